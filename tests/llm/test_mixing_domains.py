"""Every label is a domain, however many or rare; targets are never ignored."""

import numpy as np
import pytest

from slideframe.llm import mixing


def text(i, j):
    """Words of label i have byte pairs of their own."""
    a, b = chr(0x4E00 + 7 * i), chr(0x4E00 + 7 * i + 3)
    return f"{a}{b} " * 30 + b * (j % 5 + 1)


@pytest.fixture(scope="module")
def many(spark):
    """70 labels of which the last is on one row, and one very common label."""
    rows = [(i, text(i, j), f"d{i:02}") for i in range(69) for j in range(3)] + [(0, text(0, j) + f" {j}", "d00") for j in range(3000)] + [(69, text(69, 0), "d69")]
    return spark.createDataFrame([(n, t, y) for n, (_, t, y) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)


def test_every_label_is_kept(many):
    for rows in (20_000, 100):
        model = mixing.fit_domains(many, rows=rows)
        assert sorted(model.domains) == [f"d{i:02}" for i in range(70)]
        assert np.isclose(np.exp(model.prior).sum(), 1) and np.isclose(np.exp(model.prior).max(), 3003 / 3208)
    model, members = mixing.fit(many)
    got = {g["id"]: g["domain"] for g in mixing.rated(members, model).collect()}
    want = {g["doc_id"]: g["lang"] for g in many.collect()}
    assert len(got) == 3208 and sum(got[i] == want[i] for i in want) > 0.99 * len(want)


def test_a_target_of_a_rare_label_is_met(many):
    targets = {f"d{i:02}": 1.0 for i in range(70)}
    model, _ = mixing.fit(many, targets=targets)
    assert np.abs(model.reached / model.reached.sum() - 1 / 70).max() < 2e-3


def test_targets_that_are_not_modelled(many):
    with pytest.raises(ValueError, match="nowhere"):
        mixing.fit(many, targets={"d00": 1.0, "nowhere": 1.0})
    model = mixing.fit_domains(many, most=2)
    members = mixing.memberships(many, model)
    with pytest.raises(ValueError):
        mixing.fit_rates(members, model, {d: 1.0 for d in model.domains[:2]})
    mixing.fit_rates(members, model, {d: 1.0 for d in model.domains})


def test_copies_do_not_enlarge_the_sample():
    assert mixing._level([3, 3, 10_000], 100) == 94 and mixing._level([5, 7], 100) == 50
    assert mixing._level([1000] * 10_000, 20_000) == mixing.LEAST_SAMPLE
