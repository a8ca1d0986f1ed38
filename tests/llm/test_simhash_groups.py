"""Groups of fingerprints that agree on many bits are made smaller, and no near pair is lost."""

import random

import numpy as np
import pytest

from slideframe.llm import components, simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def skewed(r, n=400):
    """Fingerprints that agree on the upper 40 bits, and some near copies."""
    top = r.getrandbits(40) << 24
    out = {top | r.getrandbits(24) for _ in range(n)}
    out |= {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in sorted(out)[::5]}
    return sorted(out)


@pytest.mark.parametrize("most", [4, 30, 100])
def test_no_group_is_larger_than_the_bound(spark, most):
    fps = skewed(random.Random(6))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    groups = {}
    for g in simhash.groups_of(df, 2, most).collect():
        groups.setdefault(g["key"], set()).add(g["fp"] % (1 << 64))
    assert max(map(len, groups.values())) <= most
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert near and all(any(a in g and b in g for g in groups.values()) for a, b in near)
    parent = np.arange(len(fps))
    at = {x: i for i, x in enumerate(fps)}
    components.unite(parent, np.array([at[a] for a, _ in near]), np.array([at[b] for _, b in near]))
    found = np.arange(len(fps))
    edges = simhash.near_edges(df, 2, most).collect()
    components.unite(found, np.array([at[e["a"] % (1 << 64)] for e in edges]), np.array([at[e["b"] % (1 << 64)] for e in edges]))
    assert (found == parent).all()


def test_cuts_cover_the_free_bits():
    for free in ((1 << 64) - 1, 0xF0F0, 0b1011, 0b11, 0):
        cuts = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash._cuts(free, 3)]
        assert sum(a for a, _ in cuts) == free and all(a | b == free and not a & b for a, b in cuts)
