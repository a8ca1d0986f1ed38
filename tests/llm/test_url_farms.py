"""Hosts without rules that link to blocked ones get the same verdict however many they are."""

import pytest

from slideframe.llm import url_filter as uf


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return {g["host"]: (g["verdict"], round(g["distrust"], 6)) for g in uf.judge(df).collect() if g["rule"] is None}


def link(host):
    return f'<a href="//{host}/">x</a>'


@pytest.mark.parametrize("k", [1, 2, 3, 100])
def test_farms_of_any_size(spark, k):
    rows = [("http://spam.com/de/", "")] + [(f"http://farm{i}.net/", link("spam.com")) for i in range(k)]
    # seeds with one page of four and three of four blocked; a host half of whose links go to a blocked one
    rows += [(f"http://part{n}.com/{'de' if i < n else 'xx'}/", "") for n in (1, 3) for i in range(4)]
    rows += [(f"http://by{n}x{i}.net/", link(f"part{n}.com")) for n in (1, 3) for i in range(k)]
    rows += [(f"http://mixed{i}.net/", link("spam.com") + link("other.net")) for i in range(k)]
    got = verdicts(spark, rows)
    for i in range(k):
        assert got[f"farm{i}.net"] == ("block", 0.85)
        assert got[f"by1x{i}.net"] == ("allow", 0.2125)
        assert got[f"by3x{i}.net"] == ("block", 0.6375)
        assert got[f"mixed{i}.net"] == ("allow", 0.425)


@pytest.mark.parametrize("k", [1, 100])
def test_trust_does_not_thin_out_either(spark, k):
    """Hosts that an allowed host links to stay, however many others it links to."""
    rows = [("http://good.org/", "".join(link(f"site{i}.net") for i in range(k))), ("http://spam.com/de/", "")]
    rows += [(f"http://site{i}.net/", link("spam.com")) for i in range(k)]
    assert set(verdicts(spark, rows).values()) == {("allow", 0.85)}
