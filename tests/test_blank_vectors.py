"""The registered query of blank vectors at its limit, and on null and odd components, against its SQL."""

import duckdb
import pytest

from compare import both
from slideframe import queries

LIMIT = 0.3499999940395355  # 0.35 as a float; less than 0.35 as a double
ODD = [
    ([0.1, LIMIT], False),
    ([-LIMIT], False),
    ([0.34999996423721313, -0.34999996423721313], True),  # the float below
    ([0.3500000238418579], False),  # the float above
    ([None], True),
    ([0.1, None], True),
    ([None, 0.9], False),
    ([float("nan")], False),
    ([float("-inf"), 0.0], False),
    ([], True),
    (None, None),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_limit_nulls_and_odd_components(spark, tmp_path, kind):
    spark.createDataFrame([(i, v) for i, (v, _) in enumerate(ODD)], f"vec_id long, embedding array<{kind}>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ours, theirs = both(spark, str(tmp_path), con, queries.QUERIES["blank_vectors"], queries.SQL["blank_vectors"])
    assert ours == theirs
    if kind == "float":
        assert sorted((i, blank) for blank, i in ours) == [(i, blank) for i, (_, blank) in enumerate(ODD)]
