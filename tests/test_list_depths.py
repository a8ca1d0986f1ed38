"""The registered query of list depths on documents longer than those its SQL reads."""

import random

from slideframe import queries


def brute(text):
    depths = []
    for line in text.split("\n"):
        depths.append(min(len(line) % 9, depths[-1] + 1) if depths else 0)
    return depths


def test_every_line_has_a_depth(spark, tmp_path):
    r = random.Random(4)
    docs = [(i, "\n".join("x" * r.randrange(30) for _ in range(n))) for i, n in enumerate([1, 59, 60, 61, 62, 500])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(g) for g in queries.QUERIES["list_depths"](spark, str(tmp_path)).collect())
    assert got == [(i, n, d) for i, t in docs for n, d in enumerate(brute(t))]
