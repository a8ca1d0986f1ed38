import numpy as np
from pyspark.sql import functions as F

from slideframe.llm import ann

BY_20 = "id % 20 = 0"


def brute(rows, top=20, step=20):
    v = np.array([r[1] for r in rows], float)
    ids = np.array([r[0] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = np.zeros(len(rows))
        for d in range(v.shape[1]):
            s += v[i, d] * v[:, d]
        keep = np.flatnonzero(ids != ids[i])
        order = keep[np.lexsort((ids[keep], -s[keep]))][:top]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows)
    got = {}
    for g in ann.nearest(df.withColumn("id", F.lit(3)).withColumn("v", F.lit("x")), BY_20, shard_rows=600, query_rows=40).orderBy("query", "rank").collect():
        got.setdefault(g["query"], []).append((g["id"], g["score"], g["rank"]))
    assert set(got) == set(want)
    assert all([r for *_, r in x] == list(range(1, 21)) for x in got.values())
    assert sum(len({i for i, _ in want[q]} & {i for i, *_ in got[q]}) for q in want) / (20 * len(want)) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(exact[q, i] == s for q in got for i, s, _ in got[q] if (q, i) in exact)
    assert all(list(x) == sorted(x, key=lambda y: (-y[1], y[0])) for x in got.values())


def found(df, **options):
    got = {}
    for g in ann.nearest(df, BY_20, **options).orderBy("query", "rank").collect():
        got.setdefault(g["query"], []).append((g["id"], g["score"]))
    return got


def test_full_recall_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, files_recall=1, reach_recall=1, shard_rows=40, query_rows=3) == brute(rows)
    assert found(df, pivots=10, prefix=10, files_recall=1, reach_recall=1) == brute(rows)


def test_files_are_split_and_packed(spark):
    """Small bins and parts give the same answers as one bin: no pair is met twice or lost between files."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert found(df) == found(df, shard_rows=50, query_rows=4)
    first, n, bins = ann.bins_of_files({0: 5, 1: 130, 2: 3, 3: 4}, np.eye(4), 50)
    assert bins == 4 if n[1] == 3 and len({first[0], first[2], first[3]}) == 1 else bins == 5
    assert sum(n) == 6 and all(not (first[1] <= first[p] < first[1] + 3) for p in (0, 2, 3))


def test_equal_vectors(spark):
    """A third of the rows share one vector: answers are the least ids, own rows apart."""
    r = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 0.5]) if i % 3 else (i, r.normal(size=3).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, files_recall=1, reach_recall=1) == brute(rows)


def test_candidates_are_few(spark):
    """What the footrule bound lets through, on a larger made table with groups, and the recall."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(200, 32))
    v = centres[r.integers(200, size=6000)] + 0.5 * r.normal(size=(6000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>").withColumn("h", F.lit(0))
    index = ann.fit(df, 20)
    prod = ann.products(v, index.pivots)
    near, weights = ann.files(prod, index.asked), ann.orders(prod, index.prefix)
    share, kept = [], []
    for q in range(0, 6000, 60):
        score = v @ v[q]
        score[q] = -1
        gain = ann.gains(weights, weights[q])
        met = (gain >= index.least) & [bool(set(f) & set(near[q, : index.probes].tolist())) for f in near[:, : ann.POSTED].tolist()]
        share.append(met.mean())
        kept.append(met[np.argsort(-score)[:20]].mean())
        if q < 600:  # footrule by its definition: pivots beyond the prefix all stand one place behind it
            order = np.argsort(-prod[[q, q + 1], : ann.ORDERED], axis=1, kind="stable")[:, : index.prefix].tolist()
            place = [{p: a for a, p in enumerate(o, 1)} for o in order]
            end = index.prefix + 1
            far = sum(abs(place[0].get(p, end) - place[1].get(p, end)) for p in range(ann.ORDERED))
            assert far == index.prefix * (index.prefix + 1) - 2 * gain[q + 1]
    assert np.mean(share) < 0.1 and np.mean(kept) > 0.9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, -1.0]), (5, [3.0, 4.0]), (5, [3.0, 4.0])]
    bad = [(40, None), (60, []), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [None, 1.0]), (160, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    got = [tuple(g) for g in ann.nearest(spark.createDataFrame(good + bad, schema), BY_20).orderBy("query", "rank").collect()]
    assert got == [(0, 1, 5, 3.0), (0, 2, 5, 3.0), (0, 3, 1, 1.0), (0, 4, 2, 1.0), (0, 5, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 5, -4.0), (20, 5, 5, -4.0)]
    other = [(160, [1.0, 2.0, 3.0]), (7, [0.0, 0.0, 2.0]), (0, [2.0, 0.0]), (0, [1.0, 0.0]), (8, [1.0, 1.0])]
    got = sorted(tuple(g) for g in ann.nearest(spark.createDataFrame(other, schema), BY_20).select("query", "id", "score").collect())
    assert got == [(0, 0, 2.0), (0, 0, 2.0), (0, 8, 1.0), (0, 8, 2.0), (160, 7, 6.0)]  # each length by itself; rows of one id find one another
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), BY_20).count() == 0
    assert ann.nearest(spark.createDataFrame(bad[:6], schema), BY_20).count() == 0
    assert ann.nearest(spark.createDataFrame(good[:1], schema), BY_20).count() == 0
