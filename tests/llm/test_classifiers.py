import itertools
import math
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from slideframe.llm import quality, toxicity
from slideframe.llm.labelled import held_out, logistic

SF = "/root/testdata/sf0.01"


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out(spark):
    got = spark.createDataFrame([(i,) for i in [*range(40), -3, None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(g["h"] == (g["doc_id"] is None or zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)


def test_accuracy_on_held_out_rows(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")  # the smaller tables hold out too few rows of label 1
    for module, target, threshold, least in ((quality, "quality", 0.3, 0.98), (toxicity, "toxic", 0.5, 0.95)):
        out = module.score(docs, module.fit(docs, labels)).join(labels.withColumnRenamed("doc_id", "id"), "id").where(held_out(F.col("id"))).toPandas()
        assert out["score"].between(0, 1).all()
        y = out[target].to_numpy()
        assert auc(out["score"].to_numpy(), y) > least
        assert ((out["score"] >= threshold) == (y == 1)).mean() > 0.97


def test_edge_rows(spark):
    docs, labels = tables(spark)
    few = spark.createDataFrame([(1, ""), (2, None), (None, "x y"), (1, ""), (3, "é" * 5000), (4, " \n ")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("y", F.lit(0))
    clash = labels.withColumn("text", F.lit("clash"))
    for module, target in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, clash, target, rows=200)
        got = module.score(few, model).collect()
        assert len(got) == 6 and all(0 <= g["score"] <= 1 for g in got)
        assert got[0]["score"] == got[1]["score"] == got[3]["score"]
        assert module.score(few.limit(0), model).count() == 0
        bare = module.fit(docs, labels.where("doc_id < 0"), target)
        assert all(0 <= g["score"] <= 1 for g in module.score(few, bare).collect())
        odd = labels.where("doc_id % 2 = 0").withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id"))).unionByName(labels.withColumn(target, F.lit(None).cast("int")))
        module.fit(docs, odd, target, rows=50)


def test_segments_against_brute_force():
    """Maximal segments are those whose every proper part sums to less, and that no larger such segment holds."""
    r = random.Random(4)
    for _ in range(300):
        v = np.array([r.choice([-3.0, -2.0, -1.0, 1.0, 2.5]) + r.random() / 100 for _ in range(r.randrange(1, 11))])
        c = np.concatenate([[0], np.cumsum(v)])
        good = [(a, b) for a, b in itertools.combinations(range(len(c)), 2) if all(c[a] < c[i] for i in range(a + 1, b + 1)) and all(c[b] > c[i] for i in range(a, b))]
        want = [(a, b) for a, b in good if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in good)]
        assert [(a, b) for a, b, _ in toxicity.segments(v)] == want


def test_segments_take_linear_time():
    """A million words of falling sums: every search for a smaller sum before must not walk over all of them."""
    began = time.process_time()
    assert len(toxicity.segments(np.tile([1.0, -2.0], 500_000))) == 500_000
    assert time.process_time() - began < 8


def test_units():
    assert list(toxicity.units("words")) == ["wor", "word", "=words"]


def plain_score(word, counts, base):
    rate = base
    for u in [word[:k] for k in (3, 4, 5, 6, 7, 8) if k < len(word)] + ["=" + word]:
        n, y = counts.get(u, (0, 0))
        rate = (y + 10 * rate) / (n + 10)
    return min(6, max(-3, math.log(rate / (1 - rate)) - math.log(base / (1 - base)) - 1.5))


def plain_segments(v):
    """By Ruzzo and Tompa's recursion: the best segment, then those of the rest on both sides."""
    c = [0.0, *itertools.accumulate(v)]
    best = max(((c[b] - c[a], -(b - a), -a, b) for a, b in itertools.combinations(range(len(c)), 2)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = -best[2], best[3]
    return plain_segments(v[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in plain_segments(v[b:])]


def test_toxicity_against_brute_force(spark):
    """The whole operator on a small corpus: counts, word scores, segments, significance, weights."""
    r = random.Random(8)
    bad, good = ["vile", "vilest", "hateful", "scum"], ["tree", "river", "stone", "cloud", "hat", "a", "rivers"]
    texts, y = {}, {}
    for i in range(240):
        y[i] = int(r.random() < 0.3)
        w = [r.choice(good) for _ in range(r.randrange(1, 12))]
        if y[i] or r.random() < 0.05:
            at = r.randrange(len(w) + 1)
            w[at:at] = [r.choice(bad).upper() if r.random() < 0.2 else r.choice(bad) for _ in range(r.randrange(1, 4))]
        texts[i] = ", ".join(w)
    texts[500], texts[501] = "", "VILE scum, " * 6 + "tree " * 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {g["id"]: g for g in toxicity.score(docs, model).collect()}
    used = [i for i in y if zlib.crc32(str(i).encode()) % 5]
    ids = spark.createDataFrame([(i,) for i in used], "id long")
    calibrating = {g["id"] for g in ids.where(F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0).collect()}
    counting = [i for i in used if i not in calibrating]
    base = (sum(y[i] for i in counting) + 0.5) / (len(counting) + 1)
    counts = {}
    for i in counting:
        words = set(re.findall("[a-z]+", texts[i].lower()))
        for u in {w[:k] for w in words for k in range(3, 9) if k < len(w)} | {"=" + w for w in words}:
            n, m = counts.get(u, (0, 0))
            counts[u] = (n + 1, m + y[i])
    assert len({toxicity.cell(u) for u in counts}) == len(counts)
    values = {i: [plain_score(w, counts, base) for w in re.findall("[a-z]+", t.lower())] for i, t in texts.items()}
    flat = np.array([v for i in calibrating if not y[i] for v in values[i]])
    assert abs(np.exp(model.lam * flat).mean() - 1) < 0.01 and model.base == base
    tops = [model.lam * max((s for *_, s in plain_segments(values[i])), default=0.0) - math.log(len(values[i])) for i in calibrating if not y[i]]
    assert math.isclose(model.log_k, np.mean(tops) - 0.5772156649, abs_tol=1e-6)

    def features(i):
        n, sums = len(values[i]), sorted((s for *_, s in plain_segments(values[i])), reverse=True)
        z = [model.lam * s - model.log_k - math.log(max(n, 1)) for s in sums]
        return [min(z[0], 40) if z else -10, math.log1p(sum(max(v, 0) for v in z)), math.log1p(sum(sums[:5])), math.log1p(sum(sums)) - 0.5 * math.log1p(n)]

    x = np.array([features(i) + [1.0] for i in sorted(calibrating)])
    w = np.array(model.weights)
    slope = x.T @ (np.array([y[i] for i in sorted(calibrating)]) - 1 / (1 + np.exp(-(x @ w)))) - np.array([1, 1, 1, 1, 1e-6]) * w
    assert np.abs(slope).max() < 1e-5  # the weights are where the penalised likelihood is flat
    for i in texts:
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-(np.array(features(i) + [1.0]) @ w))), rel_tol=1e-6)
        spans = [m.span() for m in re.finditer("[A-Za-z]+", texts[i])]
        want = []
        for a, b, s in plain_segments(values[i]):
            p = 1 - math.exp(-len(values[i]) * math.exp(model.log_k - model.lam * s))
            if p <= 0.05:
                want.append((spans[a][0], spans[b - 1][1]))
        assert [(p["start"], p["end"]) for p in got[i]["passages"]] == want
    assert got[501]["passages"] and got[501]["score"] > 0.5 and not got[500]["passages"]


def test_long_texts(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels, rows=300)
    q = quality.fit(docs, labels, rows=300)
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert all(0 <= g["score"] <= 1 for m, module in ((model, toxicity), (q, quality)) for g in module.score(long, m).collect())


def test_quality_against_plain_ridge(spark):
    """Fold by fold against one dense least-squares solution, and the calibrated score by hand."""
    docs, labels = tables(spark)
    model = quality.fit(docs, labels, rows=10_000)
    known = {g["doc_id"]: g["quality"] for g in labels.collect() if zlib.crc32(str(g["doc_id"]).encode()) % 5}
    rows = sorted((g["doc_id"], g["text"] or "") for g in docs.collect() if g["doc_id"] in known)
    x = np.array([quality.statistics(t) for _, t in rows])
    y = np.array([known[i] for i, _ in rows], float)
    assert np.allclose(x.mean(axis=0), model.mean) and np.allclose(np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), model.scale)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    f = np.column_stack([np.sqrt(2 / model.freq.shape[1]) * np.cos(z @ model.freq + model.phase), z / 10, np.ones(len(z))])

    def ridge(f, y):  # as least squares with one more row for each penalty
        return np.linalg.lstsq(np.vstack([f, np.sqrt(0.3) * np.eye(f.shape[1])]), np.concatenate([y, np.zeros(f.shape[1])]), rcond=None)[0]

    assert np.allclose(ridge(f, y), model.beta, atol=1e-6)
    ids = spark.createDataFrame([(i,) for i, _ in rows], "id long")
    fold = dict(ids.select("id", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(4))).collect())
    fold = np.array([fold[i] for i, _ in rows])
    raw = np.concatenate([f[fold == k] @ ridge(f[fold != k], y[fold != k]) for k in range(4)])
    truth = np.concatenate([y[fold == k] for k in range(4)])
    truth, raw = truth[np.argsort(raw, kind="stable")], np.sort(raw)
    n, c = len(truth), np.concatenate([[0], np.cumsum(truth)])
    mean = np.array([[(c[b + 1] - c[a]) / (b + 1 - a) if a <= b else np.inf for b in range(n)] for a in range(n)])
    fit = np.round([mean[: i + 1, i:].min(axis=1).max() for i in range(n)], 9)  # max-min formula
    assert np.allclose(np.unique(fit), model.values) and np.allclose([raw[fit == v].mean() for v in np.unique(fit)], model.knots)
    got = {g["id"]: g["score"] for g in quality.score(docs, model).collect()}
    out = f @ model.beta
    want = np.clip(0.99 * np.interp(out, model.knots, model.values) + 0.01 / (1 + np.exp(-np.clip(8 * (out - 0.5), -30, 30))), 0, 1)
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-9)


def test_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=60)
    y = (x + r.normal(size=60) > 0).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    xs, ys = np.sort(x), y[np.argsort(x)]
    fit = np.array([max(min(ys[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])  # max-min formula
    assert np.allclose(sorted(set(np.round(fit, 9))), np.round(values, 9))
    assert len(xs) == 60


def test_logistic_finds_the_boundary():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 2))
    w = logistic(x, (x[:, 0] > 0).astype(float), 0.1)
    assert w[0] > 3 and abs(w[1]) < 1
