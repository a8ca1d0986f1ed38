import re
from collections import Counter

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from slideframe.llm import decontaminate as dc
from slideframe.llm import mixing, pii, quality, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's rows follow from its input by the plain form of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [rows(docs)]
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if i < len(cp.STAGES) - 1:
            assert out.columns == COLUMNS
            out.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            assert docs.count() == len(rows(docs))
            kept.append(rows(docs))
        else:
            last, model = out.collect(), mixing.fit(docs)[0]
    start, good, single, clean, safe = kept

    fitted = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = list(start)
    score = fitted.score(np.array([quality.statistics(start[i]) for i in ids]))
    assert set(good) == {i for i, s in zip(ids, score, strict=True) if s >= cp.LEAST_QUALITY}

    ids = sorted(good)
    fps = [simhash.fingerprint(good[i]) for i in ids]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(single) == {ids[find(i)] for i in range(len(ids))}

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(dc.UPPER, dc.LOWER)))

    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = tokens(r["text"])
        k = min(13, len(w))
        grams |= {tuple(w[s : s + k]) for s in range(len(w) - k + 1)}
    want = set()
    for i, t in single.items():
        w, hit = tokens(t), set()
        for k in {len(g) for g in grams}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
        if not hit or 20 * len(hit) < len(w):
            want.add(i)
    assert set(clean) == want

    assert safe == {i: pii.redact(t, pii.find_spans(t)) for i, t in clean.items()}

    copies = Counter(r["doc_id"] for r in last)
    p = np.array([model.posterior(t) for t in safe.values()])
    for i, rate in zip(safe, model.rates(p, 1e-3), strict=True):
        assert int(rate + 1e-3) <= copies[i] <= int(rate + 1e-3) + 1


def test_run_survives_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "Some plain words. Here they are.", "en", "s", 1), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], docs.schema)
    both = docs.unionByName(odd).withColumn("id", F.lit("clash"))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 0 and "copy_no" in out.columns


def test_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
