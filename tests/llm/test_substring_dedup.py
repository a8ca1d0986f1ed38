import random

import numpy as np
from pyspark.sql import functions as F

from slideframe.llm import substring_dedup as sd


def brute(rows, k):
    """{(id, text): (n_words, n_removed, kept)} by looking at every window."""
    first = {}
    low = lambda d: -1e30 if d is None else d
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - k + 1):
            key, at = tuple(w[i : i + k]), (low(d), i)
            first[key] = min(first.get(key, at), at)
    out = {}
    for (d, w), (_, t) in zip(words, rows, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (low(d), i):
                gone.update(range(i, i + k))
        out[d, t] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def rows_of(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "日本", " x", "\x85"]
    passage = [r.choice(vocab) for _ in range(55)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 19, 20, 21, 80, 300]))]
        if i % 3 == 0:
            w = w[: len(w) // 2] + passage[r.randrange(20) :] + w[len(w) // 2 :]
        if i % 10 == 0:
            w = ["same"] * 200
        rows.append((i * 7 % 1000, "".join(x + r.choice([" ", "\n", "\t ", "\x0b"]) for x in w)))
    return rows + [(5000, rows[0][1]), (None, rows[3][1]), (6000, None), (6001, ""), (6002, " \n ")]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("_t", F.lit(1)).repartition(5)
    got = sd.dedup_substrings(df, **kw).collect()
    want = brute(rows, kw.get("k", 20))
    by_id = {}
    for (d, _), v in want.items():
        by_id.setdefault(d, []).append(v)
    assert len(got) == len(rows)
    for g in got:
        assert (g["n_words"], g["n_removed"], g["kept_text"]) in by_id[g["id"]], g


def test_against_brute_force(spark):
    check(spark, rows_of(1))


def test_small_buckets_and_hot_bins(spark):
    check(spark, rows_of(2), bucket_bytes=2000)


def test_small_chunks(spark, monkeypatch):
    check(spark, rows_of(4), k=6, m=2, bucket_bytes=500)


def test_buckets_settled_piece_by_piece():
    rows = rows_of(6, 60)
    strings = [(d, t) for d, t in rows if t]
    packed = []
    for n, (d, t) in enumerate(strings):
        w = t.encode().split()
        if len(w) >= 20:
            body = b"".join(x + b" " for x in w)
            packed.append(sd._row(1, sd._pack(np.array([d if d is not None else -1]), np.array([n]), np.array([0]), np.array([len(body)]), body, sd.zstandard.ZstdCompressor())))
    want, got = (set(), set())
    for out, most in ((want, 1 << 30), (got, 2000)):
        for b in sd._find(20, most)(iter(packed)):
            for r, lo, hi in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                out.update((r, i) for i in range(lo, hi))
    assert want == got and want


def test_repeated_rows_and_shared_ids(spark):
    rows = rows_of(3, 20)
    rows = rows + rows[:3] + [(rows[1][0], "other " + (rows[3][1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sd.dedup_substrings(df).count() == len(rows)
    twice = [(1, " ".join(f"a{i}" for i in range(30)))] * 2
    got = sd.dedup_substrings(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert [g["n_removed"] for g in got] == [0, 0]


def test_empty(spark):
    assert sd.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_hashes_of_different_words():
    """Hashes that clash must not make different windows equal."""
    r = random.Random(9)
    k, strings, ids, start = 3, [], [], []
    for i in range(40):
        strings.append("".join(r.choice("ab") + " " for _ in range(r.randrange(3, 9))).encode())
        ids.append(i)
        start.append(0)
    bad = lambda h, k: sd.run_hashes(h, k) % np.uint64(3)
    want = sd.later_windows(np.array(ids), np.array(start), np.array([len(s) for s in strings]), b"".join(strings), k)
    got = sd.later_windows(np.array(ids), np.array(start), np.array([len(s) for s in strings]), b"".join(strings), k, bad)
    assert set(zip(want[0].tolist(), want[1].tolist(), strict=True)) == set(zip(got[0].tolist(), got[1].tolist(), strict=True))
    seen, brute_out = set(), set()
    for i, s in enumerate(strings):
        w = s.split()
        for j in range(len(w) - k + 1):
            if tuple(w[j : j + k]) in seen:
                brute_out.add((i, j))
            seen.add(tuple(w[j : j + k]))
    assert brute_out == set(zip(got[0].tolist(), got[1].tolist(), strict=True))
