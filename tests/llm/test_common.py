import numpy as np

from slideframe.llm import common


def test_hashed_sample(spark):
    df = spark.range(5000)
    few = [r["id"] for r in common.hashed_sample(df, ["id"], 100, 5000).collect()]
    assert len(few) == 100 and few == [r["id"] for r in common.hashed_sample(df.repartition(7), ["id"], 100, 6000).collect()]
    for rows in (4990, 5000, 9000):
        assert common.hashed_sample(df, ["id"], rows, 5000).count() == min(rows, 5000)
    assert common.hashed_sample(df.limit(0), ["id"], 10, 0).count() == 0


def test_words_and_hashes():
    w = common.Words([b" a bb\t", b"", b"\xc2\x85 \x0bccc", b"a"])
    assert [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [b"a", b"bb", b"\xc2\x85", b"ccc", b"a"]
    assert w.doc.tolist() == [0, 0, 2, 2, 3]
    h = w.hashes()
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert (common.word_hashes(w.buf, w.start, 2) == h).all()
    long = np.tile(h, 9)
    for k in (1, 2, 3, 5, 20):
        runs = common.run_hashes(long, k)
        assert len(runs) == 46 - k and (runs[:5] == runs[5:10]).all() and len(set(runs.tolist())) == (4 if k == 1 else 5)
    x = np.array([5, 3, 9, 1, 7, 7], np.uint64)
    assert common.sliding_min(x, 3).tolist() == [3, 1, 1, 1] and common.sliding_min(x, 7).tolist() == []
    assert common.slices(np.array([4, 0]), np.array([2, 3])).tolist() == [4, 5, 0, 1, 2]
