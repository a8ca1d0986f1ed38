import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from slideframe.llm import components, simhash


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(fps, budget=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts(n=150, seed=5):
    r = random.Random(seed)
    vocab = [f"Wort{i}" for i in range(400)] + ["É", "日本"]
    base = [r.choice(vocab) for _ in range(300)]
    out = []
    for i in range(n):
        w = list(base) if i % 3 == 0 else [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 50]))]
        if i % 6 == 0 and w:
            w[r.randrange(len(w))] = "neu"
        out.append("\n".join(w))
    return out


def test_fingerprint_matches_plain_form_and_spark(spark):
    for t in [*texts(40), None, "", "  ", "A", "A b"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    one = spark.sql("select xxhash64('a b c') h").first()["h"] % (1 << 64)
    assert simhash.fingerprint("A b\tc") == one


def test_components_against_all_pairs(spark):
    t = [*texts(), None, "", None]
    ids = [i * 31 % 997 for i in range(len(t))]
    df = spark.createDataFrame(list(zip(ids, t, strict=True)), "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1))
    fps = [plain_fingerprint(x) for x in t]
    root = classes(fps)
    low = {}
    for i, c in enumerate(root):
        low[c] = min(low.get(c, 10**9), ids[i])
    want = {(ids[i], fps[i], low[c]) for i, c in enumerate(root)}
    for most in (1 << 20, 3):
        got = simhash.near_duplicates(df, most=most).collect()
        assert len(got) == len(t)
        assert {(g["id"], g["fp"] % (1 << 64), g["component"]) for g in got} == want


def test_trie_pairs_against_all_pairs():
    r = random.Random(3)
    for n in (2, 3, 10, 300):
        centre = r.getrandbits(64)
        x = np.array(sorted({centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}) for _ in range(n)} | {r.getrandbits(64) for _ in range(n)}), np.uint64)
        got = {p for i, j in simhash.trie_pairs(x, np.array([0, len(x)]), 2) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if bin(int(x[i]) ^ int(x[j])).count("1") <= 2}


def test_connected_components(spark):
    r = random.Random(8)
    chain = [(i, i + 1) for i in range(60)]
    pairs = chain + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = np.arange(600)
    components.unite(parent, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got == {n: int(parent[n]) for n in {x for a, b in pairs if a != b for x in (a, b)}}


def test_empty_and_ties(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(4, "a b c d")] * 3 + [(None, "a b c d")], schema)).collect()
    assert [g["component"] for g in got] == [4] * 4
