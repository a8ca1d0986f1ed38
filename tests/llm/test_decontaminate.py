import random
import re

from pyspark.sql import functions as F

from slideframe.llm import decontaminate as dc

LOW = str.maketrans(dc.UPPER, dc.LOWER)


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, window):
    out = []
    for d, t in docs:
        w = tokens(t)
        hit, met = set(), set()
        for i, it in items:
            iw = tokens(it)
            k = min(window, len(iw))
            wins = {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if k else set()
            for s in range(len(w) - k + 1 if k else 0):
                if tuple(w[s : s + k]) in wins:
                    hit.update(range(s, s + k))
                    met.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(met), ",".join(sorted(met)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def data(seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "Ä", "É", "x1"] + [f"T{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 6, 7, 20, 40])))) for i in range(12)]
    items += [(1, items[0][1]), (2, None), (3, " ,. "), (None, "null item words here")]
    docs = []
    for i in range(80):
        w = [r.choice(vocab + ["filler", "Ünd"]) for _ in range(r.choice([0, 1, 5, 60, 200]))]
        for _ in range(r.randrange(3)):
            it = r.choice(items)[1] or ""
            cut = it.split()[r.randrange(3) :]
            at = r.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((i, "".join(x + r.choice([" ", "\n", ", ", "-"]) for x in w)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (102, items[5][1].upper()), docs[0], (7, "null item WORDS here"), (103, "the " * 300)]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("w", F.lit(0)).repartition(4),
        spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("key", F.lit(2)),
    )


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    d, i = frames(spark, docs, items)
    for window, most in ((7, 1 << 20), (13, 1 << 20), (7, -1)):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", most)
        got = [(g["id"], g["n_words"], g["n_hit"], g["n_items"], g["items"], g["contaminated"]) for g in dc.decontaminate(d, i, window).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted(got, key=key) == sorted(brute(docs, items, window), key=key)


def test_empty_tables(spark):
    docs, items = data()
    d, i = frames(spark, docs, items)
    assert dc.decontaminate(d.limit(0), i).count() == 0
    got = dc.decontaminate(d, i.limit(0)).collect()
    assert len(got) == len(docs) and not any(g["contaminated"] or g["n_hit"] for g in got)


def test_proximity(spark):
    docs = [(1, "c x b y a z"), (2, "a b"), (3, "a q q q q q q q b c")]
    d, i = frames(spark, docs, [(9, "a b c")])
    parsed = dc._documents(d, "doc_id", "text")
    anchors = dc.anchors_of(dc.items_of(i), parsed, 3)
    index = dc.postings_of(parsed, anchors.select("term").distinct(), 5)
    assert [(r["id"], r["item"]) for r in dc.near_hits(index, anchors, 3).collect()] == [(1, "9")]
    assert dc.phrase_hits(index, anchors, 3).count() == 0


def test_no_python_in_the_plan(spark):
    docs, items = data()
    plan = dc.decontaminate(*frames(spark, docs, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
