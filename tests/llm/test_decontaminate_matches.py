"""Positions of exact and of re-ordered passages."""

from slideframe.llm import decontaminate as dc


def test_matches(spark):
    docs = [(1, "c x b y a z"), (2, "a b"), (3, "a q q q q q q q b c"), (4, "q A, b c q"), (None, "b a c"), (5, None), (6, "a b c q q q q q q c b a")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    got = {(g["id"], g["item"], g["lo"], g["hi"]): g["exact"] for g in dc.matches(d, i, 3).collect()}
    assert got[4, "9", 1, 4] and got[6, "9", 0, 3]
    near = {(k[0], k[2], k[3]) for k, exact in got.items() if not exact}
    assert {n[0] for n in near} == {None, 6} and all(lo >= 7 for who, lo, _ in near if who == 6)
    assert {(k[0], k[2], k[3]) for k, exact in got.items() if exact} == {(4, 1, 4), (6, 0, 3)}
    assert dc.matches(d, i.limit(0), 3).count() == 0
    wide = spark.createDataFrame([(1, "k l m n o p q r s t u v w"), (2, "w v u t s r q p o n m l k")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "k l m n o p q r s t u v w")], "item_id long, text string")
    assert {(g["id"], g["lo"], g["hi"], g["exact"]) for g in dc.matches(wide, item).collect()} == {(1, 0, 13, True), (2, 0, 13, False)}
