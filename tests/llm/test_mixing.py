import numpy as np
from pyspark.sql import functions as F

from slideframe.llm import mixing

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain(members, targets, ridge=1e-3, steps=20000):
    """The same least-squares problem by many small projected steps."""
    t = np.array([m["tokens"] for m in members], float)
    p = np.array([m["p"] for m in members])
    total = t.sum()
    inv = np.linalg.inv((p * t[:, None]).T @ p / total + 1e-9 * np.eye(p.shape[1]))
    r = np.ones(len(t))
    for _ in range(steps):
        r = np.maximum(0, r - 0.1 * (p @ (inv @ (((t * r) @ p - targets) / total)) + ridge * (r - 1)))
    return r


def test_posteriors_find_the_language(spark):
    docs = spark.read.parquet(DOCS)
    model, members = mixing.fit(docs)
    got = mixing.rated(members, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("tokens > 20").toPandas()
    assert (got["domain"] == got["lang"]).mean() > 0.9
    assert np.abs(model.reached - model.targets).max() <= 1e-3 * model.targets.sum()
    assert (got["rate"] > 0.5).all()


def test_rates_match_targets_and_plain_solution(spark):
    docs = spark.read.parquet(DOCS)
    model, members = mixing.fit(docs, targets={"en": 1.0, "fr": 1.0, "de": 1.0, "es": 1.0})
    rows = members.orderBy("id").collect()
    rates = np.array([g["rate"] for g in mixing.rated(members, model).orderBy("id").collect()])
    want = plain(rows, model.targets)
    assert (rates >= 0).all()
    assert np.abs(model.reached / model.reached.sum() - 0.25).max() < 0.01
    assert np.abs(rates - want).max() < 0.1


def test_copies_follow_rates(spark):
    docs = spark.read.parquet(DOCS).withColumn("rate", F.lit("clash")).withColumn("p", F.lit(0))
    model, _ = mixing.fit(docs)
    got = mixing.mixed(docs, model).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).toPandas()
    assert ((got["n"] >= np.floor(got["rate"])) & (got["n"] <= np.floor(got["rate"]) + 1)).all()


def test_edges(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    model, members = mixing.fit(empty)
    assert mixing.rated(members, model).count() == 0 and mixing.mixed(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (None, "", None), (2, "x y", "a"), (2, "x y", "a"), (3, "é" * 9000, "b"), (4, "zz", None)], schema)
    model, members = mixing.fit(odd)
    got = mixing.rated(members, model).collect()
    assert len(got) == 6 and all(g["rate"] >= 0 for g in got)
    model, members = mixing.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {g["rate"] for g in mixing.rated(members, model).collect()} == {1.0}
    bound = mixing.fit_domains(spark.read.parquet(DOCS), most=2)
    assert bound.domains[-1] == mixing.OTHER and len(bound.domains) == 3
