"""Queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    out = nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    out = detect(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _scored(scores: DataFrame, threshold: float, *more: Column) -> DataFrame:
    from .labelled import held_out

    return scores.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5, F.size("passages").cast("long").alias("n_passages"), F.array_min("passages.p_value").alias("least_p"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex16("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    model, members = mixing.fit(table(spark, sf_dir, "documents"))
    return mixing.rated(members, model).withColumnRenamed("id", "doc_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ann": op2_ann,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
}
