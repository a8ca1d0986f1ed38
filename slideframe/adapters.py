"""Deck-shaped views of ordinary tables, so that operators run on any parquet data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as positioned blocks; the line number repeats, so doc_ord numbers all keys."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("slide_id"),
        F.row_number().over(w).alias("doc_ord"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'image' ELSE 'html' END").alias("type"),
        (F.col("l_partkey") * 7919 % 6000000).alias("y"),
        (F.col("l_suppkey") * 104729 % 12000000).alias("x"),
        F.expr("CASE WHEN l_linenumber = 3 THEN 0L ELSE CAST(floor(l_extendedprice * 30) AS BIGINT) END").alias("cx"),
        F.expr("CASE WHEN l_linenumber = 5 THEN 0L ELSE CAST(floor(l_quantity) AS BIGINT) * 40000 END").alias("cy"),
    )


#: The same for DuckDB.
BLOCKS_SQL = """g AS (SELECT l_orderkey AS slide_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS doc_ord,
  CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'image' ELSE 'html' END AS type,
  l_partkey * 7919 % 6000000 AS y, l_suppkey * 104729 % 12000000 AS x,
  CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(floor(l_extendedprice * 30) AS BIGINT) END AS cx,
  CASE WHEN l_linenumber = 5 THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) * 40000 END AS cy FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, numbered from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = """d AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, l[i + 1] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(len(l))) AS i))"""
