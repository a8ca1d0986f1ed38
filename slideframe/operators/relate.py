"""Joins, cascades, set operations and aggregates over deck tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..durable import durable
from ..functions.geometry import boxes_overlap

#: A dimension is broadcast only while it has at most so many rows.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Mark a dimension for broadcast if a count proves it small; else Spark chooses."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def last_wins(rels: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """One row a key: the last in document order."""
    rest = [c for c in rels.columns if c not in key]
    return rels.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def first_match(rels: DataFrame, key: tuple[str, ...], pattern: str, name: str, order: str = "ord", target: str = "target") -> DataFrame:
    """The first target of each key that matches a pattern."""
    return rels.where(F.col(target).rlike(pattern)).groupBy(*key).agg(F.min_by(target, order).alias(name))


def chain(base: DataFrame, hops: list[tuple[DataFrame, str, str]], default: Column, name: str) -> DataFrame:
    """Follow optional links hop by hop; a broken chain gives the default."""
    out = base
    for dim, left, right in hops:
        out = out.join(dim, F.col(left) == F.col(right), "left")
    return out.withColumn(name, F.coalesce(F.col(name), default)) if name in out.columns else out


def cascade(*columns: Column, default=None) -> Column:
    """The first value that is set and not zero, else the default."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns], F.lit(default))


def font_size(run, paragraph, list_style, layout, master, scale=None) -> Column:
    """A run's size in 1/100 pt: its own even if zero, else the first inherited; scaled by autofit."""
    inherited = F.coalesce(F.nullif(paragraph, F.lit(0)), list_style, layout, master, F.lit(0))
    size = F.coalesce(run, inherited)
    return size if scale is None else F.when((size > 0) & (scale != 1.0), F.round(size * scale).cast("int")).otherwise(size)


def colour(name, colour_map, scheme) -> Column:
    """A scheme colour's #RRGGBB by way of its slot; the placeholder colour has none."""
    n = F.col(name) if isinstance(name, str) else name
    defaults = F.create_map(*[F.lit(x) for kv in M.DEFAULT_SCHEME.items() for x in kv])
    slot = F.coalesce(F.try_element_at(colour_map, n), n)
    value = F.coalesce(F.try_element_at(scheme, slot), F.try_element_at(defaults, slot))
    return F.when(n != "phClr", F.concat(F.lit("#"), value))


def left_biased(own: DataFrame, default: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """Union of two keyed tables in which the first one's values win."""
    return own.select(*key, value).unionByName(default.join(own, list(key), "left_anti").select(*key, value))


def members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def strangers(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def caption_pairs(rows: DataFrame, page, order, is_caption: Column, is_image: Column, caption: str, image: str) -> DataFrame:
    """Rows whose next row is an image row, with that row's image."""
    w = W.partitionBy(*page).orderBy(*order)
    marked = rows.withColumns({"_next": F.lead(is_image).over(w), "image": F.lead(image).over(w), "_cap": is_caption})
    return marked.where(F.col("_cap") & F.coalesce(F.col("_next"), F.lit(False))).select(*page, *order, F.col(caption).alias("caption"), "image")


def bounds(df: DataFrame, page) -> DataFrame:
    """The box around all boxes of a page."""
    return df.groupBy(*page).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("cx")).alias("max_x"), F.max(F.col("y") + F.col("cy")).alias("max_y"))


def largest(df: DataFrame, page, area: Column, order: str = "doc_ord") -> DataFrame:
    """The row of largest area of each page, the first in document order on ties."""
    rest = [c for c in df.columns if c not in page]
    return df.groupBy(*page).agg(F.max_by(F.struct(*rest), F.struct(area.alias("a"), (-F.col(order)).alias("o"))).alias("_r")).select(*page, "_r.*")


def top_left(df: DataFrame, page, order: str = "doc_ord") -> DataFrame:
    rest = [c for c in df.columns if c not in page]
    return df.groupBy(*page).agg(F.min_by(F.struct(*rest), F.struct("y", "x", order)).alias("_r")).select(*page, "_r.*")


def image_dominant(pictures: DataFrame, labels: DataFrame, page: str, slide_area: Column) -> DataFrame:
    """Pages led by a picture of 40 % of their area that at least two short labels overlap.

    ``slide_area`` is a column of ``pictures``. The join is by page, the overlap is a residual.
    """
    big = largest(pictures.withColumn("_area", F.col("cx") * F.col("cy")).withColumn("_slide", slide_area), (page,), F.col("_area"))
    big = big.where(F.col("_area") >= F.col("_slide") * M.DOMINANT_SHARE).select(page, F.struct("x", "y", "cx", "cy").alias("_p"))
    short = labels.where((F.char_length("text") >= 1) & (F.char_length("text") <= M.OVERLAID_CHARS)).select(page, F.struct("x", "y", "cx", "cy").alias("_l"))
    met = big.join(short, page).where(boxes_overlap(F.col("_p"), F.col("_l")))
    return met.groupBy(page).agg(F.count("*").alias("n_labels")).where(F.col("n_labels") >= M.OVERLAID_LEAST)


def over_limits(parts: DataFrame, deck, order, size: str, part_limit: int = M.PART_BYTES, total_limit: int = M.PACKAGE_BYTES) -> DataFrame:
    """Add the running size of a deck's parts and whether it breaks a limit.

    Prefix sums of ranges: the rows are dealt out by ranges of (deck, order),
    each range adds up its own rows, and its offset is the sum of the deck's ranges before
    it. A deck of any size is spread over many tasks.
    """
    dealt = durable(parts.repartitionByRange(*deck, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*deck, "_range").agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*deck).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    offsets = sums.select(*deck, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    same = F.col("a._range") == F.col("b._range")
    for c in deck:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = dealt.alias("a").join(offsets.alias("b"), same).select("a.*", "b._offset")
    w = W.partitionBy(*deck, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("running", F.col("_offset") + F.sum(size).over(w)).drop("_range", "_offset")
    return out.withColumn("over", (F.col(size) > part_limit) | (F.col("running") > total_limit))


def _named_in_turn(t: pa.Table) -> pa.Table:
    """Names of a family of clashing media, given one by one; every number is tried once a base name."""
    rows = sorted(zip(t["_n"].to_pylist(), range(t.num_rows), t["_stem"].to_pylist(), t["_ext"].to_pylist(), strict=True))
    taken, following, names = set(), {}, [""] * t.num_rows
    for _, i, stem, ext in rows:
        name, k = stem + ext, following.get((stem, ext), 1)
        while name in taken:
            name, k = f"{stem}_{k}{ext}", k + 1
        following[stem, ext] = k
        taken.add(name)
        names[i] = name
    return t.drop_columns(["_n", "_stem", "_ext"]).append_column("filename", pa.array(names, pa.string()))


def media_names(media: DataFrame, page, path: str, order: str, base: Column) -> DataFrame:
    """(page, path, filename): a page's media in first use, clashing names numbered.

    The n-th medium of a base name gets the number n - 1, without any fold over
    the page. Only where a base name looks like a number that another one of
    the page would get (``a_1.png`` beside two of ``a.png``) numbers that are taken are
    passed over; such families of names are numbered in turn, in linear time.
    """
    first = media.groupBy(*page, path).agg(F.min(order).alias("_o")).withColumn("_base", base)
    dotted = F.col("_base").contains(".")
    stem = F.when(dotted, F.regexp_extract("_base", r"(?s)^(.*)\.", 1)).otherwise(F.col("_base"))
    first = first.withColumn("_stem", stem).withColumn("_ext", F.expr("substring(_base, char_length(_stem) + 1)"))
    first = durable(first.withColumn("_root", F.concat(F.regexp_replace("_stem", "(_[1-9][0-9]*)+$", ""), "_ext")))
    keys = [*page, "_root"]
    bases = first.groupBy(*keys, "_base", "_stem", "_ext").agg(F.count("*").alias("_m"))
    numbered = bases.withColumn("_k", F.expr("try_cast(regexp_extract(_stem, '_([1-9][0-9]*)$', 1) AS bigint)")).where("_k IS NOT NULL")
    numbered = numbered.select(*keys, F.concat(F.regexp_replace("_stem", "_[1-9][0-9]*$", ""), "_ext").alias("_base"), "_k")
    clashing = durable(numbered.join(bases, [*keys, "_base"]).where("_k < _m").select(*keys).distinct())
    nth = F.row_number().over(W.partitionBy(*page, "_base").orderBy("_o", path))
    plain = first if clashing.isEmpty() else first.join(clashing, keys, "left_anti")
    name = F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat("_stem", F.lit("_"), F.col("_nth") - 1, "_ext"))
    out = plain.withColumn("_nth", nth).select(*page, path, name.alias("filename"))
    if clashing.isEmpty():
        return out
    turn = first.join(clashing, keys, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_o", path)))
    turn = turn.select(*keys, path, "_n", "_stem", "_ext")
    schema = T.StructType([f for f in turn.schema.fields if f.name in (*keys, path)] + [T.StructField("filename", T.StringType())])
    return out.unionByName(turn.groupBy(*keys).applyInArrow(lambda t: _named_in_turn(t), schema).select(*page, path, "filename"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
