"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Words of the benchmark are counted over all documents. Every benchmark window
is then searched from its rarest word: postings of those words (document,
position, the words around) are stored, joined to the windows by word, and the
alignment given by the two offsets is intersected word by word outwards.

Scale: the texts are parsed once, into a table of words in the shared folder
that counting, posting and sizes read. What travels is the postings of rare
benchmark words. Benchmark tables are broadcast only while their values take
at most ``BROADCAST_BYTES``, as measured; beyond that Spark joins them by
shuffle, with words counted and contexts cut before. A benchmark row holds the words
around one position, never a whole item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, stored_bytes, written

#: ASCII but for digits and letters parts words; A-Z is lower-cased first.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))  # the first is faster, and the same in ASCII
    return F.array_remove(F.split(low, SEPARATORS), "")


def _fits(df: DataFrame) -> bool:
    """Whether a stored benchmark table may be broadcast."""
    return stored_bytes(df) <= BROADCAST_BYTES


def _small(df: DataFrame) -> DataFrame:
    """A stored benchmark table, marked for broadcast if its size allows."""
    return F.broadcast(df) if _fits(df) else df


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r, w): r tells apart different texts that share an id."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("r"), words(F.col(text_col)).alias("w"))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, key, w) of the items that have words; a null id is the empty string."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    return durable(items.withColumn("key", F.xxhash64("item", "w")))


def _context(at: str, radius: int) -> tuple[Column, Column]:
    """Up to ``radius`` words of ``w`` to the left of a position, nearest first, and those to the right."""
    return F.expr(f"reverse(slice(w, greatest({at} - {radius}, 0) + 1, least({at}, {radius})))"), F.expr(f"slice(w, {at} + 2, {radius})")


def anchors_of(items: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(term, item, left, right): positions so chosen that each window holds its rarest word's position, with the words around."""
    vocabulary = durable(items.select(F.explode("w").alias("term")).distinct())
    # an outer explode: a plain one adds a filter that would read each array twice; the null of an empty one meets no term
    seen = docs.select(F.explode_outer("w").alias("term"))
    count = F.count("*").alias("df")
    found = seen.join(F.broadcast(vocabulary), "term").groupBy("term").agg(count) if _fits(vocabulary) else seen.groupBy("term").agg(count).join(vocabulary, "term")
    listed = items.select("key", F.posexplode("w").alias("at", "term")).join(durable(found), "term", "left")
    ranks = listed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("df", F.lit(0)).alias("df")))).alias("t"))
    rarest = F.expr(f"""explode(array_distinct(transform(sequence(0, greatest(size(t) - {window}, 0)),
        s -> array_min(transform(slice(t, s + 1, {window}), x -> struct(x.df as df, x.at as at))))))""")
    chosen = ranks.select("key", rarest.alias("a")).where("a.df > 0").select("key", F.col("a.at").alias("at"))
    left, right = _context("at", window - 1)
    return durable(items.join(chosen, "key").select(F.col("w")[F.col("at")].alias("term"), "item", left.alias("left"), right.alias("right")).distinct())


def postings_of(docs: DataFrame, terms: DataFrame, radius: int) -> DataFrame:
    """The index: (term, id, r, pos, before, after) of every occurrence of the terms.

    ``before`` holds up to ``radius`` words to the left, nearest first, ``after`` those to the right.
    """
    before, after = _context("pos", radius)
    cut = ["term", "id", "r", "pos", before.alias("before"), after.alias("after")]
    rows = docs.select("id", "r", "w", F.posexplode_outer("w").alias("pos", "term"))
    return rows.join(F.broadcast(terms), "term").select(*cut) if _fits(terms) else rows.select(*cut).join(terms, "term")


def _run(a: str, b: str) -> Column:
    """How many leading words two arrays share."""
    same = f"zip_with({a}, {b}, (x, y) -> coalesce(x = y, false))"
    return F.expr(f"case when array_position({same}, false) = 0 then size({same}) else array_position({same}, false) - 1 end")


def phrase_hits(postings: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(id, r, item, lo, hi): word ranges, ends exclusive, that consist of occurring windows."""
    runs = postings.join(_small(anchors), "term").withColumns({"a": _run("before", "left"), "b": _run("after", "right")})
    need = F.least(F.size("left") + F.size("right") + 1, F.lit(window))  # fewer only for items that are shorter
    return runs.where(F.col("a") + F.col("b") + 1 >= need).select("id", "r", "item", (F.col("pos") - F.col("a")).cast("long").alias("lo"), (F.col("pos") + F.col("b") + 1).cast("long").alias("hi")).distinct()


def near_ranges(postings: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(id, r, item, lo, hi): contexts of postings, as word ranges, that hold all words of a window in any order."""
    around = anchors.select("term", "item", F.size("left").alias("at"), F.concat(F.reverse("left"), F.array("term"), "right").alias("w"))
    windows = around.withColumn("s", F.expr(f"explode(sequence(greatest(at - {window} + 1, 0), least(at, greatest(size(w) - {window}, 0))))"))
    windows = durable(windows.select("term", "item", F.expr(f"array_distinct(slice(w, s + 1, {window}))").alias("need")).distinct())
    met = postings.join(_small(windows), "term").where(F.size(F.array_except("need", F.concat("before", "after", F.array("term")))) == 0)
    return met.select("id", "r", "item", (F.col("pos") - F.size("before")).cast("long").alias("lo"), (F.col("pos") + F.size("after") + 1).cast("long").alias("hi")).distinct()


def near_hits(postings: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """(id, r, item): proximity matches, windows all of whose words occur, in any order, in one posting's context."""
    return near_ranges(postings, anchors, window).select("id", "r", "item").distinct()


def _indexed(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parsed documents, the anchors, and the stored index."""
    parsed = written(_documents(docs, id_col, text_col).withColumn("n_words", F.size("w").cast("long")))
    items = items_of(benchmark, item_col, item_text_col)
    anchors = anchors_of(items, parsed, window)
    return parsed, anchors, durable(postings_of(parsed, durable(anchors.select("term").distinct()), window - 1))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, r, item, lo, hi, exact): what of which item is where in which document, as word ranges with exclusive ends.

    Exact ranges consist of occurring windows. The others are proximity
    matches, contexts that hold all words of a window in any order and no exact
    range of the item; contexts of neighbouring words overlap. Repeated rows count once.
    """
    _, anchors, index = _indexed(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    exact = durable(phrase_hits(index, anchors, window))
    inside = F.expr("n.id <=> e.id and n.r = e.r and n.item = e.item and n.lo <= e.lo and e.hi <= n.hi")
    near = near_ranges(index, anchors, window).alias("n").join(exact.alias("e"), inside, "left_anti")
    return exact.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, r, n_words, n_hit, n_items, items, contaminated) per row of ``docs``.

    A window is ``window`` consecutive words of an item, or all of a shorter
    one. A document word inside any occurrence of a window is hit;
    ``contaminated`` needs a hit and ``share * n_hit >= n_words``. ``items`` lists
    the ids met, sorted as strings, comma-joined. Null texts have no words; an
    item whose id is null is listed as the empty string; items that share an
    id count once. Repeated rows get equal results, null ids results of their
    own. ``r`` is the hash of the text. Other columns are not read. Proximity
    matches don't count here; ``matches`` lists them, and all positions.
    """
    parsed, anchors, index = _indexed(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    hits = durable(phrase_hits(index, anchors, window))
    # the union of ranges: what each range adds beyond the furthest end before it
    order = W.partitionBy("id", "r").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    adds = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(order), F.col("lo"))), F.lit(0))
    n_hit = hits.select("id", "r", "lo", "hi").distinct().withColumn("adds", adds).groupBy("id", "r").agg(F.sum("adds").alias("n_hit"))
    met = hits.select("id", "r", "item").distinct().groupBy("id", "r").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    met = n_hit.alias("n").join(met.alias("m"), F.expr("n.id <=> m.id and n.r = m.r")).select("n.id", "n.r", "n_hit", "n_items", "items")
    sizes = parsed.select("id", "r", "n_words")
    out = sizes.alias("d").join(met.alias("m"), F.expr("d.id <=> m.id and d.r = m.r"), "left")
    out = out.select("d.id", "d.r", "n_words", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hit", "n_items")], F.coalesce("items", F.lit("")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, that aren't contaminated."""
    found = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = durable(found.where("contaminated").select(F.col("id").alias("_bad_id"), F.col("r").alias("_bad_r")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text_col)) == F.col("_bad_r"))
    return docs.join(_small(bad), same, "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, words)
), pos AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN met USING (doc_id)
"""
