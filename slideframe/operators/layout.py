"""Order of blocks: reading order, rows, columns, islands and list depths.

Every operator takes a frame and the columns that key a page. Rows of a page are
brought together once, by hash of those keys; later steps reuse that partitioning.
Sequence folds run as ``aggregate`` expressions in the JVM over one page's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model as M

PAGE = ("slide_id",)


def reading_order(blocks: DataFrame, page=PAGE, name: str = "reading_no") -> DataFrame:
    """Number the blocks of a page from 1 by band of y, then x, then document order."""
    w = W.partitionBy(*page).orderBy(F.expr(f"y div {M.ROW_BAND}"), "x", "doc_ord")
    return blocks.withColumn(name, F.row_number().over(w))


def fixed_bands(blocks: DataFrame, page=PAGE, name: str = "row_no") -> DataFrame:
    """Rows of equal bands, for pages on which no height is known."""
    return blocks.withColumn(name, F.dense_rank().over(W.partitionBy(*page).orderBy(F.expr(f"y div {M.ROW_BAND}"))))


def _members(blocks: DataFrame, page, first: tuple[str, ...]) -> DataFrame:
    """One row a page: its blocks as an array, sorted by the columns ``first``."""
    rest = [c for c in blocks.columns if c not in page and c not in first]
    return blocks.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("_b"))


def overlap_rows(blocks: DataFrame, page=PAGE, name: str = "row_no") -> DataFrame:
    """Rows of blocks whose heights overlap by half of the shorter one, the row's span growing.

    A block without height never joins a row.
    """
    pages = _members(blocks, page, ("y", "x", "doc_ord"))
    fold = """aggregate(_b, named_struct('top', 0L, 'bot', 0L, 'row', 0, 'out', cast(array() as array<int>)), (a, b) ->
        CASE WHEN a.row > 0 AND 2 * (least(a.bot, b.y + b.cy) - greatest(a.top, b.y)) >= greatest(1L, least(b.cy, a.bot - a.top))
          THEN named_struct('top', least(a.top, b.y), 'bot', greatest(a.bot, b.y + b.cy), 'row', a.row, 'out', concat(a.out, array(a.row)))
          ELSE named_struct('top', b.y, 'bot', b.y + b.cy, 'row', a.row + 1, 'out', concat(a.out, array(a.row + 1))) END).out"""
    return _spread(pages.withColumn("_n", F.expr(fold)), page, blocks.columns, name)


def _spread(pages: DataFrame, page, columns: list[str], name: str) -> DataFrame:
    """Give each member of ``_b`` its number from ``_n``."""
    rows = pages.select(*page, F.explode(F.arrays_zip("_b", "_n")).alias("_e"))
    return rows.select(*[F.col(c) if c in page else F.col("_e._b")[c].alias(c) for c in columns], F.col("_e._n").alias(name))


def rows(blocks: DataFrame, page=PAGE, name: str = "row_no") -> DataFrame:
    """Overlap rows where a page knows any height, else fixed bands."""
    known = F.max(F.col("cy") > 0).over(W.partitionBy(*page))
    both = fixed_bands(overlap_rows(blocks, page, "_by_overlap").withColumn("_known", known), page, "_by_band")
    return both.withColumn(name, F.when(F.col("_known"), F.col("_by_overlap")).otherwise(F.col("_by_band"))).drop("_by_overlap", "_by_band", "_known")


def x_clusters(blocks: DataFrame, row=(*PAGE, "row_no"), name: str = "col_no") -> DataFrame:
    """Columns of a row: blocks in x order split where they overlap by less than half of the narrower.

    With an unknown width the split is where a block starts past a gap.
    """
    pages = _members(blocks, row, ("x", "y", "doc_ord"))
    right = f"b.x + CASE WHEN b.cx > 0 THEN b.cx ELSE {M.COLUMN_GAP} END"
    split = f"""CASE WHEN a.col = 0 THEN true
        WHEN a.known AND b.cx > 0 THEN 2 * (least(a.hi, {right}) - greatest(a.lo, b.x)) < greatest(1L, least({right} - b.x, a.hi - a.lo))
        ELSE b.x >= a.hi END"""
    fold = f"""aggregate(_b, named_struct('lo', 0L, 'hi', 0L, 'known', true, 'col', 0, 'out', cast(array() as array<int>)), (a, b) ->
        CASE WHEN {split}
          THEN named_struct('lo', b.x, 'hi', {right}, 'known', b.cx > 0, 'col', a.col + 1, 'out', concat(a.out, array(a.col + 1)))
          ELSE named_struct('lo', least(a.lo, b.x), 'hi', greatest(a.hi, {right}), 'known', a.known AND b.cx > 0, 'col', a.col, 'out', concat(a.out, array(a.col))) END).out"""
    return _spread(pages.withColumn("_n", F.expr(fold)), row, blocks.columns, name)


def column_layout(clustered: DataFrame, row=(*PAGE, "row_no")) -> DataFrame:
    """Add how many columns a row has, whether they stand side by side, their grid width, and places."""
    w = W.partitionBy(*row)
    out = clustered.withColumn("n_cols", F.max("col_no").over(w)).withColumn("columned", F.col("n_cols").between(2, 4))
    place = W.partitionBy(*row, F.when(F.col("columned"), F.col("col_no"))).orderBy("y", "x", "doc_ord")
    return out.withColumn("grid", F.when(F.col("columned"), F.expr("12 div n_cols"))).withColumn("place", F.row_number().over(place))


def islands(df: DataFrame, page, order, same: Column, name: str = "island") -> DataFrame:
    """Number runs of consecutive rows with one value of ``same``."""
    w = W.partitionBy(*page).orderBy(*order)
    starts = F.when(~same.eqNullSafe(F.lag(same).over(w)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_starts")


def image_runs(rows_: DataFrame, page=PAGE, name: str = "item_no") -> DataFrame:
    """Items of a page from its rows (row_no, all_images, is_caption, n): a caption row and an equal
    image row below pair up; other neighbouring image rows merge; any other row stands alone.
    """
    w = W.partitionBy(*page).orderBy("row_no")
    out = rows_.withColumn("heads", F.col("is_caption") & F.coalesce(F.lead("all_images").over(w) & (F.lead("n").over(w) == F.col("n")), F.lit(False)))
    out = out.withColumn("paired", F.coalesce(F.lag("heads").over(w), F.lit(False)))
    joins = F.col("paired") | (F.col("all_images") & F.coalesce(F.lag("all_images").over(w) & ~F.lag("paired").over(w), F.lit(False)))
    return out.withColumn("_starts", F.when(joins, 0).otherwise(1)).withColumn(name, F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_starts")


def list_depths(levels) -> Column:
    """Depths of list entries: the first is 0, each next at most one deeper than the one before."""
    c = F.col(levels) if isinstance(levels, str) else levels
    start = F.array().cast("array<int>")

    def add(acc, level):
        deepest = F.when(F.size(acc) == 0, 0).otherwise(F.try_element_at(acc, F.lit(-1)) + 1)
        return F.concat(acc, F.array(F.least(F.greatest(level.cast("int"), F.lit(0)), deepest)))

    return F.aggregate(c, start, add)


def without_repeats(df: DataFrame, key, order, value: str) -> DataFrame:
    """Drop rows whose value equals that of the row before."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def visible_ordinal(df: DataFrame, page, order, hidden: Column, name: str = "visible_no") -> DataFrame:
    """Running count of visible rows; null on hidden ones."""
    w = W.partitionBy(*page).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.when(~hidden, F.sum(F.when(hidden, 0).otherwise(1)).over(w)))


def page_chain(df: DataFrame, key, order, id_col: str) -> DataFrame:
    """Doubly linked pages: ids of the neighbours, 0 at the ends."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumns({"prev_id": F.coalesce(F.lag(id_col).over(w), F.lit(0)), "next_id": F.coalesce(F.lead(id_col).over(w), F.lit(0))})


def promoted_title(lines: DataFrame, page, order, plain: str) -> DataFrame:
    """(page, title): the first line of each page if it is short enough, else null."""
    from ..functions.text import promotable

    w = W.partitionBy(*page).orderBy(*order)
    first = lines.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select(*page, F.when(promotable(plain), F.col(plain)).alias("title"))


def newest(df: DataFrame, key, order_col: str) -> DataFrame:
    """The newest row of each key."""
    packed = df.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in key]), F.col(order_col)).alias("_r"))
    return packed.select(*key, "_r.*")
