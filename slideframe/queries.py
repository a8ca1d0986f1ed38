"""The deck operators on the standard tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from .adapters import BLOCKS_SQL, LINES_SQL, blocks, lines, table
from .functions import geometry as G
from .functions import text as X
from .operators import layout as L
from .operators import relate as R
from .streaming import imports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"
#: Rows and columns of blocks as recursive queries.
ROWS_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY y, x, doc_ord) AS i FROM g),
r AS (SELECT slide_id, doc_ord, i, y AS top, y + cy AS bot, 1 AS row_no FROM o WHERE i = 1
  UNION ALL SELECT o.slide_id, o.doc_ord, o.i,
    CASE WHEN j THEN least(top, o.y) ELSE o.y END, CASE WHEN j THEN greatest(bot, o.y + o.cy) ELSE o.y + o.cy END, CASE WHEN j THEN row_no ELSE row_no + 1 END
  FROM r JOIN o ON o.slide_id = r.slide_id AND o.i = r.i + 1, LATERAL (SELECT 2 * (least(bot, o.y + o.cy) - greatest(top, o.y)) >= greatest(1, least(o.cy, bot - top)) AS j))"""


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


@query("reading_order", f"WITH {BLOCKS_SQL} SELECT slide_id, doc_ord, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY y // 457200, x, doc_ord) AS INTEGER) AS reading_no FROM g")
def reading_order(spark, sf):
    return L.reading_order(blocks(spark, sf)).select("slide_id", "doc_ord", "reading_no")


@query("fixed_bands", f"WITH {BLOCKS_SQL} SELECT slide_id, doc_ord, CAST(dense_rank() OVER (PARTITION BY slide_id ORDER BY y // 457200) AS INTEGER) AS row_no FROM g")
def fixed_bands(spark, sf):
    return L.fixed_bands(blocks(spark, sf)).select("slide_id", "doc_ord", "row_no")


@query("overlap_rows", f"WITH RECURSIVE {BLOCKS_SQL}, {ROWS_SQL} SELECT slide_id, doc_ord, row_no FROM r")
def overlap_rows(spark, sf):
    return L.overlap_rows(blocks(spark, sf)).select("slide_id", "doc_ord", "row_no")


CLUSTERS_SQL = f"""WITH RECURSIVE {BLOCKS_SQL}, {ROWS_SQL},
p AS (SELECT g.*, r.row_no, row_number() OVER (PARTITION BY g.slide_id, r.row_no ORDER BY g.x, g.y, g.doc_ord) AS k, g.x + CASE WHEN cx > 0 THEN cx ELSE 914400 END AS rt FROM g JOIN r USING (slide_id, doc_ord)),
c AS (SELECT slide_id, row_no, doc_ord, k, x AS lo, rt AS hi, cx > 0 AS known, 1 AS col_no FROM p WHERE k = 1
  UNION ALL SELECT p.slide_id, p.row_no, p.doc_ord, p.k, CASE WHEN s THEN p.x ELSE least(lo, p.x) END, CASE WHEN s THEN p.rt ELSE greatest(hi, p.rt) END,
    CASE WHEN s THEN p.cx > 0 ELSE known AND p.cx > 0 END, CASE WHEN s THEN col_no + 1 ELSE col_no END
  FROM c JOIN p ON p.slide_id = c.slide_id AND p.row_no = c.row_no AND p.k = c.k + 1,
  LATERAL (SELECT CASE WHEN known AND p.cx > 0 THEN 2 * (least(hi, p.rt) - greatest(lo, p.x)) < greatest(1, least(p.rt - p.x, hi - lo)) ELSE p.x >= hi END AS s))"""


@query("x_clusters", f"{CLUSTERS_SQL} SELECT slide_id, row_no, doc_ord, col_no FROM c")
def x_clusters(spark, sf):
    return L.x_clusters(L.overlap_rows(blocks(spark, sf))).select("slide_id", "row_no", "doc_ord", "col_no")


@query(
    "column_layout",
    f"""{CLUSTERS_SQL}, n AS (SELECT p.*, col_no, max(col_no) OVER (PARTITION BY slide_id, row_no) AS n_cols FROM c JOIN p USING (slide_id, row_no, doc_ord))
SELECT slide_id, row_no, doc_ord, col_no, n_cols, n_cols BETWEEN 2 AND 4 AS columned, CASE WHEN n_cols BETWEEN 2 AND 4 THEN CAST(12 // n_cols AS BIGINT) END AS grid,
  CAST(row_number() OVER (PARTITION BY slide_id, row_no, CASE WHEN n_cols BETWEEN 2 AND 4 THEN col_no END ORDER BY y, x, doc_ord) AS INTEGER) AS place FROM n""",
)
def column_layout(spark, sf):
    return L.column_layout(L.x_clusters(L.overlap_rows(blocks(spark, sf)))).select("slide_id", "row_no", "doc_ord", "col_no", "n_cols", "columned", F.col("grid").cast("long").alias("grid"), "place")


@query("bounds", f"WITH {BLOCKS_SQL} SELECT slide_id, min(x) AS min_x, min(y) AS min_y, max(x + cx) AS max_x, max(y + cy) AS max_y FROM g GROUP BY slide_id")
def bounds(spark, sf):
    return R.bounds(blocks(spark, sf), ("slide_id",))


@query("largest_picture", f"WITH {BLOCKS_SQL} SELECT slide_id, doc_ord, cx * cy AS area FROM g WHERE type = 'image' QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY cx * cy DESC, doc_ord) = 1")
def largest_picture(spark, sf):
    out = R.largest(blocks(spark, sf).where("type = 'image'"), ("slide_id",), F.col("cx") * F.col("cy"))
    return out.select("slide_id", "doc_ord", (F.col("cx") * F.col("cy")).alias("area"))


@query("top_left", f"WITH {BLOCKS_SQL} SELECT slide_id, doc_ord, y, x FROM g QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY y, x, doc_ord) = 1")
def top_left(spark, sf):
    return R.top_left(blocks(spark, sf), ("slide_id",)).select("slide_id", "doc_ord", "y", "x")


@query(
    "image_dominant",
    f"""WITH {BLOCKS_SQL}, big AS (SELECT * FROM g WHERE type = 'image' QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY cx * cy DESC, doc_ord) = 1)
SELECT b.slide_id, count(*) AS n_labels FROM (SELECT * FROM big WHERE cx * cy >= 6000000000000 * 0.4) b JOIN g ON g.slide_id = b.slide_id AND g.type = 'text'
WHERE least(b.x + b.cx, g.x + g.cx) > greatest(b.x, g.x) AND least(b.y + b.cy, g.y + g.cy) > greatest(b.y, g.y) GROUP BY b.slide_id HAVING count(*) >= 2""",
)
def image_dominant(spark, sf):
    g = blocks(spark, sf)
    labels = g.where("type = 'text'").withColumn("text", F.lit("label"))
    return R.image_dominant(g.where("type = 'image'"), labels, "slide_id", F.lit(6000000000000))


@query(
    "group_transform",
    f"""WITH {BLOCKS_SQL}, t AS (SELECT slide_id, doc_ord, x, y, cx, cy, 1000.0::DOUBLE - 500 * (3.0::DOUBLE / 2) AS ox1, 2000.0::DOUBLE - 250 * (1.0::DOUBLE / 4) AS oy1, 3.0::DOUBLE / 2 AS sx1, 1.0::DOUBLE / 4 AS sy1 FROM g)
SELECT slide_id, doc_ord, CAST(round(ox1 + x * 1.0 * sx1) AS BIGINT) AS gx, CAST(round(oy1 + 7 * sy1 + y * (2.0::DOUBLE * sy1)) AS BIGINT) AS gy, CAST(round(cx * sx1) AS BIGINT) AS gcx, CAST(round(cy * (2.0::DOUBLE * sy1)) AS BIGINT) AS gcy FROM t""",
)
def group_transform(spark, sf):
    link = lambda *v: F.struct(*[F.lit(a).cast("long").alias(n) for a, n in zip(v, ("x", "y", "cx", "cy", "chx", "chy", "chcx", "chcy"), strict=True)])
    tf = G.group_transform(F.array(link(1000, 2000, 300, 100, 500, 250, 200, 400), link(0, 7, 0, 800, 0, 0, 0, 400), link(None, None, 1, 1, 1, 1, 1, 1)))
    x, y, cx, cy = G.apply_transform("tf", "x", "y", "cx", "cy")
    return blocks(spark, sf).withColumn("tf", tf).select("slide_id", "doc_ord", x.alias("gx"), y.alias("gy"), cx.alias("gcx"), cy.alias("gcy"))


@query(
    "rotated_bounds",
    f"""WITH {BLOCKS_SQL}, a AS (SELECT *, doc_ord * 45 * 60000 AS rot FROM g), w AS (SELECT *, abs(cos(radians(rot / 60000.0))) AS c, abs(sin(radians(rot / 60000.0))) AS s FROM a),
b AS (SELECT *, cx > 0 AND cy > 0 AND rot <> 0 AS t, CAST(round(cx * c + cy * s) AS BIGINT) AS w, CAST(round(cx * s + cy * c) AS BIGINT) AS h FROM w)
SELECT slide_id, doc_ord, CASE WHEN t THEN CAST(round(x + cx / 2 - w / 2) AS BIGINT) ELSE x END AS bx, CASE WHEN t THEN CAST(round(y + cy / 2 - h / 2) AS BIGINT) ELSE y END AS by_,
  CASE WHEN t THEN w ELSE cx END AS bcx, CASE WHEN t THEN h ELSE cy END AS bcy FROM b""",
)
def rotated_bounds(spark, sf):
    x, y, cx, cy = G.rotated("x", "y", "cx", "cy", F.col("doc_ord") * 45 * 60000)
    return blocks(spark, sf).select("slide_id", "doc_ord", x.alias("bx"), y.alias("by_"), cx.alias("bcx"), cy.alias("bcy"))


@query("width_percent", f"WITH {BLOCKS_SQL} SELECT slide_id, doc_ord, CASE WHEN cx <= 0 THEN 0 ELSE least(100, greatest(1, CAST(round(cx / 12192000 * 100) AS INTEGER))) END AS widthpct FROM g")
def width_percent(spark, sf):
    return blocks(spark, sf).select("slide_id", "doc_ord", G.width_percent("cx", F.lit(M.SLIDE_W)).alias("widthpct"))


PRESETS = ("rightArrow", "ellipse", "roundRect", "snip1Rect", "plaque", "rect", "bentArrow")


@query(
    "geometry_kinds",
    f"""WITH p AS (SELECT p_partkey, (['{"','".join(PRESETS)}'])[p_size % 7 + 1] AS preset FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(preset, '^(right|left|up|down)Arrow$') THEN 'arrow' WHEN preset IN ('ellipse', 'oval') THEN 'ellipse'
  WHEN regexp_matches(preset, '(?i)round|snip') OR preset = 'plaque' THEN 'roundrect' ELSE 'rect' END AS kind FROM p""",
)
def geometry_kinds(spark, sf):
    preset = F.element_at(F.array(*map(F.lit, PRESETS)), (F.col("p_size") % 7 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", G.preset_kind(preset)["kind"].alias("kind"))


@query("contrast", "WITH p AS (SELECT p_partkey, substr(md5(p_name), 1, 6) AS h FROM part) SELECT p_partkey, '#' || h AS fill, CASE WHEN 0.299 * ('0x' || substr(h, 1, 2))::INT + 0.587 * ('0x' || substr(h, 3, 2))::INT + 0.114 * ('0x' || substr(h, 5, 2))::INT > 150 THEN '#000000' ELSE '#ffffff' END AS ink FROM p")
def contrast(spark, sf):
    out = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)).alias("fill"))
    return out.withColumn("ink", X.contrast("fill"))


@query("compact_numbers", "SELECT p_partkey, regexp_replace(printf('%.2f', p_retailprice), '\\.?0+$', '') AS num, regexp_replace(printf('%.2f', p_size * 25 / 100), '\\.?0+$', '') AS points FROM part")
def compact_numbers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.number("p_retailprice").alias("num"), X.points(F.col("p_size") * 25).alias("points"))


@query("strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS bare FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.strip_tags("html")).alias("bare"))


ESCAPE_SQL = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


@query("escape", f"SELECT page_id, md5({ESCAPE_SQL.format('html')}) AS safe FROM pages")
def escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.escape("html")).alias("safe"))


PLAIN_SQL = f"trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({{}}, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', ''''), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), {WS})"


@query("plain_text", f"SELECT page_id, md5({PLAIN_SQL.format('html')}) AS plain FROM pages")
def plain_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.plain_text("html")).alias("plain"))


@query("badges", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM d WHERE length(trim({ESCAPE_SQL.format('line')}, {WS})) <= 4")
def badges(spark, sf):
    return lines(spark, sf).where(X.is_badge(F.array(X.escape("line")), F.lit(False)))


@query("captions", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM d WHERE length(trim({ESCAPE_SQL.format('line')}, {WS})) <= 12")
def captions(spark, sf):
    return lines(spark, sf).where(X.is_caption(F.array(X.escape("line"))))


PROMOTE_SQL = f"""WITH {LINES_SQL}, n AS (SELECT doc_id, line_no, trim(line, {WS}) AS plain FROM d), f AS (SELECT * FROM n WHERE plain <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1)
SELECT d.doc_id, CASE WHEN length(plain) <= 60 THEN plain END AS title, count(*) AS n_blocks FROM d LEFT JOIN f USING (doc_id) GROUP BY ALL"""


@query("promote_title", PROMOTE_SQL)
def promote_title(spark, sf):
    all_lines = lines(spark, sf).withColumn("plain", X.trim("line"))
    titles = L.promoted_title(all_lines.where("plain <> ''"), ("doc_id",), ("line_no",), "plain")
    return all_lines.groupBy("doc_id").agg(F.count("*").alias("n_blocks")).join(titles, "doc_id", "left").select("doc_id", "title", "n_blocks")


@query("bullet_runs", f"WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, starts_with(line, '-') OR length(line) < 80 AS bullet FROM d), s AS (SELECT *, CASE WHEN lag(bullet) OVER w IS DISTINCT FROM bullet THEN 1 ELSE 0 END AS st FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no, bullet, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS run FROM s")
def bullet_runs(spark, sf):
    marked = lines(spark, sf).select("doc_id", "line_no", (F.col("line").startswith("-") | (F.char_length("line") < 80)).alias("bullet"))
    return L.islands(marked, ("doc_id",), ("line_no",), F.col("bullet"), "run")


@query(
    "list_depths",
    f"""WITH {LINES_SQL}, l AS (SELECT doc_id, line_no, CASE WHEN line_no = 0 THEN 0 ELSE length(line) % 9 END AS level FROM d)
SELECT doc_id, line_no, CAST(line_no + min(level - line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS depth FROM l""",
)
def list_depths(spark, sf):
    levels = lines(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", (F.char_length("line") % 9).alias("level")))).alias("l"))
    return levels.select("doc_id", F.posexplode(L.list_depths(F.col("l.level"))).alias("line_no", "depth"))


@query("adjacent_dedup", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS DISTINCT FROM event_type OR n = 1")
def adjacent_dedup(spark, sf):
    return L.without_repeats(table(spark, sf, "events"), ("user_id",), ("ts", "event_id"), "event_type").select("user_id", "event_id", "event_type")


@query("rel_chain", "SELECT o_orderkey, coalesce(r_name, 'none') AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def rel_chain(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region").where("r_name <> 'ASIA'").withColumnRenamed("r_name", "region")
    hops = [(table(spark, sf, "customer"), "o_custkey", "c_custkey"), (R.small(nation), "c_nationkey", "n_nationkey"), (R.small(region), "n_regionkey", "r_regionkey")]
    return R.chain(table(spark, sf, "orders"), hops, F.lit("none"), "region").select("o_orderkey", "region")


@query("rel_last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max((o_orderdate, o_orderkey)).o_orderdate AS o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) GROUP BY o_custkey")
def rel_last_wins(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("ord"))
    return R.last_wins(o, ("o_custkey",), "ord").select("o_custkey", "o_orderkey", "o_orderdate")


SQL["rel_last_wins"] = "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query("first_match", "SELECT p_brand, arg_min(p_type, p_partkey) AS target FROM part WHERE regexp_matches(p_type, '^S') GROUP BY p_brand")
def first_match(spark, sf):
    return R.first_match(table(spark, sf, "part").select("p_brand", "p_type", "p_partkey"), ("p_brand",), "^S", "target", "p_partkey", "p_type")


@query(
    "font_cascade",
    "SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN 1800 END, CASE WHEN c_custkey % 3 = 0 THEN 1400 END, CASE WHEN n_nationkey % 2 = 0 THEN 2000 END, 0) AS INTEGER) AS sz FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def font_cascade(spark, sf):
    hops = [(table(spark, sf, "customer"), "o_custkey", "c_custkey"), (R.small(table(spark, sf, "nation")), "c_nationkey", "n_nationkey")]
    joined = R.chain(table(spark, sf, "orders"), hops, F.lit(None), "sz")
    run = F.when(F.col("o_orderkey") % 5 == 0, 0).when(F.col("o_orderkey") % 5 == 1, 1800)
    paragraph = F.when(F.col("c_custkey") % 3 == 0, 1400).otherwise(0)
    return joined.select("o_orderkey", R.font_size(run, paragraph, F.when(F.col("n_nationkey") % 2 == 0, 2000), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("sz"))


@query(
    "scheme_colours",
    "SELECT p_partkey, CASE (['bg1', 'tx2', 'accent1', 'phClr', 'nope'])[p_size % 5 + 1] WHEN 'bg1' THEN '#FFFFFF' WHEN 'tx2' THEN '#112233' WHEN 'accent1' THEN '#4472C4' END AS colour FROM part",
)
def scheme_colours(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("bg1", "tx2", "accent1", "phClr", "nope"))), (F.col("p_size") % 5 + 1).cast("int"))
    own_map = F.create_map(*[F.lit(x) for kv in M.DEFAULT_MAP.items() for x in kv])
    return table(spark, sf, "part").select("p_partkey", R.colour(names, own_map, F.create_map(F.lit("dk2"), F.lit("112233"))).alias("colour"))


@query("map_union", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey >= 3)")
def map_union(spark, sf):
    own = table(spark, sf, "nation").where("n_nationkey >= 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return R.left_biased(own, table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), ("k",), "v")


@query("anti_labels", "SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_labels(spark, sf):
    return R.strangers(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "n_chars")


@query("semi_labels", "SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def semi_labels(spark, sf):
    return R.members(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id", "n_chars")


@query("caption_pairs", "SELECT conv_id, turn, text AS caption, nxt AS image FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'")
def caption_pairs(spark, sf):
    return R.caption_pairs(table(spark, sf, "conversations"), ("conv_id",), ("turn",), F.col("role") == "user", F.col("role") == "assistant", "text", "text")


@query("visible_ordinal", "SELECT conv_id, turn, CASE WHEN role <> 'system' THEN count(*) FILTER (role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS visible_no FROM conversations")
def visible_ordinal(spark, sf):
    return L.visible_ordinal(table(spark, sf, "conversations"), ("conv_id",), ("turn",), F.col("role") == "system").select("conv_id", "turn", "visible_no")


@query("page_chain", "SELECT conv_id, turn, coalesce(lag(turn + 1) OVER w, 0) AS prev_id, coalesce(lead(turn + 1) OVER w, 0) AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def page_chain(spark, sf):
    pages = table(spark, sf, "conversations").withColumn("page_id", F.col("turn") + 1)
    return L.page_chain(pages, ("conv_id",), ("turn",), "page_id").select("conv_id", "turn", "prev_id", "next_id")


@query(
    "media_names",
    """WITH m AS (SELECT p_brand, p_partkey, 'pic' || (p_size % 4) AS stem FROM part)
SELECT p_brand, 'a/' || p_partkey || '/' || stem || '.png' AS path, stem || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END || '.png' AS filename
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, stem ORDER BY p_partkey) AS k FROM m)""",
)
def media_names(spark, sf):
    media = table(spark, sf, "part").select("p_brand", "p_partkey", F.concat(F.lit("a/"), "p_partkey", F.lit("/pic"), F.col("p_size") % 4, F.lit(".png")).alias("path"))
    return R.media_names(media, ("p_brand",), "path", "p_partkey", X.image_name("path"))


@query("size_limits", "SELECT source, doc_id, CAST(running AS BIGINT) AS running, n_chars > 20000 OR running > 100000 AS over FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents)")
def size_limits(spark, sf):
    return R.over_limits(table(spark, sf, "documents"), ("source",), ("doc_id",), "n_chars", 20000, 100000).select("source", "doc_id", "running", "over")


@query("newest_upload", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def newest_upload(spark, sf):
    return L.newest(table(spark, sf, "events").select("user_id", "event_id", "ts"), ("user_id",), "event_id")


@query("blank_vectors", "SELECT vec_id, len(list_filter(embedding, lambda v: NOT abs(v) < 0.35)) = 0 AS is_blank FROM embeddings")
def blank_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    # As in SQL, 0.35 is compared in the components' own type, and null components don't count against a vector.
    limit = F.lit(0.35).cast(vectors.schema["embedding"].dataType.elementType)
    clear = F.transform("embedding", lambda v: F.struct(F.when(~(F.abs(v) < limit), 0).otherwise(127).alias("alpha"), F.lit(0).alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue")))
    return vectors.select("vec_id", G.all_blank(clear).alias("is_blank"))


@query("table_html", "SELECT n_regionkey, '<table class=\"table\"><thead><tr><th>key</th><th>name</th></tr></thead><tbody>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</tbody></table>' AS html FROM nation GROUP BY n_regionkey")
def table_html(spark, sf):
    from .plans.render import table_html as render_table

    cells = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("t"))
    body = F.transform("t", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"]))
    return cells.select("n_regionkey", render_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), body)).alias("html"))


@query("signed_32", "SELECT o_orderkey, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS signed FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS v FROM orders)")
def signed_32(spark, sf):
    v = F.col("o_orderkey") * F.lit(2654435761) % F.lit(4294967296)
    return table(spark, sf, "orders").select("o_orderkey", G.signed32(v).alias("signed"))


@query("fitted_size", "SELECT p_partkey, greatest(1, CAST(round(w * s) AS INTEGER)) AS width, greatest(1, CAST(round(h * s) AS INTEGER)) AS height FROM (SELECT p_partkey, w, h, least(1.0::DOUBLE, 1600 / greatest(w, h)) AS s FROM (SELECT p_partkey, p_size * 97 AS w, CAST(p_partkey % 2500 + 1 AS BIGINT) AS h FROM part))")
def fitted_size(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.fitted(F.col("p_size") * 97, F.col("p_partkey") % 2500 + 1, 1600).alias("s")).select("p_partkey", "s.width", "s.height")


@query("cache_keys", "SELECT c_custkey, substr(md5(c_name || '|' || c_mktsegment), 1, 12) AS k FROM customer")
def cache_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.cache_key("c_name", "c_mktsegment").alias("k"))


@query("file_types", "SELECT page_id, lower(regexp_extract(url, '\\.([^.]+)$', 1)) AS ext, CASE WHEN lower(regexp_extract(url, '\\.([^.]+)$', 1)) = 'pdf' THEN 'pdf' ELSE 'deck' END AS backend, regexp_replace(list_extract(string_split(url, '/'), -1), '[^a-zA-Z0-9._-]+', '_', 'g') AS base FROM pages")
def file_types(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.extension("url").alias("ext"), imports.backend(F.col("url")).alias("backend"), X.base_name("url", "").alias("base"))


@query("image_runs", f"""WITH RECURSIVE {BLOCKS_SQL}, {ROWS_SQL},
w AS (SELECT slide_id, row_no, bool_and(type = 'image') AS im, count(*) >= 2 AND bool_and(type = 'text') AS cap, count(*) AS n FROM g JOIN r USING (slide_id, doc_ord) GROUP BY ALL),
h AS (SELECT *, cap AND coalesce(lead(im) OVER v AND lead(n) OVER v = n, false) AS heads FROM w WINDOW v AS (PARTITION BY slide_id ORDER BY row_no)),
q AS (SELECT *, coalesce(lag(heads) OVER (PARTITION BY slide_id ORDER BY row_no), false) AS paired FROM h),
z AS (SELECT *, CASE WHEN paired OR (im AND coalesce(lag(im) OVER v AND NOT lag(paired) OVER v, false)) THEN 0 ELSE 1 END AS st FROM q WINDOW v AS (PARTITION BY slide_id ORDER BY row_no))
SELECT slide_id, row_no, paired, CAST(sum(st) OVER (PARTITION BY slide_id ORDER BY row_no) AS INTEGER) AS item_no FROM z""")
def image_runs(spark, sf):
    rows = L.overlap_rows(blocks(spark, sf)).groupBy("slide_id", "row_no").agg(F.bool_and(F.col("type") == "image").alias("all_images"), ((F.count("*") >= 2) & F.bool_and(F.col("type") == "text")).alias("is_caption"), F.count("*").alias("n"))
    return L.image_runs(rows).select("slide_id", "row_no", "paired", "item_no")
