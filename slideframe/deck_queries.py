"""Whole imports on the standard tables: parts become decks of slides, which are read, laid out, rendered and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import model as M
from .adapters import LINES_SQL, lines, table
from .functions import geometry as G
from .functions import text as X
from .operators import relate as R
from .plans import deck, render, sink, svg
from .queries import query
from .sources import package, writer
from .streaming import imports

BODY, PICTURE, TABLE, PANEL = (500000, 2000000, 4000000, 1500000), (500000, 4500000, 3000000, 800000), (500000, 5600000, 4000000, 400000), (0, 0, 3000000, 6858000)
LEFT, RIGHT, LINE = (6000000, 3600000, 2000000, 600000), (9000000, 3600000, 2000000, 600000), (8000000, 3900000, 1000000, 0)
PER_DECK = 20


def _slide(s: dict) -> tuple[str, dict[str, str]]:
    k, w = s["k"], writer
    brand = w.paragraph(s["p_brand"], 0, k % 4 != 0)
    kind = w.paragraph(s["p_type"], s["p_size"] % 3, k % 4 != 0)
    heading = [w.paragraph(s["p_name"])]
    shapes = [
        w.text_shape(heading, placeholder="title") if k % 5 else w.text_shape(heading, (500000, 300000, 5000000, 500000)),
        w.text_shape([w.paragraph("Footer text")], placeholder="ftr"),
        w.text_shape([w.paragraph("AB")], (500000, 1000000, 100000, 100000)),
        w.text_shape([brand, kind], BODY),
    ]
    if k % 3 == 0:
        shapes.append(w.picture("rId1", PICTURE))
    if k % 11 == 0:
        shapes.append(w.table([["Key", "Size"], [str(k), str(s["p_size"])]], TABLE))
    if k % 13 == 0:
        shapes.append(w.text_shape([], PANEL, preset="rect", fill="1F4E79"))
    if k % 4 == 1:
        shapes += [w.text_shape([w.paragraph(s["p_brand"])], LEFT, preset="rect", fill="AABBCC"), w.text_shape([w.paragraph(s["p_type"])], RIGHT, preset="ellipse", fill="112233"), w.connector(LINE)]
    return w.slide(shapes, k % 7 == 0), {"rId1": f"../media/image{s['p_size']}.png", "rId2": "../slideLayouts/slideLayout1.xml"}


def _deck(row: dict) -> bytes:
    """Slides are numbered by key and shown in the opposite order."""
    made = [_slide(s) for s in sorted(row["slides"], key=lambda s: s["k"])]
    pictures = {f"ppt/media/image{s['p_size']}.png": b"\x89PNG" + bytes(s["p_size"]) for s in row["slides"]}
    return writer.package(made, list(range(len(made), 0, -1)), pictures)


def decks(spark: SparkSession, sf: str) -> DataFrame:
    """(deck_id, content): twenty parts a deck."""
    own = F.struct(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size")
    rows = table(spark, sf, "part").select(F.concat(F.lit("deck"), ((F.col("p_partkey") - 1) / PER_DECK).cast("long")).alias("deck_id"), own.alias("s"))
    return writer.write(rows.groupBy("deck_id").agg(F.collect_list("s").alias("slides")), _deck)


#: The same slides as rows: the number shown, the number of the part, and what is on it.
SLIDES_SQL = f"""s AS (SELECT p_partkey AS k, 'deck' || ((p_partkey - 1) // {PER_DECK}) AS deck_id, p_name, p_brand, p_type, p_size,
  CAST(row_number() OVER (PARTITION BY (p_partkey - 1) // {PER_DECK} ORDER BY p_partkey DESC) AS INTEGER) AS slide_no,
  row_number() OVER (PARTITION BY (p_partkey - 1) // {PER_DECK} ORDER BY p_partkey) AS part_no FROM part)"""


def slides(spark: SparkSession, sf: str) -> DataFrame:
    return package.slides(decks(spark, sf))


@query("deck_slides", f"WITH {SLIDES_SQL} SELECT deck_id, slide_no, 'ppt/slides/slide' || part_no || '.xml' AS part_path, k % 7 = 0 AS hidden, 12192000 AS slide_w, 6858000 AS slide_h, CAST(count(*) OVER (PARTITION BY deck_id) AS INTEGER) AS n_parts, 'ppt/media/image' || p_size || '.png' AS image, CAST(4 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 1 THEN 3 ELSE 0 END AS INTEGER) AS n_shapes FROM s")
def deck_slides(spark, sf):
    return slides(spark, sf).select("deck_id", "slide_no", "part_path", "hidden", "slide_w", "slide_h", "n_parts", F.col("rels")["rId1"].alias("image"), F.size("shapes").alias("n_shapes"))


@query("deck_counts", f"WITH {SLIDES_SQL} SELECT deck_id, count(*) AS n_listed, count(*) FILTER (k % 7 <> 0) AS n_visible, CAST(count(*) AS INTEGER) AS n_parts FROM s GROUP BY deck_id")
def deck_counts(spark, sf):
    return deck.slide_counts(slides(spark, sf))


@query("deck_parts", f"WITH {SLIDES_SQL} SELECT DISTINCT deck_id, 'ppt/media/image' || p_size || '.png' AS path, p_size + 4 AS n_bytes FROM s")
def deck_parts(spark, sf):
    return package.parts(decks(spark, sf), "^ppt/media/").select("deck_id", "path", F.length("bytes").alias("n_bytes"))


@query("deck_headings", f"WITH {SLIDES_SQL} SELECT deck_id, slide_no, CASE WHEN k % 13 = 0 THEN '#1f4e79' END AS colour, CASE WHEN k % 13 = 0 THEN 3000000 END AS panelright FROM s")
def deck_headings(spark, sf):
    return deck.headings(slides(spark, sf)).select("deck_id", "slide_no", "section.colour", "section.panelright")


BLOCK_SQL = f"""WITH {SLIDES_SQL}
SELECT deck_id, slide_no, 'title' AS type, 1000000000000 AS y, 1000000000000 AS x, 0 AS cx, 0 AS cy, 1 AS doc_ord, 0 AS widthpct, p_name AS text FROM s WHERE k % 5 <> 0
UNION ALL SELECT deck_id, slide_no, 'text', 300000, 500000, 5000000, 500000, 1, 0, '0:' || p_name FROM s WHERE k % 5 = 0
UNION ALL SELECT deck_id, slide_no, 'text', 2000000, 500000, 4000000, 1500000, 7, 0, '0:' || p_brand || '|' || (p_size % 3) || ':' || p_type FROM s
UNION ALL SELECT deck_id, slide_no, 'image', 4500000, 500000, 3000000, 800000, 8, 25, 'ppt/media/image' || p_size || '.png' FROM s WHERE k % 3 = 0
UNION ALL SELECT deck_id, slide_no, 'html', 5600000, 500000, 4000000, 400000, CASE WHEN k % 3 = 0 THEN 10 ELSE 8 END, 0, '<table class="table"><thead><tr><th>Key</th><th>Size</th></tr></thead><tbody><tr><td>' || k || '</td><td>' || p_size || '</td></tr></tbody></table>' FROM s WHERE k % 11 = 0
UNION ALL SELECT deck_id, slide_no, 'html', 3600000, 6000000, 0, 0, 1073741824, 0, 'svg' FROM s WHERE k % 4 = 1"""


@query("deck_blocks", BLOCK_SQL)
def deck_blocks(spark, sf):
    paras = F.array_join(F.transform("paras", lambda p: F.concat(p["level"].cast("string"), F.lit(":"), p["text"])), "|")
    content = F.when(F.col("content").contains("<svg"), "svg").otherwise(F.col("content"))
    b = deck.blocks(slides(spark, sf))
    return b.select("deck_id", "slide_no", "type", "y", "x", "cx", "cy", "doc_ord", "widthpct", F.coalesce(content, paras).alias("text"))


LIST_SQL = "CASE WHEN k % 4 = 0 THEN '<p>' || p_brand || '</p><p>' || p_type || '</p>' WHEN p_size % 3 = 0 THEN '<ul><li>' || p_brand || '</li><li>' || p_type || '</li></ul>' ELSE '<ul><li>' || p_brand || '<ul><li>' || p_type || '</li></ul></li></ul>' END"
FIGURE_SQL = """CASE WHEN k % 3 = 0 THEN '<div class="sf-figure"><img src="@@MEDIA@@/image' || p_size || '.png" alt="" class="img-fluid"></div>' END"""
CELLS_SQL = """CASE WHEN k % 11 = 0 THEN '<table class="table"><thead><tr><th>Key</th><th>Size</th></tr></thead><tbody><tr><td>' || k || '</td><td>' || p_size || '</td></tr></tbody></table>' END"""
SVG_SQL = "CASE WHEN k % 4 = 1 THEN '[svg]' END"
PAGES_SQL = f"""{SLIDES_SQL}, pg AS (SELECT deck_id, slide_no, k, p_size,
  CASE WHEN k % 5 <> 0 OR k % 13 <> 0 THEN p_name ELSE 'Slide ' || slide_no END AS title,
  CASE WHEN k % 13 <> 0 THEN concat_ws(chr(10), {LIST_SQL}, {SVG_SQL}, {FIGURE_SQL}, {CELLS_SQL})
  ELSE '<div class="container-fluid sf-section"><div class="row"><div class="col-12 col-md-3"><div class="sf-plate" style="background-color:#1f4e79;">' || concat_ws('<br>', CASE WHEN k % 5 = 0 THEN p_name END, p_brand, p_type)
    || '</div></div><div class="col-12 col-md-9 sf-lede">' || concat_ws(chr(10), {SVG_SQL}, {CELLS_SQL}) || coalesce({FIGURE_SQL}, '') || '</div></div></div>' END AS html,
  k % 13 = 0 AS issection FROM s)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return deck.pages(slides(spark, sf))


@query("deck_pages", f"WITH {PAGES_SQL} SELECT deck_id, slide_no, title, html, issection, CASE WHEN k % 3 = 0 THEN 'ppt/media/image' || p_size || '.png' END AS image FROM pg")
def deck_pages(spark, sf):
    bare = F.regexp_replace("html", r'(?s)<div class="sf-figure sf-diagram">.*?</svg></div>', "[svg]")
    return pages(spark, sf).select("deck_id", "slide_no", "title", bare.alias("html"), "issection", F.try_element_at(F.map_values("images"), F.lit(1)).alias("image"))


#: Lessons of two decks each; the first half of a lesson's decks is stored already.
CHAIN_SQL = f"""{PAGES_SQL}, o AS (SELECT *, CAST(substr(deck_id, 5) AS BIGINT) AS d FROM pg),
c AS (SELECT d // 2 AS lesson_id, d, deck_id, slide_no, title, k, p_size, row_number() OVER (PARTITION BY d // 2 ORDER BY d % 2, slide_no) AS page_id, count(*) OVER (PARTITION BY d // 2) AS n FROM o)"""


def _lessons(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored pages of the even decks, and new pages of the odd ones."""
    d = F.substring("deck_id", 5, 18).cast("long")
    every = pages(spark, sf).withColumns({"_d": d, "lesson_id": F.floor(d / 2)})
    none = spark.createDataFrame([], "lesson_id long, page_id long")
    stored = sink.chained(every.where("_d % 2 = 0").drop("_d"), none)
    return stored, sink.chained(every.where("_d % 2 = 1").drop("_d"), stored)


@query("appended_pages", f"WITH {CHAIN_SQL} SELECT lesson_id, page_id, CASE WHEN page_id > 1 THEN page_id - 1 ELSE 0 END AS prev_id, CASE WHEN page_id < n THEN page_id + 1 ELSE 0 END AS next_id, substr(title, 1, 255) AS title, 20 AS qtype FROM c")
def appended_pages(spark, sf):
    stored, new = _lessons(spark, sf)
    both = sink.relinked(stored, new).unionByName(new)
    return both.select("lesson_id", "page_id", "prev_id", "next_id", "title", "qtype")


@query("page_answers", f"WITH {CHAIN_SQL} SELECT lesson_id, page_id, -1 AS jumpto, 'Continue' AS answer FROM c WHERE d % 2 = 1")
def page_answers(spark, sf):
    return sink.answers(_lessons(spark, sf)[1]).select("lesson_id", "page_id", "jumpto", "answer")


@query("page_media", f"WITH {CHAIN_SQL} SELECT lesson_id, page_id, 'image' || p_size || '.png' AS filename, 'ppt/media/image' || p_size || '.png' AS path FROM c WHERE d % 2 = 1 AND k % 3 = 0 AND page_id % 2 = 0")
def page_media(spark, sf):
    new = _lessons(spark, sf)[1]
    there = sink.media_rows(new).where("page_id % 2 = 1")
    return sink.media_rows(new, there).select("lesson_id", "page_id", "filename", "path")


@query("slide_titles", f"WITH {SLIDES_SQL} SELECT deck_id, CAST(row_number() OVER (PARTITION BY deck_id ORDER BY slide_no) AS INTEGER) AS page_no, slide_no, p_name AS title FROM s WHERE k % 7 <> 0")
def slide_titles(spark, sf):
    return deck.image_titles(slides(spark, sf)).withColumn("page_no", F.col("page_no").cast("int"))


@query("deck_drawings", f"WITH {SLIDES_SQL} SELECT deck_id, slide_no, 'Diagram: ' || p_brand || '; ' || p_type AS spoken, 1 AS n_rects, 1 AS n_ellipses, 1 AS n_lines, p_brand || ' ' || p_type AS words FROM s WHERE k % 4 = 1")
def deck_drawings(spark, sf):
    drawn = deck.blocks(slides(spark, sf)).where("type = 'html' AND content LIKE '%<svg%'")
    n = lambda tag: F.regexp_count("content", F.lit(f"<{tag} ")).alias(f"n_{tag}s")
    words = F.array_join(F.regexp_extract_all("content", F.lit("<tspan [^>]*>([^<]*)</tspan>"), 1), " ")
    return drawn.select("deck_id", "slide_no", F.regexp_extract("content", "<title>(.*?)</title>", 1).alias("spoken"), n("rect"), n("ellipse"), n("line"), words.alias("words"))


@query("rect_svg", """SELECT l_orderkey, l_linenumber, '<rect x="' || f(l_partkey * 100 / 9525.0) || '" y="' || f(l_suppkey * 1000 / 9525.0) || '" width="' || f(l_quantity * 9525 / 9525.0) || '" height="' || f(l_linenumber * 95250 / 9525.0) || '" fill="#112233"/>' AS svg FROM lineitem""".replace("f(", "regexp_replace(printf('%.2f', ").replace(") || '\"", "), '\\.?0+$', '') || '\""))
def rect_svg(spark, sf):
    zero, no = F.lit(0).cast("long"), F.lit(False)
    s = F.struct(
        F.lit("rect").alias("kind"), (F.col("l_partkey") * 100).alias("x"), (F.col("l_suppkey") * 1000).alias("y"), (F.col("l_quantity") * 9525).cast("long").alias("cx"), (F.col("l_linenumber") * 95250).cast("long").alias("cy"),
        F.lit("#112233").alias("fill"), F.lit(None).cast("string").alias("line"), zero.alias("linewidth"), F.lit("right").alias("arrow"), no.alias("fliph"), no.alias("flipv"),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", svg.outline(s).alias("svg"))


@query("arrow_corners", "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 10 + p_size ELSE 10 END AS DOUBLE) AS tip_x, 30.0::DOUBLE AS tip_y, CAST(CASE WHEN p_size % 2 = 0 THEN 10 ELSE 10 + p_size END AS DOUBLE) AS tail_x, 7 AS n FROM part")
def arrow_corners(spark, sf):
    turned = F.col("p_size") % 2 == 1
    points = G.arrow_points(F.lit(10.0), F.lit(10.0), F.col("p_size").cast("double"), F.lit(40.0), F.lit("right"), turned, F.lit(False))
    rows = table(spark, sf, "part").select("p_partkey", points.alias("c"))
    return rows.select("p_partkey", F.col("c")[3]["x"].alias("tip_x"), F.col("c")[3]["y"].alias("tip_y"), F.col("c")[0]["x"].alias("tail_x"), F.size("c").alias("n"))


@query("strokes", "SELECT p_partkey, CAST(CASE WHEN p_size * 1000 - 5000 > 0 THEN greatest(0.75, (p_size * 1000 - 5000) / 9525.0::DOUBLE) ELSE 1.3 END AS DOUBLE) AS stroke FROM part")
def strokes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.stroke(F.col("p_size") * 1000 - 5000).cast("double").alias("stroke"))


WRAP_SQL = """WITH RECURSIVE w AS (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '') AS t, greatest(1, CAST(floor((p_size * 4 + 20) * 0.92 / (10 * 0.55)) AS INTEGER)) AS most FROM part),
r AS (SELECT p_partkey, t, most, 1 AS i, t[1] AS line, CAST([] AS VARCHAR[]) AS done FROM w
  UNION ALL SELECT p_partkey, t, most, i + 1, CASE WHEN length(line || ' ' || t[i + 1]) > most THEN t[i + 1] ELSE line || ' ' || t[i + 1] END,
    CASE WHEN length(line || ' ' || t[i + 1]) > most THEN list_append(done, line) ELSE done END FROM r WHERE i < len(t))
SELECT p_partkey, array_to_string(list_append(done, line), '|') AS lines FROM r WHERE i = len(t)"""


@query("wrapped_lines", WRAP_SQL)
def wrapped_lines(spark, sf):
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.wrapped(text, F.col("p_size") * 4 + 20, F.lit(10)), "|").alias("lines"))


@query("forced_sizes", "SELECT p_partkey, '<div style=\"font-size:16pt;\"><p>' || p_name || ' ' || p_brand || '</p></div>' AS html FROM part")
def forced_sizes(spark, sf):
    html = render.tag('<p><span style="font-size:', X.points(F.col("p_size") * 50), 'pt;">', F.col("p_name"), "</span> ", F.col("p_brand"), "</p>")
    return table(spark, sf, "part").select("p_partkey", X.sized(html, 16).alias("html"))


@query("safe_colours", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '#' || printf('%06x', p_partkey * 77 % 16777216) ELSE '#442980' END AS colour FROM part")
def safe_colours(spark, sf):
    given = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("#"), F.format_string("%06x", F.col("p_partkey") * 77 % 16777216))).when(F.col("p_size") % 3 == 1, F.lit("red")).otherwise(F.lit("#12345"))
    return table(spark, sf, "part").select("p_partkey", X.safe_colour(given, "#442980").alias("colour"))


@query("audio_players", """SELECT p_partkey, ext IN ('mp3', 'wav', 'ogg') AS is_audio, '<audio class="sf-audio" controls preload="none"><source src="m/' || p_partkey || '"' || CASE ext WHEN 'mp3' THEN ' type="audio/mpeg"' WHEN 'wav' THEN ' type="audio/wav"' WHEN 'ogg' THEN ' type="audio/ogg"' ELSE '' END || '>This browser cannot play audio.</audio>' AS html
FROM (SELECT p_partkey, (['mp3', 'wav', 'ogg', 'png', 'txt'])[p_size % 5 + 1] AS ext FROM part)""")
def audio_players(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("MP3", "wav", "Ogg", "png", "txt"))), (F.col("p_size") % 5 + 1).cast("int"))
    path = F.concat(F.lit("a/b."), ext)
    return table(spark, sf, "part").select("p_partkey", X.is_audio(path).alias("is_audio"), render.audio(F.concat(F.lit("m/"), "p_partkey"), path, "sf-").alias("html"))


@query("picture_grids", """SELECT n_regionkey, '<div class="row g-3 sf-grid">' || string_agg('<div class="col-12 col-md-6 col-lg-4">' || CASE WHEN n_nationkey % 2 = 0 THEN '<div class="sf-cap">' || n_name || '</div>' ELSE '' END || '<img src="r' || n_nationkey || '" alt="" class="img-fluid"></div>', '' ORDER BY n_nationkey) || '</div>' AS html FROM nation GROUP BY n_regionkey""")
def picture_grids(spark, sf):
    p = F.struct(F.col("n_nationkey").alias("n"), F.concat(F.lit("r"), "n_nationkey").alias("ref"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("caption"))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return rows.select("n_regionkey", render.grid("p", "sf-").alias("html"))


@query("picture_cards", """SELECT n_nationkey, '<div class="card h-100"><a href="#" data-bs-toggle="modal" data-bs-target="#u' || n_nationkey || '" title="Click to enlarge"><img src="r' || n_nationkey || '" class="card-img-top" style="cursor:zoom-in;" alt=""></a>' || CASE WHEN n_regionkey = 1 THEN '' ELSE '<div class="card-body"><p class="card-text">' || n_name || '</p></div>' END || '</div>' AS html FROM nation""")
def picture_cards(spark, sf):
    caption = F.when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", render.card(F.concat(F.lit("r"), "n_nationkey"), caption, F.concat(F.lit("u"), "n_nationkey")).alias("html"))


@query("figures", """SELECT p_partkey, '<div class="sf-figure"><img src="r' || p_partkey || '" alt="" class="img-fluid"' || CASE WHEN p_size * 2 >= 60 THEN ' style="width:' || (p_size * 2) || '%"' ELSE '' END || '></div>' AS html FROM part""")
def figures(spark, sf):
    return table(spark, sf, "part").select("p_partkey", render.figure(F.concat(F.lit("r"), "p_partkey"), F.col("p_size") * 2, "sf-").alias("html"))


@query("flat_lists", """SELECT conv_id, '<ul>' || string_agg('<li>' || role || '</li>', '' ORDER BY turn) || '</ul>' AS html FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS DISTINCT FROM role GROUP BY conv_id""")
def flat_lists(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("items"))
    return c.select("conv_id", render.flat_list("items").alias("html"))


@query("layout_matches", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 < 2 THEN 3200 WHEN c_custkey % 4 = 2 THEN 2800 ELSE 0 END AS INTEGER) AS sz FROM customer")
def layout_matches(spark, sf):
    k = F.col("c_custkey") % 4
    own = F.when(k == 0, 3200)
    return table(spark, sf, "customer").select("c_custkey", R.font_size(own, F.when(k == 3, 0), F.when(k == 1, 3200), F.when(k == 2, 2800), F.lit(None).cast("int")).alias("sz"))


@query("file_urls", "SELECT page_id, 'file:///' || regexp_replace(replace(url, chr(92), '/'), '^/+', '') AS u FROM pages")
def file_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.file_url("url").alias("u"))


@query("media_references", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS name FROM part")
def media_references(spark, sf):
    src = F.concat(F.when(F.col("p_size") % 2 == 0, "@@MEDIA@@/").otherwise("other/"), "p_name")
    return table(spark, sf, "part").select("p_partkey", X.media_reference(src, "@@MEDIA@@/").alias("name"))


@query("font_rewrites", "SELECT p_partkey, '<a:latin typeface=\"Arial\"/><x:latin b=\"1\" typeface=\"Arial\"/><a:ea typeface=\"' || p_name || '\"/>' AS xml FROM part")
def font_rewrites(spark, sf):
    xml = render.tag('<a:latin typeface="', F.col("p_name"), '"/><x:latin b="1" typeface="', F.col("p_brand"), '"/><a:ea typeface="', F.col("p_name"), '"/>')
    return table(spark, sf, "part").select("p_partkey", X.with_font(xml, "Arial", M.RENDER_FONTS).alias("xml"))


@query("routes", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_pages, CASE WHEN count(*) > 30 THEN 'queued' ELSE 'inline' END AS route FROM d GROUP BY doc_id")
def routes(spark, sf):
    return imports.routed(lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_pages")))


@query("admitted_requests", "SELECT event_id, user_id FROM events e WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 50 = 0)")
def admitted_requests(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "lesson_id")
    return imports.admitted(e.where("event_type = 'view'"), e.where("event_type = 'purchase' AND event_id % 50 = 0")).select("event_id", F.col("lesson_id").alias("user_id"))


@query("expired_uploads", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def expired_uploads(spark, sf):
    return imports.expired(table(spark, sf, "events").withColumnRenamed("ts", "created"), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("backends", "SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([^.]+)$', 1)) = 'pdf' THEN 'pdf' ELSE 'deck' END AS backend FROM pages")
def backends(spark, sf):
    return table(spark, sf, "pages").select("page_id", imports.backend(F.col("url")).alias("backend"))


@query("section_plates", f"WITH {SLIDES_SQL} SELECT deck_id, slide_no, part, count(*) AS n FROM (SELECT deck_id, slide_no, unnest(list_filter([CASE WHEN k % 13 = 0 AND k % 5 = 0 THEN 'label' WHEN k % 5 = 0 THEN 'title' END, CASE WHEN k % 13 = 0 THEN 'label' ELSE 'main' END, CASE WHEN k % 3 = 0 AND k % 13 = 0 THEN 'media' WHEN k % 3 = 0 THEN 'main' END, CASE WHEN k % 11 = 0 AND k % 13 = 0 THEN 'lead' WHEN k % 11 = 0 THEN 'main' END, CASE WHEN k % 4 = 1 AND k % 13 = 0 THEN 'lead' WHEN k % 4 = 1 THEN 'main' END], lambda x: x IS NOT NULL)) AS part FROM s) GROUP BY ALL")
def section_plates(spark, sf):
    read = slides(spark, sf)
    rows = deck.blocks(read)
    given = rows.where("type = 'title'").groupBy(*deck.SLIDE).agg(F.min_by("content", "doc_ord").alias("title"))
    base = deck.headings(read).join(given, [*deck.SLIDE], "left")
    parts = deck.split_parts(rows.where("type <> 'title'").join(base, [*deck.SLIDE]))
    return parts.groupBy("deck_id", "slide_no", "part").agg(F.count("*").alias("n"))


@query("image_led_slides", f"WITH {SLIDES_SQL} SELECT deck_id, slide_no, CAST(page_no AS INTEGER) AS page_no FROM (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY slide_no) AS page_no FROM s WHERE k % 7 <> 0) WHERE k % 2 = 0")
def image_led_slides(spark, sf):
    """Slides of even parts are led by a picture, every fourth one's a picture-filled shape, with two labels over it."""
    big = (500000, 500000, 10000000, 6000000)

    def build(row: dict) -> bytes:
        made = []
        for s in sorted(row["slides"], key=lambda s: s["k"]):
            labels = [writer.text_shape([writer.paragraph(t)], (1000000 + i * 3000000, 1000000, 2000000, 500000)) for i, t in enumerate((s["p_brand"], s["p_type"]))]
            filled = f'<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:spPr>{writer._place(big)}<a:blipFill><a:blip r:embed="rId1"/></a:blipFill></p:spPr></p:sp>'
            lead = [] if s["k"] % 2 else [filled if s["k"] % 4 == 0 else writer.picture("rId1", big)]
            made.append((writer.slide([*lead, *labels], s["k"] % 7 == 0), {"rId1": "../media/image1.png"}))
        return writer.package(made, list(range(len(made), 0, -1)))

    own = F.struct(F.col("p_partkey").alias("k"), "p_brand", "p_type")
    rows = table(spark, sf, "part").select(F.concat(F.lit("deck"), ((F.col("p_partkey") - 1) / PER_DECK).cast("long")).alias("deck_id"), own.alias("s"))
    packed = writer.write(rows.groupBy("deck_id").agg(F.collect_list("s").alias("slides")), build)
    return deck.complex_slides(package.slides(packed), M.ImportOptions()).withColumn("page_no", F.col("page_no").cast("int"))
