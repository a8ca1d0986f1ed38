"""From parsed slides to pages: blocks, drawings, sections, layout, HTML.

Resolution and classification are expressions on a slide's own row. Layout then
works on rows of blocks, partitioned once by slide; every window and grouping
below is keyed by the slide and more, so it reuses that one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import model as M
from ..durable import durable
from ..functions import geometry as G
from ..functions import text as X
from ..model import ImportOptions
from ..operators import layout as L
from ..operators import relate as R
from . import render as H
from . import svg

SLIDE = ("deck_id", "slide_no")
Renderer = Callable[[bytes, int, str], Iterator[tuple[int, str, bytes]]]


def _colour(c) -> Column:
    plain = F.when(c["val"].rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(c["val"])))
    return F.when(c["kind"] == "srgbClr", plain).when(c["kind"] == "schemeClr", R.colour(c["val"], F.col("colour_map"), F.col("scheme")))


def shapes(slides: DataFrame) -> DataFrame:
    """One row a shape ``s`` with its slide's references, dealt out by slide; furniture is left out."""
    refs = ("slide_w", "slide_h", "rels", "colour_map", "scheme", "master_sizes", "layout", "diagrams")
    rows = slides.where("error IS NULL").select(*SLIDE, *refs, F.explode("shapes").alias("s"))
    kind = F.coalesce(F.col("s.ph.type"), F.lit(""))
    return rows.where(~kind.isin(*M.FURNITURE)).withColumn("is_title", kind.isin(*M.TITLES)).repartition(*SLIDE)


def with_geometry(rows: DataFrame) -> DataFrame:
    """Add x, y, cx, cy: moved by the groups, then the upright box of the turned shape."""
    rows = rows.withColumn("tf", G.group_transform("s.chain"))
    x, y, cx, cy = G.apply_transform("tf", "s.x", "s.y", "s.cx", "s.cy")
    rows = rows.withColumns({"x": F.coalesce(x, F.lit(M.NO_OFFSET)), "y": F.coalesce(y, F.lit(M.NO_OFFSET)), "cx": cx, "cy": cy})
    x, y, cx, cy = G.rotated("x", "y", "cx", "cy", "s.rot")
    return rows.withColumns({"x": x, "y": y, "cx": cx, "cy": cy})


def with_paragraphs(rows: DataFrame) -> DataFrame:
    """Add ``paras``, the non-empty paragraphs with inherited sizes and bullets, of shapes but titles."""
    same = F.filter("layout", lambda p: (p["type"] == F.col("s.ph.type")) & (p["idx"] == F.col("s.ph.idx")))
    rows = rows.withColumns({
        "layout_sizes": F.try_element_at(same, F.lit(1))["sizes"],
        "master": F.try_element_at("master_sizes", F.when(F.col("s.ph").isNotNull(), "body").otherwise("other")),
        "scale": F.when(F.col("s.autofit") > 0, F.col("s.autofit") / 100000).otherwise(1.0),
    })

    def sizes(p):
        inherited = (F.try_element_at(F.col(c), p["level"]) for c in ("s.sizes", "layout_sizes", "master"))
        fallback = R.font_size(F.lit(None).cast("int"), p["sz"], *inherited)
        return F.transform(p["runs"], lambda r: F.struct(r.alias("r"), R.font_size(r["sz"], fallback, *[F.lit(None).cast("int")] * 3, F.col("scale")).alias("size")))

    def run(e):
        body = F.when(e["r"]["bold"], H.tag("<strong>", X.escape(e["r"]["text"]), "</strong>")).otherwise(X.escape(e["r"]["text"]))
        boxed = F.when(e["size"] > 0, H.tag('<span style="font-size:', X.points(e["size"]), 'pt;">', body, "</span>")).otherwise(body)
        return F.when(e["r"]["br"], "\n").otherwise(boxed)

    def paragraph(p):
        bullet = F.coalesce(p["nobullet"], F.try_element_at(F.col("s.bullets"), p["level"]), F.lit(False))
        return F.struct(X.trim(H.glue(F.transform(sizes(p), run))).alias("text"), p["level"].alias("level"), bullet.alias("nobullet"))

    none = F.array().cast(T_PARAS)
    made = F.filter(F.transform("s.paras", paragraph), lambda p: p["text"] != "")
    return rows.withColumn("paras", F.when((F.col("s.tag") == "sp") & ~F.col("is_title"), made).otherwise(none)).drop("layout", "layout_sizes", "master", "master_sizes", "scale")


def with_vectors(rows: DataFrame) -> DataFrame:
    """Add ``v``, the vector shape that a shape or connector is, else null."""
    texts = F.transform("paras", lambda p: F.struct(X.plain_text(F.replace(p["text"], F.lit("\n"), F.lit(" "))).alias("text"), p["level"].alias("level"), p["nobullet"].alias("nobullet")))
    marked = lambda p: F.when((F.size("paras") > 1) & ~p["nobullet"], H.tag(F.repeat(F.lit("   "), p["level"]), "• ", p["text"])).otherwise(p["text"])
    rows = rows.withColumn("_texts", texts).withColumn("v_text", F.array_join(F.transform(F.filter("_texts", lambda p: p["text"] != ""), marked), "\n"))
    x, y, cx, cy = G.apply_transform("tf", "s.own.x", "s.own.y", "s.own.cx", "s.own.cy")
    no_line = F.coalesce(F.col("s.line.none"), F.lit(False))
    own_line = F.col("s.line.clr").isNotNull() & ~no_line
    rows = rows.withColumns({
        "vx": x, "vy": y, "vcx": cx, "vcy": cy, "is_line": F.col("s.tag") == "cxnSp", "geom": G.preset_kind("s.preset"),
        "fill": F.when(~F.col("s.nofill"), F.when(F.col("s.fill").isNotNull(), _colour(F.col("s.fill"))).otherwise(_colour(F.col("s.fill_ref")))),
        "line": F.when(own_line, _colour(F.col("s.line.clr"))).when(~no_line, _colour(F.col("s.line_ref"))),
        "linewidth": F.when(own_line, F.col("s.line.w")).otherwise(0),
    })
    background = (F.col("vcx") >= F.floor(F.col("slide_w") * M.BACKGROUND_SHARE)) & (F.col("vcy") >= F.floor(F.col("slide_h") * M.BACKGROUND_SHARE))
    panel = (F.col("vx") <= M.PANEL_X) & (F.col("vcy") >= M.PANEL_HEIGHT)
    drawn = F.col("fill").isNotNull() | F.col("line").isNotNull() | F.col("s.styled") | (F.col("geom.kind") == "arrow")
    box = (F.col("s.tag") == "sp") & F.col("s.ph").isNull() & F.col("s.shaped") & F.col("s.own").isNotNull() & (F.col("vcx") > 0) & (F.col("vcy") > 0) & ~background & ~panel & drawn
    rows = rows.withColumn("is_vector", F.coalesce(F.when(F.col("is_line"), F.col("s.own").isNotNull() & ~no_line).otherwise(box), F.lit(False)))
    turn = F.pmod(F.floor(F.col("s.own.rot") / 60000), F.lit(360)).cast("int")
    v = F.struct(
        F.col("s.ord").alias("ord"), F.when(F.col("is_line"), "line").otherwise(F.col("geom.kind")).alias("kind"), F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vcx").alias("cx"), F.col("vcy").alias("cy"),
        F.when(F.col("is_line"), 0).otherwise(turn).alias("rotation"), F.col("s.own.fliph").alias("fliph"), F.col("s.own.flipv").alias("flipv"), F.when(~F.col("is_line"), F.col("fill")).alias("fill"),
        F.when(F.col("is_line"), F.coalesce("line", F.lit("#000000"))).otherwise(F.col("line")).alias("line"), F.col("linewidth").cast("long").alias("linewidth"), F.col("geom.arrow").alias("arrow"),
        F.col("v_text").alias("text"), F.lit(None).cast("string").alias("textcolour"),
    )
    return rows.withColumn("v", F.when(F.col("is_vector"), v)).drop("_texts", "v_text", "vx", "vy", "vcx", "vcy", "is_line", "geom", "fill", "line", "linewidth", "colour_map", "scheme")


def _visible(v) -> Column:
    white = lambda c: c.isNull() | (F.upper(c) == "#FFFFFF")
    return v["kind"].isin("arrow", "line") | (X.trim(v["text"]) != "") | ~(white(v["fill"]) & white(v["line"]))


def with_drawings(rows: DataFrame, css: str) -> DataFrame:
    """Add ``drawing`` on the last vector of slides that qualify, and ``replaced`` on all of their boxes.

    At least two visible shapes must carry text, and no picture may take 6 % of the slide.
    """
    tf, s = F.col("tf"), F.col("s")
    w, h = (F.when(s["tag"] == "pic", G.whole(s[c] * tf[k])).otherwise(s[c]) for c, k in (("first_cx", "sx"), ("first_cy", "sy")))
    shown = s["tag"].isin("pic", "sp") & F.col("image").isNotNull() & F.col("audio").isNull()
    photo = F.coalesce(shown & (w * h >= F.col("slide_w") * F.col("slide_h") * M.PHOTO_SHARE), F.lit(False))
    seen = F.col("is_vector") & _visible(F.col("v"))
    texted = seen & ~F.col("v.kind").isin("arrow", "line") & (X.trim(F.col("v.text")) != "")
    slide = W.partitionBy(*SLIDE)
    rows = rows.withColumns({"seen": F.coalesce(seen, F.lit(False)), "_photo": photo, "_texted": F.coalesce(texted, F.lit(False))})
    rows = rows.withColumn("qualifies", ~F.max("_photo").over(slide) & (F.sum(F.col("_texted").cast("int")).over(slide) >= 2))
    vectors = rows.where("qualifies AND seen").select(*SLIDE, "v")
    figures = svg.drawings(vectors, SLIDE, css)
    return rows.drop("_photo", "_texted").join(figures, [*SLIDE], "left").withColumn("replaced", F.col("is_vector") & F.col("drawing").isNotNull())


def _block(kind: str, order: Column, width=None, content=None, paras=None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), *[F.col(c).alias(c) for c in ("y", "x", "cx", "cy")], order.cast("int").alias("doc_ord"),
        (F.lit(0) if width is None else width).cast("int").alias("widthpct"), (F.lit(None) if content is None else content).cast("string").alias("content"),
        (F.lit(None) if paras is None else paras).cast(T_PARAS).alias("paras"),
    )


T_PARAS = "array<struct<text:string,level:int,nobullet:boolean>>"


def blocks(slides: DataFrame, options: ImportOptions | None = None) -> DataFrame:
    """One row a block (see ``model.BLOCK``) of each slide, dealt out by slide; ``title`` blocks hold title text.

    Furniture and badges go. Boxes and arrows become one drawing where at
    least two carry text and no large photograph leads the slide.
    """
    o = options or ImportOptions()
    target = lambda rid: F.try_element_at(F.col("rels"), F.col(rid))
    rows = with_geometry(shapes(slides))
    rows = rows.withColumns({"image": target("s.blip"), "audio": F.when(F.col("s.tag") == "pic", target("s.audio")), "items": F.try_element_at("diagrams", F.col("s.dm"))}).drop("rels", "diagrams")
    rows = with_drawings(with_vectors(with_paragraphs(rows)), o.css)
    cells = lambda r: F.transform(r, lambda c: F.array_join(F.transform(F.filter(c, lambda t: X.trim(t) != ""), X.escape), " "))
    rows = rows.withColumn("rows", F.filter(F.transform("s.cells", cells), lambda r: F.size(r) > 0))
    rows = rows.withColumns({"frame": F.coalesce(H.flat_list("items"), H.table_html("rows")), "width": G.width_percent("cx", "slide_w"), "badge": X.is_badge(F.transform("paras", lambda p: p["text"]), F.col("is_vector"))})
    tag, order = F.col("s.tag"), F.col("s.ord") * 2
    title = X.joined_lines("s.title")
    keep = F.array(
        F.when((tag == "pic") & F.col("audio").isNotNull(), _block("audio", order, content=F.col("audio"))),
        F.when(tag.isin("pic", "sp") & F.col("audio").isNull() & F.col("image").isNotNull(), _block("image", order, F.col("width"), F.col("image"))),
        F.when(F.col("is_title") & (title != ""), _block("title", order + 1, content=title)),
        F.when((F.size("paras") > 0) & ~F.col("badge") & ~F.col("replaced"), _block("text", order + 1, paras=F.col("paras"))),
        F.when((tag == "graphicFrame") & F.col("frame").isNotNull(), _block("html", order, content=F.col("frame"))),
        F.when(F.col("replaced") & (F.col("s.ord") == F.col("drawn_by")), F.struct(F.lit("html").alias("type"), F.col("top_y").alias("y"), F.col("top_x").alias("x"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), F.lit(1 << 30).alias("doc_ord"), F.lit(0).alias("widthpct"), F.col("drawing").alias("content"), F.lit(None).cast(T_PARAS).alias("paras"))),
    )
    return rows.select(*SLIDE, F.explode(F.filter(keep, lambda b: b.isNotNull())).alias("b")).select(*SLIDE, "b.*")


def headings(slides: DataFrame) -> DataFrame:
    """(deck_id, slide_no, section): the divider that a slide is, by a coloured side panel or by its layout."""
    panel = F.filter("shapes", lambda s: (s["tag"] == "sp") & (F.size(s["chain"]) == 0) & (s["fill"]["kind"] == "srgbClr") & (s["own"]["x"] <= M.PANEL_X) & (s["own"]["cy"] >= M.PANEL_HEIGHT) & (s["own"]["cx"] <= F.floor(F.col("slide_w") / 2)))
    rows = slides.where("error IS NULL").select(*SLIDE, "section_layout", F.try_element_at(panel, F.lit(1)).alias("p"))
    tint = F.lower("p.fill.val")
    found = F.struct(F.when(tint.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), tint)).alias("colour"), (F.col("p.own.x") + F.col("p.own.cx")).alias("panelright"))
    by_layout = F.struct(F.lit(None).cast("string").alias("colour"), F.lit(None).cast("long").alias("panelright"))
    return rows.select(*SLIDE, F.when(F.col("p").isNotNull(), found).when(F.col("section_layout"), by_layout).alias("section"))


def split_parts(rows: DataFrame) -> DataFrame:
    """Add ``part`` to blocks that know their slide's title and section: label, title, lead, media or main.

    The part title is the block promoted where no title is given.
    """
    ref = F.col("section")["panelright"]
    label = F.col("section").isNotNull() & (F.col("type") == "text") & F.coalesce(F.col("x") < ref, F.lit(False))
    out = rows.withColumn("is_label", label)
    order = W.partitionBy(*SLIDE, "is_label").orderBy(F.expr(f"y div {M.ROW_BAND}"), "x", "doc_ord")
    plain = X.plain_text(F.col("paras")[0]["text"])
    promoted = ~F.col("is_label") & F.col("title").isNull() & (F.row_number().over(order) == 1) & (F.col("type") == "text") & (F.size("paras") == 1) & X.promotable(plain)
    out = out.withColumn("promoted", promoted)
    part = F.when(F.col("is_label"), "label").when(F.col("promoted"), "title").when(F.col("section").isNull(), "main").when(F.col("type") == "image", "media").otherwise("lead")
    wide = (F.col("type") == "image") & F.col("section").isNotNull() & (F.col("widthpct") >= M.FILL_PERCENT)
    return out.withColumns({"part": part, "widthpct": F.when(wide, 100).otherwise(F.col("widthpct"))}).drop("is_label", "promoted")


def laid_out(parts: DataFrame) -> DataFrame:
    """Add rows, columns and places to the blocks of main, lead and media parts."""
    key = (*SLIDE, "part")
    body = parts.where("part IN ('main', 'lead', 'media')")
    rowed = L.rows(body.drop("title", "section"), key)
    return L.column_layout(L.x_clusters(rowed, (*key, "row_no")), (*key, "row_no"))


def named_media(placed: DataFrame) -> DataFrame:
    """(deck_id, slide_no, content, filename): names in the order in which rendering meets the media.

    A row's leading pictures come first, as the test for picture rows meets them.
    """
    row = W.partitionBy(*SLIDE, "part", "row_no")
    inx = row.orderBy("x", "y", "doc_ord")
    other = F.max(F.when(F.col("type") != "image", 1).otherwise(0)).over(inx.rowsBetween(W.unboundedPreceding, 0))
    shown = row.orderBy(F.when(F.col("columned"), F.col("col_no")), "place")
    part = F.when(F.col("part") == "media", 1).otherwise(0)
    order = F.struct(part.alias("a"), "row_no", other.alias("b"), F.when(other == 0, F.row_number().over(inx)).otherwise(F.row_number().over(shown)).alias("c"))
    media = placed.withColumn("_first", order).where("type IN ('image', 'audio')")
    return R.media_names(media.withColumn("_audio", F.col("type") == "audio"), SLIDE, "content", "_first", X.image_name("content"))


def rendered(placed: DataFrame, names: DataFrame, o: ImportOptions) -> DataFrame:
    """(deck_id, slide_no, part, html): every part's items in order."""
    key = (*SLIDE, "part")
    row = W.partitionBy(*key, "row_no")
    df = placed.join(names, [*SLIDE, "content"], "left").withColumn("ref", F.concat(F.lit(o.media_root), F.col("filename")))
    df = df.withColumns({"n": F.count("*").over(row), "has_image": F.max(F.col("type") == "image").over(row)})
    seed = F.concat_ws("|", *SLIDE)
    beside = F.col("columned") & F.col("has_image") & (F.col("n") > 1)
    text = F.when(beside, H.text_html("paras", o.adjacent_size)).otherwise(H.text_html("paras", o.body_size))
    uid = H.card_id(seed, F.col("ref"))
    if o.card_group:
        inline = H.tag(f'<div class="{o.css}card">', H.card(F.col("ref"), F.lit(""), uid), "</div>", H.card_modal(F.col("ref"), F.lit(""), uid, o.css))
    else:
        inline = H.tag('<img src="', F.col("ref"), '" alt="" class="img-fluid">')
    whole = ~F.col("columned")
    cell = (
        F.when((F.col("type") == "image") & whole, H.figure("ref", "widthpct", o.css))
        .when(F.col("type") == "image", inline)
        .when(F.col("type") == "html", F.coalesce("content", F.lit("")))
        .when(F.col("type") == "audio", H.audio("ref", "content", o.css))
        .when(F.col("type") == "text", text)
        .otherwise("")
    )
    caption = X.sized(F.replace(F.col("paras")[0]["text"], F.lit("\n"), F.lit(" ")), o.body_size)
    short = (F.col("type") == "text") & X.is_caption(F.transform("paras", lambda p: p["text"]))
    member = F.struct("x", "y", "doc_ord", "col_no", "place", cell.alias("cell"), "ref", "widthpct", caption.alias("caption"))
    rows = df.groupBy(*key, "row_no").agg(
        F.array_sort(F.collect_list(member)).alias("m"), F.count("*").alias("n"), F.first("columned").alias("columned"), F.first("n_cols").alias("n_cols"), F.first("grid").alias("grid"),
        F.bool_and(F.col("type") == "image").alias("all_images"), (F.bool_and(F.coalesce(short, F.lit(False))) & (F.count("*") >= 2)).alias("is_caption"),
    )
    ordered = F.array_sort(F.transform("m", lambda b: F.struct(b["col_no"].alias("col"), b["place"].alias("place"), b["cell"].alias("cell"))))
    stacked = F.array_sort(F.transform("m", lambda b: F.struct(b["place"].alias("place"), b["cell"].alias("cell"))))
    cells = F.transform(F.sequence(F.lit(1), F.col("n_cols")), lambda c: H.glue(F.transform(F.filter(ordered, lambda b: b["col"] == c), lambda b: b["cell"])))
    html = F.when(F.col("columned"), H.columns(cells, F.col("grid"), o.css)).otherwise(H.glue(F.transform(stacked, lambda b: b["cell"])))
    rows = L.image_runs(rows.withColumn("html", html), key)
    head = F.struct("row_no", "all_images", "heads", "html", F.transform("m", lambda b: F.struct(b["ref"].alias("ref"), b["widthpct"].alias("widthpct"), b["caption"].alias("caption"))).alias("m"))
    items = rows.groupBy(*key, "item_no").agg(F.array_sort(F.collect_list(head)).alias("r"))
    pictures = F.flatten(F.transform(F.filter("r", lambda r: r["all_images"]), lambda r: r["m"]))
    captions = F.when(F.exists("r", lambda r: r["heads"]), F.col("r")[0]["m"])
    shown = F.transform(pictures, lambda p, i: F.struct(p["ref"].alias("ref"), F.try_element_at(captions, i + 1)["caption"].alias("caption")))
    group = H.card_group(shown, seed, o.css) if o.card_group else H.grid(shown, o.css)
    lone = (F.size(pictures) == 1) & captions.isNull()
    item = F.when(F.size(pictures) == 0, F.col("r")[0]["html"]).when(lone, H.figure(pictures[0]["ref"], pictures[0]["widthpct"], o.css)).otherwise(group)
    made = items.select(*key, "item_no", item.alias("html"))
    return made.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("item_no", "html"))).alias("i")).select(*key, F.array_join(F.transform("i", lambda i: i["html"]), "\n").alias("html"))


def pages(slides: DataFrame, options: ImportOptions | None = None, failed_media: DataFrame | None = None) -> DataFrame:
    """(deck_id, slide_no, title, html, issection, images) of every readable slide.

    ``failed_media`` (deck_id, content) names media that can't be stored: their
    blocks go before layout, so that grids shrink and emptied cells never arise.
    """
    o = options or ImportOptions()
    base = durable(headings(slides))
    rows = durable(blocks(slides, o))  # packages are read twice, whatever later steps ask of the blocks
    given = rows.where("type = 'title'").groupBy(*SLIDE).agg(F.min_by("content", "doc_ord").alias("title"))  # later titles go
    base = base.join(given, [*SLIDE], "left")
    rows = rows.where("type <> 'title'").join(base, [*SLIDE])
    if failed_media is not None:
        rows = rows.join(failed_media.select("deck_id", "content").distinct(), ["deck_id", "content"], "left_anti")
    parts = durable(split_parts(rows))
    placed = durable(laid_out(parts))
    names = named_media(placed)
    html = rendered(placed, names, o).groupBy(*SLIDE).agg(*[F.max(F.when(F.col("part") == p, F.col("html"))).alias(p) for p in ("main", "lead", "media")])
    order = F.struct(F.expr(f"y div {M.ROW_BAND}").alias("band"), "x", "doc_ord", "paras")
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "label", order))), lambda b: F.flatten(F.transform(b["paras"], lambda p: F.split(p["text"], "\n")))))
    heads = parts.groupBy(*SLIDE).agg(
        F.filter(F.transform(lines, lambda t: X.trim(X.strip_tags(t))), lambda t: t != "").alias("lines"),
        F.max(F.when(F.col("part") == "title", X.plain_text(F.col("paras")[0]["text"]))).alias("promoted"),
    )
    images = names.groupBy(*SLIDE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filename", "content")))).alias("images"))
    out = base.select(*SLIDE, "title", "section")
    for extra in (html, heads, images):
        out = out.join(extra, [*SLIDE], "left")
    title = F.coalesce("title", "promoted")
    bare = F.col("section").isNotNull() & F.col("section")["panelright"].isNull() & (F.size(F.coalesce("lines", F.array().cast("array<string>"))) == 0)
    label = F.coalesce(title, F.lit("Section"))
    plate = F.when(bare & (X.trim(label) != ""), F.array(X.escape(label))).otherwise(F.coalesce("lines", F.array().cast("array<string>")))
    content = F.concat(F.coalesce("lead", F.lit("")), F.coalesce("media", F.lit("")))
    colour = X.safe_colour(F.coalesce(F.col("section")["colour"], F.lit("")), o.section_colour)
    body = F.when(F.col("section").isNotNull(), X.trim(H.section(plate, content, colour, o.css))).otherwise(F.coalesce("main", F.lit("")))
    prefix, _, suffix = o.slide_title.partition("{}")
    shown = F.coalesce(F.nullif(X.trim(title), F.lit("")), F.concat(F.lit(prefix), F.col("slide_no"), F.lit(suffix)))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return out.select(*SLIDE, F.substring(shown, 1, M.STORED_TITLE_CHARS).alias("title"), body.alias("html"), F.col("section").isNotNull().alias("issection"), F.coalesce("images", none).alias("images"))


def image_titles(slides: DataFrame) -> DataFrame:
    """(deck_id, page_no, slide_no, title) of the visible slides, for pages that are images.

    Without a title placeholder the leading block names the page if it is one
    short line; blocks that aren't text win ties, badges don't count.
    """
    seen = L.visible_ordinal(slides.where("error IS NULL"), ("deck_id",), ("slide_no",), F.col("hidden"), "page_no").where("page_no IS NOT NULL")
    skip = (*M.FURNITURE, *M.TITLES)

    def candidate(h):
        lone = F.size(h["lines"]) == 1
        length = F.when(lone, F.char_length(h["lines"][0])).otherwise(0)
        return ~h["text"] | (~F.coalesce(h["ph"].isin(*skip), F.lit(False)) & (F.size(h["lines"]) > 0) & ~(lone & (length <= M.BADGE_CHARS)))

    kept = F.filter("heads", candidate)
    ranked = F.array_sort(F.transform(kept, lambda h, i: F.struct(h["top"].alias("top"), h["text"].alias("text"), i.alias("i"), h["lines"].alias("lines"))))
    first = F.try_element_at(ranked, F.lit(1))
    lead = F.when(first["text"] & (F.size(first["lines"]) == 1) & (F.char_length(first["lines"][0]) <= M.TITLE_CHARS), first["lines"][0])
    title = F.coalesce(F.nullif(F.col("any_title"), F.lit("")), lead, F.lit(""))
    return seen.select("deck_id", "page_no", "slide_no", title.alias("title"))


def complex_slides(slides: DataFrame, options: ImportOptions) -> DataFrame:
    """(deck_id, slide_no, page_no) of visible slides that are better kept as a picture.

    Slides led by a picture with labels over it, and, if wanted, those with a diagram part.
    """
    seen = L.visible_ordinal(slides.where("error IS NULL"), ("deck_id",), ("slide_no",), F.col("hidden"), "page_no").where("page_no IS NOT NULL")
    key = F.concat_ws("|", "deck_id", "slide_no")
    shapes = seen.select(*SLIDE, key.alias("slide"), (F.col("slide_w") * F.col("slide_h")).alias("area"), F.explode("shapes").alias("s")).where("s.own IS NOT NULL")
    filled = (F.col("s.tag") == "pic") | ((F.col("s.tag") == "sp") & F.col("s.blip").isNotNull())  # a shape filled by a picture is one
    boxes = shapes.select("slide", "area", "s.tag", filled.alias("picture"), F.col("s.ord").alias("doc_ord"), "s.own.x", "s.own.y", "s.own.cx", "s.own.cy", X.joined_lines("s.title").alias("text"))
    led = R.image_dominant(boxes.where("picture"), boxes.where("tag = 'sp' AND NOT picture"), "slide", F.col("area")).select(F.col("slide").alias("_led"))
    marked = seen.select(*SLIDE, "page_no", "smartart", key.alias("slide")).join(led, F.col("slide") == F.col("_led"), "left")
    return marked.where(F.col("_led").isNotNull() | (F.lit(options.smartart_images) & F.col("smartart"))).select(*SLIDE, "page_no")


def rendered_images(packages: DataFrame, renderer: Renderer, options: ImportOptions) -> DataFrame:
    """(deck_id, page_no, filename, bytes) from a renderer, page by page."""
    schema = pa.schema([("deck_id", pa.string()), ("page_no", pa.int32()), ("filename", pa.string()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            for deck, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for i, (no, name, data) in enumerate(renderer(content.as_py(), options.image_max_dim, options.render_font), 1):
                    if i > M.MOST_PAGES:
                        raise ValueError(f"{deck}: more than {M.MOST_PAGES} pages")
                    yield pa.RecordBatch.from_pylist([{"deck_id": deck, "page_no": no, "filename": name, "bytes": data}], schema)

    return packages.select("deck_id", "content").mapInArrow(run, "deck_id string, page_no int, filename string, bytes binary")


def image_pages(packages: DataFrame, slides: DataFrame, renderer: Renderer, options: ImportOptions | None = None) -> DataFrame:
    """One page a rendered slide, named by its title."""
    o = options or ImportOptions(import_mode="images")
    shots = rendered_images(packages, renderer, o).drop("bytes")
    named = shots.join(image_titles(slides).drop("slide_no"), ["deck_id", "page_no"], "left")
    prefix, _, suffix = o.slide_title.partition("{}")
    title = F.coalesce(F.nullif(X.trim("title"), F.lit("")), F.concat(F.lit(prefix), F.col("page_no"), F.lit(suffix)))
    named = named.withColumn("title", F.substring(title, 1, M.STORED_TITLE_CHARS))
    html = H.tag(f'<img src="{o.media_root}', F.col("filename"), '" alt="', X.escape("title"), '" class="img-fluid">')
    return named.select("deck_id", F.col("page_no").alias("slide_no"), "title", html.alias("html"), F.lit(False).alias("issection"), F.create_map("filename", "filename").alias("images"))


def with_images(page_rows: DataFrame, complex_rows: DataFrame, shots: DataFrame, options: ImportOptions | None = None) -> DataFrame:
    """Put the rendered picture in place of a complex slide's HTML, where there is one."""
    o = options or ImportOptions()
    found = complex_rows.join(shots.select("deck_id", "page_no", "filename"), ["deck_id", "page_no"]).select(*SLIDE, "filename")
    out = page_rows.join(found, [*SLIDE], "left")
    html = H.tag(f'<img src="{o.media_root}', F.col("filename"), '" alt="', X.escape("title"), '" class="img-fluid">')
    keep = F.col("filename").isNull()
    return out.withColumns({"html": F.when(keep, F.col("html")).otherwise(html), "images": F.when(keep, F.col("images")).otherwise(F.create_map("filename", "filename"))}).drop("filename")


def slide_counts(slides: DataFrame) -> DataFrame:
    """(deck_id, n_listed, n_visible, n_parts): slides in order, those shown, and slide parts in the package."""
    ok = slides.where("error IS NULL")
    return ok.groupBy("deck_id").agg(F.count("*").alias("n_listed"), F.count_if(~F.col("hidden")).alias("n_visible"), F.max("n_parts").alias("n_parts"))
