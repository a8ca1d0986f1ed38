"""Operators and expressions on small frames, with the cases that the decks rely on."""

import random

import pytest
from pyspark.sql import functions as F

from slideframe.functions import geometry as G
from slideframe.functions import text as X
from slideframe.operators import layout as L
from slideframe.operators import relate as R
from slideframe.plans import render as H
from slideframe.plans import svg

PARAS = "array<struct<text:string,level:int,nobullet:boolean>>"


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def frame(spark, boxes):
    """(y, x, cy, cx) of one slide, in document order."""
    return spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], "slide_id int, doc_ord int, y long, x long, cy long, cx long")


def columns_of(spark, boxes):
    out = L.column_layout(L.x_clusters(L.rows(frame(spark, boxes)), ("slide_id", "row_no")))
    rows = sorted((r["row_no"], r["col_no"], r["place"], r["doc_ord"], r["columned"]) for r in out.collect())
    return [r[:2] + r[3:] for r in rows]


@pytest.mark.parametrize(
    ("boxes", "columned"),
    [
        ([(2000000, 0, 0, 0), (2000000, 7000000, 0, 0)], True),
        ([(400000, 300000, 5500000, 5000000), (1500000, 6500000, 5000000, 4000000)], True),
        ([(400000, 400000, 5000000, 9000000), (1000000, 2000000, 800000, 4000000)], False),
        ([(1645920, 548640, 4105656, 5897880), (1645920, 6144768, 3666744, 5495544)], True),
        ([(1500000, 500000, 1500000, 0), (1600000, 1185600, 1500000, 0)], False),
        ([(2000000, 1000000, 0, 0), (2050000, 1000000, 0, 0)], False),
    ],
)
def test_pairs_of_blocks(spark, boxes, columned):
    got = columns_of(spark, boxes)
    assert {r[0] for r in got} == {1} and {r[3] for r in got} == {columned}


def test_rows_and_columns(spark):
    assert [r[0] for r in columns_of(spark, [(400000, 300000, 1500000, 5000000), (2500000, 300000, 1500000, 5000000)])] == [1, 2]
    upper = columns_of(spark, [(400000, 300000, 5000000, 5500000), (1000000, 6500000, 1500000, 5000000), (3000000, 6400000, 1500000, 5000000)])
    assert [r[2] for r in upper] == [0, 1, 2] and [r[1] for r in upper] == [1, 2, 2]
    footer = columns_of(spark, [(1800000, 700000, 3400000, 7000000), (1400000, 8000000, 4100000, 2200000), (6200000, 700000, 0, 0)])
    assert {r[2]: (r[0], r[3]) for r in footer} == {0: (1, True), 1: (1, True), 2: (2, False)}
    assert [r[0] for r in columns_of(spark, [(100, 0, 0, 5), (100, 10, 50, 5), (100, 20, 50, 5)])] == [1, 2, 2]
    negative = L.reading_order(frame(spark, [(-5, 9, 0, 0), (5, 3, 0, 0)])).orderBy("reading_no").collect()
    assert [r["doc_ord"] for r in negative] == [1, 0]


def test_rows_against_plain_loop(spark):
    r = random.Random(2)
    pages = [[(r.randrange(0, 900, 10), r.randrange(900), r.choice([0, 50, 200]), r.choice([0, 100, 300])) for _ in range(r.randrange(1, 12))] for _ in range(60)]
    data = [(p, i, *b) for p, boxes in enumerate(pages) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(data, "slide_id int, doc_ord int, y long, x long, cy long, cx long")
    got = {(x["slide_id"], x["doc_ord"]): x["row_no"] for x in L.overlap_rows(df).collect()}
    for p, boxes in enumerate(pages):
        row, top, bottom = 0, 0, 0
        for y, _, i, cy in sorted((b[0], b[1], i, b[2]) for i, b in enumerate(boxes)):
            if row and 2 * (min(bottom, y + cy) - max(top, y)) >= max(1, min(cy, bottom - top)):
                top, bottom = min(top, y), max(bottom, y + cy)
            else:
                row, top, bottom = row + 1, y, y + cy
            assert got[p, i] == row


def test_lists(spark):
    depths = lambda *a: value(spark, L.list_depths(F.array(*map(F.lit, a))))
    assert depths(1, 0, 3, 3, 0) == [0, 0, 1, 2, 0] and depths(5) == [0] and value(spark, L.list_depths(F.array().cast("array<int>"))) == []

    def html(*rows, size=0):
        p = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(n).alias("level"), F.lit(b).alias("nobullet")) for t, n, b in rows]).cast(PARAS)
        return value(spark, H.text_html(p, size))

    assert html(("a", 0, False), ("b", 3, False), ("c", 3, False), ("d", 0, False)) == "<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>"
    assert html(("a", 0, True), ("b", 0, True), ("c", 0, False)) == "<p>a</p><p>b</p><ul><li>c</li></ul>"
    assert html(("x\ny", 4, False)) == "<p>x<br>y</p>"
    assert html(('<span style="font-size:12pt;">font-size:9pt;</span>', 0, False), size=14) == '<div style="font-size:14pt;"><p>font-size:9pt;</p></div>'


def test_text_functions(spark):
    v = lambda e: value(spark, e)
    assert v(X.trim(F.lit("\t a\xa0\n\x0b"))) == "a\xa0" and v(X.collapse(F.lit("a\xa0 \n b"))) == "a b"
    assert v(X.plain_text(F.lit("<b>A</b><br>&amp;lt;&#039;&quot; "))) == "A &lt;'\"" and v(X.escape(F.lit("<a b='c'>&\""))) == "&lt;a b=&#039;c&#039;&gt;&amp;&quot;"
    assert v(X.is_badge(F.array(F.lit("A&amp;B")), F.lit(False))) is False and v(X.is_badge(F.array(F.lit("<b>ABCD</b>")), F.lit(False))) is True
    assert v(X.image_name(F.lit("ppt/media/a b.WMF"))) == "a_b.png" and v(X.base_name(F.lit("x/"))) == "image"
    assert v(X.safe_colour(F.lit("#12345g"), "#000000")) == "#000000" and v(X.safe_colour(F.lit("#abCDef"), "#000000")) == "#abCDef"
    assert [v(X.number(F.lit(n))) for n in (10.0, 0.5, 100.0, 1.25, 0.0, 13.456)] == ["10", "0.5", "100", "1.25", "0", "13.46"]
    assert v(X.contrast(F.lit("#FFFFFF"))) == "#000000" and v(X.contrast(F.lit("#1F4E79"))) == "#ffffff" and v(X.contrast(F.lit(None).cast("string"))) == "#000000"
    assert v(X.wrapped(F.lit("aa bb cc\ndd"), F.lit(60.0), F.lit(20.0))) == ["aa bb", "cc", "dd"] and v(X.wrapped(F.lit("unbreakable"), F.lit(1.0), F.lit(20.0))) == ["unbreakable"]
    assert v(X.file_url(F.lit("C:\\tmp\\a"))) == "file:///C:/tmp/a"
    xml = '<a:latin typeface="X" p="1"/><z:latin q="2" typeface="Y"/><a:ea typeface="Z"/>'
    assert v(X.with_font(F.lit(xml), "Arial", ("Arial",))) == xml.replace('"X"', '"Arial"').replace('"Y"', '"Arial"')
    assert v(X.with_font(F.lit(xml), "Wingdings", ("Arial",))) == xml
    assert v(X.media_reference(F.lit("@@MEDIA@@/a.png"), "@@MEDIA@@/")) == "a.png"


def test_geometry(spark):
    v = lambda e: value(spark, e)
    lit = lambda *a: [F.lit(x) for x in a]
    turned = v(F.array(*G.rotated(*lit(0, 0, 100, 40, 5400000))))
    assert turned == [30, -30, 40, 100]
    assert v(G.width_percent(F.lit(0), F.lit(100))) == 0 and v(G.width_percent(F.lit(500), F.lit(100))) == 100 and v(G.width_percent(F.lit(1), F.lit(1000))) == 1
    assert [v(G.preset_kind(F.lit(p))["kind"]) for p in ("upArrow", "leftRightArrow", "ellipse", "snip2DiagRect", "flowChartProcess")] == ["arrow", "rect", "ellipse", "roundrect", "rect"]
    right = [tuple(p) for p in v(G.arrow_points(*lit(0.0, 0.0, 40.0, 20.0, "right", False, False)))]
    assert right == [(0, 5), (20, 5), (20, 0), (40, 10), (20, 20), (20, 15), (0, 15)]
    left = [tuple(p) for p in v(G.arrow_points(*lit(0.0, 0.0, 40.0, 20.0, "right", True, False)))]
    assert left == [(40 - x, y) for x, y in right]
    up = [tuple(p) for p in v(G.arrow_points(*lit(0.0, 0.0, 20.0, 40.0, "up", False, False)))]
    assert up == [(5, 40), (5, 20), (0, 20), (10, 0), (20, 20), (15, 20), (15, 40)]
    assert [tuple(p) for p in v(G.arrow_points(*lit(0.0, 0.0, 20.0, 40.0, "up", False, True)))] == [(x, 40 - y) for x, y in up]
    assert v(G.signed32(F.lit(4294967295))) == -1 and v(G.fitted(F.lit(3200), F.lit(100), 1600)) == (1600, 50)


def test_sizes_and_colours(spark):
    v = lambda e: value(spark, e)
    n = F.lit(None).cast("int")
    assert v(R.font_size(F.lit(0), F.lit(900), n, n, n)) == 0 and v(R.font_size(n, F.lit(0), n, F.lit(1200), F.lit(1))) == 1200
    assert v(R.font_size(n, F.lit(1500), n, n, n, F.lit(0.5))) == 750 and v(R.cascade(F.lit(0), n, F.lit(7), default=1)) == 7
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    assert [v(R.colour(F.lit(c), empty, empty)) for c in ("accent1", "phClr", "nope")] == ["#4472C4", None, None]


def test_media_names_pass_over_taken_numbers(spark):
    rows = [(1, 0, "a/x.png"), (1, 1, "b/x_1.png"), (1, 2, "c/x.png"), (1, 3, "a/x.png"), (1, 4, "d/x"), (1, 5, "e/x"), (1, 6, "f/x.png")]
    df = spark.createDataFrame(rows, "page int, ord int, path string")
    got = {r["path"]: r["filename"] for r in R.media_names(df, ("page",), "path", "ord", X.image_name("path")).collect()}
    assert got == {"a/x.png": "x.png", "b/x_1.png": "x_1.png", "c/x.png": "x_2.png", "d/x": "x", "e/x": "x_1", "f/x.png": "x_3.png"}


def test_image_runs(spark):
    # a caption row and its pictures end a run: the picture row after them opens a new one
    rows = [(1, 1, False, True, 2), (1, 2, True, False, 2), (1, 3, True, False, 1), (1, 4, True, False, 1), (1, 5, False, False, 1), (1, 6, False, True, 3), (1, 7, True, False, 2)]
    df = spark.createDataFrame(rows, "slide_id int, row_no int, all_images boolean, is_caption boolean, n int")
    assert [r["item_no"] for r in L.image_runs(df).orderBy("row_no").collect()] == [1, 1, 2, 2, 3, 4, 5]


def test_smaller_operators(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, v string")
    assert [r["i"] for r in L.without_repeats(df, ("k",), ("i",), "v").orderBy("i").collect()] == [0, 2, 4, 5]
    assert [r["island"] for r in L.islands(df, ("k",), ("i",), F.col("v")).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]
    assert L.newest(df, ("k",), "i").first()["v"] == "a"
    parts = spark.createDataFrame([("d", 1, 60), ("d", 2, 60), ("e", 1, 101)], "deck string, n int, size long")
    assert [r["over"] for r in R.over_limits(parts, ("deck",), ("n",), "size", 100, 110).orderBy("deck", "n").collect()] == [False, True, True]
    assert value(spark, H.flat_list(F.array(*map(F.lit, ("a", "a", "b<", "a"))))) == "<ul><li>a</li><li>b&lt;</li><li>a</li></ul>"
    one = "ord int, kind string, x long, y long, cx long, cy long, rotation int, fliph boolean, flipv boolean, fill string, line string, linewidth long, arrow string, text string, textcolour string"
    flat = spark.createDataFrame([(0, "line", 5, 5, 0, 0, 0, False, False, None, "#000000", 0, "right", "", None), (1, "rect", 0, 0, 95250, 95250, 90, False, False, "#FF0000", "#00FF00", 9525, "right", "", None)], one)
    figure = svg.drawings(flat.select(F.lit(1).alias("s"), F.struct("*").alias("v")), ("s",), "sf-").first()["drawing"]
    assert '<g transform="rotate(90 5 5)"><rect x="0" y="0" width="10" height="10" fill="#FF0000" stroke="#00FF00" stroke-width="1"/></g>' in figure
