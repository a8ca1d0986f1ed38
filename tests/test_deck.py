"""Whole decks, from packages to pages."""

import pytest
from pyspark.sql import functions as F

from decks import deck, fill, para, pic, rels, slide, sp
from slideframe import model as M
from slideframe.model import ImportOptions
from slideframe.plans import deck as plan
from slideframe.sources import package

IMAGE = lambda n: ("rId%d" % n, f"../media/image{n}.png")


DECKS = {}
SIZED = ImportOptions(body_size=16, adjacent_size=18)


@pytest.fixture(scope="module")
def build(spark):
    """Pages of a deck; all decks are built together, once for each set of options."""
    done = {}

    def run(name, options=None):
        o = options or ImportOptions()
        if o not in done:
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", "3")
            rows = spark.createDataFrame([(n, bytearray(deck(*a, **kw))) for n, (a, kw) in DECKS.items()], "deck_id string, content binary")
            done[o] = plan.pages(package.slides(rows), o).collect()
            spark.conf.set("spark.sql.shuffle.partitions", before)
        return {r["slide_no"]: r for r in done[o] if r["deck_id"] == name}

    return run


TABLE = '<p:graphicFrame><p:xfrm><a:off x="0" y="2000000"/><a:ext cx="100" cy="100"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>Day</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>M</a:t></a:r><a:r><a:t>on</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
ART = '<p:graphicFrame><p:xfrm><a:off x="0" y="2000000"/><a:ext cx="100" cy="100"/></p:xfrm><a:graphic><a:graphicData><x:relIds xmlns:x="urn:x" r:dm="rId9"/></a:graphicData></a:graphic></p:graphicFrame>'
DIAGRAM = f'<x:drawing xmlns:x="urn:x" xmlns:a="{M.NS_A}"><a:t>Step A</a:t><a:t>Step A</a:t><a:t> Step B </a:t><a:t>Step C</a:t></x:drawing>'


def _nine():
    bold = '<a:r><a:rPr b="1"/><a:t>First point</a:t></a:r>'
    times = [sp(para(t), 1000000 + i * 3500000, 1000000, 2000000, 400000) for i, t in enumerate(("13:00", "14:00", "15:00"))]
    clocks = [pic(f"rId{i + 1}", 1000000 + i * 3500000, 2000000, 2000000, 2000000) for i in range(3)]
    slides = [
        slide(sp(para("Presentation Title"), ph='type="ctrTitle"')),
        slide(sp(para("Overview"), ph='type="title"'), sp(para(bold) + para("Second point"), 500000, 1500000, 5000000, 900000), pic("rId1", 500000, 3000000, 3000000, 900000)),
        slide(sp(para("Clock"), ph='type="title"'), *times, *clocks),
        slide(ART), slide(TABLE),
        slide(sp(para("Getting Started"), ph='type="title"'), sp(x=0, y=0, cx=3000000, cy=6858000, geom="rect", sppr=fill("1F4E79")), sp(para("SECTION ONE"), 300000, 300000, 2000000, 500000)),
        slide(sp(para("Plain"), ph='type="title"'), sp(para("Some body text here that is long"), 500000, 1500000, 5000000, 900000)),
        slide(sp(para("Breaks"), ph='type="title"'), sp(para("AT"), 500000, 900000, 100000, 100000), sp(para("<a:r><a:t>Real</a:t></a:r>", "<a:br/>", "<a:r><a:t>content</a:t></a:r>"), 500000, 2000000, 900000, 900000)),
        slide(sp(para("Short Heading"), 500000, 300000, 5000000, 500000), sp(para("A body line that goes on and on, longer than any title could be in practice."), 500000, 2000000, 5000000, 900000)),
    ]
    return ((slides, [None, [IMAGE(1)], [IMAGE(1), IMAGE(2), IMAGE(3)], [("rId9", "../diagrams/data1.xml")], *[None] * 5]), {"extra": {"ppt/diagrams/drawing1.xml": DIAGRAM}})


DECKS["nine"] = _nine()


def test_nine_slides(build):
    p = build("nine")
    assert len(p) == 9
    assert p[1]["title"] == "Presentation Title" and p[1]["html"] == ""
    assert p[2]["title"] == "Overview" and "<ul><li><strong>First point</strong></li><li>Second point</li></ul>" in p[2]["html"]
    assert p[2]["images"] == {"image1.png": "ppt/media/image1.png"} and 'src="@@MEDIA@@/image1.png"' in p[2]["html"]
    assert p[3]["html"].count("col-12 col-md-6 col-lg-4") == 3 and p[3]["html"].index("13:00") < p[3]["html"].index("14:00") < p[3]["html"].index("15:00")
    assert '<div class="sf-cap">13:00</div><img src="@@MEDIA@@/image1.png"' in p[3]["html"]
    assert p[4]["title"] == "Slide 4" and p[4]["html"] == "<ul><li>Step A</li><li>Step B</li><li>Step C</li></ul>"
    assert "<th>Day</th>" in p[5]["html"] and "<td>Mon</td>" in p[5]["html"]
    assert p[6]["issection"] and p[6]["title"] == "Getting Started" and "#1f4e79" in p[6]["html"] and "SECTION ONE" in p[6]["html"]
    assert not p[7]["issection"]
    assert "AT" not in p[8]["html"] and "<p>Real<br>content</p>" in p[8]["html"]
    assert p[9]["title"] == "Short Heading" and "Short Heading" not in p[9]["html"]


def _text():
    none, char = '<a:pPr><a:buNone/></a:pPr>', '<a:pPr><a:buChar char="x"/></a:pPr>'
    level = lambda n: f'<a:pPr lvl="{n}"/>'
    box = dict(x=0, y=2000000, cx=5000000, cy=900000)
    slides = [
        slide(sp(para("T"), ph='type="title"'), sp("".join(para(f"item{i}", ppr=level(n)) for i, n in enumerate((0, 0, 1, 0, 1))), **box), sp(para("Footer text"), ph='type="ftr"')),
        slide(sp(para("T"), ph='type="title"'), sp(para("one", ppr=level(1)) + para("two", ppr=level(0)), **box)),
        slide(sp(para("T"), ph='type="title"'), sp(para("intro", ppr=none) + para("bullet a") + para("bullet b"), **box)),
        slide(sp(para("T"), ph='type="title"'), sp(para("aaaaa") + para("bbbbb", ppr=char), lst="<a:lvl1pPr><a:buNone/></a:lvl1pPr>", **box)),
        slide(sp(para("T"), ph='type="title"'), sp(para("&lt;script&gt; A&amp;B"), **box)),
        slide(sp(para("First"), ph='type="title"'), sp(para("Second"), ph='type="title"')),
    ]
    return ((slides,), {})


DECKS["text"] = _text()


def test_text_rules(build):
    p = build("text")
    assert p[1]["html"] == "<ul><li>item0</li><li>item1<ul><li>item2</li></ul></li><li>item3<ul><li>item4</li></ul></li></ul>"
    assert p[2]["html"] == "<ul><li>one</li><li>two</li></ul>"
    assert p[3]["html"] == "<p>intro</p><ul><li>bullet a</li><li>bullet b</li></ul>"
    assert p[4]["html"] == "<p>aaaaa</p><ul><li>bbbbb</li></ul>"
    assert p[5]["html"] == "<p>&lt;script&gt; A&amp;B</p>"
    assert p[6]["title"] == "First" and p[6]["html"] == ""


def _fonts():
    master = f'<p:sldMaster xmlns:a="{M.NS_A}" xmlns:p="{M.NS_P}"><p:txStyles><p:bodyStyle><a:lvl1pPr><a:defRPr sz="2800"/></a:lvl1pPr><a:lvl2pPr><a:defRPr sz="2400"/></a:lvl2pPr></p:bodyStyle></p:txStyles></p:sldMaster>'
    layout = f'<p:sldLayout xmlns:a="{M.NS_A}" xmlns:p="{M.NS_P}"><p:cSld><p:spTree>' + sp(ph='type="body" idx="3"', lst='<a:lvl1pPr><a:defRPr sz="3200"/></a:lvl1pPr>') + "</p:spTree></p:cSld></p:sldLayout>"
    extra = {"ppt/slideLayouts/slideLayout1.xml": layout, "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels(("r1", "../slideMasters/slideMaster1.xml")), "ppt/slideMasters/slideMaster1.xml": master}
    box = dict(y=2000000, cx=4000000, cy=900000)
    s = slide(
        sp(para("T"), ph='type="title"'), sp(para("aaaaa") + para("bbbbb", ppr='<a:pPr lvl="1"/>'), x=0, ph='idx="1"', **box), sp(para("ccccc"), x=0, **(box | {"y": 3100000}), ph='type="body" idx="3"'),
        sp(para('<a:r><a:rPr sz="1200"/><a:t>ddddd</a:t></a:r>'), x=0, y=4200000, cx=4000000, cy=900000, body='<a:normAutofit fontScale="50000"/>'),
        sp(para('<a:r><a:rPr sz="0"/><a:t>eeeee</a:t></a:r>'), x=0, y=5300000, cx=4000000, cy=900000),
    )
    link = [[("rId1", "../slideLayouts/slideLayout1.xml")]]
    return (([s], link), {"extra": extra})


DECKS["fonts"] = _fonts()


def test_font_sizes(build):
    html = build("fonts")[1]["html"]
    for want in ('font-size:28pt;">aaaaa', 'font-size:24pt;">bbbbb', 'font-size:32pt;">ccccc', 'font-size:6pt;">ddddd', "<p>eeeee</p>"):
        assert want in html
    forced = build("fonts", SIZED)[1]["html"]
    assert "28pt" not in forced and '<div style="font-size:16pt;"><p>ccccc</p></div>' in forced


def _layout():
    text = lambda t, x, y, cx=0, cy=0: sp(para(t), x, y, cx, cy)
    t = sp(para("T"), ph='type="title"')
    one = [IMAGE(1), IMAGE(2)]
    slides = [
        slide(t, text("words beside", 0, 2000000), pic("rId1", 7000000, 2000000)),
        slide(t, pic("rId1", 300000, 400000, 5000000, 5500000), text("words beside", 6500000, 1500000, 4000000, 5000000)),
        slide(t, pic("rId1", 300000, 400000, 1500000, 1500000), text("words below", 300000, 2500000, 1500000, 1500000)),
        slide(t, pic("rId1", 400000, 400000, 5000000, 5000000), text("Upper words", 6500000, 1000000, 5000000, 1500000), text("Lower words", 6400000, 3000000, 5000000, 1500000)),
        slide(t, pic("rId1", 400000, 400000, 11600000, 5000000)),
        slide(t, pic("rId1", 0, 0, 500000, 500000), pic("rId2", 0, 1000000, 500000, 500000)),
    ]
    return ((slides, [one] * 6), {})


DECKS["layout"] = _layout()


def test_layout_cases(build):
    p = build("layout")
    assert p[1]["html"].count("col-md-6") == 2 and "sf-cols" in p[1]["html"]
    assert p[2]["html"].index("<img") < p[2]["html"].index("words") and p[2]["html"].count("col-md-6") == 2
    assert "sf-cols" not in p[3]["html"] and "sf-figure" in p[3]["html"]
    assert p[4]["html"].index("Upper") < p[4]["html"].index("Lower")
    assert 'style="width:95%"' in p[5]["html"]
    assert "sf-grid" in p[6]["html"] and p[6]["html"].count("<img") == 2
    cards = build("layout", ImportOptions(card_group=True))
    assert "sf-cardgroup" in cards[6]["html"] and cards[6]["html"].count("modal fade") == 2
    assert "sf-cardmodal" in cards[1]["html"] and "sf-figure" in cards[5]["html"]
    assert build("layout", SIZED)[1]["html"].count("font-size:18pt") == 1


def _drawings():
    box = lambda t, x, y, geom="rect", f="FF0000": sp(para(t) if t else "", x, y, 1500000, 800000, geom=geom, sppr=fill(f) if f else "")
    scheme = sp(para("Third"), 500000, 4000000, 1500000, 800000, geom="roundRect", sppr='<a:solidFill><a:schemeClr val="accent1"/></a:solidFill>')
    t = sp(para("T"), ph='type="title"')
    slides = [
        slide(t, box("Yes &lt;b&gt;", 500000, 1000000), box("No", 4000000, 1000000, "ellipse"), box("", 2200000, 1000000, "rightArrow", ""), scheme),
        slide(t, box("Only one", 500000, 1000000)),
        slide(t, box("", 500000, 1000000, "leftArrow"), box("", 2500000, 1000000, "ellipse")),
        slide(t, pic("rId1", 0, 0, 6000000, 4000000), box("First box", 6500000, 1000000), box("Second box", 6500000, 3000000)),
        slide(t, box("A line", 500000, 1000000), box("B line", 500000, 3000000), '<p:cxnSp><p:spPr><a:xfrm flipV="1"><a:off x="1" y="2"/><a:ext cx="95250" cy="95250"/></a:xfrm></p:spPr></p:cxnSp>'),
    ]
    return ((slides, [None, None, None, [IMAGE(1)], None]), {})


DECKS["drawings"] = _drawings()


def test_drawings(build):
    p = build("drawings")
    assert "<svg" in p[1]["html"] and "<p>" not in p[1]["html"] and "#4472C4" in p[1]["html"] and "<polygon" in p[1]["html"] and "<ellipse" in p[1]["html"]
    assert "Yes &lt;b&gt;" in p[1]["html"] and 'aria-label="Diagram: Yes &lt;b&gt;; No; Third"' in p[1]["html"]
    assert "<svg" not in p[2]["html"] and "<svg" not in p[3]["html"] and "<svg" not in p[4]["html"]
    assert "First box" in p[4]["html"] and '<line x1="0" y1="10" x2="10" y2="0"' in p[5]["html"]


def _groups():
    group = '<p:grpSp><p:grpSpPr><a:xfrm><a:off x="5000000" y="1000000"/><a:ext cx="2000000" cy="2000000"/><a:chOff x="0" y="0"/><a:chExt cx="1000000" cy="1000000"/></a:xfrm></p:grpSpPr>{}</p:grpSp>'
    t = sp(para("T"), ph='type="title"')
    sound = pic("rId1", 0, 0, 300000, 300000, nv='<a:audioFile r:link="rId5"/>')
    section_layout = f'<p:sldLayout xmlns:p="{M.NS_P}" type="secHead"/>'
    slides = [
        slide(t, group.format(sp(para("right words"), 0, 0, 1000000, 500000)), sp(para("left words"), 0, 1000000, 2000000, 1000000)),
        slide(sp(para("Divider"), ph='type="title"'), sp(para("Some lede text"), 400000, 2000000, 4000000, 500000)),
        slide(t, sound),
        slide(t, pic("rId1", 0, 0, 500000, 500000), pic("rId2", 0, 1000000, 500000, 500000), pic("rId3", 0, 2000000, 500000, 500000), pic("rId1", 0, 3000000, 500000, 500000)),
    ]
    media = [("rId1", "../media/a b.png"), ("rId2", "../other/a b.png"), ("rId3", "../media/v.EMF")]
    return ((slides, [None, [("rId1", "../slideLayouts/slideLayout2.xml")], [IMAGE(1), ("rId5", "../media/clip.mp3")], media]), {"extra": {"ppt/slideLayouts/slideLayout2.xml": section_layout}})


DECKS["groups"] = _groups()


def test_groups_sections_audio_and_names(build):
    p = build("groups")
    assert p[1]["html"].index("left") < p[1]["html"].index("right") and "sf-cols" in p[1]["html"]
    assert p[2]["issection"] and "background-color:#442980" in p[2]["html"] and "Divider" in p[2]["html"] and "Some lede text" in p[2]["html"]
    assert '<source src="@@MEDIA@@/clip.mp3" type="audio/mpeg">' in p[3]["html"] and p[3]["images"] == {"clip.mp3": "ppt/media/clip.mp3"}
    assert p[4]["images"] == {"a_b.png": "ppt/media/a b.png", "a_b_1.png": "ppt/other/a b.png", "v.png": "ppt/media/v.EMF"}
    assert p[4]["html"].count("<img") == 4 and p[4]["html"].count("a_b.png") == 2


def test_bad_packages(spark):
    strict = deck(["<x/>"], extra={"ppt/presentation.xml": f'<p:presentation xmlns:p="{M.NS_STRICT}"/>'})
    bad = [("z", b"not a zip"), ("e", b""), ("s", strict), ("n", deck([])), ("ok", deck([slide(), "<broken"], order=[2, 1])), ("u", deck([slide(), slide()], listed=False))]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in bad], "deck_id string, content binary")
    got = package.slides(rows).select("deck_id", "slide_no", "error", "part_path", "n_parts").collect()
    by = {}
    for g in got:
        by.setdefault(g["deck_id"], []).append(g)
    assert [by[k][0]["error"] for k in ("z", "e", "s", "n")] == ["not a deck", "not a deck", "strict", "no slides"]
    assert [g["part_path"] for g in by["ok"]] == ["ppt/slides/slide2.xml", "ppt/slides/slide1.xml"]
    assert len(by["u"]) == 2
    with pytest.raises(package.TooLarge):
        package.Package(deck([slide()]), part_limit=10).read("ppt/presentation.xml")
    p = package.Package(deck([slide()]), total_limit=800)
    with pytest.raises(package.TooLarge):
        for _ in range(9):
            p.read("ppt/presentation.xml")
    assert package.resolve("ppt/slides", "../media/./a.png") == "ppt/media/a.png" and package.resolve("x", "/ppt//b") == "ppt/b"


def test_image_mode(spark):
    t = lambda s: sp(para(s), ph='type="title"')
    slides = [
        slide(t("Named")), slide(t("Hidden"), attrs='show="0"'), slide(sp(para("Styled heading"), 0, 100, 10, 10), sp(para("body"), 0, 900, 10, 10)),
        slide(sp(para("line one") + para("line two"), 0, 100, 10, 10)), slide(pic("rId1", 0, 0, 9, 9), sp(para("A label below"), 0, 900, 10, 10)),
        slide(pic("rId1", 0, 0, 10000000, 6000000), sp(para("One"), 100, 100, 900000, 900000), sp(para("Two"), 5000000, 100, 900000, 900000)), slide(ART),
    ]
    rows = spark.createDataFrame([("d", bytearray(deck(slides, [[IMAGE(1)]] * 7)))], "deck_id string, content binary")
    s = package.slides(rows)
    titles = {r["page_no"]: r["title"] for r in plan.image_titles(s).collect()}
    assert titles == {1: "Named", 2: "Styled heading", 3: "", 4: "", 5: "", 6: ""}
    fake = lambda content, dim, font: ((i, f"p{i}.png", b"x") for i in range(1, 7))
    made = {r["slide_no"]: r for r in plan.image_pages(rows, s, fake).collect()}
    assert made[2]["title"] == "Styled heading" and made[3]["title"] == "Slide 3" and 'src="@@MEDIA@@/p2.png" alt="Styled heading"' in made[2]["html"]
    assert {(r["slide_no"], r["page_no"]) for r in plan.complex_slides(s, ImportOptions()).collect()} == {(6, 5)}
    both = plan.complex_slides(s, ImportOptions(smartart_images=True))
    assert {r["slide_no"] for r in both.collect()} == {6, 7}
    swapped = {r["slide_no"]: r["html"] for r in plan.with_images(plan.pages(s), both, plan.rendered_images(rows, fake, ImportOptions())).collect()}
    assert "p5.png" in swapped[6] and "p6.png" in swapped[7] and "Styled heading" not in swapped[3]
    counts = plan.slide_counts(s).first()
    assert (counts["n_listed"], counts["n_visible"], counts["n_parts"]) == (7, 6, 7)


def test_failed_media_reflow(spark):
    pair = deck([slide(sp(para("T"), ph='type="title"'), pic("rId1", 0, 0, 500000, 500000), pic("rId2", 0, 1000000, 500000, 500000))], [[IMAGE(1), IMAGE(2)]])
    s = package.slides(spark.createDataFrame([("one", bytearray(pair)), ("both", bytearray(pair))], "deck_id string, content binary"))
    gone = spark.createDataFrame([("one", "ppt/media/image2.png"), ("both", "ppt/media/image1.png"), ("both", "ppt/media/image2.png")], "deck_id string, content string")
    html = {r["deck_id"]: r["html"] for r in plan.pages(s, ImportOptions(card_group=True), gone).collect()}
    assert "sf-figure" in html["one"] and "cardgroup" not in html["one"] and "image2" not in html["one"]
    assert html["both"] == ""


def test_parts_and_files(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(deck([slide()], extra={"ppt/media/image1.png": "png"}))
    found = package.decks(spark, str(tmp_path))
    assert [r["path"] for r in package.parts(found, r"^ppt/media/").collect()] == ["ppt/media/image1.png"]
    assert found.select(F.col("deck_id").endswith("a.pptx")).first()[0]
