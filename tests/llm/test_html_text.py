import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from slideframe.llm import html_text as ht


def test_layout():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
    <body><h1>Head</h1><p>One<b> two</b><br>three<p>Four &copy;
    five<ul><li>a<li>b<ul><li>c</ul><li hidden>no<li>d</ul><ol start=3><li>x<li>y</ol>
    <div style="display:none">gone</div><div>x</div>y<!-- c --><table><caption>Cap<tr><th>Name<th>N<tr><td>Long name<td>1<tr><td colspan=2>wide</table>
    <pre>  a
   b</pre><img alt="pic"><template>t</template>end"""
    assert ht.render(page) == (
        "Head\n\nOne two\nthree\n\nFour © five\n\n- a\n- b\n  - c\n- d\n\n3. x\n4. y\n\nx\ny\n\nCap\nName       N\nLong name  1\nwide\n\n  a\n   b\n\npic end"
    )
    assert ht.title_of(page) == "T & t"


def test_tables():
    assert ht.render("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>") == "a  b  c\nd     e"
    assert ht.render("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>") == "x  y  z"
    assert ht.render("<table>stray<tr><td>a</table>") == "stray\na"


def test_odd_input():
    for t in ["", None, "<", "<a", "a<b", "</p>", "<p", "<!--x", "<script>x", "&#0;&amp", "<td>a<td>b", "\x00", "</table></div>x", "İ<script>a</SCRIPT>b"]:
        ht.render(t)
    assert ht.render("a < b") == "a < b"
    assert ht.render("<script>x</script>y<!-- z -->") == "y"
    assert ht.render("<head><meta charset=x><p>in body") == "in body"


def test_what_browsers_show():
    assert ht.render("<dialog open>shown</dialog><dialog>not</dialog>") == "shown"
    assert ht.render("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>") == "x=1"
    assert ht.render("<select><option>one<option>two</select>") == "one\ntwo"
    assert ht.render("<svg><title>t</title><desc>d</desc><text>label</text></svg>") == "label"
    assert ht.render('<div style="visibility:hidden">a<b style="visibility: visible">b</b><img alt="c">d</div>') == "b"
    assert ht.render('<div style="display:none">a<b style="display:block;visibility:visible">b</b></div>c') == "c"
    assert ht.render('<p hidden style="display:block">shown') == "shown"
    assert ht.render('<p style="color:red;display:NONE">a</p>b') == "b"


def test_style_sheets():
    sheet = "<style>/* .x{display:none} */ .h, #i {display:none} p.q{visibility:hidden} @media print{.m{display:none}} em{display:none} em.k{display:inline} .x > .y{display:none}</style>"
    assert ht.render(sheet + '<b class="a h">1</b><b id=i>2</b><p class=q>3</p><u class=q>4</u><b class=m>5</b><em>6</em><em class=k>7</em><b class=y>8</b><b class=x>9</b>') == "45789"
    assert ht.render('<style media=print>b{display:none}</style><b>1</b><style>b{display:none}</style><b>2</b><b style="display:inline">3</b>') == "13"


def test_deep_pages_stay_hidden_and_whole():
    """Elements below the deepest level laid out: hiding, words and real ancestors are kept."""
    for n in (10, 405, 3000):
        assert ht.render("<div>" * n + "<div hidden>SECRET</div>shown" + "</div>" * n + "after") == "shown\nafter"
        page = "<ul><li>" * n + "x" + "</li></ul>" * n + "<p>after</p>"
        assert ht.render(page).replace("-", " ").split() == ["x", "after"]
        assert ht.render("<section>" + "<b>" * n + "in" + "</b>" * n + "</section><p>out") == "in\n\nout"


def test_wide_spans():
    assert ht.render("<table><tr><td colspan=60>a<td>b<tr>" + "<td>c" * 60 + "<td>d</table>").split("\n")[0].split() == ["a", "b"]
    lines = ht.render("<table><tr><td colspan=60>a<td>b<tr>" + "<td>c" * 60 + "<td>d</table>").split("\n")
    assert lines[0].index("b") == lines[1].index("d")
    assert ht.render("<table><tr><td rowspan=70>a<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 71)) + "</table>").split("\n")[68:] == ["    68", "    69", "70"]
    began = time.process_time()
    ht.render("<table><tr>" + "<td colspan=1000>a" * 20_000 + "</table>")
    assert time.process_time() - began < 20


def test_titles_take_linear_time():
    began = time.process_time()
    assert ht.title_of("<title>" * 200_000) == "" and ht.title_of("<TITLE >a\n b</title><title>c</title>") == "a b"
    assert time.process_time() - began < 5


def plain_layout(tree):
    """An independent renderer of nested (kind, children) trees: the lines that the rules in the module's description give."""
    def lines(kind, kids, number=None):
        if kind == "text":
            return [kids]
        if kind == "p":
            return ["", kids, ""]
        if kind in ("ul", "ol"):
            out = []
            for i, kid in enumerate(kids, 1):
                mark = "- " if kind == "ul" else f"{i}. "
                body = [x for k in kid for x in lines(*k) if x]
                out += [mark + body[0], *(" " * len(mark) + x for x in body[1:])]
            return ["", *out, ""]
        widths = [max(len(r[c]) for r in kids) for c in range(len(kids[0]))]
        return ["", *("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in kids), ""]

    out = []
    for node in tree:
        for x in lines(*node):
            if x or (out and out[-1]):
                out.append(x)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def markup(kind, kids):
    if kind == "text":
        return f"<div>{kids}</div>"
    if kind == "p":
        return f"<p>{kids}"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join("<li>" + "".join(markup(*k) for k in kid) for kid in kids) + f"</{kind}>"
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in kids) + "</table>"


def test_layout_against_an_independent_renderer():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcxyz") for _ in range(r.randrange(1, 8)))

    def node(depth):
        kind = r.choice(["text", "p", "ul", "ol", "table"] if depth == 0 else ["text", "ul", "ol"])
        if kind in ("text", "p"):
            return kind, word()
        if kind == "table":
            n = r.randrange(1, 4)
            return kind, [[word() for _ in range(n)] for _ in range(r.randrange(1, 4))]
        return kind, [[("text", word()), *[node(depth + 1) for _ in range(r.randrange(2) if depth < 3 else 0)]] for _ in range(r.randrange(1, 4))]

    for _ in range(300):
        tree = [node(0) for _ in range(r.randrange(1, 5))]
        assert ht.render("".join(markup(*n) for n in tree)) == plain_layout(tree)


class Reader(HTMLParser):
    """Visible words, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.words.append(" ")
        self.off += tag in ("script", "style", "title", "head")

    def handle_endtag(self, tag):
        self.words.append(" ")
        self.off -= tag in ("script", "style", "title", "head")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_all_visible_words_of_the_pages_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {g["id"]: g["text"] for g in ht.extract(df.withColumn("id", F.lit(1)).withColumn("text", F.lit("x"))).collect()}
    strip = lambda s: re.sub(r"[\s-]+", "", s)
    for row in df.collect():
        r = Reader()
        r.feed(row["html"])
        assert strip(got[row["page_id"]]) == strip("".join(r.words))


def test_time_is_linear():
    r = random.Random(1)
    for unit in ("<div>", "<p>a", "<li>x", "<table><tr><td>", "</p>", "<b>", "<a href='", "<!--", "&", "<script>", "<td>"):
        t = time.time()
        ht.render(unit * 20_000)
        assert time.time() - t < 20, unit
    ht.render("".join(r.choice(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "x", "<ul>", "<li>", "</ul>", "<b>", "</b>"]) for _ in range(20_000)))


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a"), (None, None), (1, "<p>a"), (2, "")], "page_id long, html string")
    assert [tuple(g) for g in ht.extract(df).collect()] == [(1, "", "a"), (None, "", ""), (1, "", "a"), (2, "", "")]
    assert ht.extract(df.limit(0)).count() == 0
