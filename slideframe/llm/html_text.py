"""HTML extraction by layout-aware rendering.

A tree builder with implied end tags and visibility rules reads a page; a
renderer then walks the tree and emits all visible text, with blank lines around
blocks, markers and indents for lists, and table cells aligned in columns.
A map-only operator: every page is read by itself, in time that is linear in its
length apart from table padding, which is bounded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript iframe object canvas audio video datalist noembed noframes title meta link desc metadata defs symbol".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
LINES = frozenset("option optgroup text".split())  # not blocks, but each in a line of its own
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
#: A start tag that closes an open element of these names, up to the nearest of the scopes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Start tags that end an open paragraph, and elements beyond which it isn't looked for.
ENDS_P = BLOCK - frozenset("html body tbody td tfoot th thead tr caption".split()) | {"hr"}
P_SCOPE = frozenset("table td th caption button object li div".split())
IN_HEAD = frozenset("base link meta script style title template noscript".split())

_TAG = r"<(/?)([a-zA-Z][^\s/>]*)"
_OTHER = r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*>|"
_TOKEN = re.compile(_OTHER + _TAG + r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(_OTHER + _TAG + r"([^>]*)>", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|)(?:([.#])([\w-]+))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 400  # elements nested deeper are laid out in the line of the one at this depth, so that no page can exhaust the stack
MOST_COLUMNS, MOST_ROWS = 1000, 65_534  # fixed values: the largest spans that HTML allows
WIDEST = 60  # columns are padded to at most this width


class Node:
    """An element. ``hidden`` ones have no box; ``unseen`` is the inherited visibility, which a descendant may set anew."""

    __slots__ = ("attrs", "hidden", "kids", "name", "unseen")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, unseen: bool = False, rules: Rules | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []
        style = self.attrs.get("style", "")
        display = visibility = ""
        if rules:
            display, visibility = rules.of(name, self.attrs)
        if style:
            display = _last(_DISPLAY, style) or display
            visibility = _last(_VISIBILITY, style) or visibility
        closed = name == "dialog" and "open" not in self.attrs
        off = name in INVISIBLE or (name == "input" and self.attrs.get("type") == "hidden")
        self.hidden = off or display == "none" or (display == "" and ("hidden" in self.attrs or closed))
        self.unseen = visibility in ("hidden", "collapse") if visibility in ("visible", "hidden", "collapse") else unseen


def _last(pattern: re.Pattern, style: str) -> str:
    return (pattern.findall(style.lower()) or [""])[-1]


class Rules:
    """Display and visibility by the simple selectors of a page's style sheets: an element, a class, an id, or an element with one of them.

    Later rules win over earlier ones of equal weight; an id outweighs a class, a
    class an element's name. Rules within conditions (``@media``) and other selectors don't count.
    """

    def __init__(self):
        self.found: dict[tuple[str, str, str], list[tuple[int, str, str]]] = {}
        self.n = 0

    def add(self, sheet: str) -> None:
        sheet = _COMMENT.sub("", sheet)
        while True:  # conditional blocks, the innermost left as they are by the rule pattern
            at = re.search(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}?)", sheet)
            if not at:
                break
            sheet = sheet[: at.start()] + sheet[at.end() :]
        for m in _RULE.finditer(sheet):
            display, visibility = _last(_DISPLAY, m.group(2)), _last(_VISIBILITY, m.group(2))
            if display or visibility:
                for part in m.group(1).split(","):
                    one = _SELECTOR.fullmatch(part.strip())
                    if one and part.strip():
                        self.n += 1
                        self.found.setdefault((one.group(1).lower(), one.group(2) or "", one.group(3) or ""), []).append((self.n, display, visibility))

    def of(self, name: str, attrs: dict[str, str]) -> tuple[str, str]:
        if not self.found:
            return "", ""
        marks = [("", "", 0)] + [(".", c, 2) for c in attrs.get("class", "").split()] + ([("#", attrs["id"], 4)] if "id" in attrs else [])
        met = [(weight + (tag != ""), n, d, v) for tag in ("", name) for mark, value, weight in marks for n, d, v in self.found.get((tag, mark, value), ())]
        display = visibility = ""
        for _, _, d, v in sorted(met):
            display, visibility = d or display, v or visibility
        return display, visibility


class _Open:
    """The open elements of a page, with the places of each name, so that closing looks at names and not at every element."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        for node in reversed(self.stack[i:]):
            self.at[node.name].pop()
        del self.stack[i:]

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, names, scope) -> bool:
        """Close the nearest element of these names, and all within it, unless one of the scopes is nearer."""
        i = self.last(names)
        if i and i > self.last(scope - names if names & scope else scope):
            self.cut(i)
            return True
        return False

    def text(self, value: str) -> None:
        if self.top.name == "head" and value.strip():
            self.cut(len(self.stack) - 1)
        if not self.top.unseen:
            self.top.kids.append(unescape(value))

    def add(self, node: Node, void: bool) -> None:
        """Put an element into the open one, and open it. Below ``DEEPEST`` what it holds goes to the line of the element at that depth."""
        kids = self.top.kids
        if len(self.stack) < DEEPEST or void:
            kids.append(node)
        elif not node.hidden:
            if node.name in BLOCK:
                kids.append(Node("br"))
            if node.name == "li":
                kids.append("- ")
            node.kids = kids
        if not void:
            self.push(node)


def parse(html: str) -> Node:
    """The element tree of a page. Start tags imply end tags; stray end tags are ignored."""
    root, rules = Node("#root"), Rules()
    tree = _Open(root)
    at, lower, last, pattern = 0, None, html.rfind(">"), _TOKEN
    while at < len(html):
        begin = html.find("<", at)
        while 0 <= begin <= last:
            m = pattern.match(html, begin)
            if not m and pattern is _TOKEN and html[begin + 1 : begin + 3].strip("/")[:1].isalpha():
                pattern = _LOOSE  # a quote is never closed: from here on quotes don't count, so that no stretch is read twice
                m = pattern.match(html, begin)
            if m:
                break
            begin = html.find("<", begin + 1)
        else:
            m = _OPEN_COMMENT.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            tree.text(text)
        if not m:
            break
        at = m.end()
        name = m.group(2) if m.re is not _OPEN_COMMENT else None
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name == "br":
                tree.top.kids.append(Node("br"))
            elif name == "p" and not tree.at.get("p"):
                tree.top.kids.append(Node("p"))
            else:
                deep = len(tree.stack) > DEEPEST and name in BLOCK
                tree.close({name}, {"td", "th", "table"} - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {name})
                if deep:
                    tree.top.kids.append(Node("br"))
            continue
        if tree.top.name == "head" and name not in IN_HEAD:
            tree.cut(len(tree.stack) - 1)
        if name in ENDS_P:
            tree.close({"p"}, P_SCOPE)
        if name in CLOSES:
            while tree.close(*CLOSES[name]):
                pass
        attrs = {}
        if m.group(3).strip(" /"):
            for a in _ATTRIBUTE.finditer(m.group(3)):
                attrs.setdefault(a.group(1).lower(), unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        node = Node(name, attrs, tree.top.unseen, rules)
        if name == "img" and node.unseen:
            node.hidden = True
        if name in RAW:
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(html) else -1
            if len(lower) != len(html):
                found = re.compile(f"</{name}", re.I).search(html, at)
                end = found.start() if found else -1
            body = html[at : end if end >= 0 else len(html)]
            if name == "style" and attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
                rules.add(body)
            if body and not node.hidden and not node.unseen:
                node.kids.append(unescape(body))
            after = html.find(">", end) if end >= 0 else -1
            at = after + 1 if after >= 0 else len(html)
            tree.top.kids.append(node)
        else:
            tree.add(node, name in VOID)
    return root


class _Writer:
    """Lines of text with collapsed spaces; block breaks never pile up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.line)).strip(" ")
        self.line = []
        if text:
            self.put([text])

    def put(self, lines: list[str]) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def space(self) -> None:
        self.flush()
        self.blank = True


def _inside(node: Node, level: int) -> list[str]:
    out = _Writer()
    _children(node, out, level)
    out.flush()
    return out.lines


def _children(node: Node, out: _Writer, level: int) -> None:
    number = 0
    if node.name == "ol":
        start = node.attrs.get("start", "")
        number = int(start) - 1 if re.fullmatch(r"-?[0-9]{1,9}", start) else 0
    for kid in node.kids:
        if isinstance(kid, str):
            out.line.append(kid)
            continue
        if kid.hidden:
            continue
        name = kid.name
        if name == "br":
            out.flush()
        elif name == "hr":
            out.space()
        elif name == "img":
            if kid.attrs.get("alt"):
                out.line.append(f" {kid.attrs['alt']} ")
        elif name == "li":
            out.flush()
            number += 1
            mark = f"{number}. " if node.name == "ol" else "- "
            body = [x for x in _inside(kid, level + 1) if x]
            if body:
                out.put([mark + body[0], *(" " * len(mark) + x for x in body[1:])])
        elif name == "table":
            out.space()
            lines = _table(kid, level)
            if lines:
                out.put(lines)
            out.space()
        elif name == "pre":
            out.space()
            lines = _verbatim(kid).strip("\n").split("\n")
            if any(x.strip() for x in lines):
                out.put([x.rstrip() for x in lines])
            out.space()
        elif name in BLOCK or name in LINES:
            apart = name in SPACED and not (name in ("ul", "ol") and node.name == "li")
            out.space() if apart else out.flush()
            if name in ("dd", "blockquote"):
                lines = _inside(kid, level)
                if lines:
                    out.put([f"  {x}" if x else "" for x in lines])
            else:
                _children(kid, out, level)
            out.space() if apart else out.flush()
        else:
            _children(kid, out, level)


def _verbatim(node: Node) -> str:
    return "".join(k if isinstance(k, str) else "\n" if k.name == "br" else "" if k.hidden else _verbatim(k) for k in node.kids)


def _rows(node: Node):
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.hidden:
            if kid.name in ("thead", "tbody", "tfoot"):
                yield from _rows(kid)
            else:
                yield kid


def _stray_text(node: Node):
    """The strings of a table outside its rows, those of row groups set apart."""
    for kid in node.kids:
        if isinstance(kid, str):
            yield kid
        elif kid.name in ("thead", "tbody", "tfoot", "colgroup") and not kid.hidden:
            yield from (" ", *_stray_text(kid), " ")


def _table(node: Node, level: int) -> list[str]:
    """Cells in columns padded to equal width; a cell of several lines is joined by spaces."""
    before, rows, loose = [], [], Node("tr")
    for kid in _rows(node):
        if kid.name == "caption":
            before += _inside(kid, level)
        elif kid.name == "tr":
            rows.append(kid)
        elif kid.name not in ("col", "colgroup"):
            loose.kids.append(kid)
    strays = Node("div")
    strays.kids = list(_stray_text(node))
    before += _inside(strays, level)
    if loose.kids:
        rows.append(loose)
    grid: list[list[tuple[int, str]]] = []  # a row's cells by the column that they begin in
    held: list[tuple[int, int, int]] = []  # columns taken by cells of earlier rows: from, to, the row where they end
    for at, row in enumerate(rows):
        held = [h for h in held if h[2] > at]
        cells, column, passed, new = [], 0, 0, []
        kids = [k if isinstance(k, Node) else _text(k) for k in row.kids]
        for kid in kids:
            if kid.hidden or (kid.name == "#text" and not kid.kids[0].strip()):
                continue
            while passed < len(held) and held[passed][0] <= column:
                column = max(column, held[passed][1])
                passed += 1
            lines = _inside(kid, level + 1) if kid.name in ("td", "th", "#text") else _inside(_wrapped(kid), level + 1)
            cells.append((column, " ".join(x.strip() for x in lines if x)))
            span, down = (_span(kid, a) for a in ("colspan", "rowspan"))
            if down > 1:
                new.append((column, column + span, at + down))
            column += span
        held = sorted(held + new)
        if any(c for _, c in cells):
            grid.append(cells)
    widths: dict[int, int] = {}  # columns that no cell begins in take no room
    for cells in grid:
        for i, c in cells:
            widths[i] = min(WIDEST, max(widths.get(i, 0), len(c)))
    order = sorted(widths)
    out = []
    for cells in grid:
        own, line = dict(cells), []
        for i in order[: bisect_right(order, max(own))]:
            line.append(own.get(i, "").ljust(widths[i]))
        out.append("  ".join(line).rstrip())
    return before + out


def _text(value: str) -> Node:
    node = Node("#text")
    node.kids = [value]
    return node


def _wrapped(kid: Node) -> Node:
    node = Node("div")
    node.kids = [kid]
    return node


def _span(node: Node, name: str) -> int:
    value = re.match(r"\s*\+?([0-9]+)", node.attrs.get(name, ""))
    return min(MOST_COLUMNS if name == "colspan" else MOST_ROWS, max(1, int(value.group(1)[:9]))) if value else 1


def render(html: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    return "\n".join(_inside(parse(html), 0)) if html else ""


_TITLE = re.compile(r"<title(?:\s[^>]*)?>", re.I)
_TITLE_END = re.compile(r"</title", re.I)


def title_of(html: str | None) -> str:
    """The text of the first title element, else empty."""
    begin = _TITLE.search(html or "")
    end = _TITLE_END.search(html, begin.end()) if begin else None
    return _SPACE.sub(" ", unescape(html[begin.end() : end.start()])).strip(" ") if end else ""


def _extract(batches):
    for b in batches:
        pages = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(title_of, pages), pa.string()), pa.array(map(render, pages), pa.string())], ["id", "title", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text) per row. Null html counts as empty; null ids and repeated rows give a row each.

    Other columns are not read. An empty table gives an empty result.
    """
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(_extract, "id long, title string, text string")
