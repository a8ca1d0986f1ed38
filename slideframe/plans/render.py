"""HTML of pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..operators.layout import list_depths


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glue(parts: Column) -> Column:
    return F.array_join(parts, "")


def tag(*pieces) -> Column:
    """Concatenate literals and columns; a null column counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in pieces])


def table_html(rows) -> Column:
    """An HTML table of an array of arrays of escaped cells, the first row as its head."""
    r = _c(rows)
    cells = lambda row, t: glue(F.transform(row, lambda c: tag(f"<{t}>", c, f"</{t}>")))
    body = glue(F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1))), lambda row: tag("<tr>", cells(row, "td"), "</tr>")))
    return F.when(F.size(r) > 0, tag('<table class="table"><thead><tr>', cells(r[0], "th"), "</tr></thead><tbody>", body, "</tbody></table>"))


def flat_list(items) -> Column:
    """A list of plain items, each differing from the one before."""
    kept = F.filter(_c(items), lambda x, i: (i == 0) | (x != F.try_element_at(_c(items), F.greatest(i, F.lit(1)))))
    return F.when(F.size(kept) > 0, tag("<ul>", glue(F.transform(kept, lambda x: tag("<li>", X.escape(x), "</li>"))), "</ul>"))


def nested_list(texts: Column, depths: Column) -> Column:
    """Lists nested by depth; the tags after an entry follow from its depth and the next one's."""

    def entry(text, i):
        at, then = F.element_at(depths, i + 1), F.coalesce(F.try_element_at(depths, i + 2), F.lit(-1))
        closing = F.when(then > at, "<ul>").otherwise(tag("</li>", F.repeat(F.lit("</ul></li>"), at - F.greatest(then, F.lit(0))), F.when(then < 0, "</ul>")))
        return tag("<li>", text, closing)

    return tag("<ul>", glue(F.transform(texts, entry)))


def text_html(paras, size: int = 0) -> Column:
    """Paragraphs of a block: a lone one, or runs of prose and of bullets."""
    p = _c(paras)
    empty = F.array().cast("array<struct<prose:boolean,texts:array<string>,levels:array<int>>>")
    prose = lambda x: F.coalesce(x["nobullet"], F.lit(False))
    line = lambda x: F.replace(x["text"], F.lit("\n"), F.lit("<br>"))

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["prose"] == prose(x))
        before = F.when(joins, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        grown = F.struct(prose(x).alias("prose"), F.concat(F.when(joins, last["texts"]).otherwise(F.array().cast("array<string>")), F.array(line(x))).alias("texts"), F.concat(F.when(joins, last["levels"]).otherwise(F.array().cast("array<int>")), F.array(x["level"])).alias("levels"))
        return F.concat(before, F.array(grown))

    deep = F.transform(F.aggregate(p, empty, add), lambda r: F.struct(r["prose"].alias("prose"), r["texts"].alias("texts"), list_depths(r["levels"]).alias("depths")))
    many = glue(F.transform(deep, lambda r: F.when(r["prose"], glue(F.transform(r["texts"], lambda t: tag("<p>", t, "</p>")))).otherwise(nested_list(r["texts"], r["depths"]))))
    html = F.when(F.size(p) == 1, tag("<p>", F.replace(p[0]["text"], F.lit("\n"), F.lit("<br>")), "</p>")).otherwise(many)
    return F.when(F.size(p) == 0, "").otherwise(X.sized(html, size))


def figure(ref, width, css: str) -> Column:
    style = F.when(_c(width) >= M.FILL_PERCENT, tag(' style="width:', _c(width), '%"')).otherwise("")
    return tag(f'<div class="{css}figure"><img src="', _c(ref), '" alt="" class="img-fluid"', style, "></div>")


def audio(ref, path, css: str, fallback: str = "This browser cannot play audio.") -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in M.AUDIO.items() for x in kv])
    kind = F.try_element_at(kinds, X.extension(path))
    return tag(f'<audio class="{css}audio" controls preload="none"><source src="', _c(ref), '"', F.when(kind.isNotNull(), tag(' type="', kind, '"')), f">{fallback}</audio>")


def grid(images, css: str) -> Column:
    """Pictures (ref, caption) in two columns if there are two, else in three."""
    i = _c(images)
    width = F.when(F.size(i) == 2, "col-12 col-md-6").otherwise("col-12 col-md-6 col-lg-4")
    cells = F.transform(i, lambda p: tag('<div class="', width, '">', F.when(p["caption"].isNotNull(), tag(f'<div class="{css}cap">', p["caption"], "</div>")), '<img src="', p["ref"], '" alt="" class="img-fluid"></div>'))
    return tag(f'<div class="row g-3 {css}grid">', glue(cells), "</div>")


def card(ref, caption, uid) -> Column:
    body = F.when(caption != "", tag('<div class="card-body"><p class="card-text">', caption, "</p></div>"))
    link = tag('<a href="#" data-bs-toggle="modal" data-bs-target="#', uid, '" title="Click to enlarge"><img src="', ref, '" class="card-img-top" style="cursor:zoom-in;" alt=""></a>')
    return tag('<div class="card h-100">', link, body, "</div>")


def card_modal(ref, caption, uid, css: str) -> Column:
    aria = F.when(caption != "", tag(' aria-label="', X.escape(X.plain_text(caption)), '"'))
    below = F.when(caption != "", tag('<p class="mt-2 mb-0 text-muted">', caption, "</p>"))
    head = '<div class="modal-header py-2"><button type="button" class="btn-close" data-bs-dismiss="modal" aria-label="Close"></button></div>'
    picture = tag('<img src="', ref, '" alt="" style="width:100%;height:65vh;object-fit:contain;">')
    return tag(f'<div class="modal fade {css}cardmodal" id="', uid, '" tabindex="-1"', aria, '><div class="modal-dialog modal-xl modal-dialog-centered"><div class="modal-content">', head, '<div class="modal-body p-2 text-center">', picture, below, "</div></div></div></div>")


def card_group(images, seed, css: str) -> Column:
    """Pictures as cards with a zoom dialog each; ids follow from the page and the picture's place."""
    i = _c(images)
    n = F.size(i)
    width = F.when(n >= 4, "row-cols-1 row-cols-sm-2 row-cols-lg-4").when(n == 3, "row-cols-1 row-cols-md-3").otherwise("row-cols-1 row-cols-md-2")
    uid = lambda p: card_id(seed, p["ref"])
    caption = lambda p: X.trim(F.coalesce(p["caption"], F.lit("")))
    cards = F.transform(i, lambda p: tag(f'<div class="col {css}card">', card(p["ref"], caption(p), uid(p)), "</div>"))
    modals = F.transform(i, lambda p: card_modal(p["ref"], caption(p), uid(p), css))
    return tag('<div class="row ', width, f' g-4 {css}cardgroup">', glue(cards), "</div>\n", F.array_join(modals, "\n"))


def card_id(seed, ref) -> Column:
    return tag("card", F.substring(F.md5(F.concat_ws("|", _c(seed), ref)), 1, 12))


def columns(cells, width, css: str) -> Column:
    """Column contents side by side."""
    inner = glue(F.transform(_c(cells), lambda c: tag('<div class="col-12 col-md-', width, '">', c, "</div>")))
    return tag(f'<div class="row g-3 mb-3 {css}cols">', inner, "</div>")


def section(lines, content, colour, css: str) -> Column:
    """A divider: a coloured plate with its label beside the content."""
    plate = tag(f'<div class="col-12 col-md-3"><div class="{css}plate" style="background-color:', colour, ';">', F.array_join(_c(lines), "<br>"), "</div></div>")
    hero = tag(f'<div class="container-fluid {css}section"><div class="row">', plate, f'<div class="col-12 col-md-9 {css}lede">', content, "</div></div></div>")
    return F.when(F.size(_c(lines)) > 0, hero).otherwise(tag(f'<div class="{css}lede">', content, "</div>"))
