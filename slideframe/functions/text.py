"""String functions as column expressions, with PHP-compatible trimming."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import AUDIO, CAPTION_CHARS, TITLE_CHARS

TRIMMED = " \t\n\r\0\x0b"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c) -> Column:
    """Strip space, tab, line feed, carriage return, NUL and vertical tab."""
    return F.btrim(_c(c), F.lit(TRIMMED))


def escape(c) -> Column:
    """Escape the five characters that matter in HTML."""
    out = _c(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(c) -> Column:
    """Undo ``escape``, and read the no-break space."""
    out = _c(c)
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return out


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), "<[^>]*>", "")


def plain_text(c) -> Column:
    """Text of an HTML fragment: breaks become spaces, tags go, entities are read."""
    return trim(unescape(strip_tags(F.regexp_replace(_c(c), "<br ?/?>", " "))))


def collapse(c) -> Column:
    """Runs of Unicode white space become one space."""
    return F.regexp_replace(_c(c), r"(?U)\s+", " ")


def joined_lines(lines) -> Column:
    """Non-blank lines joined by a space, white space collapsed (the text of a title)."""
    return trim(collapse(F.array_join(F.filter(F.transform(_c(lines), trim), lambda x: x != ""), " ")))


def sized(html, size: int) -> Column:
    """Force a font size: drop parsed sizes, wrap in a box."""
    if size <= 0:
        return _c(html)
    bare = F.regexp_replace(_c(html), r'(?s)<span style="font-size:[0-9.]+pt;">(.*?)</span>', "$1")
    return F.concat(F.lit(f'<div style="font-size:{size}pt;">'), bare, F.lit("</div>"))


def base_name(path, fallback: str = "image") -> Column:
    """The last segment of a path with unsafe characters replaced."""
    name = F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), "[^a-zA-Z0-9._-]+", "_")
    return F.when(name == "", fallback).otherwise(name)


def image_name(path) -> Column:
    """As ``base_name``; vector images are stored converted."""
    return F.regexp_replace(base_name(path), r"(?i)\.(wmf|emf)$", ".png")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^.]+)$", 1))


def is_audio(path) -> Column:
    return extension(path).isin(*AUDIO)


def safe_colour(colour, fallback) -> Column:
    c = _c(colour)
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), c).otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback))


def contrast(fill) -> Column:
    """Black or white, by the luma of a #RRGGBB fill."""
    c = _c(fill)
    red, green, blue = (F.conv(F.substring(c, i, 2), 16, 10).cast("int") for i in (2, 4, 6))
    luma = 0.299 * red + 0.587 * green + 0.114 * blue
    return F.when(c.isNull() | ~c.rlike("^#[0-9a-fA-F]{6}$"), "#000000").when(luma > 150, "#000000").otherwise("#ffffff")


def number(value) -> Column:
    """At most two decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", _c(value).cast("double")), r"\.?0+$", "")


def points(size) -> Column:
    """Hundredths of a point as points."""
    return number(_c(size) / 100)


def is_badge(paras_text, is_vector) -> Column:
    """A lone paragraph of at most four characters, measured as escaped, outside a drawing."""
    p = _c(paras_text)
    return ~_c(is_vector) & (F.size(p) == 1) & (F.char_length(trim(strip_tags(p[0]))) <= 4)


def is_caption(paras_text) -> Column:
    """A lone short paragraph, measured as escaped."""
    p = _c(paras_text)
    return (F.size(p) == 1) & (F.char_length(trim(strip_tags(F.replace(p[0], F.lit("\n"), F.lit(" "))))) <= CAPTION_CHARS)


def promotable(plain) -> Column:
    """Whether a decoded line can serve as a title."""
    p = _c(plain)
    return F.coalesce((p != "") & (F.char_length(p) <= TITLE_CHARS), F.lit(False))


def cache_key(*parts) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *map(_c, parts))), 1, 12)


def file_url(path) -> Column:
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    return F.concat(F.lit("file:///"), F.regexp_replace(p, "^/+", ""))


def media_reference(src, root: str) -> Column:
    """The file name that an image source refers to, else the empty string."""
    return F.regexp_extract(_c(src), re.escape(root) + "(.+)$", 1)


def with_font(xml, font: str, allowed: tuple[str, ...]) -> Column:
    """Set every latin typeface of a part to an allowed font; another name leaves the part alone."""
    c = _c(xml)
    if font not in allowed:
        return c
    return F.when(c.contains("latin"), F.regexp_replace(c, r'(<[A-Za-z0-9]+:latin\b[^>]*?\btypeface=")[^"]*(")', "$1" + font + "$2")).otherwise(c)


def wrapped(text, box_width, font) -> Column:
    """Greedy word wrap to the width of a box, as an array of lines; hard breaks stay."""
    most = F.greatest(F.lit(1), F.floor((_c(box_width) * 0.92) / (_c(font) * 0.55)).cast("int"))

    def fold(para):
        def add(acc, word):
            longer = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
            full = (F.char_length(longer) > most) & (acc["line"] != "")
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, word).otherwise(longer).alias("line"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
        return F.aggregate(F.split(trim(para), r"\s+"), start, add, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))))

    lines = F.flatten(F.transform(F.split(_c(text), "\n"), fold))
    return F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)
