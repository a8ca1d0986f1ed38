"""Geometry as column expressions; lengths in EMU."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model as M


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole(c) -> Column:
    """Round half away from zero to a long."""
    return F.round(_c(c)).cast("long")


def group_transform(chain) -> Column:
    """Compose the transforms of nested groups, outermost first, to a struct (ox, oy, sx, sy).

    Each link is a struct of off, ext, choff and chext coordinates; a link
    with a missing part leaves the transform as it is.
    """
    start = F.struct(F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy"))

    def compose(tf, g):
        sx = F.when(g["chcx"] > 0, g["cx"] / g["chcx"]).otherwise(1.0)
        sy = F.when(g["chcy"] > 0, g["cy"] / g["chcy"]).otherwise(1.0)
        ox, oy = g["x"] - g["chx"] * sx, g["y"] - g["chy"] * sy
        whole_link = g["x"].isNotNull() & g["cx"].isNotNull() & g["chx"].isNotNull() & g["chcx"].isNotNull()
        new = F.struct((tf["ox"] + ox * tf["sx"]).alias("ox"), (tf["oy"] + oy * tf["sy"]).alias("oy"), (sx * tf["sx"]).alias("sx"), (sy * tf["sy"]).alias("sy"))
        return F.when(whole_link, new).otherwise(tf)

    return F.aggregate(_c(chain), start, compose)


def apply_transform(tf, x, y, cx, cy) -> tuple[Column, Column, Column, Column]:
    t = _c(tf)
    return whole(t["ox"] + _c(x) * t["sx"]), whole(t["oy"] + _c(y) * t["sy"]), whole(_c(cx) * t["sx"]), whole(_c(cy) * t["sy"])


def rotated(x, y, cx, cy, rot) -> tuple[Column, Column, Column, Column]:
    """The upright box around a box turned by ``rot`` (1/60000 degree) about its centre."""
    x, y, cx, cy, rot = map(_c, (x, y, cx, cy, rot))
    a = F.radians(rot / 60000.0)
    cos, sin = F.abs(F.cos(a)), F.abs(F.sin(a))
    w, h = whole(cx * cos + cy * sin), whole(cx * sin + cy * cos)
    turned = (cx > 0) & (cy > 0) & (x != M.NO_OFFSET) & (rot != 0)
    keep = lambda new, old: F.when(turned, new).otherwise(old)
    return keep(whole(x + cx / 2 - w / 2), x), keep(whole(y + cy / 2 - h / 2), y), keep(w, cx), keep(h, cy)


def width_percent(cx, slide_w) -> Column:
    """Width as a share of the slide, 1 to 100; 0 if unknown."""
    cx, w = _c(cx), _c(slide_w)
    return F.when((cx <= 0) | (w <= 0), 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), F.round(cx / w * 100).cast("int"))))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether two boxes (x, y, cx, cy) share a positive area."""
    right = F.least(a["x"] + a["cx"], b["x"] + b["cx"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["cy"], b["y"] + b["cy"]) - F.greatest(a["y"], b["y"])
    return (right > 0) & (down > 0)


def preset_kind(preset) -> Column:
    """(kind, arrow direction) of a preset geometry."""
    p = F.coalesce(_c(preset), F.lit("rect"))
    arrow = F.regexp_extract(p, "^(right|left|up|down)Arrow$", 1)
    kind = F.when(arrow != "", "arrow").when(p.isin("ellipse", "oval"), "ellipse").when(p.rlike("(?i)round|snip") | (p == "plaque"), "roundrect").otherwise("rect")
    return F.struct(kind.alias("kind"), F.when(arrow != "", arrow).otherwise("right").alias("arrow"))


def px(emu) -> Column:
    return _c(emu) / M.EMU_PER_PX


def stroke(line_width) -> Column:
    w = _c(line_width)
    return F.when(w > 0, F.greatest(F.lit(0.75), px(w))).otherwise(M.STROKE)


def arrow_points(x, y, w, h, arrow, flip_h, flip_v) -> Column:
    """The seven corners of a block arrow; flips change its direction."""
    x, y, w, h, arrow = map(_c, (x, y, w, h, arrow))
    turned = F.when(_c(flip_h) & arrow.isin("right", "left"), F.when(arrow == "right", "left").otherwise("right"))
    way = turned.when(_c(flip_v) & arrow.isin("up", "down"), F.when(arrow == "up", "down").otherwise("up")).otherwise(arrow)
    head = F.least(w, h)
    # along and across the arrow, from its tail: (distance from the tip, distance from the axis)
    level = way.isin("right", "left")
    length, breadth = F.when(level, w).otherwise(h), F.when(level, h).otherwise(w)
    corners = [(length, -1, 4), (head, -1, 4), (head, -1, 2), (F.lit(0.0), 0, 1), (head, 1, 2), (head, 1, 4), (length, 1, 4)]

    def corner(back, side, part):
        off = breadth * side / part
        px_ = F.when(way == "right", x + w - back).when(way == "left", x + back).otherwise(x + w / 2 + off)
        py_ = F.when(way == "up", y + back).when(way == "down", y + h - back).otherwise(y + h / 2 + off)
        return F.struct(px_.alias("x"), py_.alias("y"))

    return F.array(*[corner(*c) for c in corners])


def signed32(value) -> Column:
    v = _c(value)
    return F.when(v >= 2**31, v - 2**32).otherwise(v)


def fitted(width, height, most: int) -> Column:
    """Size of an image whose longest edge is at most ``most``; smaller ones stay."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    return F.struct(F.greatest(F.lit(1), F.round(w * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(h * scale).cast("int")).alias("height"))


def all_blank(pixels) -> Column:
    """Whether every pixel (alpha 0 opaque to 127 clear, red, green, blue) is clear or near white."""
    clear = lambda p: (p["alpha"] >= M.BLANK_ALPHA) | ((p["red"] >= M.BLANK_LEVEL) & (p["green"] >= M.BLANK_LEVEL) & (p["blue"] >= M.BLANK_LEVEL))
    return F.forall(_c(pixels), clear)
