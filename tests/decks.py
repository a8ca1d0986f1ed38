"""Builds small decks for tests."""

import io
import zipfile

from slideframe import model as M

NS = f'xmlns:a="{M.NS_A}" xmlns:p="{M.NS_P}" xmlns:r="{M.NS_R}"'


def xfrm(x=None, y=None, cx=0, cy=0, attrs=""):
    return "" if x is None else f'<a:xfrm {attrs}><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm>'


def para(*runs, ppr=""):
    body = "".join(r if r.startswith("<") else f"<a:r><a:t>{r}</a:t></a:r>" for r in runs)
    return f"<a:p>{ppr}{body}</a:p>"


def sp(paras="", x=None, y=None, cx=0, cy=0, ph=None, geom="", sppr="", style="", lst="", attrs="", body=""):
    mark = "" if ph is None else f"<p:ph {ph}/>"
    shape = f'<a:prstGeom prst="{geom}"/>' if geom else ""
    return f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:spPr>{xfrm(x, y, cx, cy, attrs)}{shape}{sppr}</p:spPr>{style}<p:txBody><a:bodyPr>{body}</a:bodyPr><a:lstStyle>{lst}</a:lstStyle>{paras}</p:txBody></p:sp>"


def pic(rid, x=None, y=None, cx=0, cy=0, nv="", attrs=""):
    return f'<p:pic><p:nvPicPr><p:nvPr>{nv}</p:nvPr></p:nvPicPr><p:blipFill><a:blip r:embed="{rid}"/></p:blipFill><p:spPr>{xfrm(x, y, cx, cy, attrs)}</p:spPr></p:pic>'


def fill(rgb):
    return f'<a:solidFill><a:srgbClr val="{rgb}"/></a:solidFill>'


def slide(*shapes, attrs=""):
    return f"<p:sld {NS} {attrs}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"


def rels(*pairs):
    rows = "".join(f'<Relationship Id="{i}" Target="{t}" Type="x"{m}/>' for i, t, *rest in pairs for m in [rest[0] if rest else ""])
    return f'<Relationships xmlns="{M.NS_REL}">{rows}</Relationships>'


def deck(slides, slide_rels=None, extra=None, size=(M.SLIDE_W, M.SLIDE_H), order=None, listed=True):
    """Bytes of a deck; ``slide_rels`` holds a list of relationships a slide."""
    parts = {"[Content_Types].xml": "<Types/>"}
    ids = order or range(1, len(slides) + 1)
    entries = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in ids) if listed else ""
    parts["ppt/presentation.xml"] = f'<p:presentation {NS}><p:sldIdLst>{entries}</p:sldIdLst><p:sldSz cx="{size[0]}" cy="{size[1]}"/></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = rels(*[(f"rId{i}", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)])
    for i, s in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = s
        if slide_rels and slide_rels[i - 1]:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = rels(*slide_rels[i - 1])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (parts | (extra or {})).items():
            z.writestr(name, data)
    return out.getvalue()
