"""Row types, options and the fixed values that define the semantics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Lengths are in EMU (914400 to the inch).
ROW_BAND = 457200
COLUMN_GAP = 914400
BADGE_CHARS = 4
CAPTION_CHARS = 12
TITLE_CHARS = 60
STORED_TITLE_CHARS = 255
FILL_PERCENT = 60
MOST_LEVEL = 8
NO_OFFSET = 10**12
PHOTO_SHARE = 0.06
BACKGROUND_SHARE = 0.85
PANEL_X, PANEL_HEIGHT = 200000, 5000000
DOMINANT_SHARE, OVERLAID_CHARS, OVERLAID_LEAST = 0.4, 60, 2
SLIDE_W, SLIDE_H = 12192000, 6858000
MOST_SLIDES, MOST_PAGES = 1000, 500
PART_BYTES, PACKAGE_BYTES = 100 << 20, 1 << 30
BLANK_ALPHA, BLANK_LEVEL, BLANK_PIXELS = 120, 250, 2_000_000
EMU_PER_PX, PADDING, RADIUS, LEAST_FONT, MOST_FONT, STROKE = 9525, 6, 10, 9, 20, 1.3
ASYNC_THRESHOLD, RETENTION_DAYS, PROBE_TTL_S, LOCK_WAIT_S = 30, 7, 3600, 10
AUDIO = {"m4a": "audio/mp4", "mp4": "audio/mp4", "aac": "audio/aac", "mp3": "audio/mpeg", "oga": "audio/ogg", "ogg": "audio/ogg", "wav": "audio/wav"}
FURNITURE = ("ftr", "sldNum", "dt")
TITLES = ("title", "ctrTitle")
TEXT_SIZES = (12, 14, 16, 18, 20, 24, 28, 32, 36)
RENDER_FONTS = ("Arial", "Calibri", "Verdana", "Times New Roman")
DEFAULT_MAP = {
    "bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2",
    "accent1": "accent1", "accent2": "accent2", "accent3": "accent3", "accent4": "accent4", "accent5": "accent5", "accent6": "accent6",
    "hlink": "hlink", "folHlink": "folHlink",
}
DEFAULT_SCHEME = {
    "dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6",
    "accent1": "4472C4", "accent2": "ED7D31", "accent3": "A5A5A5", "accent4": "FFC000", "accent5": "5B9BD5", "accent6": "70AD47",
    "hlink": "0563C1", "folHlink": "954F72",
}
NS_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
NS_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
NS_STRICT = "http://purl.oclc.org/ooxml/presentationml/main"
NS_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS_REL = "http://schemas.openxmlformats.org/package/2006/relationships"


@dataclass(frozen=True)
class ImportOptions:
    """Options of an import; literals in the plans."""

    image_max_dim: int = 1600
    section_colour: str = "#442980"
    import_mode: str = "editable"
    card_group: bool = False
    body_size: int = 0
    adjacent_size: int = 0
    smartart_images: bool = False
    render_font: str = ""
    css: str = "sf-"  # prefix of the classes in the HTML
    media_root: str = "@@MEDIA@@/"
    slide_title: str = "Slide {}"
    page_title: str = "Page {}"

    def __post_init__(self):
        for size in (self.body_size, self.adjacent_size):
            if size and size not in TEXT_SIZES:
                raise ValueError(f"text size {size} isn't one of {TEXT_SIZES}")
        if self.import_mode not in ("editable", "images"):
            raise ValueError(f"unknown import mode {self.import_mode}")


PARA = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("nobullet", T.BooleanType())])
BLOCK = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("y", T.LongType()), T.StructField("x", T.LongType()),
    T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("doc_ord", T.IntegerType()),
    T.StructField("widthpct", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("paras", T.ArrayType(PARA)),
])
