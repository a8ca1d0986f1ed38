"""PDF files: page counts in plain Python, pages by a renderer that the caller names."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..model import ImportOptions

_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_STREAM = re.compile(rb"/Type\s*/ObjStm.*?stream\r?\n(.*?)endstream", re.S)
DPI, RENDER_TIMEOUT = 150, 600


def _inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """A compressed stream in pieces, whatever its full size."""
    z = zlib.decompressobj()
    while data and not z.eof:
        yield z.decompress(data, piece)
        data = z.unconsumed_tail


def _pages_in(pieces: Iterator[bytes], overlap: int = 256) -> int:
    """Page objects in a text that comes in pieces; those at a seam are counted once."""
    n, rest = 0, b""
    for piece in pieces:
        rest += piece
        edge = max(0, len(rest) - overlap)
        n += sum(m.start() < edge for m in _PAGE.finditer(rest))
        rest = rest[edge:]
    return n + len(_PAGE.findall(rest))


def count_pages(data: bytes) -> int:
    """Page objects in a file, those in compressed object streams included; 0 if unknown."""
    n = len(_PAGE.findall(data))
    for m in _STREAM.finditer(data):
        try:
            n += _pages_in(_inflated(m.group(1)))
        except zlib.error:
            continue
    return n


def poppler(data: bytes, max_dim: int = 0, font: str = "") -> Iterator[tuple[int, str, bytes]]:
    """Render with pdftoppm where it is installed, page by page in order of file names."""
    if shutil.which("pdftoppm") is None:
        raise RuntimeError("pdftoppm isn't installed")
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "in.pdf").write_bytes(data)
        subprocess.run(["pdftoppm", "-png", "-r", str(DPI), f"{folder}/in.pdf", f"{folder}/page"], timeout=RENDER_TIMEOUT, check=True, capture_output=True)
        for i, shot in enumerate(sorted(Path(folder).glob("page*.png")), 1):
            if body := shot.read_bytes():
                yield i, f"page{i}.png", body


def page_counts(files: DataFrame) -> DataFrame:
    """(deck_id, n_pages) of (deck_id, content)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count_pages(c.as_py() or b"") for c in b.column(1)], pa.int32())], ["deck_id", "n_pages"])

    return files.select("deck_id", "content").mapInArrow(run, "deck_id string, n_pages int")


def within_limit(counts: DataFrame, most: int = M.MOST_PAGES) -> DataFrame:
    """Fail at the count, before anything is rendered, if a file has too many pages."""
    over = F.raise_error(F.concat(F.col("deck_id"), F.lit(f": more than {most} pages"))).cast("int")
    return counts.withColumn("n_pages", F.when(F.col("n_pages") > most, over).otherwise(F.col("n_pages")))


def pages(files: DataFrame, renderer=poppler, options: ImportOptions | None = None) -> DataFrame:
    """One page a rendered sheet, titled by its number."""
    from ..plans.deck import rendered_images
    from ..plans.render import tag

    o = options or ImportOptions()
    shots = rendered_images(files, renderer, o).drop("bytes")
    prefix, _, suffix = o.page_title.partition("{}")
    shots = shots.withColumn("title", F.concat(F.lit(prefix), F.col("page_no"), F.lit(suffix)))
    html = tag(f'<img src="{o.media_root}', F.col("filename"), '" alt="', X.escape("title"), '" class="img-fluid">')
    return shots.select("deck_id", F.col("page_no").alias("slide_no"), "title", html.alias("html"), F.lit(False).alias("issection"), F.create_map("filename", "filename").alias("images"))
