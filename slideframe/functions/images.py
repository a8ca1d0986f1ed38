"""Images in plain Python and numpy: PNG, bitmaps inside WMF files, blankness, scaling, outside converters.

No image library is needed for 8-bit PNG and uncompressed bitmaps. Other formats
pass through unchanged, or go to the converters that the caller names.
"""

from __future__ import annotations

import shutil
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M

# WMF records that hold a device-independent bitmap, and depths of pixels.
DIB_RECORDS = (0x0F43, 0x0B41, 0x0940, 0x0D33, 0x0F41)
DEPTHS = (1, 4, 8, 16, 24, 32)
# Fixed values of the two formats: a bitmap's header, a file's optional first and its own header, the head of a record.
HEADER = np.dtype([("size", "<u4"), ("w", "<i4"), ("h", "<i4"), ("planes", "<u2"), ("depth", "<u2"), ("rest", "V24")])
MOST_EDGE = 20000
PLACEABLE = b"\xd7\xcd\xc6\x9a" + bytes(18)
FILE_HEADER = 18
RECORD = struct.Struct("<IH")
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4, 3: 1}
Converter = Callable[[bytes, str], bytes | None]


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += n + 12


def png_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header, without decoding."""
    return struct.unpack(">II", data[16:24]) if data[:8] == SIGNATURE and data[12:16] == b"IHDR" and len(data) >= 24 else None


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels (height, width, RGBA) of an 8-bit PNG without interlacing, else None."""
    if png_size(data) is None:
        return None
    body, palette, clear, head = b"", None, None, None
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part[:13])
        elif kind == b"IDAT":
            body += part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in CHANNELS:
        return None
    n = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    except (zlib.error, ValueError):
        return None
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:], above, n)
    px = out.reshape(h, w, n)
    full = np.full((h, w, 1), 255, np.uint8)
    if colour == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette)] = palette
        return np.concatenate([table[px[:, :, 0]], alpha[px]], axis=2)
    colours = px[:, :, : 3 if n >= 3 else 1]
    return np.concatenate([np.repeat(colours, 3 // colours.shape[2], axis=2), px[:, :, -1:] if n in (2, 4) else full], axis=2)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out = bytearray(line.tobytes())
    up = above.tobytes()
    for i in range(len(out)):
        a, b, c = (out[i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode_png(px: np.ndarray) -> bytes:
    """An RGBA or RGB array as PNG."""
    h, w, n = px.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(px, np.uint8).reshape(h, w * n)], axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def is_blank(data: bytes) -> bool:
    """Whether all pixels are clear or near white; large and unreadable images count as not blank."""
    size = png_size(data)
    if size is None or size[0] * size[1] > M.BLANK_PIXELS or (px := decode_png(data)) is None:
        return False
    alpha = 127 - (px[:, :, 3] >> 1).astype(int)  # 0 is opaque, 127 clear
    return bool(((alpha >= M.BLANK_ALPHA) | (px[:, :, :3] >= M.BLANK_LEVEL).all(axis=2)).all())


def downscale(data: bytes, most: int) -> bytes:
    """A PNG whose longest edge is at most ``most``; anything else, and smaller ones, unchanged."""
    size = png_size(data)
    if size is None or max(size) <= most or (px := decode_png(data)) is None:
        return data
    w, h = size
    scale = most / max(w, h)
    rows, cols = (np.minimum(((np.arange(max(1, int(n * scale + 0.5))) + 0.5) / scale).astype(int), n - 1) for n in (h, w))
    return encode_png(px[rows][:, cols])


def find_bitmap(record: bytes) -> bytes | None:
    """A bitmap within a record, from its header on: the first of the overlapping headers at even offsets that is sound."""
    n = (len(record) - HEADER.itemsize) // 2 + 1
    if n < 1:
        return None
    headers = np.ndarray(n, HEADER, record, strides=(2,))
    at = np.flatnonzero(headers["size"] == HEADER.itemsize)
    near = headers[at]
    edges = np.stack([near["w"], np.abs(near["h"].astype(np.int64))])
    sound = (near["planes"] == 1) & np.isin(near["depth"], DEPTHS) & ((edges > 0) & (edges <= MOST_EDGE)).all(axis=0)
    return bytes(record[2 * at[sound][0] :]) if sound.any() else None


def bitmap_pixels(dib: bytes) -> np.ndarray | None:
    """RGB pixels of an uncompressed bitmap."""
    size, w, h, _, depth, packing, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", dib)
    if packing not in (0, 3):
        return None
    colours = (used or 1 << depth) if depth <= 8 else 0
    at = size + 4 * colours + (12 if packing == 3 else 0)
    stride = (w * depth + 31) // 32 * 4
    if len(dib) < at + stride * abs(h):
        return None
    rows = np.frombuffer(dib, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    if depth <= 8:
        table = np.zeros((256, 3), np.uint8)
        table[:colours] = np.frombuffer(dib, np.uint8, 4 * colours, size).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(rows, axis=1).reshape(abs(h), -1, depth)
        px = table[(index * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :w]]
    elif depth == 16:
        v = rows[:, : 2 * w].copy().view("<u2")
        px = np.stack([(v >> s & 31).astype(int) * 255 // 31 for s in (10, 5, 0)], axis=2).astype(np.uint8)
    else:
        px = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]
    return px[::-1] if h > 0 else px


def records(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(function, parameters) of a WMF file's records, up to the first that is cut short."""
    rest = memoryview(data)[len(PLACEABLE) * data.startswith(PLACEABLE[:4]) :]
    if len(rest) < FILE_HEADER or rest[0] not in (1, 2) or rest[1]:
        return
    rest = rest[FILE_HEADER:]
    while len(rest) >= RECORD.size:
        words, function = RECORD.unpack_from(rest)
        if not RECORD.size <= 2 * words <= len(rest):
            return
        yield function, rest[RECORD.size : 2 * words]
        rest = rest[2 * words :]


def wmf_to_png(data: bytes) -> bytes | None:
    """The bitmap that makes up half of a WMF file or more, as PNG."""
    largest = max((body for function, body in records(data) if function in DIB_RECORDS), key=len, default=b"")
    if not largest or 2 * (RECORD.size + len(largest)) < len(data):
        return None
    dib = find_bitmap(largest)
    px = None if dib is None else bitmap_pixels(dib)
    return None if px is None else encode_png(px)


def command(argv: list[str], timeout: float) -> Converter:
    """A converter that runs a program; ``{in}`` and ``{out}`` in its arguments are files."""

    def run(data: bytes, ext: str) -> bytes | None:
        if shutil.which(argv[0]) is None:
            return None
        with tempfile.TemporaryDirectory() as folder:
            source, target = Path(folder, f"in.{ext}"), Path(folder, "out.png")
            source.write_bytes(data)
            try:
                subprocess.run([a.replace("{in}", str(source)).replace("{out}", str(target)) for a in argv], timeout=timeout, check=True, capture_output=True)
            except (subprocess.SubprocessError, OSError):
                return None
            return target.read_bytes() if target.exists() else None

    return run


def vector_to_png(data: bytes, ext: str, converters: Iterable[Converter] = ()) -> bytes | None:
    """A WMF or EMF image as PNG: its own bitmap first, then each converter in turn."""
    made = wmf_to_png(data) if ext == "wmf" else None
    for convert in () if made else converters:
        made = convert(data, ext)
        if made:
            break
    return made


def prepared(media: DataFrame, most: int = 1600, converters: tuple[Converter, ...] = ()) -> DataFrame:
    """(deck_id, path, bytes, ok) of media parts, ready to store.

    Vector images become PNG, large PNGs shrink; blank pictures and images that
    can't be converted are marked not ok. Audio passes unchanged.
    """
    schema = pa.schema([("deck_id", pa.string()), ("path", pa.string()), ("bytes", pa.binary()), ("ok", pa.bool_())])

    def run(batches):
        for b in batches:
            for deck, path, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ext = path.rpartition(".")[2].lower()
                if ext in ("wmf", "emf"):
                    data = vector_to_png(data, ext, converters)
                ok = bool(data) and not (ext not in M.AUDIO and is_blank(data))
                yield pa.RecordBatch.from_pylist([{"deck_id": deck, "path": path, "bytes": downscale(data, most) if ok and ext not in M.AUDIO else data, "ok": ok}], schema)

    return media.select("deck_id", "path", "bytes").mapInArrow(run, "deck_id string, path string, bytes binary, ok boolean")


def failed(media: DataFrame) -> DataFrame:
    """(deck_id, content) of the prepared media that can't be stored, for ``pages``."""
    return media.where(~F.col("ok")).select("deck_id", F.col("path").alias("content"))
