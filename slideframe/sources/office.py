"""Rendering decks by outside programs: font substitution, size limits, availability."""

from __future__ import annotations

import hashlib
import io
import os
import re
import shutil
import socket
import subprocess
import tempfile
import threading
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from .. import model as M
from . import pdf
from .package import TooLarge

CONVERT_TIMEOUT, PROBE_TIMEOUT = 120, 10
_LATIN = re.compile(rb'(<[A-Za-z0-9]+:latin\b[^>]*?\btypeface=")[^"]*(")')


def check_sizes(content: bytes, part_limit: int = M.PART_BYTES, total_limit: int = M.PACKAGE_BYTES) -> None:
    """Fail if a package declares more than it may inflate to."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sizes = [i.file_size for i in z.infolist()]
    if max(sizes, default=0) > part_limit or sum(sizes) > total_limit:
        raise TooLarge("package")


def with_render_font(content: bytes, font: str) -> bytes:
    """A deck with every latin typeface of its parts set to an allowed font; other names change nothing."""
    if font not in M.RENDER_FONTS:
        return content
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = old.read(info)
            if info.filename.startswith("ppt/") and info.filename.endswith(".xml") and b"latin" in data:
                data = _LATIN.sub(lambda m: m.group(1) + font.encode() + m.group(2), data)
            new.writestr(info.filename, data)
    return out.getvalue()


def libreoffice(content: bytes, max_dim: int = 0, font: str = "") -> Iterator[tuple[int, str, bytes]]:
    """Pages of a deck as pictures, by way of PDF, in a profile of their own."""
    if shutil.which("soffice") is None:
        raise RuntimeError("soffice isn't installed")
    check_sizes(content)
    content = with_render_font(content, font)
    check_sizes(content)
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "in.pptx").write_bytes(content)
        command = ["soffice", f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", folder, f"{folder}/in.pptx"]
        subprocess.run(command, timeout=CONVERT_TIMEOUT, check=True, capture_output=True)
        yield from pdf.poppler(Path(folder, "in.pdf").read_bytes(), max_dim, font)


def runs(command: list[str], expected: str, timeout: float = PROBE_TIMEOUT) -> bool:
    """Whether a program starts and names itself."""
    try:
        done = subprocess.run(command, timeout=timeout, capture_output=True, text=True)
    except (OSError, subprocess.SubprocessError):
        return False
    return expected.lower() in (done.stdout + done.stderr).lower()


class Availability:
    """A probe's answer, kept for a time; of callers at once only one probes."""

    def __init__(self, probe: Callable[[], bool], ttl: float = M.PROBE_TTL_S, clock: Callable[[], float] = time.monotonic):
        self.probe, self.ttl, self.clock = probe, ttl, clock
        self.lock, self.kept = threading.Lock(), {}

    @staticmethod
    def key() -> str:
        """Differs by host and search path."""
        return hashlib.md5("|".join((socket.gethostname(), os.environ.get("PATH", ""))).encode()).hexdigest()[:12]

    def _fresh(self) -> bool | None:
        at, answer = self.kept.get(self.key(), (None, None))
        return answer if at is not None and self.clock() - at < self.ttl else None

    def __call__(self) -> bool:
        if (answer := self._fresh()) is None:
            with self.lock:
                if (answer := self._fresh()) is None:
                    answer = self.probe()
                    self.kept[self.key()] = (self.clock(), answer)
        return answer


rendering = Availability(lambda: runs(["soffice", "--version"], "LibreOffice") and shutil.which("pdftoppm") is not None)
