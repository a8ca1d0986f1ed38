"""Personal data: patterns propose spans, checksums confirm them, context adjusts their score.

A map-only operator: each text is judged by itself, so nothing is shuffled and
the work grows with the text. Every scan is linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds first; spans that start together are in this order.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE_KINDS = KINDS[:4]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
# the look-behind spares a second scan of a long digit run; a match can't begin inside one
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

# IBAN lengths by country code.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}
# Words that make a kind likelier nearby, and words that speak against any.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "part")
#: Score of a kind by its pattern alone, and what a passed checksum adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "tel": 0.3}
CHECKED = {"card": 0.3, "iban": 0.5}
NEAR, CONTEXT_GAIN, AGAINST_LOSS, LEAST = 40, 0.3, 0.3, 0.5
_WORD = re.compile(r"[\w-]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the run of its characters before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            lo = at
            while lo > done:  # back over the run, in growing steps
                step = max(done, lo - max(64, at - lo))
                run = _LOCAL.match(text[step:lo][::-1]).end()
                lo -= run
                if lo > step:
                    break
            if lo < at:
                yield lo, m.end()
                done = m.end()
        at = text.find("@", max(done, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 11:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _more(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Proposals of the further kinds: (start, kind, end, checksum passed)."""
    done = 0
    while m := _IBAN.search(text, done):
        length, at = IBAN_LENGTHS.get(m.group()[:2]), m.start()
        done = at + 4  # no other can begin in the country and check digits of one that fails
        plain = m.group().replace(" ", "")
        if length and len(plain) >= length and mod97(plain[:length]):
            end, left = at, length
            while left:
                left -= text[end] != " "
                end += 1
            if not (text[end : end + 1].isalnum()):
                yield at, 4, end, True
                done = end
    for kind, pattern in ((5, _SSN), (6, _TEL)):
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end(), False


def _score(text: str, kind: int, start: int, end: int, checked: bool) -> float:
    name = KINDS[kind]
    around = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start])} | {w.lower() for w in _WORD.findall(text[end : end + NEAR])}
    score = PRIOR[name] + CHECKED.get(name, 0.0) * checked
    score += CONTEXT_GAIN * (not around.isdisjoint(CONTEXT[name])) - AGAINST_LOSS * (not around.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, score)), 4)


def find_spans(text: str) -> list[Span]:
    """All spans, by start and kind. Base spans stay whatever their score; others need ``LEAST`` and no overlap."""
    base = base_spans(text)
    out = [Span(a, k, b, _score(text, k, a, b, k == 2)) for a, k, b in base]
    if not re.search("[0-9]", text):
        return out
    for a, k, b, checked in _more(text):
        score = _score(text, k, a, b, checked)
        if score >= LEAST and all(b <= s.start or a >= s.end for s in out):
            out.append(Span(a, k, b, score))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes its first kind in brackets."""
    out, done = [], 0
    for a, k, b, _ in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_DETAIL = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _detect(batches):
    for batch in batches:
        found = [find_spans(t or "") for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s.kind == k for s in f) for f in found], pa.int64()) for k in range(4)]
        base = pa.array([joined([s for s in f if s.kind < 4]) for f in found], pa.string())
        detail = pa.array([[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "score": s.score} for s in f] for f in found], _DETAIL)
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array([joined(f) for f in found], pa.string()), detail], ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "found"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, base and all spans as text, and all spans with scores.

    Offsets count code points, ends are exclusive. A null text counts as
    empty. Repeated rows and null ids give a row each. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_detect, "id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, found array<struct<kind:string,start:int,end:int,score:double>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, with spans replaced in the text; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t if t is None else redact(t, find_spans(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
