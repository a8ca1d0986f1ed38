"""Toxic passages: maximum-scoring segments of word log-odds.

A word's log-odds of toxic against other documents is estimated along its
prefixes: each longer prefix, and then the whole word, shrinks to the
estimate of the shorter one by a Dirichlet prior. A linear-time scan
(Ruzzo and Tompa) finds every maximal scoring segment of a text. With
the Karlin-Altschul parameters of the clean documents a segment's score has an
extreme-value significance; a document's significances are
aggregated and mapped to a probability.

Scale: counts come from a bounded labelled sample and are kept in ``CELLS``
cells by the units' hashes, so every unit counts and the model's size is fixed.
What is brought to the driver is that table and a few numbers a labelled
row. Scoring is a map over all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ensure_shared_dir
from .labelled import labelled_sample, logistic

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
DRIFT, LEAST, MOST = 1.5, -3.0, 6.0
PRIOR = 10.0
EULER = 0.5772156649
SIGNIFICANT = 0.05
CELLS = 1 << 22  # of the table of counts, 8 bytes each; units that share a cell share its counts
SEEN_WORDS = 100_000  # words whose score a worker remembers
CHUNK = 1 << 18  # cells of documents that are summed together


def units(word: str) -> Iterator[str]:
    """The prefixes of a word, shortest first, then the word itself, marked."""
    size = len(word)
    for k in PREFIXES:
        if size <= k:
            break
        yield word[:k]
    yield "=" + word


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score), in linear time.

    Each candidate keeps the index of the nearest earlier one whose sum before
    it is smaller, so a search jumps from one to the next: a link that is
    jumped over lies behind the new candidate's own link and isn't met again.
    """
    total = np.concatenate([[0.0], np.cumsum(values)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, link
    at = np.flatnonzero(values > 0)
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        lo, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            lo, _, left, _, link = found[j]
            del found[j:]
            j = link
        found.append((lo, i + 1, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def cell(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(unit) & (CELLS - 1)


@dataclass
class Model:
    """Counts by cell, and the parameters that turn segment scores into a probability."""

    base: float
    n: np.ndarray  # documents by cell
    y: np.ndarray  # of them, those of label 1
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)

    def __getstate__(self) -> dict:
        """Mostly zeros, the table travels and is stored packed."""
        return self.__dict__ | {c: zlib.compress(getattr(self, c).tobytes(), 1) for c in ("n", "y")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {c: np.frombuffer(zlib.decompress(state[c]), np.int32) for c in ("n", "y")}

    def word_score(self) -> Callable[[str], float]:
        """A function from a word to its score: the rate of label 1 along its units, as log-odds against the base, less a drift.

        Documents with a unit also have the units before it, so behind the first one without documents nothing is left to read.
        """
        seen_in, toxic_in = memoryview(self.n), memoryview(self.y)
        start, odds = self.base, math.log(self.base / (1 - self.base)) + DRIFT

        def score(word: str) -> float:
            rate = start
            for u in units(word.lower()):
                at = cell(u)
                n = seen_in[at]
                if not n:
                    break
                rate = (toxic_in[at] + PRIOR * rate) / (n + PRIOR)
            return min(MOST, max(LEAST, math.log(rate / (1 - rate)) - odds))

        return score

    def reader(self) -> Callable[[str], np.ndarray]:
        """A function from a text to its words' scores; it remembers words, within a bound."""
        score = lru_cache(SEEN_WORDS)(self.word_score())
        return lambda text: np.fromiter(map(score, _WORD.findall(text)), float)

    def significance(self, score: float, n: int) -> float:
        """Normalised score of a segment among n words: minus the log of the expected number by chance."""
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def features(self, found: list[tuple[int, int, float]], n: int) -> list[float]:
        """Aggregates of a document's segments and their significances."""
        sums = sorted((s for _, _, s in found), reverse=True)
        x = [self.significance(s, n) for s in sums]
        top = min(x[0], 40.0) if x else -10.0
        return [top, math.log1p(sum(max(v, 0.0) for v in x)), math.log1p(sum(sums[:5])), math.log1p(sum(sums)) - 0.5 * math.log1p(n)]

    def probability(self, features: np.ndarray) -> np.ndarray:
        w = np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))


def _count(batches):
    """(cell, n, y) sums; a document counts once in a cell."""
    for b in batches:
        held, labels, size = [], [], 0
        for i, (text, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), 1):
            seen = {cell(u) for w in {w.lower() for w in _WORD.findall(text)} for u in units(w)}
            held.append(np.fromiter(seen, np.int32, len(seen)))
            labels.append(np.full(len(seen), label))
            size += len(seen)
            if size >= CHUNK or i == b.num_rows:
                at, back = np.unique(np.concatenate(held), return_inverse=True)
                n, y = np.bincount(back, minlength=len(at)), np.bincount(back, np.concatenate(labels), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64)), pa.array(y.astype(np.int64))], ["cell", "n", "y"])
                held, labels, size = [], [], 0


GRID = 1000  # scores are counted in steps of a thousandth


def null_lambda(histogram: np.ndarray) -> float:
    """Karlin-Altschul lambda of word scores given by their counts: the root of E exp(lambda s) = 1 beside zero."""
    value = np.arange(len(histogram)) / GRID + LEAST
    share = histogram / max(1, histogram.sum())
    if not histogram[value > 0].any() or share @ value >= 0:
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if share @ np.exp(mid * value) < 1 else (lo, mid)
    return min(max(hi, 0.05), 5.0)


def _best_scores(shared):
    """(y, n, best, histogram) per row: words, best segment; a batch's first row counts the scores of its rows of label 0."""

    def run(batches):
        read = shared.value.reader()
        for b in batches:
            y = b.column(1).to_pylist()
            n, best, histogram = [], [], np.zeros(int((MOST - LEAST) * GRID) + 1, np.int64)
            for v, label in zip(map(read, b.column(0).to_pylist()), y, strict=True):
                n.append(len(v))
                best.append(max((s for _, _, s in segments(v)), default=0.0))
                if not label:
                    histogram += np.bincount(np.rint((v - LEAST) * GRID).astype(np.int64), minlength=len(histogram))
            first = [histogram.tobytes()] + [None] * (b.num_rows - 1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(first, pa.binary())], ["y", "n", "best", "histogram"])

    return run


def _sample_features(shared):
    def run(batches):
        model = shared.value
        read = model.reader()
        for b in batches:
            x = [model.features(segments(v), len(v)) for v in map(read, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``rows`` labelled rows; three quarters give counts, the rest calibrates.

    Null labels and rows that are held out or have no label aren't used; a null
    text counts as empty. Without labelled rows of both kinds every text
    scores the share of label 1.
    """
    ensure_shared_dir(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast
    sample = labelled_sample(docs, labels, target, rows, id_col, text_col)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0
    size = sample.where(~part).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    base = (size["y"] + 0.5) / (size["n"] + 1)
    counts = sample.where(~part).select("text", "y").mapInArrow(_count, "cell int, n long, y long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    table = counts.toArrow()  # at most CELLS rows
    model = Model(base, np.zeros(CELLS, np.int32), np.zeros(CELLS, np.int32))
    at = table["cell"].to_numpy()
    model.n[at], model.y[at] = table["n"].to_numpy(), table["y"].to_numpy()
    rest = sample.where(part).select("text", "y")
    best = rest.mapInArrow(_best_scores(send(model)), "y int, n long, best double, histogram binary").toArrow().to_pydict()
    y = np.array(best["y"], float)
    if not len(y) or y.min() == y.max():
        model.weights = (0.0, 0.0, 0.0, 0.0, math.log(base / (1 - base)))
        return model
    model.lam = null_lambda(sum(np.frombuffer(h, np.int64) for h in best["histogram"] if h is not None))
    clean = [model.lam * s - math.log(n) for s, n, label in zip(best["best"], best["n"], best["y"], strict=True) if n and not label]
    model.log_k = float(np.mean(clean)) - EULER if clean else 0.0
    found = rest.mapInArrow(_sample_features(send(model)), "y int, x array<double>").toArrow().to_pydict()
    model.weights = tuple(float(w) for w in logistic(np.array(found["x"]), np.array(found["y"], float)))
    return model


_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))


def _score(shared):
    def run(batches):
        model = shared.value
        read = model.reader()
        for b in batches:
            score, passages = [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for text, values in zip(texts, map(read, texts), strict=True):
                found = segments(values)
                score.append(model.features(found, len(values)))
                mine = []
                for lo, hi, s in found:
                    p = -math.expm1(-math.exp(min(50.0, -model.significance(s, len(values)))))
                    if p <= SIGNIFICANT:
                        mine.append((lo, hi, s, p))
                if mine:
                    at = [m.span() for m in _WORD.finditer(text)]
                    mine = [{"start": at[lo][0], "end": at[hi - 1][1], "score": s, "p_value": p} for lo, hi, s, p in mine]
                passages.append(mine)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(np.array(score).reshape(len(score), 4))), pa.array(passages, _PASSAGES)], ["id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) per row: the probability of label 1, and every significant segment.

    Passages are ranges of code points of the text, ends exclusive, in order.
    A null text counts as empty, a text of any length is scanned whole, in linear time; empty texts score the model's value for no words. Repeated rows and
    null ids give a row each. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), "id long, score double, passages array<struct<start:int,end:int,score:double,p_value:double>>")
