"""Quality scores: ridge regression on random Fourier features of document statistics.

Random Fourier features approximate a Gaussian kernel over about twenty
statistics of a text. Partitions sum the normal equations of a bounded
labelled sample by fold; the driver solves them. Predictions for the folds
left out are made into probabilities by isotonic regression. Scoring is a map
over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, ensure_shared_dir
from .labelled import labelled_sample

# Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as was at by an be from are this or not "
    "le la les de des du et en un une que est pour dans qui sur pas au ne se "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las del y que se por un una con no su para es al lo como más o".split()
)
LETTER, UPPER, DIGIT, SPACE, LINE, MARK, SYMBOL, HIGH = range(8)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = LETTER, UPPER, DIGIT, HIGH
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = SPACE, LINE, MARK


def statistics(text: str) -> list[float]:
    """Statistics of a text's form; an empty text has defined values."""
    raw = text.encode()
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    known = sum(c for w, c in counts.items() if w.lower() in FUNCTION_WORDS)
    same = sum(map(str.__eq__, words, words[1:]))
    line_sizes = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    return [
        np.log1p(len(words)), sizes.mean(), sizes.std(), len(counts) / n, max(counts.values(), default=0) / n,
        known / n, same / n, share[UPPER], share[DIGIT], share[MARK], share[SYMBOL], share[HIGH], np.sqrt(share[SYMBOL]), np.sqrt(same / n), np.sqrt(share[UPPER]),
        len(set(lines)) / m, np.log1p(line_sizes.mean()), np.log1p(len(lines)), sum(x.isupper() for x in counts) / max(1, len(counts)), text.count("!") / n, text.count("|") / n,
    ]


SIZE = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        return np.column_stack([f, 0.1 * z, np.ones(len(z))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a small share of the raw value keeps it strictly increasing."""
        raw = self.features(x) @ self.beta
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 / (1 + np.exp(-np.clip(8 * (raw - 0.5), -30, 30))), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the least-squares increasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of x, weight
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, a, 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def _statistics(batches):
    for b in batches:
        x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, SIZE)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, SIZE)


def _normal_equations(model: Model, folds: int):
    """One row per fold and partition: the sums of z z' and of z y."""

    def run(batches):
        total = None
        for b in batches:
            z, y, fold = model.features(_rows(b)), b.column("y").to_numpy().astype(float), b.column("fold").to_numpy()
            d = z.shape[1]
            total = np.zeros((folds, d, d + 1)) if total is None else total
            for f in range(folds):
                own = z[fold == f]
                total[f] += own.T @ np.column_stack([own, y[fold == f]])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["fold", "sums"])

    return run


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = 20_000, features: int = 300, width: float = 0.25, ridge: float = 0.3, folds: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``rows`` labelled rows. Without any, every text scores about one half."""
    ensure_shared_dir(docs.sparkSession)
    sample = labelled_sample(docs, labels, target, rows, id_col, text_col)
    x = durable(sample.select("id", "text", "y").mapInArrow(_statistics, "id long, y int, x array<double>").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(folds)).cast("int")))
    r = np.random.default_rng(seed)
    moments = x.select(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(SIZE)]).first()
    mean, scale = (np.array([v or 0.0 for v in part], float) for part in (moments[:SIZE], moments[SIZE:]))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), r.normal(size=(SIZE, features)) * width, r.uniform(0, 2 * np.pi, features), np.zeros(features + SIZE + 1), np.array([0.0]), np.array([0.5]))
    sums = np.zeros((folds, features + SIZE + 1, features + SIZE + 2))
    for fold, part in x.repartition(8).mapInArrow(_normal_equations(model, folds), "fold int, sums binary").toLocalIterator():  # 8 partitions of a bounded sample
        sums[fold] += np.frombuffer(part).reshape(sums.shape[1:])
    if sums[:, -1, -2].sum() == 0:
        return model

    def solve(s):
        return np.linalg.solve(s[:, :-1] + ridge * np.eye(len(s)), s[:, -1])

    betas = np.array([solve(sums.sum(axis=0) - sums[f]) for f in range(folds)])

    def left_out(batches):
        for b in batches:
            z = model.features(_rows(b))
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", z, betas[b.column("fold").to_numpy()])), b.column("y")], ["raw", "y"])

    pairs = x.mapInArrow(left_out, "raw double, y int").orderBy("raw", "y").toArrow()  # at most ``rows`` rows
    model.knots, model.values = isotonic(pairs["raw"].to_numpy(), pairs["y"].to_numpy().astype(float))
    model.beta = solve(sums.sum(axis=0))
    return model


def _score(shared):
    def run(batches):
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(1).to_pylist()]).reshape(b.num_rows, SIZE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row. A null text counts as empty; repeated rows and null ids give a row each.

    Other columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), "id long, score double")


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` with one more column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(at).to_pylist()]).reshape(b.num_rows, SIZE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x))], [*b.schema.names, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)
