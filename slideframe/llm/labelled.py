"""The bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, hashed_sample

FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; a null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents, held-out ids excluded.

    The ids with the least hashes are taken. Null labels and ids are left out;
    several labels of one id are averaged, a half rounding up. The label side
    is broadcast: its size is bounded by ``rows``.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(target).cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = durable(known)
    known = durable(hashed_sample(known, ["id"], rows, known.count()))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return durable(texts.join(F.broadcast(known), "id"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last one constant) of a ridge-penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
