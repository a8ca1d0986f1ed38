"""Mixing documents to target domain weights by soft membership.

A classifier fitted on labelled rows gives each document a posterior over
domains. Nonnegative document rates r are then fitted by projected-gradient least
squares, so that the expected tokens of each domain, the sum of t r p over
documents, match the targets.

Scale: a rate depends on a document only through its posterior and the history
of domain residuals, a short list of small vectors. So each step is one pass that sums
as many numbers as there are domains, and rates are recomputed from the history
instead of being stored, joined or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, ensure_shared_dir

BUCKETS = 4096  # hashed byte pairs
LEAST_SAMPLE = 50  # texts of a domain
OTHER = ""


def byte_pairs(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    return np.bincount((raw[:-1] * 131 + raw[1:]) % BUCKETS, minlength=BUCKETS)


@dataclass
class Mixture:
    """Domains with their log-likelihoods, and the steps that lead to the rates."""

    domains: list[str]
    prior: np.ndarray
    weight: np.ndarray  # buckets by domains
    steps: list[np.ndarray] = field(default_factory=list)  # one direction over domains a step
    targets: np.ndarray | None = None
    reached: np.ndarray | None = None

    def posterior(self, text: str) -> np.ndarray:
        pairs = byte_pairs(text)
        n = pairs.sum()
        z = self.prior + (pairs @ self.weight) / max(1.0, np.sqrt(n))  # tempered: long texts don't become certain at once
        p = np.exp(z - z.max())
        return p / p.sum()

    def rates(self, p: np.ndarray, ridge: float) -> np.ndarray:
        r = np.ones(len(p))
        for direction in self.steps:
            r = np.maximum(0.0, r - p @ direction - ridge * (r - 1))
        return r


def _level(sizes: list[int], rows: int) -> int:
    """The most texts a domain may give so that all together give about ``rows``, and at least ``LEAST_SAMPLE``."""
    left = rows
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return max(share, LEAST_SAMPLE)
        left -= size
    return max([LEAST_SAMPLE, *sizes])


def fit_domains(docs: DataFrame, domain_col: str = "lang", text_col: str = "text", rows: int = 20_000, most: int | None = None) -> Mixture:
    """A naive Bayes classifier on about ``rows`` labelled distinct texts, dealt evenly to the labels.

    Every label is a domain, with the share of its rows as prior; a label of few
    texts gives them all, and any label up to ``LEAST_SAMPLE``. A domain takes
    32 KB of the model. Only where ``most`` is given, labels beyond the
    ``most`` commonest are joined as one. Null labels and empty texts are left
    out. Without labelled rows there is one domain.
    """
    known = docs.select(F.col(domain_col).cast("string").alias("y"), F.col(text_col).alias("t")).where("y is not null and length(t) > 1")
    known = known.withColumn("h", F.xxhash64(F.lit("sample"), "t", "y"))
    counted = known.groupBy("y").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "y").collect()  # a row a domain
    if not counted:
        return Mixture([OTHER], np.zeros(1), np.zeros((BUCKETS, 1)))
    names = [r["y"] for r in counted[:most]]
    level = _level([r["texts"] for r in counted], rows)
    wanted = level + 4 * level**0.5 + 20
    bounds = [(r["y"], int((wanted / r["texts"] - 0.5) * 2.0**64) if wanted < 0.9 * r["texts"] else (1 << 63) - 1) for r in counted]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "y string, bound long"))
    sample = durable(known.join(bounds, "y").where("h <= bound").select("y", "t").distinct())
    place = {y: i for i, y in enumerate(names)}
    k = len(names) + 1

    def count(batches):
        sums = np.zeros((k, BUCKETS))
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pairs = byte_pairs(t)
                sums[place.get(y, k - 1)] += pairs / np.sqrt(pairs.sum())
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    sums = np.zeros((k, BUCKETS))
    for (part,) in sample.repartition(8).mapInArrow(count, "sums binary").toLocalIterator():  # 8 partitions of a bounded sample
        sums += np.frombuffer(part).reshape(sums.shape)
    n = np.array([r["n"] for r in counted[: len(names)]] + [sum(r["n"] for r in counted[len(names) :])], float)
    if len(counted) == len(names):
        sums, n = sums[:-1], n[:-1]
    else:
        names.append(OTHER)
    theta = (sums + 0.01) / (sums + 0.01).sum(axis=1, keepdims=True)
    return Mixture(names, np.log(n / n.sum()), np.log(theta).T)


def _members(model: Mixture):
    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            p = [model.posterior(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["id", "tokens", "p"])

    return run


def memberships(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p) per row; a null text has no tokens."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_members(model), "id long, tokens long, p array<double>")


def _sums(members: DataFrame, model: Mixture, ridge: float, moments: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over documents of t r p, and of t p p' where wanted."""
    k = len(model.domains)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            t = b.column(0).to_numpy().astype(float)
            p = b.column(1).flatten().to_numpy().reshape(-1, k)
            first += (t * model.rates(p, ridge)) @ p
            if moments:
                second += (p * t[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], ["i", "v"])

    out = np.zeros(k + k * k)
    for i, v in members.select("tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # as many rows as sums
        out[i] = v
    return out[:k], out[k:].reshape(k, k)


def fit_rates(members: DataFrame, model: Mixture, targets: dict[str, float] | None = None, power: float = 0.7, ridge: float = 1e-3, steps: int = 40, tolerance: float = 1e-5) -> Mixture:
    """Add the steps that lead from rates of one to rates that match the targets.

    ``targets`` are weights of domains and keep the number of tokens; domains
    left out get none. It is an error to name one that isn't modelled, or to
    leave out the joined one. Without targets weights are the token shares to
    the ``power``, and the number of tokens grows until no domain loses any, so
    that no document need go.
    Residuals are weighed by the inverse of their moments, which makes
    the step one; the ridge draws rates to one.
    """
    totals, moments = _sums(members, model, ridge, True)
    tokens = totals.sum()
    if tokens <= 0:
        return model
    if targets is None:
        goal = totals**power
        goal = goal * np.max((totals / goal)[totals > 0])
    else:
        lost = sorted({*targets, *({OTHER} & {*model.domains})} - ({*model.domains} & {*targets}))
        if lost:
            raise ValueError(f"targets and modelled domains differ in {lost}; the domains are {sorted(model.domains)}")
        goal = np.array([targets.get(d, 0.0) for d in model.domains])
        goal = goal / goal.sum() * tokens
    model.targets = goal
    inverse = np.linalg.pinv(moments / tokens + 1e-9 * np.eye(len(goal)))
    now = totals
    for _ in range(steps):
        if np.abs(now - goal).max() <= tolerance * tokens:
            break
        model.steps.append(inverse @ ((now - goal) / tokens))
        now, _ = _sums(members, model, ridge, False)
    model.reached = now
    return model


def fit(docs: DataFrame, domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[Mixture, DataFrame]:
    """The fitted mixture and the stored memberships of ``docs``."""
    ensure_shared_dir(docs.sparkSession)
    model = fit_domains(docs, domain_col, text_col)
    members = durable(memberships(docs, model, id_col, text_col))
    return fit_rates(members, model, **options), members


def rated(members: DataFrame, model: Mixture, ridge: float = 1e-3) -> DataFrame:
    """(id, tokens, domain, posterior, rate) per row of ``members``: its likeliest domain and its rate."""

    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy().reshape(-1, len(model.domains))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tokens"), pa.array([model.domains[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(model.rates(p, ridge))], ["id", "tokens", "domain", "posterior", "rate"])

    return members.mapInArrow(run, "id long, tokens long, domain string, posterior double, rate double")


def mixed(docs: DataFrame, model: Mixture, text_col: str = "text", ridge: float = 1e-3) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with columns ``rate`` and ``copy_no``.

    A rate's fraction becomes one more copy by a fixed hash of the text, so
    that repeated runs agree. Columns of ``docs`` of those names are replaced.
    """
    docs = docs.drop("rate", "copy_no")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            p = np.array([model.posterior(t or "") for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(model.domains))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.rates(p, ridge))], [*b.schema.names, "rate"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("rate", T.DoubleType())]))
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col(text_col)), F.lit(1 << 20)) / (1 << 20)
    copies = F.floor(F.round("rate", 3) + chance).cast("int")  # a rate of one within rounding is one
    return out.withColumn("copy_no", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
