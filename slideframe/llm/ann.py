"""Approximate nearest neighbours with a permutation index.

Each vector is represented by its nearest pivots in order. It is posted in the
inverted files of its first ``POSTED`` pivots; a query is sent to the files of its
own first pivots only. There the footrule distance between the orders of entry and query
is taken, on the first ``ORDERED`` pivots, and vectors near enough are
reranked by exact inner product. How many files a query reads and how far footrule may
go is fitted on a bounded sample of vectors, whose true neighbours are known.

Scale: small files are packed into bins of at most ``SHARD_ROWS`` rows and large ones
split, so a row travels at most ``POSTED`` times and a query once a bin that holds one of its
files, whatever the number of rows; the number of pivots grows with the rows
up to ``MOST_PIVOTS``. Equal vectors are searched once, and of those that share a
vector only as many ids are carried as an answer can hold. There is no cap on
candidates. Queries that find too few meet all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, ensure_shared_dir, hashed_sample, spread_join

PIVOTS, MOST_PIVOTS, ROWS_PER_PIVOT = 256, 32_000, 4096  # at least, at most, and one for so many rows between
ORDERED = 256  # pivots whose order is compared
PREFIX = 128  # places of an order that count, and files that a query may read
POSTED = 4  # nearest pivots in whose files it is posted
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 256  # what the search is fitted on
FILES_RECALL, REACH_RECALL = 0.98, 0.94  # share of the sample's true neighbours that files and footrule bound keep
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384

KEY = ("k", "h")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, v in doubles."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """(k, h, v, ids) per different vector: a key, and the ``top`` + 1 least ids of its rows, which is all that an answer can hold."""
    least = W.partitionBy("v").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= top + 1)
    ids = F.array_sort(F.collect_list("id")).alias("ids")
    return kept.groupBy("v").agg(ids).select(F.col("ids")[0].alias("k"), F.xxhash64("v").alias("h"), "v", "ids")


def products(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Inner products with pivots; of unequal lengths, the shorter counts as padded with zeros."""
    d = min(x.shape[1], pivots.shape[1])
    return x[:, :d] @ pivots[:, :d].T


def files(prod: np.ndarray, most: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, by the products with all."""
    return np.argsort(-prod, axis=1, kind="stable")[:, :most].astype(np.int16)


def orders(prod: np.ndarray, prefix: int) -> np.ndarray:
    """The order of the first pivots as a weight a pivot: prefix for the nearest, one less for the next, zero beyond the prefix.

    A multiple of eight weights a row, so that rows are read as words of eight bytes.
    """
    own = prod[:, :ORDERED]
    place = np.argsort(-own, axis=1, kind="stable")[:, :prefix]
    out = np.zeros((len(own), -(-own.shape[1] // 8) * 8), np.uint8)
    np.put_along_axis(out, place, np.arange(prefix, prefix - place.shape[1], -1, dtype=np.uint8)[None].repeat(len(own), 0), 1)
    return out


LOW = np.uint64(0x00FF00FF00FF00FF)


def gains(weights: np.ndarray, own: np.ndarray, block: int = 4096) -> np.ndarray:
    """How far the footrule distance of rows to a query's order lies below the largest one, halved.

    A pivot that both orders hold, at places a and b (from 1), brings it down by
    prefix + 1 - max(a, b), the lesser of its weights. Bytes are added up in four
    sums of 16 bits at once; 256 pivots of weight 128 at most can't overflow them.
    """
    out = np.empty(len(weights), np.int64)
    for lo in range(0, len(weights), block):
        x = np.minimum(weights[lo : lo + block], own).view(np.uint64)
        total = ((x & LOW) + ((x >> np.uint64(8)) & LOW)).sum(axis=1)
        out[lo : lo + block] = total.view(np.uint16).reshape(-1, 4).sum(axis=1, dtype=np.int64)
    return out


@dataclass
class Index:
    """What is fitted: pivots, how many of a query's files are read, and the least gain of a candidate."""

    pivots: np.ndarray
    prefix: int
    asked: int  # files that a query may read; it reads all where ``probes`` is more
    probes: int
    least: int


def fit(vectors: DataFrame, top: int, pivots: int = PIVOTS, prefix: int = PREFIX, files_recall: float = FILES_RECALL, reach_recall: float = REACH_RECALL) -> Index | None:
    """Fit on a bounded sample of (k, v): at least ``pivots`` pivots, and the bounds that keep the given shares of its true neighbours.

    Neighbours within the sample are no nearer than within all rows, so what
    is met there is met or exceeded on the whole. None without vectors.
    """
    n = vectors.count()
    pivots = min(MOST_PIVOTS, max(pivots, n // ROWS_PER_PIVOT))
    rows = [r["v"] for r in hashed_sample(vectors, list(KEY), max(SAMPLE_ROWS, pivots), n).select("v").collect()]
    if not rows:
        return None
    chosen = np.zeros((min(pivots, len(rows)), max(map(len, rows[:pivots]))))
    for i, v in enumerate(rows[: len(chosen)]):
        chosen[i, : len(v)] = v
    prefix, asked = min(prefix, len(chosen)), min(PREFIX, len(chosen))
    size = max({len(v) for v in rows}, key=lambda d: (sum(len(v) == d for v in rows), d))
    x = np.array([v for v in rows[:SAMPLE_ROWS] if len(v) == size])
    prod = products(x, chosen)
    near, weights = files(prod, asked), orders(prod, prefix)
    ranks, found = [], []
    for q in range(max(0, len(x) - SAMPLE_QUERIES), len(x)):  # from the end: the first rows are pivots, whose orders aren't typical
        score = x @ x[q]
        score[q] = -np.inf
        true = np.argsort(-score)[: min(top, len(x) - 1)]
        place = np.full(len(chosen), asked + 1)
        place[near[q]] = np.arange(1, asked + 1)
        ranks.append(place[near[true, :POSTED]].min(axis=1))
        found.append(gains(weights[true], weights[q]))
    ranks, found = np.sort(np.concatenate(ranks)), np.sort(np.concatenate(found))
    probes = asked + 1 if files_recall >= 1 or not len(ranks) else int(ranks[math.ceil(files_recall * len(ranks)) - 1])
    least = 0 if reach_recall >= 1 or not len(found) else int(found[int((1 - reach_recall) * len(found))])
    return Index(chosen, prefix, asked, probes, least)


def build(vectors: DataFrame, index: Index) -> DataFrame:
    """(k, h, v, ids, files, weights): every vector with its nearest pivots and its order."""

    def run(batches):
        for b in batches:
            v = b.column("v")
            size, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
            ends = np.cumsum(size)
            near, weights = np.empty((b.num_rows, index.asked), np.int16), [b""] * b.num_rows
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                prod = products(flat[(ends[own] - d)[:, None] + np.arange(d)], index.pivots)
                near[own] = files(prod, index.asked)
                for i, w in zip(own.tolist(), orders(prod, index.prefix), strict=True):
                    weights[i] = w.tobytes()
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, index.asked, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(weights, pa.binary())], [*b.schema.names, "files", "weights"])

    return vectors.mapInArrow(run, "k long, h long, v array<double>, ids array<long>, files array<smallint>, weights binary")


def bins_of_files(counts: dict[int, int], pivots: np.ndarray, shard_rows: int) -> tuple[list[int], list[int], int]:
    """(first bin, number of bins) of each file, and all bins: files of near pivots are packed together, large ones split."""
    first, n, at, load = [0] * len(pivots), [1] * len(pivots), 0, 0
    near = np.lexsort(((pivots @ pivots[0]), np.argmax(pivots @ pivots[: min(64, len(pivots))].T, axis=1)))
    for p in near.tolist():
        rows = counts.get(p, 0)
        if load and load + rows > shard_rows:
            at, load = at + 1, 0
        first[p], n[p] = at, max(1, -(-rows // shard_rows))
        load += rows
        if n[p] > 1:
            at, load = at + n[p], 0
    return first, n, at + (load > 0)


def _cell(index: Index, first: np.ndarray, n: np.ndarray, top: int, everything: bool):
    """Search one cell: rows with kind 0 are posted vectors, with kind 1 queries."""

    def search(own_bin, x, posted, weights, ids, q, q_files, q_weights, emit):
        if index.probes > index.asked:  # all files are read: the one of a row's nearest pivot answers
            posted = posted[:, :1]
        elsewhere = ~((first[posted] <= own_bin) & (own_bin < first[posted] + n[posted]))
        columns = [(c.astype(np.intp), e.astype(np.int32)) for c, e in zip(posted.T, elsewhere.T, strict=True)]
        for i in range(len(q)):
            if everything:
                near = np.arange(len(x))
            else:  # of the bins that hold a row, the one of its first file that the query reads answers
                place = np.full(len(index.pivots), 2 * (index.asked + 1), np.int32)
                place[q_files[i]] = np.arange(2, 2 * index.asked + 1, 2)
                meet = np.minimum.reduce([place[c] + e for c, e in columns])
                near = np.flatnonzero((meet <= 2 * index.probes) & (meet % 2 == 0))
                near = near[gains(weights[near], q_weights[i]) >= index.least]
            if not len(near):
                continue
            rough = x[near] @ q[i]
            if len(near) > top + 1:  # rounding of the rough product is far below the slack
                edge = np.partition(rough, len(near) - top - 1)[len(near) - top - 1]
                near = near[rough >= edge - 1e-9 * (np.abs(rough).max() + 1)]
            exact = np.zeros(len(near))
            for d in range(x.shape[1]):  # in order of components, so that equal vectors score equally everywhere
                exact += q[i, d] * x[near, d]
            entries = sorted((-s, c) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for c in ids[j])[: top + 1]
            emit(i, entries)

    def run(t: pa.Table) -> pa.Table:
        own_bin = t["bin"][0].as_py()
        kind = t["kind"].to_numpy()
        v = t["v"].combine_chunks()
        size, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
        ends = np.cumsum(size)
        near = t["files"].combine_chunks()
        near_size, near = near.value_lengths().to_numpy(), near.flatten().to_numpy()
        near_ends = np.cumsum(near_size)
        weights = np.frombuffer(b"".join(t["weights"].to_pylist()), np.uint8).reshape(len(kind), -1)
        k, h = t["k"].to_numpy(), t["h"].to_numpy()
        out = {"k": [], "h": [], "id": [], "score": []}
        for d in np.unique(size[kind == 1]):  # vectors of each length are a space of their own
            rows, asks = (np.flatnonzero((kind == c) & (size == d)) for c in (0, 1))
            take = lambda at: flat[(ends[at] - d)[:, None] + np.arange(d)]  # noqa: B023, E731

            def emit(i, entries, asks=asks):
                out["k"] += [k[asks[i]]] * len(entries)
                out["h"] += [h[asks[i]]] * len(entries)
                out["score"] += [-s for s, _ in entries]
                out["id"] += [c for _, c in entries]

            if len(rows) and len(asks):
                posted, asked = (near[(near_ends[at] - w)[:, None] + np.arange(w)] for at, w in ((rows, near_size[rows[0]]), (asks, near_size[asks[0]])))
                search(own_bin, take(rows), posted, weights[rows], t["ids"].take(pa.array(rows)).to_pylist(), take(asks), asked, weights[asks], emit)
        return pa.table({"k": pa.array(out["k"], pa.int64()), "h": pa.array(out["h"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def _search(index: Index, rows: DataFrame, queries: DataFrame, top: int, shard_rows: int, query_rows: int, everything: bool) -> DataFrame:
    """(k, h, id, score): each query vector's ``top`` + 1 best entries, its own among them."""
    total = len(index.pivots)
    if everything:
        bins = max(1, -(-rows.count() // shard_rows))
        first, n = np.zeros(total, np.int64), np.ones(total, np.int64)
        posted = F.array(F.pmod(F.xxhash64(F.lit("bin"), *KEY), F.lit(bins)).cast("int"))
        asked = F.sequence(F.lit(0), F.lit(bins - 1))
    else:
        sizes = rows.select(F.explode(F.slice("files", 1, POSTED)).alias("p")).groupBy("p").count().collect()  # a row a pivot at most
        first, n, bins = bins_of_files({r["p"]: r["count"] for r in sizes}, index.pivots, shard_rows)
        first, n = np.array(first), np.array(n)

        def own(p: Column, shard: Column | None = None) -> Column:
            lo, many = (F.element_at(F.lit(a.astype(np.int32)), p.cast("int") + 1) for a in (first, n))
            return lo + F.pmod(shard, many).cast("int") if shard is not None else F.sequence(lo, lo + many - 1)

        posted = F.array_distinct(F.transform(F.slice("files", 1, POSTED), lambda p: own(p, F.xxhash64(F.lit("bin"), *KEY))))
        asked = F.array_distinct(F.flatten(F.transform(F.slice("files", 1, index.probes), lambda p: own(p)))) if index.probes <= index.asked else F.sequence(F.lit(0), F.lit(max(0, bins - 1)))
    asks = queries.withColumn("ids", F.array().cast("array<long>")).select("*", F.explode(asked).alias("bin"), F.lit(1).alias("kind"))
    # a bin with many queries is searched in parts: at most one row a bin is brought here
    parts = {r["bin"]: -(-r["count"] // query_rows) for r in asks.groupBy("bin").count().where(F.col("count") > query_rows).collect()}
    many = np.ones(max(bins, 1), np.int32)
    for b, c in parts.items():
        many[b] = c
    count = F.element_at(F.lit(many), F.col("bin") + 1)
    held = rows.select("*", F.explode(posted).alias("bin"), F.lit(0).alias("kind")).withColumn("files", F.slice("files", 1, POSTED)).withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    asks = asks.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), *KEY), count).cast("int"))
    search = _cell(index, first, n, top, everything)
    found = held.unionByName(asks).groupBy("bin", "part").applyInArrow(lambda t: search(t), "k long, h long, id long, score double")
    best = W.partitionBy(*KEY).orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")


def nearest(vectors: DataFrame, is_query: str, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, files_recall: float = FILES_RECALL, reach_recall: float = REACH_RECALL, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, rank, id, score): each query's ``top`` best inner products found, ties to the smaller id.

    ``is_query`` is an SQL condition on the column ``id``. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do null
    ids. Vectors of another length are no candidates of a query. Rows that share an id all
    take part: a query isn't found itself, another row of its id is. Of equal rows
    each is a candidate, and one is a query. With fewer other rows than ``top``, all are
    returned. ``files_recall`` and ``reach_recall`` of 1 make the search exact. Other columns are not read.
    """
    ensure_shared_dir(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    unique = durable(distinct_vectors(rows, top))
    index = fit(unique, top, pivots, prefix, files_recall, reach_recall)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    built = durable(build(unique, index))
    # a vector that only rows share whose ids aren't carried may be a query too, so queries are read from all rows
    asked = durable(rows.where(is_query).select("id", "v", F.xxhash64("v").alias("h")).distinct())
    keyed = durable(spread_join(asked, unique.select("v", "k", "h"), ["v", "h"]).select("id", "k", "h"))
    queries = durable(built.join(keyed.select(*KEY).distinct(), list(KEY), "left_semi"))
    found = durable(_search(index, built, queries, top, shard_rows, query_rows, False))
    sizes = durable(built.groupBy(F.size("v").alias("d")).agg(F.sum(F.size("ids")).alias("n")))
    want = queries.select(*KEY, F.size("v").alias("d")).join(sizes, "d").select(*KEY, F.least(F.col("n"), F.lit(top + 1)).alias("want"))
    full = found.groupBy(*KEY).count().join(want, list(KEY)).where(F.col("count") >= F.col("want")).select(*KEY)
    short = durable(queries.join(full, list(KEY), "left_anti"))
    if not short.isEmpty():  # too few within the footrule bound: these queries meet all rows
        again = _search(index, built, short, top, shard_rows, query_rows, True)
        found = found.join(short.select(*KEY), list(KEY), "left_anti").unionByName(again)
    entry = F.struct((-F.col("score")).alias("s"), "id", "score")
    answers = durable(found.groupBy(*KEY).agg(F.array_sort(F.collect_list(entry)).alias("a")))  # top + 1 entries a vector
    own = durable(queries.select(*KEY, F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("own")))
    out = spread_join(keyed, answers.join(own, list(KEY)), list(KEY))
    at = F.array_position(F.transform("a", lambda e: (e["id"] == F.col("id")) & (e["score"] == F.col("own"))), True)
    others = F.when(at == 0, F.slice("a", 1, top)).otherwise(F.concat(F.slice("a", F.lit(1), at - 1), F.slice("a", at + 1, F.lit(top))))
    out = out.select(F.col("id").alias("query"), F.posexplode(F.slice(others, 1, top)).alias("at", "e"))
    return out.select("query", (F.col("at") + 1).cast("int").alias("rank"), "e.id", "e.score")
