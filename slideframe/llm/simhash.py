"""SimHash near-dedup by a binary trie self-join.

Fingerprints of distinct texts are joined with themselves within a few bits.
Two fingerprints that differ in at most b bits agree on one of b+1 blocks of
bits, so each block's value deals them out, and equal-block groups are binary
tries on the remaining bits. A trie is walked by pairs of nodes, from
the pair (root, root) down, adding up differing bits and dropping a pair when
they exceed the budget.

Scale: only distinct 8-byte fingerprints travel, b+1 times. A group of more than
``most`` fingerprints is dealt out again by blocks of its remaining bits, and
again while a part is still too large.
Found pairs are merged where they are found, so rows out stay in
proportion to the fingerprints however dense a group is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .common import durable, ensure_shared_dir, slices, spread_join

BITS = 64
FRONTIER = 1 << 18  # node pairs taken at a time
LEAF = 8  # node pairs of so few fingerprint pairs are compared one by one


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    body = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - k + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(body[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), ">u8", n).view(np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, 1 << 16))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(words: int, seed: int):
    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], ["id", "r", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, r, fp) per row; r is a hash of the text, and a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("r"), F.col(text_col).alias("t")).mapInArrow(_fingerprints(words, seed), "id long, r long, fp long")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def blocks(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """n ranges of bits that cover lo to hi, of nearly equal sizes."""
    return [(lo + (hi - lo) * i // n, lo + (hi - lo) * (i + 1) // n) for i in range(n)]


def trie_pairs(x: np.ndarray, groups: np.ndarray, budget: int):
    """Yield index pairs (i < j) of ``x`` within ``budget`` bits, inside each group.

    ``groups`` holds the bounds of the groups; each is sorted and so a trie of
    its own, and all are walked at once. A node is a range of ``x``.
    """
    lo, hi = groups[:-1], groups[1:]
    go = hi - lo > 1
    lo, hi = lo[go], hi[go]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int8), 0)]
    while stack:
        alo, ahi, blo, bhi, err, depth = stack.pop()
        if len(alo) > FRONTIER:
            stack += [tuple(v[i : i + FRONTIER] for v in (alo, ahi, blo, bhi, err)) + (depth,) for i in range(0, len(alo), FRONTIER)]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth == BITS)
        if small.any():
            n = (ahi - alo)[small] * (bhi - blo)[small]
            at = slices(np.zeros(len(n), np.int64), n)
            wide = np.repeat((bhi - blo)[small], n)
            i, j = np.repeat(alo[small], n) + at // wide, np.repeat(blo[small], n) + at % wide
            ok = i < j
            i, j = i[ok], j[ok]
            near = np.bitwise_count(x[i] ^ x[j]) <= budget
            yield i[near], j[near]
            alo, ahi, blo, bhi, err = (v[~small] for v in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        unset = np.concatenate([[0], np.cumsum((x & np.uint64(1 << (BITS - 1 - depth))) == 0)])

        def middle(lo, hi, unset=unset):
            return lo + unset[hi] - unset[lo]

        am, bm = middle(alo, ahi), middle(blo, bhi)
        same = alo == blo
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        parts.append(tuple(v[~same] for v in (am, ahi, blo, bm, err + 1)))  # of a node with itself one of the mixed pairs will do
        nxt = [np.concatenate(v) for v in zip(*parts, strict=True)]
        live = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        stack.append((*(v[live] for v in nxt), depth + 1))


def _forest(budget: int, rows: int = 1 << 20):
    """From rows (group key, fp), sorted by key: edges that span each group's linked classes."""

    def edges(keys, fps):
        order = np.lexsort((fps, keys))
        fps, keys = fps[order], keys[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        parent = np.arange(len(fps))
        for i, j in trie_pairs(fps, cuts, budget):
            components.unite(parent, i, j)
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.RecordBatch.from_arrays([pa.array(fps[tied].view(np.int64)), pa.array(fps[parent[tied]].view(np.int64))], ["a", "b"])

    def run(batches):
        keys, fps, held = [], [], 0
        for b in batches:
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            keys.append(k)
            fps.append(f)
            held += len(k)
            if held >= rows and k[0] != k[-1]:
                at = int(np.flatnonzero(k != k[-1])[-1]) + 1
                keys[-1], fps[-1] = k[:at], f[:at]
                yield edges(np.concatenate(keys), np.concatenate(fps))
                keys, fps, held = [k[at:]], [f[at:]], len(k) - at
        if keys:
            yield edges(np.concatenate(keys), np.concatenate(fps))

    return run


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cuts(free: int, n: int) -> list[tuple[int, int]]:
    """For n blocks of the set bits of ``free``: the block, and the bits left free, as signed masks."""
    bits = [1 << i for i in reversed(range(BITS)) if free >> i & 1]
    parts = [sum(bits[lo:hi]) for lo, hi in blocks(0, len(bits), n)]
    return [(_signed(part), _signed(free & ~part)) for part in parts]


def _dealt(rows: DataFrame, free: list[int], n: int) -> DataFrame:
    """(fp, key, free): each row of a group once a block of the bits that its group leaves free.

    A key is a hash of the group's key and the block with its bits; clashes
    only enlarge a group. ``free`` lists the masks that occur.
    """
    masks = rows.sparkSession.createDataFrame([(_signed(m), _cuts(m, n)) for m in free], "free long, cuts array<struct<block:long,rest:long>>")
    cut = rows.join(F.broadcast(masks), "free").select("fp", "key", F.explode("cuts").alias("c"))
    return cut.select("fp", F.xxhash64("key", "c.block", F.col("fp").bitwiseAND(F.col("c.block"))).alias("key"), F.col("c.rest").alias("free"))


def groups_of(fps: DataFrame, budget: int = 2, most: int = 1 << 20) -> DataFrame:
    """(key, fp): groups of at most ``most`` fingerprints, two of which share one if they differ in at most ``budget`` bits.

    All fingerprints of a group agree on its cut bits, so their differences are
    in the bits left free; budget + 1 blocks of these keep the pigeonhole
    bound. Only groups with no more than ``budget`` free bits can't be cut further.
    """
    whole = (1 << BITS) - 1
    level = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(block).alias("block"), F.lit(rest).alias("free")) for block, rest in _cuts(whole, budget + 1)])).alias("c"))
    level = level.select("fp", F.xxhash64("c.block", F.col("fp").bitwiseAND(F.col("c.block"))).alias("key"), "c.free")
    done = []
    while True:
        can = F.bit_count("free") > budget
        heavy = durable(level.where(can).groupBy("key").count().where(F.col("count") > most).select("key"))  # at most rows / most rows
        if heavy.isEmpty():
            break
        done += [level.where(~can).select("key", "fp"), level.where(can).join(heavy, "key", "left_anti").select("key", "fp")]
        again = durable(level.where(can).join(heavy, "key", "left_semi"))
        level = _dealt(again, [r["free"] % (1 << BITS) for r in again.select("free").distinct().collect()], budget + 1)
    out = level.select("key", "fp")
    for part in done:
        out = out.unionByName(part)
    return out


def near_edges(fps: DataFrame, budget: int = 2, most: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that connect exactly those distinct fingerprints (column fp) linked within ``budget`` bits."""
    return groups_of(fps, budget, most).repartition("key").sortWithinPartitions("key").mapInArrow(_forest(budget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2, seed: int = 42, most: int = 1 << 20) -> DataFrame:
    """(id, r, fp, root, component) per row; component is the least id reachable over links of ``budget`` bits.

    ``root`` is the class's least fingerprint as a signed number, and r a hash
    of the text.

    Equal fingerprints are linked. Texts without words, null ones included, have
    fingerprint zero. Repeated rows each give a row. A null id takes part,
    but is a component's id only where no other id is. Other columns are not
    read. An empty table gives an empty result.
    """
    ensure_shared_dir(docs.sparkSession)
    found = durable(fingerprints(docs, id_col, text_col, words, seed))
    nodes = found.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components.connected_components(near_edges(nodes.select("fp"), budget, most))
    classes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = classes.where("root <> fp").select("root").distinct()  # classes of one need no second look
    tied = classes.join(lows, "root", "left_semi").groupBy("root").agg(F.min("low").alias("least"))
    classes = classes.join(tied, "root", "left").select("fp", "root", F.coalesce("least", "low").alias("component"))
    return spread_join(found, classes, ["fp"]).select("id", "r", "fp", "root", "component")


NULL_ID = -(1 << 63)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, with one row of each class of near-duplicates.

    The least id stays, null ids last; of rows that share it, the one with
    the least text hash, and of rows that share both the one with the least hash
    of its other columns (maps, which have none, apart).
    """
    rows = near_duplicates(docs, id_col, text_col, **options)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "r")).alias("b"))
    best = best.select(F.coalesce("b.id", F.lit(NULL_ID)).alias("_keep_id"), F.col("b.r").alias("_keep_r"))
    marked = docs.withColumns({"_keep_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_keep_r": text_hash(text_col)})
    kept = marked.join(best, ["_keep_id", "_keep_r"], "left_semi")
    rest = F.xxhash64(F.lit(0), *[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    return kept.groupBy("_keep_id", "_keep_r").agg(F.min_by(F.struct(*docs.columns), rest).alias("_row")).select("_row.*")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
