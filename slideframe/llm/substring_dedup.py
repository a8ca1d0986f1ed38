"""Substring dedup by super-k-mers.

A window is ``k`` consecutive words of one text. Each word covered by a window
whose words also start earlier (in a smaller id, or earlier in the same
document) is removed. Windows are judged on the input.

Method: the minimiser of a window is the least hash among its m-word runs.
Consecutive windows with one minimiser (a super-k-mer) travel as one packed
string to the bucket of that minimiser, so equal windows meet; there sorting
finds each window's first occurrence. Hashes only order windows: equality is
always settled on the words themselves.

Scale: a first pass counts the words that each minimiser bin would receive. Bins
far above the mean are dealt out by window instead, so a hot minimiser is
spread over many buckets. Each map chunk sends one copy of a packed string;
further copies in the chunk are settled there. Reducers stream bucket by
bucket; a bucket's size is set by ``bucket_bytes``, not by the input, and one that
copies make larger is settled piece by piece, so memory stays bounded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Words, mix64, run_hashes, slices, sliding_min, word_hashes

NULL_ID = -(1 << 63)
CHUNK_BYTES = 4 << 20
MOST_WINDOWS = 64  # of one packed string
HOT = 4  # times the mean load of a bin


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, text hashes and texts, in chunks of about ``size`` bytes, by ascending id."""

    def done():
        order = sorted(range(len(ids)), key=ids.__getitem__)
        return np.array([ids[i] for i in order], np.int64), np.array([rids[i] for i in order], np.int64), [texts[i] for i in order]

    ids, rids, texts, held = [], [], [], 0
    for b in batches:
        for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(d)
            rids.append(r)
            texts.append(t)
            held += len(t)
            if held >= size:
                yield done()
                ids, rids, texts, held = [], [], [], 0
    if ids:
        yield done()


class _Runs:
    """The super-k-mers of a chunk: first window, number of windows, minimiser."""

    def __init__(self, texts: list[bytes], k: int, m: int):
        self.words = w = Words(texts)
        h = w.hashes()
        n = max(0, len(h) - k + 1)
        least = sliding_min(run_hashes(h, m), k - m + 1)[:n]
        whole = w.doc[:n] == w.doc[k - 1 : k - 1 + n]
        self.hashes = h
        new = np.ones(n, bool)
        if n:
            new[1:] = (least[1:] != least[:-1]) | (w.doc[1:n] != w.doc[: n - 1])
        first = np.flatnonzero(new)
        count = np.diff(first, append=n)
        # windows that run into the next text end a run: they are the last k-1 of each text
        good = np.add.reduceat(whole.astype(np.int64), first) if len(first) else count
        first, count = first[good > 0], good[good > 0]
        pieces = -(-count // MOST_WINDOWS)
        at = slices(np.zeros(len(pieces), np.int64), pieces) * MOST_WINDOWS
        self.first = np.repeat(first, pieces) + at
        self.count = np.minimum(np.repeat(count, pieces) - at, MOST_WINDOWS)
        self.key = mix64(least[self.first])


def _pack(ids: np.ndarray, rids: np.ndarray, start: np.ndarray, size: np.ndarray, body: bytes, squeeze) -> bytes:
    return squeeze.compress(struct.pack("<q", len(ids)) + ids.astype("<i8").tobytes() + rids.astype("<i8").tobytes() + start.astype("<i4").tobytes() + size.astype("<i4").tobytes() + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at = 8
    out = []
    for kind, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i4", 4)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += width * n
    return (*out, raw[at:])


def _count_bins(bits: int, k: int, m: int):
    def count(batches):
        for _, _, texts in _chunks(batches):
            runs = _Runs(texts, k, m)
            bins, back = np.unique(runs.key >> np.uint64(64 - bits), return_inverse=True)
            load = np.bincount(back, weights=runs.count + (k - 1), minlength=len(bins))
            size = np.bincount(back, weights=runs.words.end[runs.first + runs.count + k - 2] - runs.words.start[runs.first], minlength=len(bins))
            yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int64)), pa.array(load.astype(np.int64)), pa.array(size.astype(np.int64))], ["bin", "words", "bytes"])

    return count


def _send(bits: int, k: int, m: int, buckets: int, hot: dict[int, tuple[int, int]]):
    """Rows (bucket, blob). Buckets under zero carry ranges that are settled already."""
    hot_bins = np.array(sorted(hot), np.uint64)

    def send(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        turn = 0
        for ids, rids, texts in _chunks(batches):
            runs = _Runs(texts, k, m)
            w = runs.words
            first, count, key = runs.first, runs.count, runs.key
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            if len(hot_bins):
                bins = key >> np.uint64(64 - bits)
                is_hot = np.isin(bins, hot_bins)
                if is_hot.any():  # each window alone, dealt by its own words
                    at, n = first[is_hot], count[is_hot]
                    single = slices(at, n)
                    own = run_hashes(runs.hashes, k)[single]
                    base, spread = (np.array([hot[b][i] for b in np.repeat(bins[is_hot], n).tolist()], np.int64) for i in (0, 1))
                    bucket = np.concatenate([bucket[~is_hot], base + (own % spread.astype(np.uint64)).astype(np.int64)])
                    first = np.concatenate([first[~is_hot], single])
                    count = np.concatenate([count[~is_hot], np.ones(len(single), np.int64)])
                    order = np.argsort(first, kind="stable")
                    bucket, first, count = bucket[order], first[order], count[order]
            text_of = w.doc[first]
            begin = np.searchsorted(w.doc, np.arange(len(texts)))  # first word of each text
            start = first - begin[text_of]
            lo, hi = w.start[first], w.end[first + count + k - 2] + 1
            body = w.buf.tobytes()
            seen: dict[bytes, int] = {}
            strings = [body[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            lead = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
            settled = lead != np.arange(len(strings))
            d, r = ids[text_of], rids[text_of]
            # a copy at the same id and place (a repeated row) isn't later than the first
            later = settled & ((d != d[lead]) | (start != start[lead]))
            if later.any():
                turn += 1
                yield _row(-1 - turn % 997, _pack(d[later], r[later], start[later], count[later] + (k - 1), b"", squeeze))
            # ids in a chunk ascend, but rows that share an id restart: those all travel
            tie = settled & ~later
            go = np.flatnonzero(~settled | (tie & (r != r[lead])))
            go = go[np.argsort(bucket[go], kind="stable")]
            b = bucket[go]
            cuts = np.flatnonzero(np.diff(b)) + 1
            for part in np.split(go, cuts) if len(go) else []:
                yield _row(int(bucket[part[0]]), _pack(d[part], r[part], start[part], (hi - lo)[part], b"".join([strings[i] for i in part.tolist()]), squeeze))

    return send


def _row(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Whether buf[a:a+n] equals buf[b:b+n], in blocks of bounded size."""
    out = np.ones(len(a), bool)
    lo = 0
    ends = np.cumsum(n)
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block, "right")))
        same = buf[slices(a[lo:hi], n[lo:hi])] == buf[slices(b[lo:hi], n[lo:hi])]
        out[lo:hi] = np.logical_and.reduceat(same, np.cumsum(n[lo:hi]) - n[lo:hi])
        lo = hi
    return out


def later_windows(ids, start, size, body: bytes, k: int, hashed=run_hashes):
    """For the windows of packed strings: (string, offset) arrays of those that also start earlier."""
    order = np.lexsort((start, ids))
    at = np.cumsum(size) - size
    buf = np.frombuffer(body, np.uint8)[slices(at[order], size[order])]
    space = np.flatnonzero(buf == 32)
    wstart = np.concatenate([[0], space[:-1] + 1])
    ends = np.cumsum(size[order])
    n_words = np.diff(np.searchsorted(space, ends, "left"), prepend=0)
    first_word = np.cumsum(n_words) - n_words
    n_win = n_words - k + 1
    win = slices(first_word, n_win)  # word index of each window; ascending id and start
    of = np.repeat(np.arange(len(order)), n_win)
    h = hashed(word_hashes(buf, wstart), k)[win]
    by = np.argsort(h, kind="stable")
    hs = h[by]
    new = np.ones(len(by), bool)
    new[1:] = hs[1:] != hs[:-1]
    lead = np.empty(len(by), np.int64)
    lead[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    copy = np.flatnonzero(lead != np.arange(len(lead)))
    if not len(copy):
        return order[:0], copy, order
    # settle equality on bytes, run by run of consecutive windows of one string
    go_on = (np.diff(copy) == 1) & (np.diff(lead[copy]) == 1) & (np.diff(of[copy]) == 0) & (np.diff(of[lead[copy]]) == 0)
    head = np.flatnonzero(np.concatenate([[True], ~go_on]))
    tail = np.concatenate([head[1:], [len(copy)]]) - 1
    a, b = wstart[win[copy[head]]], wstart[win[lead[copy[head]]]]
    na = space[win[copy[tail]] + k - 1] + 1 - a
    nb = space[win[lead[copy[tail]]] + k - 1] + 1 - b
    same = na == nb
    same[same] = _equal_bytes(buf, a[same], b[same], na[same])
    if not same.all():  # equal hashes of different words: compare the words themselves
        odd = np.isin(h, np.unique(h[slices(copy[head][~same], (tail - head + 1)[~same])]))
        seen: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(odd).tolist():
            lead[i] = seen.setdefault((int(h[i]), buf[wstart[win[i]] : space[win[i] + k - 1]].tobytes()), i)
        copy = np.flatnonzero(lead != np.arange(len(lead)))
    d, s = ids[order][of], start[order][of] + (win - first_word[of])
    copy = copy[(d[copy] != d[lead[copy]]) | (s[copy] != s[lead[copy]])]
    return order[of[copy]], s[copy], order


def _joined(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    ids, rids, start, size = (np.concatenate([r[i] for r in rows]) for i in range(4))
    return ids, rids, start, size.astype(np.int64), b"".join(r[4] for r in rows)


def _settle(rows, k: int, keep_on: bool):
    """The ranges of later windows, and if the bucket goes on the strings that still hold a first one."""
    ids, rids, start, size, body = _joined(rows)
    of, at, _ = later_windows(ids, start, size, body, k)
    out = None
    if len(of):
        cut = np.flatnonzero((np.diff(of) != 0) | (np.diff(at) != 1)) + 1
        head, tail = np.concatenate([[0], cut]), np.concatenate([cut, [len(of)]]) - 1
        out = _ranges(ids[of[head]], rids[of[head]], at[head], at[tail] + k)
    if not keep_on:
        return out, None
    begin = np.cumsum(size) - size
    spaces = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint8) == 32)])
    windows = spaces[begin + size] - spaces[begin] - (k - 1)
    keep = np.flatnonzero(np.bincount(of, minlength=len(ids)) < windows)
    left = b"".join([body[a : a + n] for a, n in zip(begin[keep].tolist(), size[keep].tolist(), strict=True)])
    return out, (ids[keep], rids[keep], start[keep], size[keep], left)


def _find(k: int, most: int):
    """Streams buckets; one that outgrows ``most`` bytes is settled as it comes, copies of what it holds are let go."""

    def find(batches):
        held, bucket, size, limit = [], None, 0, most
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = _unpack(blob.as_py())
                if b < 0:
                    yield _ranges(row[0], row[1], row[2], row[2] + row[3])
                    continue
                if held and (b != bucket or size > limit):
                    out, left = _settle(held, k, b == bucket)
                    if out is not None:
                        yield out
                    held = [left] if left else []
                    size = len(left[4]) if left else 0
                    limit = max(most, 2 * size)
                bucket = b
                held.append(row)
                size += len(row[4])
        if held and (out := _settle(held, k, False)[0]) is not None:
            yield out

    return find


def _ranges(ids, rids, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["_d", "_r", "lo", "hi"])


def _squeeze(batches):
    """Texts travel to their ranges compressed."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([squeeze.compress(t.as_buffer()) for t in b.column(3)], pa.binary())], ["id", "_d", "_r", "_z"])


def _cut(batches):
    for batch in batches:
        unsqueeze = zstandard.ZstdDecompressor()
        texts, spans = map(unsqueeze.decompress, batch.column("_z").to_pylist()), batch.column("_spans").to_pylist()
        n, gone, kept = [], [], []
        for text, ranges in zip(texts, spans, strict=True):
            words = text.split()
            n.append(len(words))
            if ranges:
                keep = np.zeros(len(words) + 1, np.int64)
                np.add.at(keep, [x >> 32 for x in ranges], 1)
                np.add.at(keep, [x & 0xFFFFFFFF for x in ranges], -1)
                keep = np.cumsum(keep)[:-1] == 0
                words = [w for w, stay in zip(words, keep.tolist(), strict=True) if stay]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        own = [batch.column(c) for c in batch.schema.names if c not in ("_z", "_spans")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 3, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_text) for every row of ``docs``.

    ``kept_text`` is the words that stay, joined by one space. A null text has
    no words. A null id ranks before all others. Rows that share an id count as
    one document: equal places don't remove each other. Rows that are repeated
    entirely get equal results. Other columns of ``docs`` are not read, so
    their names can't clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.ensure_shared_dir(spark)
    # words never span texts; bytes are those of UTF-8
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    keyed = texts.select(F.coalesce("id", F.lit(NULL_ID)).alias("_d"), F.xxhash64("_t").alias("_r"), "_t")
    bits = min(24, max(12, int(common.input_bytes(docs) // (8 << 20)).bit_length()))
    bins = common.durable(keyed.mapInArrow(_count_bins(bits, k, m), "bin long, words long, bytes long").groupBy("bin").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")))
    total = bins.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(1, -(-total // bucket_bytes))
    most = HOT * max(total / (1 << bits), bucket_bytes / 4)
    base, hot = buckets, {}
    for row in bins.where(F.col("bytes") > most).orderBy("bin").collect():  # at most total / most of them
        spread = -(-row["bytes"] * k // bucket_bytes)
        hot[row["bin"]] = (base, spread)
        base += spread
    sent = keyed.mapInArrow(_send(bits, k, m, buckets, hot), "bucket long, blob binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(base, 1 << 16))
    ranges = sent.repartition(min(parts, max(1, 4 * base)), "bucket").sortWithinPartitions("bucket").mapInArrow(_find(k, 4 * bucket_bytes), "_d long, _r long, lo int, hi int")
    spans = ranges.groupBy("_d", "_r").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))).alias("_spans"))
    packed = texts.select("id", F.coalesce("id", F.lit(NULL_ID)).alias("_d"), F.xxhash64("_t").alias("_r"), "_t").mapInArrow(_squeeze, "id long, _d long, _r long, _z binary")
    joined = packed.join(spans, ["_d", "_r"], "left").select("id", "_z", "_spans")
    return joined.mapInArrow(_cut, "id long, n_words long, n_removed long, kept_text string")


#: The contract's query for DuckDB: every window, its first place, and the words that no later one covers.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), word AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
