"""Helpers that several operators share: durable tables and word arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's catalogue name of the setting for the folder that driver and executors share.
SHARED_DIR = "spark.checkpoint.dir"


def ensure_shared_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is set and the master is local (tests) make a local one."""
    if spark.conf.get(SHARED_DIR, None):
        return
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{SHARED_DIR} must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="slideframe-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read that: ``durable`` for tables as large as the texts.

    Columns are encoded and read one by one, so the table takes less than the texts.
    """
    ensure_shared_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stored_bytes(df: DataFrame) -> int:
    """About how many bytes a stored table's values take: measured, not the optimizer's estimate."""

    def size(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(f.dataType, T.ArrayType):
            each = (lambda x: F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(f.dataType.elementType, T.StringType) else (lambda x: F.lit(8))
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + each(x)), F.lit(0)) + 24
        return F.lit(8)

    total = sum((size(f) for f in df.schema.fields), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]


def hashed_sample(df: DataFrame, key: list[Column | str], rows: int, of: int) -> DataFrame:
    """At most ``rows`` rows, those with the least hashes of ``key``; ``of`` is the number of rows, or more.

    A bound on the hash first leaves about as many rows as wanted, so what is
    sorted doesn't grow with the input or its partitions.
    """
    h = F.xxhash64(F.lit("sample"), *key)
    share = (rows + 4 * rows**0.5 + 20) / max(of, 1)
    if share < 0.999:
        df = df.where(h < F.lit(int((share - 0.5) * 2.0**64)))
    return df.orderBy(h, *key).limit(rows)


#: A key is heavy beyond this share of the rows, so there are at most as many heavy keys as its inverse.
HEAVY_SHARE, HEAVY_LEAST = 1 / 4096, 256


def spread_join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of stored ``rows`` to a table with one row a key, heavy keys dealt out to many tasks.

    The rows of a key that holds more than a fixed share of all rows get salts in
    turn, and the key's row in the table is repeated for each salt. The list
    of heavy keys is broadcast: the share bounds it to 4,096 rows.
    """
    bound = max(HEAVY_LEAST, int(rows.count() * HEAVY_SHARE))
    heavy = durable(rows.groupBy(*on).count().where(F.col("count") > bound).select(*on, F.ceil(F.col("count") / bound).cast("int").alias("_salts")))
    if heavy.isEmpty():
        return rows.join(table, on)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).join(F.broadcast(heavy), on, "left").withColumn("_salt", F.pmod("_n", salts).cast("int")).drop("_n", "_salts")
    held = table.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(held, [*on, "_salt"]).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so products keep all 64 bits
MASK = (1 << 64) - 1


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Whitespace-separated words of several texts, as arrays over one byte buffer.

    Whitespace is the bytes 0x20 and 0x09 to 0x0D. ``buf`` holds every word
    followed by one space; word i is ``buf[start[i]:end[i]]`` and belongs to
    text ``doc[i]``.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        word = ~space
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        first, last = edges[0::2], edges[1::2]
        keep = word
        keep[last] = True
        buf = raw.copy()
        buf[last] = 32
        self.buf = buf[keep]
        size = last - first
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, first, "right") - 1

    def hashes(self) -> np.ndarray:
        return word_hashes(self.buf, self.start)


def word_hashes(buf: np.ndarray, start: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word; ``buf`` must consist of words with one space after each.

    Works on about ``block`` bytes at a time: the products take eight bytes a byte.
    """
    out = np.empty(len(start), np.uint64)
    bound = np.append(start, len(buf))
    table, lo = powers(64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(bound, bound[lo] + block, "right")) - 1)
        size = np.diff(bound[lo : hi + 1])
        if size.max() > len(table):
            table = powers(2 * int(size.max()))
        at = slices(np.zeros(hi - lo, np.int64), size)
        out[lo:hi] = np.add.reduceat((buf[bound[lo] : bound[hi]].astype(np.uint64) + np.uint64(1)) * table[at], bound[lo:hi] - bound[lo])
        lo = hi
    return mix64(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, by joining runs of doubled length."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole, have, part, size = None, 0, words, 1
    while True:
        if k & size:
            if whole is None:
                whole, have = part, size
            else:
                m = min(len(whole), len(part) - have)
                whole, have = whole[:m] * np.uint64(pow(BASE, size, 1 << 64)) + part[have : have + m], have + size
        if have == k:
            return mix64(whole[:n])
        part = part[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each run of w values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def slices(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices lo[0], lo[0]+1, ... (n[0] of them), then those of the next, and so on."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - n), n)
