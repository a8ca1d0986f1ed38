"""Imports as a stream: decks arrive as files, requests as rows; long imports wait in a queue of JSON tasks."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import model as M
from ..durable import durable
from ..functions import images as I
from ..model import ImportOptions
from ..operators import relate as R
from ..plans import deck, sink
from ..sources import package, pdf


def backend(path: Column) -> Column:
    """pdf by extension, anything else is a deck."""
    return F.when(F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)) == "pdf", "pdf").otherwise("deck")


def effective_mode(options: ImportOptions, renderer_available: bool) -> str:
    """Images need a renderer; without one the editable import runs."""
    return "images" if options.import_mode == "images" and renderer_available else "editable"


def arriving(spark: SparkSession, path: str, pattern: str = "*.{pptx,pdf,PPTX,PDF}", files_per_batch: int = 100) -> DataFrame:
    """A stream of (deck_id, modified, content) from a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("path").alias("deck_id"), F.col("modificationTime").alias("modified"), "content")


def routed(counts: DataFrame, threshold: int = M.ASYNC_THRESHOLD, count: str = "n_pages") -> DataFrame:
    """Add ``route``: long imports are queued, others run at once."""
    return counts.withColumn("route", F.when(F.col(count) > threshold, "queued").otherwise("inline"))


def admitted(requests: DataFrame, pending: DataFrame) -> DataFrame:
    """Requests of lessons that have none in the queue."""
    return R.strangers(requests, pending, ["lesson_id"])


def once_per_lesson(requests: DataFrame, time: str = "requested", within: str = "1 hour") -> DataFrame:
    """Of a stream of requests, the first of each lesson within a time."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark(["lesson_id"])


def expired(staged: DataFrame, now: Column, days: int = M.RETENTION_DAYS, created: str = "created") -> DataFrame:
    """Staged uploads strictly older than the retention time."""
    return staged.where(F.col(created) < now - F.expr(f"INTERVAL {days} DAYS"))


@contextmanager
def locked(spark: SparkSession, folder: str, owner: str, wait: float = M.LOCK_WAIT_S) -> Iterator[None]:
    """Hold a folder's lock, a file that only one writer can create; waits for another owner's for so many seconds.

    The owner is written into the file, so a writer that was lost and started again takes its own lock over.
    """
    hadoop = spark._jvm.org.apache.hadoop
    at = hadoop.fs.Path(f"{folder}/_lock")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    until = time.monotonic() + wait
    while True:
        try:
            out = fs.create(at, False)
            out.writeUTF(owner)
            out.close()
            break
        except Py4JJavaError:  # it exists
            if fs.exists(at):
                try:
                    held = fs.open(at)
                    mine = held.readUTF() == owner
                    held.close()
                except Py4JJavaError:  # another writer is just writing or removing it
                    mine = False
                if mine:
                    break
            if time.monotonic() >= until:
                raise TimeoutError(f"{folder} is being written by another import") from None
            time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(at, False)


#: A task of the queue as JSON: the file, its lesson, and the options by name.
TASK = "deck_id string, lesson_id string, options struct<" + ", ".join(f"{f.name}: { {'int': 'int', 'str': 'string', 'bool': 'boolean'}[f.type] }" for f in fields(ImportOptions)) + ">"


def task_json(deck_id: Column, lesson_id: Column, options: ImportOptions) -> Column:
    """A queued import as one JSON text."""
    named = F.struct(*[F.lit(v).alias(k) for k, v in asdict(options).items()])
    return F.to_json(F.struct(deck_id.alias("deck_id"), lesson_id.alias("lesson_id"), named.alias("options")))


def read_tasks(rows: DataFrame, task: str = "task") -> DataFrame:
    """Add deck_id, lesson_id and ``options`` (JSON, null where there are none); texts that aren't tasks have no deck_id."""
    t = F.from_json(F.col(task), TASK)
    return rows.withColumns({"deck_id": t["deck_id"], "lesson_id": t["lesson_id"], "options": F.to_json(t["options"])})


def options_of(text: str | None) -> ImportOptions:
    """Options from JSON; those that are missing, null or unknown by name keep their defaults."""
    known = {f.name for f in fields(ImportOptions)}
    return ImportOptions(**{k: v for k, v in json.loads(text or "{}").items() if k in known and v is not None})


def page_counts(packages: DataFrame, options: ImportOptions, renderer_available: bool) -> DataFrame:
    """(deck_id, n_pages) of files: sheets of PDF, listed slides, or all slide parts where slides become pictures; 0 if unreadable."""
    kind = backend(F.col("deck_id"))
    counts = deck.slide_counts(package.slides(packages.where(kind == "deck")))
    n = "n_parts" if effective_mode(options, renderer_available) == "images" else "n_listed"
    known = counts.select("deck_id", F.col(n).cast("int").alias("n_pages")).unionByName(pdf.page_counts(packages.where(kind == "pdf")))
    return packages.select("deck_id").join(known, "deck_id", "left").fillna(0, ["n_pages"])


def waiting(spark: SparkSession, folder: str, but: str | None = None) -> DataFrame:
    """(batch, deck_id, lesson_id, options) of the queued tasks that no worker has finished, those of batch ``but`` left out."""
    if not sink.exists(spark, f"{folder}/queue"):
        return spark.createDataFrame([], "batch string, deck_id string, lesson_id string, options string")
    rows = read_tasks(spark.read.schema("task string, batch string").parquet(f"{folder}/queue")).drop("task").where("deck_id IS NOT NULL")
    if but is not None:
        rows = rows.where(F.col("batch") != but)
    if sink.exists(spark, f"{folder}/done"):
        rows = R.strangers(rows, spark.read.schema("deck_id string, batch string").parquet(f"{folder}/done"), ["batch", "deck_id"])
    return rows


def submit(packages: DataFrame, folder: str, batch: str, options: ImportOptions | None = None, lesson: Column | None = None, renderer: deck.Renderer | None = None, owner: str = "", threshold: int = M.ASYNC_THRESHOLD) -> None:
    """Take one batch of (deck_id, content): files of up to ``threshold`` pages are imported at once, longer ones queued.

    Files of lessons that have a task in the queue are refused, and of the long files of
    a lesson in this batch all but the first by deck_id; ``refused`` lists them. The queue holds no content: ``work_off`` reads
    the file at ``deck_id``. A batch that is run again replaces what it queued and imported.
    """
    o = options or ImportOptions()
    spark = packages.sparkSession
    named = (packages.withColumn("lesson_id", F.col("deck_id")) if lesson is None else packages.withColumn("lesson_id", lesson)).select("deck_id", "lesson_id", "content")
    with locked(spark, folder, owner or batch):
        asked = named.drop("content").join(page_counts(named, o, renderer is not None), "deck_id")
        free = admitted(asked, waiting(spark, folder, but=batch))
        first = F.row_number().over(W.partitionBy("lesson_id", "route").orderBy("deck_id")) == 1
        free = durable(routed(free, threshold).withColumn("taken", (F.col("route") == "inline") | first))
        queued = free.where("taken AND route = 'queued'").select(task_json(F.col("deck_id"), F.col("lesson_id"), o).alias("task"))
        queued.write.mode("overwrite").parquet(f"{folder}/queue/batch={batch}")
        R.strangers(asked, free.where("taken"), ["deck_id"]).select("deck_id", "lesson_id").write.mode("overwrite").parquet(f"{folder}/refused/batch={batch}")
    at_once = named.join(free.where("route = 'inline'").select("deck_id"), "deck_id", "left_semi")
    import_batch(at_once, folder, batch, o, F.col("lesson_id"), renderer, owner)


def _literal(path: str) -> str:
    """A path whose special characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def work_off(spark: SparkSession, folder: str, renderer: deck.Renderer | None = None, batches: int = 1) -> int:
    """Import the queued files of up to so many batches of the queue, the least names first; returns the number of tasks done.

    Tasks whose file is gone are done without pages. A batch counts as done only
    once its pages are stored, and a retry replaces them. The driver
    lists the tasks of one batch at a time, no more than files came in with it.
    """
    done = 0
    names = [r["batch"] for r in waiting(spark, folder).select("batch").distinct().orderBy(F.length("batch"), "batch").limit(batches).collect()]
    for name in names:
        tasks = waiting(spark, folder).where(F.col("batch") == name).collect()
        for wanted in sorted({t["options"] or "" for t in tasks}):
            here = [t for t in tasks if (t["options"] or "") == wanted and sink.exists(spark, t["deck_id"])]
            if not here:
                continue
            files = spark.read.format("binaryFile").load([_literal(t["deck_id"]) for t in here]).select(F.col("path").alias("deck_id"), "content")
            lessons = spark.createDataFrame([(t["deck_id"], t["lesson_id"]) for t in here], "deck_id string, lesson_id string")
            unit = f"queued-{name}-{zlib.crc32(wanted.encode()):08x}"
            import_batch(files.join(F.broadcast(lessons), "deck_id"), folder, unit, options_of(wanted), F.col("lesson_id"), renderer)
        spark.createDataFrame([(t["deck_id"],) for t in tasks], "deck_id string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/batch={name}")
        done += len(tasks)
    return done


def import_batch(packages: DataFrame, folder: str, batch: str, options: ImportOptions | None = None, lesson: Column | None = None, renderer: deck.Renderer | None = None, owner: str = "", converters: tuple[I.Converter, ...] = ()) -> None:
    """Import one batch of (deck_id, content) into their lessons (by default a file is its own lesson).

    Decks become pages of blocks, or of pictures where the options ask for them and
    a renderer is given; PDF files need a renderer. Media that can't be prepared (blank
    ones, drawings that neither hold a bitmap nor a converter reads) leave the pages. With a renderer and
    ``smartart_images``, complex slides become pictures. New pages go behind
    the stored ones of their lesson, media are stored with their bytes, and files that
    give no pages are listed in ``errors`` with the reason.
    """
    o = options or ImportOptions()
    spark = packages.sparkSession
    packages = packages.select("deck_id", "content", *([] if lesson is None else [lesson.alias("lesson_id")]))
    kind = backend(F.col("deck_id"))
    decks, sheets = packages.where(kind == "deck"), packages.where(kind == "pdf")
    slides = package.slides(decks)
    media = package.parts(decks, "^ppt/media/")
    errors = slides.where("error IS NOT NULL").select("deck_id", "error").unionByName(media.where("error IS NOT NULL").select("deck_id", "error")).distinct()
    if effective_mode(o, renderer is not None) == "images":
        pages, shots = deck.image_pages(decks, slides, renderer, o), deck.rendered_images(decks, renderer, o)
        media = shots.select("deck_id", F.col("filename").alias("path"), "bytes")
    else:
        prepared = durable(I.prepared(media.where("error IS NULL"), o.image_max_dim, converters))
        pages = deck.pages(slides, o, I.failed(prepared)).join(media.where("error IS NOT NULL").select("deck_id"), "deck_id", "left_anti")
        media = prepared.where("ok").select("deck_id", "path", "bytes")
        if o.smartart_images and renderer is not None:
            complex_rows = durable(deck.complex_slides(slides, o))
            shots = deck.rendered_images(decks.join(complex_rows.select("deck_id").distinct(), "deck_id", "left_semi"), renderer, o)
            pages = deck.with_images(pages, complex_rows, shots, o)
            media = media.unionByName(shots.join(complex_rows, ["deck_id", "page_no"], "left_semi").select("deck_id", F.col("filename").alias("path"), "bytes"))
    if renderer is None:
        errors = errors.unionByName(sheets.select("deck_id", F.lit("no renderer").alias("error")))
    else:
        pages = pages.unionByName(pdf.pages(sheets, renderer, o))
        media = media.unionByName(deck.rendered_images(sheets, renderer, o).select("deck_id", F.col("filename").alias("path"), "bytes"))
    if lesson is None:
        pages = pages.withColumn("lesson_id", F.col("deck_id"))
    else:
        pages = pages.join(packages.select("deck_id", "lesson_id"), "deck_id")
    with locked(spark, folder, owner or batch):
        there = sink.stored(spark, folder, but=batch)
        new = durable(sink.chained(pages, there if there is not None else spark.createDataFrame([], "lesson_id string, page_id long")))
        sink.write(new, folder, batch, media)
        errors.write.mode("overwrite").parquet(f"{folder}/errors/batch={batch}")


def run(stream: DataFrame, folder: str, checkpoint: str, options: ImportOptions | None = None, lesson: Column | None = None, renderer: deck.Renderer | None = None, threshold: int = M.ASYNC_THRESHOLD, **trigger) -> StreamingQuery:
    """Start taking a stream of files: short ones are imported with their batch, long ones queued for ``work_off``."""

    def batch(rows: DataFrame, n: int) -> None:
        submit(rows, folder, str(n), options, lesson, renderer, owner=checkpoint, threshold=threshold)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
