"""Recognising text of images: a queue of what waits, what was recognised before, and batches that end up in the index."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.folder import Folder, Pointers
from loam.functions.paths import IMAGE_EXTS
from loam.functions.text import dual_form
from loam.operators.changes import compact_queue
from loam.sources.extract import IMAGE_BYTES, Recogniser, is_image, opened
from loam.sources.store import FILES, Store

PENDING = "path string, mtime long, size long"
PROCESSED = "path string, mtime long, size long, content string"
#: Images of one batch. A cluster takes as many at once as it has cores, so the batch grows with them; a desktop's was 32.
BATCH = 32
#: Parts of the processed table before they are put together.
PARTS = 16


class ImageQueue:
    """Two tables under a pointer: images that wait, and recognised text by (path, mtime, size).

    An image is marked as processed only when its text is in the index; the text is stored before that, so that what was recognised is
    never lost and an interrupted batch waits again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.pointers = Pointers(Folder(spark, root), "queue")

    def _state(self) -> dict:
        return {"pending": None, "processed": [], "waiting": 0, "total": 0} | (self.pointers.last()[1] or {})

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def pending(self) -> DataFrame:
        state = self._state()
        return self._read([state["pending"]] if state["pending"] else [], PENDING)

    def processed(self) -> DataFrame:
        """What was recognised, the newest of each path; it is kept in parts, one a batch, which are put together once there are PARTS."""
        rows = self._read(self._state()["processed"], PROCESSED + ", at long")
        return rows.groupBy("path").agg(F.max(F.struct("at", "mtime", "size", "content")).alias("_t")).select("path", "_t.mtime", "_t.size", "_t.content")

    def _publish(self, pending: DataFrame | None = None, more: DataFrame | None = None, whole: DataFrame | None = None, total: int | None = None) -> None:
        """The next state: another pending table, a further part of the processed one, or a new whole one."""
        n, state, at = self.pointers.last()[0], self._state(), time.time_ns()
        if pending is not None:
            pending.write.parquet(f"{self.root}/pending-{at}")
            state |= {"pending": f"pending-{at}", "waiting": self._read([f"pending-{at}"], PENDING).count()}
        for rows, old in ((more, state["processed"]), (whole, [])):
            if rows is not None:
                rows.select("path", "mtime", "size", "content").withColumn("at", F.lit(at)).write.parquet(f"{self.root}/processed-{at}")
                state["processed"] = [*old, f"processed-{at}"]
        state["total"] = max(state["waiting"], state["total"] if total is None else total)
        self.pointers.advance(n, state)
        if len(state["processed"]) > PARTS:
            self._publish(whole=self.processed())

    def enqueue(self, listed: DataFrame) -> None:
        """Adds listed images whose stats no recognised text has; an image that waits already takes its newest stats."""
        images = listed.where(is_image(F.col("ext")) & (F.col("size") <= IMAGE_BYTES)).select("path", "mtime", "size")
        new = images.join(self.processed().select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
        if new.isEmpty():
            return
        known = self.pending().join(images.select("path"), "path", "left_anti")
        both = known.unionByName(new).groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("_s")).select("path", "_s.*")
        self._publish(both)

    def compact(self, roots: list[str], existing: DataFrame | None = None) -> None:
        """Drops what lies under no root or, with a listing, exists no more."""
        if not self.pointers.last()[0]:
            return
        keep = lambda df: compact_queue(df, roots, existing if existing is not None else df)
        self._publish(keep(self.pending()), whole=keep(self.processed()), total=0)

    def done(self, recognised: DataFrame) -> None:
        """Takes recognised images (path, mtime, size, content) off the queue and keeps their text."""
        left = self.pending().join(recognised.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
        self._publish(left, more=recognised)

    def progress(self) -> dict:
        """(total, done): the total rises where more wait than were known, and begins anew once nothing waits."""
        state = self._state()
        return {"total": state["total"], "done": state["total"] - state["waiting"]}


def recognised(images: DataFrame, recognise: Recogniser) -> DataFrame:
    """(path, mtime, size, content) of images: recognised text with a form without spaces between CJK characters below it. What can't be read
    or recognised has '' and isn't tried again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path in batch["path"]:
                try:
                    fs, at = opened(path)
                    with fs.open_input_stream(at) as source:
                        texts.append(recognise(source.read()) or "")
                except Exception:
                    texts.append("")
            yield batch.assign(content=texts)[["path", "mtime", "size", "content"]]

    cores = images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(cores).mapInPandas(run, PROCESSED).withColumn("content", dual_form(F.col("content")))


def drain(queue: ImageQueue, store: Store, recognise: Recogniser | None, seconds: float | None = None, batch: int | None = None) -> dict:
    """Recognises waiting images in batches, least path first, until none waits or the time is over; returns the progress.

    A batch is recognised once and written, then put into the index, then marked; a failure in between leaves it waiting as a whole.
    Without a recogniser nothing is done.
    """
    spark, began = queue.spark, time.time()
    size = batch or BATCH * max(1, spark.sparkContext.defaultParallelism)
    while recognise and (seconds is None or time.time() - began < seconds):
        taken = queue.pending().orderBy("path").limit(size)
        if taken.isEmpty():
            break
        at = f"{queue.root}/batch-{time.time_ns()}"
        recognised(taken, recognise).write.parquet(at)
        texts = spark.read.schema(PROCESSED).parquet(at)
        name = F.regexp_extract("path", r"([^/\\]*)$", 1)
        rows = texts.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "content", "mtime", "size", F.lit("image").alias("kind"))
        there = store.files().where(F.col("ext").isin(*IMAGE_EXTS)).select("path", "mtime", "size")
        # an image that was changed or removed meanwhile takes no old text
        rows = rows.join(there, ["path", "mtime", "size"], "left_semi").select(*[c.split()[0] for c in FILES.split(", ")])
        store.apply(rows.select("path", F.lit("upsert").alias("op")), rows)
        queue.done(texts)
        Folder(spark, at).delete("")
    return queue.progress()
