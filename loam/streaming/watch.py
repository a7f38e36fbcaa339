"""Structured Streaming: file events to coalesced batches to index versions. The checkpoint holds the cursor."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loam.folder import Folder
from loam.operators.changes import coalesce, split_renames
from loam.sources.store import Store

EVENTS = "seq long, ts timestamp, op string, path string, to_path string"


def events(spark: SparkSession, where: str, schema: str = EVENTS, most_files: int = 16) -> DataFrame:
    """A stream of event files; ``most_files`` a trigger is the high-water mark of a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(where)


def sessions(stream: DataFrame, quiet: str = "500 milliseconds", late: str = "1 hour", key: str = "path") -> DataFrame:
    """(key, window, changes, last_op): quiet windows of each key by event time; timestamps without zone are cast first."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", quiet).alias("window"), key).agg(F.count(F.lit(1)).alias("changes"), F.max_by("op", "seq").alias("last_op"))


def keep_current(stream: DataFrame, store: Store, rows_of: Callable[[DataFrame], DataFrame], checkpoint: str, scope: Column | None = None) -> StreamingQuery:
    """Applies each micro-batch to the store as one new version, and ends when the stream's present input is done.

    A batch that is run again after a failure finds its own number under the stream's name and changes nothing. The name is the one that the
    checkpoint keeps, so another stream, or a new checkpoint, counts from the beginning. ``rows_of`` gives the index rows that (path, op)
    ask for: of an ``upsert`` the path's, of an ``upsert_tree`` those of all files below the path. Over a listing that is
    ``changes.rows_for``. ``scope`` is a predicate over ``path`` that changes must meet.
    """
    folder = Folder(store.spark, checkpoint)

    def one(batch: DataFrame, number: int) -> None:
        name = json.loads(folder.read("metadata").decode())["id"]
        changes = coalesce(split_renames(batch, scope))
        store.apply(changes, rows_of(changes.where(F.col("op").isin("upsert", "upsert_tree"))), tag=(name, number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
