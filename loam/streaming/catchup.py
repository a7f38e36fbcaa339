"""Keeping an index current from outside: replaying a volume's journal from the stored cursor, and watching roots."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.manage import Index
from loam.operators.changes import coalesce, rows_for
from loam.operators.journal import translated
from loam.session import Scratch


def catch_up(index: Index, volume: str, journal_id: int, journal: DataFrame, entries: DataFrame, anchors: DataFrame, listed: DataFrame | None = None) -> dict:
    """Brings the index up to the journal's end: from the volume's cursor if it may be resumed, else by comparing with the disk.

    ``journal`` has the records that the volume still keeps, ``entries`` the tree as it was before them. Changes since the cursor become one batch,
    and the cursor is stored after the batch is in the index, so a failure in between repeats the batch, which changes nothing. Returns
    how it was done and the new cursor.
    """
    mine = journal.where((F.col("volume") == volume) & (F.col("journal_id") == journal_id) & F.col("usn").isNotNull())
    ends = mine.agg(F.min("usn").alias("low"), F.max("usn").alias("high")).first()
    how = index.start(volume, journal_id, ends.low if ends.low is not None else 0)
    after = (ends.high + 1) if ends.high is not None else 0
    if how == "reconcile":
        index.reconcile()
    else:
        since = index.store.meta()["cursors"][volume]["next_usn"]
        scratch = Scratch(index.spark, "catchup")
        ops = translated(mine, entries.where(F.col("volume") == volume), anchors.where(F.col("volume") == volume), scratch)
        changes = scratch.keep(coalesce(ops.where(F.col("seq") >= 2 * since)))
        if not changes.isEmpty():
            there = listed if listed is not None else index.indexable(index.listed(index.store.meta()["roots"]))
            index.store.apply(changes, index.rows_of(rows_for(there, changes)))
        after = max(after, since)
    index.commit_cursor(volume, journal_id, after)
    return {"how": how, "next_usn": after, "outcome": index.store.outcome()}


def watch(index: Index, seconds: float | None = None, interval: float = 2.0, report: Callable[[dict], None] = lambda outcome: None) -> int:
    """Keeps all roots current until the time is over: what lies under no root goes, changed files are read again, waiting images are recognised.

    Returns the number of rounds. Only what changed is read and written; a round without changes writes nothing.
    """
    began, rounds = time.time(), 0
    while True:
        counts = index.reconcile()
        index.recognise_images(interval)
        rounds += 1
        if any(counts.values()):
            report(counts)
        if seconds is not None and time.time() - began + interval > seconds:
            return rounds
        time.sleep(interval)
