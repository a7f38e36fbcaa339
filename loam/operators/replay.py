"""Applying a stream of inserts, updates and deletes: commit-ordered transactional replay up to a contiguous watermark."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.folder import Folder, Pointers
from loam.session import small_join, table

#: Sequence numbers that one gap-scan task sorts at most: numbers are unique in a block, so a block is bounded by construction.
BLOCK = 65_536


@dataclass(frozen=True)
class Feed:
    """How to read a change feed.

    ``stream``: columns that name an independent sequence (a volume). ``seq``: the sequence number within it. ``key``: columns of
    the entity. ``deleted``: a boolean column expression that is never null. ``stride``: the distance between neighbouring sequence
    numbers of a feed without gaps. ``txn``: column of a transaction's name, or None if each record is one of its own. ``parts``:
    column with the number of records of the transaction. ``first``: the number that every stream begins with; where it isn't known a
    stream begins with the lowest number received, so a feed that is read in several runs should name it.
    """

    stream: tuple[str, ...]
    seq: str
    key: tuple[str, ...]
    deleted: Column
    stride: int = 1
    txn: str | None = None
    parts: str | None = None
    first: int | None = None


def records(changes: DataFrame, feed: Feed, *keep: str) -> DataFrame:
    """One row a record (stream, seq, key): deliveries that repeat it are merged; deleted if any delivery of it says so.

    Rows without a sequence number or key don't count. With ``keep`` the greatest value of these columns is carried along.
    """
    whole = changes.where(F.col(feed.seq).isNotNull())
    for k in feed.key:
        whole = whole.where(F.col(k).isNotNull())
    names = dict.fromkeys([*feed.stream, feed.seq, *feed.key, *([feed.txn] if feed.txn else [])])
    return whole.groupBy(*names).agg(F.max(feed.deleted.cast("int")).cast("boolean").alias("_deleted"), *[F.max(c).alias(c) for c in keep])


def commits(recs: DataFrame, feed: Feed) -> DataFrame:
    """Complete transactions only, with ``_commit``: the number of their last record. Incomplete ones are held back entirely."""
    if feed.txn is None:
        return recs.withColumn("_commit", F.col(feed.seq))
    txns = recs.groupBy(*feed.stream, feed.txn).agg(F.max(feed.seq).alias("_commit"), F.count_distinct(feed.seq).alias("_have"), F.max(feed.parts).alias("_need"))
    done = txns.where(F.col("_have") >= F.col("_need")).select(*feed.stream, feed.txn, "_commit")
    return recs.join(done, [*feed.stream, feed.txn])


def watermarks(seqs: DataFrame, feed: Feed) -> DataFrame:
    """(stream, low, watermark, high): the last number reached without a gap, from the stream's lowest on.

    Two levels, so that no task sorts a whole stream: numbers are scanned in blocks of at most BLOCK distinct ones, and then the
    blocks' summaries (fewer by that factor) per stream. A feed whose stride is 1 has gaps wherever a number is missing.
    """
    s, on = F.col(feed.seq), list(feed.stream)
    block = F.floor(s / F.lit(feed.stride * BLOCK)).alias("_block")
    numbers = seqs.select(*on, feed.seq).distinct().select(*on, feed.seq, block)
    inner = W.partitionBy(*on, "_block").orderBy(feed.seq)
    gap = (s - F.lag(s).over(inner)) > feed.stride
    marked = numbers.withColumn("_before", F.when(gap, F.lag(s).over(inner)))
    blocks = marked.groupBy(*on, "_block").agg(F.min(s).alias("_first"), F.max(s).alias("_last"), F.min("_before").alias("_before"))
    outer = W.partitionBy(*on).orderBy("_block")
    jump = (F.col("_first") - F.lag("_last").over(outer)) > feed.stride
    ends = blocks.withColumn("_jump", F.when(jump, F.lag("_last").over(outer)))
    first_gap = F.least(F.min("_before"), F.min("_jump"))  # least() skips nulls
    return ends.groupBy(*on).agg(F.min("_first").alias("low"), F.coalesce(first_gap, F.max("_last")).alias("watermark"), F.max("_last").alias("high"))


def anchored(seqs: DataFrame, feed: Feed) -> DataFrame:
    """The numbers of each stream and, where the feed names its first one, the one before that, so that a missing beginning is a gap."""
    if feed.first is None:
        return seqs.select(*feed.stream, feed.seq)
    before = seqs.select(*feed.stream).distinct().withColumn(feed.seq, F.lit(feed.first - feed.stride).cast("long"))
    return seqs.select(*feed.stream, feed.seq).unionByName(before)


def closing(changes: DataFrame, feed: Feed) -> DataFrame:
    """End-of-feed events (stream, end) for a feed that is known to be over: nothing up to its highest number is still to come."""
    return changes.where(F.col(feed.seq).isNotNull()).groupBy(*feed.stream).agg(F.max(feed.seq).alias("end"))


def released(changes: DataFrame, feed: Feed, *carry: str, ends: DataFrame | None = None) -> DataFrame:
    """The records of complete transactions up to each stream's watermark, with ``_commit``.

    An end-of-feed event lifts its stream's watermark to the number that it names, as gaps below it will never be filled; it completes no
    transaction.
    """
    whole = commits(records(changes, feed, *dict.fromkeys([*carry, *([feed.parts] if feed.parts else [])])), feed)
    marks = watermarks(anchored(changes.where(F.col(feed.seq).isNotNull()), feed), feed).select(*feed.stream, "watermark")
    if ends is not None:
        marks = marks.unionByName(ends.select(*feed.stream, F.col("end").alias("watermark"))).groupBy(*feed.stream).agg(F.max("watermark").alias("watermark"))
    return small_join(whole, marks, list(feed.stream), "inner", null_safe=True).where(F.col("_commit") <= F.col("watermark")).drop("watermark")


def folded(rows: DataFrame, feed: Feed, *carry: str) -> DataFrame:
    """The last released record of each entity: (stream, key, _top). Entities don't wait for each other, each is a partial aggregate of its own."""
    ids = list(dict.fromkeys([*feed.stream, *feed.key]))
    return rows.groupBy(*ids).agg(F.max(F.struct("_commit", F.col(feed.seq).alias("_seq"), "_deleted", *carry)).alias("_top"))


def state(changes: DataFrame, feed: Feed, *carry: str, closed: bool = False) -> DataFrame:
    """The table that a feed describes: (stream, key, seq, carry) of each entity that exists at the watermark.

    Deliveries are merged to records, records assembled to complete transactions, and what lies beyond a stream's contiguous watermark is
    held back. Repeated and late records fold by sequence number; of one entity the last record of the last complete transaction counts,
    and it exists unless that record deletes it. ``closed`` says that the feed has ended: end-of-feed events lift the watermarks to the
    highest numbers; incomplete transactions stay out even then. An entity with a third of all records is combined in many tasks. An
    empty feed gives an empty table.
    """
    ids = list(dict.fromkeys([*feed.stream, *feed.key]))
    last = folded(released(changes, feed, *carry, ends=closing(changes, feed) if closed else None), feed, *carry).where(~F.col("_top._deleted"))
    return last.select(*ids, F.col("_top._seq").alias(feed.seq), *[F.col(f"_top.{c}").alias(c) for c in carry])


class Replica:
    """A table kept from a feed over many runs: each run reads the new changes only, never the history.

    Stored are the exposed rows, the records that wait (beyond a gap, or of an incomplete transaction) and each stream's watermark, as one
    numbered state that a pointer names. A run that fails before the pointer is published leaves the old state; one that is run again
    meets records that it knows and changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, feed: Feed, *carry: str):
        self.spark, self.root, self.feed, self.carry = spark, root.rstrip("/"), feed, carry
        self.pointers = Pointers(Folder(spark, self.root), "state")
        self.ids = list(dict.fromkeys([*feed.stream, *feed.key]))

    def _read(self, name: str) -> DataFrame | None:
        n, state = self.pointers.last()
        return self.spark.read.parquet(f"{self.root}/{state['folder']}/{name}") if n else None

    def table(self) -> DataFrame | None:
        """The exposed table, None before the first run."""
        rows = self._read("rows")
        return rows.select(*self.ids, F.col("_top._seq").alias(self.feed.seq), *[F.col(f"_top.{c}").alias(c) for c in self.carry]) if rows is not None else None

    def apply(self, changes: DataFrame, ends: DataFrame | None = None) -> int:
        """Takes new changes in; returns the number of the state that shows them. ``ends`` are end-of-feed events (stream, end)."""
        feed, stream, n = self.feed, list(self.feed.stream), self.pointers.last()[0]
        folder = f"{n + 1}-{uuid.uuid4().hex[:8]}"
        write = lambda df, name: df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}/{name}")
        fresh = records(changes, feed, *dict.fromkeys([*self.carry, *([feed.parts] if feed.parts else [])]))
        old = self._read("marks")
        if old is not None:  # what lies at or below the watermark has been received before
            fresh = small_join(fresh, old.select(*stream, F.col("watermark").alias("_w")), stream, null_safe=True).where(F.col("_w").isNull() | (F.col(feed.seq) > F.col("_w"))).drop("_w")
            keys = [c for c in fresh.columns]
            fresh = self._read("held").select(keys).unionByName(fresh).groupBy(*[c for c in keys if c in (*stream, feed.seq, *feed.key, feed.txn)]).agg(*[F.max(c).alias(c) for c in keys if c not in (*stream, feed.seq, *feed.key, feed.txn)])
        write(fresh, "seen")
        fresh = self.spark.read.parquet(f"{self.root}/{folder}/seen")
        numbers = fresh.select(*stream, feed.seq)
        if old is None:
            numbers = anchored(numbers, feed)
        else:  # a stream goes on from its watermark, not from the least of the new numbers
            placed = small_join(numbers, old.select(*stream, F.col("watermark").alias("_w")), stream, null_safe=True)
            begun = anchored(placed.where(F.col("_w").isNull()), feed)
            numbers = placed.where(F.col(feed.seq) > F.col("_w")).select(*stream, feed.seq).unionByName(begun).unionByName(old.select(*stream, F.col("watermark").alias(feed.seq)))
        marks = watermarks(numbers, feed).select(*stream, "watermark")
        if ends is not None:
            marks = marks.unionByName(ends.select(*stream, F.col("end").alias("watermark"))).groupBy(*stream).agg(F.max("watermark").alias("watermark"))
        write(marks, "marks")
        marks = self.spark.read.parquet(f"{self.root}/{folder}/marks")
        ready = small_join(commits(fresh, feed), marks, stream, "inner", null_safe=True).where(F.col("_commit") <= F.col("watermark")).drop("watermark")
        write(ready, "ready")
        ready = self.spark.read.parquet(f"{self.root}/{folder}/ready")
        on = [feed.seq, *self.ids]
        same = F.lit(True)
        for c in on:
            same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        gone = ready.select(*[F.col(c).alias(f"_g_{c}") for c in on]).distinct()
        write(fresh.join(gone, same, "left_anti"), "held")
        tops = folded(ready, feed, *self.carry)
        had = self._read("rows")
        if had is not None:
            tops = tops.unionByName(had).groupBy(*self.ids).agg(F.max("_top").alias("_top"))
        write(tops.where(~F.col("_top._deleted")), "rows")
        return self.pointers.advance(n, {"folder": folder})


def journal_feed() -> Feed:
    """The journal table as a feed: each record is a transaction of its own, and a null flag or reason means not set."""
    return Feed(stream=("volume",), seq="usn", key=("frn",), deleted=F.coalesce(F.col("reason.file_delete"), F.lit(False)), stride=800)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that exist once the whole journal has been applied: (volume, frn, usn). The journal given is a feed that has ended."""
    changes = table(spark, sf_dir, "usn_journal").select("volume", "frn", "usn", "reason")
    return state(changes, journal_feed(), closed=True).select("volume", "frn", "usn")


#: Neighbouring numbers of the journal that ``p4_open`` takes for one transaction.
OPEN_PARTS = 2


def p4_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a feed that is still open, with transactions of several records: (volume, frn, usn) of what may be shown.

    Its numbers are taken in steps of 8000, of which every volume has some without a gap; a transaction is a pair of neighbouring steps,
    complete when both have come. What lies beyond the first missing step, and what belongs to half a pair, is held back.
    """
    rows = table(spark, sf_dir, "usn_journal").select("volume", "frn", "usn", "reason").where("usn IS NOT NULL AND frn IS NOT NULL")
    step = F.floor(F.col("usn") / 8000)
    changes = rows.withColumn("step", step).withColumn("txn", F.floor(step / OPEN_PARTS)).withColumn("parts", F.lit(OPEN_PARTS))
    feed = Feed(stream=("volume",), seq="step", key=("frn",), deleted=F.coalesce(F.col("reason.file_delete"), F.lit(False)), txn="txn", parts="parts")
    return state(changes, feed, "usn").select("volume", "frn", "usn")


P4_OPEN_SQL = """
WITH r AS (
  SELECT volume, frn, usn, usn // 8000 AS step, usn // 16000 AS txn, coalesce(reason.file_delete, false) AS gone FROM usn_journal WHERE usn IS NOT NULL AND frn IS NOT NULL
), n AS (SELECT DISTINCT volume, step FROM r), g AS (SELECT volume, step, lag(step) OVER (PARTITION BY volume ORDER BY step) AS before FROM n),
w AS (SELECT volume, coalesce(min(before) FILTER (WHERE step - before > 1), max(step)) AS watermark FROM g GROUP BY volume),
t AS (SELECT volume, txn, max(step) AS last_step FROM r GROUP BY ALL HAVING count(DISTINCT step) >= 2),
rec AS (SELECT volume, frn, step, txn, max(usn) AS usn, bool_or(gone) AS gone FROM r GROUP BY ALL),
ok AS (SELECT rec.*, t.last_step FROM rec JOIN t USING (volume, txn) JOIN w USING (volume) WHERE t.last_step <= w.watermark)
SELECT volume, frn, usn FROM ok QUALIFY row_number() OVER (PARTITION BY volume, frn ORDER BY last_step DESC, step DESC) = 1 AND NOT gone
"""


def p4_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each volume's journal is contiguous: (volume, low, watermark, high)."""
    changes = table(spark, sf_dir, "usn_journal").where(F.col("usn").isNotNull() & F.col("frn").isNotNull()).select("volume", "usn")
    return watermarks(changes, journal_feed())


P4_SQL = """
WITH r AS (
  SELECT volume, frn, usn, coalesce(reason.file_delete, false) AS gone FROM usn_journal WHERE usn IS NOT NULL AND frn IS NOT NULL
), top AS (SELECT volume, frn, max(usn) AS usn FROM r GROUP BY ALL)
SELECT t.volume, t.frn, t.usn FROM top t
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.volume IS NOT DISTINCT FROM t.volume AND r.frn = t.frn AND r.usn = t.usn AND r.gone)
"""
P4_WATERMARKS_SQL = """
WITH n AS (SELECT DISTINCT volume, usn FROM usn_journal WHERE usn IS NOT NULL AND frn IS NOT NULL),
g AS (SELECT volume, usn, lag(usn) OVER (PARTITION BY volume ORDER BY usn) AS before FROM n)
SELECT volume, min(usn) AS low, coalesce(min(before) FILTER (WHERE usn - before > 800), max(usn)) AS watermark, max(usn) AS high FROM g GROUP BY volume
"""
