"""Processing only new or changed records: a work-item ledger with pending, leased and done states."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.folder import Folder
from loam.functions.paths import strip_verbatim
from loam.session import Scratch, small_join, table

EVENTS = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("token", T.LongType()),
        T.StructField("expires_ms", T.LongType()),
        T.StructField("upto", T.LongType()),
        T.StructField("version", T.ArrayType(T.LongType())),
    ]
)
NAMES = [f.name for f in EVENTS]
PENDING, LEASED, DONE = "pending", "leased", "done"
#: Directories that the log is dealt to by a hash of the unit, so that a commit reads the events of a few units only.
BUCKETS = 16
#: How long a run of the index may hold its lease.
LEASE_MS = 3_600_000


def as_events(df: DataFrame) -> DataFrame:
    """A frame in the shape of the log; what it lacks is null."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS])


def fold(events: DataFrame) -> DataFrame:
    """What the log says of each unit: (unit, state, token, expires_ms, upto, done_version, wanted_version).

    The highest token wins; of one token ``done`` beats ``leased`` beats ``pending``. A stale writer holds a lower token than the
    lease that replaced it, so its late event changes no state. ``upto`` is how far a sequence is done: the furthest of its commits, as
    what was committed stays done whatever lease came later. ``done_version`` is that of the newest commit, ``wanted_version`` that of the
    newest demand. Repeated events fold to one, events without a unit are ignored, a null token counts as 0. Folding is a partial
    aggregate, so a unit with many events is combined before the shuffle.
    """
    done = F.col("state") == DONE
    rank = F.when(done, 2).when(F.col("state") == LEASED, 1).otherwise(0)
    token = F.coalesce("token", F.lit(0)).alias("token")
    top = F.max(F.struct(token, rank.alias("rank"), F.coalesce("expires_ms", F.lit(0)).alias("expires_ms")))
    versioned = F.struct(token, "version")
    state = F.element_at(F.array(F.lit(PENDING), F.lit(LEASED), F.lit(DONE)), F.col("top.rank") + 1)
    whole = events.where(F.col("unit").isNotNull()).groupBy("unit").agg(
        top.alias("top"), F.max(F.when(done, F.col("upto"))).alias("upto"), F.max(F.when(done & F.col("version").isNotNull(), versioned)).alias("had"),
        F.max(F.when((F.col("state") == PENDING) & F.col("version").isNotNull(), versioned)).alias("want"), F.max(F.when(done, F.col("token"))).alias("done_token"),
    )
    return whole.select("unit", state.alias("state"), "top.token", "top.expires_ms", "upto", F.col("had.version").alias("done_version"), F.col("want.version").alias("wanted_version"), "done_token")


def claimable(events: DataFrame, now_ms: int) -> DataFrame:
    """Units that a worker may take: pending ones, leased ones whose lease ended before ``now_ms`` (they return to pending), and done ones
    that are wanted in another version than the one that is done."""
    stale = F.col("wanted_version").isNotNull() & ~F.col("wanted_version").eqNullSafe(F.col("done_version"))
    unversioned = F.col("wanted_version").isNull()
    idle = (F.col("state") != LEASED) | (F.col("expires_ms") < now_ms)
    return fold(events).where(idle & (stale | (unversioned & (F.col("state") != DONE))))


class WorkLedger:
    """The ledger as an append-only Parquet log in a shared folder.

    Units are names of bounded slices of the input, of sequences that are done up to a number, or of things that are done in a version.
    A lease is taken by creating a file named by unit and token, which only one coordinator can; the token is the fence. Output of a unit
    goes to a path made of its name and the token, written with overwrite: a retry of the same lease replaces the same rows, and a
    worker that was thought dead writes beside the winner, never over it. ``commit`` takes only the token of the newest lease, and readers
    see the output that a done event names.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.folder = Folder(spark, self.root)

    def _log(self) -> str:
        """The log's present generation; compaction begins another one."""
        made = sorted(int(n.split("-")[1]) for n in self.folder.names() if n.startswith("generation-"))
        return f"events-{made[-1] if made else 0}"

    @staticmethod
    def _key(unit: str) -> str:
        return hashlib.sha256(unit.encode()).hexdigest()

    def events(self, unit: str | None = None) -> DataFrame:
        """The whole log, or the part in which a unit's events are."""
        log = self._log()
        if not self.folder.exists(log):
            return self.spark.createDataFrame([], EVENTS)
        if unit is None:
            return self.spark.read.schema(T.StructType([*EVENTS, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/{log}").select(NAMES)
        part = f"{log}/bucket={int(self._key(unit)[:2], 16) % BUCKETS}"
        return self.spark.read.schema(EVENTS).parquet(f"{self.root}/{part}") if self.folder.exists(part) else self.spark.createDataFrame([], EVENTS)

    def append(self, events: DataFrame, log: str | None = None) -> None:
        bucket = F.conv(F.substring(F.sha2("unit", 256), 1, 2), 16, 10).cast("int") % BUCKETS
        rows = as_events(events).where(F.col("unit").isNotNull()).withColumn("bucket", bucket).hint("rebalance", "bucket")
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/{log or self._log()}")

    def _say(self, rows: list[tuple]) -> None:
        self.append(self.spark.createDataFrame(rows, EVENTS).coalesce(1))

    def enqueue(self, units: DataFrame) -> None:
        """Adds units (column ``unit``, and ``version`` where a new version makes a unit pending again) that the ledger doesn't know yet."""
        has = "version" in units.columns
        new = as_events(units.withColumn("state", F.lit(PENDING)).withColumn("token", F.coalesce("token", F.lit(0)) if "token" in units.columns else F.lit(0))).where(F.col("unit").isNotNull()).distinct()
        if has:
            self.append(new)
        else:
            self.append(new.join(self.events().select("unit").distinct(), "unit", "left_anti"))

    def claimable(self, now_ms: int | None = None) -> DataFrame:
        return claimable(self.events(), self.clock() if now_ms is None else now_ms)

    def lease(self, ttl_ms: int, most: int) -> list[tuple[str, int]]:
        """Takes up to ``most`` claimable units, least name first; returns (unit, fencing token). Another coordinator's claims are left to it.

        A claim whose coordinator died before it wrote its event counts as taken for the lease's time and is then passed over.
        """
        now, taken = self.clock(), []
        for r in self.claimable(now).orderBy("unit").limit(most).collect():
            token = r.token + 1
            while not self.folder.claim(claim := f"claims/{self._key(r.unit)}/{token}"):
                if self.folder.age_ms(claim, int(time.time() * 1000)) <= ttl_ms:
                    token = None
                    break
                token += 1
            if token is not None:
                taken.append((r.unit, token))
        if taken:
            self._say([(u, LEASED, t, now + ttl_ms, None, None) for u, t in taken])
        return taken

    def commit(self, unit: str, token: int, upto: int | None = None, version: list[int] | None = None) -> bool:
        """Marks a unit done if ``token`` is still the newest one; a stale token is rejected and changes nothing."""
        now = fold(self.events(unit).where(F.col("unit") == unit)).collect()
        if not now or now[0].state == PENDING or now[0].token != token:
            return False
        self._say([(unit, DONE, token, 0, upto, version if version is not None else now[0].wanted_version)])
        return True

    def output(self, unit: str, token: int = 0) -> str:
        return f"{self.root}/output/{self._key(unit)}/{token}"

    def process(self, unit: str, token: int, rows: DataFrame, upto: int | None = None) -> bool:
        """Writes a unit's rows to its lease's path, then commits; a failure in between leaves the lease to expire."""
        rows.write.mode("overwrite").parquet(self.output(unit, token))
        return self.commit(unit, token, upto)

    def results(self) -> DataFrame | None:
        """The rows of all done units, None if there is none; outputs of leases that were never committed stay out. Which ones count is a join."""
        if not self.folder.exists("output"):
            return None
        finished = fold(self.events()).where(F.col("done_token").isNotNull())
        if finished.isEmpty():
            return None
        done = finished.select(F.concat_ws("/", F.sha2("unit", 256), F.col("done_token").cast("string")).alias("_from"))
        rows = self.spark.read.parquet(f"{self.root}/output/*/*")
        names = rows.columns
        placed = rows.withColumn("_from", F.regexp_extract("_metadata.file_path", r"/output/([0-9a-f]{64}/\d+)/", 1))
        return placed.join(done, "_from", "left_semi").select(names)

    def compact(self) -> None:
        """Folds the log into a new generation: at most three events a unit. For the coordinator, between runs."""
        log = self._log()
        event = lambda state, token, expires, upto, version: F.struct(F.col("unit").alias("unit"), state.alias("state"), token.alias("token"), expires.alias("expires_ms"), upto.alias("upto"), version.alias("version"))
        none, zero = F.lit(None), F.lit(0).cast("long")
        now = event(F.col("state"), F.col("token"), F.col("expires_ms"), none.cast("long"), none.cast("array<long>"))
        had = F.when(F.col("done_token").isNotNull(), event(F.lit(DONE), F.col("done_token"), zero, F.col("upto"), F.col("done_version")))
        want = F.when(F.col("wanted_version").isNotNull(), event(F.lit(PENDING), zero, zero, none.cast("long"), F.col("wanted_version")))
        rows = fold(self.events()).select(F.explode(F.array_compact(F.array(now, had, want))).alias("x")).select("x.*")
        n = int(log.split("-")[1]) + 1
        self.folder.delete(f"events-{n}")
        self.append(rows, f"events-{n}")
        self.folder.claim(f"generation-{n}")
        self.folder.delete(log)


def stream_unit() -> Column:
    """The unit of a journal: its volume and number. Null volumes and journals are no unit."""
    return F.concat_ws("|", F.lit("journal"), F.col("volume"), F.col("journal_id").cast("string"))


def cursor_events(cursors: DataFrame) -> DataFrame:
    """Run records of a journal cursor as ledger events of the journal's unit; the run's id is its fencing token.

    A committed run is done up to its ``next_usn``. A run that never ended holds a lease of LEASE_MS from its start. A failed or aborted run
    has given its lease back, so what it read is pending again. Rows without volume or journal name no unit and are dropped.
    """
    status = F.coalesce("run_status", F.lit(""))
    state = F.when(status == "committed", DONE).when(status.isin("failed", "aborted"), PENDING).otherwise(LEASED)
    expires = F.unix_millis(F.col("started_at").cast("timestamp")) + LEASE_MS if "started_at" in cursors.columns else F.lit(0)
    known = cursors.where(F.col("volume").isNotNull() & F.col("journal_id").isNotNull())
    return as_events(known.select(stream_unit().alias("unit"), state.alias("state"), F.col("run_id").alias("token"), expires.alias("expires_ms"), F.col("next_usn").alias("upto")))


def file_events(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """The listing and the index as ledger events of units that are paths, in the version (mtime, size).

    A sighting demands its version, what the index stored is done; times of sighting and of indexing are the tokens, so the latest of each
    counts, of equal times the greatest version. A ``\\\\?\\`` prefix is no part of a path, rows without a path are dropped.
    """

    def events(rows: DataFrame, at: str, state: str) -> DataFrame:
        token = F.unix_micros(F.col(at).cast("timestamp")) if dict(rows.dtypes)[at].startswith("timestamp") else F.col(at)
        return as_events(rows.where(F.col("path").isNotNull()).select(F.concat(F.lit("file|"), strip_verbatim(F.col("path"))).alias("unit"), F.lit(state).alias("state"), token.alias("token"), F.array(F.col("mtime"), F.col("size")).alias("version")))

    return events(listing, "seen_at", PENDING).union(events(indexed, "indexed_at", DONE))


def journal_items(journal: DataFrame, states: DataFrame, now_ms: int) -> DataFrame:
    """Distinct (volume, usn) of journal records that aren't done by the folded ``states`` and that no living lease holds.

    A record is done if its journal's unit is done beyond its usn. Records without usn are dropped; one without volume or journal belongs to
    no unit and stays pending. Folded states are broadcast only after their number is checked. Redelivered records collapse in a partial
    aggregate.
    """
    held = (F.col("state") == LEASED) & (F.col("expires_ms") >= now_ms)
    units = states.select("unit", F.col("upto").alias("_upto"), held.alias("_held"))
    unit = F.when(F.col("volume").isNotNull() & F.col("journal_id").isNotNull(), stream_unit())
    records = journal.where(F.col("usn").isNotNull()).select(unit.alias("unit"), "volume", "usn")
    left = small_join(records, units, ["unit"])
    return left.where((F.col("_upto").isNull() | (F.col("usn") >= F.col("_upto"))) & ~F.coalesce("_held", F.lit(False))).select("volume", "usn").distinct()


def listing_items(events: DataFrame, now_ms: int) -> DataFrame:
    """(path) of the files that the log wants in another version than the one that is done. Files gone from the listing are wanted by nobody."""
    return claimable(events, now_ms).where(F.col("wanted_version").isNotNull()).select(F.substring("unit", 6, 1 << 30).alias("path"))


def journal_pending(journal: DataFrame, cursors: DataFrame) -> DataFrame:
    """``journal_items`` straight from a table of runs, once all their leases have ended."""
    return journal_items(journal, fold(cursor_events(cursors)), takeover(cursors))


def listing_pending(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """``listing_items`` straight from a listing and what the index stored."""
    return listing_items(file_events(listing, indexed), 0)


def takeover(cursors: DataFrame) -> int:
    """The first moment, in milliseconds, at which no run that the cursor table records can still hold its lease."""
    if "started_at" not in cursors.columns:
        return 1
    last = cursors.agg(F.max(F.unix_millis(F.col("started_at").cast("timestamp")))).first()[0]
    return (last or 0) + LEASE_MS + 1


def history(spark: SparkSession, sf_dir: str) -> tuple[WorkLedger, int]:
    """The tables' history as a ledger: runs as events of their journals, sightings and stored files as events of their paths."""
    book = WorkLedger(spark, Scratch(spark, "ledger").root)
    cursors = table(spark, sf_dir, "usn_cursors")
    book.append(cursor_events(cursors))
    book.append(file_events(table(spark, sf_dir, "disk_listing").select("path", "mtime", "size", "seen_at"), table(spark, sf_dir, "indexed_files").select("path", "mtime", "size", "indexed_at")))
    return book, takeover(cursors)


def latest(rows: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The newest row of each key by ``at``; ties go to the greatest values. A partial aggregate: hot keys are combined first."""
    top = F.max(F.struct(F.col(at).alias("_at"), *values)).alias("_top")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, *[F.col(f"_top.{v}").alias(v) for v in values])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All work items that a run beginning after all recorded ones has to take: (change_source, volume, item).

    The history goes into a ledger; what its fold leaves pending, or returns to pending as its lease has expired, is found.
    """
    book, now = history(spark, sf_dir)
    is_journal = F.col("unit").startswith("journal|")
    states = fold(book.events().where(is_journal))
    journal = journal_items(table(spark, sf_dir, "usn_journal"), states, now)
    files = listing_items(book.events().where(~is_journal), now)
    return journal.select(F.lit("journal").alias("change_source"), "volume", F.col("usn").cast("string").alias("item")).union(
        files.select(F.lit("listing"), F.substring("path", 1, 2), "path")
    )


def p1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, journal_id, state, token, upto, expired): where the ledger stands with each journal."""
    states = fold(cursor_events(table(spark, sf_dir, "usn_cursors")))
    parts = F.split("unit", r"\|")
    expired = (F.col("state") == LEASED) & (F.col("expires_ms") < takeover(table(spark, sf_dir, "usn_cursors")))
    return states.select(parts[1].alias("volume"), parts[2].cast("long").alias("journal_id"), "state", "token", "upto", expired.alias("expired"))


P1_LEDGER_SQL = """
WITH c AS (SELECT DISTINCT * FROM usn_cursors WHERE volume IS NOT NULL AND journal_id IS NOT NULL),
top AS (SELECT volume, journal_id, run_id, run_status FROM c QUALIFY row_number() OVER (PARTITION BY volume, journal_id ORDER BY run_id DESC, CASE run_status WHEN 'committed' THEN 2 WHEN 'running' THEN 1 ELSE 0 END DESC) = 1)
SELECT t.volume, t.journal_id, CASE t.run_status WHEN 'committed' THEN 'done' WHEN 'running' THEN 'leased' ELSE 'pending' END AS state, t.run_id AS token,
  (SELECT max(next_usn) FROM c WHERE c.volume = t.volume AND c.journal_id = t.journal_id AND c.run_status = 'committed') AS upto, t.run_status = 'running' AS expired
FROM top t
"""


P1_SQL = r"""
WITH d AS (
  SELECT CASE WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END AS path, mtime, size, seen_at FROM disk_listing
), now AS (
  SELECT path, mtime, size FROM d WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, mtime DESC, size DESC) = 1
), stored AS (
  SELECT path, mtime, size FROM indexed_files WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, mtime DESC, size DESC) = 1
)
SELECT DISTINCT 'journal' AS change_source, j.volume AS volume, CAST(j.usn AS VARCHAR) AS item
FROM usn_journal j
WHERE j.usn IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM usn_cursors c WHERE c.run_status = 'committed' AND c.volume = j.volume AND c.journal_id = j.journal_id AND c.next_usn > j.usn)
UNION ALL
SELECT 'listing', substr(n.path, 1, 2), n.path
FROM now n LEFT JOIN stored s ON n.path = s.path
WHERE s.path IS NULL OR n.mtime IS DISTINCT FROM s.mtime OR n.size IS DISTINCT FROM s.size
"""


def cursor_usable(cursor: dict | str | None, journal_id: int, lowest_valid_usn: int) -> bool:
    """Whether a stored cursor may be resumed: the same journal, and nothing before it has been discarded."""
    if isinstance(cursor, str):
        cursor = json.loads(cursor)
    return bool(cursor) and cursor.get("journal_id") == journal_id and (cursor.get("next_usn") or 0) >= lowest_valid_usn


def usable(next_usn: Column, journal_id: Column, present_id: Column, lowest_valid_usn: Column) -> Column:
    """``cursor_usable`` over columns; never null."""
    return F.coalesce((journal_id == present_id) & (next_usn >= lowest_valid_usn), F.lit(False))


def safe_cursors(runs: DataFrame) -> DataFrame:
    """(volume, journal_id, safe): how far each journal may be taken as done, from (volume, journal_id, run_id, next_usn, done).

    Cursors advance in the order of the runs and never past one that hasn't been committed; null where the first run hasn't.
    """
    first = runs.groupBy("volume", "journal_id").agg(F.min(F.when(~F.coalesce("done", F.lit(False)), F.col("run_id"))).alias("_open"))
    whole = small_join(runs, first, ["volume", "journal_id"], "inner", null_safe=True)
    settled = F.col("done") & (F.col("_open").isNull() | (F.col("run_id") < F.col("_open")))
    return whole.groupBy("volume", "journal_id").agg(F.max(F.when(settled, F.col("next_usn"))).alias("safe"))
