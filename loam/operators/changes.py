"""Keeping an index current: quiet-window batches, coalescing, upserts, tree operations, reconciling and orphans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions.paths import excluded, under

#: Quiet time that closes a batch, and distinct paths that close it at once.
QUIET, HIGH_WATER = "500 milliseconds", 5000


def translate(kind: Column, is_dir: Column, exists: Column) -> Column:
    """A raw file-system event as an operation; null for events that change nothing."""
    k = F.lower(kind)
    return (
        F.when(k.isin("create", "modify", "rename_to"), F.when(is_dir, "upsert_tree").otherwise("upsert"))
        .when(k == "remove_file", "remove")
        .when(k.isin("remove", "remove_dir", "remove_other"), "remove_tree")
        .when(k == "rename_from", F.when(is_dir, "remove_tree").otherwise("remove"))
        .when(k == "any", F.when(exists, F.when(is_dir, "upsert_tree").otherwise("upsert")).otherwise("remove_tree"))
    )


def split_renames(events: DataFrame, scope: Column | None = None) -> DataFrame:
    """(seq, path, op): a rename becomes a removal of its old path and an upsert of its new one, each only if in scope.

    ``events`` has seq, path, to_path and op. ``scope`` is a predicate over ``path``. Rows without a path or operation are dropped.
    """
    both = F.array(F.struct(F.col("path").alias("path"), F.lit("remove").alias("op")), F.struct(F.col("to_path").alias("path"), F.lit("upsert").alias("op")))
    one = F.array(F.struct(F.col("path").alias("path"), F.col("op").alias("op")))
    out = events.select("seq", F.explode(F.when(F.col("op") == "rename", both).otherwise(one)).alias("x")).select("seq", "x.path", "x.op")
    out = out.where(F.col("path").isNotNull() & F.col("op").isNotNull())
    return out.where(scope) if scope is not None else out


def coalesce(changes: DataFrame, *by: str) -> DataFrame:
    """(by, path, op): the last operation of each path (by seq; of equal seqs the greater name). A partial aggregate."""
    return changes.groupBy(*by, "path").agg(F.max(F.struct("seq", "op")).alias("_l")).select(*by, "path", "_l.op")


def quiet_batches(events: DataFrame, ts: str, quiet_seconds: float, seq: str = "seq", path: str | None = None, high_water: int = HIGH_WATER) -> DataFrame:
    """Adds ``batch``: events that follow each other within the quiet time belong together. With ``path`` a batch also closes with the event
    that brings it to ``high_water`` distinct paths; the next event begins another one.

    The quiet time is global, so batches are found over one sorted column. Only the timestamps of batch starts are numbered in one task;
    the events themselves are cut to days first and stay distributed.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    day = F.floor(micros / F.lit(86_400_000_000)).alias("_day")
    rows = events.withColumn("_us", micros).withColumn("_day", day)
    within = W.partitionBy("_day").orderBy("_us", seq)
    days = rows.groupBy("_day").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    # one row a day: whether it begins a batch depends on the day before only
    carried = days.select("_day", F.lag("_last").over(W.orderBy("_day")).alias("_before"))
    near = rows.join(carried, "_day").withColumn("_gap", F.col("_us") - F.coalesce(F.lag("_us").over(within), F.col("_before")))
    starts = near.withColumn("_new", (F.col("_gap").isNull() | (F.col("_gap") > int(quiet_seconds * 1e6))).cast("long"))
    per_day = starts.groupBy("_day").agg(F.sum("_new").alias("_n"))
    offset = per_day.select("_day", F.coalesce(F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    numbered = starts.withColumn("_run", F.sum("_new").over(within)).join(offset, "_day")
    numbered = numbered.withColumn("batch", (F.col("_off") + F.col("_run")).cast("long"))
    if path is not None:
        numbered = closed_at(numbered, "_us", seq, path, high_water)
    return numbered.drop("_us", "_day", "_before", "_gap", "_new", "_run", "_off")


def closed_at(events: DataFrame, us: str, seq: str, path: str, high_water: int) -> DataFrame:
    """The events with ``batch`` numbered anew, each batch also divided wherever it reaches ``high_water`` distinct paths.

    Where a batch closes depends on all of it before, so a batch with that many paths is read in order by one task, which remembers
    the open batch's paths only (at most ``high_water``); what comes back is one row a close. Events equal in time and seq stay together.
    Batches with fewer paths aren't touched but for their number.
    """
    sizes = events.where(F.col(path).isNotNull()).groupBy("batch", path).agg(F.lit(1).alias("_1")).groupBy("batch").agg(F.count(F.lit(1)).alias("_n"))
    full = sizes.where(F.col("_n") >= high_water).select("batch")
    if full.isEmpty():
        return events
    rows = events.join(full, "batch", "left_semi").select("batch", F.col(us).alias("us"), F.col(seq).cast("long").alias("seq"), F.col(path).cast("string").alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, held, at, waiting, closes, out = None, set(), None, False, 0, []
        for part in batches:
            for b, us, s, p in zip(part["batch"], part["us"], part["seq"], part["path"]):
                if b != batch:
                    batch, held, waiting, closes = b, set(), False, 0
                elif waiting and (us, s) != at:
                    held, waiting, closes = set(), False, closes + 1
                    out.append((b, us, s, closes))
                at = (us, s)
                if p is not None:
                    held.add(p)
                waiting = len(held) >= high_water
            yield pd.DataFrame(out, columns=["batch", "_fus", "_fseq", "_k"])
            out = []

    starts = rows.repartition("batch").sortWithinPartitions("batch", "us", "seq").mapInPandas(run, "batch long, _fus long, _fseq long, _k long")
    on = (F.col("batch") == F.col("_b")) & (F.col(us) == F.col("_fus")) & (F.col(seq) == F.col("_fseq"))
    flagged = events.join(full, "batch", "left_semi").join(starts.withColumnRenamed("batch", "_b"), on, "left").drop("_b", "_fus", "_fseq")
    own = F.coalesce(F.max("_k").over(W.partitionBy("batch").orderBy(us, seq)), F.lit(0))
    parts = flagged.withColumn("_own", own).drop("_k").unionByName(events.join(full, "batch", "left_anti").withColumn("_own", F.lit(0).cast("long")))
    # one row a batch: its number moves by the closes in all batches before it
    closes = events.select("batch").distinct().join(starts.groupBy("batch").agg(F.max("_k").alias("_c")), "batch", "left")
    moved = closes.select("batch", F.coalesce(F.sum("_c").over(W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_moved"))
    return parts.join(moved, "batch").withColumn("batch", F.col("batch") + F.col("_moved") + F.col("_own")).drop("_moved", "_own")


def upsert(index: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """The index with ``rows`` in the place of those of the same key. Of rows with one key the last by all columns counts; null keys are dropped."""
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[c for c in index.columns if c != key])).alias("_r"))
    new = new.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in index.columns])
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def remove_trees(index: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """The index without what lies at or below the roots, by plain prefix tests that are pushed to the scan."""
    for r in roots:
        index = index.where(~under(F.col(path), r))
    return index


def apply_changes(index: DataFrame, changes: DataFrame, listing: DataFrame) -> DataFrame:
    """The index after coalesced (path, op): upserts take their row from ``listing``, tree operations everything below their path.

    Tree operations are matched by exploding each file's ancestors and joining on equality, so no prefix join over all pairs is needed.
    """
    trees = changes.where(F.col("op").isin("upsert_tree", "remove_tree"))
    single = changes.where(F.col("op").isin("upsert", "remove")).select("path")
    gone = below(index, trees).select("path").union(single).distinct()
    fresh = rows_for(listing, changes)
    return index.join(gone.unionByName(fresh.select("path")).distinct(), "path", "left_anti").unionByName(fresh.select(*index.columns))


def below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The files at or below the paths of ``roots``, one a path. Only paths are multiplied by their ancestors; rows are fetched for those that lie below."""
    tops = roots.select(F.col("path").alias("_root")).distinct()
    hits = files.select("path", F.explode(ancestors(F.col("path"))).alias("_root")).join(tops, "_root", "left_semi").select("path").distinct()
    return files.join(hits, "path", "left_semi").dropDuplicates(["path"])


def rows_for(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of ``listing`` that (path, op) ask for: those of upserted paths, and of upserted trees all at or below their path."""
    single = listing.join(changes.where("op = 'upsert'").select("path"), "path", "left_semi")
    return below(listing, changes.where("op = 'upsert_tree'")).unionByName(single).dropDuplicates(["path"])


def ancestors(path: Column) -> Column:
    """A path and all directories above it, for either separator."""

    def chain(sep: str) -> Column:
        parts = F.split(path, "[" + sep.replace("\\", "\\\\") + "]")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))

    return F.when(path.contains("\\"), chain("\\")).otherwise(chain("/"))


def drained(changes: DataFrame, by: str) -> DataFrame:
    """Coalesced changes with their ``position`` in the order in which a batch is handed over: by path."""
    return changes.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy("path")).cast("long"))


def requeued(pending: DataFrame, failed: DataFrame) -> DataFrame:
    """(path, op): pending changes and those of a batch that failed; an older change never replaces a newer one of its path."""
    return pending.select("path", "op").unionByName(failed.select("path", "op").join(pending.select("path"), "path", "left_anti"))


def reconcile(index: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, change): what to do so that the index shows the listing. Stats are compared null-safely; unchanged files are left out."""
    a = index.where(F.col("path").isNotNull()).select("path", F.struct("mtime", "size").alias("_i")).dropDuplicates(["path"])
    b = listing.where(F.col("path").isNotNull()).select("path", F.struct("mtime", "size").alias("_l")).dropDuplicates(["path"])
    change = F.when(F.col("_i").isNull(), "added").when(F.col("_l").isNull(), "removed").when(~F.col("_i").eqNullSafe(F.col("_l")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def orphans(index: DataFrame, roots: list[str]) -> DataFrame:
    """Paths that lie under no root; none if there are no roots."""
    if not roots:
        return index.select("path").limit(0)
    inside = F.lit(False)
    for r in roots:
        inside |= under(F.col("path"), r)
    return index.where(~inside).select("path")


def allowed(files: DataFrame, rules: dict, relative: str = "relative") -> DataFrame:
    """The files that index rules let in: no excluded or hidden directory on the way."""
    return files.where(~excluded(F.col(relative), rules.get("exclude_dirs", ())))


def outcomes(files: DataFrame, extractable: Column, max_bytes: int) -> DataFrame:
    """One row (indexed, skipped, skipped_oversize): oversize files are among the skipped."""
    over = F.col("size") > max_bytes
    return files.agg(
        F.count_if(extractable & ~over & (F.col("size") > 0)).alias("indexed"),
        F.count_if(~(extractable & ~over & (F.col("size") > 0))).alias("skipped"),
        F.count_if(extractable & over).alias("skipped_oversize"),
    )


def cached_content(images: DataFrame, processed: DataFrame) -> DataFrame:
    """Images with the recognised text that was stored for exactly their (path, mtime, size); null where there is none."""
    best = processed.groupBy("path", "mtime", "size").agg(F.max("content").alias("cached"))
    return images.join(best, ["path", "mtime", "size"], "left")


def compact_queue(queue: DataFrame, roots: list[str], existing: DataFrame) -> DataFrame:
    """Queue entries that lie under a root and still exist."""
    inside = F.lit(False)
    for r in roots:
        inside |= under(F.col("path"), r)
    return queue.where(inside).join(existing.select("path").distinct(), "path", "left_semi")


def nested_roots(roots: list[str]) -> list[tuple[str, str]]:
    """(outer, inner) of roots that lie within one another."""
    norm = {r: tuple(p for p in r.replace("\\", "/").rstrip("/").split("/")) for r in roots}
    return [(a, b) for a in roots for b in roots if a != b and norm[b][: len(norm[a])] == norm[a]]


def recent_searches(history: DataFrame, most: int = 10) -> DataFrame:
    """(q, at): the last distinct searches, trimmed, newest first."""
    trimmed = history.select(F.trim("q").alias("q"), "at").where(F.col("q") != "")
    return trimmed.groupBy("q").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "q").limit(most)
