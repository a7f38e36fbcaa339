"""Change journals: decoding binary records and turning records into file operations."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import Scratch, small_join

# Bits of a record's reason, and the layout of a version 2 record (60 bytes, then the name in UTF-16).
FILE_CREATE, FILE_DELETE, RENAME_OLD, RENAME_NEW, DIRECTORY = 0x100, 0x200, 0x1000, 0x2000, 0x10
LAYOUT = struct.Struct("<IHHQQqqIIIIHH")
RECORD = "usn long, frn long, parent_frn long, name string, is_dir boolean, file_create boolean, file_delete boolean, rename_old_name boolean, rename_new_name boolean"


def decode(raw: bytes | None) -> dict | None:
    """A record as a row, or None if it is cut short, of another version, or its name lies outside it."""
    if not raw or len(raw) < LAYOUT.size:
        return None
    length, major, _, frn, parent, usn, _, reason, _, _, attributes, size, offset = LAYOUT.unpack_from(raw)
    if major != 2 or length > len(raw) or offset + size > len(raw) or size % 2:
        return None
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    bits = {"file_create": FILE_CREATE, "file_delete": FILE_DELETE, "rename_old_name": RENAME_OLD, "rename_new_name": RENAME_NEW}
    return {
        "usn": usn, "frn": signed(frn), "parent_frn": signed(parent), "name": raw[offset : offset + size].decode("utf-16-le", "replace"),
        "is_dir": bool(attributes & DIRECTORY),
    } | {k: bool(reason & b) for k, b in bits.items()}


def encode(row: dict) -> bytes:
    """A row as a binary record, of which ``decode`` makes the row again; what is null is 0, empty or not set."""
    name = (row.get("name") or "").encode("utf-16-le")
    bits = {"file_create": FILE_CREATE, "file_delete": FILE_DELETE, "rename_old_name": RENAME_OLD, "rename_new_name": RENAME_NEW}
    reason = sum(b for k, b in bits.items() if row.get(k))
    unsigned = lambda n: int(n or 0) % (1 << 64)
    head = LAYOUT.pack(LAYOUT.size + len(name), 2, 0, unsigned(row["frn"]), unsigned(row.get("parent_frn")), int(row["usn"]), 0, reason, 0, 0, DIRECTORY if row.get("is_dir") else 0, len(name), LAYOUT.size)
    return head + name


def decoded(raw: DataFrame, column: str = "record") -> DataFrame:
    """Rows of all decodable records of a binary column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            yield pd.DataFrame([d for r in batch[column] if (d := decode(None if r is None else bytes(r)))], columns=names)

    return raw.select(column).mapInPandas(run, RECORD)


@dataclass
class Translator:
    """Turns one volume's records, in order, into (op, path): the tree is updated first, so paths are those after the record.

    A rename's old name waits for its new name; a delete in between removes the old path; a new name alone is an upsert. Records out of scope
    give nothing, a move out of scope removes the old path. ``tree`` has frn -> (parent, name, is_dir), ``anchors`` frn -> root path.
    """

    anchors: dict[int, str]
    tree: dict[int, tuple[int, str, bool]] = field(default_factory=dict)
    pending: dict[int, str | None] = field(default_factory=dict)
    separator: str = "\\"

    def path(self, frn: int, most: int = 512) -> str | None:
        names: list[str] = []
        for _ in range(most):
            if frn in self.anchors:
                return self.separator.join([self.anchors[frn], *reversed(names)])
            if frn not in self.tree:
                return None
            parent, name, _ = self.tree[frn]
            names.append(name)
            frn = parent
        return None

    def one(self, r: dict) -> list[tuple[str, str]]:
        frn, place = r["frn"], (r["parent_frn"], r["name"], bool(r["is_dir"]))
        tree_op = lambda op, is_dir: f"{op}_tree" if is_dir else op
        if r["file_delete"]:
            before = self.path(frn)
            old = self.pending.pop(frn, None) or before
            is_dir = self.tree.pop(frn, place)[2]
            if old is None:
                self.tree[frn] = place
                old = self.path(frn)
                del self.tree[frn]
            return [(tree_op("remove", is_dir), old)] if old else []
        if r["rename_old_name"]:
            self.pending[frn] = self.path(frn)
            if self.pending[frn] is None:
                self.tree.setdefault(frn, place)
                self.pending[frn] = self.path(frn)
            return []
        if r["rename_new_name"]:
            old = self.pending.pop(frn, None)
            self.tree[frn] = place
            new = self.path(frn)
            if old == new:
                return []
            return ([(tree_op("remove", place[2]), old)] if old else []) + ([(tree_op("upsert", place[2]), new)] if new else [])
        if r["file_create"]:
            self.pending.pop(frn, None)  # the number is used again
        self.tree[frn] = place
        new = self.path(frn)
        return [(tree_op("upsert", place[2]), new)] if new else []

    def all(self, records: Iterable[dict]) -> list[tuple[str, str]]:
        return [x for r in records for x in self.one(r)]


FLAGS = ("file_create", "file_delete", "rename_old_name", "rename_new_name")


def _versions(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(volume, frn, since, until, parent, name, is_dir): each place an entry has had and when, in half steps: a record's effect begins at twice its usn.

    A deletion ends the present place. The record of an old name gives a place only to an entry that has none.
    """
    known = entries.where(F.col("frn").isNotNull()).select("volume", "frn", F.lit(-2).cast("long").alias("since"), F.col("parent_frn").alias("parent"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.lit("set").alias("action"))
    action = F.when(F.col("file_delete"), "gone").when(F.col("rename_old_name"), "weak").otherwise("set")
    made = records.select("volume", "frn", (F.col("usn") * 2).alias("since"), F.col("parent_frn").alias("parent"), F.coalesce("name", F.lit("")).alias("name"), "is_dir", action.alias("action"))
    order = W.partitionBy("volume", "frn").orderBy("since")
    before = F.lag("action").over(order)
    kept = known.unionByName(made).withColumn("_before", before).where((F.col("action") != "weak") | F.col("_before").isNull() | (F.col("_before") == "gone"))
    return kept.withColumn("until", F.lead("since").over(order)).where(F.col("action") != "gone").drop("action", "_before")


def paths_at(asked: DataFrame, versions: DataFrame, anchors: DataFrame, scratch: Scratch, most: int = 512) -> DataFrame:
    """(key, path) of asked (key, volume, at, t, tail): the path of an entry at a time, with ``tail`` below it; none where the chain of parents
    doesn't reach an anchor. One round a level for all rows at once; rows that are through, or have no parent, drop out. A row on a loop meets the
    entry that it was at when the number of rounds last was a power of two, and drops out then."""
    tops = anchors.where(F.col("frn").isNotNull()).groupBy("volume", F.col("frn").alias("at")).agg(F.max("root_path").alias("root_path"))
    active, done = asked.withColumn("start", F.col("at")), None
    for n in range(1, most + 1):
        marked = scratch.keep(small_join(active, tops, ["volume", "at"]))
        through = marked.where(F.col("root_path").isNotNull()).select("key", F.when(F.col("tail") == "", F.col("root_path")).otherwise(F.concat_ws("\\", "root_path", "tail")).alias("path"))
        done = through if done is None else done.unionByName(through)
        left = marked.where(F.col("root_path").isNull()).drop("root_path")
        if left.isEmpty():
            break
        v = versions.select(F.col("volume").alias("_v"), F.col("frn").alias("_f"), "since", "until", "parent", "name")
        fits = (F.col("volume") == F.col("_v")) & (F.col("at") == F.col("_f")) & (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("until") > F.col("t")))
        up = left.join(v, fits).where(F.col("parent").isNotNull() & (F.col("parent") != F.col("start")))
        active = up.select("key", "volume", F.col("parent").alias("at"), "t", F.when(F.col("tail") == "", F.col("name")).otherwise(F.concat_ws("\\", "name", "tail")).alias("tail"), F.col("parent").alias("start") if n & (n - 1) == 0 else F.col("start"))
    return done


def translated(journal: DataFrame, entries: DataFrame, anchors: DataFrame, scratch: Scratch) -> DataFrame:
    """(volume, seq, op, path): file operations of journal records, as ``Translator`` gives them record by record, for all volumes at once.

    ``entries`` is the tree before the first record, ``anchors`` the registered roots; records outside their trees give nothing. The tree at each
    record is a table of versions, so records need no single reader; of a rename the removal comes before the upsert (seq is twice the usn,
    and one more). Repeated deliveries count once; rows without usn or frn don't count.
    """
    flag = lambda n: F.coalesce(F.max(F.coalesce(F.col(f"reason.{n}"), F.lit(False)).cast("int")), F.lit(0)).cast("boolean").alias(n)
    rows = journal.where(F.col("usn").isNotNull() & F.col("frn").isNotNull()).groupBy("volume", "usn", "frn")
    records = scratch.keep(rows.agg(F.max("parent_frn").alias("parent_frn"), F.max("name").alias("name"), F.coalesce(F.max("is_dir"), F.lit(False)).alias("is_dir"), *map(flag, FLAGS)).withColumn("id", F.monotonically_increasing_id()))
    versions = scratch.keep(_versions(records, entries))
    gone, old, new = F.col("file_delete"), ~F.col("file_delete") & F.col("rename_old_name"), ~F.col("file_delete") & ~F.col("rename_old_name") & F.col("rename_new_name")
    # three questions a record at most: where it is after the record; for deletions where it was, and where the record's own place is
    after = records.where(~gone).select((F.col("id") * 4).alias("key"), "volume", F.col("frn").alias("at"), (F.col("usn") * 2).alias("t"), F.lit("").alias("tail"))
    before = records.where(gone).select((F.col("id") * 4 + 1).alias("key"), "volume", F.col("frn").alias("at"), (F.col("usn") * 2 - 1).alias("t"), F.lit("").alias("tail"))
    own = records.where(gone & F.col("parent_frn").isNotNull()).select((F.col("id") * 4 + 2).alias("key"), "volume", F.col("parent_frn").alias("at"), (F.col("usn") * 2 - 1).alias("t"), F.coalesce("name", F.lit("")).alias("tail"))
    found = scratch.keep(paths_at(after.unionByName(before).unionByName(own), versions, anchors, scratch))
    named = found.groupBy(F.floor(F.col("key") / 4).alias("id")).agg(*[F.max(F.when(F.col("key") % 4 == k, F.col("path"))).alias(n) for k, n in ((0, "after"), (1, "before"), (2, "own"))])
    whole = records.join(named, "id", "left")
    order = W.partitionBy("volume", "frn").orderBy("usn")
    # an old name waits for the next record that settles it
    turn = F.when(gone | old | new | F.col("file_create"), F.struct(old.alias("waits"), F.col("after").alias("path")))
    last = F.last(turn, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    settled = whole.withColumn("_last", last).withColumn("pending", F.when(F.col("_last.waits"), F.col("_last.path")))
    was_dir = versions.select("volume", "frn", F.col("until").alias("_until"), F.col("is_dir").alias("_was"))
    settled = settled.join(was_dir.where(F.col("_until").isNotNull()).withColumn("usn", F.floor(F.col("_until") / 2)).drop("_until"), ["volume", "frn", "usn"], "left")
    tree = lambda op, is_dir: F.when(is_dir, op + "_tree").otherwise(op)
    removed = F.when(gone, F.coalesce("pending", "before", "own")).when(new & ~F.col("pending").eqNullSafe(F.col("after")), F.col("pending"))
    added = F.when(new & F.col("pending").eqNullSafe(F.col("after")), None).when(~gone & ~old, F.col("after"))
    both = F.array(
        F.struct((F.col("usn") * 2).alias("seq"), tree("remove", F.when(gone, F.coalesce("_was", "is_dir")).otherwise(F.col("is_dir"))).alias("op"), removed.alias("path")),
        F.struct((F.col("usn") * 2 + 1).alias("seq"), tree("upsert", F.col("is_dir")).alias("op"), added.alias("path")),
    )
    return settled.select("volume", F.explode(both).alias("x")).select("volume", "x.*").where(F.col("path").isNotNull())


def rename_pairs(journal: DataFrame) -> DataFrame:
    """(volume, frn, old_usn, new_usn, old_name, new_name): each old-name record with the next rename record of its file, if that has the new name.

    Only rename records are windowed; a file's renames are few, however many records it has.
    """
    flag = lambda n: F.coalesce(F.col(f"reason.{n}"), F.lit(False))
    rows = journal.where(F.col("usn").isNotNull() & F.col("frn").isNotNull() & (flag("rename_old_name") | flag("rename_new_name")))
    one = rows.groupBy("volume", "frn", "usn").agg(F.max(flag("rename_old_name").cast("int")).alias("old"), F.max(flag("rename_new_name").cast("int")).alias("new"), F.max("name").alias("name"))
    order = W.partitionBy("volume", "frn").orderBy("usn")
    near = one.withColumn("new_usn", F.lead("usn").over(order)).withColumn("is_new", F.lead("new").over(order)).withColumn("new_name", F.lead("name").over(order))
    return near.where((F.col("old") == 1) & (F.col("new") == 0) & (F.col("is_new") == 1)).select("volume", "frn", F.col("usn").alias("old_usn"), "new_usn", F.col("name").alias("old_name"), "new_name")


class CursorTracker:
    """The cursor that may be stored: advanced when batches commit, in the order in which they were received, never ahead of them."""

    def __init__(self, start: int):
        self.safe = start
        self.received: list[tuple[int, bool]] = []

    def receive(self, next_usn: int) -> int:
        self.received.append((next_usn, False))
        return len(self.received) - 1

    def commit(self, ticket: int) -> int:
        self.received[ticket] = (self.received[ticket][0], True)
        for usn, done in self.received:
            if not done:
                break
            self.safe = max(self.safe, usn)
        return self.safe
