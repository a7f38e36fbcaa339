"""The index as segments that are written once, with numbered states that name the present ones, and JSON sidecars beside them."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.folder import Folder, Pointers, retried
from loam.operators.changes import ancestors
from loam.plans import segment as G
from loam.plans.searcher import Searcher
from loam.session import small_join, spread

SCHEMA_VERSION = 6
FILES = "path string, name string, ext string, content string, mtime long, size long, kind string"
COLUMNS = [c.split()[0] for c in FILES.split(", ")]
# Default rules.
RULES = {"exclude_dirs": ["node_modules", "target", ".git", ".venv", "__pycache__"], "extra_text_exts": [], "max_file_mb": 20}
EMPTY = {"roots": [], "cursors": {}, "streams": {}, "segments": [], "deletes": [], "version": 0, "outcome": {}}
#: Segments that an index has at most before the smallest are merged into one.
FAN = 8
#: How long a folder that no state names may belong to a change under way.
UNUSED_MS = 3_600_000


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")


class StoreError(RuntimeError):
    """The index is missing or of another schema version."""


class Store:
    """One index below ``root``: ``segments``, ``deletes``, the numbered states ``meta-<n>.json`` and ``rules.json``.

    A state names the segments, the deletions, the roots, cursors and how far each stream has come. A change writes a segment of the new rows
    and the numbers of the deleted ones, nothing else, and then publishes the next state; there is always a readable one. Readers keep
    the state that they opened. What no kept state names is removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)
        self.pointers = Pointers(self.folder, "meta")

    def read_json(self, name: str) -> dict | None:
        """A sidecar, or None if it is missing or can't be read."""
        if not self.folder.exists(name):
            return None
        try:
            return json.loads(self.folder.read(name).decode())
        except Exception:  # broken contents and broken checksums alike
            return None

    def write_json(self, name: str, value: dict) -> None:
        """Replaces a sidecar in one step, so that readers never see half of it or none."""
        self.folder.replace(name, json.dumps(value, ensure_ascii=False).encode())

    def _state(self) -> tuple[int, dict | None]:
        n, state = self.pointers.last()
        return n, state if n else self.read_json("meta.json")  # the form of older versions

    def exists(self) -> bool:
        return self._state()[1] is not None

    def meta(self) -> dict:
        """The index's metadata; a missing index or another schema version is an error that asks for a rebuild."""
        meta = self._state()[1]
        if meta is None:
            raise StoreError("there is no index here; build one first")
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise StoreError(f"the index has schema version {meta.get('schema_version')}, this program has {SCHEMA_VERSION}; rebuild it")
        return EMPTY | meta

    def update(self, change) -> dict:
        """Publishes ``change(state)`` as the next state; begun anew from the newer state if another writer came first."""

        def once() -> dict:
            n, state = self._state()
            state = EMPTY | (state if state and state.get("schema_version") == SCHEMA_VERSION else {})
            after = change(dict(state)) | {"schema_version": SCHEMA_VERSION}
            self.pointers.advance(n, after)
            return after

        return retried(once)

    def rules(self) -> dict:
        """Index rules; missing or broken ones are the defaults, and missing entries are filled in."""
        return RULES | {k: v for k, v in (self.read_json("rules.json") or {}).items() if k in RULES}

    def set_rules(self, **changes) -> dict:
        """Replaces the given lists only, trimmed and without doubles; a size limit is at least 1 MB. They take effect with a rebuild."""
        rules = self.rules()
        for key, value in changes.items():
            if value is None:
                continue
            if key == "max_file_mb":
                rules[key] = max(1, int(value))
            else:
                clean = [x.strip() for x in value if x.strip()]
                rules[key] = list(dict.fromkeys([x.lower().lstrip(".") for x in clean] if key == "extra_text_exts" else clean))
        self.write_json("rules.json", rules)
        return rules

    def _deleted(self, meta: dict) -> tuple[DataFrame | None, dict]:
        """(seg, part, doc) of deleted files by the segment's place, and what they take from the totals."""
        ids = [s["id"] for s in meta["segments"]]
        used = [d for d in meta["deletes"] if any(s in ids for s in d["lost"])]
        lost = {k: sum(d["lost"][s][k] for d in used for s in d["lost"] if s in ids) for k in ("n", "name", "content")}
        if not used:
            return None, lost
        rows = self.spark.read.schema("segment string, part long, doc long").parquet(*[f"{self.root}/deletes/{d['id']}" for d in used])
        place = F.array_position(F.array(*[F.lit(s) for s in ids]), F.col("segment")).cast("int") - 1
        return rows.select(place.alias("seg"), "part", "doc").where("seg >= 0"), lost

    def _segments(self, meta: dict) -> list[G.Segment]:
        return [G.Segment(f"{self.root}/segments/{s['id']}", s["n"], s["name"], s["content"], s["buckets"], s["shards"]) for s in meta["segments"]]

    def searcher(self, meta: dict | None = None) -> Searcher:
        """A reader of the present state; another one is needed to see later changes."""
        meta = meta or self.meta()
        deleted, lost = self._deleted(meta)
        return Searcher(self.spark, self._segments(meta), deleted, lost)

    def files(self) -> DataFrame:
        rows = self.searcher().files()
        return rows.select(COLUMNS) if rows is not None else self.spark.createDataFrame([], FILES)

    def _write(self, rows: DataFrame) -> dict | None:
        """A new segment of the rows, of which those without a path are dropped; None if there are none."""
        name = uuid.uuid4().hex[:16]
        made = G.build(spread(rows.select(COLUMNS).where(F.col("path").isNotNull())), f"{self.root}/segments/{name}")
        if not made.n:
            self.folder.delete(f"segments/{name}")
            return None
        return {"id": name, "n": made.n, "name": made.name, "content": made.content, "buckets": made.buckets, "shards": made.shards}

    def replace(self, files: DataFrame, roots: list[str] | None = None) -> int:
        """Makes the rows the whole index, as one segment; returns the index's version."""
        made = self._write(files)
        after = self.update(lambda s: s | {"segments": [made] if made else [], "deletes": [], "roots": s["roots"] if roots is None else roots, "version": s["version"] + 1, "updated": now()})
        self.vacuum()
        return after["version"]

    def apply(self, changes: DataFrame, rows: DataFrame, tag: tuple[str, int] | None = None) -> int:
        """Applies one batch of coalesced (path, op): removals, upserts, and both for all that lies at or below a path; ``rows`` are the new
        rows of upserted paths and trees. Returns the index's version.

        ``tag`` is (stream, number of its batch): a batch that the stream has applied before changes nothing. Counts of upserted, removed and
        skipped files are kept with the state: removed are files that were there and have no new row, skipped are upserts without a row.
        """
        meta = self.meta()
        if tag and meta["streams"].get(tag[0], -1) >= tag[1]:
            return meta["version"]
        new = rows.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct(*COLUMNS[1:])).alias("_r")).select("path", "_r.*").select(COLUMNS)
        made = self._write(new)
        fresh = self.spark.read.parquet(f"{self.root}/segments/{made['id']}/files").select("path") if made else self.spark.createDataFrame([], "path string")
        reader = self.searcher(meta)
        deletion, counts = None, {"upserted": made["n"] if made else 0, "removed": 0, "skipped": changes.where("op = 'upsert'").select("path").distinct().join(fresh, "path", "left_anti").count()}
        if meta["segments"]:
            there = reader.files().select("seg", "doc", "path")
            tops = changes.where(F.col("op").isin("remove_tree", "upsert_tree")).select(F.col("path").alias("_root")).distinct()
            below = small_join(there.select("seg", "doc", "path", F.explode(ancestors(F.col("path"))).alias("_root")), tops, ["_root"], "inner").select("seg", "doc", "path")
            single = changes.where(F.col("op").isin("remove", "upsert")).select("path").union(fresh).distinct()
            doomed = below.union(there.join(single, "path", "left_semi").select("seg", "doc", "path")).distinct()
            deletion = self._delete(meta, doomed)
            if deletion:
                counts["removed"] = doomed.join(fresh, "path", "left_anti").count()

        def change(state: dict) -> dict:
            if state["segments"] != meta["segments"] or state["deletes"] != meta["deletes"]:
                raise StoreError("the index was changed by another writer during this change; apply it again")
            streams = state["streams"] | ({tag[0]: tag[1]} if tag else {})
            return state | {"segments": state["segments"] + ([made] if made else []), "deletes": state["deletes"] + ([deletion] if deletion else []), "streams": streams, "version": state["version"] + 1, "outcome": counts, "updated": now()}

        after = self.update(change)
        if len(after["segments"]) > FAN:
            self.merge()
        return after["version"]

    def outcome(self) -> dict:
        """(upserted, removed, skipped) of the last applied batch."""
        return self.meta()["outcome"]

    def _delete(self, meta: dict, doomed: DataFrame) -> dict | None:
        """Writes which files of the present segments count no more, with their parts, from (seg, doc, ...); None for none."""
        name, places = uuid.uuid4().hex[:16], None
        for k, reader in enumerate(self.searcher(meta).readers):
            zipped = F.explode(F.arrays_zip(F.col("ids").alias("doc"), F.col("names").alias("words_name"), F.col("tfs").alias("words_content"))).alias("x")
            one = reader.parts().select("part", zipped).select(F.lit(k).alias("seg"), F.lit(meta["segments"][k]["id"]).alias("segment"), "part", "x.*")
            places = one if places is None else places.union(one)
        found = places.join(doomed.select("seg", "doc"), ["seg", "doc"])
        found.select("segment", "part", "doc", "words_name", "words_content").write.option("compression", "zstd").parquet(f"{self.root}/deletes/{name}")
        sums = self.spark.read.parquet(f"{self.root}/deletes/{name}").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("words_name").alias("name"), F.sum("words_content").alias("content"))
        lost = {r.segment: {"n": r.n, "name": r.name, "content": r.content} for r in sums.collect()}  # a row a segment
        if not lost:
            self.folder.delete(f"deletes/{name}")
            return None
        return {"id": name, "lost": lost}

    def merge(self, keep: int | None = None) -> None:
        """Merges all but the ``keep`` largest segments (half of FAN) into one, without the deleted files. A file is so rewritten a few times at most,
        however many changes come after it."""
        keep = FAN // 2 if keep is None else keep
        meta = self.meta()
        order = sorted(meta["segments"], key=lambda s: s["n"], reverse=True)
        small = [s["id"] for s in order[keep:]]
        places = [k for k, s in enumerate(meta["segments"]) if s["id"] in small]
        made = self._write(self.searcher(meta).files().where(F.col("seg").isin(*places)))

        def change(state: dict) -> dict:
            if state["deletes"] != meta["deletes"]:
                raise StoreError("files were deleted by another writer during the merge; merge again")
            left = [s for s in state["segments"] if s["id"] not in small] + ([made] if made else [])
            ids = {s["id"] for s in left}
            return state | {"segments": left, "deletes": [d for d in state["deletes"] if ids & d["lost"].keys()]}

        self.update(change)
        self.vacuum()

    def vacuum(self) -> None:
        """Removes segments and deletions that none of the kept states names."""
        used = {"segments": set(), "deletes": set()}
        for n in self.pointers.numbers():
            state = self.read_json(self.pointers._name(n)) or {}
            for kind in used:
                used[kind] |= {x["id"] for x in state.get(kind, [])}
        for kind, ids in used.items():
            for name in self.folder.names(kind):
                if name not in ids and self.folder.age_ms(f"{kind}/{name}", int(time.time() * 1000)) > UNUSED_MS:
                    self.folder.delete(f"{kind}/{name}")
