"""Managing an index: building, adding, removing and rebuilding roots, reconciling with the disk, and status."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.changes import nested_roots, orphans, reconcile
from loam.operators.ledger import cursor_usable
from loam.plans.search import count_under
from loam.plans.segment import size_on_disk
from loam.session import Scratch
from loam.sources.extract import IMAGE_BYTES, Recogniser, documents, extractable, is_image, scan
from loam.sources.images import ImageQueue, drain
from loam.sources.store import FILES, Store, StoreError

OPS = "path string, op string"


def clean_root(root: str) -> str:
    """A root as it is stored: of a local path the longest ancestor that exists is resolved, links and dots included; others only lose a last separator."""
    root = root.rstrip("/\\") or root
    if "://" in root or not root.startswith(("/", ".", "~")):
        return root
    path = Path(root).expanduser().absolute()
    there = next((p for p in (path, *path.parents) if p.exists()), path)
    return str(there.resolve() / path.relative_to(there))


class Index:
    """An index in a folder. Documents are written before the roots that own them are registered, and roots are dropped before their documents.

    Recognised text of images is kept beside the index by path, time and size, so that a rebuild recognises no image again.
    """

    def __init__(self, spark: SparkSession, folder: str, recognise: Recogniser | None = None):
        self.spark, self.store, self.recognise = spark, Store(spark, folder), recognise
        self.queue = ImageQueue(spark, f"{self.store.root}/ocr")

    def listed(self, roots: list[str]) -> DataFrame:
        """What lies below the roots and may be indexed: (path, relative, name, ext, mtime, size), one row a path."""
        rules, out = self.store.rules(), None
        for r in roots:
            part = scan(self.spark, r, rules)
            out = part if out is None else out.unionByName(part)
        return out.dropDuplicates(["path"])

    def indexable(self, listed: DataFrame) -> DataFrame:
        rules = self.store.rules()
        text = extractable(F.col("ext"), tuple(rules["extra_text_exts"])) & (F.col("size") > 0) & (F.col("size") <= int(rules["max_file_mb"]) << 20)
        return listed.where(text | (is_image(F.col("ext")) & (F.col("size") <= IMAGE_BYTES)))

    def rows_of(self, listed: DataFrame) -> DataFrame:
        """Index rows of listed files; images take the text that was recognised before, and the others wait in the queue."""
        return documents(listed, self.store.rules(), self.recognise, self.queue.processed())

    def build(self, root: str) -> dict:
        """Builds the index anew from one root; other roots are forgotten."""
        began, root = time.time(), clean_root(root)
        rules, scratch = self.store.rules(), Scratch(self.spark, "listing")
        listed = scratch.keep(self.listed([root]))
        self.store.replace(self.rows_of(listed), roots=[root])
        limit = int(rules["max_file_mb"]) << 20
        seen = listed.agg(F.count(F.lit(1)).alias("n"), F.count_if(extractable(F.col("ext"), tuple(rules["extra_text_exts"])) & (F.col("size") > limit)).alias("over")).first()
        indexed = self.store.searcher().num_docs()
        self.queue.enqueue(listed)
        self.queue.compact([root], listed)
        return {"indexed": indexed, "skipped": seen.n - indexed, "skipped_oversize": seen.over, "seconds": time.time() - began}

    def add(self, root: str) -> dict:
        """Adds a root. A root that is there already is scanned again; one that lies within another, or holds one, is refused."""
        root = clean_root(root)
        if not self.store.exists():
            return self.build(root)
        roots = self.store.meta()["roots"]
        if root not in roots and (clash := nested_roots([*roots, root])):
            raise StoreError(f"{clash[0][1]} lies within {clash[0][0]}")
        listed = Scratch(self.spark, "listing").keep(self.listed([root]))
        self.store.apply(self.spark.createDataFrame([(root, "upsert_tree")], OPS), self.rows_of(listed))
        self.store.update(lambda s: s | {"roots": list(dict.fromkeys([*s["roots"], root]))})
        self.queue.enqueue(listed)
        return {"indexed": self.store.outcome()["upserted"]}

    def remove(self, root: str) -> dict:
        """Removes a root, which must be named exactly as it was added, with its documents and its images in the queue."""
        if root not in self.store.meta()["roots"]:
            raise StoreError(f"{root} is no root of this index")
        left = self.store.update(lambda s: s | {"roots": [r for r in s["roots"] if r != root]})["roots"]
        self.store.apply(self.spark.createDataFrame([(root, "remove_tree")], OPS), self.spark.createDataFrame([], FILES))
        self.queue.compact(left)
        return {"removed": self.store.outcome()["removed"]}

    def rebuild(self, root: str) -> dict:
        if root in self.store.meta()["roots"]:
            self.remove(root)
        return self.add(root)

    def reconcile(self) -> dict:
        """Brings the index in line with the disk: orphans go, changed files are read again. Returns added, modified and removed.

        The disk is listed once; the differences stay a table, and only changed files are read.
        """
        roots, files = self.store.meta()["roots"], self.store.files()
        if not roots:
            return {"added": 0, "modified": 0, "removed": 0}
        scratch = Scratch(self.spark, "reconcile")
        listing = scratch.keep(self.indexable(self.listed(roots)))
        lost = orphans(files, roots).distinct()
        diff = reconcile(files.join(lost, "path", "left_anti"), listing.select("path", "mtime", "size"))
        delta = scratch.keep(diff.unionByName(lost.select("path", F.lit("removed").alias("change"))))
        counts = delta.agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "removed")]).first().asDict()
        if sum(counts.values()):
            op = F.when(F.col("change") == "removed", "remove").otherwise("upsert")
            fresh = listing.join(delta.where("change <> 'removed'").select("path"), "path", "left_semi")
            self.store.apply(delta.select("path", op.alias("op")), self.rows_of(fresh))
            self.queue.enqueue(fresh)
        return counts

    def recognise_images(self, seconds: float | None = None) -> dict:
        """Works the image queue off, batch by batch, until it is empty or the time is over; returns its progress."""
        return drain(self.queue, self.store, self.recognise, seconds)

    def start(self, volume: str, journal_id: int, lowest_valid_usn: int) -> str:
        """How a volume is brought up to date: ``replay`` from its cursor, or ``reconcile`` if the cursor can't be used."""
        return "replay" if cursor_usable(self.store.meta()["cursors"].get(volume), journal_id, lowest_valid_usn) else "reconcile"

    def commit_cursor(self, volume: str, journal_id: int, next_usn: int) -> None:
        """Stores a volume's cursor; called once its batch is in the index."""
        self.store.update(lambda s: s | {"cursors": s["cursors"] | {volume: {"journal_id": journal_id, "next_usn": next_usn}}})

    def status(self) -> dict:
        """Documents in all and by root, the size on disk, the time of the last change and what the last batch did."""
        meta = self.store.meta()
        reader = self.store.searcher(meta)
        roots = count_under(reader.files(), meta["roots"]).collect() if meta["roots"] and meta["segments"] else []  # a row a root
        size = sum(size_on_disk(self.spark, s, part) for s in reader.segments for part in ("files", "postings", "lexicon"))
        return {
            "documents": reader.num_docs(), "roots": {r: 0 for r in meta["roots"]} | {r.root: r.files for r in roots}, "bytes": size, "updated": meta.get("updated"),
            "version": meta["version"], "outcome": meta["outcome"], "images": self.queue.progress(),
        }


def to_json(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
