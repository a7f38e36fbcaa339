"""The read-only tool surface: search, preview and index_status as plain dictionaries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loam.functions.paths import ext_group
from loam.functions.snippet import wrap
from loam.manage import Index
from loam.plans.qlang import QueryError
from loam.sources.store import StoreError

TOOL_SORTS = ("relevance", "mtime", "size")


class ArgumentError(ValueError):
    """A call with an argument that isn't allowed."""


def failure(code: str, hint: str) -> dict:
    return {"error": code, "hint": hint}


class Tools:
    """What a tool server offers. Bad arguments raise; a missing index or unknown path is an answer with an error and a hint."""

    def __init__(self, spark: SparkSession, folder: str):
        self.index = Index(spark, folder)

    def search(self, query: str, limit: int = 10, offset: int = 0, ext: str | list[str] | None = None, sort: str = "relevance") -> dict:
        if limit <= 0:
            raise ArgumentError("limit must be at least 1")
        if offset < 0:
            raise ArgumentError("offset must not be negative")
        if sort not in TOOL_SORTS:
            raise ArgumentError(f"sort must be one of {', '.join(TOOL_SORTS)}")
        exts = ext_group(ext) or tuple(clean_exts(ext)) if isinstance(ext, str) else tuple(clean_exts(",".join(ext or [])))
        try:
            reader = self.index.store.searcher()
        except StoreError as e:
            return failure("index_unavailable", str(e))
        try:
            page = reader.page(query, limit, offset, exts or None, sort)
        except QueryError as e:
            raise ArgumentError(str(e)) from e
        hits = []
        for r in page.hits.collect():  # a page's rows
            hit = {"path": r.path, "snippet": wrap(r.snippet, [(x.start, x.end) for x in r.highlighted]), "kind": r.ext}
            if sort == "relevance":
                hit["score"] = r.score
            hits.append(hit)
        return {"hits": hits, "total_hits": page.total, "total_docs": reader.num_docs()}

    def preview(self, path: str, query: str = "") -> dict:
        try:
            row = self.index.store.searcher().preview(path, query).first()
        except StoreError as e:
            return failure("index_unavailable", str(e))
        if row is None:
            return failure("path_not_found", "take the path from a search hit")
        return {"path": row.path, "text": wrap(row.text, [(x.start, x.end) for x in row.highlighted])}

    def index_status(self) -> dict:
        try:
            return self.index.status()
        except StoreError as e:
            return failure("index_unavailable", str(e))


class Commands(Tools):
    """What a front end offers beside the tools: what is under way, and changes of roots and rules."""

    def indexing_status(self) -> dict:
        """(state, total, done): ``recognising`` while images wait, else ``idle``."""
        progress = self.index.queue.progress()
        return {"state": "recognising" if progress["done"] < progress["total"] else "idle"} | progress

    def get_rules(self) -> dict:
        return self.index.store.rules()

    def set_rules(self, **changes) -> dict:
        return self.index.store.set_rules(**changes)

    def rebuild_index(self, root: str) -> dict:
        return self.index.build(root)

    def add_root(self, root: str) -> dict:
        try:
            return self.index.add(root)
        except StoreError as e:
            return failure("root_refused", str(e))


def clean_exts(text: str | None) -> list[str]:
    """Extensions from a comma-separated list: trimmed, in lower case, without empty ones."""
    return [e.strip().lower() for e in (text or "").split(",") if e.strip()]
