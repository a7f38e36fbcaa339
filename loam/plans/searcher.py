"""Searching an index: a parsed query is answered from the postings of its terms, part by part, without reading a text.

The driver looks the terms up in the lexicon, which gives the weights and tells which shards can match, if any. One job of one stage reads the
terms' postings in those and evaluates each part in arrays: sets for the conditions, positions for phrases, BM25 for the order. Of a part only
the best rows leave, with the number of its hits. Texts are read for the rows of one page.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loam.functions.snippet import PREVIEW, SNIPPET, snippet_column
from loam.functions.text import query_terms
from loam.plans import segment as G
from loam.plans.qlang import Clause, Field, Group, Path, Query, QueryError, Range, Word
from loam.plans.search import K1, SORTS, B, Page, Stats, prepared
from loam.session import BROADCAST_ROWS, within

FOUND = "seg int, doc long, path string, score double, key long, hits long"


def text_clause(c: Clause) -> tuple[list[list[str]], tuple[str, ...]] | None:
    """What a clause looks up: term lists that must all match, each as a phrase, and the fields of which one must match; None if it looks up nothing."""
    if isinstance(c, Word):
        return [query_terms(c.text)], ("name", "content")
    if isinstance(c, Path):
        terms = query_terms(c.text)
        if not terms:
            raise QueryError(f"path: has no word in {c.text!r}")
        return [terms] if c.quoted and len(terms) > 1 else [[t] for t in terms], ("path",)
    if isinstance(c, Field) and c.name not in ("ext", "kind"):
        return [query_terms(c.text)], ("path" if c.name == "path_text" else c.name,)
    return None


def all_terms(query: Query) -> list[str]:
    found = [text_clause(c) for g in query.groups for c in (*g.must, *g.must_not)]
    return list(dict.fromkeys(t for f in found if f for phrase in f[0] for t in phrase))


def shards_of(group: Group, known: dict[tuple[str, str], tuple[int, int]]) -> int:
    """The bits of the groups of shards in which a group of conditions can match, by what the lexicon knows of its terms."""
    mask = (1 << G.GROUPS) - 1
    for c in group.must:
        if (f := text_clause(c)) is not None:
            for phrase in f[0]:
                either = 0
                for name in f[1]:
                    every = mask if phrase else 0
                    for t in phrase:
                        every &= known.get((name, t), (0, 0))[1]
                    either |= every
                mask &= either
    return mask


@dataclass
class Plan:
    """What a task needs to evaluate parts: the query, its weights, and how many rows of a part are wanted in which order (None: all)."""

    query: Query
    exts: tuple[str, ...]
    stats: Stats | None
    fields: tuple[str, ...]
    sort: str
    top: int | None

    def columns(self) -> list[str]:
        """Which facts about files are needed."""
        clauses = [c for g in self.query.groups for c in (*g.must, *g.must_not)]
        need = {c.column + "s" for c in clauses if isinstance(c, Range)} | {c.name + "s" for c in clauses if isinstance(c, Field) and c.name in ("ext", "kind")}
        need |= {"exts"} if self.exts else set()
        need |= {"mtimes"} if self.sort.startswith("mtime") else {"sizes"} if self.sort == "size" else set()
        need |= {"tfs", "names"} if self.stats else set()
        return sorted(need)


@dataclass
class Part:
    """One part in arrays."""

    n: int
    facts: dict[str, np.ndarray]
    postings: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]
    known: dict = field(default_factory=dict)

    def positions(self, name: str, term: str) -> np.ndarray:
        """file * 2^32 + position of each place of a term."""
        docs, tfs, gaps = self.postings[name, term]
        sums = np.cumsum(gaps, dtype="int64")
        starts = np.cumsum(tfs) - tfs
        before = np.where(starts > 0, sums[starts - 1], 0)
        return (np.repeat(docs.astype("int64") << 32, tfs)) + sums - np.repeat(before, tfs)

    def frequencies(self, name: str, phrase: tuple[str, ...]) -> np.ndarray:
        """How often a term or a phrase of consecutive terms stands in a field of each file."""
        if (name, phrase) not in self.known:
            out = np.zeros(self.n, "int64")
            if phrase and all((name, t) in self.postings for t in phrase):
                if len(phrase) == 1:
                    docs, tfs, _ = self.postings[name, phrase[0]]
                    out[docs] = tfs
                else:
                    at = self.positions(name, phrase[0])
                    for k, t in enumerate(phrase[1:], 1):
                        at = np.intersect1d(at, self.positions(name, t) - k, assume_unique=True)
                    np.add.at(out, at >> 32, 1)
            self.known[name, phrase] = out
        return self.known[name, phrase]

    def matches(self, c: Clause) -> np.ndarray:
        if isinstance(c, Range):
            values, out = self.facts[c.column + "s"], np.ones(self.n, bool)
            out &= values >= c.low if c.low is not None else True
            return out & (values < c.high) if c.high is not None else out
        if (f := text_clause(c)) is None:
            return self.facts[c.name + "s"] == c.text
        out = np.ones(self.n, bool)
        for phrase in f[0]:
            one = np.zeros(self.n, bool)
            for name in f[1]:
                one |= self.frequencies(name, tuple(phrase)) > 0
            out &= one
        return out

    def group(self, g: Group) -> np.ndarray:
        out = np.ones(self.n, bool)
        for c in g.must:
            out &= self.matches(c)
        for c in g.must_not:
            out &= ~self.matches(c)
        return out

    def score(self, words: list[Word], plan: Plan) -> np.ndarray:
        out = np.zeros(self.n)
        for name in plan.fields:
            if not plan.stats.mean[name]:
                continue
            norm = K1 * (1 - B + B * self.facts["names" if name == "name" else "tfs"] / plan.stats.mean[name])
            for w in words:
                terms = query_terms(w.text)
                tf = self.frequencies(name, tuple(terms))
                out += sum(plan.stats.idf(name, t) for t in terms) * tf * (K1 + 1) / (tf + norm)
        return out


def evaluate(part: Part, plan: Plan, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, scores, keys, hits) of a part's best files; ``gone`` are places that don't count."""
    each = [part.group(g) for g in plan.query.groups]
    hit = np.logical_or.reduce(each)
    if plan.exts:
        hit &= np.isin(part.facts["exts"], plan.exts)
    hit[gone] = False
    at = np.flatnonzero(hit)
    scores = np.zeros(part.n)
    if plan.stats and plan.sort == "relevance":
        for g, own in zip(plan.query.groups, each):
            scores += np.where(own, part.score([c for c in g.must if isinstance(c, Word)], plan), 0.0)
        scores = np.round(scores, 6)
    keys = part.facts["mtimes"] if plan.sort.startswith("mtime") else part.facts["sizes"] if plan.sort == "size" else np.zeros(part.n, "int64")
    total = len(at)
    if plan.top is not None and total > plan.top:
        by = {"relevance": -scores[at], "mtime_asc": keys[at]}.get(plan.sort, -keys[at])
        at = at[np.argsort(by, kind="stable")[: plan.top]]  # places stand in the order of their paths, so ties fall to the path
    return at, scores[at], keys[at], total


def _numbers(lists: pa.Array, at: int) -> np.ndarray:
    return lists[at].values.to_numpy(zero_copy_only=False)


def runner(plan: Plan, columns: list[str], deletions: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Evaluates the rows (term, field, part, seg, docs, tfs, positions, ids, paths, the facts and, with deletions, ``gone``) of a task's shards by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings: dict = defaultdict(dict)
        parts: dict = {}
        for batch in batches:
            names = {n: batch.column(n) for n in batch.schema.names}
            keys = zip(names["seg"].to_pylist(), names["part"].to_pylist(), names["field"].to_pylist(), names["term"].to_pylist())
            for i, (seg, part, f, t) in enumerate(keys):
                if t:
                    postings[seg, part][f, t] = np.cumsum(_numbers(names["docs"], i)), _numbers(names["tfs"], i), _numbers(names["positions"], i)
                else:
                    facts = {c: (np.array(names[c][i].as_py(), object) if c in ("exts", "kinds") else _numbers(names[c], i)) for c in columns}
                    gone = _numbers(names["gone"], i) if deletions and names["gone"][i].is_valid else None
                    parts[seg, part] = _numbers(names["ids"], i), names["paths"][i].values, facts, gone
        out: list[list] = [[], [], [], [], []]
        shown = []
        for (seg, part), (ids, paths, facts, gone) in parts.items():
            lost = np.flatnonzero(np.isin(ids, gone)) if gone is not None else np.empty(0, "int64")
            at, scores, keys, total = evaluate(Part(len(ids), facts, postings.get((seg, part), {})), plan, lost)
            if not total:
                continue
            if not len(at):  # only the number is wanted
                scores, keys, where = np.zeros(1), np.zeros(1, "int64"), np.array([-1])
                shown.append(pa.nulls(1, pa.string()))
            else:
                where = ids[at]
                shown.append(paths.take(pa.array(at)))
            for column, values in zip(out, (np.full(len(where), seg), where, scores, keys, np.concatenate([[total], np.zeros(len(where) - 1, "int64")]))):
                column.append(values)
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        seg, doc, score, key, hits = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)]
        yield pa.RecordBatch.from_arrays([seg, doc, pa.concat_arrays(shown) if shown else pa.array([], pa.string()), score, key, hits], names=["seg", "doc", "path", "score", "key", "hits"])

    return run


class Searcher:
    """Searches some segments. ``deleted`` has (seg, part, doc) of files that no longer count, by the segment's place in the list, and ``lost``
    says how many files and words they take from each."""

    def __init__(self, spark: SparkSession, segments: list[G.Segment], deleted: DataFrame | None = None, lost: dict[str, int] | None = None):
        self.spark, self.segments, self.deleted = spark, segments, deleted
        self.lost = {"n": 0, "name": 0, "content": 0} | (lost or {})
        self.readers = [G.Reader(spark, s) for s in segments]
        self.lexicons = [G.Lexicon(r) for r in self.readers]

    def num_docs(self) -> int:
        return sum(s.n for s in self.segments) - self.lost["n"]

    def files(self) -> DataFrame:
        """All files, with ``seg`` and ``doc``."""
        out = None
        for k, reader in enumerate(self.readers):
            part = reader.files().withColumn("seg", F.lit(k))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if self.deleted is not None:
            out = out.join(self.deleted.select("seg", "doc"), ["seg", "doc"], "left_anti")
        return out

    def stats(self, terms: list[str], fields: tuple[str, ...] = ("name", "content")) -> Stats:
        """What ranking needs, from the lexicon: no job, but one over the terms' postings if files have been deleted."""
        n = self.num_docs()
        mean = {f: (sum(getattr(s, f) for s in self.segments) - self.lost[f]) / n if n else 0.0 for f in fields}
        df: dict[tuple[str, str], int] = {}
        for lexicon in self.lexicons:
            for key, (count, _) in lexicon.look_up(terms).items():
                df[key] = df.get(key, 0) + count
        if self.deleted is not None and terms:
            for r in self._deleted_df(terms):
                df[r.field, r.term] = df[r.field, r.term] - r.n
        return Stats(n, mean, {k: c for k, c in df.items() if k[0] in fields})

    def _gone(self, k: int) -> DataFrame:
        """(part, gone): the deleted files of one segment by part, at most a part's files each."""
        return self.deleted.where(F.col("seg") == k).groupBy("part").agg(F.collect_set("doc").alias("gone"))

    def _deleted_df(self, terms: list[str]):
        """(field, term, n): in how many deleted files the terms stand; a row a field and term of the query."""
        out = None
        for k, reader in enumerate(self.readers):
            gone = self._gone(k)
            ids = reader.parts().select("part", "ids")
            rows = reader.postings().where(F.col("term").isin(*terms)).select("term", "field", "part", "docs").join(gone, "part").join(ids, "part")
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
            places = F.aggregate("docs", start, lambda a, g: F.struct((a["at"] + g).alias("at"), F.array_append(a["all"], a["at"] + g).alias("all")), lambda a: a["all"])
            n = F.size(F.filter(places, lambda p: F.array_contains(F.col("gone"), F.get(F.col("ids"), p))))
            part = rows.select("term", "field", n.alias("n"))
            out = part if out is None else out.union(part)
        return out.groupBy("field", "term").agg(F.sum("n").alias("n")).collect()

    def found(self, plan: Plan) -> DataFrame | None:
        """(seg, doc, path, score, key, hits) of the best files of each part, ``hits`` being the part's number on its first row; None if nothing can match."""
        terms, columns = all_terms(plan.query), plan.columns()
        wanted = F.col("term").isin("", *terms)
        names = ["part", "term", "field", "docs", "positions", "ids", "paths", *dict.fromkeys(["tfs", *columns])]
        out = None
        for k, (s, reader, lexicon) in enumerate(zip(self.segments, self.readers, self.lexicons)):
            known, mask = lexicon.look_up(terms), 0
            for g in plan.query.groups:
                mask |= shards_of(g, known)
            if not mask or not s.n:
                continue
            rows = reader.postings(mask).where(wanted).select(F.lit(k).alias("seg"), *names)
            if self.deleted is not None:
                gone = self._gone(k)
                if within(gone, BROADCAST_ROWS):
                    rows = rows.join(F.broadcast(gone), "part", "left")
                else:  # a part's rows must stay in one task
                    rows = rows.join(gone, "part", "left").repartition("part")
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.mapInArrow(runner(plan, columns, self.deleted is not None), FOUND)

    def plan(self, text: str | Query, exts: tuple[str, ...] | None, sort: str, top: int | None, fields: tuple[str, ...] = ("name", "content"), ranked: bool = True) -> Plan:
        if sort not in SORTS:
            raise QueryError(f"unknown sort {sort!r}; known: {', '.join(SORTS)}")
        query = prepared(text)
        terms = list(dict.fromkeys(t for w in query.words() for t in query_terms(w.text)))
        stats = self.stats(terms, fields) if terms and ranked and sort == "relevance" else None
        return Plan(query, tuple(e.strip().lower() for e in exts or () if e.strip()), stats, fields, sort, top)

    def hits(self, text: str | Query, exts: tuple[str, ...] | None = None, columns: tuple[str, ...] = ("path",), fields: tuple[str, ...] = ("name", "content"), ranked: bool = False) -> DataFrame:
        """All files that a query matches, with the named columns, and ``score`` if ``ranked``."""
        found = self.found(self.plan(text, exts, "relevance", None, fields, ranked))
        shown = [*columns, *(["score"] if ranked else [])]
        if found is None:
            return self.files().select(*columns, F.lit(0.0).alias("score")).limit(0).select(shown)
        if set(columns) <= {"path"}:
            return found.select(shown)
        return found.select("seg", "doc", "score").join(self.files().select("seg", "doc", *columns), ["seg", "doc"]).select(shown)

    def top(self, text: str | Query, limit: int, offset: int = 0, exts: tuple[str, ...] | None = None, sort: str = "relevance", columns: tuple[str, ...] = ("path",), fields: tuple[str, ...] = ("name", "content"), extra: tuple[Column, ...] = ()) -> tuple[list[dict], int]:
        """(rows, total): one page in order, ties by path, with the named columns, ``score`` and ``key``; and the number of all hits, from the same pass.

        Columns other than ``path`` are read for the page's rows, by a second job.
        """
        offset, limit = max(0, offset), max(0, limit)
        want = offset + limit
        plan = self.plan(text, exts, sort, want, fields)
        found = self.found(plan)
        if found is None:
            return [], 0
        seen = Observation()
        by = {"relevance": F.desc("score"), "mtime_asc": F.asc("key")}.get(sort, F.desc("key"))
        first = found.observe(seen, F.sum("hits").alias("total")).orderBy(by, F.asc("path")).limit(max(1, want)).collect()
        page = [r for r in first if r.doc >= 0][offset:want]
        rows = {(r.seg, r.doc): {"path": r.path, "score": r.score, "key": r.key} for r in page}
        if set(columns) - {"path"} or extra:
            for seg, group in itertools.groupby(sorted(rows), key=lambda x: x[0]):
                files = self.readers[seg].files().where(F.col("doc").isin(*[d for _, d in group]))
                for r in files.select("doc", *[c for c in dict.fromkeys(columns) if c != "path"], *extra).collect():
                    rows[seg, r.doc] |= r.asDict(recursive=True)
        return list(rows.values()), seen.get["total"] or 0

    def page(self, text: str, limit: int = 10, offset: int = 0, exts: tuple[str, ...] | None = None, sort: str = "relevance") -> Page:
        """One page of (path, score, snippet, highlighted, ext), and the number of all hits. A limit of 0 or less gives an empty page."""
        query = prepared(text)
        terms = list(dict.fromkeys(t for w in query.words() for t in query_terms(w.text)))
        st = self.stats(terms, ("content",)) if terms else None
        weights = {t: 1 / (1 + st.df.get(("content", t), 0)) for t in terms} if st else {}
        cut = snippet_column(F.col("content"), weights, SNIPPET).alias("cut")
        rows, total = self.top(query, limit, offset, exts, sort, ("path", "ext"), extra=(cut,))
        schema = "path string, score double, snippet string, highlighted array<struct<start:int,end:int>>, ext string"
        return Page(self.spark.createDataFrame([(r["path"], r["score"], r["cut"]["text"], [(x["start"], x["end"]) for x in r["cut"]["ranges"]], r["ext"]) for r in rows], schema), total)

    def preview(self, path: str, text: str = "") -> DataFrame:
        """(path, text, highlighted) of one file: the best 1500 characters for the query's words, else its head; no row for an unknown path."""
        try:
            terms = list(dict.fromkeys(t for w in prepared(text).words() for t in query_terms(w.text))) if text.strip() else []
        except QueryError:
            terms = []
        cut = snippet_column(F.col("content"), {t: 1.0 for t in terms}, PREVIEW)
        return self.files().where(F.col("path") == path).limit(1).withColumn("cut", cut).select("path", F.col("cut.text").alias("text"), F.col("cut.ranges").alias("highlighted"))


