"""Search: a parsed query becomes columns over files (path, name, ext, content, mtime, size, kind), ranked by BM25, sorted and paged.

Filters on mtime, size, ext and path stay plain comparisons and are pushed to the scan. Ranking needs the tokens of the positive words
only. Content is fetched for the rows of one page, and snippets are cut from those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths
from loam.functions.snippet import PREVIEW, SNIPPET, snippet_column
from loam.functions.text import frequency, query_terms, spaced, tokens
from loam.plans.qlang import Clause, Field, Group, Path, Query, QueryError, Range, Word, parse
from loam.session import spread, table

K1, B = 1.2, 0.75
SORTS = ("relevance", "mtime", "mtime_asc", "size")


def documents_as_files(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """The documents table in the shape of the index: unknown values are '' and 0, never null. ``apart`` spreads few splits over all cores."""
    d = spread(table(spark, sf_dir, "documents")) if apart else table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce(paths.file_name(F.col("path")), F.lit("")).alias("name"),
        F.lower(F.coalesce("ext", F.lit(""))).alias("ext"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce(F.unix_millis(F.col("modified_at").cast("timestamp")), F.lit(0)).alias("mtime"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
        F.when(F.lower("ext").isin(*paths.IMAGE_EXTS), "image").otherwise("text").alias("kind"),
    )


def prepared_files(files: DataFrame) -> DataFrame:
    """The files with their tokens beside them, for a session that asks many queries: persist the result and search it like the files."""
    out = files.withColumns({f"t_{f}": tokens(F.col(f)) for f in ("name", "content", "path")})
    out = out.withColumns({f"n_{f}": F.size(f"t_{f}") for f in ("name", "content")})
    return out.withColumns({f"s_{f}": F.concat(F.lit(" "), F.array_join(f"t_{f}", " "), F.lit(" ")) for f in ("name", "content", "path")})


def text_of(files: DataFrame, field: str) -> Column:
    return F.col(f"s_{field}") if f"s_{field}" in files.columns else spaced(F.col(field))


def tokens_of(files: DataFrame, field: str) -> Column:
    return F.col(f"t_{field}") if f"t_{field}" in files.columns else tokens(F.col(field))


def framed(terms: list[str]) -> str:
    return " " + " ".join(terms) + " "


def matches(c: Clause, files: DataFrame) -> Column:
    """A clause as a predicate. A word that yields no token matches nothing by itself and is dropped before."""
    if isinstance(c, Range):
        col = F.col(c.column)
        parts = [col >= c.low] if c.low is not None else []
        parts += [col < c.high] if c.high is not None else []
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]
    if isinstance(c, Path):
        terms = query_terms(c.text)
        if not terms:
            raise QueryError(f"path: has no word in {c.text!r}")
        text = text_of(files, "path")
        if c.quoted and len(terms) > 1:
            return text.contains(framed(terms))
        out = text.contains(framed(terms[:1]))
        for t in terms[1:]:
            out &= text.contains(framed([t]))
        return out
    if isinstance(c, Field):
        if c.name in ("ext", "kind"):
            return F.col(c.name) == c.text
        terms = query_terms(c.text)
        return text_of(files, "path" if c.name == "path_text" else c.name).contains(framed(terms)) if terms else F.lit(False)
    needle = framed(query_terms(c.text))
    return text_of(files, "name").contains(needle) | text_of(files, "content").contains(needle)


def cheap_first(clauses: list[Clause]) -> list[Clause]:
    return sorted(clauses, key=lambda c: {Range: 0, Field: 1, Path: 2, Word: 3}[type(c)])


def usable(group: Group) -> Group:
    """The group without words that yield no token."""
    keep = lambda c: not isinstance(c, Word) or bool(query_terms(c.text))
    return Group([c for c in group.must if keep(c)], [c for c in group.must_not if keep(c)])


def group_predicate(group: Group, files: DataFrame) -> Column:
    out = F.lit(True)
    for c in cheap_first(group.must):
        out &= matches(c, files)
    for c in cheap_first(group.must_not):
        out &= ~matches(c, files)
    return out


def prepared(text: str | Query) -> Query:
    query = parse(text) if isinstance(text, str) else text
    groups = [g for g in map(usable, query.groups) if g.must or g.must_not]
    if not groups:
        raise QueryError("the query has no word to look for")
    return Query(groups, query.has_operators)


def where(files: DataFrame, text: str | Query, exts: tuple[str, ...] | None = None) -> DataFrame:
    """The files that a query matches, unranked. ``exts`` is the extension filter; None or empty is none."""
    query = prepared(text)
    out = F.lit(False)
    for g in query.groups:
        out |= group_predicate(g, files)
    hits = files.where(group_predicate(query.groups[0], files) if len(query.groups) == 1 else out)
    return hits.where(F.col("ext").isin(*[e.strip().lower() for e in exts if e.strip()])) if exts else hits


@dataclass
class Stats:
    """What ranking needs of the corpus: documents, mean lengths and document frequencies by field."""

    n: int
    mean: dict[str, float]
    df: dict[tuple[str, str], int]

    def idf(self, field: str, term: str) -> float:
        df = self.df.get((field, term), 0)
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))


def stats(files: DataFrame, terms: list[str], fields: tuple[str, ...] = ("name", "content")) -> Stats:
    """One aggregate over the corpus to a single row; its width is the query's terms."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if all(f"n_{f}" in files.columns for f in fields):
        rows, size, holds = files, lambda f: F.col(f"n_{f}"), lambda f, t: F.col(f"s_{f}").contains(framed([t]))
    else:
        rows = files.select(*[tokens(F.col(f)).alias(f"t_{f}") for f in fields])
        size, holds = lambda f: F.size(f"t_{f}"), lambda f, t: F.array_contains(f"t_{f}", t)
    for f in fields:
        aggs.append(F.avg(size(f)).alias(f"mean_{f}"))
        aggs += [F.count_if(holds(f, t)).alias(f"df_{f}_{i}") for i, t in enumerate(terms)]
    row = rows.agg(*aggs).first()
    return Stats(row["n"], {f: row[f"mean_{f}"] or 0.0 for f in fields}, {(f, t): row[f"df_{f}_{i}"] or 0 for f in fields for i, t in enumerate(terms)})


def bm25(words: list[Word], st: Stats, fields: tuple[str, ...] = ("name", "content")) -> Column:
    """The sum over fields and words; a phrase counts as its terms' weight at the phrase's frequency. Needs t_<field> columns."""
    score = F.lit(0.0)
    for f in fields:
        if not st.mean[f]:
            continue
        norm = K1 * (1 - B + B * F.size(f"t_{f}") / F.lit(st.mean[f]))
        for w in words:
            terms = query_terms(w.text)
            tf = frequency(F.col(f"t_{f}"), terms)
            score += F.lit(sum(st.idf(f, t) for t in terms)) * tf * (K1 + 1) / (tf + norm)
    return score


def ranked(files: DataFrame, text: str | Query, exts: tuple[str, ...] | None = None, fields: tuple[str, ...] = ("name", "content")) -> DataFrame:
    """The hits with ``score``, rounded to six places. A document's score sums the groups that it satisfies; filters add nothing."""
    query = prepared(text)
    terms = list(dict.fromkeys(t for w in query.words() for t in query_terms(w.text)))
    hits = where(files, query, exts)
    if not terms:
        return hits.withColumn("score", F.lit(0.0))
    st = stats(files, terms, fields)
    scored = hits.withColumns({f"t_{f}": tokens_of(hits, f) for f in fields})
    total = F.lit(0.0)
    for g in query.groups:
        own = bm25([c for c in g.must if isinstance(c, Word)], st, fields)
        total += own if len(query.groups) == 1 else F.when(group_predicate(g, files), own).otherwise(0.0)
    return scored.withColumn("score", F.round(total, 6)).select(*files.columns, "score")


def ordering(sort: str) -> list[Column]:
    """The sort's order; ties fall to the path."""
    first = {"relevance": F.desc("score"), "mtime": F.desc("mtime"), "mtime_asc": F.asc("mtime"), "size": F.desc("size")}
    if sort not in first:
        raise QueryError(f"unknown sort {sort!r}; known: {', '.join(SORTS)}")
    return [first[sort], F.asc("path")]


@dataclass
class Page:
    hits: DataFrame
    total: int


def page(files: DataFrame, text: str, limit: int = 10, offset: int = 0, exts: tuple[str, ...] | None = None, sort: str = "relevance") -> Page:
    """One page of (path, score, snippet, highlighted, ext), and the number of all hits.

    Rows are ranked without their contents; contents come for the page's rows only. A limit of 0 or less gives an empty page. Scores are 0 in
    any order but relevance.
    """
    query = prepared(text)
    hits = ranked(files, query, exts) if sort == "relevance" else where(files, query, exts).withColumn("score", F.lit(0.0))
    total = where(files, query, exts).count()
    top = hits.select("path", "score", "ext", "mtime", "size").orderBy(*ordering(sort)).offset(max(0, offset)).limit(max(0, limit))
    terms = list(dict.fromkeys(t for w in query.words() for t in query_terms(w.text)))
    st = stats(files, terms, ("content",)) if terms else None
    weights = {t: 1 / (1 + st.df[("content", t)]) for t in terms} if st else {}
    # a page is a handful of rows, so it is what gets broadcast
    bodies = files.select("path", "content").join(F.broadcast(top), "path")
    cut = bodies.withColumn("cut", snippet_column(F.col("content"), weights, SNIPPET))
    rows = cut.select("path", "score", F.col("cut.text").alias("snippet"), F.col("cut.ranges").alias("highlighted"), "ext", "mtime", "size")
    return Page(rows.orderBy(*ordering(sort)).drop("mtime", "size"), total)


def preview(files: DataFrame, path: str, text: str = "") -> DataFrame:
    """(path, text, highlighted) of one file: the best 1500 characters for the query's words, else its head; no row for an unknown path."""
    try:
        terms = list(dict.fromkeys(t for w in prepared(text).words() for t in query_terms(w.text))) if text.strip() else []
    except QueryError:
        terms = []
    cut = snippet_column(F.col("content"), {t: 1.0 for t in terms}, PREVIEW)
    return files.where(F.col("path") == path).limit(1).withColumn("cut", cut).select("path", F.col("cut.text").alias("text"), F.col("cut.ranges").alias("highlighted"))


def count_under(files: DataFrame, roots: list[str]) -> DataFrame:
    """(root, files): how many files lie at or below each root, in one pass."""
    counts = files.agg(*[F.count_if(paths.under(F.col("path"), r)).alias(str(i)) for i, r in enumerate(roots)])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.col(str(i)).alias("files")) for i, r in enumerate(roots)])).alias("x")
    return counts.select(pairs).select("x.*")
