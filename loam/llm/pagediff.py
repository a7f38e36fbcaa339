"""Page differencing: pages with neighbouring addresses share their templates, so what a page shares with its nearest one is deleted.

The address of a file is its path, the host its first part. Pages are sorted by host and path over the whole table, so neighbours stand side by
side wherever they lie, and no host or folder is one task. Lines are aligned by a longest common subsequence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import table

SCHEMA = "path string, nearest string, shared int, content string"


def parts(path: str) -> list[str]:
    return re.split(r"[/\\]+", path)


def nearness(a: str, b: str) -> tuple[int, int]:
    """How near two addresses are: common leading parts, then common leading characters; (-1, 0) for different hosts."""
    x, y = parts(a), parts(b)
    if x[0].lower() != y[0].lower():
        return -1, 0
    same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return same, next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Indices of the lines of ``mine`` in a longest common subsequence with ``other``; blank lines don't count.

    By Hunt and Szymanski: the work grows with the number of equal pairs of lines, not with the product of the lengths.
    """
    places = defaultdict(list)
    for j, line in enumerate(other):
        if line.strip():
            places[line].append(j)
    ends: list[int] = []  # the least end in ``other`` of a common subsequence of each length
    links: list[tuple] = []
    for i, line in enumerate(mine):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def difference(text: str, other: str | None) -> tuple[str, int]:
    """(the text without the lines shared with another, how many they are); blank lines beside what goes become one."""
    lines = text.split("\n")
    if other is None:
        return text, 0
    shared = shared_lines([x.strip() for x in lines], [x.strip() for x in other.split("\n")])
    kept = "\n".join(line for i, line in enumerate(lines) if i not in shared)
    return (re.sub(r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n", kept).strip("\n") if shared else text), len(shared)


def differenced(pages: DataFrame) -> DataFrame:
    """(path, nearest, shared, content) of each path: the page of the nearest address of its host, and the text without the lines it shares with it.

    ``pages`` has path and content, one row a path. Rows without a path are dropped; null contents stay null and share nothing. The only page of
    a host stays whole, with a null ``nearest``. Each task reads its range of the sorted addresses once and holds three pages at a time;
    the first page of a range has only its successor to be compared with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None
        for batch in batches:
            out = []
            for after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is not None:
                    out.append(one(before, now, after))
                before, now = now, after
            yield rows(out)
        yield rows([one(before, now, None)] if now is not None else [])

    def one(before, now, after) -> tuple:
        near = [(nearness(now[0], x[0]), -k, x) for k, x in enumerate((before, after)) if x is not None and x[1] is not None]
        best = max(near, key=lambda n: n[:2], default=None)
        if now[1] is None or best is None or best[0][0] < 0:
            return now[0], None, 0, now[1]
        content, shared = difference(now[1], best[2][1])
        return now[0], best[2][0], shared, content

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "nearest", "shared", "content"])

    host = F.lower(F.regexp_extract("path", r"^([^/\\]*)", 1))
    known = pages.where(F.col("path").isNotNull()).select("path", "content", host.alias("host"))
    return known.repartitionByRange("host", "path").sortWithinPartitions("host", "path").select("path", "content").mapInArrow(run, SCHEMA)


def p6_differenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, nearest, shared, content) of each indexed path, the latest row of which counts."""
    rows = table(spark, sf_dir, "indexed_files").select("path", "content", "indexed_at").where(F.col("path").isNotNull())
    latest = rows.groupBy("path").agg(F.max(F.struct("indexed_at", "content")).alias("_t")).select("path", F.col("_t.content").alias("content"))
    return differenced(latest)
