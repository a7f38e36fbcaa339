"""Snippets, highlights and previews. They run on the rows of one page only, after the limit."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import query_terms, tokenize

#: Characters of a snippet and of a preview, and bytes of a content that are searched for the best fragment.
SNIPPET, PREVIEW, SCAN = 160, 1500, 128 * 1024


def normalize_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges: those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def snippet(content: str, weights: dict[str, float], limit: int = SNIPPET) -> tuple[str, list[tuple[int, int]]]:
    """(fragment, ranges): the fragment of whole tokens within ``limit`` characters whose terms weigh most, the first of equals.

    Ranges are byte offsets into the fragment. Without a hit in the searched head, the first ``limit`` characters without ranges.
    """
    head = content.encode()[:SCAN].decode(errors="ignore")
    toks = tokenize(head)
    hits = [i for i, (t, _, _) in enumerate(toks) if t in weights]
    if not hits:
        return content[:limit], []
    raw = head.encode()
    spans, at, n = [], 0, 0
    for _, s, e in toks:
        n += len(raw[at:s].decode())
        size = len(raw[s:e].decode())
        spans.append((n, n + size))
        n, at = n + size, e
    best, best_at, start = -1.0, (0, 0), 0
    while start < len(toks):
        end, weight = start, 0.0
        while end < len(toks) and spans[end][1] - spans[start][0] <= limit:
            weight += weights.get(toks[end][0], 0.0)
            end += 1
        if weight > best:
            best, best_at = weight, (start, max(end, start + 1))
        start = max(end, start + 1)
    a, z = best_at
    s, e = toks[a][1], toks[z - 1][2]
    ranges = [(b - s, c - s) for t, b, c in toks[a:z] if t in weights]
    return raw[s:e].decode(), normalize_ranges(ranges)


def snippet_column(content: Column, weights: dict[str, float], limit: int = SNIPPET) -> Column:
    """STRUCT<text, ranges> per row."""

    @F.pandas_udf("struct<text:string,ranges:array<struct<start:int,end:int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [snippet(t or "", weights, limit) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in out], "ranges": [[{"start": a, "end": b} for a, b in r] for _, r in out]})

    return run(content)


def segments(text: str, ranges: Iterable[tuple[int, int]]) -> list[tuple[str, bool]]:
    """(piece, highlighted) pieces of a text by byte ranges; ranges that are empty, reversed, outside or within a character are skipped."""
    raw, out, at = text.encode(), [], 0
    for start, end in ranges:
        if not at <= start < end <= len(raw):
            continue
        try:
            before, inside, _ = raw[at:start].decode(), raw[start:end].decode(), raw[end:].decode()
        except UnicodeDecodeError:
            continue
        if before:
            out.append((before, False))
        out.append((inside, True))
        at = end
    if at < len(raw) or not out:
        out.append((raw[at:].decode(), False))
    return out


def wrap(text: str, ranges: Iterable[tuple[int, int]], opening: str = "«", closing: str = "»") -> str:
    """The text with markers around its highlighted pieces."""
    return "".join(f"{opening}{t}{closing}" if h else t for t, h in segments(text, ranges))


def highlight_name(name: str, terms: Iterable[str]) -> list[tuple[int, int]]:
    """Byte ranges of all places where one of the terms stands in a name, whatever their case."""
    low, out = name.lower(), []
    if len(low) != len(name):
        return []
    for term in {t.strip('"').lower() for t in terms} - {""}:
        at = low.find(term)
        while at >= 0:
            start = len(name[:at].encode())
            out.append((start, start + len(name[at : at + len(term)].encode())))
            at = low.find(term, at + len(term))
    return normalize_ranges(out)


def positive_terms(words: Iterable[str]) -> list[str]:
    return [t for w in words for t in query_terms(w)]
