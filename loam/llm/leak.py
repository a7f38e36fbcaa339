"""Evaluation texts leaking into training text: one Aho-Corasick automaton over the items, one scan of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import Scratch, spread, table

#: Consecutive words that make a leak.
WINDOW = 12
#: Words of items in one automaton, about, a node of some 100 bytes each; more items make more automata, each scanned on its own.
BLOCK_WORDS = 1_500_000

#: A word: a maximal run of letters and digits.
WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text in lower case. They are found first, so that a change of case can't divide one."""
    found = WORDS.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


class Leaks:
    """All items in one automaton, as sequences of word numbers.

    A run of ``window`` words of an item holds at least one whole block of half as many words that begins at a multiple of that length, so
    only those blocks are keys. A key that is found is grown to both sides along the item's words; runs of ``window`` words or more count.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window, self.size = window, (window + 1) // 2
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        keys: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            found = words(text)
            if len(found) < window:
                continue
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found]
            for i in range(0, len(seq) - self.size + 1, self.size):
                keys.setdefault(tuple(seq[i : i + self.size]), []).append((len(self.items), i))
            self.items.append((item, seq))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, places in keys.items():
            self.found.add_word(seq, places)
        if keys:
            self.found.make_automaton()

    def runs(self, text: str) -> dict[int, list[list[int]]]:
        """The leaked runs of each item, as first and last word of the text; those that overlap are one."""
        number = self.numbers.get
        seq = tuple([number(w, 0) for w in words(text)])
        grown: dict[int, set[tuple[int, int]]] = {}
        ends: dict[tuple[int, int], int] = {}
        for end, places in self.found.iter(seq):
            for k, at in places:
                item, own = self.items[k]
                shift = end - self.size + 1 - at
                if ends.get((k, shift), -1) >= end:
                    continue  # within a run that is known
                a, z = end - self.size + 1, end
                while a > 0 and a - shift > 0 and seq[a - 1] == own[a - 1 - shift]:
                    a -= 1
                while z + 1 < len(seq) and z + 1 - shift < len(own) and seq[z + 1] == own[z + 1 - shift]:
                    z += 1
                ends[k, shift] = z
                if z - a + 1 >= self.window:
                    grown.setdefault(item, set()).add((a, z))
        out: dict[int, list[list[int]]] = {}
        for item, spans_ in sorted(grown.items()):
            mine = out.setdefault(item, [])
            for a, z in sorted(spans_):
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(z, mine[-1][1])
                else:
                    mine.append([a, z])
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(item, start, end) of the leaked passages as character offsets into the original text."""
        if not self.items or not text or len(text) < 2 * self.window - 1 or not (runs := self.runs(text)):
            return []
        at = [m.span() for m in WORDS.finditer(text)]
        return [(item, at[a][0], at[z][1]) for item, mine in runs.items() for a, z in mine]


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, length) of each passage of an item in a document, offsets in characters of the document's text.

    A passage is a run of at least ``window`` consecutive words of the item. Items and documents with null or shorter texts match
    nothing; an item listed twice counts once. Up to about BLOCK_WORDS words of items make one automaton and the corpus is scanned once, in its
    own partitions, without a shuffle. More items are taken in blocks of that size, drawn by a hash of their id, with a scan for each, so
    that what is shipped to the executors stays bounded.
    """
    whole = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    size = whole.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (6 * BLOCK_WORDS)
    if blocks > 1:
        whole = Scratch(items.sparkSession, "items").keep(whole.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    out = None
    for k in range(blocks):
        mine = [(r.item_id, r.text) for r in (whole.where(F.col("block") == k) if blocks > 1 else whole).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Leaks(shared.value, window)
            for batch in batches:
                rows = [(doc, item, a, z - a) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item, a, z in found.spans(text)]
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "length"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, length long")
        out = part if out is None else out.union(part)
    return out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold at least twelve consecutive words of an item."""
    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the leaked passages stand."""
    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


P9_SQL = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (win)
"""
