"""Encoding a corpus with a public byte-level BPE tokenizer: an exact backtracking encoder.

A piece of text is covered by longest token matches from an Aho-Corasick automaton. Neighbours are checked against a table of
compatible pairs; at an incompatible or impossible place the encoder falls back to the next shorter token, or a step back, and marks
the place as dead. A cover of compatible pairs is the one that the merges give, so ids are exact and each place is left at most once.
"""

from __future__ import annotations

import importlib.util
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from loam.session import spread, table

TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids a worker remembers at most before it begins anew; some 100 MB.
REMEMBERED = 300_000


def tokenizer_dir() -> str:
    """Where the installed vocabulary files lie; any other folder can be given to the operators."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


def _class(*kinds: str) -> str:
    """A character class of all code points whose general category begins with one of ``kinds``."""
    spans, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(kinds)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            spans.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def splitter() -> tuple[Callable[[str], bool], Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Three functions for cutting a text into pieces before the merges: is it plain, cut a plain one, cut any other.

    ``re`` has no \\p classes, and long explicit ones are slow. Where a text has no number sign outside the decimal digits and no
    rare control character, its short classes mean the same once underscores are set aside as U+0001; other texts take the explicit
    pattern. In plain texts the underscores must be U+0001 when they are cut.
    """
    letter, number, digit = _class("L"), _class("N"), r"\d"
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode's White_Space
    short = r"'s|'t|'re|'ve|'m|'ll|'d"
    exact = re.compile(rf"{short}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    quick = re.compile(rf" ?[^\W\d]+|{short}| ?{digit}+| ?[^\s\w]+|\s+(?!\S)|\s+")
    odd = {"\x01", *"\x1c\x1d\x1e\x1f", *(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))}
    return odd.isdisjoint, quick.findall, exact.findall


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Encodes texts; built once a worker from the vocabulary file's text. As a dict it remembers the ids of pieces."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        if max(self.ids.values()) >= 1 << 16:
            raise ValueError("pairs of ids are kept as two 16-bit numbers; this vocabulary has larger ids")
        self.sizes = [0] * (1 + max(self.ids.values()))
        for b, i in self.ids.items():
            self.sizes[i] = len(b)
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pair: dict[int, int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair[left << 16 | right] = n
            if whole not in self.rank:
                self.rank[whole], self.split[whole] = n, (left, right)
        self.matches = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.matches.add_word(b.decode("latin-1"), i)
        self.matches.make_automaton()
        self.shorter = {}
        for b, i in self.ids.items():
            for n in range(len(b) - 1, 0, -1):
                if (k := self.ids.get(b[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.compatible: dict[int, bool] = {}  # by the first id * 2^16 + the second
        self.plain, self.cut, self.cut_odd = splitter()

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token as the merges build it, each with the rank of the merge that uses it up."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, part = [], float("inf"), token
            while True:
                known.append((part, until))
                if part not in self.split:
                    break
                until = self.rank[part]
                part = self.split[part][side]
            self.edges[side][token] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across the seam comes before the merges that use up its two parts.

        Of equal ranks the leftmost merge comes first: a's own use of its part goes before the seam, the seam before b's.
        """
        pair, ok = self.pair, True
        left, right = self._edge(a, 1), self._edge(b, 0)
        for x, x_until in left:
            for y, y_until in right:
                if (r := pair.get(x << 16 | y)) is not None and r < x_until and r <= y_until:
                    ok = False
        self.compatible[a << 16 | b] = ok
        return ok

    def encode_piece(self, piece: str) -> array:
        raw = piece.encode("utf-8", "surrogatepass")
        if (one := self.ids.get(raw)) is not None:  # the longest match covers all
            return array("i", [one])
        size, sizes = len(raw), self.sizes
        longest = [0] * size
        for end, token in self.matches.iter(raw.decode("latin-1")):
            longest[end - sizes[token] + 1] = token  # matches come by rising end, so the longest is last
        out: list[int] = []
        dead, known, shorter, fits = bytearray(size + 1), self.compatible.get, self.shorter, self.fits
        at, token, last = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            if not dead[end] and (last < 0 or (ok := known(last << 16 | token)) or ok is None and fits(last, token)):
                out.append(token)
                if end == size:
                    return array("i", out)
                at, last, token = end, token, longest[end]
            elif token in shorter:
                token = shorter[token]
            else:  # nothing fits from here; the last token ends in a dead place now, so the next round shortens it
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = self.encode_piece(piece.replace("\x01", "_")).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers in the machine's order."""
        if self.plain(text):
            return b"".join(map(self.__getitem__, self.cut(text.replace("_", "\x01"))))
        return b"".join([self.encode_piece(p).tobytes() for p in self.cut_odd(text)])


class Decoder:
    """Decodes by an offset table: all tokens' bytes in one run, and where each begins."""

    def __init__(self, vocabulary: str):
        letters = _byte_letters()
        by_id = {i: bytes(letters[c] for c in s) for s, i in json.loads(vocabulary)["model"]["vocab"].items()}
        sizes = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)])
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.run = b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.run[self.offsets[i] : self.offsets[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


_made: dict[tuple[type, int], Encoder | Decoder] = {}


def _of(kind: type, vocabulary: Broadcast) -> Encoder | Decoder:
    key = (kind, hash(vocabulary.value))
    if key not in _made:
        _made[key] = kind(vocabulary.value)
    return _made[key]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each row: the text's token ids without special tokens, an empty list for an empty or null text.

    Runs in the scan's own partitions without a shuffle. The vocabulary is a file of fixed size and is broadcast as text. Strings of
    special tokens in a text are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _of(Encoder, shared)
        for batch in batches:
            ids = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)], dtype="int64") // 4
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(np.frombuffer(b"".join(ids), "int32")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of each row of ids; an empty or null list gives the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _of(Decoder, shared)
        for batch in batches:
            texts = [decoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")


def vocabulary_text(folder: str | None = None, name: str = TOKENIZER) -> str:
    return Path(folder or tokenizer_dir(), name).read_text(encoding="utf-8")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary_text())
