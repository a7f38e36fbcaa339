"""Tokens and other text expressions. Everything here is a JVM-side column, so scans stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two CJK ranges; the second is what scanned text's space cleaning knows.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
CJK_WIDE = CJK + r"\x{F900}-\x{FAFF}"
#: A token: one CJK character, or a maximal run of other letters and digits. A segmenter for CJK may replace the characters (see segmented).
TOKEN = rf"([{CJK}]|[\p{{IsAlphabetic}}\p{{N}}&&[^{CJK}]]+)"
#: The same for DuckDB.
TOKEN_SQL = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|(?:[^\P{L}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|\p{N})+)"
_TOKEN_PY = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")


def tokens(text: Column) -> Column:
    """The array of a text's tokens in lower case; empty for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def segmented(text: Column, words: list[str]) -> Column:
    """Tokens in which CJK runs are cut to the words of a dictionary, the longest that fits first; what no word covers stays single characters.

    The dictionary becomes one alternation, so segmenting stays in the JVM; it suits some thousand words.
    """
    known = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(" + "|".join([*map(re.escape, known), TOKEN[1:]])), F.lit(1))


def spaced(text: Column) -> Column:
    """The tokens joined and framed by single spaces, so that a term or phrase is a substring ``' a b '``."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) in UTF-8 bytes of the original text, for snippets and queries."""
    out, at, byte = [], 0, 0
    for m in _TOKEN_PY.finditer(text):
        byte += len(text[at : m.start()].encode())
        size = len(m[0].encode())
        out.append((m[0].lower(), byte, byte + size))
        at, byte = m.end(), byte + size
    return out


def query_terms(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN_PY.findall(text)]


def frequency(toks: Column, phrase: list[str]) -> Column:
    """How often a term, or a phrase of consecutive terms, stands in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda x: x == phrase[0]))
    last = F.size(toks) - (len(phrase) - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        same = F.try_element_at(toks, i) == phrase[0]
        for k, t in enumerate(phrase[1:], 1):
            same &= F.try_element_at(toks, i + k) == t
        return same

    return F.size(F.filter(starts, here))


def clean_cjk_spaces(text: Column) -> Column:
    """Drops single spaces between CJK characters."""
    return F.regexp_replace(text, rf"(?<=[{CJK_WIDE}]) (?=[{CJK_WIDE}])", "")


def dual_form(text: Column) -> Column:
    """Recognised text as it is searched: the trimmed text, and below it the form without CJK spaces if that differs; blank gives ''."""
    raw = F.regexp_replace(text, r"^\s+|\s+$", "")
    clean = clean_cjk_spaces(raw)
    return F.when(raw == "", "").when(raw == clean, raw).otherwise(F.concat_ws("\n", raw, clean))


def human_bytes(size: Column) -> Column:
    """1024-based with one decimal, halves to even; whole for bytes. Null for null."""
    s = size.cast("double")
    out = F.format_string("%d B", size.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(s >= 1024.0**k, F.format_string(f"%.1f {unit}", F.bround(s / 1024.0**k, 1))).otherwise(out)
    return F.when(size.isNotNull(), out)


def human_ago(seconds: Column) -> Column:
    """How long ago in seconds, minutes, hours or days."""
    s = seconds.cast("long")
    part = lambda n, unit: F.format_string(f"%d {unit} ago", F.floor(s / n))
    return F.when(s < 60, part(1, "s")).when(s < 3600, part(60, "min")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def format_count(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def merge_ranges(ranges: Column) -> Column:
    """Sorted, disjoint ranges of an ARRAY<STRUCT<start INT, end INT>>: those that overlap or touch become one."""

    def add(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (r["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:int,end:int>>"), add)
