"""Noise in text from scanned pages: divided words, misread characters, running headers and page numbers; and the text without them.

Words are grouped by the skeleton that is left when confusable glyphs fall together. A rare form beside a frequent one is a misreading;
among several frequent forms the context decides. Lines with masked digits that recur at page edges are headers, and what remains is
reflowed to paragraphs with SQL windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import Scratch, small_join, table

# Glyphs that recognition confuses; pairs first, then single ones by what they fall together to.
PAIRS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"))
SINGLES = {"a": "@", "o": "0", "l": "1!|i", "s": "5$", "c": "e", "b": "h8ß6", "f": "t", "q": "g9"}
#: A form is taken for a misreading of one that is at least so many times as frequent (in records).
RATIO = 6
#: A word with a digit or sign inside letters is none by itself, so it needs no context to be taken for a misreading.
_MIXED = r"\p{L}[0-9@!$|]+\p{L}"

_FROM = "".join(x for v in SINGLES.values() for x in v)
_TO = "".join(k for k, v in SINGLES.items() for _ in v)
_SINGLE = str.maketrans(_FROM, _TO)
BROKEN_D = re.compile("c[l1!|]")
HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐\xad] ?\n *(?=[^\W\d_])")
TOKEN = re.compile(r"[\w@!$|]+")
MIXED = re.compile(r"[^\W\d_][0-9@!$|]+[^\W\d_]")
#: Words whose skeletons a worker remembers before it begins anew.
REMEMBERED = 300_000

# Java's dialect, for columns
_NUMBER = r"^[\[(—–-]?\s*(?i:(?:p[aá@][gq][ec]|[s5]e[il1!][tf][ec]|p[aá@][gq](?:ina)?|стр(?:аница)?|第)\.?\s*)?\d{1,5}(?:\s*/\s*\d{1,5})?\s*页?\s*[\])—–-]?$"
_SENTENCE_END = r'[.!?。，；;,:”"]$'
_TITLED = r"^[^–/:]{2,60}(?: –| /|:) \S+(?: \S+)?(?:\s*\|?\s*\d+)?$"
_BESIDE = r"^\d{1,4}(?:\s*\|\s*|\s+)\D|\D(?:\s*\|\s*|\s+)\d{1,4}$"


def skeleton(word: str) -> str:
    """What is left of a word when confusable glyphs fall together."""
    word = BROKEN_D.sub("d", word.lower())
    for pair, one in PAIRS:
        word = word.replace(pair, one)
    return word.translate(_SINGLE)


def fold(line: Column) -> Column:
    """A line's shape for recognising it elsewhere: page number cut off, digits masked, confusable glyphs and separators folded."""
    out = F.regexp_replace(line, r"^\d+\s*\|?\s*|\s*\|?\s*\d+$", "")
    out = F.replace(F.lower(F.regexp_replace(out, r"\d", "#")), F.lit("ß"), F.lit("ss"))
    for pair, one in PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return F.trim(F.regexp_replace(F.translate(out, _FROM, _TO), r"[^\p{L}\p{N}#]+", " "))


def records(scans: DataFrame) -> DataFrame:
    """(path, content): one row a path, the latest by ``processed_at``. Null paths and null or empty contents are left out."""
    rows = scans.where(F.col("path").isNotNull() & F.col("content").isNotNull() & (F.col("content") != ""))
    return rows.groupBy("path").agg(F.max(F.struct("processed_at", "content")).alias("_t")).select("path", F.col("_t.content").alias("content"))


def tokens(text: str) -> list[str]:
    return TOKEN.findall(HYPHEN.sub("", text))


def is_word(token: str) -> bool:
    """Three glyphs or more, one of them a letter, none of them CJK."""
    return len(token) > 2 and any(c.isalpha() for c in token) and not any("㐀" <= c <= "鿿" for c in token)


def spots(recs: DataFrame) -> DataFrame:
    """(path, skel, word, before, after): each record's words with their neighbours in lower case, once for each surrounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(text)
                low = [w.lower() for w in found]
                mine = {(w, b, a) for w, b, a in zip(found, ["", *low], [*low[1:], ""]) if is_word(w)}
                if len(known) > REMEMBERED:
                    known.clear()
                for w, b, a in mine:
                    if (skel := known.get(w)) is None:
                        known[w] = skel = skeleton(w)
                    for column, value in zip(out, (path, skel, w, b, a)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["path", "skel", "word", "before", "after"])

    return recs.mapInArrow(run, "path string, skel string, word string, before string, after string")


def confusions(seen: DataFrame) -> DataFrame:
    """(word, form, total): for each word that may be misread the forms of letters only in its group that are RATIO times as frequent."""
    forms = seen.groupBy("skel", "word").agg(F.count(F.lit(1)).alias("n"))
    # spellings that differ by case only support each other
    forms = forms.withColumn("total", F.sum("n").over(W.partitionBy("skel", F.lower("word"))))
    # one of a group's forms must be frequent for any to be misread
    top = F.max("total").over(W.partitionBy("skel"))
    forms = forms.withColumn("top", top).where(F.col("top") >= RATIO).drop("top")
    good = forms.where(F.col("word").rlike(r"^\p{L}+$")).groupBy("skel", F.lower("word").alias("form")).agg(F.max("total").alias("total"))
    rare = forms.select("skel", "word", F.col("total").alias("seen"))
    return rare.join(good, "skel").where((F.col("total") >= RATIO * F.col("seen")) & (F.lower("word") != F.col("form"))).select("word", "form", "total")


def corrections(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, word, before, after, form): what to read for each misread word of each record.

    Of the forms that may be meant the one that most often stands between the same neighbours counts, after the one or before the other;
    then the most frequent, then the least by name. A word of letters only is misread only where the form has been seen beside one
    of its neighbours; one with a digit or sign inside letters always is.
    """
    may = scratch.keep(confusions(seen))
    words = may.select("word").distinct()
    doubtful = scratch.keep(small_join(seen, words, ["word"], "inner").select("path", "word", "before", "after"))
    asked = scratch.keep(doubtful.join(may, "word"))
    either = None
    for side in ("before", "after"):
        # only neighbours that are asked for are counted
        keys = asked.select("form", side).distinct()
        counted = small_join(seen.select(F.lower("word").alias("form"), side), keys, ["form", side], "inner").groupBy("form", side).agg(F.count(F.lit(1)).alias(f"n_{side}"))
        either = (asked if either is None else either).join(counted, ["form", side], "left")
    support = F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))
    best = F.max(F.struct(support.alias("support"), "total", "form")).alias("best")
    read = either.groupBy("path", "word", "before", "after").agg(best)
    return read.where((F.col("best.support") > 0) | F.col("word").rlike(_MIXED)).select("path", "word", "before", "after", F.col("best.form").alias("form"))


def misread(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, fixes): the records with misread words, and what to read for each in its surroundings. The texts are read once."""
    found = corrections(scratch.keep(spots(recs)), scratch)
    return found.groupBy("path").agg(F.collect_list(F.struct("word", "before", "after", "form")).alias("fixes"))


def lines(recs: DataFrame) -> DataFrame:
    """(path, pos, line, is_number, is_header, beside): each line of a record and whether it is a page number or a running header.

    A form feed is a line of its own. A header is a line without a sentence's end whose folded shape comes at least twice in the record, at a
    page's edge, beside a page number or alone, or anywhere if it has a title's shape; or one of several titles at page edges, as left
    and right pages differ.
    """
    cut = recs.select("path", F.posexplode(F.split(F.regexp_replace("content", "\f", "\n\f\n"), "\n")).alias("pos", "line"))
    order = W.partitionBy("path").orderBy("pos")
    s = F.when(F.col("line").contains("\f"), "\f").otherwise(F.trim(F.regexp_replace("line", r"\s+", " ")))
    near = cut.withColumn("s", s).withColumn("prev", F.lag("s", 1, "\f").over(order)).withColumn("next", F.lead("s", 1, "\f").over(order))
    number = lambda c: F.col(c).rlike(_NUMBER)
    side = lambda c: F.col(c).isin("", "\f") | number(c)
    placed = (F.col("prev") == "\f") | (F.col("next") == "\f") | number("prev") | number("next") | (side("prev") & side("next"))
    base = ~number("s") & ~F.col("s").isin("", "\f") & (F.length("s") < 80) & F.col("s").rlike(r"\p{L}") & ~F.col("s").rlike(r"\.{3}") & ~F.col("s").rlike(_SENTENCE_END)
    title = base & (F.col("s").rlike(_TITLED) | (F.col("s").rlike(r"\p{Lu}{3}") & (F.upper("s") == F.col("s"))))
    marked = near.withColumn("placed", placed).withColumn("title", title)
    shaped = marked.withColumn("candidate", base & (F.col("placed") | F.col("title"))).withColumn("key", F.when(F.col("candidate"), fold(F.col("s"))))
    titled = F.col("title") & F.col("placed")
    same = F.count(F.lit(1)).over(W.partitionBy("path", "key"))
    titles = F.sum(titled.cast("int")).over(W.partitionBy("path"))
    header = F.col("candidate") & (F.col("key") != "") & ((same >= 2) | (titled & (titles >= 2)))
    return shaped.withColumn("is_header", header).select(
        "path", "pos", "line", number("s").alias("is_number"), "is_header", (F.col("is_header") & F.col("s").rlike(_BESIDE)).alias("beside")
    )


def noise(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, noise): the kinds of noise of each record."""
    edges = lines(recs).groupBy("path").agg(F.max(F.col("is_number") | F.col("beside")).alias("page_number"), F.max("is_header").alias("running_header"))
    divided = recs.where(F.col("content").rlike(r"\p{L}[-‐\xAD] ?\n *\p{L}")).select("path", F.lit("hyphenation").alias("noise"))
    out = divided.union(misread(recs, scratch).select("path", F.lit("misread")))
    for kind in ("page_number", "running_header"):
        out = out.union(edges.where(kind).select("path", F.lit(kind)))
    return out


def repaired(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, content) as continuous paragraphs: misread words replaced, headers and page numbers gone, divided words joined, lines reflowed.

    Paragraphs are divided by blank lines and stand one a line; leader-dot lists keep their lines. A paragraph goes on over a page's edge unless
    it ended with a sentence. Spaces between CJK characters are dropped. A record of nothing but page numbers gives the empty text.
    """
    order = W.partitionBy("path").orderBy("pos")
    s = F.trim(F.regexp_replace("line", "[\\s\f]+", " "))
    gone = F.col("is_number") | F.col("is_header") | F.col("line").contains("\f")
    whole = lines(recs).withColumn("s", s).withColumn("gone", gone).withColumn("blank", F.col("s") == "")
    # a blank line beside what goes belongs to the page's edge
    soft = F.col("blank") & (F.lag("gone", 1, True).over(order) | F.lead("gone", 1, True).over(order))
    kept = whole.withColumn("soft", soft).where(~F.col("gone") & ~F.col("soft"))
    rows = kept.withColumn("gap", F.col("pos") - F.lag("pos").over(order) > 1)
    rows = rows.withColumn("leader", F.col("s").rlike(r"\.{3}"))
    # over a removed line or page edge the paragraph goes on; a blank line or a list line begins a new one
    begins = F.lag("blank", 1, True).over(order) | F.col("leader") | F.lag("leader", 1, False).over(order) | (F.col("gap") & F.lag("s").over(order).rlike(r"[.!?。”]$"))
    rows = rows.withColumn("para", F.sum(begins.cast("int")).over(order)).where(~F.col("blank"))
    # Window order isn't kept by collect_list, so lines are sorted by position
    joined = rows.groupBy("path", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "\n").alias("text"))
    text = F.regexp_replace("text", r"(?<=\p{L})[-‐\xAD] ?\n *(?=\p{L})", "")
    cjk = r"[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]"
    text = F.regexp_replace(F.regexp_replace(text, "\n", " "), rf"(?<={cjk}) +(?={cjk})", "")
    whole = joined.withColumn("text", text).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    fixed = recs.select("path").join(whole, "path", "left").join(misread(recs, scratch), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(reread(text or "", [tuple(f.values()) for f in fixes or ()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "content"])

    return fixed.select("path", "content", "fixes").mapInArrow(run, "path string, content string")


def reread(text: str, fixes: list[tuple[str, str, str, str]]) -> str:
    """The text with misread words (word, before, after, form) replaced in the case of what stands there.

    A word is replaced beside one of the neighbours that it was found with. Over a removed line both may be others; then only a word that is
    none by itself is replaced.
    """
    if not fixes:
        return text
    after_, before_ = {(w, b): form for w, b, _, form in fixes}, {(w, a): form for w, _, a, form in fixes}
    alone = {w: form for w, _, _, form in fixes if MIXED.search(w)}
    found = list(TOKEN.finditer(text))
    low = ["", *(m[0].lower() for m in found), ""]
    out, at = [], 0
    for k, m in enumerate(found):
        form = after_.get((m[0], low[k])) or before_.get((m[0], low[k + 2])) or alone.get(m[0])
        if form is not None:
            letters = [c for c in m[0] if c.isalpha()]
            if len(letters) > 1 and all(c.isupper() for c in letters):
                form = form.upper()
            elif letters[0].isupper():
                form = form.capitalize()
            out += [text[at : m.start()], form]
            at = m.end()
    return "".join(out) + text[at:]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, noise) of every record."""
    scratch = Scratch(spark, "ocr")
    return noise(scratch.keep(records(table(spark, sf_dir, "ocr_processed").select("path", "content", "processed_at"))), scratch)


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of every record as continuous paragraphs."""
    scratch = Scratch(spark, "ocr")
    return repaired(scratch.keep(records(table(spark, sf_dir, "ocr_processed").select("path", "content", "processed_at"))), scratch)
