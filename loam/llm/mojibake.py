"""Garbled text from a wrong character encoding: found and restored by best-first search over encode, decode and unescape steps.

A state is a text. From a text one encode step leads to bytes and one decode step to another text, or an unescape step leads straight
to another text. The cheapest text so far is expanded first, by whatever way it came, and texts are remembered as they are reached. The cost counts implausible characters and neighbours, so sound text in any of the corpus's scripts costs next to nothing.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import spread, table

# The encodings tried.
ENCODINGS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "gbk")
#: Steps (an encode and a decode, or an unescape) on one path at most: text is rarely garbled more than twice.
DEPTH = 3
#: Texts of up to so many times the least cost reached so far are gone on with.
DEARER = 2.0
#: A path must lower the cost by this much, and to this share of what it was.
GAIN, SHARE = 1.5, 0.5
#: Quotations up to so many characters that hold nothing but what is garbled are examples, not damage.
QUOTED = 24

# Russian letters by falling frequency, for the cost of Cyrillic text.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"

_LOWER, _UPPER = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž", "À-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_BOX = "─-╿▀-▟■-◿"
_MATHS = "√∂∆∏∑∞∫≈≠≤≥◊Ωπ∙∩≡⌐⌠⌡₧Γ-ΩΑ-ωƒ"
_SIGNS = "¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾×÷‚„†‡ˆ‰‹›•˜€¿¡№"
_CYR = "А-Яа-яЁё"


def _rare_hanzi() -> str:
    """CJK characters outside the everyday set of GB 2312, as a character class; a few hundred spans made by rule."""

    def everyday(c: int) -> bool:
        try:
            return bool(chr(c).encode("gb2312"))
        except UnicodeEncodeError:
            return False

    spans, start = [], None
    for c in range(0x3400, 0xA001):
        rare = c < 0xA000 and not (0x4DC0 <= c < 0x4E00) and not everyday(c)
        if rare and start is None:
            start = c
        elif not rare and start is not None:
            spans.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(spans)


_RARE = _rare_hanzi()
_LETTER = r"[^\W\d_]"
BROKEN = re.compile("[\x80-\x9f�-]")
#: (weight, pattern): what makes text implausible.
SIGNALS = [
    (6.0, BROKEN),
    (2.5, re.compile(rf"(?<={_LETTER})[{_SIGNS.replace('«', '').replace('»', '').replace('°', '').replace('²', '').replace('³', '').replace('º', '').replace('ª', '').replace('№', '')}“–—](?={_LETTER})|(?<=[{_LOWER}{_UPPER}])[{_SIGNS.replace('»', '').replace('›', '')}](?=[^\n])|[¢£¤¥¦¨©¬®¯´µ¶¸¹¼½¾‚†‡ˆ‰•˜€](?={_LETTER})|(?<=[а-яёА-ЯЁ])[{_SIGNS.replace('»', '')}]|[{_SIGNS.replace('«', '').replace('№', '').replace('„', '')}](?=[а-яёА-ЯЁ])")),
    (3.0, re.compile(rf"(?<={_LETTER})[{_BOX}{_MATHS}]|[{_BOX}√∂∆∏∑∞∫≈≠≤≥◊∙∩≡⌐⌠⌡₧ƒ](?=\w)|[{_BOX}√∂∆∏∑∞∫≈≠≤≥◊∙∩≡⌐⌠⌡₧ƒ](?=[{_SIGNS}])|(?<=[ΓΣΦΘτσπ])[{_SIGNS}{_UPPER}{_LOWER}]")),
    (2.0, re.compile(rf"(?<=[{_LOWER}])[{_UPPER}](?=[{_LOWER}{_UPPER}{_SIGNS}{_MATHS}\s\xa0™]|$)|(?<=[а-яё])[А-ЯЁ]")),
    (1.5, re.compile(rf"(?<=[À-ÿ][À-ÿ])[À-ÿ]")),
    (2.5, re.compile("[ЂЃ‰ЉЊЌЋЏђѓљњќћџЄєЇїЎўІіЈјҐґЅѕ]")),
    (3.0, re.compile(f"[{_RARE}]")),
    (2.0, re.compile("[ぁ-ヿㄅ-ㄯ㈠-㋿ｦ-ﾟ]")),
    (1.5, re.compile(rf"(?<=[a-z{_LOWER}])[㐀-鿿]{{1,2}}(?=[{_LOWER}a-z])|(?<=[A-Za-z])[{_CYR}]|[{_CYR}](?=[A-Za-z])")),
    (2.5, re.compile("[ﬁﬂ⁄]")),
    (1.4, re.compile(r"(?<=\s)[¡¿](?=\s)")),
    (2.0, re.compile(r"(?<=[a-zß-öø-ÿ])[㐀-鿿]{1,2}(?![㐀-鿿])")),
    (0.8, re.compile("[ÃÂÐØÞðþĂĐ]")),
    (1.4, re.compile(r"[\u0180-\u036f\u0370-\u0400\u0460-\u0fff\uac00-\ud7a3]")),
    (1.4, re.compile(r"(?<!\S)[㐀-鿿](?!\S)")),
    (0.1, re.compile(r"[À-ž]")),
    (0.3, re.compile(r"[Ā-ž]")),
    (0.02, re.compile(r"[^\x00-\xff]")),
    # escapes count only where two in a row spell what may be a multi-byte character
    (3.0, re.compile(r"&(?:[AEIOUaeiou](?:tilde|circ|grave|acute|uml)|aring|Aring|ETH|Ntilde|eth);(?=&(?!lt|gt|amp|nbsp))|&#(?:x[c-fC-F][0-9a-fA-F]|19[2-9]|2[0-4]\d);(?=&#)|\\u00[c-fC-F][0-9A-Fa-f](?=\\u00[89abAB])|\\x[c-fC-F][0-9A-Fa-f](?=\\x[89abAB])")),
]
#: Where a text has none of these, it needs no closer look.
GATE = re.compile("|".join(f"(?:{p.pattern})" for w, p in SIGNALS if w >= 1.5) + r"|[А-ЯЁ]{4}")


def _unsuspected() -> str:
    """Characters that no signal but those of PLAIN_TOO can rest on, as a class: small accented letters, Cyrillic, everyday CJK, usual marks.

    CJK characters that the bytes of accented letters turn into are left out.
    """
    accents = {bytes([a, b]).decode("gbk", "ignore") for a in (0xC2, 0xC3) for b in range(0x80, 0xC0)}
    cjk = "".join(c for c in map(chr, range(0x4E00, 0xA000)) if c not in _RARE_SET and c not in accents)
    return "äöüßéèêëàâçîïôùûœáíóúñãõ’‘“”–—…。，：；！？、（）《》【】「」" + "А-Яа-яЁё" + cjk


_RARE_SET = set(re.findall(f"[{_RARE}]", "".join(map(chr, range(0x3400, 0xA000)))))
#: A quick test before the gate: texts of everyday characters only can't be garbled, but for what PLAIN_TOO shows.
SUSPECT = re.compile(rf"[^\x00-\x7f{_unsuspected()}]")
PLAIN_TOO = re.compile(r"[А-ЯЁ]{4}|[а-яё][А-ЯЁ]|[А-ЯЁа-яё][“–—…]|[à-ÿ]{3}|[a-z][“–—](?=[a-z])")
# The accented letters of the corpus's languages in Latin script.
ALPHABETS = ("äöüß", "éèêëàâçîïôùûœæÿ", "áéíóúñü", "áâãàçéêíóôõú", "áčďéěíňóřšťúůýž", "ąćęłńóśźż")
_ACCENTED = re.compile("[à-öø-ÿßœā-ž]")
_INSIDE = re.compile(rf"(?<={_LETTER})[«»°²³¹ºªⁿ‘”“„‚](?={_LETTER})")
_RANK = {c: i for i, c in enumerate(RUSSIAN)}
_CYR_ALL = re.compile(f"[{_CYR}]")
_EXAMPLE = re.compile(rf"“[^“”\n]{{1,{QUOTED}}}”|\"[^\"\n]{{1,{QUOTED}}}\"|«[^«»\n]{{1,{QUOTED}}}»|„[^„“\n]{{1,{QUOTED}}}“|‘[^‘’\n]{{1,{QUOTED}}}’|「[^「」\n]{{1,{QUOTED}}}」|`[^`\n]{{1,{QUOTED}}}`|'[^'\n]{{1,{QUOTED}}}'")


@lru_cache(2_000)
def cost(text: str) -> float:
    """How implausible a text is; 0 for plain ASCII."""
    if text.isascii() and "&" not in text and "\\" not in text:
        return 0.0
    total = sum(w * len(p.findall(text)) for w, p in SIGNALS)
    total += 2.5 * len(_INSIDE.findall(text))
    accented = _ACCENTED.findall(text.lower())
    if accented:  # one language's letters go together
        total += 0.5 * min(sum(c not in a for c in accented) for a in ALPHABETS)
    letters = _CYR_ALL.findall(text)
    if letters:
        # common letters first: sound Russian has a mean rank of about 8, shuffled letters one of 16
        total += max(0.0, sum(_RANK.get(c.lower(), 33) for c in letters) / len(letters) - 9.5) * len(letters) * 0.15
    return total


def to_bytes(text: str, encoding: str) -> bytes | None:
    """Strict encoding; cp1252 lets the control characters through that some decoders put in its gaps."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding != "cp1252":
            return None
    try:
        return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)
    except UnicodeEncodeError:
        return None


def to_text(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def unescape(text: str) -> str:
    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1] or m[2], 16)), html.unescape(text))


Step = tuple[str, str]


def steps(text: str) -> Iterator[tuple[Step, str]]:
    """All texts one step away, those that come out of strict UTF-8 first."""
    if "&" in text or "\\" in text:
        yield ("unescape", ""), unescape(text)
    raws = [(e, raw) for e in ENCODINGS if (raw := to_bytes(text, e)) is not None]
    for e, raw in raws:
        if (whole := to_text(raw, "utf-8")) is not None:
            yield (e, "utf-8"), whole
    for e, raw in raws:
        for d in ENCODINGS:
            if d != e and (out := to_text(raw, d)) is not None:
                yield (e, d), out


def follow(text: str, path: tuple[Step, ...]) -> str | None:
    for a, b in path:
        if a == "unescape":
            text = unescape(text)
            continue
        raw = to_bytes(text, a)
        text = None if raw is None else to_text(raw, b)
        if text is None:
            return None
    return text


def toll(path: tuple[Step, ...]) -> float:
    """What a path costs by itself: longer ones more, and steps that don't end in strict UTF-8 more, as almost any bytes pass those."""
    return sum(0.2 if to in ("utf-8", "") else 0.8 for _, to in path)


def plausible(text: str, price: float) -> bool:
    """Whether what a text costs is no more than what its script costs anyway."""
    return price < 0.8 + 0.021 * sum(c > "\xff" for c in text) + 0.11 * len(_ACCENTED.findall(text))


@lru_cache(20_000)
def search(text: str) -> tuple[str, tuple[Step, ...]]:
    """The cheapest reachable text and the path to it, by best-first search: of all texts reached the one of least cost goes on, be it dearer
    than what it came from. Steps cost a little themselves, so the shortest of equal paths wins.

    A text that is reached again is not gone on with, unless by a cheaper path. The search ends when the cheapest text is plausible or nothing
    is left within DEARER of it. The result depends on the text alone: what is remembered are results of whole searches.
    """
    best, way = text, ()
    lowest = cost(text)
    queue, seen, n = [(lowest, 0, text, ())], {text: 0.0}, 0
    while queue:
        c, _, at, path = heapq.heappop(queue)
        if c > DEARER * lowest + 3 or plausible(best, lowest):
            break
        for step, after in steps(at):
            further = (*path, step)
            fare = toll(further)
            if seen.get(after, fare + 1.0) <= fare:
                continue
            seen[after] = fare
            price = cost(after) + fare
            if price < lowest:
                best, way, lowest = after, further, price
                if step[1] == "utf-8" and plausible(best, lowest):  # hardly any bytes pass as UTF-8 and read well by chance
                    return best, way
            if len(further) < DEPTH and price <= DEARER * lowest + 3:
                n += 1
                heapq.heappush(queue, (price, n, after, further))
    return best, way


def cheapest(text: str, known: list[tuple[Step, ...]]) -> tuple[str, tuple[Step, ...]]:
    """``search``, but paths ``known`` from other lines of the same record are tried first and taken if they leave a plausible text."""
    before, best = cost(text), None
    for path in known:
        after = follow(text, path)
        if after is not None and after != text and cost(after) < 0.15 * before and plausible(after, cost(after)):
            found = (cost(after) + toll(path), path, after)
            best = min(best, found) if best else found
    if best:
        return best[2], best[1]
    return search(text)


_RUN = re.compile(r"\S*[^\x00-\x7f]\S*(?:[ \xa0]\S*[^\x00-\x7f]\S*)*")


def better(before: str, after: str) -> bool:
    a, b = cost(before), cost(after)
    return after != before and a - b >= GAIN and b <= SHARE * a


def restore_line(line: str, known: list[tuple[Step, ...]]) -> str:
    """The line mended as a whole if strict UTF-8 came out or most of it was garbled, else each run of words with characters beyond ASCII on
    its own if that is cheaper."""
    whole, path = cheapest(line, known)
    if better(line, whole) and (all(to == "utf-8" for _, to in path) or sum(c > "\x7f" for c in line) > 0.2 * len(line)):
        known += [path] if path not in known else []
        return whole

    fares = [0.0]

    def run(m: re.Match) -> str:
        after, way = cheapest(m[0], known)
        if not better(m[0], after):
            return m[0]
        fares.append(toll(way))
        return after

    parts = _RUN.sub(run, line)
    return whole if better(line, whole) and cost(whole) + toll(path) < cost(parts) + max(fares) else parts


def suspicious(text: str) -> bool:
    if text.isascii():
        return ("&" in text or "\\" in text) and bool(SIGNALS[-1][1].search(text))
    return bool(SUSPECT.search(text) or PLAIN_TOO.search(text) or SIGNALS[-1][1].search(text)) and bool(GATE.search(text))


def restore(text: str) -> tuple[str, bool]:
    """(restored text, found): what can't be mended stays as it is, but counts as found if it shows broken characters.

    Only quoted examples of garbled characters are no find.
    """
    if not suspicious(text):
        return text, False
    lines, found, known = text.split("\n"), False, []
    for i, line in enumerate(lines):
        if not line or not GATE.search(line):
            continue
        bare = _EXAMPLE.sub("", line)
        if bare != line and not GATE.search(bare):
            continue
        after = restore_line(line, known)
        # a repair may need the quoted places too; then most of the damage must lie outside them
        outside = bare == line or cost(bare) >= max(GAIN, 0.5 * cost(line))
        if better(line, after) and outside or bare != line and better(bare, restore_line(bare, known)):
            found, lines[i] = True, after
        elif BROKEN.search(bare):
            found = True
    return "\n".join(lines), found


def restored(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, content, found) of each row. Null and empty contents come back as they are and are no finds. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [restore(t) if t else (t, False) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([f for _, f in out], pa.bool_())], names=[key, "content", "found"])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, content string, found boolean")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id) of files whose content shows characters of a wrong encoding, restorable or not."""
    return restored(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content"))).where("found").select("file_id").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): the mended contents of the files found."""
    return restored(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content"))).where("found").select("file_id", F.col("content")).distinct()
