"""Template residue and error-page text: labelled exemplars retrieved through an inverted index, scored by TF-IDF containment.

A text is cut into passages: sentences, lines and windows between template delimiters. A passage's terms retrieve the exemplars that share
weighty terms with it. An exemplar matches if most of its weight is contained in the passage and it covers most of the passage, so a
sentence that merely mentions an error or a script is no match.

Exemplars are a few general sentences with labels (seeds), and passages learned from the corpus itself: what stands again and again in
documents that seeds match, and hardly anywhere else. Names of placeholders are learned from windows whose shape says what they are.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, zip_longest

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import spread, table

#: Least share of an exemplar's weight in a passage, and of a passage's weight that the exemplar covers.
CONTAINED, COVERED = 0.75, 0.6
#: Filler Latin needs so many of its words in a passage.
FILLER_WORDS = 4
#: Documents that a learned passage or name must stand in, and the least share of a passage's documents that seeds or learned passages match.
LEAST, SHARE = 2, 0.6
#: Passages and characters of them in one index, and names of placeholders beside them. What is learned beyond that makes more indexes, each
#: over the texts on its own.
PASSAGES, CHARACTERS, NAMES = 20_000, 4_000_000, 100_000
#: Times that learning goes on from what it has learned.
ROUNDS = 1
#: Answers that an index keeps for passages and for terms found together, and the terms that one may have.
KEPT, KEPT_TERMS = 20_000, 50
#: Characters of keys that a worker counts before it hands the counts on.
HELD = 8_000_000
#: Bytes of texts, about, that a worker takes out of a batch at once, and characters of a long text that it cuts to words or passages at once.
TAKEN, PIECE = 16_000_000, 500_000

# Labelled exemplars, general ones in the corpus's languages. A passage has to hold one sentence.
SEEDS = {
    "script": """
Please enable JavaScript to view this page.
You need to enable JavaScript to run this app.
You need to turn on scripts and cookies.
This page needs JavaScript, which is switched off in your browser.
JavaScript seems to be switched off in your browser.
JavaScript is disabled in your browser.
Your browser is not supported. Please update it.
Please update your browser to view this page.
Scripts must be allowed to continue.
Checking your browser before opening the page.
Confirm that you are not a robot.
Veuillez activer JavaScript pour afficher
JavaScript est désactivé dans votre navigateur.
Votre navigateur n’est pas pris en charge.
Bitte aktivieren Sie JavaScript, um die Seite anzuzeigen.
Für diese Seite wird JavaScript benötigt.
Ihr Browser wird nicht unterstützt.
Active JavaScript para ver este
Su navegador no es compatible.
Ative o JavaScript para ver
O seu navegador não é suportado.
Включите JavaScript, чтобы открыть
Ваш браузер не поддерживается.
请启用 JavaScript 后再查看此文。
您的浏览器不支持脚本，无法显示页面。
您的浏览器版本过低，请升级浏览器。
""",
    "error": """
The requested page could not be found on this server.
Page not found.
We can't find that page. It may have been moved or renamed.
404 Not Found
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Bad request: a parameter is missing.
Gateway timed out
Access denied
You do not have permission to open this page.
Your session has expired. Log in again to continue.
Your session has ended.
Fatal error: uncaught exception in
Oops! Something went wrong on our end.
The server is too busy right now. Please try again in a few minutes.
Please try again later.
Too many requests
is down for maintenance. Come back soon.
took too long to respond.
refused the request.
has expired or was removed by its owner.
No preview available: the server answered with status
Fehler 404: Die angeforderte Seite wurde nicht gefunden.
Zugriff verweigert.
Der Dienst ist vorübergehend nicht erreichbar.
Erreur 404 : la page demandée est introuvable.
Accès refusé.
Service momentanément indisponible.
Error 404: no se ha encontrado la página solicitada.
Acceso denegado.
Servicio no disponible temporalmente.
Erro 404: a página solicitada não foi encontrada.
Acesso negado.
Serviço temporariamente indisponível.
Ошибка 404: страница не найдена.
Доступ запрещён.
Сервис временно недоступен.
页面不存在
您没有权限访问此页面，请先登录。
您访问的页面不存在或已被删除。
服务器内部错误，请稍后再试。
系统维护中，请稍后再试。
""",
    "filler": """
Text goes here.
Your text here.
Insert text here.
This is sample text. Replace it with your own.
This is placeholder text.
Text to follow.
Copy to follow.
Body copy
Dies ist ein Blindtext.
Hier steht Text.
Ceci est un texte d’exemple.
Texto de ejemplo.
Texto de exemplo.
Здесь будет текст.
这里是示例文字，请替换为正文内容。
此处为示例文本
测试测试
""",
}
# The usual filler passage.
LOREM = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim
veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate
velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit
anim id est laborum.
"""
# Words that ask to fill in what follows.
FILL_IN = set("insert enter fill add your compléter insérer saisir votre einfügen eintragen ausfüllen ergänzen ihr insertar ingrese rellenar completar su inserir preencher seu введите укажите вставьте заполнить".split())
#: Names in braces with a dollar sign that scripts read from their environment.
ENVIRONMENT = {"home", "path", "user", "pwd", "shell", "tmpdir", "lang", "pythonpath", "java_home"}

# Shapes of placeholders by how they open. Those of STRICT count whatever they name, those of LOOSE only with a known name.
STRICT = re.compile(r"\{\{\s?([^{}\n]{1,60}?)\s?\}\}|<%=?\s?([^%<>\n]{1,60}?)\s?%>|\{%\s([^%{}\n]{1,60}?)\s%\}|@@([^@\n]{2,60}?)@@|%%([^%\n]{2,60}?)%%|\[(?:INSERT|TODO:|TBD:|FILL IN:?)\s([^\]\n]{1,60})\]|\bXX([^X\W][^X\n]{1,58}?)XX\b|<([^<>\n]{2,60}?) here>")
LOOSE = re.compile(r"\$\{([^{}\n]{1,60}?)\}|#\{([^{}\n]{1,60}?)\}|\{([^{}\n:\"']{2,60}?)\}|\[\[([^\[\]\n|]{2,60}?)\]\]|\[([^\[\]\n]{2,60}?)\]|【([^】\n]{1,60}?)】|<<([^<>\n]{2,60}?)>>|__([^\W_][^\n]{0,58}?)__|%([^%\s\d][^%\n]{1,58}?)%")
DELIMITERS = re.compile(r"[{\[【@%<]|__|XX")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<(?:pre|code)\b.*?</(?:pre|code)>", re.S)
PASSAGE = re.compile(r"\n|(?<=[.!?。！？])\s*|<[^<>\n]{1,200}>|(?<=\d\)) +(?=\w)")
TERMS = re.compile(r"[㐀-䶿一-鿿]+|[^\W\d_㐀-䶿一-鿿]+")
BESIDE_DIGITS = re.compile(r"[A-Za-z_.\-]*\d[\dA-Za-z_.\-]*")
TAG = re.compile(r"</?[A-Za-z!][^<>\n]{0,200}>")


def terms(passage: str) -> list[str]:
    """Words in lower case, but for those beside digits, and pairs of neighbouring CJK characters."""
    out = []
    for run in TERMS.findall(BESIDE_DIGITS.sub(" ", passage.lower())):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if "㐀" <= run[0] <= "鿿" else [run]
    return out


def seeds() -> list[tuple[str, tuple[str, ...]]]:
    """(label, terms) of each seed sentence."""
    return [(label, tuple(t)) for label, text in SEEDS.items() for line in text.strip().split("\n") for s in PASSAGE.split(line) if (t := terms(s))]


TERMS_OF_NAME = re.compile(r"[^\W_]+")
#: Terms that stand for a delimiter's shape, for a placeholder's name and for a word that asks to fill something in.
SHAPE, NAME, ASKS = "\x01shape", "\x01name", "\x01asks"
#: What a placeholder is: a shape that says so by itself, or another one around a known name or a request.
PLACEHOLDERS = [("placeholder", (SHAPE + "!",)), ("placeholder", (SHAPE, NAME)), ("placeholder", (SHAPE, ASKS))]


def name_of(m: re.Match) -> str:
    return "_".join(TERMS_OF_NAME.findall(next(g for g in m.groups() if g is not None).lower()))


def windows(bare: str) -> Iterator[tuple[bool, str]]:
    """(whether its shape says that it is a placeholder, name) of what stands between template delimiters in a text without code."""
    for m in STRICT.finditer(bare):
        if m[0].startswith("XX") or TERMS_OF_NAME.search(m[0]):
            yield True, name_of(m)
    for m in LOOSE.finditer(bare):
        yield False, name_of(m)


def window_terms(strict: bool, name: str, known: frozenset[str]) -> list[str]:
    """A window as terms: its shape, and its name masked if it is known or asks to be filled in."""
    words = name.split("_")
    if strict:
        return [SHAPE + "!"]
    if name in ENVIRONMENT:
        return [SHAPE, name]
    if name in known:
        return [SHAPE, NAME]
    if (2 <= len(words) <= 4 and not FILL_IN.isdisjoint(words)) or name.startswith(("请填写", "此处填写")):
        return [SHAPE, ASKS]
    return [SHAPE, *words]


#: What ends a sentence or a line.
ENDS = re.compile(r"[\n.!?。！？]")


def stretch_start(low: str, at: int, least: int = 0) -> int:
    """Where the stretch around a place begins, which is at ``least`` or behind it."""
    return max(least, 1 + max(low.rfind(c, least, at) for c in "\n.!?。！？"))


def without_code(text: str) -> str:
    return CODE.sub(" ", text) if "`" in text or "~~~" in text or "<" in text else text


def pieces(text: str) -> Iterator[str]:
    """A text, cut at ends of lines if it is long, so that what is made of it at once doesn't grow with it. No passage goes over lines."""
    start = 0
    while len(text) - start > PIECE and (end := text.find("\n", start + PIECE)) >= 0:
        yield text[start : end + 1]
        start = end + 1
    yield text[start:]


class Weights:
    """Inverse document frequencies over all documents of the terms that exemplars have; a term that none has weighs as much as the rarest."""

    def __init__(self, counts: dict[str, int], total: int):
        self.known = {t: math.log(1 + (total + 1) / (1 + n)) for t, n in counts.items()}
        self.plain = max(self.known.values(), default=1.0)

    def __getitem__(self, term: str) -> float:
        return 1.0 if term[0] == "\x01" else self.known.get(term, self.plain)


def document_terms(text: str, single: set[str], double: set[str]) -> set[str]:
    """Which of some words and pairs of CJK characters a document has."""
    found = set()
    for piece in pieces(text):
        low = piece.lower()
        found |= single.intersection(_LETTERS.findall(low))
        if double and _CJK.search(low):
            found |= {t for t in double if t in low} if len(double) < len(low) else double & {*low, *map("".join, zip(low, low[1:]))}
    return found


_CJK = re.compile("[㐀-鿿]")


_LETTERS = re.compile(r"[^\W\d_]+")


class Latin:
    """Filler Latin, whole or worn: a word counts if the usual passage has it, or if all its triples of letters but one stand in the passage written
    without spaces, so that torn and joined words count as well."""

    def __init__(self):
        words = re.findall(r"[a-z]+", LOREM.lower())
        run = "".join(words)
        self.words, self.triples = set(words), {run[i : i + 3] for i in range(len(run) - 2)}
        self.known: dict[str, bool] = {}

    def __call__(self, word: str) -> bool:
        if word in self.words:
            return True
        if len(word) < 5 or not word.isascii():
            return False
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            missing = sum(word[i : i + 3] not in self.triples for i in range(len(word) - 2))
            self.known[word] = missing <= (len(word) > 5)
        return self.known[word]


class Index:
    """The inverted index: each exemplar under its weightiest terms, found in a text by one automaton.

    As many terms are taken as leave the rest below CONTAINED, so what passes the thresholds has one of them. A stretch of text
    without a sentence's end is cut to passages and scored only if the terms found in it, and all that aren't in the automaton, could make up
    CONTAINED of some exemplar.
    """

    def __init__(self, weights: Weights, names: frozenset[str], learned: list[tuple[str, tuple[str, ...]]], alone: bool = False):
        """``alone``: without the seeds and placeholders, and without filler Latin."""
        self.weights, self.names = weights, names
        self.postings: dict[str, list[tuple[str, dict[str, float], float]]] = defaultdict(list)
        self.shares: dict[str, list[tuple[int, float, float]]] = defaultdict(list)  # (exemplar, the term's weight, weight that is needed of such terms)
        for k, (label, ts) in enumerate(dict.fromkeys(learned if alone else [*seeds(), *learned, *PLACEHOLDERS])):
            own = {t: weights[t] * n for t, n in Counter(ts).items()}
            weight = sum(own.values())
            rest, posted = weight, []
            for t in sorted(own, key=lambda t: (len(t) > 2 or t >= "\u3400" or t[0] == "\x01", own[t]), reverse=True):  # short words stand in many others
                if rest < (CONTAINED - 1e-9) * weight:
                    break
                self.postings[t].append((label, own, weight))
                posted.append(t)
                rest -= own[t]
            for t in posted:
                self.shares[t].append((k, own[t], (CONTAINED - 1e-9) * weight - rest))
        self.latin = Latin()
        self.matched: dict[tuple[str, ...], str | None] = {}
        self.judged: dict[frozenset[str], bool] = {}
        self.anchors = set() if alone else {w for w in self.latin.words if len(w) > 4}
        self.alone = {t for t, shares in self.shares.items() if any(w >= need for _, w, need in shares)} | self.anchors
        self.found = ahocorasick.Automaton()
        for t in {*self.postings, *self.anchors}:
            if t[0] != "\x01":
                self.found.add_word(t, (len(t), t))
        self.found.make_automaton()

    def match(self, ts: list[str] | tuple[str, ...]) -> str | None:
        """The label of the exemplar that terms match, or None. Answers for short passages are kept, as many come again."""
        if len(ts) > KEPT_TERMS:
            return self._match(ts)
        key = tuple(ts)
        if key not in self.matched:
            if len(self.matched) >= KEPT:
                self.matched.clear()
            self.matched[key] = self._match(key)
        return self.matched[key]

    def _match(self, ts: list[str] | tuple[str, ...]) -> str | None:
        counts = Counter(ts)
        latin = sum(n for t, n in counts.items() if self.latin(t))
        if latin >= FILLER_WORDS and latin >= COVERED * len(ts):
            return "filler"
        total = sum(self.weights[t] * n for t, n in counts.items())
        for t in counts:
            for label, own, weight in self.postings.get(t, ()):
                if total < (CONTAINED - 1e-6) * weight or weight < (COVERED - 1e-6) * total and label != "filler":
                    continue  # what both have is no more than either
                both = sum(min(self.weights[k] * counts[k], w) for k, w in own.items() if k in counts)
                repeats = 1
                if label == "filler" and both >= 0.99 * weight:
                    repeats = max(1, min(counts[k] * self.weights[k] / w for k, w in own.items()))
                if both >= (CONTAINED - 1e-9) * weight and both * repeats >= COVERED * total:
                    return label
        return None

    def worth(self, hits: set[str]) -> bool:
        """Whether terms found together could make up enough of an exemplar."""
        if not self.alone.isdisjoint(hits):
            return True
        if len(hits) < 2:
            return False
        if len(hits) > KEPT_TERMS:
            return self._worth(hits)
        key = frozenset(hits)
        if key not in self.judged:
            if len(self.judged) >= KEPT:
                self.judged.clear()
            self.judged[key] = self._worth(key)
        return self.judged[key]

    def _worth(self, hits: set[str] | frozenset[str]) -> bool:
        have: dict[int, float] = defaultdict(float)
        for t in hits:
            for k, w, need in self.shares[t]:
                have[k] += w
                if have[k] >= need:
                    return True
        return False

    def passages(self, bare: str) -> Iterator[tuple[str, ...]]:
        """The terms of the passages that may match an exemplar of the index."""
        if len(self.found):
            for piece in pieces(bare):
                yield from self._passages(piece.lower())

    def _passages(self, low: str) -> Iterator[tuple[str, ...]]:
        hits, last, least = set(), -1, 0
        for end, (size, term) in self.found.iter(low):
            start = end - size + 1
            if term < "\u3400" and (low[end + 1 : end + 2].isalpha() or start and low[start - 1].isalpha()):
                continue  # within a word
            if hits and last < start and (ends := ENDS.search(low, last + 1, start)):
                yield from self._cut(low, last, hits, least)
                hits, least = set(), ends.end()
            hits.add(term)
            last = max(last, end)
        yield from self._cut(low, last, hits, least)

    def _cut(self, low: str, at: int, hits: set[str], least: int) -> Iterator[tuple[str, ...]]:
        """The passages of the stretch around a place, if what was found there is worth it; no stretch before ``least`` is looked at again."""
        if not hits or not self.worth(hits):
            return
        a, z = stretch_start(low, at, least), ENDS.search(low, at + 1)
        for passage in PASSAGE.split(low[a : z.end() if z else len(low)]):
            if passage and not passage.isspace() and (ts := terms(passage)):
                yield tuple(ts)

    def residue(self, text: str | None, with_windows: bool = True) -> str | None:
        """The label of a text's first residue, or None for real content. Null, empty and blank texts have none."""
        if not text or not text.strip():
            return None
        bare = without_code(text)
        for ts in self.passages(bare):
            if label := self.match(ts):
                return label
        if with_windows and DELIMITERS.search(bare):
            bare = CODE.sub(" ", text)
            for strict, name in windows(bare):
                if label := self.match(window_terms(strict, name, self.names)):
                    return label
        return None


def in_parts(column: pa.Array) -> Iterator[list]:
    """A column's texts, a few at once."""
    step = max(1, TAKEN * len(column) // (column.nbytes + 1))
    return (column.slice(k, step).to_pylist() for k in range(0, len(column), step))


def tallied(keys: Callable[[str], set[str]], batches: Iterator[list], held: int = HELD) -> Iterator[Counter]:
    """How many texts of some batches have each key. Counts are handed on whenever ``held`` characters of keys went into them, so that what
    is in memory at once doesn't grow with the texts of a task; the same key may come again."""
    counts, size = Counter(), 0
    for texts in batches:
        for text in texts:
            if text:
                counts.update(own := keys(text))
                size += sum(map(len, own))
                if size >= held:
                    yield counts
                    counts, size = Counter(), 0
    if counts:
        yield counts


def _texts(docs: DataFrame, maker: Callable[[], Callable[[list], Iterator[set[str]]]]) -> DataFrame:
    """(key, n): how many texts have each key, by a scan of the table in its own partitions. ``maker`` makes a task's function, which gives the
    keys of each of some texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = maker()
        for counts in tallied(lambda own: own, (keys(texts) for batch in batches for texts in in_parts(batch.column(0)))):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    return docs.select("text").mapInArrow(each, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def in_blocks(lines: Iterable[str], most: int, characters: int = CHARACTERS) -> list[str]:
    """All lines, in blocks of at most so many lines and, but for a single line, characters."""
    out, own, size = [], [], 0
    for line in lines:
        if own and (len(own) >= most or size + len(line) > characters):
            out.append("\n".join(own))
            own, size = [], 0
        own.append(line)
        size += len(line)
    return [*out, "\n".join(own)] if own else out


def in_turn(blocks: list, make: Callable) -> Callable[[], Iterator]:
    """Gives what is made of each block's number and block, one after the other and made anew each time; of a single block it is kept."""
    if len(blocks) > 1:
        return lambda: (make(k, block) for k, block in enumerate(blocks))
    kept = [make(k, block) for k, block in enumerate(blocks)]
    return lambda: iter(kept)


def indexes(weights: Weights, names: list[str], known: list[str]) -> Callable[[], Iterator[Index]]:
    """The indexes of blocks of names and of exemplars (lines of a label and terms); the first has the seeds as well."""

    def make(k: int, block: tuple[str, str]) -> Index:
        exemplars = [(label, tuple(ts)) for label, *ts in (line.split(" ") for line in sorted(block[1].split("\n")) if line)]
        return Index(weights, frozenset(block[0].split("\n")) - {""}, exemplars + PLACEHOLDERS * (k > 0), alone=k > 0)

    return in_turn(list(zip_longest(names, known, fillvalue="")) or [("", "")], make)


def labels(texts: list, each: Callable[[], Iterator[Index]], with_windows: bool = True) -> list[str | None]:
    """The label of each text by the first index that has one for it."""
    out: list[str | None] = [None] * len(texts)
    for index in each():
        out = [label or index.residue(text, with_windows) for label, text in zip(out, texts)]
    return out


def counted(docs: DataFrame, wanted: set[str]) -> tuple[dict[str, int], int, list[str]]:
    """(documents by term, documents, names): in how many documents the wanted terms stand, and blocks of all names of placeholders whose shape
    says what they are. The driver gets a row a term and name."""
    single, double = {t for t in wanted if not "㐀" <= t[0] <= "鿿"}, {t for t in wanted if "㐀" <= t[0] <= "鿿"}

    def keys(text: str) -> set[str]:
        names = {"=" + name for strict, name in windows(CODE.sub(" ", text)) if strict and name} if DELIMITERS.search(text) else set()
        return document_terms(text, single, double) | names

    rows = _texts(docs, lambda: lambda texts: (keys(text) for text in texts if text))
    df, names = dict.fromkeys(wanted, 0), []
    for r in rows.where(~F.col("key").startswith("=") | (F.col("n") >= LEAST)).toLocalIterator():
        if r.key[0] == "=":
            names.append(r.key[1:])
        else:
            df[r.key] = r.n
    return df, docs.count(), in_blocks(sorted(names), NAMES)


def learned(docs: DataFrame, counts: dict[str, int], total: int, names: list[str]) -> list[str]:
    """Blocks of exemplars (lines of a label and terms): all passages that stand in documents that seeds match and hardly anywhere else;
    ``counts`` gets the documents of their terms.

    In each round one scan finds the documents that match so far and counts their passages, of which those of LEAST documents are candidates;
    another counts the candidates, and their terms, in all documents. Candidates of which at least SHARE of the documents match are exemplars
    of the next round. The driver holds the candidates as text, and their terms; a worker has one block of them in an index at a time.
    """
    spark, known = docs.sparkSession, []
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((Weights(counts, total), names, known))

        def matched(shared=shared) -> Callable[[list], Iterator[set[str]]]:
            each = indexes(*shared.value)

            def keys(texts: list) -> Iterator[set[str]]:
                for text, label in zip(texts, labels(texts, each, with_windows=False)):
                    if label:
                        own = {" ".join(terms(p)) for piece in pieces(without_code(text)) for p in PASSAGE.split(piece.lower()) if p and not p.isspace()}
                        yield {label + " " + p for p in own if " " in p}

            return keys

        rows = _texts(docs, matched).where(F.col("n") >= LEAST).selectExpr("substring_index(key, ' ', 1) AS label", "substring(key, instr(key, ' ') + 1) AS passage", "n")
        rows = rows.groupBy("passage").agg(F.sum("n").alias("n"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        hits = in_blocks((f"{r.n} {r.label} {r.passage}" for r in rows.orderBy(F.desc("n"), "passage").toLocalIterator()), PASSAGES)
        firsts = [0, *accumulate(block.count("\n") + 1 for block in hits)]  # the number of each block's first candidate
        new = {t for block in hits for line in block.split("\n") for t in line.split(" ")[2:]} - counts.keys()
        candidates = spark.sparkContext.broadcast((Weights(counts, total), hits, firsts, new))

        def everywhere(candidates=candidates) -> Callable[[list], Iterator[set[str]]]:
            weights, hits, firsts, new = candidates.value
            single, double = {t for t in new if not "㐀" <= t[0] <= "鿿"}, {t for t in new if "㐀" <= t[0] <= "鿿"}

            def make(k: int, block: str) -> tuple[Index, dict[tuple[str, ...], str]]:
                numbers = {tuple(line.split(" ")[2:]): str(n) for n, line in enumerate(block.split("\n"), firsts[k])}
                return Index(weights, frozenset(), [("c", ts) for ts in numbers], alone=True), numbers

            each = in_turn(hits, make)

            def keys(texts: list) -> Iterator[set[str]]:
                for index, numbers in each():
                    for text in texts:
                        if text:
                            yield {numbers[ts] for ts in index.passages(without_code(text)) if ts in numbers}
                for text in texts:
                    if text:
                        yield {"=" + t for t in document_terms(text, single, double)}

            return keys

        counts.update(dict.fromkeys(new, 0))
        totals = array("q", bytes(8 * firsts[-1]))
        if hits:
            for r in _texts(docs, everywhere).toLocalIterator():  # a row a candidate and term
                if r.key[0] == "=":
                    counts[r.key[1:]] = r.n
                else:
                    totals[int(r.key)] = r.n
        lines = zip((line.split(" ", 1) for block in hits for line in block.split("\n")), totals)
        known = in_blocks((line for (n, line), everywhere in lines if int(n) >= SHARE * max(1, everywhere)), PASSAGES)
    return known


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, label) of each document: placeholder, filler, error or script where real content should be, null for real content.

    Scans of the table in its own partitions: one counts terms, two a round learn, one scores. All that is learned is broadcast as text; a
    worker has PASSAGES exemplars and NAMES names in an index at a time.
    """
    counts, total, names = counted(docs, {t for _, ts in seeds() for t in ts})
    known = learned(docs, counts, total, names)
    shared = docs.sparkSession.sparkContext.broadcast((Weights(counts, total), names, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = indexes(*shared.value)
        for batch in batches:
            found = [label for texts in in_parts(batch.column(1)) for label in labels(texts, each)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "label"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, label string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of documents with residue instead of content."""
    return labelled(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).where(F.col("label").isNotNull()).select("doc_id").distinct()


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents that stay in the corpus."""
    return labelled(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).where(F.col("label").isNull()).select("doc_id").distinct()
