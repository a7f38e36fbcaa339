"""Markup residue in text documents: which languages a content is written in, and the content as plain text.

Page differencing (``pagediff``) finds lines that pages share, but it neither names a language nor keeps what a page has alone, so each
language is recognised by its own constructs, with program source and quoted code masked first, and converted construct by construct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.session import spread, table

# Element names of HTML; others in angle brackets are data or type parameters.
ELEMENTS = """
a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font
footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav ol option p pre q s samp script
section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var
""".split()
# Named characters that ordinary text does not spell by chance.
ENTITIES = "nbsp amp lt gt quot apos mdash ndash hellip copy reg trade laquo raquo ldquo rdquo lsquo rsquo bull middot times deg euro auml ouml uuml Auml Ouml Uuml szlig eacute egrave ecirc agrave acirc ccedil ntilde iacute oacute uacute aacute".split()

FENCED = re.compile(r"^ {0,3}(```|~~~)[^\n]*\n.*?(?:^ {0,3}\1[^\n]*$|\Z)", re.M | re.S)
INLINE = re.compile(r"`[^`\n]+`")
PRE = re.compile(r"(<(pre|code|script|style|syntaxhighlight|source|nowiki)\b[^<>]*>).*?(</\2>|\Z)", re.S | re.I)
VERBATIM = re.compile(r"(\\begin\{(verbatim|lstlisting|minted)\}).*?(\\end\{\2\}|\Z)", re.S)
#: A line of program source, with its trailing comment.
SOURCE = re.compile(
    r"^[ \t]*(?:(?:pub |async |export |static |public |private )*(?:def|class|fn|struct|impl|enum|trait|interface|func|function|namespace|package)\b.*[:{(;][^\n]*"
    r"|(?:if|for|while|else|elif|match|switch|try|except|with)\b[^\n.]*[:{][^\n]*|(?:return|import|from|let|const|var|use|yield|raise|assert)\b[^\n]*[;()\[\]=.:][^\n]*"
    r"|[\w.\[\]]+ ?[-+*/]?= ?[^=\n][^\n]*[\w)\]}'\";][^\n]*|[\w.:&*]+\([^\n]*\)[;,]?(?:[ \t]*(?:#|//)[^\n]*)?|[\w_]+: [\w<>&\[\], :]+,(?:[ \t]*//[^\n]*)?|[}\])]+[;,]?(?:[ \t]*(?:#|//)[^\n]*)?|[^\n]*;[ \t]*(?://[^\n]*)?|[^\n]*\{[ \t]*(?://[^\n]*)?)$",
    re.M,
)
COMMENT = re.compile(r"^[ \t]*(?:#(?!#)|//)[^\n]*$", re.M)

TAG = re.compile(rf"</?(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)?/?>|<!DOCTYPE\s+html|<!--", re.I)
ENTITY = re.compile(rf"&(?:{'|'.join(ENTITIES)}|#\d{{2,5}}|#x[0-9A-Fa-f]{{2,5}});")
MD_STRONG = re.compile(
    r"!?\[[^\]\[\n]+\]\([^)\n]+\)|(?<!\[)\[[^\]\[\n]+\]\[[\w ]+\]|\*\*(?=\S)[^*\n]*\S\*\*|^ {0,3}(?:```|~~~)|^[ \t]*[-*+] \[[ xX]\] |^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*$", re.M
)
MD_HEADING = re.compile(r"(?:\A|\n[ \t]*\n) {0,3}#{1,6} +[^\n]+(?=\n[ \t]*\n|\s*\Z)")
MD_SETEXT = re.compile(r"(?:\A|\n[ \t]*\n)[^\s|,{}\[\]<>=-][^\n]*[^\s\n:;,{]\n(?:=+|-{3,})[ \t]*(?=\n|\Z)")
MD_SPAN = re.compile(r"`[^`\n]+`|(?<![\w_])_[^_\s][^_\n]*_(?![\w_])")
WIKI = [
    re.compile(r"(?<!\[)\[\[[^\[\]\n{}\"'=]*[^\W\d_][^\[\]\n{}\"'=]*\]\](?!\])"),
    re.compile(r"(?<!')'''(?!')[^'\n]+'''(?!')"),
    re.compile(r"^(={2,6})[^=\n]+={2,6}[ \t]*$", re.M),
    re.compile(r"^\{\|[^\n]*\n(?:.*\n)*?\|\}", re.M),
    re.compile(r"\{\{[A-ZÀ-Þ一-鿿][^{}]*[|}\n]"),
    re.compile(r"(?<!')''(?!')[^'\n]+''(?!')"),
]
TEX = re.compile(
    r"\\(?:documentclass|usepackage|begin|end|(?:sub)*section|chapter|paragraph|emph|text(?:bf|it|tt|sc)|title|author|item|cite|ref|label|footnote|caption|includegraphics|frac|sqrt|sum|int|left|right|leq|geq|alpha|beta|gamma|cdot|times|href|url)\b\*?"
    r"|\\[a-zA-Z]{3,}\*?(?:\[[^\]\n]*\])?\{[^}\n]*\}|\\\((?=.+?\\\))|\\\[(?=[\s\S]+?\\\])"
)
MATH = re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*(?:\\[a-zA-Z]+|[\^_]\{?\w)[^$\n]*\$(?!\w)")
PATHLIKE = re.compile(r"(?:[A-Za-z]:|\\\\\?)\\[^\s]*|\b[\w.]+(?:\\[\w.]+)+")


def prose(text: str) -> str:
    """The text without code: fenced blocks and the insides of code elements and verbatim environments, keeping their markers."""
    if "```" in text or "~~~" in text:
        text = FENCED.sub(lambda m: m[1] + "\n" + m[1], text)
    if "</" in text or "<pre" in text or "<code" in text:
        text = PRE.sub(r"\1\3", text)
    if "\\begin{" in text:
        text = VERBATIM.sub(r"\1\3", text)
    return text


def without_source(text: str) -> str:
    """The text without lines of program source and the comments among them, where a text is mostly source by its paragraphs."""
    lines = [x for x in text.split("\n") if x.strip()]
    code = sum(1 for x in lines if SOURCE.match(x))
    if not code:
        return text
    out = []
    for para in re.split(r"\n[ \t]*\n", text):
        own = [x for x in para.split("\n") if x.strip()]
        source = [bool(SOURCE.match(x)) for x in own]
        if any(source) and sum(s or bool(COMMENT.match(x)) for s, x in zip(source, own)) >= 0.5 * len(own):
            continue  # a paragraph of source
        if 2 * code >= len(lines) and all(COMMENT.match(x) for x in own):
            continue  # comments on their own in a file of source
        out.append(para)
    return "\n\n".join(out)


def languages(text: str) -> list[str]:
    """The markup languages that a text is written in, in alphabetical order."""
    if not any(c in text for c in "<&[*`#|'=\\$_"):
        return []
    bare = without_source(prose(text))
    plain = INLINE.sub(" ", bare) if "`" in bare else bare
    found = set()
    wiki = [bool(p.search(plain)) for p in WIKI] if "[[" in plain or "''" in plain or "==" in plain or "{|" in plain or "{{" in plain else [False] * 6
    if sum(wiki) >= 2 or any((wiki[0], wiki[3], wiki[4], wiki[1])):
        found.add("wiki")
    if "<" in plain and TAG.search(plain) or "&" in plain and ENTITY.search(plain):
        tags = {m[0].strip("</> ").split()[0].lower() for m in TAG.finditer(plain)} if "<" in plain else set()
        # a wiki page has line breaks and the like of its own
        if "wiki" not in found or not tags <= {"br", "br/", "ref", "small", "sub", "sup", "u", "s", "code", "pre"} or (not tags and ENTITY.search(plain)):
            found.add("html")
    if "\\" in plain and TEX.search(PATHLIKE.sub(" ", plain) if re.search(r"\w\\|\\\\", plain) and not re.search(r"\\(?:begin|section|documentclass)", plain) else plain) or "$" in plain and MATH.search(plain):
        found.add("latex")
    if MD_STRONG.search(bare if "```" in bare or "~~~" in bare else plain):
        found.add("markdown")
    elif "wiki" not in found and ("#" in plain and MD_HEADING.search(plain) or ("==" in plain or "---" in plain) and MD_SETEXT.search(plain)):
        found.add("markdown")
    elif not found & {"wiki", "latex", "html"} and "`" in bare and MD_SPAN.search(bare) and len(MD_SPAN.findall(bare)) >= 2:
        found.add("markdown")
    return sorted(found)


class _Html(HTMLParser):
    """Text of HTML with the structure that plain text can keep."""

    BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "nav", "blockquote", "dl", "dd", "dt", "form", "fieldset", "figure", "address", "details", "summary", "body", "html", "head", "center"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.cells = 0

    def block(self, lines: int = 2) -> None:
        tail = "".join(self.out[-3:])
        have = len(tail) - len(tail.rstrip("\n"))
        if self.out and have < lines:
            self.out.append("\n" * (lines - have))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "title":
            self.block()
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.block()
        elif tag == "pre":
            self.block()
            self.out.append("```\n")
            self.pre += 1
        elif tag in ("ul", "ol"):
            self.block(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.block(1)
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            self.out.append("  " * (len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- "))
        elif tag == "table":
            self.block()
        elif tag == "tr":
            self.block(1)
            self.cells = 0
        elif tag in ("td", "th"):
            if self.cells:
                self.out.append(" | ")
            self.cells += 1
        elif tag in self.BLOCK:
            self.block(1 if self.lists or self.cells else 2)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.block(1)
            self.out.append("```")
            self.block()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.block(1 if self.lists else 2)
        elif tag == "tr":
            self.cells = 0
            self.block(1)
        elif tag in self.BLOCK or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "table", "title"):
            self.block(1 if self.lists or self.cells else 2)

    def handle_data(self, data):
        if self.skip or data.isspace() and not self.pre and self.out and self.out[-1].endswith("\n"):
            return
        self.out.append(data)


def html_text(text: str) -> str:
    parser = _Html()
    # what only looks like a tag is text
    parser.feed(re.sub(rf"<(?!/?(?:{'|'.join(ELEMENTS)})\b|!)", "&lt;", text, flags=re.I))
    parser.close()
    return "".join(parser.out).replace("\xa0", " ")


def _outside_code(text: str, change) -> str:
    """Applies a change to what lies between fenced code blocks."""
    out, at = [], 0
    for m in FENCED.finditer(text):
        out += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(text[at:])])


def markdown_text(text: str) -> str:
    """Headings as ``# x``, lists, tables as ``a | b`` rows, fenced code and formulas stay; emphasis, links and quotes lose their signs."""

    def change(t: str) -> str:
        t = re.sub(r"^([^\n]*\S[^\n]*)\n=+[ \t]*$", r"# \1", t, flags=re.M)
        t = re.sub(r"(?:(?<=\n\n)|\A)([^\n|]*[^\s|][^\n|]*)\n-{3,}[ \t]*$", r"## \1", t, flags=re.M)
        t = re.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*\n?", "", t, flags=re.M)
        t = re.sub(r"^[ \t]*\|(.*?)\|?[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), t, flags=re.M)
        t = re.sub(r"^> ?", "", t, flags=re.M)
        t = re.sub(r"^(\s*)[*+] ", r"\1- ", t, flags=re.M)
        t = re.sub(r"!?\[([^\]\n]+)\](?:\([^)\n]*\)|\[\w+\])", r"\1", t)
        t = re.sub(r"\*\*(\S(?:[^\n]*?\S)?)\*\*|(?<!\w)__(\S(?:[^\n]*?\S)?)__(?!\w)", lambda m: m[1] or m[2], t)
        t = re.sub(r"(?<![\w*])\*([^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])|(?<![\w_])_([^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])", lambda m: m[1] or m[2], t)
        return re.sub(r"`([^`\n]+)`", r"\1", t)

    return _outside_code(text, change)


def wiki_text(text: str) -> str:
    """Headings as ``# x``, lists, tables and parameters of templates as lines; links keep their labels, categories go."""
    text = re.sub(r"<(syntaxhighlight|source|pre)\b[^<>]*>\n?(.*?)\n?</\1>", r"\n```\n\2\n```\n", text, flags=re.S)

    def change(t: str) -> str:
        t = re.sub(r"^(={2,6})\s*([^=\n]+?)\s*={2,6}[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t, flags=re.M)
        t = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|分类|File|Image|Datei)\s*:[^\[\]\n]*\]\]", "", t)
        t = re.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]*)\]\]", r"\1", t)
        t = re.sub(r"\[(?:https?|ftp)://\S+ ([^\]\n]+)\]", r"\1", t)
        t = re.sub(r"'{2,5}", "", t)

        def grid(m: re.Match) -> str:
            rows, row = [], []
            for line in m[0].split("\n")[1:-1]:
                if line.startswith("|-"):
                    rows, row = [*rows, row] if row else rows, []
                elif line[:1] in "|!" and line:
                    row += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
            return "\n".join(" | ".join(r) for r in ([*rows, row] if row else rows))

        t = re.sub(r"^\{\|[^\n]*\n(?:.*\n)*?\|\}", grid, t, flags=re.M)
        t = re.sub(r"\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}", lambda m: m[1].strip() + "".join("\n" + p.strip() for p in m[2].split("|") if p.strip()), t)
        t = re.sub(r"^([*#]+)[ \t]*", lambda m: "  " * (len(m[1]) - 1) + ("- " if m[1][-1] == "*" else "1. ") if not re.match(r"#{2,}", m[1]) else m[0], t, flags=re.M)
        return t

    return _outside_code(text, change)


def latex_text(text: str) -> str:
    """Sections as ``# x``, items as ``- x``, tables as ``a | b`` rows, verbatim as fenced code; formulas stay in their notation."""
    text = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\{[^}]*\}|\[[^\]]*\])*\n?(.*?)\n?\\end\{\1\}", r"\n```\n\2\n```\n", text, flags=re.S)

    def change(t: str) -> str:
        kept: list[str] = []

        def keep(m: re.Match) -> str:
            kept.append(m[0])
            return f"\x00{len(kept) - 1}\x00"

        t = re.sub(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|gather|math)\*?\}.*?\\end\{\1\*?\}", keep, t, flags=re.S)
        t = MATH.sub(keep, t)
        t = re.sub(r"\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}", lambda m: "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in m[1].replace("\\hline", "").split("\\\\") if r.strip()), t, flags=re.S)
        t = re.sub(r"\\(chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * (1 + m[1].count('sub') + (m[1] == 'paragraph') * 3)} {m[2]}\n", t)
        t = re.sub(r"\\item(?:\[([^\]]*)\])?\s*", lambda m: "- " + (m[1] + ": " if m[1] else ""), t)
        t = re.sub(r"\\(?:documentclass|usepackage|begin|end|label|pagestyle|bibliographystyle)\*?(?:\[[^\]]*\])?\{[^{}]*\}(?:\{[^{}]*\})?", "", t)
        t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
        for _ in range(3):
            t = re.sub(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
        t = re.sub(r"\\([%&#_{}$])", r"\1", t)
        return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)

    return _outside_code(text, change)


CONVERTERS = (("latex", latex_text), ("wiki", wiki_text), ("markdown", markdown_text), ("html", html_text))


def to_plain(text: str, found: list[str]) -> str:
    """The text without the markup of the named languages; code blocks are fenced and formulas keep their notation."""
    for name, convert in CONVERTERS:
        if name in found:
            text = convert(text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


def converted(files: DataFrame, key: str = "file_id", plain: bool = True) -> DataFrame:
    """(key, markup, content): the languages of each row and, with ``plain``, its plain text. Null and empty contents have none and stay. No shuffle."""
    kind = files.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("markup", T.ArrayType(T.StringType())), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for t in batch.column(1).to_pylist():
                names = languages(t) if t else []
                found.append(names)
                texts.append(to_plain(t, names) if names and plain else t if plain else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[key, "markup", "content"])

    return files.select(key, "content").mapInArrow(run, schema)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, markup) of every language a content is written in."""
    found = converted(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content")), plain=False)
    return found.select("file_id", F.explode("markup").alias("markup")).distinct()


def p6_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): the plain text of the files that hold markup."""
    return converted(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content"))).where(F.size("markup") > 0).select("file_id", "content").distinct()
