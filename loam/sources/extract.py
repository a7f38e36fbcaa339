"""Text of files: plain text in any encoding, office documents, and optional recognisers for PDF and images."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths
from loam.operators.changes import allowed, cached_content
from loam.sources.store import FILES, RULES

#: Images beyond this size are not recognised.
IMAGE_BYTES = 20 << 20
Recogniser = Callable[[bytes], str | None]


def _lead(raw: bytes) -> list[int]:
    """The lead bytes of two-byte characters in text of a double-byte encoding."""
    out, i = [], 0
    while i < len(raw):
        if raw[i] < 0x80:
            i += 1
        else:
            out.append(raw[i])
            i += 2
    return out


def _share(leads: list[int], spans: dict[tuple[int, int], float]) -> float:
    """The mean weight of lead bytes by the rows of a code table that they name."""
    return sum(next((w for (a, z), w in spans.items() if a <= b <= z), -1.0) for b in leads) / len(leads) if leads else -1.0


# The rows of each code table with its everyday characters, its rarer ones and its signs, and how much text of them speaks for it.
DOUBLE_BYTE = {
    "gb18030": {(0xB0, 0xD7): 1.0, (0xA1, 0xA3): 0.6, (0xD8, 0xF7): 0.1, (0x81, 0xA0): -0.5},
    "big5": {(0xA4, 0xC6): 1.0, (0xA1, 0xA3): 0.6, (0xC9, 0xF9): 0.0},
    "shift_jis": {(0x82, 0x83): 1.0, (0x81, 0x81): 0.6, (0x88, 0x97): 0.7, (0x98, 0x9F): -0.3, (0xE0, 0xEA): -0.3},
    "euc_jp": {(0xA4, 0xA5): 1.1, (0xA1, 0xA3): 0.6, (0xB0, 0xCF): 0.7, (0xD0, 0xF4): -0.3},
    "euc_kr": {(0xB0, 0xC8): 1.0, (0xA1, 0xA3): 0.5, (0xCA, 0xFD): -0.3},
}
#: Characters from which text of Korean syllables only is taken for Korean; shorter text might be Chinese as well.
KOREAN_LEAST = 8
# Single-byte encodings and the letters that are usual in text of them.
SINGLE_BYTE = {
    "cp1251": "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "koi8_r": "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "cp1252": "äöüßéèêëàâçîïôùûáíóúñãõ",
    "cp1250": "áčďéěíňóřšťúůýžąćęłńśźżäöüőű",
    "cp1253": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ",
}


def _single(text: str, letters: str) -> float:
    """How well a text's characters beyond ASCII stand as letters of a language: usual small ones count, others speak against it."""
    known, score, n = set(letters), 0.0, 0
    latin = letters[0] < "\u0250"
    for before, c in zip(" " + text, text):
        if c > "\x7f":
            n += 1
            if not latin and before.isalpha() and before.isascii():  # two scripts in one word
                score -= 1.0
                continue
            inside = before.isalpha() and before.islower()
            score += 1.0 if c in known else 0.7 if c.lower() in known and not inside else 0.2 if c in "«»“”„‘’–—…°§№\xa0" and not before.isalpha() else -1.0
    return score / n if n else -1.0


def guess(raw: bytes) -> str | None:
    """The text in the encoding that speaks most for itself, by where its characters lie in each code table; None if none does."""
    best, out = 0.45, None
    for encoding, spans in DOUBLE_BYTE.items():
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        leads = _lead(raw)
        score = _share(leads, spans)
        if encoding == "euc_kr" and len(leads) < KOREAN_LEAST:
            score -= 0.2
        if encoding == "gb18030" and any("\u3040" <= c <= "\u30ff" for c in text):
            score -= 0.5
        if score > best or (encoding == "euc_kr" and score >= best and score > 0.9):
            best, out = score, text
    if out is None or best < 0.7:
        for encoding, letters in SINGLE_BYTE.items():
            try:
                text = raw.decode(encoding)
            except UnicodeDecodeError:
                continue
            if (score := _single(text, letters)) > best:
                best, out = score, text
    return out


def decode_text(raw: bytes) -> str | None:
    """Text of unknown encoding: by its byte order mark, as strict UTF-8, as the encoding that fits best, else as lossy UTF-8. None for no bytes."""
    if not raw:
        return None
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(encoding, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return guess(raw) or raw.decode("utf-8", "replace")


def tagged_text(xml: bytes, text_tag: str, paragraph_tag: str | None = None, joint: str = "") -> str:
    """What stands in elements of one local name; a line break after each paragraph, ``joint`` after each text. Text before a first XML error is kept."""
    out: list[str] = []
    depth = 0
    parser = expat.ParserCreate()
    local = lambda name: name.rpartition(":")[2]

    def start(name, _):
        nonlocal depth
        depth += local(name) == text_tag

    def end(name):
        nonlocal depth
        if local(name) == text_tag:
            depth -= 1
            out.append(joint)
        elif paragraph_tag and local(name) == paragraph_tag:
            out.append("\n")

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: out.append(data) if depth else None
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return "".join(out)


def natural(name: str) -> list:
    """Sort key in which slide2 comes before slide10."""
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def office_text(raw: bytes, ext: str) -> str | None:
    """Text of docx, xlsx or pptx; None if it is no such file or has only white space. An unreadable sheet or slide is skipped."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = z.namelist()

            def read(name: str) -> bytes:
                try:
                    return z.read(name)
                except (KeyError, zipfile.BadZipFile, OSError):
                    return b""

            if ext == "docx":
                text = tagged_text(z.read("word/document.xml"), "t", "p")
            elif ext == "xlsx":
                sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet[^/]*\.xml", n)), key=natural)
                text = "".join(tagged_text(read(n), "t", joint="\n") for n in ["xl/sharedStrings.xml", *sheets] if n in names)
            else:
                slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n)), key=natural)
                text = "".join(tagged_text(read(n), "t", "p") + "\n" for n in slides)
    except (zipfile.BadZipFile, KeyError, OSError, EOFError):
        return None
    return text.strip() or None


def pdf_text(raw: bytes) -> str | None:
    """The text layer of a PDF if a reader is installed, else None."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages).strip() or None


def extract(raw: bytes, ext: str, extra: tuple[str, ...] = ()) -> str | None:
    """The text of a file by its extension; a file that a parser fails on has none."""
    ext = ext.lower()
    try:
        if ext == "pdf":
            return pdf_text(raw)
        if ext in paths.OFFICE_EXTS:
            return office_text(raw, ext)
        return decode_text(raw) if ext in paths.TEXT_EXTS or ext in extra else None
    except Exception:  # a broken file must not end the scan
        return None


def extractable(ext: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.lower(ext).isin("pdf", *paths.TEXT_EXTS, *paths.OFFICE_EXTS, *extra)


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(*paths.IMAGE_EXTS)


LISTED = "path string, relative string, name string, ext string, mtime long, size long"
#: Directories that the driver finds before the rest of the tree is listed by tasks.
FRONTIER = 64
#: Bytes of text that a task holds before it passes them on.
HELD = 32 << 20


def opened(where: str):
    """(file system, path) of a folder or file: local ones are named by their path, others by their address."""
    if "://" in where and not where.startswith("file:"):
        return pafs.FileSystem.from_uri(where)
    return pafs.LocalFileSystem(), re.sub(r"^file:(?://)?(?=/)", "", where)


def _entries(where: str, skipped: frozenset[str]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(directories to go on with, files as (path, mtime in ms, size)) of one directory; one that can't be read has none."""
    fs, at = opened(where)
    head = where[: -len(at)] if where.endswith(at) and not where.startswith("file:") else ""
    try:
        found = fs.get_file_info(pafs.FileSelector(at, recursive=False))
    except OSError:
        return [], []
    dirs = [head + i.path for i in found if i.type == pafs.FileType.Directory and not i.base_name.startswith(".") and i.base_name not in skipped]
    return dirs, [(head + i.path, (i.mtime_ns or 0) // 1_000_000, i.size) for i in found if i.type == pafs.FileType.File]


def scan(spark: SparkSession, root: str, rules: dict = RULES) -> DataFrame:
    """(path, relative, name, ext, mtime, size) of all files below a directory, whatever their names, that the rules let in.

    Excluded and hidden directories aren't entered; the root itself is exempt, and so are the directories above it. The driver lists until it
    has FRONTIER directories, tasks list what is below those. A directory that can't be read is left out.
    """
    base = re.sub(r"^file:(?://)?(?=/)", "", root).rstrip("/")
    skipped = frozenset(rules.get("exclude_dirs", ()))
    dirs, files = [base], []
    while dirs and len(dirs) < FRONTIER:
        d = dirs.pop(0)
        more, here = _entries(d, skipped)
        dirs += more
        files += here
        if not more and not dirs:
            break

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["dir"]:
                left = [first]
                while left:
                    more, here = _entries(left.pop(), skipped)
                    left += more
                    if here:
                        yield pd.DataFrame(here, columns=["path", "mtime", "size"])

    found = spark.createDataFrame(files, "path string, mtime long, size long")
    if dirs:
        tops = spark.createDataFrame([(d,) for d in dirs], "dir string").repartition(max(1, len(dirs) // 2))
        found = found.unionByName(tops.mapInPandas(run, "path string, mtime long, size long"))
    relative = F.substring("path", len(base) + 2, 1 << 30)
    named = found.withColumn("relative", relative).withColumn("name", paths.file_name(F.col("path"))).withColumn("ext", paths.extension(F.col("path")))
    return allowed(named, rules).select(*[c.split()[0] for c in LISTED.split(", ")])


def documents(scanned: DataFrame, rules: dict = RULES, recognise: Recogniser | None = None, processed: DataFrame | None = None) -> DataFrame:
    """Index rows of scanned files: text files with their text, images with recognised text or '' as a placeholder.

    Files that are too large, empty, broken or of another kind give no row. ``processed`` (path, mtime, size, content) is text that was
    recognised before: an image with the same stats takes it and isn't recognised again. Tasks open the files themselves, dealt out evenly, and
    hold a bounded amount of text at a time.
    """
    extra = tuple(rules.get("extra_text_exts", ()))
    limit = int(rules.get("max_file_mb", 20)) << 20
    wanted = scanned.where((extractable(F.col("ext"), extra) & (F.col("size") > 0) & (F.col("size") <= limit)) | (is_image(F.col("ext")) & (F.col("size") <= IMAGE_BYTES)))
    if processed is not None:
        wanted = cached_content(wanted, processed)
    else:
        wanted = wanted.withColumn("cached", F.lit(None).cast("string"))
    names = [c.split()[0] for c in FILES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = r.ext in paths.IMAGE_EXTS
                if image and r.cached is not None:
                    text = r.cached
                else:
                    try:
                        fs, at = opened(r.path)
                        with fs.open_input_stream(at) as source:
                            raw = source.read()
                        text = ((recognise(raw) if recognise else None) or "") if image else extract(raw, r.ext, extra)
                    except Exception:  # gone since, or recognised as empty and not tried again
                        text = "" if image else None
                if text is not None:
                    rows.append((r.path, r.name, r.ext, text, r.mtime, r.size, "image" if image else "text"))
                    held += len(text)
                if held > HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    # a given number of partitions, which stays: these rows are small, but what is read for them isn't
    cores = 4 * scanned.sparkSession.sparkContext.defaultParallelism
    return wanted.select("path", "name", "ext", "mtime", "size", "cached").repartition(cores).mapInPandas(run, FILES)
