"""Path expressions: prefixes, names, extensions, kinds, subtree and exclusion predicates. All are JVM-side columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extension groups of the filter, the classes of the display and the extensions whose files are read as text.
DOC_EXTS = ("md", "txt", "pdf", "docx", "xlsx", "pptx", "html")
CODE_EXTS = (
    "rs", "py", "go", "js", "ts", "jsx", "tsx", "java", "c", "h", "cpp", "hpp", "cs", "rb", "php",
    "lua", "vue", "json", "yaml", "yml", "toml", "sh", "ps1", "bat", "sql",
)
IMAGE_EXTS = ("png", "jpg", "jpeg", "webp", "bmp")
KIND_CODE_EXTS = (
    "rs", "py", "go", "js", "ts", "jsx", "tsx", "c", "h", "cpp", "hpp", "cs", "rb", "php", "lua", "vue", "java",
    "json", "toml", "yaml", "yml", "sh", "ps1", "bat", "sql", "html", "htm", "xml", "css",
)
KIND_DOC_EXTS = ("md", "markdown", "txt", "log", "csv", "tsv", "ini", "cfg", "conf")
TEXT_EXTS = (
    "txt", "md", "markdown", "log", "csv", "tsv", "json", "toml", "yaml", "yml", "ini", "cfg", "conf", "xml", "html", "htm",
    "sql", "sh", "ps1", "bat", "rs", "py", "go", "java", "js", "ts", "jsx", "tsx", "c", "h", "cpp", "hpp", "cs", "rb", "php", "lua", "vue",
)
OFFICE_EXTS = ("docx", "xlsx", "pptx")


def strip_verbatim(path: Column) -> Column:
    """The path without a leading ``\\\\?\\``; nulls stay null."""
    return F.when(path.startswith("\\\\?\\"), F.substring(path, 5, 1 << 30)).otherwise(path)


def display_path(path: Column) -> Column:
    """``\\\\?\\UNC\\x`` becomes ``\\\\x``, ``\\\\?\\x`` becomes ``x``; others stay."""
    return F.when(path.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substring(path, 9, 1 << 30))).otherwise(strip_verbatim(path))


def file_name(path: Column) -> Column:
    """What follows the last separator (either kind)."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def ext_group(name: str) -> tuple[str, ...] | None:
    """The extensions of a group; None, which is no filter, for an unknown name."""
    return {"doc": DOC_EXTS, "code": CODE_EXTS, "image": IMAGE_EXTS}.get(name)


def kind_of(ext: Column) -> Column:
    """Coarse class for display: pdf, image, code, doc or file."""
    e = F.lower(ext)
    return (
        F.when(e == "pdf", "pdf").when(e.isin(*IMAGE_EXTS), "image").when(e.isin(*KIND_CODE_EXTS), "code").when(e.isin(*KIND_DOC_EXTS), "doc").otherwise("file")
    )


def under(path: Column, root: str) -> Column:
    """Component-wise prefix test: the root itself or anything below it. Both parts are pushed to the scan."""
    sep = "\\" if ("\\" in root and "/" not in root) or re.fullmatch("[A-Za-z]:", root) else "/"
    root = root.rstrip("/\\") or sep
    return (path == root) | path.startswith(root if root.endswith(sep) else root + sep)


def excluded(relative: Column, names: Iterable[str]) -> Column:
    """Whether a directory on the way (never the last part) is hidden or listed; case-sensitive."""
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    dirs = F.slice(F.split(relative, r"[/\\]"), 1, F.greatest(F.size(F.split(relative, r"[/\\]")) - 1, F.lit(0)))
    return F.exists(dirs, lambda c: c.startswith(".") | F.array_contains(listed, c))


def middle_ellipsis(text: Column, most: int = 64) -> Column:
    """Keeps 60 % of ``most - 1`` characters at the head and the rest at the tail around an ellipsis."""
    head = -(-(most - 1) * 6 // 10)
    tail = most - 1 - head
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -tail, tail) if tail else F.lit("")))
