"""The query language: words joined by AND, OR between groups, NOT or -, "phrases", path:, mtime:, size: and other fields. Pure Python.

Unlike a purely textual exclusion, ``-path:x`` and ``NOT size:>1mb`` exclude by the structured condition itself.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass, field

MAX_SIZE = 2**63 - 1
#: Fields that are compared with a plain value.
PLAIN_FIELDS = ("ext", "kind", "name", "content", "path_text")
# Size units.
UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


class QueryError(ValueError):
    """A query that can't be understood."""


@dataclass(frozen=True)
class Word:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Path:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Range:
    """low <= column < high; either bound may be missing."""

    column: str
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Field:
    name: str
    text: str
    quoted: bool = False


Clause = Word | Path | Range | Field


@dataclass
class Group:
    must: list[Clause] = field(default_factory=list)
    must_not: list[Clause] = field(default_factory=list)


@dataclass
class Query:
    groups: list[Group]
    has_operators: bool

    def words(self) -> list[Word]:
        """The words that a hit is ranked and highlighted by."""
        return [c for g in self.groups for c in g.must if isinstance(c, Word)]


def lex(text: str) -> list[str]:
    """Splits at white space outside quotes; quotes stay, and one that is never closed takes all the rest."""
    out, token, quoted = [], "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        if c.isspace() and not quoted:
            if token:
                out.append(token)
            token = ""
        else:
            token += c
    return [*out, token] if token else out


def unquote(text: str) -> tuple[str, bool]:
    if text.startswith('"'):
        return text[1:-1] if len(text) > 1 and text.endswith('"') else text[1:], True
    return text, False


def comparison(field_name: str, text: str) -> tuple[str, str]:
    for op in (">=", "<=", ">", "<"):
        if text.startswith(op):
            return op, text[len(op) :]
    raise QueryError(f"{field_name}: needs one of > >= < <=")


def civil_ms(year: int, month: int, day: int) -> int:
    return calendar.timegm((year, month, day, 0, 0, 0)) * 1000


def date_span(text: str) -> tuple[int, int]:
    """The first millisecond of a day or month in UTC, and the first after it."""
    parts = text.split("-")
    if not 2 <= len(parts) <= 3 or not all(re.fullmatch(r"\d{1,4}", p) for p in parts):
        raise QueryError(f"not a date: {text!r}")
    nums = [int(p) for p in parts]
    try:
        start = dt.date(nums[0], nums[1], nums[2] if len(nums) > 2 else 1)
    except ValueError as e:
        raise QueryError(f"not a date: {text!r}") from e
    days = 1 if len(nums) == 3 else calendar.monthrange(nums[0], nums[1])[1]
    first = civil_ms(start.year, start.month, start.day)
    return first, first + days * 86_400_000


def mtime_range(text: str) -> Range:
    op, value = comparison("mtime", text)
    first, after = date_span(value)
    return {">": Range("mtime", after), ">=": Range("mtime", first), "<": Range("mtime", None, first), "<=": Range("mtime", None, after)}[op]


def size_range(text: str) -> Range:
    op, value = comparison("size", text)
    m = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)([A-Za-z]*)", value)
    if not m or m[2].lower() not in UNITS:
        raise QueryError(f"not a size: {value!r}")
    n = min(int(float(m[1]) * UNITS[m[2].lower()] + 0.5), MAX_SIZE)
    up = min(n + 1, MAX_SIZE)
    return {">": Range("size", up), ">=": Range("size", n), "<": Range("size", None, n), "<=": Range("size", None, up)}[op]


def clause(token: str) -> tuple[Clause, bool]:
    """A token as a clause, and whether an operator made it."""
    m = re.match(r"([A-Za-z_]+):", token)
    name = m[1].lower() if m else ""
    rest = token[m.end() :] if m else ""
    if name == "path":
        text, quoted = unquote(rest)
        if not text.strip():
            raise QueryError("path: needs something to look for")
        return Path(text, quoted), True
    if name == "mtime":
        return mtime_range(rest), True
    if name == "size":
        return size_range(rest), True
    if name in PLAIN_FIELDS and rest:
        text, quoted = unquote(rest)
        return Field(name, text, quoted), False
    text, quoted = unquote(token)
    return Word(text, quoted), False


def parse(text: str) -> Query:
    """Parses a query; raises QueryError for one without any condition or with a wrong operand."""
    groups, group, operators = [], Group(), False
    tokens = iter(lex(text))
    for token in tokens:
        if token == "OR":
            operators = True
            groups.append(group)
            group = Group()
        elif token == "NOT":
            operators = True
            target = next(tokens, None)
            if target is None:
                raise QueryError("NOT needs something to exclude")
            group.must_not.append(clause(target)[0])
        elif token.startswith("-") and len(token) > 1:
            operators = True
            group.must_not.append(clause(token[1:])[0])
        else:
            made, by_operator = clause(token)
            operators |= by_operator
            group.must.append(made)
    groups = [g for g in [*groups, group] if g.must or g.must_not]
    if not groups:
        raise QueryError("no actual condition")
    return Query(groups, operators)
