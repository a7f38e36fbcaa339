import pytest
from hypothesis import given
from hypothesis import strategies as st

from loam.plans.qlang import Field, Path, QueryError, Range, Word, civil_ms, lex, parse


def must(text):
    return parse(text).groups[0].must


def test_lowercase_operators_are_words():
    assert [w.text for w in must("cats or dogs")] == ["cats", "or", "dogs"]
    assert not parse("shall not pass").has_operators


def test_groups_bind_weaker_than_and():
    q = parse("a b OR c")
    assert [[w.text for w in g.must] for g in q.groups] == [["a", "b"], ["c"]]


@pytest.mark.parametrize("text", ["", "OR", "OR OR", "a NOT", "path:", 'path:""', "mtime:2026-01-01", "mtime:>abc", "mtime:>2026-13-01", "mtime:>2026-02-30", "mtime:>2026", "size:>10tb", "size:10mb", "size:>"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_dates():
    assert must("mtime:>2026-1-5") == [Range("mtime", civil_ms(2026, 1, 6))]
    assert must("mtime:<=2024-02") == [Range("mtime", None, civil_ms(2024, 3, 1))]


def test_sizes():
    assert must("size:>=1.5mb") == [Range("size", 1572864)]
    assert must("size:<99999999999gb") == [Range("size", None, 2**63 - 1)]


def test_words_that_look_like_fields():
    assert must("12:30 http://x") == [Word("12:30"), Word("http://x")]
    assert must('PATH:x path:"my docs" ext:md') == [Path("x"), Path("my docs", True), Field("ext", "md")]


def test_exclusion_keeps_the_condition():
    g = parse("a -path:x NOT size:>1kb").groups[0]
    assert g.must_not == [Path("x"), Range("size", 1025)]
    assert must("a -") == [Word("a"), Word("-")]


def test_open_quote_takes_the_rest():
    assert lex('a "b c') == ["a", '"b c']


@given(st.lists(st.text("abcxyz019", min_size=1), min_size=1))
def test_plain_words_come_back(words):
    assert [w.text for w in must(" ".join(words))] == words
