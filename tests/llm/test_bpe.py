import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = bpe.vocabulary_text()


@pytest.fixture(scope="module")
def both():
    reference = tokenizers.Tokenizer.from_str(VOCABULARY)
    reference.encode_special_tokens = True
    return bpe.Encoder(VOCABULARY), bpe.Decoder(VOCABULARY), reference


def ids(raw):
    return list(memoryview(raw).cast("i"))


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("aehinorst _'\n\t0中é\x01\x1c½", max_size=60), st.text("abcdefgh ", max_size=80)))
def test_equals_plain_merging(both, text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    encoder, decoder, reference = both
    got = ids(encoder.encode(text))
    assert got == reference.encode(text, add_special_tokens=False).ids
    assert decoder.decode(got) == text


def test_special_strings_and_long_texts(both):
    encoder, decoder, reference = both
    for text in ["<|endoftext|>", "a" * 5000, "=" * 3000, "中" * 3000, " " * 999, "we'll it's I'd __init__ x_y", "\r\n\r\n  x", "abc" * 2000]:
        got = ids(encoder.encode(text))
        assert got == reference.encode(text, add_special_tokens=False).ids and decoder.decode(got) == text


def test_memory_of_pieces_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder, _, reference = both
    encoder.clear()
    text = "one two three four five six"
    assert ids(encoder.encode(text)) == reference.encode(text, add_special_tokens=False).ids and len(encoder) <= 3


def test_table(spark, both):
    rows = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "hello world", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(rows, VOCABULARY).collect()}
    want = both[2].encode("hello world", add_special_tokens=False).ids
    assert got == {1: want, 2: [], 3: [], 4: want}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(rows, VOCABULARY), VOCABULARY).collect()}
    assert back == {1: "hello world", 2: "", 3: "", 4: "hello world"}
    assert bpe.encode(rows.limit(0), VOCABULARY).count() == 0


def test_larger_vocabularies_are_refused():
    import json

    with pytest.raises(ValueError):
        bpe.Encoder(json.dumps({"model": {"vocab": {"a": 0, "b": 70_000}, "merges": []}}))
