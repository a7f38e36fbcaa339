import random

from loam.llm import leak
from loam.llm.queries import REGISTRY

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def frame(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id long")


def test_passages_and_offsets(spark):
    words = ITEM.split()
    shown = "«One, TWO – three\u00a0four; five-six: seven/eight\nnine\tten (eleven) twelve»"
    docs = [(1, f"Intro. {shown} end", ""), (2, " ".join(words[:11]), ""), (3, " ".join(words[2:]), ""), (4, None, ""), (5, "", ""), (6, " ".join(words[:6] + ["x"] + words[6:]), ""), (7, ITEM + " . " + ITEM, "")]
    d, i = frame(spark, docs, [(10, ITEM, 1), (10, ITEM, 1), (11, None, 1), (12, "too short", 1), (13, " ".join(words[1:13]), 1)])
    got = leak.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (3, 10), (7, 10), (7, 13)}
    r = next(r for r in got if r.doc_id == 1)
    assert docs[0][1][r.start : r.start + r.length] == shown[1:-1]
    assert sum(r.doc_id == 7 and r.item_id == 10 for r in got) == 2


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 40))), 0) for k in range(30)]
    docs = []
    for k in range(60):
        cut = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(cut) - 8))
        docs.append((k, " ".join(rng.choices(vocabulary, k=10) + cut[a : a + rng.randrange(8, 20)] + rng.choices(vocabulary, k=5)), ""))
    d, i = frame(spark, docs, items)
    windows = lambda t: {tuple(t.split()[j : j + 12]) for j in range(len(t.split()) - 11)}
    want = {(a, b) for a, t, _ in docs for b, u, _ in items if windows(t) & windows(u)}
    assert want and {tuple(r) for r in leak.leaks(d, i).select("doc_id", "item_id").collect()} == want
    monkeypatch.setattr(leak, "BLOCK_WORDS", 40)
    assert {tuple(r) for r in leak.leaks(d, i).select("doc_id", "item_id").collect()} == want


def test_empty(spark):
    d, i = frame(spark, [], [])
    assert leak.leaks(d, i).count() == 0
    assert leak.leaks(frame(spark, [(1, ITEM, "")], [])[0], i).count() == 0


def test_words():
    assert leak.words("İstanbul_x Ünï—2b") == ["i̇stanbul", "x", "ünï", "2b"] and leak.words("") == [] and leak.words("…") == []


def test_sql(spark, oracle):
    oracle(spark, *REGISTRY["p9_found"])
