import random

import pytest
from pyspark.sql import functions as F

from loam.plans import search as S
from loam.plans import segment as G
from loam.plans.searcher import Searcher
from loam.sources.store import Store

SCHEMA = "path string, name string, ext string, content string, mtime long, size long, kind string"
QUERIES = [
    "red", "red blue", "red OR green", "red -blue", "-red", '"red blue"', '"blue red blue"', "path:a", 'path:"a d1"', "name:f1", "ext:md", "kind:image", "size:>2", "mtime:>=1970-01-02 red",
    "-path:a", "NOT size:>2", 'red "green red" -path:b OR name:f3 blue', "会议", '"会 议"', "missing", "missing OR red", "content:red", "a-b", "red red",
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["red", "blue", "green", "会议", "a", "b", ""]
    rows = [(f"/{rng.choice('ab')}/d{k % 3}/f{k}.md", f"f{k % 7}.md", rng.choice(["md", "txt", "png"]), " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.randrange(3) * 86_400_000, k % 5, rng.choice(["text", "image"])) for k in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).persist()
    return frame, Searcher(spark, [G.build(frame, f"file://{tmp_path_factory.mktemp('seg')}/s")])


@pytest.mark.parametrize("text", QUERIES)
def test_index_equals_scan(corpus, text):
    frame, index = corpus
    want = {(r.path, r.score) for r in S.ranked(frame, text).select("path", "score").collect()}
    assert {(r.path, r.score) for r in index.hits(text, ranked=True).collect()} == want
    rows, total = index.top(text, 4, 1)
    order = sorted(want, key=lambda x: (-x[1], x[0].encode()))
    assert total == len(want) and [(r["path"], r["score"]) for r in rows] == order[1:5]


def test_orders_and_filters(corpus):
    frame, index = corpus
    for sort in ("mtime", "mtime_asc", "size"):
        want = [r.path for r in S.where(frame, "red OR blue", ("md",)).orderBy(*S.ordering(sort)).limit(6).collect()]
        assert [r["path"] for r in index.top("red OR blue", 6, exts=("md",), sort=sort)[0]] == want
    with pytest.raises(S.QueryError):
        index.top("red", 3, sort="bogus")
    assert index.top("red", 0)[0] == [] and index.top("red", 0)[1] == S.where(frame, "red").count()


def test_parts_of_few_files_and_long_texts(spark, tmp_path, monkeypatch):
    rows = [(f"/p{k:02d}", f"p{k:02d}", "md", ("word " * 3000 + f"k{k}") if k % 4 == 0 else f"word k{k}", 0, k, "text") for k in range(12)]
    monkeypatch.setattr(G, "PART_BYTES", 40_000)
    index = Searcher(spark, [G.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/s")])
    assert index.top("word", 3)[1] == 12 and index.top('"word k8"', 3)[0][0]["path"] == "/p08" and index.readers[0].parts().count() >= 1


def test_ranking_after_deletions_is_that_of_a_new_index(spark, corpus, tmp_path):
    frame, _ = corpus
    store = Store(spark, f"file://{tmp_path}/i")
    store.replace(frame)
    store.apply(spark.createDataFrame([("/a/d1", "remove_tree")], "path string, op string"), spark.createDataFrame([("/new", "new", "md", "red blue new", 0, 1, "text")], SCHEMA))
    now = store.files().persist()
    for text in ("red", '"red blue"', "red OR new", "-blue"):
        want = {(r.path, r.score) for r in S.ranked(now, text).select("path", "score").collect()}
        assert {(r.path, r.score) for r in store.searcher().hits(text, ranked=True).collect()} == want
    assert now.where(F.col("path").startswith("/a/d1/")).count() == 0


def test_empty_index(spark, tmp_path):
    index = Searcher(spark, [G.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/s")])
    assert index.num_docs() == 0 and index.top("red", 3) == ([], 0) and index.hits("red OR -blue").count() == 0
