import itertools
import random

import numpy as np
import pytest

from loam.llm import neardup as N
from loam.session import Scratch

P = N.Params(words=3, least=0.6)
SCHEMA = "file_id long, content string, indexed_at long, code string"


def brute(texts, p):
    sets = {k: set(N.shingles(t, p.words).tolist()) for k, t in texts.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= p.least * len(sets[a] | sets[b])}


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = {}
    for k in range(n):
        if k % 3 and texts:
            words = texts[rng.choice(sorted(texts))].split()
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if k % 2:
                words = words[40:] + words[:40]
        else:
            words = rng.choices(vocabulary, k=120)
        texts[k + 1] = " ".join(words)
    return texts


def test_shingles():
    assert len(N.shingles("a b", 3)) == 0 and len(N.shingles("A, b; c_d", 3)) == 2
    assert len(N.shingles("会议abc纪要", 3)) == 3
    assert np.array_equal(N.shingles("a b c a b c a", 3), N.shingles("A-b-c a.b.c a", 3))


def test_signature_estimates_similarity():
    c = N.Circulant(N.Params(words=1, bands=100, rows=5))
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (300, 100, 100))
    x, y = c.signature(np.concatenate([shared, a])), c.signature(np.concatenate([shared, b]))
    assert abs((x == y).mean() - 0.6) < 0.08


@pytest.mark.parametrize("bucket", [64, 1, 3])
def test_equals_all_pairs(spark, bucket):
    texts = corpus()
    rows = [(k, t, 1, "x") for k, t in texts.items()]
    codes, members = N.coded(spark.createDataFrame(rows, SCHEMA))
    name = {r.code: r.file_id for r in members.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in N.links(codes, P, Scratch(spark, "t"), bucket).collect()}
    # near the limit itself a pair may be missed; a pair below it may never come
    assert brute(texts, N.Params(words=3, least=0.66)) <= got <= brute(texts, P)


def test_edge_rows(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, 1, ""), (1, base, 2, ""), (2, base, 1, ""), (3, base + " tail", 1, ""), (4, None, 1, ""), (5, "", 1, ""), (6, "a b", 1, ""), (7, "a b", 1, ""), (None, base, 1, ""), (8, "other " * 500_00, 1, ""), (9, base, 1, ""), (9, "now quite different text here", 2, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/indexed_files.parquet")
    assert {tuple(r) for r in N.p2_found(spark, str(tmp_path)).collect()} == {(1, 2), (1, 3), (2, 3)}
    got = {r.file_id: (r.class_id, r.links) for r in N.p2_classes(spark, str(tmp_path)).collect()}
    assert got[2] == (1, 1) and got[3] == (3, 1) and got[7] == (6, 0) and got[9] == (9, 0)


def test_many_copies_are_paired_with_the_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "EXPANDED", 3)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(k, base, 1, "") for k in range(1, 8)] + [(20, base + " x", 1, ""), (21, base + " x", 1, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/indexed_files.parquet")
    assert {tuple(r) for r in N.p2_found(spark, str(tmp_path)).collect()} == {(1, k) for k in range(2, 8)} | {(1, 20), (1, 21), (20, 21)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/indexed_files.parquet")
    assert N.p2_found(spark, str(tmp_path)).count() == 0


def test_crowded_band_of_one_text_and_its_copies(spark, monkeypatch):
    # more members than a bucket takes, most of them copies: the few different texts are still compared
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(k, base, 1, "") for k in range(30)] + [(40 + k, base + f" t{k}", 1, "") for k in range(6)]
    codes, members = N.coded(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = N.links(codes, P, Scratch(spark, "t"), 4).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == 21  # all pairs of seven texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {k: v for k, v in got.items() if k in want} == {k: v for k, v in want.items() if k in got} and set(got) == set(want)


def test_groups(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base, 1, ""), (2, base + " tail", 1, ""), (9, base, 1, ""), (3, "nothing like it at all here", 1, ""), (7, None, 1, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/indexed_files.parquet")
    assert {tuple(r) for r in N.p2_groups(spark, str(tmp_path)).collect()} == {(2, 2, 1), (5, 2, 1), (9, 2, 1), (3, 3, 0)}
