import random

import pytest

from loam.operators import hierarchy as H
from loam.session import Scratch

ENTRIES, ROOTS = "volume string, frn long, parent_frn long, name string, usn long, extra string", "volume string, frn long, root_path string"


def brute(entries, roots):
    latest = {}
    for v, f, p, n, u, _ in entries:
        if f is not None and ((v, f) not in latest or (u or -1) > latest[v, f][2]):
            latest[v, f] = (p, n or "", u or -1)
    tops, out = {(v, f): r for v, f, r in roots}, {}
    for (v, f) in latest:
        names, at, seen = [], f, set()
        while (v, at) in latest and at not in seen and (v, at) not in tops:
            seen.add(at)
            names.append(latest[v, at][1])
            at = latest[v, at][0]
        if (v, at) in tops:
            out[v, f] = ("rooted", at, len(names), "\\".join([tops[v, at], *reversed(names)]))
        else:
            out[v, f] = ("cycle" if at in seen else "broken", -1, -1, "")
    return out


def run(spark, entries, roots):
    got = H.hierarchy(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(roots, ROOTS), Scratch(spark, "t")).collect()
    assert len({(r.volume, r.frn) for r in got}) == len(got)
    return {(r.volume, r.frn): (r.outcome, r.root_frn, r.node_depth, r.full_path) for r in got}


def test_small_cases(spark):
    entries = [("C:", 10, 1, "a", 5, ""), ("C:", 11, 10, "b", 5, ""), ("C:", 11, 99, "old", 2, ""), ("C:", 11, 10, "b", 5, ""), ("C:", 20, 20, "self", 1, ""), ("C:", 21, 22, "x", 1, ""), ("C:", 22, 21, "y", 1, ""), ("C:", 23, 22, "hangs", 1, ""), ("C:", 30, None, "n", 1, ""), ("C:", 31, 30, None, None, ""), ("D:", 11, 1, "other", 1, ""), ("C:", None, 1, "no", 1, ""), ("C:", 2**62 + 1, 10, "big", 1, "")]
    roots = [("C:", 1, "C:\\r"), ("D:", 2, "D:\\r")]
    got = run(spark, entries, roots)
    assert got == brute(entries, roots)
    assert got["C:", 2**62 + 1] == ("rooted", 1, 2, "C:\\r\\a\\big")


def test_empty(spark):
    assert run(spark, [], [("C:", 1, "C:\\r")]) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest_with_small_bounds(spark, monkeypatch, seed):
    for name, value in (("LOCAL_ROWS", 40), ("CHUNK", 15), ("SIBLINGS", 10)):
        monkeypatch.setattr(H, name, value)
    rng = random.Random(seed)
    entries = [("C:", 100 + i, rng.choice([1, 99, None, 100 + rng.randrange(max(1, i)), 100 + rng.randrange(80), 100 + max(0, i - 1)]) if i % 3 else 101, f"n{i}", 1, "") for i in range(80)]
    roots = [("C:", 1, "C:\\r")]
    assert run(spark, entries, roots) == brute(entries, roots)


def test_descendants(spark):
    entries = [("C:", 10, 1, "a", 1, ""), ("C:", 11, 10, "b", 1, ""), ("C:", 12, 11, "c", 1, ""), ("C:", 13, 10, "d", 1, "")]
    spans = H.intervals(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([("C:", 1, "C:\\r")], ROOTS), Scratch(spark, "t"))
    assert {r.frn: r.descendants for r in spans.collect()} == {10: 3, 11: 1, 12: 0, 13: 0}
    pairs = H.descendants(spans, spark.createDataFrame([("C:", 10), ("C:", 11)], "volume string, frn long"))
    assert {(r.ancestor, r.frn) for r in pairs.collect()} == {(10, 11), (10, 12), (10, 13), (11, 12)}


def test_registered_descendants_have_every_entry(spark, tmp_path):
    from loam.queries import REGISTRY

    entries = [("C:", 100, 1, "a", 1, ""), ("C:", 101, 100, "b", 1, ""), ("C:", 102, 101, "c", 1, ""), ("C:", 200, 201, "x", 1, ""), ("C:", 201, 200, "y", 1, ""), ("C:", 202, 200, "hangs", 1, ""), ("C:", 203, 202, "on", 1, ""), ("D:", 100, None, "d", 1, ""), ("D:", 103, 100, "e", 1, "")]
    spark.createDataFrame(entries, ENTRIES).write.parquet(f"{tmp_path}/frn_entries.parquet")
    spark.createDataFrame([("C:", 1, "C:\\r")], ROOTS).write.parquet(f"{tmp_path}/frn_roots.parquet")
    spans = {(r.volume, r.frn): (r.descendants, r.loop) for r in REGISTRY["p7_intervals"][0](spark, str(tmp_path)).collect()}
    assert spans == {("C:", 100): (2, False), ("C:", 101): (1, False), ("C:", 102): (0, False), ("C:", 200): (2, True), ("C:", 201): (0, True), ("C:", 202): (1, False), ("C:", 203): (0, False), ("D:", 100): (1, False), ("D:", 103): (0, False)}
    pairs = {(r.volume, r.ancestor, r.frn, r.loop) for r in REGISTRY["p7_descendant_pairs"][0](spark, str(tmp_path)).collect()}
    assert pairs == {("C:", 100, 101, False), ("C:", 100, 102, False), ("C:", 200, 202, True), ("C:", 200, 203, True), ("D:", 100, 103, False)}
