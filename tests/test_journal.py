import random

import pytest

from loam.operators import journal as J
from loam.session import Scratch

ROOT, SEP = 1, "\\"


def rec(frn, parent, name, is_dir=False, **flags):
    return {"usn": 0, "frn": frn, "parent_frn": parent, "name": name, "is_dir": is_dir} | {k: flags.get(k, False) for k in ("file_create", "file_delete", "rename_old_name", "rename_new_name")}


def run(*records, tree=None):
    t = J.Translator({ROOT: "C:\\r"}, dict(tree or {}))
    return t.all(records)


OLD, NEW, DEL, CRE = ({k: True} for k in ("rename_old_name", "rename_new_name", "file_delete", "file_create"))


def test_translation():
    assert run(rec(5, ROOT, "a.md", **CRE)) == [("upsert", "C:\\r\\a.md")]
    assert run(rec(5, ROOT, "a.md", **CRE), rec(5, ROOT, "a.md", **DEL)) == [("upsert", "C:\\r\\a.md"), ("remove", "C:\\r\\a.md")]
    assert run(rec(5, ROOT, "a", **OLD), rec(5, ROOT, "b", **NEW), tree={5: (ROOT, "a", False)}) == [("remove", "C:\\r\\a"), ("upsert", "C:\\r\\b")]
    assert run(rec(5, ROOT, "a", **OLD), rec(5, ROOT, "a", **DEL), tree={5: (ROOT, "a", False)}) == [("remove", "C:\\r\\a")]
    assert run(rec(5, ROOT, "b", **NEW)) == [("upsert", "C:\\r\\b")]
    assert run(rec(5, ROOT, "a", **OLD), rec(5, 99, "a", **NEW), tree={5: (ROOT, "a", False)}) == [("remove", "C:\\r\\a")]
    assert run(rec(5, ROOT, "a", **OLD), rec(5, ROOT, "a", **NEW), tree={5: (ROOT, "a", False)}) == []
    assert run(rec(5, 99, "x", **CRE)) == []


def test_interleaved_renames_and_directories():
    tree = {5: (ROOT, "a", False), 6: (ROOT, "d", True), 7: (6, "f", False)}
    got = run(rec(5, ROOT, "a", **OLD), rec(6, ROOT, "d", True, **OLD), rec(5, ROOT, "b", **NEW), rec(6, ROOT, "e", True, **NEW), rec(7, 6, "f"), tree=tree)
    assert got == [("remove", "C:\\r\\a"), ("upsert", "C:\\r\\b"), ("remove_tree", "C:\\r\\d"), ("upsert_tree", "C:\\r\\e"), ("upsert", "C:\\r\\e\\f")]


def test_number_used_again_clears_what_waits():
    assert run(rec(5, ROOT, "a", **OLD), rec(5, ROOT, "z", **CRE), rec(5, ROOT, "y", **NEW), tree={5: (ROOT, "a", False)})[-1] == ("upsert", "C:\\r\\y")


def test_cycle_has_no_path():
    assert J.Translator({ROOT: "r"}, {2: (3, "a", True), 3: (2, "b", True)}).path(2) is None


def test_decode(spark):
    name = "报告.md".encode("utf-16-le")
    raw = J.LAYOUT.pack(60 + len(name), 2, 0, 7, 8, 9, 0, J.FILE_CREATE | J.RENAME_NEW, 0, 0, J.DIRECTORY, len(name), 60) + name
    row = J.decode(raw)
    assert (row["usn"], row["frn"], row["parent_frn"], row["name"], row["is_dir"], row["file_create"], row["file_delete"]) == (9, 7, 8, "报告.md", True, True, False)
    assert J.decode(raw[:40]) is None and J.decode(raw[:-2]) is None and J.decode(None) is None and J.decode(b"") is None
    df = spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(raw[:10]),)], "record binary")
    assert [r.name for r in J.decoded(df).collect()] == ["报告.md"]


def test_cursor_follows_commits_in_order():
    c = J.CursorTracker(10)
    a, b = c.receive(20), c.receive(30)
    assert c.commit(b) == 10 and c.commit(a) == 30


@pytest.mark.parametrize("seed", [2])
def test_translated_tables_equal_the_reader(spark, seed):
    rng = random.Random(seed)
    roots = {1: "C:\\r", 2: "C:\\s"}
    entries = {k: (rng.choice([1, 2, 99, 10, 11]), f"e{k}", k % 3 == 0) for k in range(10, 20)}
    entries[10], entries[11] = (1, "a", True), (10, "b", True)
    records = []
    for n in range(50):
        frn = rng.randrange(10, 26)
        kind = rng.choice(["file_create", "file_delete", "rename_old_name", "rename_new_name", ""])
        records.append({"usn": 100 + n, "frn": frn, "parent_frn": rng.choice([1, 2, 99, 10, 11, 12]), "name": f"n{n}", "is_dir": frn % 3 == 0} | {k: k == kind for k in J.FLAGS})
    reader = J.Translator(dict(roots), dict(entries))
    want = [(r["usn"], op, path) for r in records for op, path in reader.one(r)]
    rows = [("C:", r["usn"], r["frn"], r["parent_frn"], r["name"], r["is_dir"], tuple(r[k] for k in J.FLAGS)) for r in records]
    frame = spark.createDataFrame(rows + rows[:5], "volume string, usn long, frn long, parent_frn long, name string, is_dir boolean, reason struct<file_create:boolean,file_delete:boolean,rename_old_name:boolean,rename_new_name:boolean>")
    tree = spark.createDataFrame([("C:", k, *v) for k, v in entries.items()], "volume string, frn long, parent_frn long, name string, is_dir boolean")
    anchors = spark.createDataFrame([("C:", k, v) for k, v in roots.items()], "volume string, frn long, root_path string")
    got = J.translated(frame, tree, anchors, Scratch(spark, "t")).orderBy("seq").collect()
    assert [(r.seq // 2, r.op, r.path) for r in got] == want
