import io
import json
import os
import zipfile

import pytest

from loam.api import ArgumentError, Tools, clean_exts
from loam.cli import main
from loam.manage import Index
from loam.operators.changes import rows_for
from loam.plans import search as S
from loam.sources import extract as X
from loam.sources.store import Store, StoreError
from loam.streaming import watch


def write(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", xml)
    return out.getvalue()


DOCX = office(word__document="<w:document xmlns:w='x'><w:p><w:t>docx </w:t><w:t>sentinel &amp; more</w:t></w:p></w:document>")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("idx")
    root = base / "docs"
    write(root, {
        "both.md": "限流中间件的实现细节 covid-19 vaccine", "one.md": "限流方案对比笔记", "note.txt": "API design notes", "sub/deep/main.rs": "fn main() { api }", "empty.txt": "",
        "node_modules/x.md": "hidden api", "a.docx": DOCX, "broken.docx": "not a real zip file", "pic.png": b"\x89PNG", "gbk.txt": "分布式限流器保护后端服务".encode("gbk"),
    })
    index = Index(spark, f"file://{base}/index")
    return index, root, index.build(str(root))


def names(df):
    return sorted(os.path.basename(r.path) for r in df.select("path").collect())


def test_build_and_search(built):
    index, root, stats = built
    files = index.store.files()
    assert stats["indexed"] == 7 and names(files) == ["a.docx", "both.md", "gbk.txt", "main.rs", "note.txt", "one.md", "pic.png"]
    for query, want in [
        ("限流 中间件", ["both.md"]), ("API", ["main.rs", "note.txt"]), ('"限流器"', ["gbk.txt"]), ("covid-19", ["both.md"]), ('"vaccine 19"', []), ("sentinel", ["a.docx"]),
        ("限流 -中间件", ["gbk.txt", "one.md"]), ("vaccine OR design", ["both.md", "note.txt"]), ("api ext:rs", ["main.rs"]), ("path:deep", ["main.rs"]), ("size:<5", ["pic.png"]), ("mtime:<2000-01-01", []),
        ("pic", ["pic.png"]), ("kind:image", ["pic.png"]),
    ]:
        assert names(S.where(files, query)) == want, query
    with pytest.raises(S.QueryError):
        S.where(files, "--- ...")


def test_page(built):
    files = built[0].store.files()
    page = S.page(files, "限流", limit=1, offset=1)
    assert page.total == 3 and page.hits.count() == 1
    assert S.page(files, "限流", limit=0).hits.count() == 0 and S.page(files, "限流", offset=9).hits.count() == 0
    assert {r.score for r in S.page(files, "限流", sort="size").hits.collect()} == {0.0}
    row = S.page(files, "vaccine").hits.first()
    assert row.snippet.encode()[row.highlighted[0].start : row.highlighted[0].end] == b"vaccine"


def test_tools(built, spark):
    tools = Tools(spark, built[0].store.root)
    hit = tools.search("vaccine")["hits"][0]
    assert "«vaccine»" in hit["snippet"] and hit["kind"] == "md" and hit["score"] > 0
    assert tools.search("限流", ext="code")["total_hits"] == 0 and "score" not in tools.search("限流", sort="mtime")["hits"][0]
    for bad in ({"limit": 0}, {"sort": "mtime_asc"}, {"offset": -1}):
        with pytest.raises(ArgumentError):
            tools.search("x", **bad)
    assert tools.preview("/nowhere")["error"] == "path_not_found"
    assert "«vaccine»" in tools.preview(hit["path"], "vaccine")["text"]
    assert Tools(spark, built[0].store.root + "-none").search("x")["error"] == "index_unavailable"
    assert clean_exts(" MD, ,txt") == ["md", "txt"]
    assert tools.index_status()["documents"] == 7


def test_reconcile_and_roots(spark, tmp_path):
    root, other = tmp_path / "r", tmp_path / "r2"
    write(root, {"a.md": "alpha", "b.md": "beta", "c.md": "gamma"})
    write(other, {"x.md": "delta"})
    index = Index(spark, f"file://{tmp_path}/index")
    index.build(str(root))
    assert index.add(str(other)) == {"indexed": 1}
    assert index.add(str(other)) == {"indexed": 1} and index.store.files().count() == 4
    for bad in (root / "sub", tmp_path):
        with pytest.raises(StoreError):
            index.add(str(bad))
    (root / "b.md").unlink()
    write(root, {"a.md": "alpha changed", "d.md": "new"})
    assert index.reconcile() == {"added": 1, "modified": 1, "removed": 1}
    assert index.reconcile() == {"added": 0, "modified": 0, "removed": 0}
    assert names(S.where(index.store.files(), "changed OR new")) == ["a.md", "d.md"]
    assert index.remove(str(other)) == {"removed": 1} and index.status()["roots"] == {str(root): 3}
    assert index.start("C:", 1, 0) == "reconcile"
    index.commit_cursor("C:", 1, 50)
    assert index.start("C:", 1, 40) == "replay" and index.start("C:", 1, 60) == "reconcile"


def test_rules_and_meta(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    assert store.rules()["max_file_mb"] == 20
    store.set_rules(max_file_mb=0, extra_text_exts=[" .FOO", "foo", ""])
    assert store.rules()["max_file_mb"] == 1 and store.rules()["extra_text_exts"] == ["foo"] and "target" in store.rules()["exclude_dirs"]
    (tmp_path / "i" / "rules.json").write_text("{broken")
    for crc in (tmp_path / "i").glob(".*.crc"):
        crc.unlink()
    assert store.rules()["max_file_mb"] == 20
    with pytest.raises(StoreError):
        store.meta()
    store.write_json("meta.json", {"schema_version": 4})
    with pytest.raises(StoreError):
        store.meta()


def test_cli(spark, tmp_path, capsys):
    write(tmp_path / "d", {"a.md": "alpha beta"})
    at = ["--index", f"file://{tmp_path}/i"]
    assert main([*at, "index", str(tmp_path / "d")], spark) == 0
    assert main([*at, "search", "beta", "--sort", "bogus"], spark) == 0
    assert "1 hits" in capsys.readouterr().out
    assert main([*at, "search", "mtime:>abc"], spark) == 1
    assert main([*at, "rules", "set", "--max-file-mb", "3"], spark) == 0 and json.loads(capsys.readouterr().out)["max_file_mb"] == 3


def test_decoding():
    assert X.decode_text(b"") is None and X.decode_text("\ufeffab".encode()) == "ab" and X.decode_text("报告".encode("gbk")) == "报告"
    assert X.decode_text(b"a\xff\xfeb") == "a\ufffd\ufffdb" and X.decode_text("ü".encode("utf-16")) == "ü"


def test_office():
    assert X.office_text(DOCX, "docx") == "docx sentinel & more"
    sheet = office(xl__sharedStrings="<s><t>foo</t><t>bar</t></s>", xl__worksheets__sheet1="<s><t>inline</t><v>1</v></s>", xl__worksheets__sheet2="<s><t>kept</t><broken")
    assert X.office_text(sheet, "xlsx").split() == ["foo", "bar", "inline", "kept"]
    deck = office(ppt__slides__slide10="<a><a:t xmlns:a='x'>ten</a:t></a>", ppt__slides__slide2="<a><t>two</t></a>")
    assert X.office_text(deck, "pptx").split() == ["two", "ten"]
    assert X.office_text(b"no zip", "docx") is None and X.office_text(office(other="<x/>"), "docx") is None and X.extract(b"x", "exe") is None


def test_stream_keeps_the_index_current(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    row = lambda p, t: (p, p[1:], "md", t, 1, 1, "text")
    schema = "path string, name string, ext string, content string, mtime long, size long, kind string"
    store.replace(spark.createDataFrame([row("/a", "old"), row("/b", "b"), row("/t/c", "c")], schema))
    feed = f"file://{tmp_path}/feed"
    spark.createDataFrame([(1, "upsert", "/a", None), (2, "rename", "/b", "/n"), (3, "remove_tree", "/t", None)], "seq long, op string, path string, to_path string").selectExpr("seq", "timestamp_seconds(seq) AS ts", "op", "path", "to_path").write.parquet(feed)
    fresh = spark.createDataFrame([row("/a", "new"), row("/n", "n")], schema)
    for _ in range(2):  # the second run has nothing to do
        watch.keep_current(watch.events(spark, feed), store, lambda want: fresh.join(want.select("path"), "path", "left_semi"), f"{tmp_path}/ck").awaitTermination()
    assert {(r.path, r.content) for r in store.files().collect()} == {("/a", "new"), ("/n", "n")}
    assert store.meta()["version"] == 2


def test_stream_fills_upserted_trees(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    row = lambda p, t: (p, p.rsplit("/", 1)[1], "md", t, 1, 1, "text")
    schema = "path string, name string, ext string, content string, mtime long, size long, kind string"
    store.replace(spark.createDataFrame([row("/t/a", "old"), row("/t/gone", "x"), row("/t2/b", "b"), row("/c", "old")], schema))
    feed = f"file://{tmp_path}/feed"
    ops = [(1, "upsert_tree", "/t", None), (2, "upsert_tree", "/new", None), (3, "upsert", "/c", None)]
    spark.createDataFrame(ops, "seq long, op string, path string, to_path string").selectExpr("seq", "timestamp_seconds(seq) AS ts", "op", "path", "to_path").write.parquet(feed)
    disk = spark.createDataFrame([row("/t/a", "new"), row("/t/d/e", "e"), row("/t2/b", "not asked for"), row("/new/f", "f"), row("/newer/g", "g"), row("/c", "new")], schema)
    watch.keep_current(watch.events(spark, feed), store, lambda wanted: rows_for(disk, wanted), f"{tmp_path}/ck").awaitTermination()
    assert {(r.path, r.content) for r in store.files().collect()} == {("/t/a", "new"), ("/t/d/e", "e"), ("/t2/b", "b"), ("/new/f", "f"), ("/c", "new")}


def test_sessions(spark, tmp_path):
    spark.createDataFrame([(1, 0, "upsert"), (2, 1, "remove"), (3, 9000, "upsert"), (4, 99999, "upsert")], "seq long, s long, op string").selectExpr("seq", "timestamp_seconds(s) AS ts", "op", "'/a' AS path", "'' AS to_path").write.parquet(f"{tmp_path}/e")
    q = watch.sessions(watch.events(spark, f"{tmp_path}/e"), "2 seconds").writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.changes, r.last_op) for r in spark.table("sess").collect()} >= {(2, "remove"), (1, "upsert")}
