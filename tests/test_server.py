import io
import json

import pytest

from loam.api import Commands, Tools
from loam.manage import Index, clean_root
from loam.server import Server
from loam.sources.images import drain
from loam.sources.store import Store
from loam.streaming.catchup import catch_up, watch


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("srv")
    root = base / ".hidden" / "docs"
    root.mkdir(parents=True)
    for name, text in {"a.md": "alpha beta", ".dot.md": "alpha dotted", "_under.txt": "alpha under", "sub/c.md": "gamma", ".git/x.md": "alpha hidden"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    for k in range(5):
        (root / f"p{k}.png").write_bytes(b"image %d" % k)
    out = Index(spark, f"file://{base}/index", lambda raw: raw.decode() + " 会 议")
    out.recognise = None
    out.build(str(root))
    return out, root


def ask(server, *messages):
    sink = io.StringIO()
    server.serve(io.StringIO("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages)), sink)
    return [json.loads(x) for x in sink.getvalue().splitlines()]


def test_server(spark, index):
    server = Server(Tools(spark, index[0].store.root))
    call = lambda n, name, **args: {"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": name, "arguments": args}}
    got = ask(server, {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
              call(3, "search", query="alpha"), call(4, "search", query="alpha", limit=0), call(5, "preview", path="/nowhere"), call(6, "nothing"), "{", {"id": 7}, {"jsonrpc": "2.0", "id": 8, "method": "x"}, call(9, "search"), call(10, "index_status"))
    by = {m["id"]: m for m in got}
    assert by[1]["result"]["serverInfo"]["name"] == "loam" and {t["name"] for t in by[2]["result"]["tools"]} == {"search", "preview", "index_status"}
    assert by[3]["result"]["structuredContent"]["total_hits"] == 3 and not by[3]["result"]["isError"]  # names that begin with . or _ are indexed, hidden folders aren't
    assert by[4]["error"]["code"] == -32602 and by[5]["result"]["isError"] and by[6]["error"]["code"] == -32602 and by[8]["error"]["code"] == -32601 and by[9]["error"]["code"] == -32602
    assert by[7]["error"]["code"] == -32600 and by[None]["error"]["code"] == -32700 and by[10]["result"]["structuredContent"]["documents"] == 9


def test_images_are_recognised_in_batches_and_never_twice(spark, index):
    idx, root = index
    assert idx.queue.progress() == {"total": 5, "done": 0}
    seen = lambda raw: raw.decode() + " 会 议"
    assert drain(idx.queue, idx.store, None) == {"total": 5, "done": 0}
    assert drain(idx.queue, idx.store, seen, batch=2) == {"total": 5, "done": 5}
    assert idx.store.searcher().top('"会议"', 10)[1] == 5 and idx.store.searcher().top("image", 10)[1] == 5
    assert Commands(spark, idx.store.root).indexing_status()["state"] == "idle"
    idx.build(str(root))  # a rebuild takes the stored texts
    assert idx.store.searcher().top('"会议"', 10)[1] == 5 and idx.queue.pending().count() == 0


def test_watch_follows_the_disk(index):
    idx, root = index
    (root / "new.md").write_text("omega")
    seen = []
    assert watch(idx, 0.0, 0.1, seen.append) == 1 and seen == [{"added": 1, "modified": 0, "removed": 0}]
    assert idx.store.searcher().top("omega", 5)[1] == 1


def test_catch_up_replays_from_the_cursor(spark, index):
    idx, root = index
    (root / "late.md").write_text("sigma")
    flags = "reason struct<file_create:boolean,file_delete:boolean,rename_old_name:boolean,rename_new_name:boolean>"
    journal = spark.createDataFrame([("V:", 7, 10, 50, 1, "old.md", False, (True, False, False, False)), ("V:", 7, 20, 51, 1, "late.md", False, (True, False, False, False))], "volume string, journal_id long, usn long, frn long, parent_frn long, name string, is_dir boolean, " + flags)
    entries = spark.createDataFrame([], "volume string, frn long, parent_frn long, name string, is_dir boolean")
    anchors = spark.createDataFrame([("V:", 1, "V:\\docs")], "volume string, frn long, root_path string")
    listed = idx.indexable(idx.listed([str(root)]))
    first = catch_up(idx, "V:", 7, journal.where("usn < 20"), entries, anchors, listed)
    assert first["how"] == "reconcile" and first["next_usn"] == 11
    again = catch_up(idx, "V:", 7, journal, entries, anchors, listed)
    assert again["how"] == "replay" and again["next_usn"] == 21 and idx.store.meta()["cursors"]["V:"] == {"journal_id": 7, "next_usn": 21}
    assert again["outcome"] == {"upserted": 0, "removed": 0, "skipped": 1}  # the path lies on another system, so no row came


def test_states_survive_a_crash_and_streams_dont_share_numbers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    schema = "path string, name string, ext string, content string, mtime long, size long, kind string"
    row = lambda p, t: (p, p[1:], "md", t, 1, 1, "text")
    store.replace(spark.createDataFrame([row("/a", "old")], schema))
    (tmp_path / "i" / "meta-000000000002.json").write_text("{half")  # a crash while the next state was written
    for crc in (tmp_path / "i").glob(".*.crc"):
        crc.unlink()
    assert store.meta()["version"] == 1 and store.files().count() == 1
    (tmp_path / "i" / "meta-000000000002.json").unlink()
    ops = spark.createDataFrame([("/b", "upsert")], "path string, op string")
    for stream, text in (("one", "first"), ("two", "second"), ("two", "again")):
        store.apply(ops, spark.createDataFrame([row("/b", text)], schema), tag=(stream, 0))
    assert {r.path: r.content for r in store.files().collect()} == {"/a": "old", "/b": "second"}
    assert store.searcher().stats(["old"], ("content",)).n == 2


def test_many_batches_are_merged(spark, tmp_path, monkeypatch):
    from loam.sources import store as module

    monkeypatch.setattr(module, "FAN", 3)
    store = Store(spark, f"file://{tmp_path}/i")
    schema = "path string, name string, ext string, content string, mtime long, size long, kind string"
    row = lambda p, t: (p, p[1:], "md", t, 1, 1, "text")
    store.replace(spark.createDataFrame([row("/a", "zero word"), row("/z", "word")], schema))
    for k in range(4):
        store.apply(spark.createDataFrame([("/a", "upsert")], "path string, op string"), spark.createDataFrame([row("/a", f"n{k} word"), row(f"/b{k}", "word")], schema))
    assert len(store.meta()["segments"]) <= 3
    reader = store.searcher()
    assert reader.num_docs() == 6 and reader.top("word", 10)[1] == 6 and reader.top("n3", 10)[1] == 1 and reader.top("n2", 10)[1] == 0
    assert reader.stats(["word"], ("content",)).df["content", "word"] == 6


def test_roots_are_resolved(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert clean_root(f"{tmp_path}/link/not/there/") == f"{tmp_path}/real/not/there" and clean_root("C:\\x\\") == "C:\\x"
