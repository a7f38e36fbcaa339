from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import paths
from loam.functions.snippet import highlight_name, normalize_ranges, segments, snippet, wrap
from loam.functions.text import clean_cjk_spaces, dual_form, frequency, human_ago, merge_ranges, tokenize, tokens


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    for text, want in [("glimmer-9931-Unique", ["glimmer", "9931", "unique"]), ("v1.2.3", ["v1", "2", "3"]), ("用 GPT-4 写的", ["用", "gpt", "4", "写", "的"]), ("，。 ,.", []), ("", [])]:
        assert one(spark, tokens(F.lit(text))) == want
        assert [t for t, _, _ in tokenize(text)] == want
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_token_offsets_are_bytes():
    assert tokenize("报告api")[-1] == ("api", 6, 9)
    assert len(tokenize("alpha-99 " * 20000)) == 40000


def test_phrase_frequency(spark):
    toks = F.array(*[F.lit(t) for t in "a a a b".split()])
    assert one(spark, frequency(toks, ["a", "a"])) == 2
    assert one(spark, frequency(toks, ["b", "a"])) == 0
    assert one(spark, frequency(F.array().cast("array<string>"), ["a", "a"])) == 0


def test_cjk_spaces(spark):
    assert one(spark, clean_cjk_spaces(F.lit("分 布 式 a b  限"))) == "分布式 a b  限"
    assert one(spark, dual_form(F.lit(" 分 布 "))) == "分 布\n分布"
    assert one(spark, dual_form(F.lit("  \n"))) == ""


def test_paths(spark):
    assert one(spark, paths.display_path(F.lit("\\\\?\\UNC\\host\\x"))) == "\\\\host\\x"
    assert one(spark, paths.display_path(F.lit("\\\\?\\C:\\x"))) == "C:\\x"
    assert [one(spark, paths.extension(F.lit(p))) for p in ("/a/.bashrc", "/a.b/noext", "C:\\x\\Y.MD", "t.tar.gz")] == ["", "", "md", "gz"]
    assert one(spark, paths.under(F.lit("/watchother/a"), "/watch")) is False
    assert one(spark, paths.excluded(F.lit("a/.git/x"), ["target"])) is True
    assert one(spark, paths.excluded(F.lit("a/target"), ["target"])) is False
    assert one(spark, paths.middle_ellipsis(F.lit("x" * 30), 11)) == "xxxxxx…xxxx"


def test_human_ago(spark):
    assert [one(spark, human_ago(F.lit(s))) for s in (5, 125, 7200, 200000)] == ["5 s ago", "2 min ago", "2 h ago", "2 d ago"]


def test_ranges(spark):
    vectors = [([], []), ([(10, 13), (0, 2), (5, 7)], [(0, 2), (5, 7), (10, 13)]), ([(0, 9), (0, 6)], [(0, 9)]), ([(0, 6), (3, 9)], [(0, 9)]), ([(0, 3), (3, 6)], [(0, 6)])]
    for given_, want in vectors:
        assert normalize_ranges(given_) == want
        arr = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in given_]) if given_ else F.array().cast("array<struct<start:int,end:int>>")
        assert [tuple(r) for r in one(spark, merge_ranges(arr))] == want


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)).map(lambda t: (t[0], t[0] + t[1]))))
def test_normalized_ranges_cover_the_same(ranges):
    out = normalize_ranges(ranges)
    assert {i for a, b in ranges for i in range(a, b)} == {i for a, b in out for i in range(a, b)}
    assert all(a[1] < b[0] for a, b in zip(out, out[1:]))


def test_snippet():
    text, ranges = snippet("fill " * 200 + "报告 the needle here " + "more " * 200, {"needle": 1.0, "报": 1.0})
    assert len(text) <= 160 and [text.encode()[a:b].decode() for a, b in ranges] == ["报", "needle"]
    assert snippet("x" * 500, {"y": 1.0}) == ("x" * 160, [])
    assert snippet("a " * 70_000 + "needle", {"needle": 1.0})[1] == []


def test_segments():
    assert segments("报告api", [(6, 9), (1, 2), (4, 4)]) == [("报告", False), ("api", True)]
    assert segments("", []) == [("", False)]
    assert wrap("a b", [(2, 3)]) == "a «b»"
    assert highlight_name("Report-report", ['"report"']) == [(0, 6), (7, 13)]


def test_human_bytes_of_every_size(spark, tmp_path):
    import duckdb

    from loam.queries import REGISTRY

    sizes = [None, 0, 1023, 1024, 1536, 1 << 20, (1 << 30) - 1, 1 << 30, 3 << 29, 1 << 40, 5 << 41, 1 << 50]
    spark.createDataFrame([(s,) for s in sizes], "size long").write.parquet(f"{tmp_path}/indexed_files.parquet")
    query, sql = REGISTRY["human_bytes_all"]
    got = {(r.size, r.shown) for r in query(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW indexed_files AS SELECT * FROM '{tmp_path}/indexed_files.parquet/*.parquet'")
    assert got == set(con.execute(sql).fetchall()) and len(got) == len(sizes)
    assert {(None, None), (3 << 29, "1.5 GB"), (5 << 41, "10.0 TB")} <= got
