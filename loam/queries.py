"""The registry of the core's queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths
from loam.functions import text as X
from loam.operators import changes as C
from loam.operators import hierarchy, journal, ledger, replay
from loam.operators.ledger import latest
from loam.plans import segment
from loam.plans import search as S
from loam.plans.searcher import Searcher
from loam.session import Scratch, table
from loam.sources.extract import extractable
from loam.sources.store import RULES

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

# The tables as files, and their tokens, in SQL. RE2 has no class of alphabetic marks, so the vowel signs of the corpus's one such script are spelled out.
_TOKEN = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|(?:[^\P{L}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|\p{N}|[\x{093E}-\x{094C}])+)"
FILES = r"""files AS (
  SELECT doc_id, coalesce(path, '') AS path, coalesce(regexp_extract(path, '([^/\\]*)$', 1), '') AS name, lower(coalesce(ext, '')) AS ext,
    coalesce(text, '') AS content, coalesce(epoch_us(modified_at) // 1000, 0) AS mtime, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM documents
)"""
TOKENS = FILES + f""", toks AS (
  SELECT *, regexp_extract_all(lower(content), '{_TOKEN}') AS t, regexp_extract_all(lower(name), '{_TOKEN}') AS tn, regexp_extract_all(lower(path), '{_TOKEN}') AS tp FROM files
), hay AS (
  SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS c, ' ' || array_to_string(tn, ' ') || ' ' AS n, ' ' || array_to_string(tp, ' ') || ' ' AS p FROM toks
)"""  # fmt: skip


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return add


def index_of(spark: SparkSession, d: str) -> Searcher:
    """The index of the documents table, built once a session below the shared folder."""
    made = spark.sparkContext.__dict__.setdefault("_loam_indexes", {})
    if d not in made:
        made[d] = Searcher(spark, [segment.build(S.documents_as_files(spark, d, apart=True), f"{Scratch(spark, 'index').root}/documents")])
    return made[d]


def rows_of(spark: SparkSession, rows: list[dict], schema: str, **more) -> DataFrame:
    """A page's rows as a frame."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple((r | more)[n] for n in names) for r in rows], schema)


def search_query(name: str, text: str, condition: str, exts: tuple[str, ...] | None = None) -> None:
    """A query of the query language; ``condition`` is what it means in SQL over ``hay``."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return index_of(spark, d).hits(text, exts, ("doc_id", "path"))

    REGISTRY[name] = (run, f"WITH {TOKENS} SELECT doc_id, path FROM hay WHERE {condition}")


def has(term: str) -> str:
    return f"(contains(c, ' {term} ') OR contains(n, ' {term} '))"


def _list(items: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _ms(day: str) -> str:
    return f"epoch_ms(TIMESTAMP '{day}')"


for _n, _g in (("doc", paths.DOC_EXTS), ("code", paths.CODE_EXTS), ("image", paths.IMAGE_EXTS)):
    search_query(f"ext_group_{_n}", "the OR 的 OR die", f"({has('the')} OR {has('的')} OR {has('die')}) AND ext IN ({_list(_g)})", _g)
search_query("term_match", "recipe", has("recipe"))
search_query("term_match_case", "RECIPE", has("recipe"))
search_query("and_terms", "recipe garden", f"{has('recipe')} AND {has('garden')}")
search_query("or_groups", "recipe garden OR wiring", f"({has('recipe')} AND {has('garden')}) OR {has('wiring')}")
search_query("not_term", "recipe -garden", f"{has('recipe')} AND NOT {has('garden')}")
search_query("not_word", "recipe NOT garden", f"{has('recipe')} AND NOT {has('garden')}")
search_query("pure_negation", "-recipe", f"NOT {has('recipe')}")
search_query("phrase_match", '"recipe card"', has("recipe card"))
search_query("phrase_cjk", '"会议纪要"', has("会 议 纪 要"))
search_query("compound_word", "half-written", has("half written"))
search_query("path_term", "path:notes", "contains(p, ' notes ')")
search_query("path_terms", "path:inbox/shared", "contains(p, ' inbox ') AND contains(p, ' shared ')")
search_query("path_phrase", 'path:"inbox shared"', "contains(p, ' inbox shared ')")
search_query("not_path", "recipe -path:notes", f"{has('recipe')} AND NOT contains(p, ' notes ')")
search_query("ext_field", "recipe ext:md", f"{has('recipe')} AND ext = 'md'")
search_query("name_field", "name:md", "contains(n, ' md ')")
search_query("mtime_gt", "mtime:>2024-06-15", f"mtime >= {_ms('2024-06-16')}")
search_query("mtime_ge", "mtime:>=2024-06-15", f"mtime >= {_ms('2024-06-15')}")
search_query("mtime_lt", "mtime:<2024-06-15", f"mtime < {_ms('2024-06-15')}")
search_query("mtime_le", "mtime:<=2024-06-15", f"mtime < {_ms('2024-06-16')}")
search_query("mtime_month", "mtime:>=2024-02 mtime:<=2024-02", f"mtime >= {_ms('2024-02-01')} AND mtime < {_ms('2024-03-01')}")
search_query("size_gt", "size:>1.5kb", "size > 1536")
search_query("size_le", "size:<=1kb", "size <= 1024")
search_query("not_size", "recipe NOT size:>1kb", f"{has('recipe')} AND NOT (size > 1024)")
search_query(
    "combined_operators", 'recipe "scratch buffer" -garden size:>1kb OR path:notes mtime:>2024-06 wiring',
    f"({has('recipe')} AND {has('scratch buffer')} AND size > 1024 AND NOT {has('garden')}) OR (contains(p, ' notes ') AND mtime >= {_ms('2024-07-01')} AND {has('wiring')})",
)


def _bm25_sql(terms: list[str], fields: list[tuple[str, str]], condition: str, limit: int = 20) -> str:
    parts, stats = [], ["count(*) AS nn"]
    for f, col in fields:
        stats.append(f"avg(len({col})) AS mean_{f}")
        for i, t in enumerate(terms):
            stats.append(f"count(*) FILTER (WHERE list_contains({col}, '{t}')) AS df_{f}_{i}")
            tf = f"len(list_filter({col}, lambda x: x = '{t}'))"
            parts.append(f"ln(1 + (nn - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len({col}) / mean_{f}))")
    return f"WITH {TOKENS}, st AS (SELECT {', '.join(stats)} FROM hay) SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM hay, st WHERE {condition} ORDER BY score DESC, path LIMIT {limit}"


@query("bm25_topk", _bm25_sql(["recipe", "garden"], [("content", "t")], "contains(c, ' recipe ') AND contains(c, ' garden ')"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    # both in the content, ranked by it
    rows, _ = index_of(spark, d).top("content:recipe content:garden recipe garden", 20, columns=("doc_id",), fields=("content",))
    return rows_of(spark, rows, "doc_id long, score double")


@query("bm25_two_field", _bm25_sql(["recipe", "md"], [("name", "tn"), ("content", "t")], f"{has('recipe')} AND {has('md')}"))
def bm25_two_field(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, index_of(spark, d).top("recipe md", 20, columns=("doc_id",))[0], "doc_id long, score double")


for _s, _o in (("mtime", "mtime DESC"), ("mtime_asc", "mtime"), ("size", "size DESC")):

    def _sorted(spark: SparkSession, d: str, s: str = _s) -> DataFrame:
        rows, _ = index_of(spark, d).top("recipe", 25, sort=s, columns=("doc_id", "path", "mtime", "size"))
        return rows_of(spark, rows, "doc_id long, path string, mtime long, size long")

    REGISTRY[f"sort_{_s}"] = (_sorted, f"WITH {TOKENS} SELECT doc_id, path, mtime, size FROM hay WHERE {has('recipe')} ORDER BY {_o}, path LIMIT 25")


@query("page_with_total", f"WITH {TOKENS} SELECT doc_id, path, count(*) OVER () AS total FROM hay WHERE {has('recipe')} ORDER BY size DESC, path LIMIT 5 OFFSET 5")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows, total = index_of(spark, d).top("recipe", 5, 5, sort="size", columns=("doc_id", "path"))
    return rows_of(spark, rows, "doc_id long, path string, total long", total=total)


@query("search_page")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).page('recipe "garden plan" OR wiring', 10, 0).hits


@query("preview_page")
def preview_page(spark: SparkSession, d: str) -> DataFrame:
    first = S.documents_as_files(spark, d).where("content <> '' AND path <> ''").agg(F.min("path")).first()[0] or ""
    return index_of(spark, d).preview(first, "the")


@query("num_docs", "SELECT count(*) AS docs FROM documents")
def num_docs(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, [{"docs": index_of(spark, d).num_docs()}], "docs long")


@query(
    "count_under_root",
    "SELECT r.root, count(d.path) AS files FROM (VALUES ('/notes'), ('/inbox/shared'), ('/note')) r(root) LEFT JOIN documents d ON d.path = r.root OR starts_with(d.path, r.root || '/') GROUP BY r.root",
)
def count_under_root(spark: SparkSession, d: str) -> DataFrame:
    return S.count_under(index_of(spark, d).files(), ["/notes", "/inbox/shared", "/note"])


@query("term_df", f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM hay) GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return segment.document_frequencies(index_of(spark, d).readers[0], "content")


@query("corpus_stats", f"WITH {TOKENS} SELECT count(*) AS n, round(avg(len(t)), 6) AS mean_length, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(max(len(t)) AS BIGINT) AS longest FROM hay")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    reader = index_of(spark, d)
    st = reader.stats([], ("content",))
    longest = reader.readers[0].parts().agg(F.max(F.array_max("tfs"))).first()[0] or 0
    row = {"n": st.n, "mean_length": round(st.mean["content"], 6), "tokens": reader.segments[0].content, "longest": longest}
    return rows_of(spark, [row], "n long, mean_length double, tokens long, longest long")


@query(
    "postings_index",
    f"WITH {TOKENS}, x AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM hay) SELECT term, doc_id, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM x GROUP BY ALL",
)
def postings_index(spark: SparkSession, d: str) -> DataFrame:
    return segment.postings_of(index_of(spark, d).readers[0], "content", "doc_id")


@query(
    "image_placeholders",
    r"SELECT file_id, path, CASE WHEN lower(ext) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp') THEN 'image' ELSE 'text' END AS kind, coalesce(content, '') AS content FROM indexed_files GROUP BY ALL",
)
def image_placeholders(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.lower("ext").isin(*paths.IMAGE_EXTS), "image").otherwise("text")
    return table(spark, d, "indexed_files").select("file_id", "path", kind.alias("kind"), F.coalesce("content", F.lit("")).alias("content")).distinct()


_OPS = "CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'upsert' WHEN 'purchase' THEN 'upsert_tree' WHEN 'error' THEN 'remove' ELSE 'remove_tree' END"
_EVENTS = f"e AS (SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS path, {_OPS} AS op FROM events)"
_BATCHES = "b AS (SELECT *, CAST(sum(CASE WHEN g IS NULL OR g > 600 THEN 1 ELSE 0 END) OVER (ORDER BY ts, seq) AS BIGINT) AS batch FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts, seq) AS g FROM e))"


def file_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("path"), F.expr(_OPS).alias("op"))


@query("debounce_last_op", f"WITH {_EVENTS}, {_BATCHES} SELECT batch, path, arg_max(op, seq) AS op FROM b GROUP BY batch, path")
def debounce_last_op(spark: SparkSession, d: str) -> DataFrame:
    return C.coalesce(C.quiet_batches(file_events(spark, d), "ts", 600, path="path"), "batch")


@query("quiet_window_batches", f"WITH {_EVENTS}, {_BATCHES} SELECT batch, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY batch")
def quiet_window_batches(spark: SparkSession, d: str) -> DataFrame:
    return C.quiet_batches(file_events(spark, d), "ts", 600, path="path").groupBy("batch").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("coalesce_all", f"WITH {_EVENTS} SELECT path, arg_max(op, seq) AS op FROM e GROUP BY path")
def coalesce_all(spark: SparkSession, d: str) -> DataFrame:
    return C.coalesce(file_events(spark, d))


@query(
    "rename_split",
    """WITH e AS (SELECT event_id AS seq, event_type = 'click' AS is_rename, CAST(user_id AS VARCHAR) AS path, CAST(user_id + 1 AS VARCHAR) AS to_path FROM events)
SELECT seq, path, 'upsert' AS op FROM e WHERE NOT is_rename UNION ALL SELECT seq, path, 'remove' FROM e WHERE is_rename UNION ALL SELECT seq, to_path, 'upsert' FROM e WHERE is_rename""",
)
def rename_split(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "rename").otherwise("upsert")
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("path"), (F.col("user_id") + 1).cast("string").alias("to_path"))
    return C.split_renames(rows)


def stored_and_listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stored = latest(table(spark, d, "indexed_files").select("path", "mtime", "size", "indexed_at"), "path", "indexed_at", "mtime", "size")
    listed = table(spark, d, "disk_listing").select(paths.strip_verbatim(F.col("path")).alias("path"), "mtime", "size", "seen_at")
    return stored, latest(listed, "path", "seen_at", "mtime", "size")


_LATEST = r"""i AS (SELECT path, mtime, size FROM indexed_files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, mtime DESC, size DESC) = 1),
l AS (SELECT * FROM (SELECT CASE WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END AS path, mtime, size, seen_at FROM disk_listing)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, mtime DESC, size DESC) = 1)"""
_DIFF = f"""{_LATEST}, diff AS (SELECT coalesce(i.path, l.path) AS path, CASE WHEN i.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM i FULL OUTER JOIN l ON i.path = l.path WHERE i.path IS NULL OR l.path IS NULL OR i.mtime IS DISTINCT FROM l.mtime OR i.size IS DISTINCT FROM l.size)"""


@query("upsert_merge", f"WITH {_LATEST} SELECT path, mtime, size FROM l UNION ALL SELECT path, mtime, size FROM i WHERE path NOT IN (SELECT path FROM l)")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    stored, listed = stored_and_listed(spark, d)
    return C.upsert(stored, listed)


@query("reconcile_diff", f"WITH {_DIFF} SELECT path, change FROM diff")
def reconcile_diff(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(*stored_and_listed(spark, d))


@query("reconcile_stats", f"WITH {_DIFF} SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'removed') AS removed FROM diff")
def reconcile_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(*stored_and_listed(spark, d)).agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "removed")])


@query("remove_tree", r"SELECT DISTINCT path FROM indexed_files WHERE NOT (path = 'C:\work\notes' OR starts_with(path, 'C:\work\notes\'))")
def remove_tree(spark: SparkSession, d: str) -> DataFrame:
    return C.remove_trees(table(spark, d, "indexed_files").select("path"), ["C:\\work\\notes"]).distinct()


@query(
    "apply_changes",
    rf"""WITH {_LATEST}, gone AS (SELECT path FROM i WHERE starts_with(path, 'C:\work\notes\') OR starts_with(path, 'E:\')), fresh AS (SELECT path, mtime, size FROM l WHERE starts_with(path, 'E:\'))
SELECT path, mtime, size FROM i WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    stored, listed = stored_and_listed(spark, d)
    ops = spark.createDataFrame([("C:\\work\\notes", "remove_tree"), ("E:", "upsert_tree")], "path string, op string")
    return C.apply_changes(stored, ops, listed)


_ROOTS = ("C:\\work", "D:\\media\\scans", "E:\\archive")


@query("orphans", "SELECT DISTINCT path FROM indexed_files WHERE " + " AND ".join(f"NOT (path = '{r}' OR starts_with(path, '{r}\\'))" for r in _ROOTS))
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return C.orphans(table(spark, d, "indexed_files"), list(_ROOTS)).distinct()


@query(
    "rules_exclusion",
    "SELECT doc_id, path FROM documents WHERE path IS NULL OR NOT list_bool_or(list_transform(list_slice(string_split(substr(path, 2), '/'), 1, len(string_split(substr(path, 2), '/')) - 1), lambda x: starts_with(x, '.') OR x IN ('inbox', 'zivoth', 'vipax')))",
)
def rules_exclusion(spark: SparkSession, d: str) -> DataFrame:
    files = S.documents_as_files(spark, d).select("doc_id", F.col("path"), F.substring("path", 2, 1 << 30).alias("relative"))
    return C.allowed(files, {"exclude_dirs": ["inbox", "zivoth", "vipax"]}).select("doc_id", F.when(F.col("path") != "", F.col("path")).alias("path"))


_TEXTS = _list(("pdf", *paths.TEXT_EXTS, *paths.OFFICE_EXTS))


@query(
    "oversize_stats",
    f"WITH {FILES} SELECT count(*) FILTER (WHERE ok AND size <= 2048 AND size > 0) AS indexed, count(*) FILTER (WHERE NOT (ok AND size <= 2048 AND size > 0)) AS skipped, count(*) FILTER (WHERE ok AND size > 2048) AS skipped_oversize FROM (SELECT *, ext IN ({_TEXTS}) AS ok FROM files)",
)
def oversize_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.outcomes(S.documents_as_files(spark, d), extractable(F.col("ext"), tuple(RULES["extra_text_exts"])), 2048)


@query(
    "ocr_cache_join",
    "SELECT f.file_id, f.path, f.mtime, f.size, p.cached FROM (SELECT DISTINCT file_id, path, mtime, size FROM indexed_files WHERE lower(ext) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp')) f LEFT JOIN (SELECT path, mtime, size, max(content) AS cached FROM ocr_processed GROUP BY ALL) p USING (path, mtime, size)",
)
def ocr_cache_join(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "indexed_files").where(F.lower("ext").isin(*paths.IMAGE_EXTS)).select("file_id", "path", "mtime", "size").distinct()
    return C.cached_content(images, table(spark, d, "ocr_processed").select("path", "mtime", "size", "content")).select("file_id", "path", "mtime", "size", "cached")


_CJK_SQL = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


@query(
    "ocr_clean_spaces",
    # two passes, as matches can't overlap
    rf"SELECT DISTINCT path, regexp_replace(regexp_replace(content, '({_CJK_SQL}) ({_CJK_SQL})', '\1\2', 'g'), '({_CJK_SQL}) ({_CJK_SQL})', '\1\2', 'g') AS cleaned FROM ocr_processed WHERE content IS NOT NULL",
)
def ocr_clean_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_processed").where(F.col("content").isNotNull()).select("path", X.clean_cjk_spaces(F.col("content")).alias("cleaned")).distinct()


@query("display_path", r"SELECT DISTINCT path, CASE WHEN starts_with(path, '\\?\UNC\') THEN '\\' || substr(path, 9) WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END AS shown FROM disk_listing")
def display_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "disk_listing").select("path", paths.display_path(F.col("path")).alias("shown")).distinct()


@query(
    "name_and_ext",
    r"SELECT DISTINCT path, regexp_extract(path, '([^/\\]*)$', 1) AS file_name, lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '^.+\.([^.]+)$', 1)) AS extension FROM indexed_files",
)
def name_and_ext(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").select("path", paths.file_name(F.col("path")).alias("file_name"), paths.extension(F.col("path")).alias("extension")).distinct()


@query(
    "kind_of",
    f"SELECT ext, CASE WHEN lower(ext) = 'pdf' THEN 'pdf' WHEN lower(ext) IN ({_list(paths.IMAGE_EXTS)}) THEN 'image' WHEN lower(ext) IN ({_list(paths.KIND_CODE_EXTS)}) THEN 'code' WHEN lower(ext) IN ({_list(paths.KIND_DOC_EXTS)}) THEN 'doc' ELSE 'file' END AS kind, count(*) AS n FROM documents GROUP BY ALL",
)
def kind_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("ext").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", paths.kind_of(F.col("ext")))


@query("human_bytes", "SELECT DISTINCT size, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE printf('%d B', size) END AS shown FROM indexed_files WHERE size < 1073741824")
def human_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").where("size < 1073741824").select("size", X.human_bytes(F.col("size")).alias("shown")).distinct()


@query(
    "human_bytes_all",
    "SELECT DISTINCT size, CASE WHEN size IS NULL THEN NULL WHEN size >= 1099511627776 THEN printf('%.1f TB', size / 1099511627776.0) WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824.0) WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE printf('%d B', size) END AS shown FROM indexed_files",
)
def human_bytes_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").select("size", X.human_bytes(F.col("size")).alias("shown")).distinct()


@query("middle_ellipsis", "SELECT DISTINCT path, CASE WHEN length(path) <= 24 THEN path ELSE left(path, 14) || '…' || right(path, 9) END AS shown FROM indexed_files")
def middle_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").select("path", paths.middle_ellipsis(F.col("path"), 24).alias("shown")).distinct()


@query("format_count", "SELECT l_orderkey, format('{:,}', l_orderkey) AS shown FROM lineitem GROUP BY l_orderkey")
def format_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", X.format_count(F.col("l_orderkey")).alias("shown")).distinct()


@query(
    "merge_ranges",
    """WITH r AS (SELECT o_custkey AS k, CAST(o_orderkey % 97 AS INTEGER) AS s, CAST(o_orderkey % 97 + 1 + o_orderkey % 7 AS INTEGER) AS e FROM orders),
m AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT k, s, e, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS i FROM m)
SELECT k, min(s) AS range_start, max(e) AS range_end FROM g GROUP BY k, i""",
)
def merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("o_orderkey") % 97).cast("int")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.struct(start.alias("start"), (start + 1 + (F.col("o_orderkey") % 7)).cast("int").alias("end")).alias("r"))
    merged = rows.groupBy("k").agg(F.collect_list("r").alias("rs")).select("k", F.explode(X.merge_ranges(F.col("rs"))).alias("x"))
    return merged.select("k", F.col("x.start").alias("range_start"), F.col("x.end").alias("range_end"))


@query("recent_history", "SELECT q, searched AS \"at\" FROM (SELECT trim(o_orderpriority || ' ' || o_orderstatus) AS q, max(o_orderdate) AS searched FROM orders GROUP BY 1) ORDER BY searched DESC, q LIMIT 10")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return C.recent_searches(table(spark, d, "orders").select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("q"), F.col("o_orderdate").alias("at")))


@query(
    "rename_pairing",
    """WITH r AS (SELECT volume, frn, usn, bool_or(coalesce(reason.rename_old_name, false)) AS old, bool_or(coalesce(reason.rename_new_name, false)) AS new, max(name) AS name
  FROM usn_journal WHERE usn IS NOT NULL AND frn IS NOT NULL AND (coalesce(reason.rename_old_name, false) OR coalesce(reason.rename_new_name, false)) GROUP BY volume, frn, usn),
n AS (SELECT volume, frn, usn AS old_usn, lead(usn) OVER w AS new_usn, name AS old_name, lead(name) OVER w AS new_name, old, new, lead(new) OVER w AS is_new FROM r WINDOW w AS (PARTITION BY volume, frn ORDER BY usn))
SELECT volume, frn, old_usn, new_usn, old_name, new_name FROM n WHERE old AND NOT new AND is_new""",
)
def rename_pairing(spark: SparkSession, d: str) -> DataFrame:
    return journal.rename_pairs(table(spark, d, "usn_journal").select("volume", "frn", "usn", "name", "reason"))


@query(
    "cursor_validity",
    "SELECT DISTINCT c.volume, c.journal_id, c.next_usn, coalesce(c.next_usn >= j.lowest, false) AS usable FROM usn_cursors c LEFT JOIN (SELECT volume, journal_id, min(usn) AS lowest FROM usn_journal WHERE usn IS NOT NULL GROUP BY ALL) j USING (volume, journal_id)",
)
def cursor_validity(spark: SparkSession, d: str) -> DataFrame:
    lowest = table(spark, d, "usn_journal").where("usn IS NOT NULL").groupBy("volume", "journal_id").agg(F.min("usn").alias("lowest"))
    cursors = table(spark, d, "usn_cursors").select("volume", "journal_id", "next_usn").distinct()
    joined = cursors.join(lowest, ["volume", "journal_id"], "left")
    usable = ledger.usable(F.col("next_usn"), F.col("journal_id"), F.when(F.col("lowest").isNotNull(), F.col("journal_id")), F.col("lowest"))
    return joined.select("volume", "journal_id", "next_usn", usable.alias("usable"))


REGISTRY |= {
    "p1_found": (ledger.p1_found, ledger.P1_SQL),
    "p1_ledger": (ledger.p1_ledger, ledger.P1_LEDGER_SQL),
    "p4_found": (replay.p4_found, replay.P4_SQL),
    "p4_open": (replay.p4_open, replay.P4_OPEN_SQL),
    "p4_watermarks": (replay.p4_watermarks, replay.P4_WATERMARKS_SQL),
    "p7_found": (hierarchy.p7_found, hierarchy.P7_SQL),
    "p7_descendants": (hierarchy.p7_descendants, hierarchy.P7_DESCENDANTS_SQL),
    "p7_intervals": (hierarchy.p7_intervals, None),
    "p7_descendant_pairs": (hierarchy.p7_descendant_pairs, hierarchy.P7_DESCENDANT_PAIRS_SQL),
}

import loam.queries_more  # noqa: E402, F401
