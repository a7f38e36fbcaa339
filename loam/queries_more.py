"""More of the core's queries: display functions, snippets, index maintenance, image queue, journals. Added to the registry of ``queries``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import paths, snippet
from loam.functions import text as X
from loam.operators import changes as C
from loam.operators import journal, ledger
from loam.operators.ledger import latest
from loam.plans import search as S
from loam.plans import segment
from loam.plans.searcher import Searcher
from loam.queries import _LATEST, FILES, TOKENS, _list, has, index_of, query, rows_of, stored_and_listed
from loam.session import Scratch, table
from loam.sources.extract import scan
from loam.sources.images import ImageQueue
from loam.sources.store import Store

_IMAGES = _list(paths.IMAGE_EXTS)


# Extension groups and phrases over tables in which they have hits of their own


def indexed_as_files(spark: SparkSession, d: str) -> DataFrame:
    """The indexed files, the latest row of each, in the shape of the index."""
    rows = table(spark, d, "indexed_files").where(F.col("file_id").isNotNull())
    top = F.max(F.struct("indexed_at", "mtime", "size", "path", "name", "ext", "content"))
    r = rows.groupBy("file_id").agg(top.alias("t")).select("file_id", "t.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when(F.lower("ext").isin(*paths.IMAGE_EXTS), "image").otherwise("text")
    return r.select("file_id", text("path").alias("path"), text("name").alias("name"), F.lower(text("ext")).alias("ext"), text("content").alias("content"), F.coalesce("mtime", F.lit(0)).alias("mtime"), F.coalesce("size", F.lit(0)).alias("size"), kind.alias("kind"))


def files_index(spark: SparkSession, d: str) -> Searcher:
    made = spark.sparkContext.__dict__.setdefault("_loam_file_indexes", {})
    if d not in made:
        made[d] = Searcher(spark, [segment.build(indexed_as_files(spark, d), f"{Scratch(spark, 'index').root}/files")])
    return made[d]


_TOKEN = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|(?:[^\P{L}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|\p{N}|[\x{093E}-\x{094C}])+)"
_INDEXED = f"""i AS (SELECT file_id, coalesce(path, '') AS path, coalesce(name, '') AS name, lower(coalesce(ext, '')) AS ext, coalesce(content, '') AS content FROM indexed_files WHERE file_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC, mtime DESC, size DESC, path DESC, name DESC, ext DESC, content DESC) = 1),
hay AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(content), '{_TOKEN}'), ' ') || ' ' AS c, ' ' || array_to_string(regexp_extract_all(lower(name), '{_TOKEN}'), ' ') || ' ' AS n FROM i)"""


def file_query(name: str, text: str, condition: str, group: str | None = None) -> None:
    exts = paths.ext_group(group) if group else None

    def run(spark: SparkSession, d: str) -> DataFrame:
        return files_index(spark, d).hits(text, exts, ("file_id", "path"))

    limited = f"({condition}) AND ext IN ({_list(exts)})" if exts else condition
    query(name, f"WITH {_INDEXED} SELECT file_id, path FROM hay WHERE {limited}")(run)


file_query("ext_group_code_files", "the OR return OR die OR if", " OR ".join(has(t) for t in ("the", "return", "die", "if")), "code")
file_query("ext_group_image_files", "png OR jpg OR jpeg OR webp OR bmp", " OR ".join(has(t) for t in paths.IMAGE_EXTS), "image")
file_query("ext_group_doc_files", "the OR 的 OR die", " OR ".join(has(t) for t in ("the", "的", "die")), "doc")
file_query("phrase_three_words", '"the recipe card"', has("the recipe card"))
file_query("phrase_or_word", '"in the second pass" OR wiring', f"{has('in the second pass')} OR {has('wiring')}")
file_query("phrase_and_not_phrase", 'the -"the office manager"', f"{has('the')} AND NOT {has('the office manager')}")
file_query("kind_field", "kind:image", f"ext IN ({_IMAGES})")
file_query("content_field", "content:recipe", "contains(c, ' recipe ')")


@query("exact_path", f"WITH {FILES} SELECT path, size FROM files WHERE path = (SELECT min(path) FROM files WHERE content <> '' AND path <> '')")
def exact_path(spark: SparkSession, d: str) -> DataFrame:
    files = index_of(spark, d).files()
    first = files.where("content <> '' AND path <> ''").agg(F.min("path")).first()[0]
    return files.where(F.col("path") == first).select("path", "size")


@query("snapshot_of_root", "SELECT DISTINCT path, mtime, size FROM indexed_files WHERE path = 'C:\\work' OR starts_with(path, 'C:\\work\\')")
def snapshot_of_root(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").where(paths.under(F.col("path"), "C:\\work")).select("path", "mtime", "size").distinct()


@query("nested_roots", "SELECT a.root_path AS outer_root, b.root_path AS inner_root FROM frn_roots a JOIN frn_roots b ON a.root_path <> b.root_path AND (starts_with(b.root_path, rtrim(a.root_path, '\\') || '\\')) GROUP BY ALL")
def nested_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = sorted({r.root_path for r in table(spark, d, "frn_roots").select("root_path").collect()})  # registered roots, a fixed few
    return spark.createDataFrame(C.nested_roots(roots), "outer_root string, inner_root string")


# Display


@query("dual_form", rf"""WITH t AS (SELECT DISTINCT path, regexp_replace(content, '^\s+|\s+$', '', 'g') AS raw FROM ocr_processed WHERE content IS NOT NULL),
u AS (SELECT path, raw, regexp_replace(regexp_replace(raw, '([\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]) ([\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}])', '\1\2', 'g'), '([\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]) ([\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}])', '\1\2', 'g') AS clean FROM t)
SELECT path, CASE WHEN raw = '' THEN '' WHEN raw = clean THEN raw ELSE raw || chr(10) || clean END AS content FROM u""")
def dual_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_processed").where(F.col("content").isNotNull()).select("path", X.dual_form(F.col("content")).alias("content")).distinct()


@query("human_ago", "SELECT DISTINCT o_orderkey AS age, CASE WHEN o_orderkey < 60 THEN printf('%d s ago', o_orderkey) WHEN o_orderkey < 3600 THEN printf('%d min ago', o_orderkey // 60) WHEN o_orderkey < 86400 THEN printf('%d h ago', o_orderkey // 3600) ELSE printf('%d d ago', o_orderkey // 86400) END AS shown FROM orders")
def human_ago(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("age"), X.human_ago(F.col("o_orderkey")).alias("shown")).distinct()


@query("clean_extensions", "SELECT DISTINCT source, list_filter(list_transform(string_split(source || ' , MD,, .txt ', ','), lambda x: lower(trim(x))), lambda x: x <> '') AS exts FROM documents WHERE source IS NOT NULL")
def clean_extensions(spark: SparkSession, d: str) -> DataFrame:
    from loam.api import clean_exts

    @F.pandas_udf("array<string>")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean_exts)

    return table(spark, d, "documents").where(F.col("source").isNotNull()).select("source").distinct().select("source", cleaned(F.concat("source", F.lit(" , MD,, .txt "))).alias("exts"))


_MARK = "((?:md|in|or)+)"


@query("highlight_names", f"SELECT DISTINCT name, regexp_replace(name, '{_MARK}', '«\\1»', 'gi') AS shown FROM indexed_files WHERE name IS NOT NULL")
def highlight_names(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def shown(names: pd.Series) -> pd.Series:
        return names.map(lambda n: snippet.wrap(n, snippet.highlight_name(n, ["md", "IN", '"or"'])))

    return table(spark, d, "indexed_files").where(F.col("name").isNotNull()).select("name").distinct().select("name", shown("name").alias("shown"))


@query("name_segments", f"SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '{_MARK}')) AS part FROM indexed_files WHERE name IS NOT NULL")
def name_segments(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def parts(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [t.lower() for t, hit in snippet.segments(n, snippet.highlight_name(n, ["md", "in", "or"])) if hit])

    return table(spark, d, "indexed_files").where(F.col("name").isNotNull()).select("name").distinct().select("name", F.explode(parts("name")).alias("part")).distinct()


#: A small dictionary for segmenting.
_WORDS = ("会议纪要", "会议", "采购清单", "清单", "读书笔记", "笔记", "文件列表", "文件", "排序阶段", "报销单")


@query("cjk_segments", f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '({'|'.join(sorted(_WORDS, key=lambda w: (-len(w), w)))}|{_TOKEN[1:]}')) AS term FROM documents WHERE text IS NOT NULL) SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) > 1 AND regexp_matches(term, '[\\x{{4E00}}-\\x{{9FFF}}]') GROUP BY ALL")
def cjk_segments(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary's words in each document, and how often they stand there as segments of their own."""
    terms = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(X.segmented(F.col("text"), list(_WORDS))).alias("term"))
    return terms.where((F.length("term") > 1) & F.col("term").rlike(r"[\x{4E00}-\x{9FFF}]")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


# Snippets and previews


@query("snippet_fallback", "SELECT doc_id, left(text, 160) AS snippet FROM documents WHERE text IS NOT NULL")
def snippet_fallback(spark: SparkSession, d: str) -> DataFrame:
    cut = snippet.snippet_column(F.col("text"), {"zzmissing": 1.0})
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", cut.alias("cut")).select("doc_id", F.col("cut.text").alias("snippet"))


@query("snippet_hits", f"WITH {TOKENS} SELECT doc_id, 'recipe' AS hit, true AS short_enough FROM hay WHERE contains(c, ' recipe ')")
def snippet_hits(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words that snippets mark by their byte ranges, and whether each snippet keeps to its length."""

    @F.pandas_udf("array<string>")
    def marked(cuts: pd.DataFrame) -> pd.Series:
        return pd.Series([sorted({t.encode()[r["start"] : r["end"]].decode().lower() for r in ranges}) for t, ranges in zip(cuts["text"], cuts["ranges"])])

    rows = index_of(spark, d).hits("content:recipe", columns=("doc_id", "content"))
    cut = snippet.snippet_column(F.col("content"), {"recipe": 1.0}).alias("cut")
    return rows.select("doc_id", cut).select("doc_id", F.explode(marked("cut")).alias("hit"), (F.length("cut.text") <= snippet.SNIPPET).alias("short_enough"))


@query("preview_heads", f"WITH {TOKENS} SELECT doc_id, left(content, 1500) AS preview FROM hay WHERE NOT contains(c, ' recipe ')")
def preview_heads(spark: SparkSession, d: str) -> DataFrame:
    rows = index_of(spark, d).hits("-content:recipe", columns=("doc_id", "content"))
    cut = snippet.snippet_column(F.col("content"), {"recipe": 1.0}, snippet.PREVIEW).alias("cut")
    return rows.select("doc_id", cut).select("doc_id", F.col("cut.text").alias("preview"))


# The index under changes


def changed_store(spark: SparkSession, d: str) -> Store:
    """An index of the stored files, to which one batch is applied: a tree goes, a tree comes from the listing, and one file of the listing is new."""
    made = spark.sparkContext.__dict__.setdefault("_loam_stores", {})
    if d not in made:
        store = Store(spark, f"{Scratch(spark, 'store').root}/index")
        stored, listed = stored_and_listed(spark, d)
        shape = lambda df: df.select("path", paths.file_name(F.col("path")).alias("name"), paths.extension(F.col("path")).alias("ext"), F.concat(F.lit("body of "), F.col("path")).alias("content"), F.coalesce("mtime", F.lit(0)).alias("mtime"), F.coalesce("size", F.lit(0)).alias("size"), F.lit("text").alias("kind"))
        store.replace(shape(stored), roots=["C:\\work", "E:"])
        ops = spark.createDataFrame([("C:\\work\\notes", "remove_tree"), ("E:", "upsert_tree"), ("Z:\\nowhere", "upsert")], "path string, op string")
        store.apply(ops, shape(C.rows_for(listed, ops)))
        made[d] = store
    return made[d]


_CHANGED = rf"""{_LATEST}, gone AS (SELECT path FROM i WHERE path = 'C:\work\notes' OR starts_with(path, 'C:\work\notes\') OR starts_with(path, 'E:\')),
fresh AS (SELECT path, mtime, size FROM l WHERE starts_with(path, 'E:\')),
after AS (SELECT path, mtime, size FROM i WHERE path NOT IN (SELECT path FROM gone) UNION ALL SELECT path, mtime, size FROM fresh)"""


@query("store_files", f"WITH {_CHANGED} SELECT path, coalesce(mtime, 0) AS mtime, coalesce(size, 0) AS size FROM after")
def store_files(spark: SparkSession, d: str) -> DataFrame:
    return changed_store(spark, d).files().select("path", "mtime", "size")


@query("store_outcome", f"WITH {_CHANGED} SELECT (SELECT count(*) FROM fresh) AS upserted, (SELECT count(*) FROM gone WHERE path NOT IN (SELECT path FROM fresh)) AS removed, CAST(1 AS BIGINT) AS skipped")
def store_outcome(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, [changed_store(spark, d).outcome()], "upserted long, removed long, skipped long")


@query("store_status", f"WITH {_CHANGED} SELECT (SELECT count(*) FROM after) AS documents, (SELECT count(*) FROM after WHERE path = 'C:\\work' OR starts_with(path, 'C:\\work\\')) AS below_work")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    from loam.manage import Index

    index = Index(spark, changed_store(spark, d).root)
    status = index.status()
    return rows_of(spark, [{"documents": status["documents"], "below_work": status["roots"]["C:\\work"]}], "documents long, below_work long")


@query("store_search", f"WITH {_CHANGED} SELECT path FROM after WHERE list_contains(string_split_regex(lower(path), '[^\\p{{L}}\\p{{N}}]+'), 'e')")
def store_search(spark: SparkSession, d: str) -> DataFrame:
    return changed_store(spark, d).searcher().hits("path:e")


@query("store_search_weights", f"WITH {_CHANGED}, w AS (SELECT path, string_split_regex(trim(regexp_replace(lower('body of ' || path), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS t FROM after WHERE regexp_full_match(path, '[\\x00-\\x7f]*')), s AS (SELECT count(*) FILTER (WHERE list_contains(string_split_regex(lower(path), '[^\\p{{L}}\\p{{N}}]+'), 'notes')) AS df FROM after) SELECT (SELECT count(*) FROM after) AS n, (SELECT df FROM s) AS df")
def store_search_weights(spark: SparkSession, d: str) -> DataFrame:
    """The corpus size and a document frequency that ranking uses after deletions."""
    stats = changed_store(spark, d).searcher().stats(["notes"], ("content",))
    return rows_of(spark, [{"n": stats.n, "df": stats.df.get(("content", "notes"), 0)}], "n long, df long")


_OPS = "CASE event_type WHEN 'view' THEN 'upsert' WHEN 'click' THEN 'upsert' WHEN 'purchase' THEN 'upsert_tree' WHEN 'error' THEN 'remove' ELSE 'remove_tree' END"


@query("drain_order", f"WITH e AS (SELECT user_id % 50 AS batch, CAST(user_id AS VARCHAR) AS path, arg_max({_OPS}, event_id) AS op FROM events GROUP BY ALL) SELECT batch, path, op, row_number() OVER (PARTITION BY batch ORDER BY path) AS position FROM e")
def drain_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("batch"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.expr(_OPS).alias("op"))
    return C.drained(C.coalesce(rows, "batch"), "batch")


@query("requeue_failed", f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id, {_OPS} AS op FROM events), old AS (SELECT path, arg_max(op, event_id) AS op FROM e WHERE event_id % 2 = 0 GROUP BY path), new AS (SELECT path, arg_max(op, event_id) AS op FROM e WHERE event_id % 3 = 0 GROUP BY path) SELECT path, op FROM new UNION ALL SELECT path, op FROM old WHERE path NOT IN (SELECT path FROM new)")
def requeue_failed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.expr(_OPS).alias("op"))
    return C.requeued(C.coalesce(rows.where("seq % 3 = 0")), C.coalesce(rows.where("seq % 2 = 0")))


_KINDS = "CASE event_type WHEN 'view' THEN 'Create' WHEN 'click' THEN 'rename_from' WHEN 'purchase' THEN 'any' WHEN 'error' THEN 'remove_file' ELSE 'remove_dir' END"


@query("translate_events", f"""WITH e AS (SELECT event_id, {_KINDS} AS k, user_id % 2 = 0 AS d, user_id % 3 = 0 AS x FROM events)
SELECT event_id, CASE k WHEN 'Create' THEN CASE WHEN d THEN 'upsert_tree' ELSE 'upsert' END WHEN 'remove_file' THEN 'remove' WHEN 'remove_dir' THEN 'remove_tree' WHEN 'rename_from' THEN CASE WHEN d THEN 'remove_tree' ELSE 'remove' END
WHEN 'any' THEN CASE WHEN x THEN CASE WHEN d THEN 'upsert_tree' ELSE 'upsert' END ELSE 'remove_tree' END END AS op FROM e""")
def translate_events(spark: SparkSession, d: str) -> DataFrame:
    op = C.translate(F.expr(_KINDS), F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0)
    return table(spark, d, "events").select("event_id", op.alias("op"))


# Images


def image_queue(spark: SparkSession, d: str) -> ImageQueue:
    """The images of the listing against what was recognised before, once a batch of a third of the waiting ones is done."""
    made = spark.sparkContext.__dict__.setdefault("_loam_queues", {})
    if d not in made:
        queue = ImageQueue(spark, f"{Scratch(spark, 'images').root}/queue")
        done = latest(table(spark, d, "ocr_processed"), "path", "processed_at", "mtime", "size", "content")
        queue.done(done.where(F.col("mtime").isNotNull() & F.col("size").isNotNull()).select("path", "mtime", "size", F.coalesce("content", F.lit("")).alias("content")))
        listed = latest(table(spark, d, "disk_listing").select(paths.strip_verbatim(F.col("path")).alias("path"), "mtime", "size", "seen_at"), "path", "seen_at", "mtime", "size")
        images = listed.withColumn("ext", paths.extension(F.col("path")))
        queue.enqueue(images)
        queue.done(queue.pending().where("crc32(path) % 3 = 0").withColumn("content", F.lit("")))
        made[d] = queue
    return made[d]


_QUEUE = rf"""l AS (SELECT * FROM (SELECT CASE WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END AS path, mtime, size, seen_at FROM disk_listing)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, mtime DESC, size DESC) = 1),
p AS (SELECT path, mtime, size FROM ocr_processed QUALIFY row_number() OVER (PARTITION BY path ORDER BY processed_at DESC, mtime DESC, size DESC, content DESC) = 1),
w AS (SELECT path, mtime, size FROM l WHERE regexp_matches(lower(path), '\.(png|jpg|jpeg|webp|bmp)$') AND size <= 20971520 AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = l.path AND p.mtime = l.mtime AND p.size = l.size))"""


@query("image_queue_total", f"WITH {_QUEUE} SELECT count(*) AS total FROM w")
def image_queue_total(spark: SparkSession, d: str) -> DataFrame:
    return rows_of(spark, [image_queue(spark, d).progress()], "total long")


@query("image_queue_pending", f"WITH {_QUEUE} SELECT path, mtime, size FROM w")
def image_queue_pending(spark: SparkSession, d: str) -> DataFrame:
    """What has waited: what still waits and what the one batch has done."""
    queue = image_queue(spark, d)
    return queue.pending().unionByName(queue.processed().where("crc32(path) % 3 = 0 AND content = ''").select("path", "mtime", "size").join(queued_paths(spark, d), ["path", "mtime", "size"], "left_semi"))


def queued_paths(spark: SparkSession, d: str) -> DataFrame:
    listed = latest(table(spark, d, "disk_listing").select(paths.strip_verbatim(F.col("path")).alias("path"), "mtime", "size", "seen_at"), "path", "seen_at", "mtime", "size")
    before = latest(table(spark, d, "ocr_processed"), "path", "processed_at", "mtime", "size", "content")
    return listed.join(before.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


@query("queue_compaction", r"SELECT DISTINCT i.path FROM indexed_files i WHERE lower(i.ext) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp') AND (starts_with(i.path, 'C:\') OR starts_with(i.path, 'D:\')) AND i.path IN (SELECT CASE WHEN starts_with(path, '\\?\') THEN substr(path, 5) ELSE path END FROM disk_listing)")
def queue_compaction(spark: SparkSession, d: str) -> DataFrame:
    waiting = table(spark, d, "indexed_files").where(F.lower("ext").isin(*paths.IMAGE_EXTS)).select("path").distinct()
    there = table(spark, d, "disk_listing").select(paths.strip_verbatim(F.col("path")).alias("path"))
    return C.compact_queue(waiting, ["C:", "D:"], there)


# Journals


@query("journal_decoded", "SELECT DISTINCT usn, frn, coalesce(parent_frn, 0) AS parent_frn, coalesce(name, '') AS name, coalesce(is_dir, false) AS is_dir, coalesce(reason.file_create, false) AS file_create, coalesce(reason.file_delete, false) AS file_delete, coalesce(reason.rename_old_name, false) AS rename_old_name, coalesce(reason.rename_new_name, false) AS rename_new_name FROM usn_journal WHERE usn IS NOT NULL AND frn IS NOT NULL")
def journal_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The journal written as binary records and decoded again."""
    rows = table(spark, d, "usn_journal").where("usn IS NOT NULL AND frn IS NOT NULL").select("usn", "frn", F.coalesce("parent_frn", F.lit(0)).alias("parent_frn"), "name", "is_dir", "reason.*").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record": [journal.encode(r) for r in batch.astype(object).where(batch.notna(), None).to_dict("records")]})

    return journal.decoded(rows.mapInPandas(run, "record binary")).distinct()


@query("safe_cursors", """WITH r AS (SELECT DISTINCT volume, journal_id, run_id, next_usn, run_status FROM usn_cursors),
o AS (SELECT *, min(CASE WHEN run_status = 'committed' THEN NULL ELSE run_id END) OVER (PARTITION BY volume, journal_id) AS first_open FROM r)
SELECT volume, journal_id, max(next_usn) FILTER (WHERE run_status = 'committed' AND (first_open IS NULL OR run_id < first_open)) AS safe FROM o GROUP BY volume, journal_id""")
def safe_cursors(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "usn_cursors").select("volume", "journal_id", "run_id", "next_usn", (F.col("run_status") == "committed").alias("done"))
    return ledger.safe_cursors(runs)


@query("bootstrap_decision", "SELECT DISTINCT c.volume, c.journal_id, c.next_usn, CASE WHEN c.next_usn >= j.lowest THEN 'replay' ELSE 'reconcile' END AS how FROM usn_cursors c LEFT JOIN (SELECT volume, journal_id, min(usn) AS lowest FROM usn_journal WHERE usn IS NOT NULL GROUP BY ALL) j USING (volume, journal_id)")
def bootstrap_decision(spark: SparkSession, d: str) -> DataFrame:
    lowest = table(spark, d, "usn_journal").where("usn IS NOT NULL").groupBy("volume", "journal_id").agg(F.min("usn").alias("lowest"))
    cursors = table(spark, d, "usn_cursors").select("volume", "journal_id", "next_usn").distinct().join(lowest, ["volume", "journal_id"], "left")
    usable = ledger.usable(F.col("next_usn"), F.col("journal_id"), F.when(F.col("lowest").isNotNull(), F.col("journal_id")), F.col("lowest"))
    return cursors.select("volume", "journal_id", "next_usn", F.when(usable, "replay").otherwise("reconcile").alias("how"))


@query("listed_files")
def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """What lies below the data directory itself, as the index lists a root."""
    return scan(spark, d).select("relative", "name", "ext", "size")
