"""Index segments: files, their inverted index and the lexicon, written once and never changed.

A segment is a folder with

* ``files``: the rows with ``doc``, a number that is unique in the segment;
* ``postings``: a shard for each partition of the files, one row a term, field and part, where a part is up to PART files read together:
  the files' places in the part, how often the term stands in each and where. A shard is sorted by term, so a query reads the pages of its
  terms. The row without a term has each part's file numbers, paths, lengths, times, sizes and extensions. A shard holds all that is known of its
  files, so a query needs no shuffle: each task evaluates its shards;
* ``lexicon``: in how many files each term stands, and in which 64ths of the shards, in small files by a hash of the term, which the driver
  reads without a job.

Places and positions are kept as gaps. A term with a third of all postings is a row a part, spread over all shards.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.folder import Folder
from loam.functions.text import tokens

#: Files of one part at most, and bytes of their tokens: what one row of a very frequent term, and one step of a query, may take.
PART, PART_BYTES = 4096, 32 << 20
#: Bytes of text for each bucket of terms, and how many buckets there are at least and at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 8192
#: Groups of shards that the lexicon tells apart: the bits of a number.
GROUPS = 64
FIELDS = ("name", "content", "path")
ROW = (
    "term string, field string, part long, n int, cf long, docs array<int>, tfs array<int>, positions array<int>, "
    "ids array<long>, names array<int>, mtimes array<long>, sizes array<long>, exts array<string>, kinds array<string>, paths array<string>"
)
_LISTS = {"docs": pa.int32(), "tfs": pa.int32(), "positions": pa.int32(), "ids": pa.int64(), "names": pa.int32(), "mtimes": pa.int64(), "sizes": pa.int64(), "exts": pa.string(), "kinds": pa.string(), "paths": pa.string()}


@dataclass(frozen=True)
class Segment:
    """A written segment: its folder, files, total lengths by field, and numbers of lexicon buckets and of shards."""

    root: str
    n: int
    name: int
    content: int
    buckets: int
    shards: int

    def as_dict(self) -> dict:
        return asdict(self)


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rising values as gaps within each run that begins at one of ``starts``."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    offsets = np.append(starts, len(values)).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype("int32")))


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    size = len(columns["term"])
    arrays = [columns["term"], columns["field"], columns["part"], columns["n"], columns["cf"]]
    arrays += [columns[k] if k in columns else pa.nulls(size, pa.list_(t)) for k, t in _LISTS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ROW.split(", ")])


def part_rows(part: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The posting rows of one part, from columns doc, path, mtime, size, ext, kind and t_<field> of its files. No token is touched in Python."""
    files, lengths = batch.num_rows, {}
    for f in FIELDS:
        column = batch.column(f"t_{f}")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        lengths[f] = sizes
        coded = column.flatten().dictionary_encode()
        if not len(coded):
            continue
        codes = coded.indices.to_numpy()
        row = np.repeat(np.arange(files), sizes)
        position = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(codes, kind="stable")  # tokens stand in order of file and position, and stay so within a term
        codes, row, position = codes[order], row[order], position[order]
        begins = np.flatnonzero(np.diff(codes * np.int64(files) + row, prepend=-1))  # of each posting
        terms = np.flatnonzero(np.diff(codes[begins], prepend=-1))  # of each term among the postings
        tfs = np.diff(np.append(begins, len(codes)))
        first = begins[terms]
        yield _batch({
            "term": coded.dictionary.take(pa.array(codes[first])), "field": pa.array([f] * len(terms)), "part": pa.array(np.full(len(terms), part)),
            "n": pa.array(np.diff(np.append(terms, len(begins))).astype("int32")), "cf": pa.array(np.diff(np.append(first, len(codes)))),
            "docs": _lists(_gaps(row[begins], terms), terms), "tfs": _lists(tfs, terms), "positions": _lists(_gaps(position, begins), first),
        })
    whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, files], pa.int32()), pa.array(values, kind))
    of = lambda name: batch.column(name)
    yield _batch({
        "term": pa.array([""]), "field": pa.array([""]), "part": pa.array([part]), "n": pa.array([files], pa.int32()), "cf": pa.array([int(lengths["content"].sum())]),
        "ids": whole(of("doc"), pa.int64()), "tfs": whole(lengths["content"], pa.int32()), "names": whole(lengths["name"], pa.int32()),
        "mtimes": whole(of("mtime"), pa.int64()), "sizes": whole(of("size"), pa.int64()), "exts": whole(of("ext"), pa.string()), "kinds": whole(of("kind"), pa.string()), "paths": whole(of("path"), pa.string()),
    })


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a task's rows to parts, numbered by task and order."""
    part = TaskContext.get().partitionId() << 32
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            size = min(PART, batch.num_rows - at)
            while size > 1 and batch.slice(at, size).nbytes > PART_BYTES:
                size = (size + 1) // 2
            yield from part_rows(part, batch.slice(at, size))
            part, at = part + 1, at + size


def build(files: DataFrame, root: str) -> Segment:
    """Writes a segment of index rows (path, name, ext, content, mtime, size, kind and any others) and returns it.

    Rows are sorted by path within their partitions, and each partition becomes a shard. Texts and postings don't move between tasks; only the
    lexicon's counts are shuffled.
    """
    spark = files.sparkSession
    files.sortWithinPartitions("path").withColumn("doc", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/files")
    stored = spark.read.parquet(f"{root}/files")
    toks = stored.select("doc", "path", "mtime", "size", "ext", "kind", *[tokens(F.col(f)).alias(f"t_{f}") for f in FIELDS])
    shards = max(1, stored.rdd.getNumPartitions())
    rows = toks.mapInArrow(_parts, ROW).sortWithinPartitions("term", "field", "part")
    # one row group a file, so that no shard is read by two tasks
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": 6, "parquet.writer.version": "v2", "parquet.page.size": 1 << 16, "parquet.block.size": 1 << 29}
    rows.write.mode("overwrite").options(**options).parquet(f"{root}/postings")
    posted = spark.read.schema(ROW).parquet(f"{root}/postings")
    text = stored.agg(F.sum(F.octet_length("content"))).first()[0]
    buckets = int(min(MOST_BUCKETS, max(LEAST_BUCKETS, (text or 0) // BUCKET_BYTES)))
    counts = posted.groupBy("term", "field").agg(F.sum("n").cast("long").alias("df"), F.bit_or(F.expr(f"shiftleft(1L, CAST(floor(shiftright(part, 32) * {GROUPS} / {shards}) AS INT))")).alias("mask"))
    counts = counts.where("term <> ''").withColumn("bucket", (F.crc32("term") % buckets).cast("int"))
    counts.repartition(max(1, buckets // 4), "bucket").sortWithinPartitions("bucket", "term", "field").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/lexicon")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    total = posted.where("term = ''").agg(F.sum("n"), F.sum(add(F.col("names"))), F.sum("cf")).first()
    return Segment(root, total[0] or 0, total[1] or 0, total[2] or 0, buckets, shards)


class Reader:
    """A segment's tables, whose files are listed once."""

    def __init__(self, spark: SparkSession, segment: Segment):
        self.spark, self.segment, self.folder = spark, segment, Folder(spark, segment.root)
        self.known: dict[tuple, DataFrame] = {}

    def files(self) -> DataFrame:
        if () not in self.known:
            self.known[()] = self.spark.read.parquet(f"{self.segment.root}/files")
        return self.known[()]

    def postings(self, mask: int = -1) -> DataFrame:
        """The shards of the groups whose bits are set."""
        groups = tuple(g for g in range(GROUPS) if mask >> g & 1)
        if groups not in self.known:
            names = [n for n in self.folder.names("postings") if n.startswith("part-")]
            mine = [f"{self.segment.root}/postings/{n}" for n in names if int(n.split("-")[1]) * GROUPS // self.segment.shards in groups]
            self.known[groups] = self.spark.read.schema(ROW).parquet(*mine) if mine else self.spark.createDataFrame([], ROW)
        return self.known[groups]

    def parts(self) -> DataFrame:
        """The rows without a term: what is known of each part's files."""
        return self.postings().where("term = ''")


class Lexicon:
    """Document frequencies by (field, term) of one segment, read by the driver from the buckets that a query needs and remembered."""

    REMEMBERED = 20_000

    def __init__(self, reader: Reader):
        self.segment, self.folder = reader.segment, reader.folder
        self.known: dict[str, dict[str, tuple[int, int]]] = {}

    def look_up(self, terms: list[str]) -> dict[tuple[str, str], tuple[int, int]]:
        """(files, bits of the groups of shards) by field and term, for what the segment has."""
        missing = [t for t in dict.fromkeys(terms) if t not in self.known]
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
            missing = list(dict.fromkeys(terms))
        for bucket in {bucket_of(t, self.segment.buckets) for t in missing}:
            mine = [t for t in missing if bucket_of(t, self.segment.buckets) == bucket]
            self.known.update({t: {} for t in mine})
            part = f"lexicon/bucket={bucket}"
            for name in self.folder.names(part):
                if name.endswith(".parquet"):
                    found = pq.read_table(io.BytesIO(self.folder.read(f"{part}/{name}")), columns=["term", "field", "df", "mask"], filters=[("term", "in", mine)])
                    for t, f, n, mask in zip(*(c.to_pylist() for c in found.columns)):
                        self.known[t][f] = n, mask % (1 << GROUPS)
        return {(f, t): known for t in terms for f, known in self.known[t].items()}


def size_on_disk(spark: SparkSession, segment: Segment, part: str) -> int:
    folder = Folder(spark, segment.root)
    return folder.fs.getContentSummary(folder.path(part)).getLength() if folder.exists(part) else 0


def document_frequencies(reader: Reader, field: str) -> DataFrame:
    """(term, df, cf): in how many files each term stands and how often in all."""
    rows = reader.postings().where((F.col("term") != "") & (F.col("field") == field))
    return rows.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("cf").alias("cf"))


def postings_of(reader: Reader, field: str, key: str) -> DataFrame:
    """(term, key, tf, first_pos, last_pos) of a field, a row for each term of each file: the index unpacked, for inspection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            numbers = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype("int64")  # noqa: E731, B023
            for i, term in enumerate(batch.column("term").to_pylist()):
                docs, tfs, gaps = np.cumsum(numbers("docs", i)), numbers("tfs", i), numbers("positions", i)
                starts = np.cumsum(tfs) - tfs
                sums = np.cumsum(gaps)
                before = np.where(starts > 0, sums[starts - 1], 0)
                for column, values in zip(out, ([term] * len(docs), np.full(len(docs), batch.column("part")[i].as_py()), docs, tfs, gaps[starts], sums[starts + tfs - 1] - before)):
                    column.append(np.asarray(values))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)], names=["term", "part", "place", "tf", "first_pos", "last_pos"])

    rows = reader.postings().where((F.col("term") != "") & (F.col("field") == field)).select("term", "part", "docs", "tfs", "positions")
    flat = rows.mapInArrow(run, "term string, part long, place long, tf long, first_pos long, last_pos long")
    places = reader.parts().select("part", F.posexplode("ids").alias("place", "doc")).withColumn("place", F.col("place").cast("long"))
    return flat.join(places, ["part", "place"]).join(reader.files().select("doc", key), "doc").select("term", key, "tf", "first_pos", "last_pos")
