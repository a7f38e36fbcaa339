"""Near-duplicate records with small edits: circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: the first scatters a record's shingles over D places, the second, shifted circularly by k, gives
coordinate k as the least value at the shifted places. Records that agree in all rows of a band are candidates; their shingle sets decide.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import BROADCAST_ROWS, Scratch, small_join, spread, table, within

#: A word: a CJK character, or a maximal run of other letters and digits.
WORDS = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")
#: Words whose hashes a worker remembers before it begins anew.
REMEMBERED = 500_000
#: Candidates of one bucket that are paired at once; larger buckets are compared block by block.
BUCKET = 64


@dataclass(frozen=True)
class Params:
    """words a shingle, least Jaccard similarity, bands and rows of a band, places (a power of two) and the seed of the permutations.

    80 bands of 6 rows find a pair of similarity 0.66 with probability 0.999 and one of 0.75 with 1 - 1e-6.
    """

    words: int = 5
    least: float = 0.8
    bands: int = 80
    rows: int = 6
    places: int = 1 << 20
    seed: int = 20_240_229


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _WordHashes()


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; none if it has fewer words than a shingle."""
    found = WORDS.findall(text.lower())
    n = len(found) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


class Circulant:
    """The two permutations and what follows from them."""

    def __init__(self, p: Params):
        rng = np.random.default_rng(p.seed)
        self.p, k = p, p.bands * p.rows
        self.first = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        self.shift = np.uint64(64 - (p.places.bit_length() - 1))
        second = rng.permutation(p.places).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)
        self.mix = rng.integers(1, 1 << 62, (p.bands, p.rows)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 1 << 62, p.bands).astype(np.uint64)

    def signature(self, shingle: np.ndarray) -> np.ndarray:
        at = ((shingle * self.first) >> self.shift).astype(np.int64)
        least = self.windows[at[:256]].min(axis=0)
        for i in range(256, len(at), 256):
            least = np.minimum(least, self.windows[at[i : i + 256]].min(axis=0))
        return least

    def bands(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit hash a band; those of different bands differ by their salts."""
        h = (signature.astype(np.uint64).reshape(self.p.bands, self.p.rows) * self.mix).sum(axis=1, dtype=np.uint64) + self.salt
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(30))).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def banded(texts: DataFrame, p: Params) -> DataFrame:
    """(band, code): a row for each band of each text, from (code, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(p)
        for batch in batches:
            codes, rows = [], []
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(s := shingles(text, p.words)):
                    codes.append(code)
                    rows.append(circulant.bands(circulant.signature(s)))
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(codes, np.int64), p.bands))], names=["band", "code"])

    return texts.mapInArrow(run, "band long, code long")


def verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The (a, b, similarity) of candidate pairs that reach the least similarity, by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for k, t in ((a, x), (b, y)):
                    if k not in known:
                        known[k] = shingles(t, p.words)
                if (s := jaccard(known[a], known[b])) >= p.least:
                    out.append((a, b, s))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    left = texts.select(F.col("code").alias("a"), F.col("content").alias("x"))
    right = texts.select(F.col("code").alias("b"), F.col("content").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def block_pairs(members: DataFrame, texts: DataFrame, p: Params, bucket: int) -> DataFrame:
    """(a, b, similarity) within large buckets, from (band, code, n): their members are dealt to blocks, and each pair of blocks is one small
    task that counts shared shingles through an index of one block. Only pairs that reach the similarity leave a task."""
    blocks = F.ceil(F.col("n") / bucket)
    mine = members.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("code"), F.col("blocks")))
    dealt = mine.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = dealt.select("band", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") <= F.col("j")).alias("low"), "code")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = {c: shingles(t, p.words) for c, t in zip(group["code"], group["content"])}
        within = group["lo"].iloc[0] == group["hi"].iloc[0]
        one = group["code"] if within else group.loc[group["low"], "code"]
        two = group["code"] if within else group.loc[~group["low"], "code"]
        holders = defaultdict(list)
        for c in one:
            for s in sets[c].tolist():
                holders[s].append(c)
        out = []
        for c in two:
            shared = Counter(h for s in sets[c].tolist() for h in holders.get(s, ()))
            for o, both in shared.items():
                s = both / (len(sets[c]) + len(sets[o]) - both)
                if s >= p.least and (c != o if not within else o < c):
                    out.append((min(o, c), max(o, c), s))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return keyed.join(texts, "code").groupBy("band", "lo", "hi").applyInPandas(run, "a long, b long, similarity double")


def buckets_of(bands: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """(band, codes, k) of the bands that several texts share, with up to ``most`` members and one more, and what tells those with more.

    Members are ranked, and ranks beyond the bound are dropped in each task before the shuffle, so a band that a third of all texts share
    brings a bounded number of rows from each task and to the one that puts it together. Nothing is lost: what is crowded is told apart.
    """
    order = W.partitionBy("band").orderBy("code")
    first = bands.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most + 1)
    shared = first.withColumn("before", F.lag("code").over(order)).withColumn("after", F.lead("code").over(order)).where("before IS NOT NULL OR after IS NOT NULL")
    return shared.groupBy("band").agg(F.collect_set("code").alias("codes"), F.max("k").alias("k")), F.col("k") > most


def crowds(bands: DataFrame, crowded: DataFrame) -> DataFrame:
    """(band, n, code) of all members of crowded bands; of bands with the same members only one is kept."""
    members = small_join(bands, crowded.select("band"), ["band"], "inner").distinct()
    marks = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("code").alias("x"), F.bit_xor(F.xxhash64("code")).alias("y"))
    kept = marks.groupBy("n", "x", "y").agg(F.min("band").alias("band")).where("n > 1").select("band", "n")
    return small_join(members, kept, ["band"], "inner").select("band", "n", "code")


def links(texts: DataFrame, p: Params, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b, similarity), a < b, of all different texts that reach the least similarity, from (code, content).

    Buckets of up to ``bucket`` texts give candidate pairs, which are made distinct and then verified; larger ones go through
    ``block_pairs``, so no bucket is cut short and none is one task. Contents travel only for texts that are candidates.
    """
    bands = banded(texts, p)
    shared, more = buckets_of(bands, bucket)
    shared = scratch.keep(shared.withColumn("crowded", more).drop("k"))
    pairs = shared.where(~F.col("crowded") & (F.size("codes") > 1)).select(F.explode("codes").alias("a"), "codes").select("a", F.explode("codes").alias("b")).where("a < b")
    pairs = scratch.keep(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("code"))
    crowded, large = shared.where("crowded").select("band"), None
    if not crowded.isEmpty():
        large = scratch.keep(crowds(bands, crowded))
        wanted = wanted.union(large.select("code"))
    wanted = wanted.distinct()
    wanted = F.broadcast(wanted) if within(wanted, BROADCAST_ROWS) else wanted
    chosen = scratch.keep(texts.join(wanted, "code", "left_semi").dropDuplicates(["code"]))
    found = verified(pairs, chosen, p)
    if large is not None:
        found = found.union(block_pairs(large, chosen, p, bucket)).dropDuplicates(["a", "b"])
    return found


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes of undirected edges (a, b): the least node of each connected component, by alternating stars.

    In a round each node links its greater neighbours to its least one, and then its lesser ones likewise, so distances shrink by about half. A
    node with a third of all edges is a partial aggregate and a join on its least neighbour.
    """
    now, mark = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = small_join(both.where("v > u"), least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = small_join(large, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        small = scratch.keep(small)
        after = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        scratch.drop(now)
        scratch.drop(large)
        now = small
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()


def coded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, content) of the rows, and the members (file_id, code): the code is a hash of the content.

    A file listed again with the same content is one member; of a file with several contents the latest counts (by ``indexed_at``).
    Rows without id or content, and empty contents, are left out. 64-bit codes of different texts would meet only by accident, and such
    a pair is then taken for copies; at 10^9 texts that chance is 3 %.
    """
    rows = files.where(F.col("file_id").isNotNull() & F.col("content").isNotNull() & (F.col("content") != ""))
    rows = rows.withColumn("code", F.xxhash64("content"))
    members = rows.groupBy("file_id").agg(F.max(F.struct("indexed_at", "code")).alias("_t")).select("file_id", F.col("_t.code").alias("code"))
    return rows.select("code", "content"), members


P2 = Params(words=3, least=0.6)


#: Copies of one text up to which all their pairs are listed; of more, each is paired with the first, which stands for them elsewhere.
EXPANDED = 100


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id_a, file_id_b): files whose contents share at least 60 % of their distinct three-word sequences.

    Copies belong to one text, and pairs of texts are expanded to pairs of files as the result's columns demand. A text with more than EXPANDED
    copies is shown by its least file id, and its copies by their pairs with that one, so that no group's pairs grow as its square;
    ``p2_classes`` has all memberships. Copies of texts too short for a sequence share none and are no pairs.
    """
    scratch = Scratch(spark, "neardup")
    texts, members = coded(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content", "indexed_at")))
    found = links(texts, P2, scratch).select("a", "b")
    members = scratch.keep(members)
    copied = scratch.keep(members.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first")).where("n > 1"))
    shown = small_join(members, copied.where(F.col("n") > EXPANDED).select("code", "first"), ["code"]).where("first IS NULL OR file_id = first")
    one, two = shown.select(F.col("file_id").alias("f"), F.col("code").alias("a")), shown.select(F.col("file_id").alias("g"), F.col("code").alias("b"))
    across = found.join(one, "a").join(two, "b").select("f", "g")
    enough = long_enough(texts.join(F.broadcast(copied) if within(copied, BROADCAST_ROWS) else copied, "code", "left_semi"), P2.words)
    groups = small_join(members, copied.join(enough, "code"), ["code"], "inner")
    few = groups.where(F.col("n") <= EXPANDED).select("code", "file_id")
    same = few.withColumnRenamed("file_id", "f").join(few.withColumnRenamed("file_id", "g"), "code").where("f < g").select("f", "g")
    many = groups.where((F.col("n") > EXPANDED) & (F.col("file_id") != F.col("first"))).select("first", "file_id")
    return across.union(same).union(many).select(F.least("f", "g").alias("file_id_a"), F.greatest("f", "g").alias("file_id_b")).distinct()


def long_enough(texts: DataFrame, words: int) -> DataFrame:
    """Distinct codes of texts that have at least one shingle."""
    cjk = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
    count = F.size(F.regexp_extract_all("content", F.lit(rf"([{cjk}]|[\p{{L}}\p{{N}}&&[^{cjk}]]+)"), F.lit(1)))
    return texts.where(count >= words).select("code").distinct()


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, class_id, links): each file's class of exact copies (its least file id) and to how many other texts the text is similar."""
    scratch = Scratch(spark, "classes")
    texts, members = coded(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content", "indexed_at")))
    found = scratch.keep(links(texts, P2, scratch).select("a", "b"))
    degree = found.select(F.explode(F.array("a", "b")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("links"))
    ids = members.groupBy("code").agg(F.min("file_id").alias("class_id"))
    return members.join(ids, "code").join(degree, "code", "left").select("file_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, group_id, links): each file's group, in which every text is similar to another one of it or a copy, by its least file id; and to how
    many other texts the file's is similar. A file like no other is a group of its own."""
    scratch = Scratch(spark, "groups")
    texts, members = coded(spread(table(spark, sf_dir, "indexed_files").select("file_id", "content", "indexed_at")))
    found = scratch.keep(links(texts, P2, scratch).select("a", "b"))
    degree = found.select(F.explode(F.array("a", "b")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("links"))
    roots = components(found, scratch).select(F.col("node").alias("code"), "root")
    placed = scratch.keep(members.join(roots, "code", "left").join(degree, "code", "left").withColumn("root", F.coalesce("root", "code")))
    least = placed.groupBy("root").agg(F.min("file_id").alias("group_id"))
    return small_join(placed, least, ["root"], "inner").select("file_id", "group_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
