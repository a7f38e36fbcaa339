"""Session helpers: table access, lineage cuts on shared storage and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast. Rows here are keys and counters of some 100 bytes, so the bound is about 20 MB.
BROADCAST_ROWS = 200_000
#: Replicas of the small side when it is beyond that bound and the large side is salted instead.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the cluster names in spark.checkpoint.dir.

    Where it is unset a local session (tests) takes a temporary folder of this machine; on a cluster that would lose data, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/loam-shared-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; survives lost executors, unlike cached or local blocks.

    ``keep`` writes a frame and reads it back. ``drop`` deletes a table that a later one has replaced.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loam-{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (path := self.paths.pop(id(df), None)):
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out over all cores if it has fewer splits than there are cores, so that work on its rows isn't left to a few.

    A table with fewer files and row groups than cores can't be split by the scan. Larger tables are left as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def within(self, df: DataFrame, most: int) -> bool:
        """``within`` of a frame that this scratch wrote, by the row counts in its files' footers: no row is read."""
        return df.count() <= most


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out over all cores if it has fewer partitions than there are cores, so that work on its rows isn't left to a few.

    Large tables have more splits than cores and are left as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def within(df: DataFrame, most: int) -> bool:
    """Whether a frame has at most so many rows; reads no more than it needs to tell."""
    return df.limit(most + 1).count() <= most


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Equi-join (left or inner) of a skewed frame with one that is unique by ``on`` and usually small.

    The small side is broadcast only when its row count is checked to be within ``most``. Beyond it the big side is salted and
    the small one replicated per salt, so that a key that holds a third of the rows is spread over SALTS tasks. With ``null_safe`` a null
    key equals a null key.
    """
    keys = list(on)
    if within(small, most):
        small = F.broadcast(small)
    else:
        keys.append("_salt")
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int"))
        small = small.withColumn("_salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    if not null_safe:
        return big.join(small, keys, how).drop("_salt")
    renamed = small.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return big.join(renamed, same, how).drop("_salt", *[f"_r_{k}" for k in keys])


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, so that Python workers can import it wherever they run."""
    if getattr(spark.sparkContext, "_loam_shipped", False):
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    staged = Path(tempfile.mkdtemp(prefix="loam-ship-"))
    shutil.copytree(package, staged / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(staged / package.name), "zip", staged / "src"))
    spark.sparkContext._loam_shipped = True
