"""Folders on the shared file system: small files that appear whole or not at all, and numbered pointers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder reached through Hadoop's file systems, so that the same code serves local disks, HDFS and object stores."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """The names in a folder; none for a folder that doesn't exist."""
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def age_ms(self, name: str, now_ms: int) -> int:
        return now_ms - self.fs.getFileStatus(self.path(name)).getModificationTime()

    def read(self, name: str) -> bytes:
        source = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def write(self, name: str, raw: bytes) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(raw))
        out.close()

    def replace(self, name: str, raw: bytes) -> None:
        """Replaces a small file in one step: written beside it and renamed over it."""
        beside = f".{uuid.uuid4().hex}.new"
        self.write(beside, raw)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.path(beside), self.path(name), how)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def claim(self, name: str) -> bool:
        """Creates an empty file that must not exist yet: of several callers one gets True."""
        self.fs.mkdirs(self.path(name).getParent())
        try:
            return self.fs.createNewFile(self.path(name))
        except Exception:  # some file systems raise where others answer
            return False

    def publish(self, name: str, raw: bytes) -> bool:
        """Makes a whole file of a name that must not exist yet: written beside it and renamed. False if the name is taken."""
        if self.exists(name):
            return False
        beside = f".{uuid.uuid4().hex}.new"
        self.write(beside, raw)
        done = self.fs.rename(self.path(beside), self.path(name))
        if not done:
            self.delete(beside)
        return done


class Pointers:
    """Numbered JSON files ``<label>-<n>.json``, of which the highest counts. A new state is a new file, so there is no moment without one.

    The last few are kept for readers that hold an older one.
    """

    KEPT = 5

    def __init__(self, folder: Folder, label: str):
        self.folder, self.label = folder, label

    def _name(self, n: int) -> str:
        return f"{self.label}-{n:012d}.json"

    def numbers(self) -> list[int]:
        head, tail = f"{self.label}-", ".json"
        found = [n[len(head) : -len(tail)] for n in self.folder.names() if n.startswith(head) and n.endswith(tail)]
        return sorted(int(n) for n in found if n.isdigit())

    def last(self) -> tuple[int, dict | None]:
        """(number, state) of the newest readable pointer; (0, None) if there is none."""
        for n in reversed(self.numbers()):
            try:
                return n, json.loads(self.folder.read(self._name(n)).decode())
            except ValueError:
                continue
        return 0, None

    def advance(self, after: int, state: dict) -> int:
        """Publishes a state as the successor of ``after``; raises if another writer came first."""
        if not self.folder.publish(self._name(after + 1), json.dumps(state, ensure_ascii=False).encode()):
            raise Conflict(f"another writer has published {self._name(after + 1)}")
        for n in self.numbers()[: -self.KEPT]:
            self.folder.delete(self._name(n))
        return after + 1


class Conflict(RuntimeError):
    """Two writers made the same successor of one state; the later one must start again from the newer state."""


def retried(change, times: int = 6, wait: float = 0.3):
    """Runs a change that may meet a conflict or a passing failure of the file system again from the start, waiting longer each time."""
    import time

    from py4j.protocol import Py4JJavaError

    for n in range(times):
        try:
            return change()
        except (Conflict, Py4JJavaError):
            if n == times - 1:
                raise
            time.sleep(min(3.0, wait * 2**n))
