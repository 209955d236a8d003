"""Files on any file system that Spark reads, through Hadoop's interface, and tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset the warehouse, or in local mode a folder that goes at the end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            own = tempfile.mkdtemp(prefix="tallyloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = "file://" + own
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tallyloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when these end; for queries whose results are written and read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that all that uses it sees the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with shuffle_files_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Reading, writing and moving of files by path or URI."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_file(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def move(self, old: str, new: str) -> None:
        """Replaces ``new``."""
        fs, at = self._at(old)
        _, to = self._at(new)
        if fs.exists(to):
            fs.delete(to, True)
        if not fs.rename(at, to):
            raise OSError(f"cannot move {old} to {new}")

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; hidden entries and Spark's marks left out."""
        fs, at = self._at(folder)
        found = (s.getPath().getName() for s in fs.listStatus(at))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, path: str) -> Iterator[bytes]:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            while block := bytes(stream.readNBytes(CHUNK)):
                yield block
        finally:
            stream.close()

    def write(self, path: str, parts: Iterable[str | bytes]) -> None:
        """Under another name, moved when whole."""
        fs, at = self._at(path + ".part")
        stream = fs.create(at, True)
        try:
            held = bytearray()
            for p in parts:
                held += p.encode("utf-8") if isinstance(p, str) else p
                if len(held) >= CHUNK:
                    stream.write(held)
                    held = bytearray()
            if held:
                stream.write(held)
        finally:
            stream.close()
        self.move(path + ".part", path)

    def write_json(self, path: str, body: Any) -> None:
        self.write(path, [json.dumps(body, indent=2, default=str)])

    def read_json(self, path: str) -> Any:
        """None where there is no such file or no whole document in it."""
        if not self.exists(path):
            return None
        try:
            return json.loads(b"".join(self.read(path)))
        except json.JSONDecodeError:
            return None

    def digest(self, path: str) -> str:
        """SHA-256 of a file, or of the names and hashes of a folder's files in name order."""
        h = hashlib.sha256()
        if self.is_file(path):
            for block in self.read(path):
                h.update(block)
        else:
            for name in self.names(path):
                h.update(f"{name} {self.digest(f'{path}/{name}')}\n".encode())
        return h.hexdigest()
