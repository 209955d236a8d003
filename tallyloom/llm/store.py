"""Shared scratch tables: lineage is cut with Parquet written where every executor can read it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import Files, shared_dir, shuffle_files_go

#: Where the shared folder is a local one, Hadoop starts a process to set the mode of each file, of its checksum's and of the
#: folder that its task writes to.  Until such a process has begun, it shows all of the executor's memory as its own.  The raw
#: file system has no checksums.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
FILE_ROWS = 20_000  # tables whose rows are known to be few get no more files than this asks for


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with more underscores in front where ``df`` has such columns (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Names, writes and drops the intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it again: what follows never recomputes what came before.

        ``rows``: it has no more than these, so that many partitions of a few rows become few files.
        """
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        with shuffle_files_go(self.spark):
            df.write.options(**LOCAL).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str | None) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            path = table if isinstance(table, str) else getattr(table, "_scratch_path", None)
            if path:
                Files(self.spark).delete(path)
