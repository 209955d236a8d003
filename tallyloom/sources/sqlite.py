"""SQLite as a Spark data source (rowid ranges as partitions) and as a sink with primary and foreign keys."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.spec import Table
from .files import flatten

ROWS_A_PARTITION = 100_000
BATCH = 1_000
WAIT_SECONDS = 600  # of a task for another attempt at it
PARTS = "_tallyloom_parts"  # partitions that are in the file, while it is written


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_names(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        return [_Range(a, a + ROWS_A_PARTITION) for a in range(low, high + 1, ROWS_A_PARTITION)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        casts = {T.LongType: int, T.DoubleType: float, T.StringType: str}
        to = [casts[type(f.dataType)] for f in self.schema.fields]
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else c(v) for c, v in zip(to, row, strict=True))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_file").option("table", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType()}
        return T.StructType([T.StructField(c[1], kinds.get((c[2] or "TEXT").upper(), T.StringType())) for c in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, limit: int | None = None) -> DataFrame:
    names = table_names(path)
    if table is None and len(names) != 1:
        raise ValueError(f"{path} has the tables {names}; name one")
    if table is not None and table not in names:
        raise ValueError(f"{path} has no table '{table}'; it has {names}")
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite_file").option("table", table or names[0]).load(path)
    return df.limit(limit) if limit is not None else df


def _parents_first(specs: dict[str, Table], names: list[str]) -> list[str]:
    done: list[str] = []
    left = list(names)
    while left:
        ready = [n for n in left if n not in specs or all(f.target[0] not in left or f.target[0] == n for f in specs[n].refs)]
        done += ready or left
        left = [n for n in left if n not in done]
    return done


def ddl(name: str, spec: Table | None, columns: list[tuple[str, str]], referenced: set[str]) -> str:
    """``CREATE TABLE``: the first generated field is the primary key, other referenced fields are unique."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    primary = next((f.name for f in spec.fields if f.generator), None) if spec else None
    parts = []
    for c, kind in columns:
        rule = " PRIMARY KEY" if c == primary else " UNIQUE" if c in referenced else ""
        parts.append(f"{_quoted(c)} {kinds.get(kind, 'TEXT')}{rule}")
    for f in spec.refs if spec else []:
        parts.append(f"FOREIGN KEY ({_quoted(f.name)}) REFERENCES {_quoted(f.target[0])} ({_quoted(f.target[1])})")
    return f"CREATE TABLE {_quoted(name)} ({', '.join(parts)})"


def _insert(db: sqlite3.Connection, name: str, part: int, rows: Iterator[tuple], width: int) -> None:
    """Inserts a partition's rows and notes it, both or nothing; a partition that is noted is left out."""
    db.execute("PRAGMA foreign_keys = ON")
    db.execute("BEGIN IMMEDIATE")
    batch, sql = [], f"INSERT INTO {_quoted(name)} VALUES ({', '.join('?' * width)})"
    try:
        if not db.execute(f"SELECT 1 FROM {PARTS} WHERE name = ? AND part = ?", (name, part)).fetchone():
            for row in rows:
                batch.append(row)
                if len(batch) >= BATCH:
                    db.executemany(sql, batch)
                    batch = []
            db.executemany(sql, batch)
            db.execute(f"INSERT INTO {PARTS} VALUES (?, ?)", (name, part))
        db.execute("COMMIT")
    except BaseException:
        if db.in_transaction:
            db.execute("ROLLBACK")
        raise


def _inserted(path: str, name: str, width: int):
    """A task's rows into the file at ``path``: ``(seen, wrong)``; where the file is not seen nothing is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wrong = os.path.exists(path), None
        if seen:
            db = sqlite3.connect(f"file:{quote(path)}?mode=rw", uri=True, timeout=WAIT_SECONDS, isolation_level=None)
            try:
                rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
                _insert(db, name, TaskContext.get().partitionId(), rows, width)
            except sqlite3.IntegrityError as e:  # the same for any retry
                wrong = str(e)
            finally:
                db.close()
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([wrong], pa.string())], ["seen", "wrong"])

    return run


def write_sqlite(tables: dict[str, DataFrame], specs: dict[str, Table], path: str) -> None:
    """One database file, parents first, one partition after the other; replaced when whole.

    Tasks insert their rows themselves; where one does not see the driver's file, the table is streamed through the driver.
    """
    temp = f"{os.path.abspath(path)}.{uuid.uuid4().hex}.tmp"
    db = sqlite3.connect(temp, isolation_level=None)
    try:
        db.execute(f"CREATE TABLE {PARTS} (name TEXT, part INTEGER)")
        for name in _parents_first(specs, list(tables)):
            df = tables[name]
            lacking = [f for f in (specs[name].fields if name in specs else []) if f.name not in df.columns]
            df = flatten(df.select("*", *(F.lit(None).cast(f.spark_type()).alias(f.name) for f in lacking)))
            referenced = {f.target[1] for s in specs.values() for f in s.refs if f.target[0] == name}
            db.execute(ddl(name, specs.get(name), df.dtypes, referenced))
            plain = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if k in ("date", "timestamp") or k.startswith("decimal") else F.col(f"`{c}`") for c, k in df.dtypes))
            width = len(df.columns)
            done = plain.mapInArrow(_inserted(temp, name, width), "seen boolean, wrong string").rdd
            for part in range(done.getNumPartitions()):
                said = df.sparkSession.sparkContext.runJob(done, list, [part])
                if wrong := [r.wrong for r in said if r.wrong]:
                    raise sqlite3.IntegrityError(wrong[0])
                if not all(r.seen for r in said):
                    db.execute(f"DELETE FROM {_quoted(name)}")  # others may have seen it
                    _insert(db, name, -1, map(tuple, plain.toLocalIterator()), width)
                    break
        db.execute(f"DROP TABLE {PARTS}")
        db.close()
        os.replace(temp, path)
    finally:
        db.close()
        if os.path.exists(temp):
            os.remove(temp)
