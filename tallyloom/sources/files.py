"""Readers and writers of the five formats, flattening, single files, manifests.

Tables are read and written by Spark; only small artefacts (a SQLite file, a single JSON array, a manifest) are written by the
driver, row by row from an iterator, so nothing is gathered in memory.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Table
from .shared import Files

FORMATS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".sqlite": "sqlite", ".db": "sqlite"}
BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # a CSV writer strips values unless told not to


def format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown format '{suffix}' of {path}; use one of {', '.join(FORMATS)}")
    return FORMATS[suffix]


def separator(path: str) -> str:
    return "\t" if path.rstrip("/").lower().endswith(".tsv") else ","


def flatten(df: DataFrame, arrays: bool = True) -> DataFrame:
    """Structs become dotted columns; arrays become JSON text if asked."""

    def walk(col: Column, kind: T.DataType, name: str) -> Iterator[Column]:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(col[f.name], f.dataType, f"{name}.{f.name}")
        elif isinstance(kind, T.ArrayType | T.MapType) and arrays:
            yield F.to_json(col, {"ignoreNullFields": "false"}).alias(name)
        else:
            yield col.alias(name)

    return df.select(*(c for f in df.schema.fields for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name)))


def unflatten(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Dotted columns become structs; JSON text becomes arrays where ``schema`` says so.

    Without a schema, a text column whose bracketed values all parse becomes an array of their common type; text that is
    no JSON array stays text.
    """
    tree: dict[str, Any] = {}
    for name in df.columns:
        node = tree
        *heads, last = name.split(".")
        for h in heads:
            node = node.setdefault(h, {})
        node[last] = F.col(f"`{name}`")
    guessed = {} if schema else _array_columns(df)

    def build(node: Any, kind: T.DataType | None, path: str) -> Column:
        if isinstance(node, dict):
            inner = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
            return F.struct(*(build(v, inner.get(k), f"{path}.{k}").alias(k) for k, v in node.items()))
        if isinstance(kind, T.ArrayType):
            return F.from_json(node, kind)
        return F.from_json(node, guessed[path]) if path in guessed else node

    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    return df.select(*(build(v, kinds.get(k), k).alias(k) for k, v in tree.items()))


def _array_columns(df: DataFrame) -> dict[str, str]:
    """Types of the text columns that hold JSON arrays and nulls only (one pass over all of them)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    tests = []
    for i, n in enumerate(names):
        v = F.col(f"`{n}`")
        parsed = F.try_parse_json(F.when(v.startswith("[") & v.endswith("]"), v))
        tests += [F.bool_and(parsed.isNotNull() | v.isNull()).alias(f"ok{i}"), F.schema_of_variant_agg(parsed).alias(f"kind{i}")]
    got = df.agg(*tests).first().asDict()
    known = re.compile(r"ARRAY<(BIGINT|DOUBLE|STRING|BOOLEAN)>")
    return {n: got[f"kind{i}"] for i, n in enumerate(names) if got[f"ok{i}"] and known.fullmatch(got[f"kind{i}"] or "")}


def read(spark: SparkSession, path: str, limit: int | None = None, sqlite_table: str | None = None, table: Table | None = None) -> DataFrame:
    """A data set as Spark reads it; CSV gives text, ``''`` as null and dotted columns as structs."""
    kind = format_of(path)
    if kind == "csv":
        df = spark.read.options(header=True, escape='"', multiLine=True, sep=separator(path), **BLANKS).csv(path)
        df = unflatten(df, table.struct() if table else None)
    elif kind == "json":
        df = _unwrapped(spark, path)
    elif kind == "jsonl":
        df = spark.read.json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        from .sqlite import read_sqlite

        df = read_sqlite(spark, path, sqlite_table, limit)
    return df.limit(limit) if limit is not None else df


def _unwrapped(spark: SparkSession, path: str) -> DataFrame:
    """An array's records; of a single object the elements of its first list, or the object itself."""
    df = spark.read.option("multiLine", True).json(path)
    fs = Files(spark)
    first = path if fs.is_file(path) else f"{path}/{fs.names(path)[0]}"
    if not next(fs.read(first), b"").lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{"):
        return df
    keys = spark.read.text(first, wholetext=True).select(F.json_object_keys("value").alias("k")).first().k or []
    name = next((k for k in keys if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType)), None)
    if name is None:
        return df
    rows = df.select(F.explode(f"`{name}`").alias(name))
    return rows.select(f"`{name}`.*") if isinstance(rows.schema[name].dataType, T.StructType) else rows


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """``_record`` variants of a JSON-lines file, blank lines skipped; a torn line gives null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("_record"))


def write(df: DataFrame, path: str, kind: str | None = None, table: Table | None = None, mode: str = "overwrite") -> None:
    """Write a data set in the format of ``path`` (or ``kind``), as a folder of part files."""
    kind = kind or format_of(path)
    if kind == "csv":
        flatten(df).write.mode(mode).options(header=True, escape='"', sep=separator(path), **BLANKS).csv(path)
    elif kind == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "json":
        write_json_array(df, path)
    elif kind == "sqlite":
        from .sqlite import write_sqlite

        write_sqlite({table.name if table else "records": df}, {table.name: table} if table else {}, path)
    else:
        raise ValueError(f"unknown format {kind}")


def write_json_array(df: DataFrame, path: str) -> None:
    """One indented JSON array, streamed partition by partition through the driver."""

    def parts() -> Iterator[str]:
        first = True
        for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            yield "[\n" if first else ",\n"
            yield "\n".join("  " + line for line in json.dumps(json.loads(r.j), indent=2, ensure_ascii=False).split("\n"))
            first = False
        yield "[]\n" if first else "\n]\n"

    Files(df.sparkSession).write(path, parts())


def write_single(df: DataFrame, path: str, table: Table | None = None) -> None:
    """One file instead of a folder, for results of a size that one task may write."""
    kind = format_of(path)
    if kind in ("json", "sqlite"):
        write(df, path, kind, table)
        return
    folder = path + ".parts" + (os.path.splitext(path)[1] if kind == "csv" else "")
    write(df.coalesce(1), folder, kind)
    fs = Files(df.sparkSession)
    part = next((n for n in fs.names(folder) if n.startswith("part-")), None)
    if part:
        fs.move(f"{folder}/{part}", path)
    else:
        fs.write(path, [])
    fs.delete(folder)


def export(tables: dict[str, DataFrame], specs: dict[str, Table], folder: str, formats: list[str]) -> list[str]:
    """Every table in every format; SQLite gets one file for all."""
    from .sqlite import write_sqlite

    out = []
    for kind in formats:
        if kind == "sqlite":
            os.makedirs(folder, exist_ok=True)
            out.append(os.path.join(folder, "dataset.sqlite"))
            write_sqlite(tables, specs, out[-1])
            continue
        for name, df in tables.items():
            out.append(os.path.join(folder, f"{name}.{kind}"))
            write(df, out[-1], kind, specs.get(name))
    return out


def write_manifest(spark: SparkSession, folder: str, files: list[str], extra: dict[str, Any]) -> str:
    """``manifest.json`` with a hash of each output."""
    path, fs = f"{folder}/manifest.json", Files(spark)
    fs.write_json(path, extra | {"files": {p.removeprefix(folder).lstrip("/"): fs.digest(p) for p in files}})
    return path
