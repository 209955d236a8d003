"""Command line: define, check, generate, validate, export."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import SparkSession

from .operators import infer, report
from .plans import spec
from .plans.generate import GenerationError, generate_dataset
from .plans.provider import OfflineProvider, payload
from .sources import files
from .sources.shared import Files
from .sources.store import read_last_run, write_last_run


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def located(path: str) -> str:
    """Spark resolves relative paths where its JVM started, so local ones are made absolute."""
    return path if "://" in path else os.path.abspath(path)


def counts_of(dataset: spec.Dataset, text: list[str]) -> dict[str, int]:
    """``N`` for a single table, ``table=N`` for any."""
    out = {}
    for item in text:
        name, _, n = item.rpartition("=")
        if not name and len(dataset.tables) != 1:
            raise spec.SpecError("with several tables counts are given as table=N")
        out[dataset.table(name or dataset.tables[0].name).name] = int(n)
    return out


def do_define(a: argparse.Namespace) -> int:
    df = files.read(session(), located(a.from_sample), limit=a.limit)
    name = os.path.basename(a.from_sample).split(".")[0]
    doc = infer.infer(df, "".join(c if c.isalnum() else "_" for c in name), a.about, a.count)
    spec.save(doc, a.schema)
    print(f"{a.schema}: {len(doc['fields'])} fields")
    return 0


def do_check(a: argparse.Namespace) -> int:
    dataset = spec.load(a.schema)
    for t in dataset.ordered():
        print(f"{t.name}: {t.count} records, {len(t.fields)} fields, {len(t.checks)} checks, complexity {spec.complexity(spec.batch_schema(t))}")
        for w in spec.complexity_warnings(spec.batch_schema(t)):
            print(f"  warning: {w}")
        if a.show_prompt:
            print(payload(t)["system"])
        if a.show_schema:
            print(json.dumps(spec.full_schema(t), indent=2, default=str))
    return 0


def do_generate(a: argparse.Namespace) -> int:
    dataset = spec.load(a.schema)
    if a.seed is not None:
        dataset.settings.seed = a.seed
    out = os.path.abspath(a.output)
    if os.path.isdir(out) and os.listdir(out) and not (a.resume or a.overwrite):
        print(f"{out} is not empty; use --resume or --overwrite", file=sys.stderr)
        return 2
    spark = session()
    code = 0
    try:
        tables, stats = generate_dataset(spark, dataset, out, OfflineProvider(dataset.settings.seed or 0), a.only, counts_of(dataset, a.count or []), a.resume, log=print)
    except GenerationError as e:
        print(str(e), file=sys.stderr)
        return 1
    written = files.export(tables, {t.name: t for t in dataset.tables}, os.path.join(out, "export"), a.format.split(","))
    reports = {name: report.quality_report(df, dataset.table(name)) for name, df in tables.items()}
    Files(spark).write_json(os.path.join(out, "quality_report.json"), reports)
    files.write_manifest(spark, out, written, {"schema": spec.read_document(a.schema), "fingerprint": dataset.fingerprint(), "stats": {k: s.as_dict() for k, s in stats.items()}})
    write_last_run(spark, {"folder": out, "schema": os.path.abspath(a.schema)}, os.getcwd())
    for name, r in reports.items():
        print(report.render(r, name))
    return code


def _schema_for(path: str | None) -> spec.Dataset | None:
    last = read_last_run(session(), os.getcwd())
    path = path or (last or {}).get("schema")
    return spec.load(path) if path and os.path.exists(path) else None


def _table_for(dataset: spec.Dataset | None, data: str, name: str | None) -> spec.Table | None:
    if dataset is None:
        return None
    stem = os.path.basename(data.rstrip("/")).split(".")[0]
    if name or len(dataset.tables) > 1:
        return dataset.table(name or stem)
    return dataset.tables[0]


def do_validate(a: argparse.Namespace) -> int:
    table = _table_for(_schema_for(a.schema), a.data, a.table)
    df = files.read(session(), located(a.data), table=table, sqlite_table=a.table if files.format_of(a.data) == "sqlite" else None)
    found = report.quality_report(df, table)
    print(json.dumps(found, indent=2, default=str) if a.json else report.render(found, a.data))
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            json.dump(found, f, indent=2, default=str)
    bad = found.get("duplicate_rows", 0) or found.get("schema", {}).get("pass_rate", 1) < 1
    return 1 if bad else 0


def do_export(a: argparse.Namespace) -> int:
    table = _table_for(_schema_for(a.schema), a.data, a.table)
    df = files.read(session(), located(a.data), table=table)
    if os.path.splitext(a.output)[1]:
        files.write_single(df, located(a.output), table)
    else:
        name = table.name if table else os.path.basename(a.data).split(".")[0]
        files.export({name: df}, {name: table} if table else {}, located(a.output), a.format.split(","))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    sub = p.add_subparsers(required=True)

    def add(name: str, run: Any, **options: dict) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for o, keys in options.items():
            c.add_argument(*([o] if keys.pop("positional", False) else [f"--{o.replace('_', '-')}"]), **keys)

    flag = {"action": "store_true"}
    add("define", do_define, schema={"positional": True}, from_sample={"required": True}, about={"default": ""}, count={"type": int}, limit={"type": int})
    add("check", do_check, schema={"positional": True}, show_prompt=dict(flag), show_schema=dict(flag))
    add("generate", do_generate, schema={"positional": True}, output={"default": "out"}, count={"nargs": "*"}, format={"default": "jsonl"}, only={"nargs": "*"}, seed={"type": int}, resume=dict(flag), overwrite=dict(flag))
    add("validate", do_validate, data={"positional": True}, schema={}, table={}, report={}, json=dict(flag))
    add("export", do_export, data={"positional": True}, output={"required": True}, schema={}, table={}, format={"default": "parquet"})
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (spec.SpecError, ValueError, FileNotFoundError) as e:
        print(str(e), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
