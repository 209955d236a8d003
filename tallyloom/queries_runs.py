"""Driver queries of whole runs: files of a specification, several tables, streams, the command line, prompts."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from .operators import accept, report
from .plans import generate, spec
from .plans.provider import OfflineProvider, payload, planned_scenarios, scenario_prompt, slot_brief, user_prompt
from .registry import query, table
from .sources import files
from .sources.shared import Files, shared_dir

_SHOPS = {
    "settings": {"seed": 21},
    "tables": {
        "shops": {"count": 6, "fields": {"id": {"type": "string", "generator": "sequence", "format": "S{:02d}"}, "town": "string", "opened": {"type": "date", "min": "2020-01-01", "max": "2020-12-31", "distribution": "uniform"}}},
        "sales": {
            "count": 40,
            "batch_size": 8,
            "fields": {"id": {"type": "integer", "generator": "sequence"}, "shop": {"ref": "shops.id", "ref_context": ["opened"]}, "day": {"type": "date", "min": "2021-01-01", "max": "2021-12-31", "distribution": "uniform"}, "n": {"type": "integer", "min": 1, "max": 9}, "note": "string"},
            "checks": ["day > date.fromisoformat(parent['shop']['opened'])"],
        },
    },
}


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@query("SELECT * FROM (VALUES ('json', true, 2), ('yaml', true, 2)) t(kind, same, tables)")
def schema_files(spark, sf_dir):
    """A specification written and read again says the same."""
    rows, want = [], spec.from_dict(_SHOPS).fingerprint()
    with tempfile.TemporaryDirectory() as folder:
        for kind in ("json", "yaml"):
            path = f"{folder}/shops.{kind}"
            with open(path, "w", encoding="utf-8") as f:
                json.dump(_SHOPS, f)  # JSON is YAML too
            with contextlib.suppress(ImportError):
                got = spec.load(path)
                rows.append((kind, got.fingerprint() == want, len(got.tables)))
    return spark.createDataFrame(rows or [("json", False, 0)], "kind string, same boolean, tables int")


@query("SELECT 6::BIGINT AS shops, 40::BIGINT AS sales, 0::BIGINT AS orphans, 0::BIGINT AS early, 'refused' AS without_parents, 40::BIGINT AS again")
def parents_from_disk(spark, sf_dir):
    """Children generated in a run of their own refer to the parents on disk; without these they are refused."""
    folder, dataset = _folder(spark), spec.from_dict(_SHOPS)
    try:
        generate.generate_dataset(spark, dataset, folder, only=["sales"])
        refused = ""
    except generate.GenerationError:
        refused = "refused"
    shops = generate.generate_dataset(spark, dataset, folder, only=["shops"])[0]["shops"]
    sales = generate.generate_dataset(spark, dataset, folder, only=["sales"])[0]["sales"]
    orphans = accept.orphans(sales, "shop", shops, "id").count()
    early = sales.join(shops.select(F.col("id").alias("shop"), "opened"), "shop").where("day <= opened").count()
    again = generate.generate_dataset(spark, dataset, folder, only=["sales"], resume=True)[0]["sales"].count()
    return spark.createDataFrame([(shops.count(), sales.count(), orphans, early, refused, again)], "shops long, sales long, orphans long, early long, without_parents string, again long")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 3")
def orphaned_references(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 3")
    return accept.orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query("SELECT format, n.c AS nations, r.c AS regions FROM (VALUES ('csv'), ('jsonl'), ('parquet')) f(format), (SELECT count(*) AS c FROM nation) n, (SELECT count(*) AS c FROM region) r")
def multi_format_export(spark, sf_dir):
    """Every table in every format, read again."""
    folder, tables = _folder(spark), {n: table(spark, sf_dir, n) for n in ("nation", "region")}
    written = files.export(tables, {}, folder, ["csv", "jsonl", "parquet"])
    rows = []
    for kind in ("csv", "jsonl", "parquet"):
        n, r = (files.read(spark, next(p for p in written if p.endswith(f"/{name}.{kind}"))).count() for name in ("nation", "region"))
        rows.append((kind, n, r))
    return spark.createDataFrame(rows, "format string, nations long, regions long")


@query("SELECT count(*) AS rows, true AS same_score, true AS names_all_columns, 1::BIGINT AS words_column FROM nation")
def report_files(spark, sf_dir):
    """The report as a file and as text; a text column is one by its number of words."""
    path, df = f"{_folder(spark)}/quality_report.json", table(spark, sf_dir, "nation").withColumn("prose", F.concat(F.lit("a few words and a number "), "n_nationkey"))
    made = report.quality_report(df, order="n_nationkey")
    Files(spark).write_json(path, made)
    read, text = Files(spark).read_json(path), report.render(made, "nation")
    told = [c for c, i in read["columns"].items() if "text" in i]
    row = (read["rows"], read["score"] == made["score"], all(f"| {c} |" in text for c in made["columns"]), len(told))
    return spark.createDataFrame([row], "rows long, same_score boolean, names_all_columns boolean, words_column long")


@query("""SELECT * FROM (VALUES (0, '{"a": 5, "b": "x"}', 0), (1, '{"a": 7, "b": "x"}', 1), (2, '{"a": 5, "b": null}', 1), (3, '{"a": 5, "b": "x", "c": 1}', 0), (4, '{"b": "x"}', 0), (5, '"no object"', 0)) t(slot, record, repaired)""")
def assembled_records(spark, sf_dir):
    """Records in field order; planned values and nulls are put over the provider's, what is unknown stays to be judged."""
    own = spec.from_dict({"fields": {"k": {"type": "integer", "generator": "sequence"}, "a": "integer", "b": {"type": "string", "nullable": True}}}).tables[0]
    slot = lambda fixed=None, nulls=(): {"fixed": fixed or {}, "nulls": list(nulls), "refs": {}}
    given = [(slot(), {"b": "x", "a": 5}), (slot({"a": 7}), {"a": 5, "b": "x"}), (slot(nulls=["b"]), {"a": 5, "b": "x"}), (slot(), {"c": 1, "a": 5, "b": "x"}), (slot(), {"b": "x"}), (slot(), "no object")]
    rows = [(i, *generate.assemble(own, s, r)) for i, (s, r) in enumerate(given)]
    return spark.createDataFrame(rows, "slot int, record string, repaired int")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id >= 10 AND value <= 90 GROUP BY event_type")
def streamed_records(spark, sf_dir):
    """Records of a stream, validated and appended, counted by label."""
    from .queries import events_spec
    from .streaming.ingest import append_valid

    folder, own = _folder(spark), events_spec()
    own.checks, own["event_type"].values = [], ["click", "view", "purchase"]
    labels = table(spark, sf_dir, "events").select("event_type").distinct().collect()
    own["event_type"].values = sorted(r.event_type for r in labels)
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value", "user_id")).alias("value"))
    rows.repartition(3).write.text(f"{folder}/in")
    stream = spark.readStream.text(f"{folder}/in")
    append_valid(stream, own, f"{folder}/ok", f"{folder}/state", f"{folder}/bad").awaitTermination(300)
    return spark.read.parquet(f"{folder}/ok").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1, 'check', 0), (2, 'generate', 0), (3, 'generate again', 2), (4, 'resume', 0), (5, 'validate', 0), (6, 'validate copies', 1), (7, 'export', 0), (8, 'define', 0), (9, 'unknown file', 2)) t(step, command, code)")
def command_line(spark, sf_dir):
    """Exit codes of all commands."""
    from . import cli

    before, rows = os.getcwd(), []
    with tempfile.TemporaryDirectory() as folder, contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        os.chdir(folder)
        try:
            with open("s.json", "w", encoding="utf-8") as f:
                json.dump({"name": "t", "count": 5, "fields": {"id": {"type": "integer", "generator": "sequence"}, "word": "string"}}, f)
            with open("copies.jsonl", "w", encoding="utf-8") as f:
                f.write('{"id": 1, "word": "x"}\n' * 3)
            calls = {
                "check": ["check", "s.json", "--show-prompt", "--show-schema"],
                "generate": ["generate", "s.json", "--seed", "4", "--format", "jsonl,csv"],
                "generate again": ["generate", "s.json"],
                "resume": ["generate", "s.json", "--seed", "4", "--resume", "--count", "8"],
                "validate": ["validate", "out/export/t.jsonl", "--json", "--report", "r.json"],
                "validate copies": ["validate", "copies.jsonl", "--schema", "s.json"],
                "export": ["export", "out/export/t.jsonl", "--schema", "s.json", "--output", "t.json"],
                "define": ["define", "d.json", "--from-sample", "t.json"],
                "unknown file": ["check", "nothing.json"],
            }
            for i, (name, args) in enumerate(calls.items(), 1):
                rows.append((i, name, cli.main(args)))
        finally:
            os.chdir(before)
    return spark.createDataFrame(rows, "step int, command string, code int")


@query("SELECT * FROM (VALUES ('fields', true), ('checks', true), ('coded fields left out', true), ('slot', true), ('avoid', true), ('feedback', true), ('scenarios', true), ('planned', true)) t(part, there)")
def prompts(spark, sf_dir):
    """What a provider is told, and what it plans."""
    own = spec.from_dict(_SHOPS | {"tables": {"sales": _SHOPS["tables"]["sales"] | {"diversity": {"scenarios": 45, "scenario_guidance": "all seasons"}}, "shops": _SHOPS["tables"]["shops"]}}).table("sales")
    system = payload(own)["system"]
    asked = user_prompt([{"slot_id": 3, "fixed": {"n": 4}, "nulls": ["day"], "scenario": "rush"}], {"n": ["1", "2"]}, ["n: too large"])
    brief = slot_brief({"slot_id": 3, "fixed": {"n": 4}, "nulls": ["day"], "scenario": "rush", "edge_case": True})
    found = planned_scenarios(own, OfflineProvider(1))
    more = scenario_prompt(own, 5, ["calm night"])
    said = {
        "fields": "- n (integer)" in system and "- day (date)" in system,
        "checks": "parent['shop']['opened']" in system,
        "coded fields left out": "leave out: id, shop" in system,
        "slot": all(x in brief for x in ('{"n": 4}', "null: day", "rush", "unusual")),
        "avoid": "1; 2" in asked,
        "feedback": "n: too large" in asked,
        "scenarios": "all seasons" in more and "calm night" in more,
        "planned": len(found) == len({s.lower() for s in found}) == 45,
    }
    return spark.createDataFrame(list(said.items()), "part string, there boolean")
