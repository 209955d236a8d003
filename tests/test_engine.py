import json
import re

import pytest
from pyspark.sql import functions as F
from test_spec import BOATS

from tallyloom.functions import rng
from tallyloom.functions.checks import CheckError, Compiler
from tallyloom.operators import accept, infer, metrics, report, validate
from tallyloom.plans import generate, slots, spec
from tallyloom.plans.provider import OfflineProvider, matched, salvage
from tallyloom.sources import files
from tallyloom.sources.sqlite import read_sqlite, write_sqlite
from tallyloom.sources.store import Store

SHIP = {
    "berth": "512", "beacon": "URN:UUID:0F0E0D0C-0B0A-0908-0706-050403020100", "rig": " Ketch", "length_m": "12.345", "crew": True, "launched": "2001-02-03T04:05",
    "home": None, "motto": "  go  ", "ports": '["Oslo"]', "engine": {"kw": 40, "diesel": "yes"},
}


def judged(spark, table, *records):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string").select("i", F.try_parse_json("j").alias("_record"))
    return validate.validate(df, table).orderBy("i").collect()


def test_validation(spark):
    table = spec.from_dict(BOATS).tables[0]
    ok, *wrong = judged(
        spark, table, SHIP,
        SHIP | {"crew": 0, "ports": list("abcde"), "flag": "x"},
        {k: v for k, v in SHIP.items() if k not in ("motto", "home")},
        SHIP | {"length_m": 99, "rig": "raft", "engine": {"kw": -1, "diesel": "perhaps"}, "ports": ["a", 2], "launched": "1980-01-01"},
    )
    assert list(ok._errors) == [] and (ok.berth, ok.rig, ok.length_m, ok.crew, ok.motto, ok.ports) == (512, "ketch", 12.34, 1, "go", ["Oslo"])
    assert ok.launched.minute == 5 and ok.engine.kw == 40.0 and ok.engine.diesel is True and ok.home is None
    told = [{e.path: e.reason for e in r._errors} for r in wrong]
    assert told[0].keys() == {"crew", "ports", "flag"} and told[0]["flag"] == validate.REASONS["extra"] and "at most 4 items" in told[0]["ports"]
    assert told[1] == {"motto": validate.REASONS["required"]}
    assert list(told[2]) == ["rig", "length_m", "launched", "ports.1", "engine.kw", "engine.diesel"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a is None or a != b", [True, True, False]),
        ("len(set(tags)) == len(tags)", [True, False, True]),
        ("n >= {'x': 1, 'y': 5}[b]", [True, False, True]),
        ("sum(t['q'] * t['p'] for t in items) == n", [True, False, False]),
        ("b in ('x', 'z') and not n < 0", [True, False, True]),
        ("str(n) in note", [True, False, True]),
        ("(a is None) == (n == 3)", [True, True, True]),
        ("all(x != b for x in tags)", [True, True, False]),
        ("b in [t['name'] for t in items]", [True, False, False]),
        ("len({s.lower() for s in tags}) == len(tags)", [True, False, True]),
    ],
)
def test_checks(spark, source, expected):
    rows = [(None, "x", 3, ["k", "l"], [(1.0, 3.0, "x")], "3 of"), ("q", "y", 4, ["k", "k"], [(1.0, 1.0, "z")], ""), ("x", "x", 5, ["x"], [], "5")]
    df = spark.createDataFrame(rows, "a string, b string, n long, tags array<string>, items array<struct<q:double,p:double,name:string>>, note string")
    got = df.withColumn("ok", Compiler(df.schema).compile(source)).collect()
    assert [r.ok for r in got] == expected


def test_checks_outside_the_subset(spark):
    df = spark.createDataFrame([(1,)], "n long")
    for source in ("__import__('os')", "m > 1", "n.bit_length()", "[x for x in range(3)]"):
        with pytest.raises(CheckError):
            Compiler(df.schema).compile(source)


def test_apportion_and_quota():
    assert slots.apportioned(10, [0.2, 0.3, 0.5]) == [2, 3, 5]
    assert sum(slots.apportioned(17, [1, 1, 1])) == 17


def test_plans_do_not_depend_on_partitions(spark):
    table = spec.from_dict(BOATS).tables[0]
    a = slots.plan(spark, table, 0, 64, 9).orderBy("slot_id").collect()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = slots.plan(spark, table, 0, 64, 9).orderBy("slot_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", n)
    assert a == b
    rigs = [r["_fixed_rig"] for r in a]
    assert [rigs.count(x) for x in ("sloop", "ketch", "yawl", "cutter")] == [32, 16, 8, 8]
    assert all(4.5 <= r["_fixed_length_m"] <= 30 for r in a) and 10 < sum("home" in r.nulls for r in a) < 42


def test_parents(spark):
    parents = spark.range(50).select(F.concat(F.lit("c"), "id").alias("k"), (F.col("id") * 2).alias("n"))
    drawn = slots.pick_parents(spark.range(2000).withColumnRenamed("id", "key"), parents, "k", 1.2, "s", context=["n"])
    rows = drawn.select("_parent.*").groupBy("k").count().orderBy(F.desc("count")).collect()
    assert drawn.count() == 2000 and rows[0]["count"] > 300
    old, slots.BROADCAST_PARENTS = slots.BROADCAST_PARENTS, 1
    try:
        again = slots.pick_parents(spark.range(2000).withColumnRenamed("id", "key"), parents, "k", 1.2, "s", context=["n"])
        assert sorted(map(tuple, again.select("key", "_parent.k").collect())) == sorted(map(tuple, drawn.select("key", "_parent.k").collect()))
    finally:
        slots.BROADCAST_PARENTS = old


def test_salvage_and_matching():
    whole, ok = salvage('{"records": [{"a": 1}]}')
    assert (whole, ok) == ([{"a": 1}], True)
    torn, ok = salvage('{"records": [{"a": 1}, {"a": 2}, {"a"')
    assert (torn, ok) == ([{"a": 1}, {"a": 2}], False)
    assert salvage("no")[0] == []
    assert salvage('{"other": [1], "records" : [ {"a": 1} , {"a"')[0] == [{"a": 1}]
    pairs, lost = matched([{"slot_id": 5}, {"slot_id": 6}, {"slot_id": 7}], [{"_slot": 1, "v": 1}, "x", {"_slot": 1, "v": 2}, {"_slot": 9, "v": 3}, {"v": 4}])
    assert [(s["slot_id"], r["v"]) for s, r in pairs] == [(5, 2), (6, 1), (7, 3)]
    assert lost == {"record: malformed": 1, "record: extra record": 1}


def test_generation_with_a_misbehaving_provider(spark, tmp_path):
    dataset = spec.from_dict(BOATS | {"count": 32, "strict_distribution": True, "checks": ["len(motto) > 1"]})
    provider = OfflineProvider(8, invalid_rate=0.15, disobey_rate=0.1, wrong_case_rate=0.3, duplicate_rate=0.1, shuffle=True, extra_record=True)
    folder = str(tmp_path / "run")
    tables, stats = generate.generate_dataset(spark, dataset, folder, provider, counts={"boats": 24})
    first = {r.berth: r for r in tables["boats"].collect()}
    assert sorted(first) == list(range(500, 524)) and len({r.motto.lower() for r in first.values()}) == 24
    assert stats["boats"].accepted == 24 and {"record: extra record"} < stats["boats"].rejected.keys()
    tables, _ = generate.generate_dataset(spark, dataset, folder, provider, resume=True)
    rows = {r.berth: r for r in tables["boats"].collect()}
    assert sorted(rows) == list(range(500, 532)) and all(rows[k] == r for k, r in first.items())
    rigs = [r.rig for r in rows.values()]
    assert rigs.count("sloop") == 16 and len({r.beacon for r in rows.values()}) == 32


def test_batches_shrink_values_are_avoided_scenarios_planned(spark, tmp_path):
    class Watched(OfflineProvider):
        """Cuts the answers of large batches, and writes down what it is shown."""

        def respond(self, table, slots, feedback, avoid):
            text = super().respond(table, slots, feedback, avoid)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps([len(slots), sorted({s["scenario"] for s in slots}), avoid]) + "\n")
            return text[: int(0.7 * len(text))] if len(slots) > 6 else text

    document = BOATS | {"count": 30, "diversity": {"scenarios": 3, "avoid_repeats": ["rig"]}}
    provider = Watched(5)
    provider.path = str(tmp_path / "log")
    tables, stats = generate.generate_dataset(spark, spec.from_dict(document), str(tmp_path / "out"), provider)
    calls = [json.loads(x) for x in open(provider.path, encoding="utf-8")]
    done = stats["boats"]
    assert tables["boats"].count() == 30 and done.truncations and done.batch_size < 9 and done.tokens_per_record > 10
    assert max(c[0] for c in calls) == 9 and min(c[0] for c in calls) < 9
    assert len(done.scenarios) == 3 and {s for c in calls for s in c[1]} == set(done.scenarios)
    assert not calls[0][2] and {"rig", "motto"} == calls[-1][2].keys() and len(calls[-1][2]["motto"]) <= 40


def test_two_tables(spark, tmp_path):
    document = {
        "seed": 5,
        "tables": {
            "customers": {"count": 8, "fields": {"id": {"type": "string", "generator": "sequence", "format": "C{:03d}"}, "name": "string", "since": {"type": "date", "min": "2020-01-01", "max": "2021-01-01", "distribution": "uniform"}}},
            "orders": {
                "count": 20,
                "fields": {"id": {"type": "integer", "generator": "sequence"}, "customer": {"ref": "customers.id", "ref_context": ["since"], "ref_skew": 1.2}, "day": {"type": "date", "min": "2022-01-01", "max": "2022-12-31", "distribution": "uniform"}, "note": "string"},
                "checks": ["day >= date.fromisoformat(parent['customer']['since'])"],
            },
        },
    }
    dataset = spec.from_dict(document)
    tables, _ = generate.generate_dataset(spark, dataset, str(tmp_path / "out"))
    assert tables["orders"].count() == 20
    assert tables["orders"].join(tables["customers"], F.col("customer") == tables["customers"].id, "left_anti").count() == 0
    path = str(tmp_path / "d.sqlite")
    write_sqlite(tables, {t.name: t for t in dataset.tables}, path)
    assert read_sqlite(spark, path, "orders").count() == 20
    assert Store(spark, str(tmp_path / "out")).load(dataset.table("orders")).count() == 20


def test_impossible_tables_give_up(spark, tmp_path):
    dataset = spec.from_dict({"seed": 1, "fields": {"n": {"type": "integer", "min": 0, "max": 9}}, "checks": ["n > 10"], "count": 5, "batch_size": 50})
    with pytest.raises(generate.GenerationError, match="most rejected: check: failed"):
        generate.generate_dataset(spark, dataset, str(tmp_path / "o"))


@pytest.mark.parametrize("name", ["t.csv", "t.tsv", "t.json", "t.jsonl", "t.parquet"])
def test_round_trips(spark, tmp_path, name):
    df = spark.createDataFrame([(1, 'a "q",\nb', ["x", "y"], (1, "z")), (2, None, [], (None, "w"))], "id long, s string, a array<string>, o struct<n:long,t:string>")
    path = str(tmp_path / name)
    files.write(df, path)
    back = files.read(spark, path)
    if name[2:] in ("csv", "tsv"):
        got = files.unflatten(files.flatten(back), df.schema).select(F.col("id").cast("long"), "s", "a", F.struct(F.col("o.n").cast("long").alias("n"), F.col("o.t").alias("t")).alias("o"))
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    else:
        assert sorted(str(r.asDict(True)) for r in back.select(*df.columns).collect()) == sorted(str(r.asDict(True)) for r in df.collect())
    single = str(tmp_path / ("one_" + name))
    files.write_single(df, single)
    assert (tmp_path / ("one_" + name)).is_file()


@pytest.mark.parametrize("name", ["t.csv", "t.tsv"])
def test_blanks_at_the_ends_stay(spark, tmp_path, name):
    texts = [" lead", "trail ", "\ttab\t", "\nline\r\n", "\r", " ", "\x00", "\x00a", "a\x1a", '" ', ' ,"\r']
    path = str(tmp_path / name)
    files.write(spark.createDataFrame(list(enumerate(texts)), "i long, s string").coalesce(1), path)
    assert [r.s for r in sorted(files.read(spark, path).collect(), key=lambda r: int(r.i))] == texts


def test_report(spark):
    """A tide gauge: a level that falls all the time, a broken sensor, one station, notes from a form."""
    rows = [(n, 9000.0 - 7 * n, -999.0 if n % 40 == 3 else 20 + n * 13 % 17 / 4, "pier", f"checked the gauge as planned on round {n * 31}", n % 3 == 0) for n in range(80)]
    df = spark.createDataFrame(rows, "n long, level double, water double, station string, log string, calm boolean")
    found = report.quality_report(df, order="n")
    issues = {(i["column"], i["severity"]): i["message"] for i in found["issues"]}
    assert "Spearman -1.00" in issues["level", "medium"] and "2 outliers" in issues["water", "low"]
    assert "always 'pier'" in issues["station", "low"] and "checked the gauge" in issues["log", "medium"] or "lexical" in issues["log", "medium"]
    assert "round_number_share" not in found["columns"]["water"] and found["columns"]["calm"]["distribution"].keys() == {"true", "false"}
    text = report.render(found)
    assert text.startswith("# Quality of data set") and "| level |" in text and "* medium, level:" in text
    few = report.quality_report(df.limit(10), order="n")["columns"]["level"]
    assert "round_number_share" not in few and "row_order_correlation" not in few  # too few rows to tell


def test_report_with_a_table(spark):
    fields = {"lane": {"type": "enum", "values": ["left", "right", "bus"], "weights": [2, 1, 1]}, "speed": {"type": "integer", "min": 1, "max": 130}}
    own = spec.from_dict({"name": "traffic", "fields": fields}).tables[0]
    rows = [("left" if k < 20 else "right", 131 if k > 57 else k + 1) for k in range(60)] + [("left", 1)]
    found = report.quality_report(spark.createDataFrame(rows, "lane string, speed long"), own)
    assert found["schema"]["valid_rows"] == 59 and list(found["schema"]["violations"].values()) == [2]
    assert found["duplicate_rows"] == 2 and found["columns"]["lane"]["target"] == {"left": 0.5, "right": 0.25, "bus": 0.25}
    assert any(i["column"] == "lane" and i["severity"] == "high" for i in found["issues"])


def test_inference(spark):
    rows = [(i, ["free", "pro", "team"][i % 3], float(2 ** (i % 12)) + 0.25, f"long comment number {i} " * 6, f"2024-01-{i % 28 + 1:02d}", "true" if i % 2 else "false", None if i % 4 else f"u{i}@x.org") for i in range(120)]
    doc = infer.infer(spark.createDataFrame(rows, "id long, plan string, amount double, comment string, day string, active string, mail string"))
    by = {f["name"]: f for f in doc["fields"]}
    assert by["id"]["generator"] == "sequence" and by["plan"]["type"] == "enum" and by["amount"]["distribution"]["type"] == "lognormal"
    assert by["day"]["type"] == "date" and by["active"]["type"] == "boolean" and by["mail"]["type"] == "email" and by["mail"]["null_rate"] == 0.75
    assert "comment number" not in json.dumps(doc)


def test_patterns_of_another_dialect(spark):
    from tallyloom.functions.text import java_pattern

    texts = ["ab-ab", "ab-ba", "été-été", "x", "a_b"]
    for pattern in (r"(?P<a_b>\w+)-(?P=a_b)", r"\w+\Z", r"[a-z]+-\w+"):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r.ok for r in df.select("t", F.col("t").rlike(rf"\A(?:{java_pattern(pattern)})\z").alias("ok")).collect()]
        assert got == [re.fullmatch(pattern, t) is not None for t in texts], pattern
    with pytest.raises(ValueError):
        java_pattern(r"(a)?(?(1)b|c)")


def test_bounded_draws(spark):
    df = spark.range(20_000)
    for kind, params, low, high in (("normal", {"mean": 0.0, "std": 1.0}, 4.0, 4.5), ("normal", {"mean": 0.0, "std": 1.0}, None, -6.0), ("lognormal", {"median": 10.0, "sigma": 1.0}, 9.0, 11.0), ("exponential", {"mean": 1.0}, 3.0, None)):
        r = df.select(rng.bounded(kind, params, low, high, "s", F.col("id")).alias("v")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.avg("v").alias("m"), F.count_distinct("v").alias("d")).first()
        assert (low is None or r.a >= low) and (high is None or r.b <= high) and r.d > 19_000, (kind, r)
    third = df.select((rng.bounded("normal", {"mean": 0.0, "std": 1.0}, 0.0, None, "s", F.col("id")) < 1).cast("double").alias("x")).agg(F.avg("x")).first()[0]
    assert abs(third - 0.6827) < 0.015


def test_acceptance(spark):
    df = spark.createDataFrame([(1, " A  b"), (2, "a B"), (3, None), (4, None), (5, "c")], "s long, v string")
    assert sorted(r.s for r in accept.first_wins(df, ["v"], "s").collect()) == [1, 3, 4, 5]
    taken = spark.createDataFrame([("C",)], "v string")
    assert sorted(r.s for r in accept.first_wins(df, ["v"], "s", taken).collect()) == [1, 3, 4]
    assert sorted(r._number for r in accept.numbered(df, "s", 10).collect()) == [10, 11, 12, 13, 14]


def test_metrics_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([], "v double, s string")
    assert metrics.order_trend(df, "v", "v").first()["rho"] is None
    assert metrics.entropy(df, "s").first()["entropy"] is None
    one = spark.createDataFrame([(1.0, "x")] * 30, "v double, s string")
    assert metrics.entropy(one, "s").first()["entropy"] == 1.0 and metrics.outliers(one, "v").first()["outliers"] == 0


def test_exact_quantiles_hold_no_table_of_values(spark, monkeypatch):
    """As Spark's exact percentile has them, for every size and also where the brackets miss."""
    at = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    for n, summary in ((0, 4_000), (1, 4_000), (2, 4_000), (7, 4_000), (10, 4_000), (999, 4_000), (30_000, 4_000), (30_000, 100)):
        monkeypatch.setattr(metrics, "SUMMARY", summary)
        i = F.col("id")
        df = spark.range(0, n, 1, 3).select((F.xxhash64(i) / 1e9).alias("a"), F.when(i % 10 < 8, 5).otherwise(i % 97).alias("b"), F.when(i % 3 > 0, i).alias("c"), F.lit(None).cast("double").alias("d"))
        want = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, at))).alias(c) for c in df.columns)).first().asDict()
        got = metrics.quantiles(df, {c: F.col(c) for c in df.columns}, at)
        assert {c: q if q[0] is not None else None for c, q in got.items()} == want, (n, summary)
    plan = metrics.numeric(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_trend_with_ranks_found_once(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(0, 500, 1, 4).select(i.alias("o"), (i * i % 83).alias("few"), (F.xxhash64(i) % 10**9 + i * 3_000_000).alias("many"), F.when(i % 2 > 0, 7).otherwise(i).alias("hot"))
    places = metrics.ranked(df, "o", "place")
    seen = metrics.frequencies(df, {c: F.col(c) for c in df.columns})
    assert (seen["o"], seen["hot"]["top"]) == ({"distinct": 500, "top": 1, "share": 0.002}, 250) and seen["few"]["distinct"] == 42
    for few, hot in ((10**6, 10**6), (0, 10**6), (0, 0)):  # broadcast ranks, rows ranked in place, ranks joined
        monkeypatch.setattr(metrics, "FEW_VALUES", few)
        monkeypatch.setattr(metrics, "HOT_ROWS", hot)
        for c in ("few", "many", "hot"):
            assert metrics.order_trend(places, c, "place", "place", seen[c]).first() == metrics.order_trend(df, c, "o").first(), (few, hot, c)


def test_nulls_in_a_sequence(spark):
    """Rows without a value at the end leave a sequence one; a null before or a fall does not."""
    df = spark.range(0, 30, 1, 3).select(F.col("id").alias("o"), F.when(F.col("id") < 25, F.col("id") + 4).alias("up"), (-F.col("id")).alias("down"), F.when(F.col("id") > 0, F.col("id")).alias("late"))
    assert [infer.in_row_order(df, c, "o") for c in ("up", "down", "late")] == [True, False, False]


def test_sqlite_rows_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from tallyloom.sources import sqlite

    own = {t.name: t for t in spec.from_dict({"tables": {"p": {"fields": {"k": {"type": "integer", "generator": "sequence"}, "n": "string"}}, "c": {"fields": {"k": {"type": "integer", "generator": "sequence"}, "p": {"ref": "p.k"}, "s": "string"}}}}).tables}
    p = spark.range(0, 40, 1, 3).withColumnRenamed("id", "k")
    c = spark.range(0, 3_000, 1, 5).select(F.col("id").alias("k"), (F.col("id") % 40).alias("p"), F.when(F.col("id") % 7 > 0, "a'é").alias("s"))
    want, path = sorted(map(tuple, c.collect()), key=str), str(tmp_path / "a b.sqlite")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows came to the driver"))
        write_sqlite({"c": c, "p": p}, own, path)
        with pytest.raises(sqlite.sqlite3.IntegrityError, match="FOREIGN KEY"):
            write_sqlite({"c": c.withColumn("p", F.col("p") + 1), "p": p}, own, path)
    inserted = sqlite._inserted
    monkeypatch.setattr(sqlite, "_inserted", lambda at, *rest: inserted(at + "x", *rest))  # tasks that do not see the file
    away = str(tmp_path / "away.sqlite")
    write_sqlite({"c": c, "p": p}, own, away)
    for each in (path, away):
        with sqlite.sqlite3.connect(each) as db:
            assert sorted(db.execute("SELECT * FROM c").fetchall(), key=str) == want
        assert sqlite.table_names(each) == ["c", "p"]
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a b.sqlite", "away.sqlite"]


def test_a_fall_is_told_without_numbering(spark, monkeypatch):
    monkeypatch.setattr(infer, "numbered", lambda *_: pytest.fail("rows were numbered"))
    df = spark.range(0, 30, 1, 3).select(F.col("id").alias("o"), (-F.col("id")).alias("down"))
    assert not infer.in_row_order(df, "down", "o")


def test_word_pairs_are_counted_in_small_tasks(spark, monkeypatch):
    """A task's partial counts grow with its text, so long tables are dealt by size; the figures stay."""
    from tallyloom.functions import text

    df = spark.range(0, 200, 1, 1).select(F.concat_ws(" ", F.lit("to be or not to be"), F.col("id") % 7, F.col("id")).alias("t"))
    words, sizes = text.words(F.col("t")), []
    whole = metrics.ngram_diversity(df, words).first()
    monkeypatch.setattr(metrics, "TASK_CHARS", 500)
    real = metrics.spread
    monkeypatch.setattr(metrics, "spread", lambda *a: sizes.append(real(*a)) or sizes[-1])
    assert metrics.ngram_diversity(df, words, F.length("t")).first() == whole
    chars = [r.n for r in sizes[0].groupBy(F.spark_partition_id()).agg(F.sum(F.length("t")).alias("n")).collect()]
    assert len(chars) > 5 and max(chars) < 1_000


def test_report_of_records_in_one_part(spark, monkeypatch):
    """Records are judged in several tasks though they come in one part; score and issues stay."""
    own = spec.from_dict({"name": "s", "fields": {"n": {"type": "integer", "unique": True}, "v": "number", "s": {"type": "string", "max_length": 3}}}).tables[0]
    i = F.col("id")
    df = spark.range(0, 300, 1, 1).select(i.alias("n"), F.when(i % 50 == 0, -1e9).otherwise(i * 7919 % 101 + 0.5).alias("v"), F.concat(F.lit("k"), i % 120).alias("s"))
    whole = report.quality_report(df, own, order="n")
    parts, real = [], validate.validate
    monkeypatch.setattr(validate, "validate", lambda rows, *rest: parts.append(rows.rdd.getNumPartitions()) or real(rows, *rest))
    monkeypatch.setattr(report, "SPREAD_ROWS", 50)
    assert report.quality_report(df, own, order="n") == whole and parts == [7]
    assert whole["columns"]["v"]["p50"] == df.agg(F.percentile("v", 0.5)).first()[0] and whole["columns"]["v"]["outliers"] == 6
    assert whole["columns"]["n"]["row_order_correlation"] == 1.0 and whole["schema"]["violations"]


def test_streaming(spark, tmp_path):
    from tallyloom.streaming.ingest import append_valid

    table = spec.from_dict({"fields": {"n": {"type": "integer", "min": 0}}}).tables[0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"n": 1}\n{"n": -1}\n{"n": "x"}\n{"n": 4}\n')
    stream = spark.readStream.text(str(tmp_path / "in"))
    append_valid(stream, table, str(tmp_path / "ok"), str(tmp_path / "cp"), str(tmp_path / "no")).awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [1, 4]
    assert spark.read.parquet(str(tmp_path / "no")).count() == 2


def test_cli(spark, tmp_path, monkeypatch, capsys):
    from tallyloom import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "s.json").write_text(json.dumps({"name": "t", "fields": {"id": {"type": "integer", "generator": "sequence"}, "name": "string"}, "count": 4}))
    assert cli.main(["check", "s.json", "--show-prompt"]) == 0
    assert cli.main(["generate", "s.json", "--seed", "3", "--format", "csv,jsonl"]) == 0
    assert cli.main(["generate", "s.json"]) == 2
    assert cli.main(["validate", "out/export/t.jsonl", "--schema", "s.json", "--json"]) == 0
    assert cli.main(["export", "out/export/t.jsonl", "--schema", "s.json", "--output", "one.json"]) == 0
    assert len(json.loads((tmp_path / "one.json").read_text())) == 4
    assert cli.main(["define", "d.json", "--from-sample", "one.json"]) == 0
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["files"]
