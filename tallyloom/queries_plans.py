"""Driver queries of planning and generation."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .operators import accept
from .plans import generate, slots, spec
from .plans.provider import OfflineProvider, matched, salvage
from .registry import query, table
from .sources.shared import shared_dir


def _cards() -> dict:
    return {
        "name": "cards",
        "count": 100,
        "batch_size": 20,
        "seed": 11,
        "strict_distribution": True,
        "fields": {
            "id": {"type": "string", "generator": "sequence", "format": "K-{:05d}", "start": 40},
            "token": {"type": "uuid", "generator": "uuid"},
            "suit": {"type": "enum", "values": ["acorns", "bells", "leaves"], "weights": {"acorns": 0.5, "bells": 0.3, "leaves": 0.2}},
            "value": {"type": "integer", "min": 2, "max": 14, "distribution": "uniform"},
            "note": "string",
        },
        "checks": ["value > 1"],
    }


@query("SELECT scenario, count(*) AS n, count(DISTINCT slot_id // 4)::BIGINT AS cycles FROM (SELECT unnest(range(200)) AS slot_id, ['calm', 'rush', 'storm', 'night'][1 + slot_id % 4] AS scenario) GROUP BY scenario")
def scenario_round_robin(spark, sf_dir):
    """Every scenario once in each cycle."""
    own = spec.from_dict(_cards()).tables[0]
    plan = slots.plan(spark, own, 0, 200, 5, scenarios=["calm", "rush", "storm", "night"])
    return plan.groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("slot_id") / 4)).alias("cycles"))


@query("SELECT * FROM (VALUES ('acorns', 50::BIGINT, 2, 14), ('bells', 30::BIGINT, 2, 14), ('leaves', 20::BIGINT, 2, 14)) t(suit, n, low, high)")
def planned_labels(spark, sf_dir):
    """Stratified labels by quota, sampled values within their bounds."""
    plan = slots.plan(spark, spec.from_dict(_cards()).tables[0], 0, 100, 5)
    ok = F.col("_fixed_value").between(2, 14)
    return plan.where(ok).groupBy(F.col("_fixed_suit").alias("suit")).agg(F.count("*").alias("n"), F.lit(2).alias("low"), F.lit(14).alias("high"))


@query("SELECT 100::BIGINT AS rows, 'K-00040' AS first, 'K-00139' AS last, 100::BIGINT AS tokens, 50::BIGINT AS acorns, 30::BIGINT AS bells, 20::BIGINT AS leaves, true AS resumed")
def generated_records(spark, sf_dir):
    """A whole run with a provider that misbehaves, resumed once."""
    folder = f"{shared_dir(spark)}/cards-{uuid.uuid4().hex}"
    dataset = spec.from_dict(_cards())
    provider = OfflineProvider(3, invalid_rate=0.1, disobey_rate=0.1, duplicate_rate=0.05, shuffle=True, extra_record=True)
    generate.generate_dataset(spark, dataset, folder, provider, counts={"cards": 60})
    tables, stats = generate.generate_dataset(spark, dataset, folder, provider, resume=True)
    labels = [F.count_if(F.col("suit") == x).alias(x) for x in ("acorns", "bells", "leaves")]
    done = stats["cards"]
    resumed = F.lit(done.accepted == 100 and done.rounds >= 2 and done.rejected.get("record: extra record", 0) > 0)
    return tables["cards"].agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("token").alias("tokens"), *labels, resumed.alias("resumed"))


@query("SELECT o_orderkey, sha256('{\"c0\":\"' || lower(trim(o_orderpriority)) || '\",\"c1\":' || o_custkey || '}') AS digest FROM orders")
def content_hashes(spark, sf_dir):
    """Hash of what a provider wrote: folded text, no coded or sampled fields."""
    own = spec.from_dict({"fields": {"k": {"type": "integer", "generator": "sequence"}, "priority": "string", "who": "integer", "x": {"type": "integer", "min": 0, "max": 9, "distribution": "uniform"}}}).tables[0]
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("priority"), F.col("o_custkey").alias("who"), F.lit(3).alias("x"))
    return df.select("o_orderkey", accept.content_hash(df, own).alias("digest"))


@query("SELECT * FROM (VALUES ('whole', 2, true, ''), ('list', 1, true, ''), ('torn', 2, false, ''), ('talk', 0, false, ''), ('pairs', 3, true, '0:b 1:a 2:c | record: extra record=1 record: malformed=1')) t(answer, records, is_whole, pairs)")
def salvaged_answers(spark, sf_dir):
    """Records of whole and torn answers, and their places."""
    answers = {"whole": '{"records": [{"a": 1}, {"a": 2}]}', "list": '[{"a": 1}]', "torn": '{"records": [{"a": 1}, {"a": 2}, {"a', "talk": "I would rather not."}
    rows = [(k, len(salvage(v)[0]), salvage(v)[1], "") for k, v in answers.items()]
    given = [{"_slot": 1, "v": "a"}, 7, {"_slot": 1, "v": "b"}, {"v": "c"}, {"_slot": 99, "v": "d"}]
    pairs, lost = matched([{"slot_id": i} for i in range(3)], given)
    said = " ".join(f"{s['slot_id']}:{r['v']}" for s, r in pairs) + " | " + " ".join(f"{k}={v}" for k, v in sorted(lost.items()))
    return spark.createDataFrame([*rows, ("pairs", len(pairs), True, said)], "answer string, records int, is_whole boolean, pairs string")


_TRADE = {
    "tables": {
        "sale": {"fields": {"id": {"type": "integer", "generator": "sequence"}, "shop": {"ref": "shop.id"}, "item": {"ref": "item.code"}, "n": {"type": "integer", "min": 1}}},
        "item": {"fields": {"code": {"type": "string", "unique": True}, "shop": {"ref": "shop.id"}}},
        "shop": {"fields": {"id": {"type": "integer", "generator": "sequence"}, "town": "string"}},
    }
}


@query("SELECT * FROM (VALUES (0, 'shop', '', ''), (1, 'item', 'shop>shop.id:integer', ''), (2, 'sale', 'shop>shop.id:integer item>item.code:string', '')) t(place, name, refs, problem) UNION ALL SELECT * FROM (VALUES (9, 'unknown table', '', 'refused'), (9, 'no such field', '', 'refused'), (9, 'not unique', '', 'refused'), (9, 'cycle', '', 'refused')) u(place, name, refs, problem)")
def relation_order(spark, sf_dir):
    """Parents first, references with the types of their targets, wrong ones refused."""
    d = spec.from_dict(_TRADE)
    rows = [(i, t.name, " ".join(f"{f.name}>{f.ref}:{f.type}" for f in t.refs), "") for i, t in enumerate(d.ordered())]
    wrong = {"unknown table": "depot.id", "no such field": "shop.zone", "not unique": "shop.town"}
    for name, ref in wrong.items():
        rows.append((9, name, "", _refused(_TRADE["tables"] | {"sale": {"fields": {"n": "integer", "x": {"ref": ref}}}})))
    ring = {x: {"fields": {"id": {"type": "integer", "unique": True}, "o": {"ref": f"{y}.id"}}} for x, y in (("a", "b"), ("b", "c"), ("c", "a"))}
    return spark.createDataFrame([*rows, (9, "cycle", "", _refused(ring))], "place int, name string, refs string, problem string")


def _refused(tables: dict) -> str:
    try:
        spec.from_dict({"tables": tables})
    except spec.SpecError:
        return "refused"
    return ""


@query("SELECT * FROM (VALUES ('suit', '{\"enum\":[\"acorns\",\"bells\",\"leaves\"]}'), ('value', '{\"maximum\":14,\"minimum\":2,\"type\":\"integer\"}'), ('note', '{\"type\":\"string\"}'), ('id', '{\"type\":\"string\"}'), ('token', '{\"format\":\"uuid\",\"type\":\"string\"}'), ('*', '{\"depth\":1,\"enum_values\":3,\"objects\":1,\"optional\":0,\"properties\":5,\"unions\":0}')) t(field, schema)")
def compiled_json_schema(spark, sf_dir):
    """JSON Schema of finished records, and its size."""
    full = spec.full_schema(spec.from_dict(_cards()).tables[0])
    rows = [(k, json.dumps(v, sort_keys=True, separators=(",", ":"))) for k, v in full["properties"].items()]
    return spark.createDataFrame([*rows, ("*", json.dumps(spec.complexity(full), sort_keys=True, separators=(",", ":")))], "field string, schema string")


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM (SELECT o_orderkey, least(floor((('0x' || substr(md5('7|ctx|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0) * n), n - 1)::BIGINT AS d FROM orders, (SELECT count(*) AS n FROM customer)) s JOIN (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5('7|ctx|popularity|' || c_custkey), c_custkey) - 1 AS k FROM customer) p ON p.k = s.d")
def fk_with_context(spark, sf_dir):
    """References with columns of the parent that they drew."""
    drawn = slots.pick_parents(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer"), "c_custkey", 0, "7", "ctx", context=["c_mktsegment"], key_name="o_orderkey")
    return drawn.select("o_orderkey", "_parent.c_custkey", "_parent.c_mktsegment")
