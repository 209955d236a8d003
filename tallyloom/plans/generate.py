"""Generation in rounds: plan slots, ask the provider, validate as columns, accept, commit.

A provider need not be deterministic, so its answers are written before anything reads them twice.  A round is committed
by the store's state file; a lost run resumes after the last committed round with the numbering and quotas it left.
"""

from __future__ import annotations

import json
import math
import random
import secrets
import time
from collections import Counter, deque
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accept, validate
from ..sources.shared import written
from ..sources.store import Store
from . import slots as planning
from .provider import OfflineProvider, Provider, matched, planned_scenarios, salvage
from .spec import Dataset, Settings, Table

STALLS = 6  # rounds without a record after which a run gives up
LEAST_ACCEPTANCE = 0.5  # over-provisioning assumes no less
KNOWN_AFTER = 20  # returned records from which the acceptance rate is used
RECENT, AVOIDED = 400, 40  # values of a field that are remembered, and of these shown to the provider
SHRINK = 0.6  # of the batch size, after a round in which answers were cut off
FILL, KEEP = 0.75, 0.7  # share of the provider's token limit that a batch may take; weight of the tokens a record so far
BUDGET = (4, 20)  # slots asked for at most: that many times the target, more for small targets


class GenerationError(RuntimeError):
    """The target can't be reached; what was accepted is committed."""


@dataclass
class Stats:
    target: int = 0
    accepted: int = 0
    returned: int = 0
    asked: int = 0
    repaired: int = 0
    refusals: int = 0
    truncations: int = 0
    rounds: int = 0
    seconds: float = 0.0
    batch_size: int = 0
    tokens_per_record: float = 0.0
    scenarios: list[str] = field(default_factory=list)
    rejected: dict[str, int] = field(default_factory=dict)

    @property
    def acceptance(self) -> float:
        return self.accepted / self.returned if self.returned else 1.0

    @property
    def rate(self) -> float:
        return self.accepted / self.seconds if self.seconds else 0.0

    def as_dict(self) -> dict[str, Any]:
        return asdict(self) | {"acceptance": round(self.acceptance, 4), "records_per_second": round(self.rate, 2)}


def _response_schema() -> str:
    return "slot_id long, record string, repaired long, fault string, tokens double"


def _asker(table: Table, provider: Provider, feedback: list[str], avoid: dict[str, list[str]]):
    """One batch of slots -> one row a slot: the assembled record as JSON, or the fault of its response."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        todo = []
        for r in batch.sort_values("slot_id").itertuples():
            plan = json.loads(r.plan)
            todo.append({"slot_id": int(r.slot_id), "fixed": plan.get("fixed") or {}, "refs": plan.get("refs") or {}, "nulls": plan.get("nulls") or [], "scenario": plan.get("scenario"), "edge_case": plan.get("edge_case")})
        text = provider.respond(table, todo, feedback, avoid)
        records, whole = salvage(text)
        tokens = len(text) / 4 / len(records) if whole and records else None  # four characters a token
        fault = None if whole else "truncated" if records else "refused"
        out, seen = [], set()
        pairs, lost = matched(todo, records)
        for slot, record in pairs:
            done, repaired = assemble(table, slot, record)
            seen.add(slot["slot_id"])
            out.append((slot["slot_id"], done, repaired, fault, tokens))
        out += [(s["slot_id"], None, 0, fault or "missing", None) for s in todo if s["slot_id"] not in seen]
        out += [(None, None, n, reason, None) for reason, n in lost.items()]  # counted only
        return pd.DataFrame(out, columns=["slot_id", "record", "repaired", "fault", "tokens"])

    return run


def assemble(table: Table, slot: dict[str, Any], record: Any) -> tuple[str, int]:
    """The record in field order, planned values put over the provider's; how many had to be put right."""
    if not isinstance(record, dict):
        return json.dumps(record, default=str), 0
    out, repaired = {}, 0
    for f in table.fields:
        if f.generator:
            continue
        if f.ref:
            out[f.name] = slot["refs"][f.name][f.target[1]]
            continue
        planned = None if f.name in slot["nulls"] else slot["fixed"].get(f.name, record.get(f.name))
        if f.name in slot["nulls"] or f.name in slot["fixed"]:
            repaired += record.get(f.name) != planned
            out[f.name] = planned
        elif f.name in record:
            out[f.name] = record[f.name]
    out |= {k: v for k, v in record.items() if k not in {f.name for f in table.fields}}
    return json.dumps(out, default=str), repaired


class _Recent:
    """The last values of the fields that should not repeat: those named, and unique text."""

    def __init__(self, table: Table, have: DataFrame, seed: int | None):
        unique = [f.name for f in table.provided if f.unique and f.type in ("string", "text", "email", "url")]
        self.seed, self.held = seed, {k: deque(maxlen=RECENT) for k in dict.fromkeys([*table.diversity.avoid_repeats, *unique])}
        self.add(have)

    def add(self, rows: DataFrame) -> None:
        for r in rows.select(*(F.col(f"`{k}`").cast("string") for k in self.held)).limit(RECENT).collect() if self.held else ():
            for k, v in zip(self.held, r, strict=True):
                if v is not None:
                    self.held[k].append(v)

    def shown(self, number: int) -> dict[str, list[str]]:
        pick = random.Random(f"{self.seed}|avoid|{number}")
        return {k: pick.sample(list(v), min(AVOIDED, len(v))) for k, v in self.held.items() if v}


def _batch_size(table: Table, settings: Settings, stats: Stats) -> int:
    size = stats.batch_size or table.batch_size
    if stats.tokens_per_record:
        size = min(size, int(FILL * settings.max_tokens / stats.tokens_per_record))
    return max(1, size)


def _planned(slots: DataFrame, table: Table) -> DataFrame:
    """``(slot_id, plan)``: the plan as JSON."""
    fixed = [F.col(c).alias(c[7:]) for c in slots.columns if c.startswith("_fixed_")]
    refs = [F.col(c).alias(c[5:]) for c in slots.columns if c.startswith("_ref_")]
    parts = [F.col("nulls"), F.col("scenario"), F.col("edge_case")]
    parts += [F.struct(*fixed).alias("fixed")] if fixed else []
    parts += [F.struct(*refs).alias("refs")] if refs else []
    return slots.select("slot_id", "_batch", F.to_json(F.struct(*parts)).alias("plan"))


def _deficits(table: Table, have: DataFrame, target: int) -> dict[str, dict[Any, int]]:
    """Labels still wanted for each stratified field; nulls planned for a field shrink its target."""
    out = {}
    for f in table.where(lambda f: f.stratify and not f.from_code):
        goal = round(target * (1 - (f.null_rate or 0)))
        want = dict(zip(f.values, planning.apportioned(goal, f.weights), strict=True))
        seen = {r[0]: r[1] for r in have.where(F.col(f"`{f.name}`").isNotNull()).groupBy(f"`{f.name}`").count().collect()}
        out[f.name] = {v: max(0, n - seen.get(v, 0)) for v, n in want.items()}
    return out


def _stretched(want: dict[Any, int], total: int) -> list[tuple]:
    """Deficits as counts that sum up to ``total`` slots, in proportion."""
    weights = [n or 0 for n in want.values()]
    if not sum(weights):
        weights = [1] * len(want)
    return list(zip(want, planning.apportioned(total, weights), strict=True))


def generate_table(spark: SparkSession, table: Table, settings: Settings, store: Store, provider: Provider, parents: dict[str, DataFrame], target: int | None = None, scenarios: list[str] | None = None, log=lambda text: None) -> Stats:
    """Rounds until ``target`` records of ``table`` are committed."""
    target = target or table.count
    state = store.state(table.name)
    stats = Stats(**{k: v for k, v in state.get("stats", {}).items() if k in Stats.__dataclass_fields__}) if state else Stats()
    stats.target = target
    began, before = time.time(), stats.seconds
    seed, rejected, stalls = settings.seed, Counter(stats.rejected), 0
    parent_specs = {f.name: f for f in table.refs}
    checked = replace(table, fields=table.where(lambda f: not f.generator))
    scenarios = scenarios or stats.scenarios or planned_scenarios(table, provider, log)
    stats.scenarios = list(scenarios)
    recent = _Recent(table, store.load(table), seed)
    while stats.accepted < target:
        missing = target - stats.accepted
        rate = max(LEAST_ACCEPTANCE, stats.acceptance) if stats.returned >= KNOWN_AFTER else 1.0
        n = math.ceil(missing / rate)
        if stats.asked + n > target * (BUDGET[0] if target >= 100 else BUDGET[1]) or stalls >= STALLS:
            why = ", ".join(f"{k} ({v})" for k, v in rejected.most_common(4))
            raise GenerationError(f"table '{table.name}': {stats.accepted} of {target} records after {stats.asked} slots; most rejected: {why}")
        have = store.load(table)
        deficits = _deficits(table, have, target)
        quotas = {k: _stretched(v, n) for k, v in deficits.items()}
        number = stats.rounds
        slots = written(planning.plan(spark, table, stats.asked, n, seed, parents, quotas, scenarios), "slots")  # read three times
        slots = slots.withColumn("_batch", F.floor((F.col("slot_id") - stats.asked) / _batch_size(table, settings, stats)))
        feedback = [k for k, _ in rejected.most_common(5)]
        plans = _planned(slots, table)
        asked = plans.repartition(settings.concurrency, "_batch").groupBy("_batch").applyInPandas(_asker(table, provider, feedback, recent.shown(number)), _response_schema())
        raw = f"{store.table_path(table.name)}/responses={number}"
        asked.write.mode("overwrite").parquet(raw)
        answers = spark.read.schema(_response_schema()).parquet(raw)
        contexts = {name: (F.col(f"_ref_{name}"), slots.schema[f"_ref_{name}"].dataType) for name in parent_specs}
        joined = answers.where("record IS NOT NULL").join(slots, "slot_id").withColumn("_record", F.try_parse_json("record"))
        judged = validate.validate(joined, checked, contexts or None)
        judged = judged.withColumn("_errors", F.when(F.size("_errors") > 0, F.col("_errors")).otherwise(_unplanned(table)))
        judged = judged.persist()
        good = judged.where(F.size("_errors") == 0)
        valid = good.count()
        for f in table.where(lambda f: f.unique and not f.generator):
            good = accept.first_wins(good, [f.name], "slot_id", have)
        unique = good.withColumn("_content", accept.content_hash(good, table))
        known = have.withColumn("_content", accept.content_hash(have, table)) if stats.accepted else None
        unique = accept.first_wins(unique, ["_content"], "slot_id", known)
        if table.strict_distribution:
            for name, want in deficits.items():
                unique = accept.cap(unique, name, want, "slot_id")
        taken = accept.numbered(unique, "slot_id", 0).where(F.col("_number") < missing)
        final = _finished(taken, table, seed, stats.accepted)
        first = final.count()
        own = F.when(F.col("slot_id").isNotNull(), F.col("repaired"))
        counts = answers.agg(F.count_if(F.col("record").isNotNull()), F.coalesce(F.sum(own), F.lit(0)), F.count_if(F.col("fault") == "refused"), F.count_if(F.col("fault") == "truncated"), F.avg("tokens")).first()
        for r in answers.where("slot_id IS NULL").groupBy("fault").agg(F.sum("repaired").alias("n")).collect():  # two reasons at most
            rejected[r.fault] += r.n
            stats.returned += r.n
        for r in validate.roll_up(judged, 50).collect():
            rejected[r["category"]] += r["n"]
        if valid > first:
            rejected["duplicate, over quota or over target"] += valid - first
        stats.returned += counts[0]
        stats.repaired += counts[1]
        stats.refusals += counts[2]
        stats.truncations += counts[3]
        if counts[3]:
            stats.batch_size = max(1, int(SHRINK * (stats.batch_size or table.batch_size)))
        if counts[4]:
            stats.tokens_per_record = KEEP * stats.tokens_per_record + (1 - KEEP) * counts[4] if stats.tokens_per_record else counts[4]
        stats.asked += n
        stats.rounds += 1
        stats.accepted += first
        stats.seconds = before + time.time() - began
        stats.rejected = dict(rejected)
        stalls = 0 if first else stalls + 1
        store.append(table.name, final, number, store.state(table.name) | {"stats": asdict(stats), "target": target, "seed": seed})
        judged.unpersist()
        recent.add(final)
        log(f"{table.name}: {stats.accepted}/{target} after round {number}, acceptance {stats.acceptance:.0%}")
    return stats


def _unplanned(table: Table):
    """A null in a field with a null rate stands only where one was planned."""
    found = [F.when(F.col(f"`{f.name}`").isNull() & ~F.array_contains("nulls", f.name), F.struct(F.lit(f.name).alias("path"), F.lit("null was not planned for this record").alias("reason"))) for f in table.provided if f.null_rate]
    empty = F.array().cast("array<struct<path:string,reason:string>>")
    return F.array_compact(F.array(*found)) if found else empty


def _finished(rows: DataFrame, table: Table, seed: int, offset: int) -> DataFrame:
    """Final records in field order: sequence numbers are gapless over what was accepted before."""
    cols = []
    for f in table.fields:
        if f.generator == "uuid":
            value = planning.uuid_text(seed, table.name, f.name, F.col("slot_id"))
        elif f.generator == "sequence":
            value = planning.sequence_text(F.col("_number") + f.start + offset, f.format, f.type)
        else:
            value = F.col(f"`{f.name}`")
        cols.append(value.cast(f.spark_type()).alias(f.name))
    return rows.select(*cols)


def generate_dataset(spark: SparkSession, dataset: Dataset, folder: str, provider: Provider | None = None, only: list[str] | None = None, counts: dict[str, int] | None = None, resume: bool = False, scenarios: dict[str, list[str]] | None = None, log=lambda text: None) -> tuple[dict[str, DataFrame], dict[str, Stats]]:
    """All tables, parents first.  Tables left out by ``only`` are read from the folder if others refer to them."""
    store, provider = Store(spark, folder), provider or OfflineProvider()
    settings = dataset.settings
    tables: dict[str, DataFrame] = {}
    stats: dict[str, Stats] = {}
    for t in dataset.ordered():
        state = store.state(t.name)
        own = replace(settings, seed=settings.seed if settings.seed is not None else state.get("seed", secrets.randbits(31)))
        if only and t.name not in only:
            if any(f.target[0] == t.name for o in dataset.tables if o.name in only for f in o.refs) and not state.get("rounds"):
                raise GenerationError(f"table '{t.name}' is referred to, but {folder} has no records of it")
        else:
            if not resume:
                store.reset(t.name)
            stats[t.name] = generate_table(spark, t, own, store, provider, tables, (counts or {}).get(t.name), (scenarios or {}).get(t.name), log)
        tables[t.name] = store.load(t)
    return tables, stats
