"""Slot planning: which record gets which planned value, as DataFrame operations over a counter-based generator.

Apportionment and quotas are exact; every draw depends on seed, table, field and slot only, so a plan is the same for
any number of partitions and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from .spec import Field, Table, temporal_text

BROADCAST_PARENTS = 10_000  # parents up to this number are broadcast; beyond it the pick is an equi-join


def apportion(counts: DataFrame, total: int) -> DataFrame:
    """``counts(label, idx, weight)`` -> ``(label, idx, n)``: largest remainders, ties by idx; n sums up to ``total``."""
    sums = counts.agg(F.sum("weight").alias("_all"))
    exact = counts.join(F.broadcast(sums)).withColumn("_x", F.col("weight") * total / F.col("_all"))
    exact = exact.withColumns({"_floor": F.floor("_x"), "_rest": F.round(F.col("_x") - F.floor("_x"), 9)})
    left = exact.agg((F.lit(total) - F.sum("_floor")).alias("_left"))
    rank = F.row_number().over(W.orderBy(F.desc("_rest"), "idx"))  # one row a label
    return exact.join(F.broadcast(left)).withColumn("_rank", rank).select("label", "idx", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("n"))


def apportioned(total: int, weights: list[float]) -> list[int]:
    """The same on the driver, for plans over a field's few labels."""
    all_ = sum(weights)
    exact = [w * total / all_ for w in weights]
    base = [int(x) for x in exact]
    by_rest = sorted(range(len(weights)), key=lambda i: (-round(exact[i] - base[i], 9), i))
    for i in by_rest[: total - sum(base)]:
        base[i] += 1
    return base


def shuffled_rank(df: DataFrame, key: str, *salt: str) -> DataFrame:
    """Adds ``_rank``, 0-based, in hash order of ``key``: two-level counts over hash ranges, no single sorted partition."""
    keyed = df.withColumn("_order", rng.order_key(*salt, F.col(key)))
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, 3))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))  # at most 4,096 rows
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_order", key)) - 1
    return keyed.withColumn("_inside", inside).join(F.broadcast(before), "_bucket").withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_order", "_bucket", "_inside", "_before")


def labelled(df: DataFrame, key: str, counts: list[tuple], *salt: str, name: str = "label") -> DataFrame:
    """Deals ``(label, n)`` to the rows of ``df`` in hash order: exactly n rows each; rows beyond the sum get null."""
    ranked, upto, value = shuffled_rank(df, key, *salt), 0, F.lit(None)
    bands = []
    for label, n in counts:
        bands.append((upto, upto + n, label))
        upto += n
    for low, high, label in reversed(bands):
        value = F.when((F.col("_rank") >= low) & (F.col("_rank") < high), F.lit(label)).otherwise(value)
    return ranked.withColumn(name, value).drop("_rank")


def sampled(f: Field, *key) -> Column:
    """A sampled field's value for the slot that ``key`` names."""
    d = f.distribution
    if f.type == "date":
        return rng.uniform_date(f.min.isoformat(), f.max.isoformat(), *key)
    if f.type == "datetime":
        return rng.uniform_timestamp(temporal_text(f.min), temporal_text(f.max), *key)
    if d.type == "uniform" and f.type == "integer":
        return rng.uniform_int(int(f.min), int(f.max), *key)
    value = rng.bounded(d.type, d.params, f.min, f.max, *key)
    if f.type == "integer":
        value = F.bround(value, 0).cast("long")
    elif f.decimals is not None:
        value = F.bround(value, f.decimals)
    if f.min is not None:  # rounding may have left the bounds
        value = F.greatest(value, F.lit(f.min).cast("long" if f.type == "integer" else "double"))
    if f.max is not None:
        value = F.least(value, F.lit(f.max).cast("long" if f.type == "integer" else "double"))
    return value


def uuid_text(*key) -> Column:
    """Version-4 shaped, from the key's MD5."""
    h = rng.order_key(*key)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sequence_text(n: Column, pattern: str | None, kind: str) -> Column:
    """A sequence number in a ``str.format`` pattern with one ``{}``, ``{:d}`` or ``{:0Nd}`` placeholder."""
    if not pattern:
        return n.cast("long") if kind == "integer" else n.cast("string")
    head, _, rest = pattern.partition("{")
    spec, _, tail = rest.partition("}")
    width = spec.lstrip(":").rstrip("d")
    body = F.lpad(n.cast("string"), max(1, int(width)), "0" if width.startswith("0") else " ") if width.isdigit() and int(width) else n.cast("string")
    if width.isdigit() and int(width):
        body = F.when(F.length(n.cast("string")) >= int(width), n.cast("string")).otherwise(body)
    out = F.concat(F.lit(head), body, F.lit(tail))
    return out.cast("long") if kind == "integer" else out


def pick_parents(slots: DataFrame, parents: DataFrame, key: str, skew: float, *salt: str, context: list[str] | None = None, key_name: str = "key") -> DataFrame:
    """Adds ``_parent``, a struct of ``key`` and ``context`` of the parent drawn for each slot.

    Uniform, or Zipf by popularity rank ``1 / rank ** skew`` over parents in hash order.  Uniform draws are equi-joins on the
    rank.  For Zipf the cumulative weights are cut at the draws' buckets, so that join has an equality too.
    """
    cols = list(dict.fromkeys([key, *(context or [])]))
    ranked = shuffled_rank(parents.select(*cols), key, *salt, "popularity")
    total = ranked.count()
    if not total:
        raise ValueError("there are no parents to refer to")
    own = F.struct(*cols).alias("_parent")
    u = rng.uniform(*salt, F.col(key_name))
    if not skew:
        drawn = slots.withColumn("_draw", F.least(F.floor(u * total), F.lit(total - 1)).cast("long"))
        right = ranked.select(F.col("_rank").cast("long").alias("_r"), own)
        right = F.broadcast(right) if total <= BROADCAST_PARENTS else right
        return drawn.join(right, F.col("_draw") == F.col("_r")).drop("_draw", "_r")
    weight = 1 / F.pow(F.col("_rank") + 1, F.lit(float(skew)))
    pieces = ranked.withColumns({"_w": weight, "_piece": F.floor(F.col("_rank") / 4096)})
    sums = pieces.groupBy("_piece").agg(F.sum("_w").alias("_sum"))
    run = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_piece", F.coalesce(F.sum("_sum").over(run), F.lit(0.0)).alias("_base"))  # a row for 4,096 parents
    inside = F.sum("_w").over(W.partitionBy("_piece").orderBy("_rank"))
    bands = pieces.withColumn("_in", inside).join(before, "_piece").select("_w", (F.col("_base") + F.col("_in")).alias("_hi"), own)
    top = bands.agg(F.max("_hi")).first()[0]
    bands = bands.select(((F.col("_hi") - F.col("_w")) / top).alias("_lo"), (F.col("_hi") / top).alias("_hi"), "_parent")
    # A wide band spans several buckets, but buckets are as many as parents, so bands make at most twice as many rows.
    bands = bands.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") * total), F.least(F.floor(F.col("_hi") * total), F.lit(total - 1)))))
    bands = F.broadcast(bands) if total <= BROADCAST_PARENTS else bands
    drawn = slots.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * total))
    return drawn.join(bands, "_bucket").where("_u >= _lo AND _u < _hi").drop("_u", "_lo", "_hi", "_bucket")


def plan(spark: SparkSession, table: Table, first: int, count: int, seed: int, parents: dict[str, DataFrame] | None = None, quotas: dict[str, list[tuple]] | None = None, scenarios: list[str] | None = None) -> DataFrame:
    """Slots ``first`` to ``first + count - 1``: fixed values, nulls, references with context, scenario, edge case.

    ``quotas`` gives for each stratified field the ``(label, n)`` still wanted; without it the field's weights are
    apportioned over the slots.
    """
    name = table.name
    slots = spark.range(first, first + count).withColumnRenamed("id", "slot_id")
    key = F.col("slot_id")
    nulls, fixed = [], []
    for f in table.provided:
        if f.null_rate:
            nulls.append(F.when(rng.uniform(seed, name, f.name, "null", key) < f.null_rate, F.lit(f.name)))
    slots = slots.withColumn("nulls", F.array_compact(F.array(*nulls)) if nulls else F.array().cast("array<string>"))
    for f in table.where(lambda f: f.stratify and not f.from_code):
        want = (quotas or {}).get(f.name) or list(zip(f.values, apportioned(count, f.weights), strict=True))
        slots = labelled(slots, "slot_id", want, str(seed), name, f.name, str(first), name=f"_fixed_{f.name}")
        fixed.append(f)
    for f in table.where(lambda f: f.distribution):
        slots = slots.withColumn(f"_fixed_{f.name}", sampled(f, seed, name, f.name, key))
        fixed.append(f)
    for f in fixed:
        value = F.col(f"_fixed_{f.name}").cast(f.spark_type())
        slots = slots.withColumn(f"_fixed_{f.name}", F.when(~F.array_contains("nulls", f.name), value))
    for f in table.refs:
        parent, target = f.target
        slots = pick_parents(slots, parents[parent], target, f.ref_skew, str(seed), name, f.name, context=f.ref_context, key_name="slot_id").withColumnRenamed("_parent", f"_ref_{f.name}")
    if scenarios:
        n = len(scenarios)
        cycle = F.floor(key / n)
        pos = F.row_number().over(W.partitionBy("_cycle").orderBy(rng.order_key(seed, name, "scenario", key))) - 1
        slots = slots.withColumn("_cycle", cycle).withColumn("scenario", F.array(*map(F.lit, scenarios))[pos]).drop("_cycle")
    else:
        slots = slots.withColumn("scenario", F.lit(None).cast("string"))
    edge = rng.uniform(seed, name, "edge", key) < table.diversity.edge_case_ratio
    return slots.withColumn("edge_case", edge)

