"""Acceptance of provider records: uniqueness, quotas, numbering.  All deterministic by slot order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..plans.spec import Table
from ..sources.shared import written

RANGE_ROWS = 1_000_000


def unique_key(df: DataFrame, name: str) -> Column:
    """Key under which values of a unique field count as equal."""
    c = F.col(f"`{name}`")
    return collapsed(c) if dict(df.dtypes)[name] == "string" else c


def first_wins(df: DataFrame, keys: list[str], order: str, accepted: DataFrame | None = None) -> DataFrame:
    """Of rows with equal keys the first by ``order`` stays; none whose key is in ``accepted``; null keys never clash.

    The winner is a partial aggregation, so a hot key costs one row a task, and only winners are joined back.
    """
    out = df
    for k in keys:
        key = unique_key(out, k)
        best = out.select(key.alias("_key"), F.col(order).alias("_at")).where("_key IS NOT NULL").groupBy("_key").agg(F.min("_at").alias("_best"))
        if accepted is not None:
            taken = accepted.select(unique_key(accepted, k).alias("_key")).distinct()
            best = best.join(taken, "_key", "left_anti")
        wins = best.select(F.col("_best").alias("_win"))
        keep_null = out.where(key.isNull())
        out = out.where(key.isNotNull()).join(wins, F.col(order) == F.col("_win"), "left_semi").unionByName(keep_null)
    return out


def cap(df: DataFrame, label: str, deficit: dict, order: str) -> DataFrame:
    """At most ``deficit[label]`` rows a label, first by ``order``; labels without an entry get none.

    The cut is found by a row number in the label's hash range of ``order`` blocks, so no label is sorted in one task.
    """
    want = df.sparkSession.createDataFrame([(str(k), int(n)) for k, n in deficit.items()], "_label string, _want long")
    rows = df.withColumn("_label", F.col(label).cast("string")).join(F.broadcast(want), "_label")
    ranged = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "cap")
    sizes = ranged.groupBy("_label", "_part").agg(F.count("*").alias("_n"))
    run = W.partitionBy("_label").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(F.col("_label").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_label", "_part").orderBy(order))
    out = ranged.withColumn("_inside", inside).join(before, (F.col("_label") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    return out.where(F.col("_before") + F.col("_inside") <= F.col("_want")).select(*df.columns)


def numbered(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """Adds ``_number``: gapless from ``start`` in ``order``, by two-level counts over range partitions.

    Ranges come from a sample and may be coalesced, so rows are written with their range's number and read by both branches.
    """
    ranged = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    out = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    return out.withColumn("_number", (F.col("_before") + F.col("_inside") + start).cast("long")).drop("_part", "_inside", "_before")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference, if not null, no parent has."""
    known = parents.select(F.col(f"`{key}`").alias("_parent_key")).distinct()
    return df.where(F.col(f"`{column}`").isNotNull()).join(known, F.col(f"`{column}`") == F.col("_parent_key"), "left_anti")


def content_hash(df: DataFrame, table: Table) -> Column:
    """Hash of what the provider wrote itself: neither coded nor sampled nor stratified fields."""
    own = [f for f in table.provided if not f.distribution and not f.stratify]
    cols = [unique_key(df, f.name) if dict(df.dtypes)[f.name] == "string" else F.col(f"`{f.name}`") for f in own or table.provided]
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cols))), {"ignoreNullFields": "false"}), 256)
