"""Streaming intake: records are validated and deduplicated as they arrive.  An extension; batch plans are the same code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..plans.spec import Table


def validated(stream: DataFrame, table: Table, json_col: str = "value") -> DataFrame:
    """A stream of JSON texts -> typed fields and ``_errors``; stateless."""
    return validate.validate(stream.select(F.try_parse_json(json_col).alias("_record")), table)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, late: str = "10 minutes") -> DataFrame:
    """First of rows with equal keys within the watermark; state older than that is dropped."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(window_start, label, n)`` over tumbling windows."""
    n = stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("window_start"), "label", "n")


def append_valid(stream: DataFrame, table: Table, path: str, checkpoint: str, rejected: str | None = None) -> StreamingQuery:
    """Valid records to ``path``; others, with their errors, to ``rejected``.  Batches are idempotent by their number."""

    def commit(batch: DataFrame, number: int) -> None:
        rows = validated(batch, table).persist()
        good = rows.where(F.size("_errors") == 0).drop("_errors")
        good.write.mode("overwrite").parquet(f"{path}/round={number}")
        if rejected:
            rows.where(F.size("_errors") > 0).write.mode("overwrite").parquet(f"{rejected}/round={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
