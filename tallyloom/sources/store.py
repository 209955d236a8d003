"""Committed rounds of generated tables: Parquet folders, a state file, the last-run pointer."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import Table
from .shared import Files


class Store:
    """``folder/table/round=k``: a round that the state doesn't name was not committed and is dropped on load.

    Folder and state are on the file system that Spark writes to, so a cluster's executors and any later driver see them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def table_path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _state_path(self, table: str) -> str:
        return f"{self.folder}/.{table}.state.json"

    def state(self, table: str) -> dict[str, Any]:
        return self.files.read_json(self._state_path(table)) or {}

    def save_state(self, table: str, state: dict[str, Any]) -> None:
        self.files.write_json(self._state_path(table), state)

    def append(self, table: str, rows: DataFrame, number: int, state: dict[str, Any]) -> None:
        """Write a round, then commit it by naming it in the state."""
        rows.write.mode("overwrite").parquet(f"{self.table_path(table)}/round={number}")
        self.save_state(table, state | {"rounds": sorted({*state.get("rounds", []), number})})

    def load(self, table: Table) -> DataFrame:
        rounds = self.state(table.name).get("rounds", [])
        paths = [f"{self.table_path(table.name)}/round={k}" for k in rounds]
        schema = table.struct()
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(*paths)
        return found.select(*(F.col(f"`{f.name}`") for f in schema.fields))

    def reset(self, table: str) -> None:
        self.files.delete(self.table_path(table))
        self.files.delete(self._state_path(table))


def write_last_run(spark: SparkSession, info: dict[str, Any], base: str) -> None:
    Files(spark).write_json(f"{base}/.last_run.json", info)


def read_last_run(spark: SparkSession, base: str) -> dict[str, Any] | None:
    return Files(spark).read_json(f"{base}/.last_run.json")
