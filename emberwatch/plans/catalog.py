"""All queries by name."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = ["detect", "ingest", "stores", "alerts", "incidents", "reports", "streaming"]


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for part in PARTS:
        found.update(import_module(f"emberwatch.plans.catalog_{part}").QUERIES)
    return found


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return _all()[name][0](spark, folder)


def queries() -> dict:
    return {name: parts[0] for name, parts in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: parts[1] for name, parts in _all().items() if parts[1]}
