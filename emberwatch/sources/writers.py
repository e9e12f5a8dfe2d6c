"""Writing stores. Files of a day are sorted by what rules filter on, so that scans skip them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_raw(raw: DataFrame, path: str) -> None:
    """Append-only evidence, by receive day and format."""
    day = raw.withColumn("received_date", F.to_date("received_at"))
    day.write.mode("append").partitionBy("received_date", "source_type").parquet(path)


def write_events(events: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Append-only events by event day. A busy day is written by many tasks, each in order of
    category, action and time."""
    day = events.withColumn("event_date", F.to_date("timestamp"))
    ordered = day.sortWithinPartitions("event_date", "event_category", "event_action", "timestamp")
    ordered.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(path)


def write_snapshot(df: DataFrame, path: str, version: str) -> str:
    """Detections, alerts and incidents are written whole to a new version folder, never over the
    one that may be being read."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


write_detections = write_alerts = write_incidents = write_snapshot
