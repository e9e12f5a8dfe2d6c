"""Reading raw records and stored events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EQUALS = [
    "source_id", "batch_id", "source_type", "event_category", "event_action", "event_outcome", "host",
    "username", "source_ip",
]


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record per line with its exact bytes; one trailing CR is dropped, blank lines go."""
    lines = spark.read.option("lineSep", "\n").text(path)
    raw = F.col("value").cast("binary")
    cr = F.when(F.expr("right(hex(value), 2)") == "0D", F.expr("substring(cast(value as binary), 1, octet_length(value) - 1)"))
    rows = lines.select(F.coalesce(cr, raw).alias("raw_data"), F.col("_metadata.file_path").alias("file"))
    blank = F.regexp_replace(F.hex("raw_data"), "^(?:20|09|0A|0B|0C|0D)*$", "") == ""
    return rows.filter(~blank).withColumn("is_valid_utf8", F.is_valid_utf8(F.col("raw_data").cast("string")))


def read_record_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Records of `{"records": ["...", ...]}` payloads, one payload per file."""
    payload = spark.read.schema("records array<string>").option("multiLine", True).json(path)
    rows = payload.select(F.posexplode("records").alias("record_no", "text"))
    return rows.select(F.col("record_no").cast("bigint"), F.col("text").cast("binary").alias("raw_data"))


def scan_events(
    events: DataFrame, start: datetime | None = None, end: datetime | None = None, **equals: str
) -> DataFrame:
    """Events of an inclusive time range with equality filters. Where the store is partitioned by
    `event_date`, whole days are pruned."""
    for column, moment, low in (("timestamp", start, True), ("timestamp", end, False)):
        if moment is None:
            continue
        day = F.lit(moment.date())
        events = events.filter(F.col(column) >= F.lit(moment) if low else F.col(column) <= F.lit(moment))
        if "event_date" in events.columns:
            events = events.filter(F.col("event_date") >= day if low else F.col("event_date") <= day)
    for name, value in equals.items():
        if name not in EQUALS:
            raise ValueError(f"cannot filter by {name!r}")
        events = events.filter(F.col(name) == (value.lower() if name in ("host", "username") else value))
    return events


def event_detail(
    events: DataFrame, raw: DataFrame, sources: DataFrame, links: DataFrame, alerts: DataFrame, event_id: str
) -> DataFrame:
    """One event with its raw record, its source and the alerts that cite it."""
    one = events.filter(F.col("id") == event_id)
    raws = raw.select(F.col("id").alias("raw_event_id"), "raw_data")
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    cited = (
        links.filter(F.col("event_id") == event_id)
        .join(alerts.select(F.col("id").alias("alert_id"), "created_us"), "alert_id")
        .groupBy(F.col("event_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("created_us", "alert_id"))).alias("a"))
        .select("id", F.transform("a", lambda x: x["alert_id"]).alias("alert_ids"))
    )
    return one.join(raws, "raw_event_id").join(names, "source_id").join(cited, "id", "left")


def batch_records(raw: DataFrame, batch_id: str, status: str | None = None) -> DataFrame:
    rows = raw.filter(F.col("batch_id") == batch_id)
    if status is not None:
        rows = rows.filter(F.col("parse_status") == status)
    return rows.orderBy("received_at", "record_no")
