"""From raw records to stored evidence and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch import lineage
from emberwatch.operators.enrich import enrich
from emberwatch.operators.parsers import parse_records
from emberwatch.schema import EVENT_SCHEMA, INTERNAL_NETWORKS, MAX_RAW_BYTES

MAX_ISSUES = 50


def fingerprint(source: str = "source_id", raw: str = "raw_data") -> Column:
    """SHA-256 over the source, a separator and the exact bytes."""
    return F.sha2(F.concat(F.col(source).cast("binary"), F.unhex(F.lit("1F")), F.col(raw)), 256)


def reject_oversize(records: DataFrame, max_bytes: int = MAX_RAW_BYTES) -> DataFrame:
    return records.withColumn("rejected", F.octet_length("raw_data") > max_bytes)


def drop_duplicates(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first record per fingerprint that is not stored yet. Copies are reduced before they move,
    so a record that was sent very many times costs one row per input task."""
    rows = records if "fingerprint" in records.columns else records.withColumn("fingerprint", fingerprint())
    names = rows.columns
    first = F.min_by(F.struct(*names), F.struct("received_at", "batch_id", "record_no")).alias("_first")
    kept = rows.groupBy("fingerprint").agg(first).select("_first.*")
    return kept if stored is None else kept.join(stored.select("fingerprint"), "fingerprint", "left_anti")


def with_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """What a record's source says about it: type, zone, default host, allowed hosts."""
    known = sources.select(
        F.col("id").alias("source_id"), "source_type", "timezone", "default_host", "allowed_hosts"
    )
    return records.drop("source_type", "timezone", "default_host").join(known, "source_id")


def enforce_host_allowlist(parsed: DataFrame) -> DataFrame:
    """A source with an allowlist speaks only for those hosts; others FAIL as host_not_allowed."""
    listed = F.coalesce(F.size("allowed_hosts"), F.lit(0)) > 0
    refused = (F.col("parse_status") == "PARSED") & listed & ~F.coalesce(
        F.array_contains("allowed_hosts", F.col("host")), F.lit(False)
    )
    return parsed.withColumn("_refused", F.coalesce(refused, F.lit(False))).withColumns(
        {
            "parse_status": F.when(F.col("_refused"), F.lit("FAILED")).otherwise(F.col("parse_status")),
            "parse_detail": F.when(F.col("_refused"), F.lit("host_not_allowed")).otherwise(F.col("parse_detail")),
        }
    ).drop("_refused")


def batch_report(received: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per batch: records received and what became of them, event times, and the first issues.
    `outcomes`: kept records with parse_status; what is neither rejected nor kept is duplicate."""
    totals = received.groupBy("batch_id").agg(
        F.count("*").alias("received"), F.count_if("rejected").alias("rejected")
    )
    is_ = lambda s: F.count_if(F.col("parse_status") == s)
    counts = outcomes.groupBy("batch_id").agg(
        is_("PARSED").alias("parsed"),
        is_("SKIPPED").alias("skipped"),
        is_("FAILED").alias("failed"),
        F.min("timestamp").alias("first_event_at"),
        F.max("timestamp").alias("last_event_at"),
    )
    issue = lambda df, status, code: df.select(
        "batch_id", F.col("record_no").alias("index"), F.lit(status).alias("status"), code.alias("code")
    )
    issues = issue(received.filter("rejected"), "REJECTED", F.lit("record_too_large")).unionByName(
        issue(outcomes.filter("parse_status = 'FAILED'"), "FAILED", F.col("parse_detail"))
    )
    w = Window.partitionBy("batch_id").orderBy("index")
    first = issues.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= MAX_ISSUES)
    listed = first.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "status", "code"))).alias("issues")
    )
    zeros = ["parsed", "skipped", "failed"]
    return (
        totals.join(counts, "batch_id", "left")
        .na.fill(0, zeros)
        .withColumn("duplicate", F.col("received") - F.col("rejected") - F.col("parsed") - F.col("skipped") - F.col("failed"))
        .join(listed, "batch_id", "left")
    )


def ingest(
    records: DataFrame,
    sources: DataFrame,
    assets: DataFrame,
    identities: DataFrame,
    stored: DataFrame | None = None,
    internal: list[str] = INTERNAL_NETWORKS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(received, raw, events): all records with `rejected`, the kept ones with their outcome, and the
    events of the parsed ones, enriched. Oversize records cannot be kept without changing them, so
    they are in the first only. `stored`: fingerprints that are stored already. Ids follow from the fingerprint, so a repeated run
    writes the same rows."""
    received = reject_oversize(with_sources(records, sources))
    fresh = drop_duplicates(received.filter("not rejected"), stored)
    formats = [r[0] for r in sources.select("source_type").distinct().collect()]  # a few words
    parsed = enforce_host_allowlist(parse_records(fresh, formats)).withColumn("raw_event_id", F.col("fingerprint"))
    raw = lineage.stored(parsed)  # evidence first: what follows reads the kept outcome, it never parses again
    events = raw.filter("parse_status = 'PARSED'").withColumns(
        {
            "id": F.substring(F.sha2(F.concat(F.lit("event"), "fingerprint"), 256), 1, 32),
            "simulated": F.lit(False) if "simulated" not in raw.columns else F.col("simulated"),
        }
    )
    events = enrich(events, assets, identities, internal)
    return received, raw, events.select(*EVENT_SCHEMA.names, "fingerprint")
