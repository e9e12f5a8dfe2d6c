"""The sample's detections, alerts and links, computed once per session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.lineage import cut
from emberwatch.operators.alerts import apply_detections, score_alerts
from emberwatch.plans.rules import tuned
from emberwatch.plans.run import run_with_evidence
from emberwatch.sources import sample

RULES = [tuned("AUTH-001", threshold=2, time_window="24h"), tuned("PRIV-001")]
STATUSES = ["NEW", "TRIAGED", "IN_PROGRESS", "RESOLVED", "FALSE_POSITIVE"]
_kept: dict[tuple, tuple] = {}


def _once(spark: SparkSession, folder: str, name: str, make):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def found(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    def make():
        detections, evidence = run_with_evidence(sample.events(spark, folder), RULES)
        return cut(detections), evidence

    return _once(spark, folder, "found", make)


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return found(spark, folder)[0]


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    return found(spark, folder)[1]


def applied(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Alerts and links right after the first application, all NEW."""

    def make():
        alerts, links = apply_detections(detections(spark, folder), RULES, 0, evidence=evidence(spark, folder))
        links = cut(links)
        events = sample.events(spark, folder)
        scored = score_alerts(
            alerts, links, events, sample.assets(spark, folder), sample.identities(spark, folder)
        )
        return cut(scored), links

    return _once(spark, folder, "applied", make)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts with a life of their own: status and times follow from the last event time."""
    last, second = F.col("last_us"), 1_000_000
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (last % 5 + 1).cast("int"))
    created = last + 60 * second
    return applied(spark, folder)[0].withColumns(
        {
            "status": status,
            "created_us": created,
            "triaged_us": F.when(last % 5 > 0, created + (last % 3600) * second),
            "resolved_us": F.when(last % 5 > 2, created + (last % 7200 + 10) * second),
            "disposition": F.when(
                last % 5 == 3,
                F.when(last % 2 == 0, F.lit("confirmed_malicious")).otherwise(F.lit("benign_expected")),
            ),
        }
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    return applied(spark, folder)[1]
