"""Alert priority and incident risk: additive points with a breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The points, the caps and the lowest score of each band.
SEVERITY_POINTS = {"low": 10, "medium": 25, "high": 40, "critical": 55}
CONFIDENCE_POINTS = {"low": 0, "medium": 8, "high": 15}
ASSET_POINTS = {"low": 0, "medium": 5, "high": 10, "critical": 15}
UNKNOWN_ASSET_POINTS = 5
PRIVILEGED_POINTS = 10
VOLUME_POINTS, VOLUME_FACTOR = 5, 2
STAGE_POINTS, STAGE_MAX = 5, 15
HOSTS_POINTS = 5
INCIDENT_PRIVILEGED_POINTS = 5
MAX_SCORE = 100
BANDS = {"critical": 75, "high": 50, "medium": 25, "low": 0}
MODEL_VERSION = "3"


def points(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(c == name, F.lit(n)).otherwise(out)
    return out


def band(score: Column) -> Column:
    out = F.lit("low")
    for name, lowest in sorted(BANDS.items(), key=lambda b: b[1]):
        out = F.when(score >= lowest, F.lit(name)).otherwise(out)
    return out


def factor(name: str, value: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.struct(F.lit(name).alias("factor"), value.alias("value"), n.cast("int").alias("points"))


def scored(df: DataFrame, factors: list[Column], prefix: str) -> DataFrame:
    listed = df.withColumn(f"{prefix}_breakdown", F.array_compact(F.array(*factors)))
    total = F.aggregate(f"{prefix}_breakdown", F.lit(0), lambda a, f: a + f["points"])
    return listed.withColumn(f"{prefix}_score", F.least(F.lit(MAX_SCORE), total)).withColumn(
        f"{prefix}_band", band(F.col(f"{prefix}_score"))
    )


def alert_priority(alerts: DataFrame) -> DataFrame:
    """Needs severity, confidence, kind, threshold, peak_count and the context columns
    asset_name, asset_level, actor, actor_privileged, target, target_privileged."""
    actor = F.coalesce("actor_privileged", F.lit(False))
    target = F.coalesce("target_privileged", F.lit(False))
    volume = F.col("kind").isin("threshold", "distinct") & (
        F.col("peak_count") >= VOLUME_FACTOR * F.col("threshold")
    )
    known = F.col("asset_name").isNotNull()
    return scored(
        alerts,
        [
            factor("severity", F.col("severity"), points(F.col("severity"), SEVERITY_POINTS)),
            factor("confidence", F.col("confidence"), points(F.col("confidence"), CONFIDENCE_POINTS)),
            F.when(
                known,
                factor(
                    "asset",
                    F.concat_ws(" ", "asset_name", "asset_level"),
                    points(F.col("asset_level"), ASSET_POINTS),
                ),
            ).otherwise(factor("asset", F.lit("not in inventory"), UNKNOWN_ASSET_POINTS)),
            F.when(
                actor, factor("identity", F.concat("actor", F.lit(" privileged")), PRIVILEGED_POINTS)
            ).when(
                target,
                factor("identity", F.concat("target", F.lit(" privileged (target account)")), PRIVILEGED_POINTS),
            ),
            F.when(
                volume,
                factor(
                    "evidence",
                    F.concat(
                        F.col("peak_count").cast("string"),
                        F.lit(f" (≥ {VOLUME_FACTOR}× threshold "),
                        F.col("threshold").cast("string"),
                        F.lit(")"),
                    ),
                    VOLUME_POINTS,
                ),
            ),
        ],
        "priority",
    )


def incident_risk(incidents: DataFrame) -> DataFrame:
    """Needs top_score, top_title, top_has_privileged, stages, hosts and privileged_identity."""
    kinds = F.size("stages")
    bonus = F.least(F.lit(STAGE_MAX), STAGE_POINTS * (kinds - 1))
    found = F.concat(
        kinds.cast("string"), F.lit(" kinds of finding: "), F.array_join("stages", ", ")
    )
    extra = F.col("privileged_identity").isNotNull() & ~F.col("top_has_privileged")
    return scored(
        incidents,
        [
            factor(
                "highest alert",
                F.concat(F.col("top_score").cast("string"), F.lit(" ("), F.substring("top_title", 1, 80), F.lit(")")),
                F.col("top_score"),
            ),
            F.when(kinds > 1, factor("attack stages", found, bonus)),
            F.when(
                F.size("hosts") > 1,
                factor("hosts", F.concat(F.size("hosts").cast("string"), F.lit(" hosts affected")), HOSTS_POINTS),
            ),
            F.when(
                extra,
                factor(
                    "identity",
                    F.concat("privileged_identity", F.lit(" privileged")),
                    INCIDENT_PRIVILEGED_POINTS,
                ),
            ),
        ],
        "risk",
    )
