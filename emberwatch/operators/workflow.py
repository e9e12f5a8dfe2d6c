"""Status changes of alerts and incidents replayed in order against the allowed transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.lineage import cut
from emberwatch.schema import ACTIVE_ALERT

#: Changes of an item that are replayed together.
CHUNK = 1000

# Which status may follow which.
ALERT_TRANSITIONS = {
    "NEW": ["TRIAGED", "IN_PROGRESS", "FALSE_POSITIVE"],
    "TRIAGED": ["IN_PROGRESS", "RESOLVED", "FALSE_POSITIVE"],
    "IN_PROGRESS": ["TRIAGED", "RESOLVED", "FALSE_POSITIVE"],
    "RESOLVED": ["TRIAGED"],
    "FALSE_POSITIVE": ["TRIAGED"],
}
INCIDENT_TRANSITIONS = {
    "OPEN": ["TRIAGED", "RESOLVED"],
    "TRIAGED": ["INVESTIGATING", "RESOLVED"],
    "INVESTIGATING": ["CONTAINED", "RESOLVED"],
    "CONTAINED": ["INVESTIGATING", "RESOLVED"],
    "RESOLVED": ["CLOSED", "INVESTIGATING"],
    "CLOSED": [],
}


def _given(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _alert_code(current: str) -> Column:
    """Why a change from `current` is refused; null when it is accepted."""
    to, reopen = F.col("to_status"), F.lit(current not in ACTIVE_ALERT) & F.col("to_status").isin(ACTIVE_ALERT)
    return (
        F.when(to == current, F.lit("already"))
        .when(~to.isin(ALERT_TRANSITIONS[current]), F.lit("not_allowed"))
        .when((to == "RESOLVED") & F.col("disposition").isNull(), F.lit("disposition_required"))
        .when((to != "RESOLVED") & F.col("disposition").isNotNull(), F.lit("disposition_unexpected"))
        .when(((to == "FALSE_POSITIVE") | reopen) & ~_given("reason"), F.lit("reason_required"))
    )


def _incident_code(current: str) -> Column:
    to = F.col("to_status")
    complete = F.col("disposition").isNotNull() & _given("resolution")
    extra = F.col("disposition").isNotNull() | _given("resolution")
    reopen = F.lit(current == "RESOLVED") & (to == "INVESTIGATING")
    return (
        F.when(F.lit(current == "CLOSED"), F.lit("final"))
        .when(to == current, F.lit("already"))
        .when(~to.isin(INCIDENT_TRANSITIONS[current]), F.lit("not_allowed"))
        .when((to == "RESOLVED") & ~complete, F.lit("resolution_required"))
        .when((to != "RESOLVED") & extra, F.lit("resolution_unexpected"))
        .when(reopen & ~_given("reason"), F.lit("reason_required"))
    )


def _replay(items: DataFrame, changes: DataFrame, states: list[str], code, chunk: int) -> DataFrame:
    """Each change with the status it met, `accepted` and `code`.

    A change is a small function from status to status, written as the array of its results, so
    changes can be chained without knowing where they start. All changes are put in order by item and time
    over many tasks, and cut into chunks of at most so many rows of an item, however they lie in time:
    every chunk first yields its combined function, chunks are chained by one small row each, and
    then the changes of a chunk are replayed from the status it really starts with. The cut is
    checkpointed, as both passes must see the same chunks."""
    codes = F.array(*[code(s) for s in states])
    target = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("to_status")).cast("int") - 1
    rows = changes.withColumns({"_codes": codes, "_to": target})
    order = ["item_id", "at", "change_id"]
    rows = rows.select(*order, "_codes", "_to").repartitionByRange(*order).sortWithinPartitions(*order, "_codes", "_to")
    # Numbers rise with the order of tasks and of rows in them, so chunks of an item are in order too.
    rows = cut(rows.withColumn("_chunk", F.expr(f"monotonically_increasing_id() div {chunk}")))
    step = F.struct("at", "change_id", "_codes", "_to")
    grouped = rows.groupBy("item_id", "_chunk").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def run(steps: Column, start: Column) -> Column:
        return F.aggregate(
            steps, start, lambda s, c: F.when(F.get(c["_codes"], s).isNull(), c["_to"]).otherwise(s)
        )

    ends = grouped.withColumn("ends", F.array(*[run(F.col("steps"), F.lit(i)) for i in range(len(states))]))
    line = F.array_sort(F.collect_list(F.struct("_chunk", "ends")))
    starts = (
        ends.groupBy("item_id")
        .agg(line.alias("line"))
        .join(items.select("item_id", F.col("status")), "item_id")
        .withColumn("s0", F.array_position(F.array(*[F.lit(s) for s in states]), F.col("status")).cast("int") - 1)
        .withColumn(
            "walk",
            F.aggregate(
                "line",
                F.struct(F.col("s0").alias("s"), F.array().cast("array<int>").alias("seen")),
                lambda a, x: F.struct(
                    F.get(x["ends"], a["s"]).alias("s"), F.array_append(a["seen"], a["s"]).alias("seen")
                ),
            )["seen"],
        )
        .select("item_id", F.explode(F.arrays_zip("line", "walk")).alias("z"))
        .select("item_id", F.col("z.line._chunk").alias("_chunk"), F.col("z.walk").alias("start"))
    )
    met = F.aggregate(
        "steps",
        F.struct(F.col("start").alias("s"), F.array().cast("array<int>").alias("seen")),
        lambda a, c: F.struct(
            F.when(F.get(c["_codes"], a["s"]).isNull(), c["_to"]).otherwise(a["s"]).alias("s"),
            F.array_append(a["seen"], a["s"]).alias("seen"),
        ),
    )["seen"]
    names = F.array(*[F.lit(s) for s in states])
    return (
        grouped.join(starts, ["item_id", "_chunk"])
        .withColumn("seen", met)
        .select("item_id", F.explode(F.arrays_zip("steps", "seen")).alias("z"))
        .select(
            "item_id",
            F.col("z.steps.at").alias("at"),
            F.col("z.steps.change_id").alias("change_id"),
            F.get(names, F.col("z.seen")).alias("from_status"),
            F.get(names, F.col("z.steps._to")).alias("to_status"),
            F.get(F.col("z.steps._codes"), F.col("z.seen")).alias("code"),
        )
        .withColumn("accepted", F.col("code").isNull())
    )


def fold_transitions(alerts: DataFrame, changes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """alerts: item_id, status; changes: item_id, change_id, at (microseconds), to_status,
    disposition, reason. Refused changes keep their code and change nothing."""
    return _replay(alerts, changes, list(ALERT_TRANSITIONS), _alert_code, chunk)


def fold_incident_transitions(incidents: DataFrame, changes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """As fold_transitions, with a `resolution` and the incident states."""
    return _replay(incidents, changes, list(INCIDENT_TRANSITIONS), _incident_code, chunk)


def final_status(items: DataFrame, replayed: DataFrame) -> DataFrame:
    """The status after all accepted changes, and when it was reached."""
    last = replayed.filter("accepted").groupBy("item_id").agg(
        F.max_by("to_status", F.struct("at", "change_id")).alias("last_status"), F.max("at").alias("changed_at")
    )
    return items.join(last, "item_id", "left").select(
        "item_id", F.coalesce("last_status", "status").alias("status"), "changed_at"
    )
