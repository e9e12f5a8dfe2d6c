"""Hunting: typed filters in a time range, paging, and the four analytic templates."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.conditions import _predicate, compile_condition
from emberwatch.functions.net import to_network
from emberwatch.functions.text import fold, fold_text
from emberwatch.operators import slices as S
from emberwatch.operators.detect import micros, new_values
from emberwatch.schema import IP_FIELDS, PORT_FIELDS

# Operators that a hunt offers, by what kind of field they compare.
_EVERY = ["eq", "ne", "exists"]
_KINDS = [
    (IP_FIELDS, [*_EVERY, "in", "not_in", "cidr"]),
    (PORT_FIELDS, [*_EVERY, "in", "not_in", "gt", "gte", "lt", "lte"]),
    (["identity_privileged"], _EVERY),
]
_WORDS = [*_EVERY, "in", "not_in", "contains", "startswith", "endswith"]


def allowed_operators(name: str) -> set[str]:
    return set(next((ops for fields, ops in _KINDS if name in fields), _WORDS))


def hunt_filter(name: str, op: str, value=None) -> Column:
    if op not in allowed_operators(name):
        raise ValueError(f"a hunt by {name} has no {op}")
    return F.coalesce(_predicate(name, op, value), F.lit(False))


def attribute_filter(key: str, op: str, value, json: str = "attributes_json") -> Column:
    """One attribute of a JSON text column, compared as text: 5 is "5", true is "true"."""
    text = F.get_json_object(json, f"$.{key}")
    if op == "exists":
        present = text.isNotNull() & (text != "")
        return F.coalesce(~present if value is False else present, F.lit(value is False))
    values = [fold_text(v) for v in (value if isinstance(value, list) else [value])]
    tests = {
        "eq": fold(text).isin(values),
        "in": fold(text).isin(values),
        "ne": text.isNull() | ~fold(text).isin(values),
        "not_in": text.isNull() | ~fold(text).isin(values),
        "contains": fold(text).contains(values[0]),
        "startswith": fold(text).startswith(values[0]),
        "endswith": fold(text).endswith(values[0]),
    }
    return F.coalesce(tests[op], F.lit(False))


def resolve_range(
    last: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    now: datetime | None = None,
) -> tuple[datetime, datetime]:
    """`15m`/`24h`/`7d` before now, or both ends given."""
    if last is not None:
        hit = re.fullmatch(r"(\d{1,4})([mhd])", last)
        if start or end or not hit or now is None:
            raise ValueError("give either last (15m, 24h, 7d) and now, or both from and to")
        span = timedelta(**{{"m": "minutes", "h": "hours", "d": "days"}[hit[2]]: int(hit[1])})
        start, end = now - span, now
    if start is None or end is None or start.tzinfo is None or end.tzinfo is None:
        raise ValueError("a range needs both ends, with a time zone")
    if start >= end:
        raise ValueError("a range begins before it ends")
    return start, end


def in_range(events: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        events = events.filter(F.col("timestamp") >= F.lit(start))
    return events if end is None else events.filter(F.col("timestamp") <= F.lit(end))


def with_alert_context(
    events: DataFrame,
    links: DataFrame,
    alerts: DataFrame,
    in_alert: bool | None = None,
    rule_ids: list[str] | None = None,
    severities: list[str] | None = None,
    statuses: list[str] | None = None,
) -> DataFrame:
    """Events that are evidence in such an alert, or in none."""
    wanted = {"rule_id": rule_ids, "severity": severities, "status": statuses}
    wanted = {k: v for k, v in wanted.items() if v}
    if not wanted and in_alert is None:
        return events
    if in_alert is False and wanted:
        raise ValueError("alert filters cannot be combined with in_alert: false")
    if wanted:
        for name, values in wanted.items():
            alerts = alerts.filter(F.col(name).isin(values))
        links = links.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
    cited = links.select(F.col("event_id").alias("id"))
    return events.join(cited, "id", "left_anti" if in_alert is False else "left_semi")


def hunt(
    events: DataFrame,
    filters: list[dict],
    start: datetime,
    end: datetime,
    links: DataFrame | None = None,
    alerts: DataFrame | None = None,
    **context,
) -> DataFrame:
    rows = in_range(events, start, end)
    for f in filters:
        rows = rows.filter(hunt_filter(f["field"], f["op"], f.get("value")))
    return with_alert_context(rows, links, alerts, **context) if context else rows


def keyset_page(
    rows: DataFrame,
    limit: int,
    after: tuple[datetime, str] | None = None,
    newest: bool = True,
) -> DataFrame:
    """The next `limit` rows strictly after (timestamp, id), with `has_more`. The order and the
    limit become one top-k, so no task sorts everything."""
    t, i = F.col("timestamp"), F.col("id")
    if after is not None:
        at, ident = F.lit(after[0]), F.lit(after[1])
        beyond = (t < at) | ((t == at) & (i < ident)) if newest else (t > at) | ((t == at) & (i > ident))
        rows = rows.filter(beyond)
    order = [t.desc(), i.desc()] if newest else [t, i]
    page = rows.orderBy(*order).limit(limit + 1)
    numbered = page.withColumns(
        {
            "_r": F.row_number().over(Window.orderBy(*order)),
            "has_more": F.count("*").over(Window.partitionBy(F.lit(1))) > limit,
        }
    )
    return numbered.filter(F.col("_r") <= limit).drop("_r")


def capped_count(rows: DataFrame, cap: int = 10000) -> DataFrame:
    counted = rows.limit(cap + 1).agg(F.count("*").alias("n"))
    return counted.select(
        F.least("n", F.lit(cap)).alias("total"), (F.col("n") > cap).alias("capped")
    )


def _logons(events: DataFrame, outcome: str | None) -> DataFrame:
    wanted = {"event_category": "authentication", "event_action": "logon"}
    if outcome:
        wanted["event_outcome"] = outcome
    tests = [{"field": k, "op": "eq", "value": v} for k, v in wanted.items()]
    return events.filter(compile_condition({"all": tests})).filter(
        "username is not null and source_ip is not null"
    )


def success_after_failures(
    events: DataFrame,
    min_failures: int = 3,
    within_minutes: int = 10,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Successful logons with enough failures of the same account and source in the minutes
    before. Failures enter and leave a running count at the right times, so each row is
    looked at a fixed number of times however many there are in the window."""
    reach, keys = within_minutes * 60_000_000, ["username", "source_ip"]
    rows = _logons(events, None).filter(F.col("event_outcome").isin("failure", "success"))
    rows = rows.withColumn("us", F.unix_micros("timestamp")).select(
        *keys, "us", "id", "host", (F.col("event_outcome") == "failure").alias("failed")
    )
    if end is not None:
        rows = rows.filter(F.col("us") <= _us(end))
    placed = S.spread(S.look_back(rows, S.width_for(reach), reach), keys).filter("failed or _own")
    order = Window.partitionBy(*keys, "_s", "failed").orderBy("us", "id")
    moves = placed.withColumn("after", F.lead("us").over(order)).withColumn(
        "m",
        F.explode(
            F.when(
                F.col("failed"),
                F.array(
                    F.struct(F.col("us").alias("at"), F.lit(1).alias("step")),
                    F.struct((F.col("us") + reach).alias("at"), F.lit(-1).alias("step")),
                ),
            ).otherwise(F.array(F.struct(F.col("us").alias("at"), F.lit(0).alias("step"))))
        ),
    ).withColumns({"at": F.col("m.at"), "step": F.col("m.step")})
    # At equal times the success comes first: only strictly earlier failures count, and a
    # failure exactly at the window's edge is still inside.
    w = (
        Window.partitionBy(*keys, "_s")
        .orderBy("at", F.col("failed"), "us", "id", "step")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    oldest = F.coalesce(
        F.last(F.when(F.col("step") == -1, F.col("after")), ignorenulls=True).over(w),
        F.first(F.when(F.col("step") == 1, F.col("us")), ignorenulls=True).over(w),
    )
    found = moves.withColumns({"failures": F.sum("step").over(w), "first_failure_us": oldest})
    found = found.filter("not failed").filter(F.col("failures") >= min_failures)
    if start is not None:
        found = found.filter(F.col("us") >= _us(start))
    return found.select(
        F.col("id").alias("event_id"), "us", "host", *keys, "failures", "first_failure_us"
    )


def _us(moment: datetime) -> int:
    return micros(moment - datetime.fromtimestamp(0, moment.tzinfo))


def first_seen_source(
    events: DataFrame,
    lookback_days: int = 14,
    min_history: int = 5,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """First successful logon of an account from a network unseen in the lookback."""
    rows = _logons(events, "success").withColumns(
        {"us": F.unix_micros("timestamp"), "v": to_network(F.col("source_ip"))}
    )
    found = new_values(
        rows.filter("v is not null").select("username", "us", "id", "v"),
        ["username"],
        lookback_days * 86_400_000_000,
        min_history,
        None if start is None else _us(start),
        None if end is None else _us(end),
    )
    return rows.drop("v").join(found, ["username", "us", "id"]).select(
        F.col("id").alias("event_id"), "us", "host", "username", "source_ip",
        F.col("v").alias("network"), F.col("history_count").alias("history"),
    )


def _spread_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: rows, times, number of different values and the first ten of them. Rows are first
    summed per (key, value); the sample is a rank limit applied before the move."""
    pairs = rows.groupBy(key, value).agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    totals = pairs.groupBy(key).agg(
        F.count(value).alias("values"),
        F.sum("n").alias("total"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    ranked = (
        pairs.filter(F.col(value).isNotNull())
        .withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value)))
        .filter("_r <= 10")
    )
    sample = ranked.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("sample"))
    return totals.join(sample, key, "left")


def rare_process(
    events: DataFrame, max_hosts: int = 1, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    rows = in_range(events, start, end).filter("process_name is not null")
    spread = _spread_of(rows.withColumn("us", F.unix_micros("timestamp")), "process_name", "host")
    return spread.filter(F.col("values") <= max_hosts).select(
        "process_name", F.col("sample").alias("hosts"), F.col("total").alias("executions"),
        "first_us", "last_us",
    )


def one_source_many_accounts(
    events: DataFrame, min_accounts: int = 5, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    rows = in_range(_logons(events, "failure"), start, end)
    spread = _spread_of(rows.withColumn("us", F.unix_micros("timestamp")), "source_ip", "username")
    return spread.filter(F.col("values") >= min_accounts).select(
        "source_ip", F.col("values").alias("accounts"), F.col("sample").alias("sample_accounts"),
        F.col("total").alias("failures"), "first_us", "last_us",
    )


