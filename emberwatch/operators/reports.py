"""Dashboards, rule metrics, coverage and inventory views."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.conditions import compile_condition
from emberwatch.operators.alerts import is_open
from emberwatch.operators.enrich import short_name
from emberwatch.schema import ACTIVE_INCIDENT, SEVERITIES

TOP, RECENT, RECENT_ALERTS, RECENT_INCIDENTS = 5, 10, 8, 5
WORKED = ["INVESTIGATING", "CONTAINED"]
DAY = 86_400_000_000


def us_of(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def day_of(us: Column) -> Column:
    return F.to_date(F.timestamp_micros(us))


# ---------- summaries ----------


def daily_counts(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Events per day of their own time, raw records per day of receipt."""
    kinds = [("event", events, "timestamp"), ("raw", raw, "received_at")]
    parts = [
        df.groupBy(F.to_date(c).alias("day")).agg(F.count("*").alias("records")).withColumn("kind", F.lit(kind))
        for kind, df, c in kinds
    ]
    return parts[0].unionByName(parts[1])


def logon_success_daily(events: DataFrame) -> DataFrame:
    """Successful logons per account, source and day."""
    wanted = {"event_category": "authentication", "event_action": "logon", "event_outcome": "success"}
    tests = [{"field": k, "op": "eq", "value": v} for k, v in wanted.items()]
    rows = events.filter(compile_condition({"all": tests})).filter("username is not null and source_ip is not null")
    return rows.groupBy("username", "source_ip", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("logons"), F.max(F.unix_micros("timestamp")).alias("last_us")
    )


def merge_daily_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("kind", "day").agg(F.sum("records").alias("records"))


def merge_logons(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("username", "source_ip", "day").agg(
        F.sum("logons").alias("logons"), F.max("last_us").alias("last_us")
    )


# ---------- dashboard ----------


def monitored_hosts(events: DataFrame, now: datetime, approximate: bool = False) -> DataFrame:
    """Distinct hosts seen in the last 24 hours."""
    recent = events.filter(F.col("timestamp") >= F.lit(now - timedelta(hours=24)))
    count = F.approx_count_distinct("host") if approximate else F.countDistinct("host")
    return recent.agg(count.alias("hosts"))


def _section(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("bigint").alias("value"))


def dashboard_summary(
    counts: DataFrame,
    alerts: DataFrame,
    incidents: DataFrame,
    events: DataFrame,
    assets: DataFrame,
    rules: DataFrame,
    now: datetime,
) -> DataFrame:
    """Every number of the dashboard as (section, name, value). `counts` is daily_counts, `rules`
    has rule_id, name, enabled. Each table is read once for its counters."""
    today, week = datetime(now.year, now.month, now.day, tzinfo=UTC), now - timedelta(days=7)
    n = lambda test: F.count_if(test)

    def counters(df: DataFrame, **values: Column) -> DataFrame:
        row = df.agg(*[v.alias(k) for k, v in values.items()])
        pairs = F.array(*[F.struct(F.lit(k).alias("n"), F.col(k).cast("bigint").alias("v")) for k in values])
        return _section(row.select(F.explode(pairs).alias("p")), "counter", F.col("p.n"), F.coalesce("p.v", F.lit(0)))

    event = F.col("kind") == "event"
    week_alerts = alerts.filter(F.col("created_us") >= us_of(week))
    spread = F.array(*[F.struct(F.lit(s).alias("n"), n(is_open() & (F.col("severity") == s)).alias("v")) for s in SEVERITIES])
    severity = alerts.agg(spread.alias("s")).select(F.explode("s").alias("p"))
    top_rules = week_alerts.join(rules.select("rule_id", "name"), "rule_id").groupBy("rule_id").agg(F.count("*").alias("v"))
    top_sources = week_alerts.filter("source_ip is not null").groupBy("source_ip").agg(F.count("*").alias("v"))
    active = F.col("status").isin(ACTIVE_INCIDENT)
    parts = [
        counters(
            counts,
            records_processed=F.sum(F.when(~event, F.col("records"))),
            events_stored=F.sum(F.when(event, F.col("records"))),
            events_today=F.sum(F.when(event & (F.col("day") >= F.lit(today.date())), F.col("records"))),
        ),
        counters(
            alerts,
            alerts_today=n(F.col("created_us") >= us_of(today)),
            open_alerts=n(is_open()),
            open_alerts_simulated=n(is_open() & F.col("simulated")),
            critical_alerts=n(is_open() & (F.col("severity") == "critical")),
            high_alerts=n(is_open() & (F.col("severity") == "high")),
        ),
        counters(incidents, open_incidents=n(active), incidents_under_investigation=n(F.col("status").isin(WORKED))),
        counters(assets, inventory_assets=n(F.col("status") == "ACTIVE")),
        counters(rules, active_rules=n(F.col("enabled")), library_rules=F.count("*")),
        _section(monitored_hosts(events, now), "counter", F.lit("monitored_hosts"), F.col("hosts")),
        _section(severity, "severity", F.col("p.n"), F.col("p.v")),
        _section(top_rules.orderBy(F.col("v").desc(), "rule_id").limit(TOP), "top_rule", F.col("rule_id"), F.col("v")),
        _section(top_sources.orderBy(F.col("v").desc(), "source_ip").limit(TOP), "top_source", F.col("source_ip"), F.col("v")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trends(
    counts: DataFrame, alerts: DataFrame, incidents: DataFrame, events: DataFrame, days: int, now: datetime
) -> DataFrame:
    """Per UTC day, oldest first and none missing: alerts by severity, incidents, events. Today's
    events stop at now."""
    spark = alerts.sparkSession
    first, today = (now - timedelta(days=days - 1)).date(), now.date()
    calendar = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    start = us_of(datetime(first.year, first.month, first.day, tzinfo=UTC))
    by_day = alerts.filter(F.col("created_us") >= start).groupBy(day_of(F.col("created_us")).alias("day"))
    levels = by_day.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    opened = incidents.filter(F.col("created_us") >= start).groupBy(day_of(F.col("created_us")).alias("day")).agg(F.count("*").alias("incidents"))
    past = counts.filter((F.col("kind") == "event") & (F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(today)))
    midnight = datetime(today.year, today.month, today.day, tzinfo=UTC)
    so_far = events.filter((F.col("timestamp") >= F.lit(midnight)) & (F.col("timestamp") <= F.lit(now)))
    seen = past.select("day", F.col("records").alias("events")).unionByName(
        so_far.agg(F.count("*").alias("events")).select(F.lit(today).alias("day"), "events")
    )
    joined = calendar.join(levels, "day", "left").join(opened, "day", "left").join(seen, "day", "left")
    return joined.na.fill(0).orderBy("day")


def recent_alerts(alerts: DataFrame, n: int = RECENT_ALERTS) -> DataFrame:
    return alerts.orderBy(F.col("created_us").desc(), "id").limit(n)


def recent_incidents(incidents: DataFrame, n: int = RECENT_INCIDENTS) -> DataFrame:
    return incidents.orderBy(F.col("created_us").desc(), "incident_id").limit(n)


# ---------- rules ----------


def rule_metrics(rules: DataFrame, alerts: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Per rule (all of them) over the alerts created in the range."""
    rows = alerts.filter(F.col("created_us").between(start_us, end_us))
    resolved = F.col("status") == "RESOLVED"
    seconds = lambda c: (F.col(c) - F.col("created_us")) / 1e6
    half = lambda c: F.percentile(c, F.lit(0.5))
    per = rows.groupBy("rule_id").agg(
        F.count("*").alias("alerts"),
        F.count_if(is_open()).alias("open"),
        F.count_if(resolved & (F.col("disposition") == "confirmed_malicious")).alias("confirmed"),
        F.count_if(resolved & (F.col("disposition") == "benign_expected")).alias("benign"),
        F.count_if(F.col("status") == "FALSE_POSITIVE").alias("false_positives"),
        half(seconds("triaged_us")).alias("median_triage_seconds"),
        half(F.when(~is_open(), seconds("resolved_us"))).alias("median_resolve_seconds"),
    )
    closed = F.col("confirmed") + F.col("benign") + F.col("false_positives")
    out = rules.select("rule_id").join(per, "rule_id", "left")
    out = out.na.fill(0, ["alerts", "open", "confirmed", "benign", "false_positives"])
    return out.withColumn("false_positive_rate", F.when(closed > 0, F.bround(F.col("false_positives") / closed, 3)))


def coverage(technique_map: DataFrame, rules: DataFrame, techniques: DataFrame, alerts: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Per technique and rule: alerts in the period that count for it, and the last one at any time.
    A mapping of the whole rule counts all its alerts, one of an indicator only its own.

    `technique_map`: rule_id, indicator ("" for the rule), technique, reason. Alerts are summed per
    rule and indicator first, so the joins only meet small rows."""
    inside = F.col("created_us").between(start_us, end_us)
    per = alerts.groupBy("rule_id", F.coalesce("indicator", F.lit("")).alias("alert_indicator")).agg(
        F.count_if(inside).alias("n"), F.max("created_us").alias("last")
    )
    counts = F.col("alert_indicator").isNotNull() & (
        (F.col("indicator") == "") | (F.col("indicator") == F.col("alert_indicator"))
    )
    rows = technique_map.join(rules, "rule_id").join(techniques, "technique").join(per, "rule_id", "left")
    return rows.groupBy("technique", "technique_name", "tactics", "rule_id", "name", "enabled", "indicator", "reason").agg(
        F.coalesce(F.sum(F.when(counts, F.col("n"))), F.lit(0)).alias("alerts"),
        F.max(F.when(counts, F.col("last"))).alias("last_us"),
    )


def tactic_coverage(covered: DataFrame, tactics: list[str]) -> DataFrame:
    """All tactics in order, with the techniques that cover them and whether an enabled rule does."""
    spark = covered.sparkSession
    names = spark.range(len(tactics)).select(
        (F.col("id") + 1).cast("int").alias("position"),
        F.element_at(F.array(*[F.lit(t) for t in tactics]), (F.col("id") + 1).cast("int")).alias("tactic"),
    )
    per = (
        covered.select("technique", "enabled", "alerts", F.explode("tactics").alias("tactic"))
        .groupBy("tactic")
        .agg(F.countDistinct("technique").alias("techniques"), F.bool_or("enabled").alias("active"), F.sum("alerts").alias("alerts"))
    )
    out = names.join(per, "tactic", "left").na.fill(0, ["techniques", "alerts"]).na.fill(False, ["active"])
    return out.withColumn("covered", F.col("techniques") > 0).orderBy("position")


# ---------- inventory ----------


def _involved(inventory: DataFrame, alerts: DataFrame, by: list[tuple[Column, Column]]) -> DataFrame:
    """(item, alert) pairs through any of several keys, as a union of equi-joins."""
    out = None
    for mine, theirs in by:
        a = inventory.select(F.col("id").alias("item_id"), mine.alias("_key"))
        b = alerts.select(F.col("id").alias("alert_id"), theirs.alias("_key")).filter("_key is not null")
        found = a.join(b, "_key").select("item_id", "alert_id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def asset_keys() -> list[tuple[Column, Column]]:
    return [
        (F.col("id"), F.col("asset_id")),
        (F.col("hostname"), F.col("host")),
        (short_name(F.col("hostname")), short_name(F.col("host"))),
    ]


def identity_keys() -> list[tuple[Column, Column]]:
    return [
        (F.col("id"), F.col("identity_id")),
        (F.col("username"), F.col("username")),
        (F.col("username"), F.col("target_username")),
    ]


def last_seen(inventory: DataFrame, events: DataFrame, name: str, recorded: str, field: str) -> DataFrame:
    """Latest event per item by recorded id or by name; events are summed per key first."""
    per = lambda key: events.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.unix_micros("timestamp")).alias("us")
    )
    by_id = inventory.select(F.col("id").alias("item_id"), F.col("id").alias("_key")).join(per(recorded), "_key")
    by_name = inventory.select(F.col("id").alias("item_id"), F.col(name).alias("_key")).join(per(field), "_key")
    both = by_id.select("item_id", "us").unionByName(by_name.select("item_id", "us"))
    return both.groupBy("item_id").agg(F.max("us").alias("last_seen_us"))


def _activity(inventory: DataFrame, involved: DataFrame, alerts: DataFrame, incidents: DataFrame, members: DataFrame, named: DataFrame, seen: DataFrame) -> DataFrame:
    rows = involved.join(
        alerts.select(F.col("id").alias("alert_id"), "status", "last_us"), "alert_id"
    )
    totals = rows.groupBy("item_id").agg(F.count("*").alias("total_alerts"), F.count_if(is_open()).alias("open_alerts"))

    def latest(df: DataFrame, key: str, alias: str) -> DataFrame:
        w = Window.partitionBy("item_id").orderBy(F.col("last_us").desc(), key)
        top = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= RECENT)
        ordered = F.array_sort(F.collect_list(F.struct("_r", key)))
        return top.groupBy("item_id").agg(F.transform(ordered, lambda x: x[key]).alias(alias))

    links = involved.join(members, "alert_id").select("item_id", "incident_id").unionByName(named).distinct()
    cases = links.join(incidents.select("incident_id", "status", "last_us"), "incident_id")
    sums = cases.groupBy("item_id").agg(
        F.count("*").alias("total_incidents"), F.count_if(F.col("status").isin(ACTIVE_INCIDENT)).alias("open_incidents")
    )
    out = inventory.select(F.col("id").alias("item_id"))
    for part in (totals, sums, seen, latest(rows, "alert_id", "recent_alerts"), latest(cases, "incident_id", "recent_incidents")):
        out = out.join(part, "item_id", "left")
    return out.na.fill(0, ["total_alerts", "open_alerts", "total_incidents", "open_incidents"])


def asset_activity(assets: DataFrame, alerts: DataFrame, incidents: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Per asset: its alerts and incidents, when it was last seen, and the recent ones."""
    hosts = incidents.select("incident_id", F.explode("hosts").alias("hostname"))
    named = assets.select(F.col("id").alias("item_id"), "hostname").join(hosts, "hostname").select("item_id", "incident_id")
    seen = last_seen(assets, events, "hostname", "asset_id", "host")
    return _activity(assets, _involved(assets, alerts, asset_keys()), alerts, incidents, members, named, seen)


def identity_activity(identities: DataFrame, alerts: DataFrame, incidents: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """As asset_activity, for accounts."""
    users = incidents.select("incident_id", F.explode("users").alias("username"))
    named = identities.select(F.col("id").alias("item_id"), "username").join(users, "username").select("item_id", "incident_id")
    seen = last_seen(identities, events, "username", "identity_id", "username")
    return _activity(identities, _involved(identities, alerts, identity_keys()), alerts, incidents, members, named, seen)


def list_activity(inventory: DataFrame, alerts: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """Open alerts and the last event of every asset or identity in one pass."""
    asset = kind == "asset"
    involved = _involved(inventory, alerts.filter(is_open()), asset_keys() if asset else identity_keys())
    open_alerts = involved.groupBy("item_id").agg(F.count("*").alias("open_alerts"))
    names = ("hostname", "asset_id", "host") if asset else ("username", "identity_id", "username")
    out = inventory.select(F.col("id").alias("item_id")).join(open_alerts, "item_id", "left")
    return out.join(last_seen(inventory, events, *names), "item_id", "left").na.fill(0, ["open_alerts"])


def inventory_context(
    hosts: DataFrame, actors: DataFrame, targets: DataFrame, assets: DataFrame, identities: DataFrame
) -> DataFrame:
    """(kind, name, item_id, roles): known assets and identities with their roles, and the names that
    are in no inventory (item_id null). Inputs: one column `name` each."""
    exact = assets.select(F.col("hostname").alias("name"), F.col("id").alias("exact_id"))
    only = assets.groupBy(short_name(F.col("hostname")).alias("short")).agg(
        F.min("id").alias("short_id"), F.count("*").alias("n")
    ).filter("n = 1").drop("n")
    found = (
        hosts.select("name").distinct().withColumn("short", short_name(F.col("name")))
        .join(exact, "name", "left")
        .join(only, "short", "left")
        .select(F.lit("host").alias("kind"), "name", F.coalesce("exact_id", "short_id").alias("item_id"), F.lit("").alias("roles"))
    )
    people = actors.select("name", F.lit("actor").alias("role")).unionByName(targets.select("name", F.lit("target").alias("role")))
    roles = people.distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))
    known = identities.select(F.col("username").alias("name"), F.col("id").alias("item_id"))
    accounts = roles.join(known, "name", "left").select(F.lit("account").alias("kind"), "name", "item_id", "roles")
    return found.unionByName(accounts)


def search_inventory(inventory: DataFrame, columns: list[str], text: str | None = None, tag: str | None = None, **equal: str) -> DataFrame:
    """Literal substring over some columns, equality on others, and a tag."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        inventory = inventory.filter(hit)
    for name, value in equal.items():
        if value:
            inventory = inventory.filter(F.col(name) == value)
    if tag:
        inventory = inventory.filter(F.array_contains("tags", tag.lower()))
    return inventory.orderBy(columns[0])


def batch_list(batches: DataFrame, source_id: str | None = None, limit: int = 50) -> DataFrame:
    rows = batches if source_id is None else batches.filter(F.col("source_id") == source_id)
    return rows.orderBy(F.col("created_us").desc(), "batch_id").limit(limit)


def simulated_split(raw: DataFrame) -> DataFrame:
    return raw.groupBy("simulated").agg(F.count("*").alias("records"))
