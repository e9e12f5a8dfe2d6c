"""What an incident derives from its alerts, and the views of it.

`members` is always (incident_id, alert_id); per-incident sets are built from distinct
(incident, value) rows, so a large incident is reduced before it meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.lineage import cut
from emberwatch.operators.priority import incident_risk
from emberwatch.schema import SEVERITIES

MAX_TITLE, RAW_PREVIEW = 300, 1024


def _sets(rows: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    return rows.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(alias))


def _severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), c)


def kind_of_finding() -> Column:
    return F.concat_ws(":", "rule_id", "indicator")


def incident_order() -> list[Column]:
    return [F.col("first_us"), F.col("last_us"), F.col("rule_id"), F.col("id")]


def rollup_incidents(members: DataFrame, alerts: DataFrame, subjects: DataFrame) -> DataFrame:
    """Sets, span, severity, counts, stages and the top alert of each incident."""
    sets = ["hosts", "users", "sources", "tactics", "techniques"]
    rows = members.select("incident_id", F.col("alert_id").alias("id")).join(
        alerts.select("id", "rule_id", "indicator", "severity", "priority_score", "priority_breakdown", "title",
                      "first_us", "last_us", "simulated"), "id",
    )
    values = members.select("incident_id", F.col("alert_id").alias("id")).join(subjects.select("id", *sets), "id")
    out = rows.groupBy("incident_id").agg(
        F.count("*").alias("alert_count"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max_by("severity", _severity_rank(F.col("severity"))).alias("severity"),
        F.bool_or("simulated").alias("simulated"),
        F.max_by(
            F.struct("priority_score", "title", "priority_breakdown"), F.struct("priority_score", "last_us", "id")
        ).alias("top"),
    )
    tagged = lambda c: F.transform(c, lambda v: F.struct(F.lit(c).alias("set"), v.alias("value")))
    pairs = F.flatten(F.array(*[tagged(c) for c in sets]))
    each = values.select("incident_id", F.explode(pairs).alias("p")).select("incident_id", "p.set", "p.value").distinct()
    gathered = each.groupBy("incident_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("set") == c, F.col("value")))).alias(c) for c in sets]
    )
    stages = _sets(rows.withColumn("stage", kind_of_finding()), "incident_id", "stage", "stages")
    joined = out.join(gathered, "incident_id", "left").join(stages, "incident_id")
    return joined.select(
        "*",
        F.col("top.priority_score").alias("top_score"),
        F.col("top.title").alias("top_title"),
        F.exists(F.col("top.priority_breakdown"), lambda f: f["factor"] == "identity").alias("top_has_privileged"),
    ).drop("top")


def privileged_identity(
    members: DataFrame, alerts: DataFrame, links: DataFrame, events: DataFrame, identities: DataFrame
) -> DataFrame:
    """The smallest privileged username of each incident, among actors and target accounts."""
    privileged = identities.filter("privilege_level = 'privileged'").select("id", F.col("username").alias("privileged_identity"))
    alert_ids = members.select("incident_id", "alert_id")
    actors = alert_ids.join(
        alerts.select(F.col("id").alias("alert_id"), F.col("identity_id").alias("id")), "alert_id"
    ).select("incident_id", "id").distinct().join(privileged, "id")
    targets = (
        alert_ids.join(links, "alert_id")
        .join(events.select(F.col("id").alias("event_id"), "target_username"), "event_id")
        .select("incident_id", F.col("target_username").alias("privileged_identity"))
        .distinct()
        .join(privileged, "privileged_identity")
    )
    both = actors.select("incident_id", "privileged_identity").unionByName(targets.select("incident_id", "privileged_identity"))
    return both.groupBy("incident_id").agg(F.min("privileged_identity").alias("privileged_identity"))


def most_common(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """The most frequent value per incident; the smallest among equals."""
    counts = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy("incident_id", value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("incident_id").orderBy(F.col("n").desc(), value)
    best = counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return best.select("incident_id", F.col(value).alias(alias))


def incident_text(incidents: DataFrame, members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Adds the generated title and summary."""
    rows = members.select("incident_id", F.col("alert_id").alias("id")).join(
        alerts.select("id", "rule_id", "title", "username", "source_ip", "first_us", "last_us"), "id"
    )
    first = rows.groupBy("incident_id").agg(
        F.min_by("title", F.struct("first_us", "last_us", "rule_id", "id")).alias("first_title")
    )
    rules = _sets(rows, "incident_id", "rule_id", "rules")
    joined = (
        incidents.join(first, "incident_id")
        .join(rules, "incident_id")
        .join(most_common(rows, "username", "who"), "incident_id", "left")
        .join(most_common(rows, "source_ip", "origin"), "incident_id", "left")
    )
    n = F.size("hosts")
    named = F.concat(
        F.array_join(F.slice("hosts", 1, 2), ", "),
        F.when(n > 2, F.concat(F.lit(" and "), (n - 2).cast("string"), F.lit(" more"))).otherwise(""),
    )
    where = F.when(n > 0, F.concat(F.lit(" on "), named)).otherwise("")
    detail = F.concat_ws(" from ", "who", "origin")
    stage = F.when(F.size("stages") > 1, F.lit("Multi-stage activity")).otherwise(
        F.split_part("first_title", F.lit(" ("), F.lit(1))
    )
    many = F.concat(stage, where, F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))
    title = F.when(F.col("alert_count") == 1, F.col("first_title")).otherwise(F.substring(many, 1, MAX_TITLE))
    moment = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
    listed = lambda word, c: F.when(
        F.size(c) > 0, F.concat(F.lit(f"{word}: "), F.array_join(c, ", "), F.lit("."))
    )
    tactics = F.when(F.size("tactics") > 0, F.array_join("tactics", ", ")).otherwise("no mapped tactic")
    summary = F.concat_ws(
        " ",
        F.concat(
            F.col("alert_count").cast("string"), F.lit(" alert(s) from "), F.size("rules").cast("string"),
            F.lit(" rule(s) ("), F.array_join("rules", ", "), F.lit("); ATT&CK tactics: "), tactics, F.lit("."),
        ),
        listed("Hosts", "hosts"),
        listed("Accounts", "users"),
        listed("Sources", "sources"),
        F.concat(F.lit("Activity from "), moment("first_us"), F.lit(" to "), moment("last_us"), F.lit(" UTC.")),
    )
    return joined.withColumns({"title": title, "summary": summary}).drop("first_title", "rules", "who", "origin")


def build_incidents(
    members: DataFrame, alerts: DataFrame, subjects: DataFrame, links: DataFrame, events: DataFrame, identities: DataFrame
) -> DataFrame:
    rolled = rollup_incidents(members, alerts, subjects).join(
        privileged_identity(members, alerts, links, events, identities), "incident_id", "left"
    )
    return incident_text(incident_risk(rolled), members, alerts)


def incident_techniques(members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per incident and technique: name, tactics, the rules that map to it, each with its first
    reason."""
    rows = members.select("incident_id", F.col("alert_id").alias("id")).join(
        alerts.select("id", "rule_id", "first_us", "last_us", F.explode("mitre").alias("m")), "id"
    )
    place = F.struct("first_us", "last_us", "rule_id", "id")
    per_rule = rows.groupBy("incident_id", F.col("m.technique").alias("technique"), "rule_id").agg(
        F.min(place).alias("at"),
        F.min_by(F.struct("m.name", "m.tactics", "m.reason"), place).alias("first"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "rule_id", "first")))
    return per_rule.groupBy("incident_id", "technique").agg(ordered.alias("o")).select(
        "incident_id", "technique", F.col("o")[0]["first"]["name"].alias("name"), F.col("o")[0]["first"]["tactics"].alias("tactics"),
        F.transform("o", lambda x: x["rule_id"]).alias("rules"), F.transform("o", lambda x: x["first"]["reason"]).alias("reasons"),
    )


def response_steps(members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Recommended steps per alert in order of activity; each step once per incident."""
    rows = members.select("incident_id", F.col("alert_id").alias("id")).join(
        alerts.select("id", "rule_id", "title", "first_us", "last_us", F.posexplode("response").alias("pos", "step")), "id"
    )
    place = F.struct("first_us", "last_us", "rule_id", "id", "pos", "title")
    once = rows.groupBy("incident_id", "step").agg(F.min(place).alias("p"))
    return once.groupBy("incident_id", F.col("p.id").alias("alert_id"), F.col("p.rule_id").alias("rule_id"), F.col("p.title").alias("title")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p.pos", "step"))), lambda s: s["step"]).alias("steps")
    )


def incident_timeline(
    incident_id: str,
    members: DataFrame,
    links: DataFrame,
    events: DataFrame,
    alerts: DataFrame,
    activity: DataFrame,
    after: tuple[int, str, str] | None = None,
    limit: int = 50,
) -> DataFrame:
    """Evidence, alerts and activity of an incident in order (at, kind, ref), a page at a time,
    with what each entry says. `activity`: incident_id, seq, at, text."""
    mine = members.filter(F.col("incident_id") == incident_id).select("alert_id")
    cited = links.join(mine, "alert_id", "left_semi")
    ids = cited.select(F.col("event_id").alias("id")).distinct()
    seen = events.join(ids, "id", "left_semi").select(
        F.unix_micros("timestamp").alias("at"), F.lit("1event").alias("kind"), F.col("id").alias("ref"),
        F.concat_ws(" ", "event_category", "event_action", "event_outcome", "host", "username").alias("text"),
    )
    raised = alerts.join(mine.withColumnRenamed("alert_id", "id"), "id", "left_semi").select(
        F.col("created_us").alias("at"), F.lit("2alert").alias("kind"), F.col("id").alias("ref"), F.col("title").alias("text")
    )
    done = activity.filter(F.col("incident_id") == incident_id).select(
        "at", F.lit("3activity").alias("kind"), F.lpad(F.col("seq").cast("string"), 20, "0").alias("ref"), "text"
    )
    merged = seen.unionByName(raised).unionByName(done)
    if after is not None:
        cursor = F.struct(F.lit(after[0]).cast("bigint").alias("at"), F.lit(after[1]).alias("kind"), F.lit(after[2]).alias("ref"))
        merged = merged.filter((F.col("at") >= after[0]) & (F.struct("at", "kind", "ref") > cursor))
    page = cut(merged.orderBy("at", "kind", "ref").limit(limit))  # `limit` rows, read twice below
    rules = (
        cited.join(page.filter("kind = '1event'").select(F.col("ref").alias("event_id")), "event_id", "left_semi")
        .join(alerts.select(F.col("id").alias("alert_id"), "rule_id"), "alert_id")
        .groupBy(F.col("event_id").alias("ref"))
        .agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    )
    return page.join(rules, "ref", "left").orderBy("at", "kind", "ref")


def incident_queue(
    incidents: DataFrame,
    sort: str = "risk",
    status: list[str] | None = None,
    severity: list[str] | None = None,
    assigned_to: str | None = None,
    unassigned: bool = False,
    host: str | None = None,
    username: str | None = None,
    source_ip: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    rows = incidents
    if status:
        rows = rows.filter(F.col("status").isin(status))
    if severity:
        rows = rows.filter(F.col("severity").isin(severity))
    if assigned_to:
        rows = rows.filter(F.col("assigned_to") == assigned_to)
    if unassigned:
        rows = rows.filter(F.col("assigned_to").isNull())
    wanted = {"hosts": host and host.lower(), "users": username and username.lower(), "sources": source_ip}
    for name, value in wanted.items():
        if value:
            rows = rows.filter(F.array_contains(name, value))
    order = [F.col("last_us").desc(), F.col("incident_id")]
    if sort == "risk":
        order.insert(0, F.col("risk_score").desc())
    return rows.orderBy(*order).offset(offset).limit(limit)


def current_pins(evidence_log: DataFrame) -> DataFrame:
    """Targets whose latest entry pins them; log: incident_id, event_id, alert_id, action, at, id."""
    target = F.coalesce(F.concat(F.lit("event "), "event_id"), F.concat(F.lit("alert "), "alert_id"))
    latest = evidence_log.groupBy("incident_id", target.alias("target")).agg(
        F.max_by("action", F.struct("at", "id")).alias("action"), F.max("at").alias("at")
    )
    return latest.filter("action = 'PIN'")


def incident_members(links: DataFrame, alerts: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Linked alerts in order of their activity."""
    rows = links if incident_id is None else links.filter(F.col("incident_id") == incident_id)
    return rows.withColumnRenamed("alert_id", "id").join(alerts, "id").orderBy("incident_id", *incident_order())


def alert_incident(links: DataFrame, incidents: DataFrame, alert_id: str) -> DataFrame:
    mine = links.filter(F.col("alert_id") == alert_id).select("incident_id")
    return incidents.join(mine, "incident_id", "left_semi")


def incident_log(notes: DataFrame, activity: DataFrame, users: DataFrame, incident_id: str | None = None) -> DataFrame:
    """Notes and activity with their author, in order; both: incident_id, seq, at, author_id, text."""
    rows = notes.withColumn("kind", F.lit("note")).unionByName(activity.withColumn("kind", F.lit("activity")))
    if incident_id is not None:
        rows = rows.filter(F.col("incident_id") == incident_id)
    people = users.select(F.col("id").alias("author_id"), F.col("email").alias("author"))
    return rows.join(people, "author_id", "left").orderBy("at", "seq")
