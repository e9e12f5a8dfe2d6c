"""Alerts: detections of the same activity folded into one record, scored and queried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.lineage import cut, stored
from emberwatch.operators.enrich import match_assets
from emberwatch.operators.priority import alert_priority, band
from emberwatch.plans.rules import ATTACK_VERSION, TECHNIQUES, mappings
from emberwatch.schema import ACTIVE_ALERT

# Sizes an alert is kept to, and the order of criticality.
RELATED_WINDOW = 86_400_000_000
ENTITY_COLUMNS = ["host", "username", "target_username", "source_ip", "destination_ip"]
CRITICALITY = ["low", "medium", "high", "critical"]

MITRE = "array<struct<technique:string,name:string,tactics:array<string>,reason:string,attack_version:string>>"


def is_open(status: str = "status") -> Column:
    return F.col(status).isin(ACTIVE_ALERT)


def _json_text(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def dedup_key(rule: Column, indicator: Column, names: Column, values: Column) -> Column:
    """SHA-256 of the rule, the indicator and the grouped values in order of their names."""
    pairs = F.array_sort(F.arrays_zip(names.alias("k"), values.alias("v")))
    listed = F.transform(pairs, lambda p: F.concat(_json_text(p["k"]), F.lit(": "), _json_text(p["v"])))
    text = F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}"))
    return F.sha2(F.concat_ws("\x1f", rule, F.coalesce(indicator, F.lit("")), text), 256)


def title(rule_name: Column, indicator_name: Column, values: Column) -> Column:
    name = F.concat_ws(": ", rule_name, indicator_name)
    full = F.when(
        F.size(values) > 0, F.concat(name, F.lit(" ("), F.array_join(values, ", "), F.lit(")"))
    ).otherwise(name)
    return full


def with_keys(detections: DataFrame) -> DataFrame:
    return detections.withColumns(
        {
            "dedup_key": dedup_key(
                F.col("rule_id"), F.col("indicator"), F.col("group_names"), F.col("group_values")
            ),
            "title": title(F.col("rule_name"), F.col("indicator_name"), F.col("group_values")),
        }
    )


def alert_entities(detections: DataFrame) -> DataFrame:
    """The grouped value of each entity column, or the only value in the evidence, or null."""
    group = F.map_from_arrays("group_names", "group_values")
    found = {}
    for name in ENTITY_COLUMNS:
        top = F.try_element_at("entities", F.lit(name))
        only = F.when(F.size(top) == 1, F.element_at(top, 1))
        found[name] = F.coalesce(F.try_element_at(group, F.lit(name)), only)
    return detections.withColumns(found)


def attach_techniques(detections: DataFrame, rules: list[dict], techniques: list[tuple] = TECHNIQUES) -> DataFrame:
    """Adds `mitre`: the indicator's techniques, or the rule's, with names and tactics. An unknown
    technique keeps its id and has no tactics. The mapping is as small as the rule library."""
    known = {t: (name, tactics) for t, name, tactics in techniques}
    by_key: dict[tuple[str, str], list] = {}
    for rule, indicator, technique, reason in mappings(rules):
        by_key.setdefault((rule, indicator), []).append((technique, reason))
    out = F.array().cast(MITRE)
    for (rule, indicator), refs in by_key.items():
        entries = []
        for technique, reason in refs:
            name, tactics = known.get(technique, (technique, []))
            tactics = F.array(*[F.lit(t) for t in tactics]).cast("array<string>")
            parts = [F.lit(technique), F.lit(name), tactics, F.lit(reason), F.lit(ATTACK_VERSION)]
            entries.append(F.struct(*parts))
        same = (F.col("rule_id") == rule) & (F.coalesce("indicator", F.lit("")) == indicator)
        out = F.when(same, F.array(*entries).cast(MITRE)).otherwise(out)
    return detections.withColumn("mitre", out)


LATEST = [
    "severity", "confidence", "explanation", "facts", "entities", "response", "mitre", "title", "threshold",
    *ENTITY_COLUMNS,
]
FIXED = ["rule_id", "indicator", "kind", "category", "group_names", "group_values"]


def apply_detections(
    detections: DataFrame,
    rules: list[dict],
    now_us: int | Column,
    alerts: DataFrame | None = None,
    links: DataFrame | None = None,
    evidence: DataFrame | None = None,
    history: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """A new snapshot of (alerts, links) with the detections applied. `evidence` (match_id, us, id)
    is all evidence of the detections; without it only the sample that they show is linked.
    `history` is how many of its latest detections an alert shows.

    Evidence already linked to any alert of the same key changes nothing, so applying twice is the
    same as once. New evidence extends the open alert of the key, or opens one that points to
    the latest closed. Detections of one key fold in time order; every step is a join or an
    aggregation by key with rank limits, so a key with very many detections stays spread."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    # Detections are read four times below, and each snapshot is the input of the next one.
    det = cut(alert_entities(attach_techniques(with_keys(detections), rules)))
    owners = det.select("dedup_key", "match_id", "first_us")
    if evidence is None:
        cited = det.select(*owners.columns, F.posexplode("evidence_ids").alias("pos", "event_id"))
        partly = F.bool_or(F.col("event_count") > F.size("evidence_ids"))
    else:
        cited = owners.join(evidence.select("match_id", F.col("us").alias("pos"), F.col("id").alias("event_id")), "match_id")
        partly = F.lit(False)
    if links is not None:
        known = links.join(
            alerts.select(F.col("id").alias("alert_id"), "dedup_key"), "alert_id"
        ).select("dedup_key", "event_id")
        cited = cited.join(known, ["dedup_key", "event_id"], "left_anti")
    owner = F.struct("first_us", "match_id", "pos")
    new = cut(cited.groupBy("dedup_key", "event_id").agg(F.min(owner).alias("o")))
    fresh = new.groupBy("dedup_key", F.col("o.match_id").alias("match_id")).agg(
        F.count("*").alias("new_evidence")
    )
    changed = det.join(fresh, ["dedup_key", "match_id"])
    order = F.struct("first_us", "match_id")
    size = F.when(F.col("kind") == "distinct", F.col("distinct_count")).otherwise(F.col("event_count"))
    entry = F.struct(
        F.col("first_us").alias("first_us"),
        "last_us",
        "event_count",
        "new_evidence",
        "explanation",
    )
    recent = Window.partitionBy("dedup_key").orderBy(F.col("first_us").desc(), F.col("match_id").desc())
    newest = (
        changed.select("dedup_key", "match_id", "first_us", entry.alias("entry"))
        .withColumn("_r", F.row_number().over(recent))
        .filter(F.col("_r") <= history)
        .groupBy("dedup_key")
        .agg(F.array_sort(F.collect_list("entry")).alias("new_history"))
    )
    folded = (
        changed.groupBy("dedup_key")
        .agg(
            *[F.first(c).alias(c) for c in FIXED],
            F.max_by(F.struct(*LATEST), order).alias("latest"),
            F.min("first_us").alias("opened_us"),
            F.max(size).alias("new_peak"),
            F.count("*").alias("new_detections"),
            partly.alias("cut"),
        )
        .join(newest, "dedup_key")
        .select("*", *[F.col(f"latest.{c}").alias(c) for c in LATEST])
        .drop("latest")
    )
    if alerts is None:
        empty = {
            "alert_id": "string", "linked": "bigint", "peak_count": "bigint", "detection_count": "bigint",
            "evidence_truncated": "boolean", "history": "array<struct<first_us:bigint,last_us:bigint,event_count:bigint,new_evidence:bigint,explanation:string>>",
            "previous_alert_id": "string", "status": "string", "created_us": "bigint", "triaged_us": "bigint",
            "resolved_us": "bigint", "disposition": "string",
        }
        joined = folded.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    else:
        kept = alerts.filter(is_open()).select(
            "dedup_key", F.col("id").alias("alert_id"), F.col("event_count").alias("linked"), "peak_count",
            "detection_count", "evidence_truncated", "history", "previous_alert_id", "status", "created_us",
            "triaged_us", "resolved_us", "disposition",
        )
        closed = alerts.filter(~is_open()).groupBy("dedup_key").agg(
            F.max_by("id", F.struct("created_us", "id")).alias("closed_id")
        )
        joined = folded.join(kept, "dedup_key", "left").join(closed, "dedup_key", "left")
        joined = joined.withColumn(
            "previous_alert_id",
            F.when(F.col("alert_id").isNull(), F.col("closed_id")).otherwise(F.col("previous_alert_id")),
        ).drop("closed_id")
    opened = F.concat_ws("-", "dedup_key", F.col("opened_us").cast("string"))
    targets = cut(joined.withColumn("id", F.coalesce("alert_id", opened)))
    added = cut(
        link_evidence(
            new.select("dedup_key", "event_id", F.col("o").alias("order")),
            targets.select("dedup_key", "id", F.coalesce("linked", F.lit(0)).alias("linked")),
        )
    )
    spans = added.groupBy("dedup_key").agg(
        F.count_if("kept").alias("added"), F.bool_or(~F.col("kept")).alias("over")
    )
    touched = (
        targets.join(spans, "dedup_key")
        .withColumns(
            {
                "event_count": F.coalesce("linked", F.lit(0)) + F.col("added"),
                "peak_count": F.greatest("peak_count", "new_peak"),
                "detection_count": F.coalesce("detection_count", F.lit(0)) + F.col("new_detections"),
                "evidence_truncated": F.coalesce("evidence_truncated", F.lit(False)) | F.col("cut") | F.col("over"),
                "history": merge_history(F.coalesce("history", F.array()), F.col("new_history"), history),
                "status": F.coalesce("status", F.lit("NEW")),
                "created_us": F.coalesce("created_us", now),
            }
        )
        .drop("alert_id", "linked", "added", "over", "cut", "new_peak", "new_detections", "new_history", "opened_us")
    )
    out_links = added.filter("kept").select(F.col("id").alias("alert_id"), "event_id")
    if alerts is not None:
        names = touched.columns
        rest = alerts.join(touched.select("id"), "id", "left_anti").select(*names)
        touched = touched.unionByName(rest)
        out_links = links.select("alert_id", "event_id").unionByName(out_links)
    return cut(touched), out_links


def link_evidence(new: DataFrame, targets: DataFrame, cap: int | None = None) -> DataFrame:
    """New evidence of each key, all of it `kept`; with a cap, in order while the alert has room.
    Ranks up to the cap are limited before rows move; what is beyond it is only known to exist."""
    if cap is None:
        return new.join(targets, "dedup_key").withColumn("kept", F.lit(True))
    w = Window.partitionBy("dedup_key").orderBy("order", "event_id")
    ranked = new.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap + 1)
    return ranked.join(targets, "dedup_key").withColumn("kept", F.col("_r") + F.col("linked") <= cap)


def merge_history(old: Column, new: Column, keep: int) -> Column:
    both = F.concat(old, new)
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - (keep - 1)), keep)


def alert_context(
    links: DataFrame, events: DataFrame, assets: DataFrame, identities: DataFrame
) -> DataFrame:
    """Per alert, from all linked evidence: time span, whether it is simulated, the most critical
    asset, and the most privileged actor and target. Assets and actors count both as recorded on
    the events and as matched against the inventory now."""
    # The evidence meets its events once; six sums below read what they need of it.
    rows = stored(links.join(
        events.select(
            F.col("id").alias("event_id"), "host", "host_ip", "username", "target_username",
            F.col("asset_id").alias("recorded_asset"), F.col("identity_id").alias("recorded_identity"),
            "simulated", F.unix_micros("timestamp").alias("us"),
        ),
        "event_id",
    ).drop("event_id"))
    spans = rows.groupBy("alert_id").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.bool_or("simulated").alias("simulated")
    )
    matched = match_assets(rows, assets).filter("asset_id is not null").withColumnsRenamed(
        {"host": "_h", "host_ip": "_i"}
    )
    hosts = rows.select("alert_id", "host", "host_ip", "recorded_asset").distinct()
    here = F.col("host").eqNullSafe(F.col("_h")) & F.col("host_ip").eqNullSafe(F.col("_i"))
    asset_ids = (
        hosts.join(matched, here, "left")
        .select("alert_id", F.explode(F.array("asset_id", "recorded_asset")).alias("id"))
        .filter("id is not null")
        .distinct()
    )
    rank = F.array_position(F.array(*[F.lit(c) for c in CRITICALITY]), F.col("criticality"))
    best = asset_ids.join(assets.select("id", "hostname", "criticality"), "id").groupBy("alert_id").agg(
        F.max(F.struct(rank.alias("rank"), F.col("hostname"), F.col("criticality"), F.col("id"))).alias("a")
    )
    level = (F.col("privilege_level") == "privileged").alias("p")
    people = identities.select("id", "username", level)
    by_name = lambda c: (
        rows.select("alert_id", F.col(c).alias("username")).distinct().join(people, "username")
    )
    by_id = (
        rows.select("alert_id", F.col("recorded_identity").alias("id")).distinct().join(people, "id")
    )
    top = F.max(F.struct("p", "username", "id"))
    actors = by_name("username").unionByName(by_id).groupBy("alert_id").agg(top.alias("i"))
    targets = by_name("target_username").groupBy("alert_id").agg(top.alias("t"))
    return (
        spans.join(best, "alert_id", "left")
        .join(actors, "alert_id", "left")
        .join(targets, "alert_id", "left")
        .select(
            "alert_id", "first_us", "last_us", "simulated",
            F.col("a.id").alias("asset_id"), F.col("a.hostname").alias("asset_name"),
            F.col("a.criticality").alias("asset_level"),
            F.col("i.id").alias("identity_id"), F.col("i.username").alias("actor"),
            F.col("i.p").alias("actor_privileged"),
            F.col("t.username").alias("target"), F.col("t.p").alias("target_privileged"),
        )
    )


CONTEXT = [
    "first_us", "last_us", "simulated", "asset_id", "asset_name", "asset_level", "identity_id", "actor",
    "actor_privileged", "target", "target_privileged",
]
SCORE = ["priority_breakdown", "priority_score", "priority_band"]


def score_alerts(
    alerts: DataFrame, links: DataFrame, events: DataFrame, assets: DataFrame, identities: DataFrame
) -> DataFrame:
    """Alerts with their context and priority computed anew."""
    context = alert_context(links, events, assets, identities).withColumnRenamed("alert_id", "id")
    return alert_priority(alerts.drop(*CONTEXT, *SCORE).join(context, "id"))


def reprioritize(
    alerts: DataFrame, links: DataFrame, events: DataFrame, assets: DataFrame, identities: DataFrame
) -> DataFrame:
    """Open alerts scored again after the inventory changed; closed ones keep their score."""
    open_alerts = alerts.filter(is_open())
    mine = links.join(open_alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
    scored = score_alerts(open_alerts, mine, events, assets, identities)
    return scored.unionByName(alerts.filter(~is_open()).select(*scored.columns))


def filter_alerts(
    alerts: DataFrame,
    status: list[str] | None = None,
    severity: list[str] | None = None,
    bands: list[str] | None = None,
    rule_id: str | None = None,
    host: str | None = None,
    username: str | None = None,
    source_ip: str | None = None,
    since_us: int | None = None,
    until_us: int | None = None,
) -> DataFrame:
    for name, values in (("status", status), ("severity", severity), ("priority_band", bands)):
        if values:
            alerts = alerts.filter(F.col(name).isin(values))
    equal = {"rule_id": rule_id, "host": host and host.lower(), "username": username and username.lower(), "source_ip": source_ip}
    for name, value in equal.items():
        if value:
            alerts = alerts.filter(F.col(name) == value)
    if since_us is not None:
        alerts = alerts.filter(F.col("last_us") >= since_us)
    return alerts if until_us is None else alerts.filter(F.col("first_us") <= until_us)


def alert_queue(alerts: DataFrame, sort: str = "priority", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    order = [F.col("last_us").desc(), F.col("id")]
    if sort == "priority":
        order.insert(0, F.col("priority_score").desc())
    return filter_alerts(alerts, **filters).orderBy(*order).offset(offset).limit(limit)


def group_alerts(
    alerts: DataFrame, by: str, names: dict[str, str] | None = None, limit: int = 100, **filters
) -> DataFrame:
    """The queue counted per rule, host, username or source: a page of its first groups."""
    key = {"rule": "rule_id"}.get(by, by)
    rows = filter_alerts(alerts, **filters).filter(F.col(key).isNotNull())
    groups = rows.groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("alerts"),
        F.count_if(is_open()).alias("open"),
        F.max("priority_score").alias("top_priority"),
        F.max("last_us").alias("last_us"),
    )
    label = F.col("key")
    for rule, name in (names or {}).items() if by == "rule" else ():
        label = F.when(F.col("key") == rule, F.lit(name)).otherwise(label)
    groups = groups.withColumns({"label": label, "top_band": band(F.col("top_priority"))})
    return groups.orderBy(F.col("top_priority").desc(), F.col("alerts").desc(), "key").limit(limit)


def alert_evidence(
    links: DataFrame, events: DataFrame, raw: DataFrame, alert_id: str, limit: int = 100, offset: int = 0
) -> DataFrame:
    mine = links.filter(F.col("alert_id") == alert_id).select(F.col("event_id").alias("id"))
    raws = raw.select(F.col("id").alias("raw_event_id"), "raw_data")
    rows = events.join(mine, "id", "left_semi").join(raws, "raw_event_id")
    return rows.orderBy("timestamp", "id").offset(offset).limit(limit)


def related_alerts(alerts: DataFrame, alert_id: str, limit: int = 20) -> DataFrame:
    """Other alerts sharing the host, user or source of one alert within a day of it, with labels."""
    labels = {"host": "host", "username": "user", "source_ip": "source"}

    def values(df: DataFrame, *more: str) -> DataFrame:
        pairs = [
            F.struct(F.lit(word).alias("word"), F.col(name).alias("text")) for name, word in labels.items()
        ]
        return df.select(*more, F.explode(F.array(*pairs)).alias("e")).filter(
            "e.text is not null and e.text != ''"
        )

    one = values(
        alerts.filter(F.col("id") == alert_id),
        F.col("first_us").alias("from_us"),
        F.col("last_us").alias("to_us"),
    )
    others = values(
        alerts.filter(F.col("id") != alert_id), "id", "rule_id", "priority_score", "first_us", "last_us"
    )
    near = (F.col("last_us") >= F.col("from_us") - RELATED_WINDOW) & (
        F.col("first_us") <= F.col("to_us") + RELATED_WINDOW
    )
    label = F.concat_ws(" ", "e.word", "e.text")
    return (
        others.join(one, "e")
        .filter(near)
        .groupBy("id", "rule_id", "priority_score", "last_us")
        .agg(F.array_sort(F.collect_set(label)).alias("shared"))
        .orderBy(F.col("priority_score").desc(), F.col("last_us").desc(), "id")
        .limit(limit)
    )


def alerts_citing(links: DataFrame, alerts: DataFrame, event_id: str) -> DataFrame:
    mine = links.filter(F.col("event_id") == event_id).select(F.col("alert_id").alias("id"))
    return alerts.join(mine, "id", "left_semi").orderBy("created_us")


def status_activity(audit: DataFrame, alert_id: str | None = None) -> DataFrame:
    """Status changes from the audit log, oldest first."""
    rows = audit.filter("action = 'ALERT_STATUS_CHANGED' and entity_type = 'ALERT'")
    if alert_id is not None:
        rows = rows.filter(F.col("entity_id") == alert_id)
    detail = lambda k: F.get_json_object("details", f"$.{k}")
    return rows.select(
        F.col("entity_id").alias("alert_id"), "occurred_at", "id", F.col("actor_label").alias("actor"),
        detail("from").alias("from_status"), detail("to").alias("to_status"),
        detail("disposition").alias("disposition"), detail("reason").alias("reason"),
    ).orderBy("occurred_at", "id")


