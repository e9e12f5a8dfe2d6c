"""Queries over alerts, enrichment and status changes, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import alerts as A
from emberwatch.operators import enrich, workflow
from emberwatch.plans.catalog_detect import B1, PRIV
from emberwatch.plans.oracle import ASSETS, EV, IDENTITIES, with_
from emberwatch.plans.rules import RULES_BY_ID
from emberwatch.sources import sample, store

STATUS = "['NEW', 'TRIAGED', 'IN_PROGRESS', 'RESOLVED', 'FALSE_POSITIVE']"
ALERTS = f"""
{EV}, {B1}, {PRIV}, {ASSETS}, {IDENTITIES},
al_e AS (
  SELECT 'AUTH-001' AS rule_id, NULL::VARCHAR AS indicator, host, username, source_ip AS gs, source_ip, NULL::VARCHAR AS target_username,
    t0::VARCHAR AS det, us, id, simulated, outcome, message FROM f1_e
  UNION ALL SELECT 'PRIV-001', indicator, host, username, NULL, source_ip, target_username, id, us, id, simulated, outcome, message
  FROM pr WHERE indicator IS NOT NULL),
al_d AS (SELECT rule_id, indicator, host, username, gs, det, count(*) AS n FROM al_e GROUP BY ALL),
al_b AS (
  SELECT rule_id, indicator, host, username, gs, count(*) AS event_count, count(DISTINCT det) AS detection_count,
    min(us) AS first_us, max(us) AS last_us, bool_or(simulated) AS simulated, bool_or(outcome = 'success') AS succeeded,
    arg_max(source_ip, (us, id)) AS source_ip, max(target_username) AS target_username,
    sha256(rule_id || chr(31) || coalesce(indicator, '') || chr(31) || '{{"host": "' || host || '", ' ||
      CASE WHEN gs IS NULL THEN '' ELSE '"source_ip": "' || gs || '", ' END || '"username": "' || username || '"}}') AS dedup_key
  FROM al_e GROUP BY rule_id, indicator, host, username, gs),
names AS (SELECT hostname AS name, min(id) AS id FROM assets GROUP BY 1),
labels AS (SELECT split_part(hostname, '.', 1) AS name, min(id) AS id FROM assets GROUP BY 1 HAVING count(*) = 1),
host_asset AS (
  SELECT h.host, coalesce(n.id, s.id, l.id) AS asset_id
  FROM (SELECT DISTINCT host FROM ev) h LEFT JOIN names n ON n.name = h.host
  LEFT JOIN names s ON s.name = split_part(h.host, '.', 1) LEFT JOIN labels l ON l.name = split_part(h.host, '.', 1)),
al_c AS (
  SELECT b.*, b.dedup_key || '-' || b.first_us AS id, ha.asset_id, a.hostname AS asset_name, a.criticality AS asset_level,
    i.id AS identity_id, i.username AS actor, i.privilege_level = 'privileged' AS actor_privileged,
    coalesce((SELECT max(n) FROM al_d d WHERE d.rule_id = b.rule_id AND d.indicator IS NOT DISTINCT FROM b.indicator
      AND d.host = b.host AND d.username = b.username AND d.gs IS NOT DISTINCT FROM b.gs), 0) AS peak_count,
    CASE WHEN b.indicator = 'root_shell' THEN 'low' ELSE 'medium' END AS confidence, 'medium' AS severity
  FROM al_b b LEFT JOIN host_asset ha ON ha.host = b.host LEFT JOIN assets a ON a.id = ha.asset_id
  LEFT JOIN identities i ON i.username = b.username),
al AS (
  SELECT *, CASE WHEN priority_score >= 75 THEN 'critical' WHEN priority_score >= 50 THEN 'high'
      WHEN priority_score >= 25 THEN 'medium' ELSE 'low' END AS priority_band,
    last_us + 60000000 AS created_us, {STATUS}[last_us % 5 + 1] AS status,
    CASE WHEN last_us % 5 > 0 THEN last_us + 60000000 + (last_us % 3600) * 1000000 END AS triaged_us,
    CASE WHEN last_us % 5 > 2 THEN last_us + 60000000 + (last_us % 7200 + 10) * 1000000 END AS resolved_us,
    CASE WHEN last_us % 5 = 3 THEN CASE WHEN last_us % 2 = 0 THEN 'confirmed_malicious' ELSE 'benign_expected' END END AS disposition
  FROM (SELECT *, (25 + CASE confidence WHEN 'medium' THEN 8 ELSE 0 END
    + CASE asset_level WHEN 'low' THEN 0 WHEN 'medium' THEN 5 WHEN 'high' THEN 10 WHEN 'critical' THEN 15 ELSE 5 END
    + CASE WHEN actor_privileged THEN 10 ELSE 0 END
    + CASE WHEN rule_id = 'AUTH-001' AND peak_count >= 4 THEN 5 ELSE 0 END)::INT AS priority_score FROM al_c))"""
OPEN = "status IN ('NEW', 'TRIAGED', 'IN_PROGRESS')"
TOP = "(SELECT id FROM al ORDER BY priority_score DESC, last_us DESC, id LIMIT 1)"


def top_alert(s, d) -> str:
    return A.alert_queue(store.alerts(s, d), limit=1).first()["id"]


EARLY = "(SELECT id FROM al ORDER BY first_us, id LIMIT 1 OFFSET 20)"


def early_alert(s, d) -> str:
    return store.alerts(s, d).orderBy("first_us", "id").offset(20).limit(1).first()["id"]


def _sql(body: str, *ctes: str) -> str:
    return with_(ALERTS, *ctes, body=body)


def _changes(s, d):
    """A log of status changes, one per linked event, derived from its time."""
    targets = F.array(*[F.lit(x) for x in store.STATUSES])
    at = F.col("us") + F.col("n") * 3_600_000_000
    ev = sample.events(s, d).select(F.col("id").alias("event_id"), F.unix_micros("timestamp").alias("us"))
    return (
        store.links(s, d).join(ev, "event_id")
        .withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(4)])))
        .select(
            F.col("alert_id").alias("item_id"),
            F.concat_ws("-", "event_id", F.col("n").cast("string")).alias("change_id"),
            at.alias("at"),
            F.element_at(targets, ((F.col("us") + F.col("n") * 7) % 5 + 1).cast("int")).alias("to_status"),
            F.when((F.col("us") + F.col("n") * 7) % 5 == 3, F.when(F.col("us") % 2 == 0, F.lit("benign_expected"))).alias("disposition"),
            F.when(F.expr("us div 5") % 3 > 0, F.lit("seen")).alias("reason"),
        )
    )


def _replayed(s, d):
    first = store.alerts(s, d).select(F.col("id").alias("item_id"), F.lit("NEW").alias("status"))
    return workflow.fold_transitions(first, _changes(s, d))


REPLAY = """
ch AS (
  SELECT a.id AS item_id, e.id || '-' || n AS change_id, e.us + n * 3600000000 AS moved,
    ['NEW', 'TRIAGED', 'IN_PROGRESS', 'RESOLVED', 'FALSE_POSITIVE'][(e.us + n * 7) % 5 + 1] AS tgt,
    CASE WHEN (e.us + n * 7) % 5 = 3 AND e.us % 2 = 0 THEN 'benign_expected' END AS disposition,
    CASE WHEN (e.us // 5) % 3 > 0 THEN 'seen' END AS reason
  FROM al a JOIN al_e e ON e.rule_id = a.rule_id AND e.indicator IS NOT DISTINCT FROM a.indicator AND e.host = a.host
    AND e.username = a.username AND e.gs IS NOT DISTINCT FROM a.gs CROSS JOIN range(4) r(n)),
cn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY moved, change_id) AS k FROM ch),
wk AS (
  SELECT item_id, 0::BIGINT AS k, 'NEW' AS st, NULL::VARCHAR AS change_id, NULL::BIGINT AS moved, NULL::VARCHAR AS from_status,
    NULL::VARCHAR AS to_status, NULL::VARCHAR AS code FROM (SELECT DISTINCT item_id FROM cn)
  UNION ALL
  SELECT item_id, k, CASE WHEN code IS NULL THEN tgt ELSE st END, change_id, moved, st, tgt, code FROM (
    SELECT c.*, w.st, CASE
      WHEN c.tgt = w.st THEN 'already'
      WHEN NOT list_contains(CASE w.st WHEN 'NEW' THEN ['TRIAGED', 'IN_PROGRESS', 'FALSE_POSITIVE']
        WHEN 'TRIAGED' THEN ['IN_PROGRESS', 'RESOLVED', 'FALSE_POSITIVE'] WHEN 'IN_PROGRESS' THEN ['TRIAGED', 'RESOLVED', 'FALSE_POSITIVE']
        ELSE ['TRIAGED'] END, c.tgt) THEN 'not_allowed'
      WHEN c.tgt = 'RESOLVED' AND c.disposition IS NULL THEN 'disposition_required'
      WHEN c.tgt <> 'RESOLVED' AND c.disposition IS NOT NULL THEN 'disposition_unexpected'
      WHEN (c.tgt = 'FALSE_POSITIVE' OR w.st IN ('RESOLVED', 'FALSE_POSITIVE')) AND c.reason IS NULL THEN 'reason_required' END AS code
    FROM wk w JOIN cn c ON c.item_id = w.item_id AND c.k = w.k + 1))"""


def _audit(s, d):
    """The status changes as audit entries."""
    return _changes(s, d).select(
        F.lit("ALERT_STATUS_CHANGED").alias("action"), F.lit("ALERT").alias("entity_type"),
        F.col("item_id").alias("entity_id"), F.col("at").alias("occurred_at"), F.col("change_id").alias("id"),
        F.lit("ana@example.org").alias("actor_label"),
        F.to_json(F.struct(F.col("to_status").alias("to"), "disposition", "reason")).alias("details"),
    )


def _reapplied(s, d):
    """Applying the same detections again changes nothing; counted per rule."""
    det, alerts, links = store.detections(s, d), store.applied(s, d)[0], store.links(s, d)
    again, more = A.apply_detections(det, store.RULES, 0, alerts, links, store.evidence(s, d))
    n = again.groupBy("rule_id").agg(F.count("*").alias("alerts"), F.sum("event_count").alias("events"))
    return n.crossJoin(more.agg(F.count("*").alias("links")))


def _second_half(s, d):
    """Alerts after two runs: first the detections before 16 January, then all of them."""
    det = store.detections(s, d)
    early = det.filter(F.col("last_us") < 1705363200000000)
    a1, l1 = A.apply_detections(early, store.RULES, 0, evidence=store.evidence(s, d))
    a2, l2 = A.apply_detections(det, store.RULES, 1, a1, l1, store.evidence(s, d))
    return a2.select("dedup_key", "event_count", "detection_count", "status", F.size("history").alias("history"), "created_us")


QUERIES: dict[str, tuple] = {
    "enr_ip_scope": (
        lambda s, d: enrich.with_ip_scope(sample.events(s, d)).groupBy("source_ip_scope").agg(F.count("*").alias("n")),
        with_(EV, body="SELECT source_ip_scope, count(*) AS n FROM ev GROUP BY 1"),
    ),
    "enr_asset": (
        lambda s, d: enrich.with_asset(sample.events(s, d), sample.assets(s, d)).groupBy("host", "asset_id", "asset_criticality").agg(F.count("*").alias("n")),
        _sql("""SELECT ev.host, ha.asset_id, a.criticality AS asset_criticality, count(*) AS n FROM ev LEFT JOIN host_asset ha USING (host)
  LEFT JOIN assets a ON a.id = ha.asset_id GROUP BY ALL"""),
    ),
    "enr_identity": (
        lambda s, d: enrich.with_identity(sample.events(s, d), sample.identities(s, d)).groupBy("username", "identity_id", "identity_privileged").agg(F.count("*").alias("n")),
        with_(EV, IDENTITIES, body="""SELECT ev.username, i.id AS identity_id, i.privilege_level = 'privileged' AS identity_privileged, count(*) AS n
FROM ev LEFT JOIN identities i USING (username) GROUP BY ALL"""),
    ),
    "alr_dedup": (
        lambda s, d: A.with_keys(store.detections(s, d)).groupBy("dedup_key", "title").agg(F.count("*").alias("n")),
        _sql("""SELECT dedup_key, CASE rule_id WHEN 'AUTH-001' THEN 'Repeated SSH authentication failures (' || gs || ', ' || host || ', ' || username || ')'
  ELSE 'Suspicious privilege escalation indicator: ' || CASE indicator WHEN 'root_shell' THEN 'Interactive root shell through sudo'
  ELSE 'sudo attempted by a user without sudo rights' END || ' (' || host || ', ' || username || ')' END AS title, detection_count AS n FROM al"""),
    ),
    "alr_apply": (
        lambda s, d: store.alerts(s, d).select(
            "id", "dedup_key", "rule_id", "indicator", "event_count", F.col("peak_count").cast("bigint"), "detection_count", "first_us", "last_us", "evidence_truncated"
        ),
        _sql("SELECT id, dedup_key, rule_id, indicator, event_count, peak_count::BIGINT AS peak_count, detection_count, first_us, last_us, FALSE AS evidence_truncated FROM al"),
    ),
    "alr_apply_again": (
        _reapplied,
        _sql("SELECT rule_id, count(*) AS alerts, sum(event_count)::BIGINT AS events, (SELECT count(*) FROM al_e) AS links FROM al GROUP BY 1"),
    ),
    "alr_apply_increment": (
        _second_half,
        _sql("""SELECT dedup_key, event_count, detection_count, 'NEW' AS status, detection_count::INT AS history,
  CASE WHEN early > 0 THEN 0 ELSE 1 END::BIGINT AS created_us FROM al JOIN (
    SELECT rule_id, indicator, host, username, gs, count(*) FILTER (WHERE b < 1705363200000000) AS early FROM (
      SELECT rule_id, indicator, host, username, gs, det, max(us) AS b FROM al_e GROUP BY ALL) GROUP BY ALL) x
  ON x.rule_id = al.rule_id AND x.indicator IS NOT DISTINCT FROM al.indicator AND x.host = al.host AND x.username = al.username
    AND x.gs IS NOT DISTINCT FROM al.gs"""),
    ),
    "alr_links": (
        lambda s, d: store.links(s, d).groupBy("alert_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")),
        _sql("""SELECT al.id AS alert_id, count(*) AS n, min(e.id) AS first_event FROM al JOIN al_e e ON e.rule_id = al.rule_id
  AND e.indicator IS NOT DISTINCT FROM al.indicator AND e.host = al.host AND e.username = al.username AND e.gs IS NOT DISTINCT FROM al.gs GROUP BY 1"""),
    ),
    "alr_link_cap": (
        lambda s, d: A.link_evidence(
            sample.events(s, d).select(F.col("host").alias("dedup_key"), F.col("id").alias("event_id"), F.struct(F.unix_micros("timestamp").alias("us"), "id").alias("order")),
            sample.events(s, d).select(F.col("host").alias("dedup_key")).distinct().withColumns({"id": F.col("dedup_key"), "linked": F.lit(20).cast("bigint")}),
            cap=100,
        ).filter("kept").groupBy("id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")),
        with_(EV, body="""SELECT host AS id, count(*) AS n, max(id) AS last_event FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, id) AS r FROM ev) WHERE r <= 80 GROUP BY 1"""),
    ),
    "alr_history": (
        lambda s, d: store.alerts(s, d).select("id", F.size("history").alias("n"), F.element_at("history", -1)["last_us"].alias("last_us")),
        _sql("SELECT id, least(detection_count, 50)::INT AS n, last_us FROM al"),
    ),
    "alr_entities": (
        lambda s, d: store.alerts(s, d).select("id", *A.ENTITY_COLUMNS),
        _sql("SELECT id, host, username, target_username, source_ip, NULL::VARCHAR AS destination_ip FROM al"),
    ),
    "alr_context": (
        lambda s, d: store.alerts(s, d).select("id", "asset_id", "asset_name", "identity_id", "actor", "actor_privileged", "target", "simulated"),
        _sql("SELECT id, asset_id, asset_name, identity_id, actor, actor_privileged, NULL::VARCHAR AS target, simulated FROM al"),
    ),
    "alr_priority": (
        lambda s, d: store.alerts(s, d).select("id", "priority_score", "priority_band", F.array_join(F.transform("priority_breakdown", lambda f: F.concat(f["factor"], F.lit("+"), f["points"].cast("string"))), " ").alias("factors")),
        _sql("""SELECT id, priority_score, priority_band, concat_ws(' ', 'severity+25', 'confidence+' || CASE confidence WHEN 'medium' THEN 8 ELSE 0 END,
  'asset+' || CASE asset_level WHEN 'low' THEN 0 WHEN 'medium' THEN 5 WHEN 'high' THEN 10 WHEN 'critical' THEN 15 ELSE 5 END,
  CASE WHEN actor_privileged THEN 'identity+10' END, CASE WHEN rule_id = 'AUTH-001' AND peak_count >= 4 THEN 'evidence+5' END) AS factors FROM al"""),
    ),
    "alr_reprioritize": (
        lambda s, d: A.reprioritize(
            store.alerts(s, d), store.links(s, d), sample.events(s, d),
            sample.assets(s, d).withColumn("criticality", F.lit("critical")), sample.identities(s, d),
        ).select("id", "priority_score", "priority_band"),
        _sql(f"""SELECT id, n AS priority_score, CASE WHEN n >= 75 THEN 'critical' WHEN n >= 50 THEN 'high' WHEN n >= 25 THEN 'medium' ELSE 'low' END AS priority_band
FROM (SELECT *, (CASE WHEN {OPEN} AND asset_id IS NOT NULL THEN priority_score + 15 - CASE asset_level WHEN 'low' THEN 0 WHEN 'medium' THEN 5
  WHEN 'high' THEN 10 ELSE 15 END ELSE priority_score END)::INT AS n FROM al)"""),
    ),
    "alr_queue": (
        lambda s, d: A.alert_queue(store.alerts(s, d), limit=20, offset=10, status=["NEW", "TRIAGED"], severity=["medium"]).select("id", "priority_score", "last_us"),
        _sql("SELECT id, priority_score, last_us FROM al WHERE status IN ('NEW', 'TRIAGED') ORDER BY priority_score DESC, last_us DESC, id LIMIT 20 OFFSET 10"),
    ),
    "alr_group_rule": (
        lambda s, d: A.group_alerts(store.alerts(s, d), "rule", {r: v["name"] for r, v in RULES_BY_ID.items()}),
        _sql(f"""SELECT rule_id AS key, CASE rule_id WHEN 'AUTH-001' THEN 'Repeated SSH authentication failures' ELSE 'Suspicious privilege escalation indicator' END AS label,
  count(*) AS alerts, count(*) FILTER (WHERE {OPEN}) AS open, max(priority_score) AS top_priority, max(last_us) AS last_us,
  CASE WHEN max(priority_score) >= 75 THEN 'critical' WHEN max(priority_score) >= 50 THEN 'high' WHEN max(priority_score) >= 25 THEN 'medium' ELSE 'low' END AS top_band FROM al GROUP BY 1, 2"""),
    ),
    "alr_group_source": (
        lambda s, d: A.group_alerts(store.alerts(s, d), "source_ip").select("key", "alerts", "open", "top_priority", "last_us"),
        _sql(f"""SELECT source_ip AS key, count(*) AS alerts, count(*) FILTER (WHERE {OPEN}) AS open, max(priority_score) AS top_priority, max(last_us) AS last_us
FROM al WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY 4 DESC, 2 DESC, 1 LIMIT 100"""),
    ),
    "alr_evidence": (
        lambda s, d: A.alert_evidence(
            store.links(s, d), sample.events(s, d),
            sample.events(s, d).select(F.col("raw_event_id").alias("id"), F.col("message").alias("raw_data")), top_alert(s, d),
        ).select("id", "raw_data"),
        _sql(f"""SELECT e.id, e.message AS raw_data FROM al JOIN al_e e ON e.rule_id = al.rule_id AND e.indicator IS NOT DISTINCT FROM al.indicator
  AND e.host = al.host AND e.username = al.username AND e.gs IS NOT DISTINCT FROM al.gs WHERE al.id = {TOP}"""),
    ),
    "alr_related": (
        lambda s, d: A.related_alerts(store.alerts(s, d), early_alert(s, d)).select("id", F.array_join("shared", ", ").alias("shared")),
        _sql(f"""SELECT id, shared FROM (SELECT b.id, b.priority_score, b.last_us, concat_ws(', ', CASE WHEN b.host = a.host THEN 'host ' || a.host END,
    CASE WHEN b.source_ip = a.source_ip THEN 'source ' || a.source_ip END, CASE WHEN b.username = a.username THEN 'user ' || a.username END) AS shared
  FROM al a JOIN al b ON b.id <> a.id AND b.last_us >= a.first_us - 86400000000 AND b.first_us <= a.last_us + 86400000000 WHERE a.id = {EARLY})
WHERE shared <> '' ORDER BY priority_score DESC, last_us DESC, id LIMIT 20"""),
    ),
    "alr_transitions": (
        lambda s, d: _replayed(s, d).select("item_id", "change_id", "from_status", "to_status", "code", "accepted"),
        _sql("SELECT item_id, change_id, from_status, to_status, code, code IS NULL AS accepted FROM wk WHERE k > 0", REPLAY).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "alr_status_activity": (
        lambda s, d: A.status_activity(_audit(s, d), top_alert(s, d)).select("alert_id", "id", "actor", "to_status", "disposition", "reason"),
        _sql(f"SELECT item_id AS alert_id, change_id AS id, 'ana@example.org' AS actor, tgt AS to_status, disposition, reason FROM ch WHERE item_id = {TOP}", REPLAY).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "alr_techniques": (
        lambda s, d: store.alerts(s, d).select("rule_id", "indicator", F.explode("mitre").alias("m")).groupBy(
            "rule_id", "indicator", F.col("m.technique").alias("technique"), F.col("m.name").alias("name"), F.array_join("m.tactics", ",").alias("tactics")
        ).agg(F.count("*").alias("n")),
        _sql("""SELECT rule_id, indicator, CASE rule_id WHEN 'AUTH-001' THEN 'T1110.001' ELSE 'T1548.003' END AS technique,
  CASE rule_id WHEN 'AUTH-001' THEN 'Brute Force: Password Guessing' ELSE 'Abuse Elevation Control Mechanism: Sudo and Sudo Caching' END AS name,
  CASE rule_id WHEN 'AUTH-001' THEN 'Credential Access' ELSE 'Privilege Escalation' END AS tactics, count(*) AS n FROM al GROUP BY ALL"""),
    ),
    "hnt_alert_context": (
        lambda s, d: _hunted(s, d),
        _sql(f"""SELECT DISTINCT e.id, e.message FROM al JOIN al_e e ON e.rule_id = al.rule_id AND e.indicator IS NOT DISTINCT FROM al.indicator
  AND e.host = al.host AND e.username = al.username AND e.gs IS NOT DISTINCT FROM al.gs WHERE al.rule_id = 'AUTH-001' AND {OPEN}"""),
    ),
    "hnt_in_no_alert": (
        lambda s, d: _unhunted(s, d),
        _sql("SELECT category AS event_category, count(*) AS n FROM ev WHERE id NOT IN (SELECT id FROM al_e) GROUP BY 1"),
    ),
    "src_event_detail": (
        lambda s, d: _detail(s, d),
        _sql(f"""SELECT e.id, e.message AS raw_data, 'source ' || (e.n % 4) AS source_name, string_agg(al.id, ',' ORDER BY al.created_us, al.id) AS alerts
FROM ev e JOIN al_e x ON x.id = e.id JOIN al ON x.rule_id = al.rule_id AND x.indicator IS NOT DISTINCT FROM al.indicator AND x.host = al.host
  AND x.username = al.username AND x.gs IS NOT DISTINCT FROM al.gs WHERE e.id = (SELECT min(y.id) FROM al_e y) GROUP BY 1, 2, 3"""),
    ),
}


def _hunted(s, d):
    from emberwatch.operators.hunts import with_alert_context
    from emberwatch.schema import ACTIVE_ALERT

    found = with_alert_context(sample.events(s, d), store.links(s, d), store.alerts(s, d), rule_ids=["AUTH-001"], statuses=ACTIVE_ALERT)
    return found.select("id", "message")


def _unhunted(s, d):
    from emberwatch.operators.hunts import with_alert_context

    found = with_alert_context(sample.events(s, d), store.links(s, d), store.alerts(s, d), in_alert=False)
    return found.groupBy("event_category").agg(F.count("*").alias("n"))


def _detail(s, d):
    from emberwatch.sources.readers import event_detail

    ev = sample.events(s, d)
    raw = ev.select(F.col("raw_event_id").alias("id"), F.col("message").alias("raw_data"))
    names = ev.select(F.col("source_id").alias("id"), F.concat(F.lit("source "), "source_id").alias("name")).distinct()
    first = store.links(s, d).agg(F.min("event_id")).first()[0]
    one = event_detail(ev, raw, names, store.links(s, d), store.alerts(s, d), first)
    return one.select("id", "raw_data", "source_name", F.array_join("alert_ids", ",").alias("alerts"))
