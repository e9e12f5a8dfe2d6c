"""Queries over correlation and incidents, each with its DuckDB statement.

Views of an incident are checked on a plain membership (all alerts of a host form one incident) that
SQL can state; `cor_assemble` plays the real rules and is tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import correlate as C
from emberwatch.operators import incidents as I
from emberwatch.operators import workflow
from emberwatch.operators.priority import incident_risk
from emberwatch.plans.catalog_alerts import OPEN, _sql
from emberwatch.plans.oracle import HOUR
from emberwatch.sources import sample, store


def subjects(s, d):
    return store._once(s, d, "subjects", lambda: store.cut(
        C.alert_subjects(store.alerts(s, d), store.links(s, d), sample.events(s, d))))


def members(s, d):
    return store.alerts(s, d).select(F.concat(F.lit("i-"), "host").alias("incident_id"), F.col("id").alias("alert_id"))


def rolled(s, d):
    return store._once(s, d, "rolled", lambda: store.cut(
        I.rollup_incidents(members(s, d), store.alerts(s, d), subjects(s, d))
        .join(I.privileged_identity(members(s, d), store.alerts(s, d), store.links(s, d), sample.events(s, d), sample.identities(s, d)), "incident_id", "left")))


def incidents(s, d):
    """Incidents with a status that follows from their last event."""
    names = F.array(*[F.lit(x) for x in workflow.INCIDENT_TRANSITIONS])
    last = F.col("last_us")
    return incident_risk(rolled(s, d)).withColumns({
        "status": F.element_at(names, (last % 6 + 1).cast("int")),
        "assigned_to": F.when(last % 3 == 0, F.lit("ana")),
        "created_us": last + 90_000_000,
    })


def activity(s, d):
    return members(s, d).join(store.alerts(s, d).select(F.col("id").alias("alert_id"), "created_us", "title"), "alert_id").select(
        "incident_id", (F.col("created_us") % 1_000_000_000).alias("seq"), (F.col("created_us") + 5_000_000).alias("at"),
        F.concat(F.lit("linked "), "title").alias("text"), (F.col("created_us") % 3).cast("string").alias("author_id"),
    )


def users(s, d):
    return sample.warehouse(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lower("n_name"), F.lit("@example.org")).alias("email")).filter("id in ('1', '2')")


INC = """
sj AS (SELECT al.*, ['host ' || host] AS hs, CASE WHEN target_username IS NULL THEN [username] ELSE list_sort([username, target_username]) END AS users,
    (SELECT list_sort(list(DISTINCT e.source_ip)) FROM al_e e WHERE e.rule_id = al.rule_id AND e.indicator IS NOT DISTINCT FROM al.indicator
      AND e.host = al.host AND e.username = al.username AND e.gs IS NOT DISTINCT FROM al.gs) AS sources,
    CASE rule_id WHEN 'AUTH-001' THEN 'Credential Access' ELSE 'Privilege Escalation' END AS tactic,
    CASE rule_id WHEN 'AUTH-001' THEN 'T1110.001' ELSE 'T1548.003' END AS technique,
    succeeded AND rule_id = 'PRIV-001' AS access,
    concat_ws(':', rule_id, indicator) AS stage,
    CASE rule_id WHEN 'AUTH-001' THEN 'Repeated SSH authentication failures (' || gs || ', ' || host || ', ' || username || ')'
  ELSE 'Suspicious privilege escalation indicator: ' || CASE indicator WHEN 'root_shell' THEN 'Interactive root shell through sudo'
  ELSE 'sudo attempted by a user without sudo rights' END || ' (' || host || ', ' || username || ')' END AS title,
  CASE WHEN actor_privileged THEN actor END AS pid, 'i-' || host AS incident_id FROM al),
inc AS (SELECT incident_id, count(*) AS alert_count, min(first_us) AS first_us, max(last_us) AS last_us, bool_or(simulated) AS simulated,
    list_sort(list(DISTINCT host)) AS hosts, (SELECT list_sort(list(DISTINCT u)) FROM (SELECT unnest(x.users) AS u FROM sj x WHERE x.incident_id = sj.incident_id)) AS users,
    (SELECT list_sort(list(DISTINCT u)) FROM (SELECT unnest(x.sources) AS u FROM sj x WHERE x.incident_id = sj.incident_id)) AS sources,
    list_sort(list(DISTINCT tactic)) AS tactics, list_sort(list(DISTINCT technique)) AS techniques, list_sort(list(DISTINCT stage)) AS stages,
    max(priority_score) AS top_score, arg_max(title, (priority_score, last_us, id)) AS top_title,
    coalesce(arg_max(coalesce(actor_privileged, FALSE), (priority_score, last_us, id)), FALSE) AS top_priv, min(pid) AS privileged_identity FROM sj GROUP BY incident_id),
risk AS (SELECT *, least(100, top_score + CASE WHEN len(stages) > 1 THEN least(15, 5 * (len(stages) - 1)) ELSE 0 END
    + CASE WHEN privileged_identity IS NOT NULL AND NOT top_priv THEN 5 ELSE 0 END)::INT AS risk_score,
    ['OPEN', 'TRIAGED', 'INVESTIGATING', 'CONTAINED', 'RESOLVED', 'CLOSED'][last_us % 6 + 1] AS status,
    CASE WHEN last_us % 3 = 0 THEN 'ana' END AS assigned_to, last_us + 90000000 AS created_us FROM inc)"""
W = 2 * HOUR
PAIRS = f"""
pp AS (SELECT a.id, b.id AS other, a.host = b.host AS h, list_has_any(a.users, b.users) AS u,
    list_filter(list_sort(list_intersect(a.sources, b.sources)), lambda x: starts_with(x, '203')) AS x, len(list_intersect(a.sources, b.sources)) > 0 AS s,
    a.host = b.host AND b.access AS acc, a.technique <> b.technique AS nt, a.first_us >= b.first_us AS later,
    greatest(a.first_us - b.last_us, b.first_us - a.last_us, 0) AS gap, a.host AS at_host, a.technique AS finding, b.first_us AS since,
    list_concat(CASE WHEN a.host = b.host THEN ['host ' || a.host] ELSE []::VARCHAR[] END,
      list_transform(list_sort(list_intersect(a.users, b.users)), lambda v: 'user ' || v),
      list_transform(list_sort(list_intersect(a.sources, b.sources)), lambda v: 'source ' || v)) AS shared
  FROM sj a JOIN sj b ON a.id <> b.id AND a.first_us <= b.last_us + {W} AND a.last_us >= b.first_us - {W}),
cp AS (SELECT * FROM pp WHERE (h AND (u OR s)) OR len(x) > 0 OR acc)"""
TOLD = f"""
td AS (SELECT *, acc AND nt AND later AND gap <= {HOUR // 2} AS foothold,
    CASE len(shared) WHEN 1 THEN shared[1] ELSE array_to_string(shared[1:len(shared) - 1], ', ') || ' and ' || shared[len(shared)] END AS listed,
    CASE WHEN gap = 0 THEN 'during the same period' WHEN gap < 120000000 THEN (gap // 1000000) || ' s apart' ELSE (gap // 60000000) || ' min apart' END AS apart
  FROM cp)"""


def _isql(body: str, *more: str) -> str:
    return _sql(body, INC, *more)


def pairs(s, d, facts=False):
    return C.candidate_pairs(subjects(s, d), facts=facts)


def _pins(s, d):
    ev = sample.events(s, d).select(F.col("id").alias("event_id"), F.unix_micros("timestamp").alias("us"))
    log = store.links(s, d).join(ev, "event_id").join(members(s, d), "alert_id")
    twice = log.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "incident_id", "event_id", F.lit(None).cast("string").alias("alert_id"),
        F.when((F.col("us") + F.col("n")) % 3 == 0, F.lit("UNPIN")).otherwise(F.lit("PIN")).alias("action"),
        (F.col("us") + F.col("n")).alias("at"), F.concat("event_id", F.col("n").cast("string")).alias("id"),
    )
    return I.current_pins(twice).select("incident_id", "target")


def _changes(s, d):
    targets = F.array(*[F.lit(x) for x in workflow.INCIDENT_TRANSITIONS])
    ev = sample.events(s, d).select(F.col("id").alias("event_id"), F.unix_micros("timestamp").alias("us"))
    pick = (F.col("us") % 6 + 1).cast("int")
    to = F.element_at(targets, pick)
    resolving = to == "RESOLVED"
    return store.links(s, d).join(ev, "event_id").join(members(s, d), "alert_id").select(
        F.col("incident_id").alias("item_id"), F.col("event_id").alias("change_id"), F.col("us").alias("at"), to.alias("to_status"),
        F.when(resolving, F.lit("benign")).alias("disposition"), F.when(resolving, F.lit("checked")).alias("resolution"),
        F.when(F.expr("us div 6") % 2 == 0, F.lit("again")).alias("reason"),
    )


def _closed_view(s, d):
    return incidents(s, d).select("incident_id", "status", "hosts", "users", "sources", "first_us", "last_us")


def _assembled(s, d):
    found = C.assemble_incidents(subjects(s, d))
    return found.groupBy("incident_id").agg(
        F.count("*").alias("alerts"), F.array_join(F.array_sort(F.collect_set("strength")), ",").alias("strengths")
    )


def _full(s, d):
    links = store.cut(C.assemble_incidents(subjects(s, d)))
    built = I.build_incidents(links, store.alerts(s, d), subjects(s, d), store.links(s, d), sample.events(s, d), sample.identities(s, d))
    return built.select("incident_id", "alert_count", "risk_score", "risk_band", "title", "summary")


REPLAY = """
ch AS (SELECT i.incident_id AS item_id, e.id AS change_id, e.us AS moved,
    ['OPEN', 'TRIAGED', 'INVESTIGATING', 'CONTAINED', 'RESOLVED', 'CLOSED'][e.us % 6 + 1] AS tgt, (e.us // 6) % 2 = 0 AS why
  FROM (SELECT DISTINCT incident_id, host FROM sj) i JOIN al_e e ON e.host = i.host),
cn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY moved, change_id) AS k FROM ch),
wk AS (
  SELECT item_id, 0::BIGINT AS k, 'OPEN' AS st, NULL::VARCHAR AS change_id, NULL::VARCHAR AS from_status, NULL::VARCHAR AS to_status, NULL::VARCHAR AS code
  FROM (SELECT DISTINCT item_id FROM cn)
  UNION ALL
  SELECT item_id, k, CASE WHEN code IS NULL THEN tgt ELSE st END, change_id, st, tgt, code FROM (
    SELECT c.*, w.st, CASE WHEN w.st = 'CLOSED' THEN 'final' WHEN c.tgt = w.st THEN 'already'
      WHEN NOT list_contains(CASE w.st WHEN 'OPEN' THEN ['TRIAGED', 'RESOLVED'] WHEN 'TRIAGED' THEN ['INVESTIGATING', 'RESOLVED']
        WHEN 'INVESTIGATING' THEN ['CONTAINED', 'RESOLVED'] WHEN 'CONTAINED' THEN ['INVESTIGATING', 'RESOLVED'] ELSE ['CLOSED', 'INVESTIGATING'] END, c.tgt) THEN 'not_allowed'
      WHEN w.st = 'RESOLVED' AND c.tgt = 'INVESTIGATING' AND NOT c.why THEN 'reason_required' END AS code
    FROM wk w JOIN cn c ON c.item_id = w.item_id AND c.k = w.k + 1))"""
J = lambda c: F.array_join(c, ",").alias(c)
STR = "array_to_string({0}, ',') AS {0}"

QUERIES: dict[str, tuple] = {
    "cor_subjects": (
        lambda s, d: subjects(s, d).select("id", J("hosts"), J("users"), J("sources"), J("tactics"), J("techniques"), "access", "first_us", "last_us"),
        _isql(f"SELECT id, host AS hosts, {STR.format('users')}, {STR.format('sources')}, tactic AS tactics, technique AS techniques, access, first_us, last_us FROM sj"),
    ),
    "cor_pairs": (pairs, _isql("SELECT id, other FROM cp", PAIRS)),
    "cor_links": (
        lambda s, d: C.score_links(pairs(s, d, facts=True), subjects(s, d)).select("id", "other", "strength", F.array_join("shared", ";").alias("shared"), "reason"),
        _isql("""SELECT id, other, CASE WHEN h AND (u OR s) THEN 'STRONG' WHEN len(x) > 0 OR foothold THEN 'MEDIUM' ELSE 'WEAK' END AS strength,
  array_to_string(shared, ';') AS shared,
  CASE WHEN h AND u THEN 'Same host and user (' || listed || '), ' || apart || '.'
    WHEN h AND s THEN 'Same host and source (' || listed || '), ' || apart || '.'
    WHEN len(x) > 0 THEN 'Same outside source ' || array_to_string(x, ', ') || ' (one campaign across hosts), ' || apart || '.'
    WHEN foothold THEN 'On ' || at_host || ', after the access the incident shows there (since ' || strftime(make_timestamp(since), '%Y-%m-%d %H:%M:%S')
      || ' UTC): a new kind of finding (' || finding || '), ' || apart || '.'
    ELSE 'Only ' || listed || ' in common, ' || apart || ': not linked.' END AS reason FROM td""", PAIRS, TOLD),
    ),
    "cor_assemble": (_assembled, None),
    "cor_incidents": (_full, None),
    "cor_related_closed": (
        lambda s, d: C.related_closed(subjects(s, d), _closed_view(s, d)),
        _isql("""SELECT sj.id, arg_max(r.incident_id, (r.last_us, r.incident_id)) AS related_id FROM sj JOIN risk r
  ON r.status IN ('RESOLVED', 'CLOSED') AND r.last_us >= sj.first_us - 2592000000000 AND r.first_us <= sj.last_us + 2592000000000
  AND ((list_contains(r.hosts, sj.host) AND (list_has_any(r.users, sj.users) OR list_has_any(r.sources, sj.sources)))
    OR len(list_filter(list_intersect(r.sources, sj.sources), lambda x: starts_with(x, '203'))) > 0) GROUP BY 1"""),
    ),
    "cor_rollup": (
        lambda s, d: rolled(s, d).select("incident_id", "alert_count", "first_us", "last_us", "severity", "simulated", J("hosts"), J("users"), J("sources"), J("tactics"), J("techniques"), J("stages")),
        _isql(f"SELECT incident_id, alert_count, first_us, last_us, 'medium' AS severity, simulated, {', '.join(STR.format(c) for c in ('hosts', 'users', 'sources', 'tactics', 'techniques', 'stages'))} FROM inc"),
    ),
    "cor_risk": (
        lambda s, d: incidents(s, d).select("incident_id", "risk_score", "risk_band"),
        _isql("SELECT incident_id, risk_score, CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_band FROM risk"),
    ),
    "cor_privileged": (
        lambda s, d: rolled(s, d).select("incident_id", "privileged_identity"),
        _isql("SELECT incident_id, privileged_identity FROM inc"),
    ),
    "cor_text": (
        lambda s, d: I.incident_text(incidents(s, d), members(s, d), store.alerts(s, d)).select("incident_id", "title", "summary"),
        _isql("""SELECT incident_id, CASE WHEN alert_count = 1 THEN t ELSE (CASE WHEN len(stages) > 1 THEN 'Multi-stage activity' ELSE split_part(t, ' (', 1) END
  || ' on ' || hosts[1] || ' (' || who || ' from ' || origin || ')')[1:300] END AS title,
  alert_count || ' alert(s) from ' || nr || ' rule(s) (' || rules || '); ATT&CK tactics: ' || array_to_string(tactics, ', ') || '. Hosts: ' || array_to_string(hosts, ', ') ||
  '. Accounts: ' || array_to_string(users, ', ') || '. Sources: ' || array_to_string(sources, ', ') || '. Activity from ' || strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S')
  || ' to ' || strftime(make_timestamp(last_us), '%Y-%m-%d %H:%M:%S') || ' UTC.' AS summary
FROM inc JOIN (SELECT incident_id, arg_min(title, (first_us, last_us, rule_id, id)) AS t, count(DISTINCT rule_id) AS nr, string_agg(DISTINCT rule_id, ', ' ORDER BY rule_id) AS rules FROM sj GROUP BY 1) USING (incident_id)
JOIN (SELECT incident_id, arg_max(username, r) AS who FROM (SELECT incident_id, username, row_number() OVER (PARTITION BY incident_id ORDER BY count(*), username DESC) AS r FROM sj GROUP BY 1, 2) GROUP BY 1) USING (incident_id)
JOIN (SELECT incident_id, arg_max(source_ip, r) AS origin FROM (SELECT incident_id, source_ip, row_number() OVER (PARTITION BY incident_id ORDER BY count(*), source_ip DESC) AS r FROM sj GROUP BY 1, 2) GROUP BY 1) USING (incident_id)"""),
    ),
    "cor_techniques": (
        lambda s, d: I.incident_techniques(members(s, d), store.alerts(s, d)).select("incident_id", "technique", "name", J("tactics"), J("rules")),
        _isql("""SELECT incident_id, technique, CASE technique WHEN 'T1110.001' THEN 'Brute Force: Password Guessing' ELSE 'Abuse Elevation Control Mechanism: Sudo and Sudo Caching' END AS name,
  min(tactic) AS tactics, string_agg(DISTINCT rule_id, ',') AS rules FROM sj GROUP BY 1, 2"""),
    ),
    "cor_response": (
        lambda s, d: I.response_steps(members(s, d), store.alerts(s, d)).select("incident_id", "alert_id", "rule_id", F.array_join("steps", "|").alias("steps")),
        _isql("""SELECT incident_id, alert_id, rule_id, string_agg(step, '|' ORDER BY pos) AS steps FROM (
  SELECT incident_id, step, arg_min(id, (first_us, last_us, rule_id, id, pos)) AS alert_id, arg_min(rule_id, (first_us, last_us, rule_id, id, pos)) AS rule_id, arg_min(pos, (first_us, last_us, rule_id, id, pos)) AS pos FROM (
    SELECT *, unnest([0, 1]) AS pos, unnest(CASE rule_id WHEN 'AUTH-001' THEN ['Block ' || gs || ' if it is not expected.', 'Use key-based logons for "' || username || '".']
      ELSE ['Contain ' || host || ' if this was not authorized.', 'Review the sudoers file of ' || host || '.'] END) AS step FROM sj) GROUP BY 1, 2) GROUP BY 1, 2, 3"""),
    ),
    "cor_timeline": (
        lambda s, d: I.incident_timeline("i-srv-4", members(s, d), store.links(s, d), sample.events(s, d), store.alerts(s, d), activity(s, d), after=(1704585600000000, "1event", ""), limit=30)
        .select("at", "kind", "ref", "text", J("rules")),
        _isql("""SELECT m.moved AS "at", m.kind, m.ref, m.text, r.rules FROM (
  SELECT e.us AS moved, '1event' AS kind, e.id AS ref, e.category || ' ' || e.action || ' ' || e.outcome || ' ' || e.host || ' ' || e.username AS text FROM ev e WHERE e.id IN (SELECT id FROM al_e WHERE host = 'srv-4')
  UNION ALL SELECT created_us, '2alert', id, title FROM sj WHERE incident_id = 'i-srv-4'
  UNION ALL SELECT created_us + 5000000, '3activity', lpad((created_us % 1000000000)::VARCHAR, 20, '0'), 'linked ' || title FROM sj WHERE incident_id = 'i-srv-4') m
LEFT JOIN (SELECT id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM al_e GROUP BY 1) r ON r.id = m.ref AND m.kind = '1event'
WHERE (m.moved, m.kind, m.ref) > (1704585600000000, '1event', '') ORDER BY m.moved, m.kind, m.ref LIMIT 30"""),
    ),
    "cor_queue": (
        lambda s, d: I.incident_queue(incidents(s, d), status=["OPEN", "TRIAGED", "INVESTIGATING", "RESOLVED"], unassigned=True, limit=8).select("incident_id", "risk_score"),
        _isql("SELECT incident_id, risk_score FROM risk WHERE status IN ('OPEN', 'TRIAGED', 'INVESTIGATING', 'RESOLVED') AND assigned_to IS NULL ORDER BY risk_score DESC, last_us DESC, incident_id LIMIT 8"),
    ),
    "cor_pins": (
        _pins,
        _isql("""SELECT 'i-' || host AS incident_id, 'event ' || id AS target FROM al_e WHERE (us + 1) % 3 <> 0"""),
    ),
    "cor_transitions": (
        lambda s, d: workflow.fold_incident_transitions(
            members(s, d).select(F.col("incident_id").alias("item_id"), F.lit("OPEN").alias("status")).distinct(), _changes(s, d)
        ).select("item_id", "change_id", "from_status", "to_status", "code"),
        _isql("SELECT item_id, change_id, from_status, to_status, code FROM wk WHERE k > 0", REPLAY).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "cor_standalone": (
        lambda s, d: C.standalone_alerts(store.alerts(s, d), members(s, d).filter(F.col("incident_id") < "i-srv-3"), 1704672000000000, 1705752000000000).select("id"),
        _isql(f"SELECT id FROM sj WHERE {OPEN} AND first_us <= 1705752000000000 AND last_us >= 1704672000000000 AND NOT incident_id < 'i-srv-3'"),
    ),
    "cor_members": (
        lambda s, d: I.incident_members(members(s, d), store.alerts(s, d)).select("incident_id", "id", "rule_id", "title"),
        _isql("SELECT incident_id, id, rule_id, title FROM sj"),
    ),
    "cor_alert_incident": (
        lambda s, d: I.alert_incident(members(s, d), incidents(s, d), store.alerts(s, d).agg(F.min("id")).first()[0]).select("incident_id", "status"),
        _isql("SELECT incident_id, status FROM risk WHERE incident_id = (SELECT arg_min(incident_id, id) FROM sj)"),
    ),
    "cor_log": (
        lambda s, d: I.incident_log(activity(s, d).filter("seq % 2 = 0"), activity(s, d).filter("seq % 2 = 1"), users(s, d)).select("incident_id", "kind", "author", "text"),
        _isql("""SELECT incident_id, CASE WHEN created_us % 2 = 0 THEN 'note' ELSE 'activity' END AS kind,
  CASE WHEN created_us % 3 > 0 THEN (SELECT lower(n_name) || '@example.org' FROM nation WHERE n_nationkey = created_us % 3) END AS author, 'linked ' || title AS text FROM sj"""),
    ),
}
