"""Queries over reports and the ledger, each with its DuckDB statement."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from emberwatch.operators import ledger as L
from emberwatch.operators import reports as R
from emberwatch.plans.catalog_alerts import OPEN, _sql
from emberwatch.plans.catalog_detect import GOOD
from emberwatch.plans.catalog_incidents import _isql, incidents, members
from emberwatch.plans.oracle import ASSETS, EV, IDENTITIES, with_
from emberwatch.plans.rules import RULES, TACTICS, TECHNIQUES, mappings
from emberwatch.sources import sample, store

NOW = datetime(2024, 1, 25, 15, 30, tzinfo=UTC)
NOW_US, TODAY_US, WEEK_US = 1706196600000000, 1706140800000000, 1706196600000000 - 7 * 86400000000
START_US, END_US = 1704672000000000, 1705752000000000


def raw(s, d):
    return sample.events(s, d).select("id", "simulated", (F.col("timestamp") + F.expr("interval 5 hours")).alias("received_at"))


def counts(s, d):
    return R.daily_counts(sample.events(s, d), raw(s, d))


def rules(s):
    return s.createDataFrame([(r["id"], r["name"], r["id"] != "PROC-001") for r in RULES], "rule_id string, name string, enabled boolean")


def covered(s, d):
    maps = s.createDataFrame(mappings(RULES), "rule_id string, indicator string, technique string, reason string")
    known = s.createDataFrame(TECHNIQUES, "technique string, technique_name string, tactics array<string>")
    return R.coverage(maps, rules(s), known, store.alerts(s, d), START_US, END_US)


def ledger(s, d):
    """Orders as audit entries, chained in SQL-expressible form: each entry's stored previous hash is
    the digest of the entry before it alone, one entry is edited and one is missing."""
    c = F.col
    rows = sample.warehouse(s, d, "orders").select(
        c("o_orderkey").alias("seq"), c("o_orderkey").cast("string").alias("id"), c("o_orderdate").cast("timestamp").alias("occurred_at"),
        F.when(c("o_orderkey") % 3 == 0, F.lit("LOGIN")).otherwise(F.lit("RULE_UPDATED")).alias("action"), c("o_orderstatus").alias("result"),
        c("o_custkey").cast("string").alias("actor_id"), F.concat(F.lit("token="), c("o_orderpriority"), F.lit(" ok")).alias("note"),
    )
    for name in ("actor_label", "entity_type", "entity_id", "client_ip", "request_id", "details"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows


def _digest(seq):
    """A stand-in chain value: computable per row, so the sample can be built without a fold."""
    return F.sha2(seq.cast("string"), 256)


def chained(s, d):
    rows = ledger(s, d)

    before = F.lag("seq").over(R.Window.partitionBy(F.expr("seq div 1000")).orderBy("seq"))

    linked = rows.withColumn("_before", before)
    return linked.withColumns(
        {
            "entry_hash": F.when(F.col("seq") >= 100, _digest(F.col("seq"))),
            "prev_hash": F.when(F.col("seq") == 777, F.lit("edited")).otherwise(
                F.coalesce(F.when(F.col("_before") >= 100, _digest(F.col("_before"))), F.lit(L.GENESIS))
            ),
        }
    )


def sealed(s, d):
    """Orders as audit entries in volumes of 64 sequence numbers, each a ledger that is hashed entry by entry; then some
    entries are edited and some removed. Entries before 100 are older than the chain."""
    rows = ledger(s, d).withColumn("volume", F.expr("seq div 64"))
    fields = [c for c in rows.columns if c != "volume"]
    entry = F.struct("seq", *[c for c in fields if c != "seq"])
    lines = rows.filter("seq >= 100").groupBy("volume").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    last = lambda hashes: F.element_at(hashes, -1)
    add = lambda hashes, e: F.concat(hashes, F.array(L.entry_hash(last(hashes), lambda c: e[c])))
    lines = lines.withColumn("hashes", F.aggregate("entries", F.array(F.lit(L.GENESIS)), add))
    one = F.posexplode("entries").alias("at", "e")
    made = lines.select("volume", "hashes", one).select(
        "volume", "e.*", F.expr("hashes[at]").alias("prev_hash"), F.expr("hashes[at + 1]").alias("entry_hash")
    )
    made = made.filter("seq % 89 <> 7").withColumn("result", F.when(F.col("seq") % 97 == 5, F.lit("X")).otherwise(F.col("result")))
    old = rows.filter("seq < 100").withColumns({"prev_hash": F.lit(None).cast("string"), "entry_hash": F.lit(None).cast("string")})
    return made.unionByName(old)


def _links(s, d):
    """Entries whose link to the entry before is wrong, over blocks of sequence numbers."""
    log = chained(s, d)
    return L.check_entries(log, block=1000).filter("not link_ok").select("seq", "prev_hash", "expected_prev")


def _anchors(s, d):
    log = chained(s, d).filter("seq % 1000 != 5")
    anchors = sample.warehouse(s, d, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 1000 == 7, F.lit("other")).otherwise(_digest(F.col("o_orderkey"))).alias("hash"),
    )
    return L.check_anchors(log, anchors)


def _list(kind):
    def query(s, d):
        inv = sample.assets(s, d) if kind == "asset" else sample.identities(s, d)
        return R.list_activity(inv, store.alerts(s, d), sample.events(s, d), kind)

    return query


def _context(s, d):
    ev = sample.events(s, d)
    names = lambda c: ev.select(F.col(c).alias("name")).filter("name is not null").distinct()
    return R.inventory_context(names("host"), names("username"), names("target_username"), sample.assets(s, d), sample.identities(s, d))


ITEM_ALERTS = """
ia AS (SELECT DISTINCT a.id AS item_id, al.id AS alert_id, al.status, al.last_us FROM assets a JOIN al
  ON al.asset_id = a.id OR al.host = a.hostname OR split_part(al.host, '.', 1) = split_part(a.hostname, '.', 1)),
ii AS (SELECT DISTINCT i.id AS item_id, al.id AS alert_id, al.status, al.last_us FROM identities i JOIN al
  ON al.identity_id = i.id OR al.username = i.username OR al.target_username = i.username)"""

TECH = ", ".join(f"('{t}', '{n}', {tac!r})" for t, n, tac in TECHNIQUES)
MAPS = ", ".join(f"('{r}', '{i}', '{t}')" for r, i, t, _ in mappings(RULES))
NAMES = ", ".join(f"('{r['id']}', {str(r['id'] != 'PROC-001').upper()})" for r in RULES)
COVER = f"""
cov AS (SELECT m.technique, t.tactics, m.rule_id, m.indicator, r.enabled,
    (SELECT count(*) FROM al WHERE al.rule_id = m.rule_id AND (m.indicator = '' OR al.indicator = m.indicator) AND created_us BETWEEN {START_US} AND {END_US}) AS alerts,
    (SELECT max(created_us) FROM al WHERE al.rule_id = m.rule_id AND (m.indicator = '' OR al.indicator = m.indicator)) AS last_us
  FROM (VALUES {MAPS}) m(rule_id, indicator, technique) JOIN (VALUES {TECH}) t(technique, name, tactics) USING (technique)
  JOIN (VALUES {NAMES}) r(rule_id, enabled) USING (rule_id))"""

QUERIES: dict[str, tuple] = {
    "rpt_daily_counts": (
        lambda s, d: counts(s, d).select("kind", F.col("day").cast("string").alias("day"), "records"),
        with_(EV, body="""SELECT 'event' AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS records FROM ev GROUP BY 2
UNION ALL SELECT 'raw', strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d'), count(*) FROM ev GROUP BY 2"""),
    ),
    "rpt_logon_success_daily": (
        lambda s, d: R.merge_logons(
            R.logon_success_daily(sample.events(s, d).filter("source_id = '0'")), R.logon_success_daily(sample.events(s, d).filter("source_id != '0'"))
        ).withColumn("day", F.col("day").cast("string")),
        with_(EV, body=f"SELECT username, source_ip, strftime(ts, '%Y-%m-%d') AS day, count(*) AS logons, max(us) AS last_us FROM ev WHERE {GOOD} GROUP BY ALL"),
    ),
    "rpt_dashboard": (
        lambda s, d: R.dashboard_summary(counts(s, d), store.alerts(s, d), incidents(s, d), sample.events(s, d), sample.assets(s, d), rules(s), NOW),
        _isql(f"""SELECT 'counter' AS section, unnest(['records_processed', 'events_stored', 'events_today', 'alerts_today', 'open_alerts', 'open_alerts_simulated', 'critical_alerts', 'high_alerts',
    'open_incidents', 'incidents_under_investigation', 'inventory_assets', 'active_rules', 'library_rules', 'monitored_hosts']) AS name,
  unnest([(SELECT count(*) FROM ev), (SELECT count(*) FROM ev), (SELECT count(*) FROM ev WHERE us >= {TODAY_US}), (SELECT count(*) FROM al WHERE created_us >= {TODAY_US}),
    (SELECT count(*) FROM al WHERE {OPEN}), (SELECT count(*) FROM al WHERE {OPEN} AND simulated), 0, 0,
    (SELECT count(*) FROM risk WHERE status IN ('OPEN', 'TRIAGED', 'INVESTIGATING', 'CONTAINED')), (SELECT count(*) FROM risk WHERE status IN ('INVESTIGATING', 'CONTAINED')),
    (SELECT count(*) FROM assets WHERE status = 'ACTIVE'), 8, 9, (SELECT count(DISTINCT host) FROM ev WHERE us >= {NOW_US} - 86400000000)]) AS value
UNION ALL SELECT 'severity', s, CASE WHEN s = 'medium' THEN (SELECT count(*) FROM al WHERE {OPEN}) ELSE 0 END FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS s)
UNION ALL (SELECT 'top_rule', rule_id, count(*) FROM al WHERE created_us >= {WEEK_US} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'top_source', source_ip, count(*) FROM al WHERE created_us >= {WEEK_US} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)"""),
    ),
    "rpt_monitored_hosts": (
        lambda s, d: R.monitored_hosts(sample.events(s, d), NOW),
        with_(EV, body=f"SELECT count(DISTINCT host) AS hosts FROM ev WHERE us >= {NOW_US} - 86400000000"),
    ),
    "rpt_trends": (
        lambda s, d: R.trends(counts(s, d), store.alerts(s, d), incidents(s, d), sample.events(s, d), 14, NOW).withColumn("day", F.col("day").cast("string")),
        _isql(f"""SELECT strftime(d, '%Y-%m-%d') AS day, 0::BIGINT AS critical, 0::BIGINT AS high, 0::BIGINT AS low,
  (SELECT count(*) FROM al WHERE make_timestamp(created_us)::DATE = d) AS medium, (SELECT count(*) FROM risk WHERE make_timestamp(created_us)::DATE = d) AS incidents,
  (SELECT count(*) FROM ev WHERE ts::DATE = d AND us <= {NOW_US}) AS events
FROM (SELECT (DATE '2024-01-12' + i::INT)::DATE AS d FROM range(14) r(i))"""),
    ),
    "rpt_recent_alerts": (
        lambda s, d: R.recent_alerts(store.alerts(s, d)).select("id", "created_us"),
        _sql("SELECT id, created_us FROM al ORDER BY created_us DESC, id LIMIT 8"),
    ),
    "rpt_recent_incidents": (
        lambda s, d: R.recent_incidents(incidents(s, d)).select("incident_id", "created_us"),
        _isql("SELECT incident_id, created_us FROM risk ORDER BY created_us DESC, incident_id LIMIT 5"),
    ),
    "rpt_rule_metrics": (
        lambda s, d: R.rule_metrics(rules(s), store.alerts(s, d), START_US, END_US),
        _sql(f"""SELECT r.rule_id, count(al.id) AS alerts, count(al.id) FILTER (WHERE {OPEN}) AS open, count(al.id) FILTER (WHERE status = 'RESOLVED' AND disposition = 'confirmed_malicious') AS confirmed,
  count(al.id) FILTER (WHERE status = 'RESOLVED' AND disposition = 'benign_expected') AS benign, count(al.id) FILTER (WHERE status = 'FALSE_POSITIVE') AS false_positives,
  quantile_cont((triaged_us - created_us) / 1e6, 0.5) AS median_triage_seconds, quantile_cont(CASE WHEN NOT {OPEN} THEN (resolved_us - created_us) / 1e6 END, 0.5) AS median_resolve_seconds,
  round_even(count(al.id) FILTER (WHERE status = 'FALSE_POSITIVE') / nullif(count(al.id) FILTER (WHERE NOT {OPEN}), 0), 3) AS false_positive_rate
FROM (VALUES {NAMES}) r(rule_id, enabled) LEFT JOIN al ON al.rule_id = r.rule_id AND created_us BETWEEN {START_US} AND {END_US} GROUP BY 1"""),
    ),
    "rpt_coverage": (
        lambda s, d: covered(s, d).select("technique", "rule_id", "indicator", "enabled", "alerts", "last_us"),
        _sql("SELECT technique, rule_id, indicator, enabled, alerts, last_us FROM cov", COVER),
    ),
    "rpt_tactic_coverage": (
        lambda s, d: R.tactic_coverage(covered(s, d), TACTICS),
        _sql(f"""SELECT t.position::INT AS position, t.tactic, count(DISTINCT c.technique) AS techniques, coalesce(bool_or(c.enabled), FALSE) AS active, coalesce(sum(c.alerts), 0)::BIGINT AS alerts,
  count(c.technique) > 0 AS covered FROM (SELECT unnest({TACTICS!r}) AS tactic, unnest(range(1, 16)) AS position) t LEFT JOIN cov c ON list_contains(c.tactics, t.tactic) GROUP BY 1, 2""", COVER),
    ),
    "rpt_asset_activity": (
        lambda s, d: R.asset_activity(sample.assets(s, d), store.alerts(s, d), incidents(s, d), members(s, d), sample.events(s, d)).select(
            "item_id", "total_alerts", "open_alerts", "total_incidents", "open_incidents", "last_seen_us", F.array_join("recent_alerts", ",").alias("recent")),
        _isql(f"""SELECT a.id AS item_id, (SELECT count(*) FROM ia WHERE item_id = a.id) AS total_alerts, (SELECT count(*) FROM ia WHERE item_id = a.id AND {OPEN}) AS open_alerts,
  (SELECT count(*) FROM ic WHERE item_id = a.id) AS total_incidents, (SELECT count(*) FROM ic WHERE item_id = a.id AND status IN ('OPEN', 'TRIAGED', 'INVESTIGATING', 'CONTAINED')) AS open_incidents,
  (SELECT max(us) FROM ev WHERE ev.host = a.hostname) AS last_seen_us,
  (SELECT string_agg(alert_id, ',' ORDER BY last_us DESC, alert_id) FROM (SELECT * FROM ia WHERE item_id = a.id ORDER BY last_us DESC, alert_id LIMIT 10)) AS recent FROM assets a""",
              ITEM_ALERTS, "ic AS (SELECT DISTINCT x.item_id, r.incident_id, r.status FROM (SELECT item_id, sj.incident_id FROM ia JOIN sj ON sj.id = ia.alert_id UNION SELECT a.id, r.incident_id FROM assets a JOIN risk r ON list_contains(r.hosts, a.hostname)) x JOIN risk r USING (incident_id))"),
    ),
    "rpt_identity_activity": (
        lambda s, d: R.identity_activity(sample.identities(s, d), store.alerts(s, d), incidents(s, d), members(s, d), sample.events(s, d)).select(
            "item_id", "total_alerts", "open_alerts", "total_incidents", "last_seen_us"),
        _isql(f"""SELECT i.id AS item_id, coalesce(t, 0) AS total_alerts, coalesce(o, 0) AS open_alerts, coalesce(n, 0) AS total_incidents, l.us AS last_seen_us FROM identities i
  LEFT JOIN (SELECT item_id, count(*) AS t, count(*) FILTER (WHERE {OPEN}) AS o FROM ii GROUP BY 1) x ON x.item_id = i.id LEFT JOIN (SELECT item_id, count(*) AS n FROM ic GROUP BY 1) y ON y.item_id = i.id
  LEFT JOIN (SELECT username, max(us) AS us FROM ev GROUP BY 1) l ON l.username = i.username""",
              ITEM_ALERTS, "ic AS (SELECT DISTINCT item_id, incident_id FROM (SELECT item_id, sj.incident_id FROM ii JOIN sj ON sj.id = ii.alert_id UNION SELECT i.id, r.incident_id FROM identities i JOIN risk r ON list_contains(r.users, i.username)))"),
    ),
    "rpt_list_assets": (
        _list("asset"),
        _sql(f"SELECT a.id AS item_id, (SELECT count(*) FROM ia WHERE item_id = a.id AND {OPEN}) AS open_alerts, (SELECT max(us) FROM ev WHERE ev.host = a.hostname) AS last_seen_us FROM assets a", ITEM_ALERTS),
    ),
    "rpt_list_identities": (
        _list("identity"),
        _sql(f"""SELECT i.id AS item_id, coalesce(o, 0) AS open_alerts, l.us AS last_seen_us FROM identities i LEFT JOIN (SELECT item_id, count(*) FILTER (WHERE {OPEN}) AS o FROM ii GROUP BY 1) x ON x.item_id = i.id
  LEFT JOIN (SELECT username, max(us) AS us FROM ev GROUP BY 1) l ON l.username = i.username""", ITEM_ALERTS),
    ),
    "rpt_inventory_context": (
        _context,
        _sql("""SELECT 'host' AS kind, h.host AS name, coalesce(n.id, l.id) AS item_id, '' AS roles FROM (SELECT DISTINCT host FROM ev) h LEFT JOIN names n ON n.name = h.host LEFT JOIN labels l ON l.name = split_part(h.host, '.', 1)
UNION ALL SELECT 'account', r.name, i.id, r.roles FROM (SELECT name, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (
  SELECT username AS name, 'actor' AS role FROM ev UNION SELECT target_username, 'target' FROM ev WHERE target_username IS NOT NULL) GROUP BY 1) r LEFT JOIN identities i ON i.username = r.name"""),
    ),
    "rpt_search_assets": (
        lambda s, d: R.search_inventory(sample.assets(s, d), ["hostname", "owner", "description"], "Nation 1", tag="TAG1", environment="production").select("id", "hostname"),
        with_(ASSETS, body="SELECT id, hostname FROM assets WHERE (contains(lower(hostname), 'nation 1') OR contains(lower(owner), 'nation 1') OR contains(lower(description), 'nation 1')) AND tag = 'tag1' AND environment = 'production'"),
    ),
    "rpt_search_identities": (
        lambda s, d: R.search_inventory(sample.identities(s, d), ["username", "display_name", "department"], "MACH", privilege_level="privileged", status="ACTIVE").select("id", "username"),
        with_(IDENTITIES, body="SELECT id, username FROM identities WHERE contains(lower(department), 'mach') AND privilege_level = 'privileged' AND status = 'ACTIVE'"),
    ),
    "rpt_batch_list": (
        lambda s, d: R.batch_list(sample.events(s, d).groupBy("source_id", "batch_id").agg(F.count("*").alias("received"), F.max(F.unix_micros("timestamp")).alias("created_us")), "2", 10),
        with_(EV, body="SELECT (n % 4)::VARCHAR AS source_id, batch_id, count(*) AS received, max(us) AS created_us FROM ev WHERE n % 4 = 2 GROUP BY 1, 2 ORDER BY created_us DESC LIMIT 10"),
    ),
    "rpt_simulated_split": (
        lambda s, d: R.simulated_split(raw(s, d)),
        with_(EV, body="SELECT simulated, count(*) AS records FROM ev GROUP BY 1"),
    ),
    "aud_chain_links": (
        _links,
        """WITH e AS (SELECT o_orderkey AS seq, lag(o_orderkey) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS b, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS g FROM orders),
x AS (SELECT seq, CASE WHEN seq = 777 THEN 'edited' WHEN b >= 100 THEN sha256(b::VARCHAR) ELSE repeat('0', 64) END AS prev_hash, CASE WHEN g >= 100 THEN sha256(g::VARCHAR) ELSE repeat('0', 64) END AS expected_prev FROM e WHERE seq >= 100)
SELECT * FROM x WHERE prev_hash <> expected_prev""",
    ),
    "aud_chains": (
        lambda s, d: L.verify_chains(sealed(s, d), ["volume"], block=16, group=2),
        """WITH RECURSIVE o AS (SELECT o_orderkey AS seq, o_orderkey // 64 AS volume, row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS k,
  '","' || o_orderkey || '","' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","' || CASE WHEN o_orderkey % 3 = 0 THEN 'LOGIN' ELSE 'RULE_UPDATED' END
  || '","' || o_orderstatus || '","' || o_custkey || '",null,null,null,null,null,null]' AS fields FROM orders WHERE o_orderkey >= 100),
c AS (SELECT seq, volume, k, repeat('0', 64) AS prev, sha256('["' || repeat('0', 64) || fields) AS h FROM o WHERE k = 1
  UNION ALL SELECT o.seq, o.volume, o.k, c.h, sha256('["' || c.h || o.fields) FROM c JOIN o ON o.volume = c.volume AND o.k = c.k + 1),
x AS (SELECT *, seq % 97 = 5 OR prev <> coalesce(lag(h) OVER (PARTITION BY volume ORDER BY seq), repeat('0', 64)) AS broken FROM c WHERE seq % 89 <> 7),
y AS (SELECT volume, count(*) AS chained, min(seq) FILTER (WHERE broken) AS first_broken, max(seq) AS head_seq, max_by(h, seq) AS head_hash FROM x GROUP BY volume),
z AS (SELECT DISTINCT volume FROM y UNION SELECT o_orderkey // 64 FROM orders WHERE o_orderkey < 100)
SELECT z.volume, coalesce(chained, 0) AS chained, first_broken, head_seq, head_hash,
  (SELECT count(*) FROM orders WHERE o_orderkey < 100 AND o_orderkey // 64 = z.volume) AS legacy FROM z LEFT JOIN y ON y.volume = z.volume""",
    ),
    "aud_chain": (
        lambda s, d: L.verify_chain(chained(s, d), block=1000).select("chained", "legacy", "head_seq", "head_hash"),
        "SELECT count(*) FILTER (WHERE o_orderkey >= 100) AS chained, count(*) FILTER (WHERE o_orderkey < 100) AS legacy, max(o_orderkey) AS head_seq, sha256(max(o_orderkey)::VARCHAR) AS head_hash FROM orders",
    ),
    "aud_entry_hash": (
        lambda s, d: ledger(s, d).withColumn("occurred_at", F.lit(None).cast("string")).select("seq", L.entry_hash(F.lit("0")).alias("entry_hash")),
        """SELECT o_orderkey AS seq, sha256('["0","' || o_orderkey || '",null,"' || CASE WHEN o_orderkey % 3 = 0 THEN 'LOGIN' ELSE 'RULE_UPDATED' END || '","' || o_orderstatus || '","' || o_custkey || '",null,null,null,null,null,null]') AS entry_hash FROM orders""",
    ),
    "aud_anchors": (
        _anchors,
        """SELECT o_orderkey AS seq, CASE WHEN o_orderkey < 100 OR o_orderkey % 1000 = 5 THEN 'missing' ELSE 'different' END AS problem FROM orders WHERE o_orderkey < 100 OR o_orderkey % 1000 IN (5, 7)""",
    ),
    "aud_filter": (
        lambda s, d: L.filter_audit(ledger(s, d), ["LOGIN"], "F", since=datetime(1995, 1, 1, tzinfo=UTC), limit=40, offset=5).select("seq", "action"),
        "SELECT o_orderkey AS seq, 'LOGIN' AS action FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 40 OFFSET 5",
    ),
    "aud_redact": (
        lambda s, d: L.redact_columns(
            ledger(s, d).select("seq", "note").unionByName(
                sample.warehouse(s, d, "documents").select((-F.col("doc_id")).alias("seq"), F.concat(F.lit("Bearer abc.def "), "source", F.lit(" http://u:pw@h/ password=x1")).alias("note"))
            ), ["note"]),
        """SELECT o_orderkey AS seq, regexp_replace('token=' || o_orderpriority || ' ok', 'token=[^ ,]+', 'token=[REDACTED]') AS note FROM orders
UNION ALL SELECT -doc_id, 'Bearer [REDACTED] ' || source || ' http://u:[REDACTED]@h/ password=[REDACTED]' FROM documents""",
    ),
    "aud_safe_details": (
        lambda s, d: ledger(s, d).withColumn("details_map", F.create_map(F.lit("Password"), F.col("id"), F.lit("note"), F.col("note")))
        .select("seq", F.to_json(L.safe_details()).alias("details")),
        """SELECT o_orderkey AS seq, '{"note":"' || regexp_replace('token=' || o_orderpriority || ' ok', 'token=[^ ,]+', 'token=[REDACTED]') || '"}' AS details FROM orders""",
    ),
}
