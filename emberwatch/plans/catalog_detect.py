"""Queries over conditions, detection and hunting, each with its DuckDB statement."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from emberwatch.functions.allowlist import exclude_listed
from emberwatch.functions.conditions import apply_exclusions, compile_condition, field, require_group
from emberwatch.functions.net import to_network
from emberwatch.functions.text import fold
from emberwatch.lineage import stored
from emberwatch.operators import detect, explain, hunts
from emberwatch.plans import run
from emberwatch.plans.oracle import DAY, EV, HOUR, NET, bursts, with_
from emberwatch.plans.rules import tuned
from emberwatch.sources.readers import scan_events
from emberwatch.sources.sample import events, warehouse


def _allowlist(s, d):
    """An entry per customer: a /31, an account for three days, or one address."""
    key, kind = F.col("c_custkey"), F.col("c_custkey") % 3
    host = ((kind + key % 2) * 2).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    day = F.when(kind == 1, F.timestamp_add("DAY", (key % 20).cast("int"), F.lit("2024-01-02").cast("timestamp")))
    return warehouse(s, d, "customer").select(
        F.when(kind == 1, "username").otherwise("source_ip").alias("field"),
        F.when(kind == 0, text("10.", key % 2, ".", key % 5, ".", host, "/31")).when(kind == 1, text("USER", key))
        .otherwise(text("203.0.113.", key % 9)).alias("value"),
        day.alias("active_from"), F.timestamp_add("DAY", F.lit(3), day).alias("active_until"),
    )


def _on_history(s, d):
    """Two runs, one after the other; each reads the sums that the one before it left."""
    rule, rows = tuned("AUTH-004"), events(s, d)
    first, second, last = (datetime(*t, tzinfo=UTC) for t in ((2024, 1, 16), (2024, 1, 19, 6), (2024, 3, 1)))
    tick = timedelta(microseconds=1)
    sums = stored(detect.compact_history(rows.filter(F.col("timestamp") < F.lit(first)), rule))
    found = run.evidence_of(rows, [rule], first, second - tick, {rule["id"]: sums}).withColumn("run", F.lit(0))
    between = rows.filter((F.col("timestamp") >= F.lit(first)) & (F.col("timestamp") < F.lit(second)))
    sums = stored(detect.merge_history(sums, detect.compact_history(between, rule), detect.group_keys(rule)))
    found = found.unionByName(run.evidence_of(rows, [rule], second, last, {rule["id"]: sums}).withColumn("run", F.lit(1)))
    return found.select("run", "id", "username", "value", "history_count", "us")


FAIL = "category = 'authentication' AND action = 'logon' AND outcome = 'failure'"
GOOD = "category = 'authentication' AND action = 'logon' AND outcome = 'success'"
AUTH1 = tuned("AUTH-001", threshold=2, time_window="24h")
AUTH2 = tuned("AUTH-002", threshold=1, time_window="24h", max_gap="12h")
AUTH2_TWO = tuned("AUTH-002", threshold=2, time_window="7d", max_gap=None)
AUTH3 = tuned("AUTH-003", threshold=3, time_window="24h")
AUTH5 = tuned("AUTH-005", threshold=2, time_window="24h")
ACCT1 = tuned("ACCT-001", time_window="24h")
NET1 = tuned("NET-001", threshold=2, time_window="24h")
SEQ3 = {
    "id": "SEQ-003", "kind": "sequence", "group_by": ["host"], "threshold": 2, "time_window": "24h", "max_gap": "12h",
    "steps": [
        {"name": "failures", "match": {"all": [{"field": "event_action", "op": "eq", "value": "logon"}, {"field": "event_outcome", "op": "eq", "value": "failure"}]}},
        {"name": "logons", "match": {"all": [{"field": "event_action", "op": "eq", "value": "logon"}, {"field": "event_outcome", "op": "eq", "value": "success"}]}, "min_count": 2},
        {"name": "account change", "match": {"field": "event_category", "op": "eq", "value": "iam"}},
    ],
}
TUNED = [AUTH1, AUTH2, AUTH3, tuned("AUTH-004"), AUTH5, ACCT1, NET1, tuned("PRIV-001"), tuned("PROC-001")]

START, END = datetime(2024, 1, 8, tzinfo=UTC), datetime(2024, 1, 20, 12, tzinfo=UTC)
RANGE = "ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"

B1 = bursts("f1", FAIL + " AND service = 'sshd'", ["source_ip", "host", "username"], 2, DAY)
B3 = bursts("f3", FAIL, ["source_ip"], 3, DAY, "username")
B5 = bursts("f5", FAIL + " AND invalid_user IS DISTINCT FROM TRUE", ["username"], 2, DAY, "source_ip")
BN = bursts(
    "fn", "category = 'network' AND action = 'connection' AND source_ip_scope = 'internal'",
    ["source_ip"], 2, DAY, "destination_ip || ':' || destination_port",
)
PRIV = """pr AS (SELECT *, CASE WHEN outcome = 'failure' AND failure_reason = 'not_in_sudoers' THEN 'not_in_sudoers'
  WHEN outcome = 'success' AND target_username = 'root' AND command_line = '/bin/bash' THEN 'root_shell' END AS indicator
  FROM ev WHERE category = 'privilege' AND action = 'sudo')"""
PROC = """pc AS (SELECT *, CASE process_name WHEN 'powershell.exe' THEN 'encoded_powershell'
  WHEN 'curl' THEN 'download_pipe_shell' WHEN 'certutil.exe' THEN 'certutil_download'
  WHEN 'bash' THEN 'dev_tcp_shell' END AS indicator FROM ev WHERE category = 'process' AND command_line IS NOT NULL)"""


def pairs(name: str, first: str, last: str, keys: list[str], window: int, gap: int | None) -> str:
    """Two-step sequence with one event needed: a final right after new first-step events."""
    k = ", ".join(keys)
    near = window if gap is None else min(window, gap)
    return f"""
{name}_r AS (SELECT *, ({first}) AS s1, ({last}) AS s2 FROM ev WHERE ({first}) OR ({last})),
{name}_o AS (
  SELECT *, max(us) FILTER (WHERE s1) OVER (PARTITION BY {k} ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS last_first,
    count(*) FILTER (WHERE s1) OVER (PARTITION BY {k} ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS c
  FROM {name}_r),
{name}_f AS (
  SELECT *, row_number() OVER (PARTITION BY {k}, c ORDER BY us, id) AS nth FROM {name}_o
  WHERE s2 AND c > 0 AND us - last_first <= {near}),
{name}_d AS (
  SELECT *, lag(us) OVER (PARTITION BY {k} ORDER BY us, id) AS before_us,
    lag(id) OVER (PARTITION BY {k} ORDER BY us, id) AS before_id FROM {name}_f WHERE nth = 1),
{name}_e AS (
  SELECT d.{", d.".join(keys)}, d.id AS final_id, d.us AS final_us, r.us, r.id, r.batch_id, r.s1
  FROM {name}_d d JOIN {name}_r r ON {" AND ".join(f"d.{x} = r.{x}" for x in keys)}
    AND (r.id = d.id OR (r.s1 AND r.us >= d.us - {window} AND (r.us, r.id) < (d.us, d.id)
      AND (d.before_us IS NULL OR (r.us, r.id) > (d.before_us, d.before_id)))))"""


IAM_NEW = "category = 'iam' AND action = 'user_created'"
IAM_ADD = "category = 'iam' AND action = 'group_member_added' AND group_name = 'sudo'"
P2 = pairs("p2", FAIL, GOOD, ["source_ip", "username", "host"], DAY, 12 * HOUR)
PA = pairs("pa", IAM_NEW, IAM_ADD, ["host", "target_username"], DAY, None)
NV = f"""
nv_m AS (SELECT *, {NET.format("source_ip")} AS v FROM ev WHERE {GOOD}),
nv_c AS (
  SELECT *, count(*) OVER (PARTITION BY username ORDER BY us RANGE BETWEEN {14 * DAY} PRECEDING AND 1 PRECEDING) AS history,
    count(*) OVER (PARTITION BY username, v ORDER BY us RANGE BETWEEN {14 * DAY} PRECEDING AND 1 PRECEDING) AS same
  FROM nv_m),
nv AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY username, v ORDER BY us, id) AS nth FROM nv_c
  WHERE same = 0 AND history >= 5) WHERE nth = 1)"""

_ONE = "{'us': us, 'id': id}"
SEQ3_SQL = f"""
m_r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, id) AS nth FROM (
  SELECT host, us, id, ({FAIL}) AS s1, ({GOOD}) AS s2, category = 'iam' AS s3 FROM ev) WHERE s1 OR s2 OR s3),
m_w AS (
  SELECT *, CASE WHEN s1 THEN [{_ONE}] ELSE [] END AS p1, CASE WHEN s2 THEN [{_ONE}] ELSE [] END AS p2,
    NULL::STRUCT(us BIGINT, id VARCHAR)[] AS taken FROM m_r WHERE nth = 1
  UNION ALL
  SELECT host, us, id, s1, s2, s3, nth,
    CASE WHEN done THEN list_filter(l1, lambda x: x.us > f.us OR (x.us = f.us AND x.id >= f.id))
      WHEN s1 THEN list_append(l1, {_ONE}) ELSE l1 END,
    CASE WHEN done THEN [] WHEN s2 THEN list_append(l2, {_ONE}) ELSE l2 END,
    CASE WHEN done THEN t1 || l2 || [{_ONE}] END
  FROM (
    SELECT *, s3 AND len(l2) >= 2 AND us - l2[-1].us <= {12 * HOUR} AND len(t1) >= 2 AND f.us - t1[-1].us <= {12 * HOUR} AS done
    FROM (
      SELECT *, list_filter(l1, lambda x: x.us < f.us OR (x.us = f.us AND x.id < f.id)) AS t1
      FROM (
        SELECT *, l2[1] AS f FROM (
          SELECT r.*, list_filter(w.p1, lambda x: x.us >= r.us - {DAY}) AS l1, list_filter(w.p2, lambda x: x.us >= r.us - {DAY}) AS l2
          FROM m_w w JOIN m_r r ON r.host = w.host AND r.nth = w.nth + 1)))))"""


#: A rule that cannot be planned, and below an evaluation that fails while it runs.
BROKEN = dict(tuned("PRIV-001"), id="BROKEN", match={"field": "no_such_field", "op": "eq", "value": 1})


def _failing(rows, rule, *span):
    found = detect.evaluate(rows, rule, *span)
    return found.withColumn("value", F.raise_error(F.lit("broken")).cast("string")) if rule["id"] == "FAILS" else found


def _matches(df, *extra):
    keys = ["match_id"]
    return df.groupBy(*keys).agg(
        F.count("*").alias("event_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), *extra
    )


def _burst_sql(name: str, rule: str, keys: list[str], ctes: str, extra: str = "") -> str:
    k = " || '|' || ".join(keys)
    return with_(EV, ctes, body=f"""
SELECT '{rule}|' || {k} || '|' || t0 AS match_id, count(*) AS event_count, min(us) AS first_us, max(us) AS last_us{extra}
FROM {name}_e GROUP BY {", ".join(keys)}, t0""")


def _count(condition):
    """How many events per category a condition accepts."""
    return lambda spark, d: (
        events(spark, d).filter(compile_condition(condition)).groupBy("event_category").agg(F.count("*").alias("n"))
    )


def _count_sql(where: str) -> str:
    return with_(EV, body=f"SELECT category AS event_category, count(*) AS n FROM ev WHERE {where} GROUP BY 1")


def _p(name, op, value=None):
    return {"field": name, "op": op, "value": value}


# A run over [START, END] reads a window more on both sides; single events have none.
RANGE_COLUMNS = ["rule_id", "event_count", "first_us", "last_us"]
_FROM, _TO = (f"epoch_us(TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}')" for t in (START, END))
_NEAR = f" AND us BETWEEN {_FROM} - {DAY} AND {_TO} + {DAY}"
RANGE = [
    bursts("g1", FAIL + " AND service = 'sshd'" + _NEAR, ["source_ip", "host", "username"], 2, DAY),
    bursts("g3", FAIL + _NEAR, ["source_ip"], 3, DAY, "username"),
    PRIV,
]
_FACTS = "count(*) AS event_count, min(us) AS first_us, max(us) AS last_us, list(batch_id) AS batches"
RANGE_ALL = f""", found AS (SELECT 'AUTH-001' AS rule_id, {_FACTS} FROM g1_e GROUP BY source_ip, host, username, t0
UNION ALL SELECT 'AUTH-003', {_FACTS} FROM g3_e GROUP BY source_ip, t0
UNION ALL SELECT 'PRIV-001', {_FACTS} FROM pr WHERE indicator IS NOT NULL AND us BETWEEN {_FROM} AND {_TO} GROUP BY id)"""


QUERIES: dict[str, tuple] = {
    "cnd_fold": (
        lambda s, d: events(s, d).groupBy(fold(F.upper("message")).alias("folded")).agg(F.count("*").alias("n")),
        with_(EV, body="SELECT lower(message) AS folded, count(*) AS n FROM ev GROUP BY 1"),
    ),
    "cnd_eq_ne": (
        _count({"all": [_p("username", "ne", "USER7"), _p("target_username", "ne", "root"), _p("event_outcome", "eq", "Success")]}),
        _count_sql("username <> 'user7' AND target_username IS DISTINCT FROM 'root' AND outcome = 'success'"),
    ),
    "cnd_in_not_in": (
        _count({"all": [_p("service", "not_in", ["sudo", "cron"]), _p("host", "in", ["srv-1", "SRV-2", "srv-3"])]}),
        _count_sql("(service IS NULL OR service NOT IN ('sudo', 'cron')) AND host IN ('srv-1', 'srv-2', 'srv-3')"),
    ),
    "cnd_text_search": (
        _count({"any": [_p("command_line", "contains", "/DEV/tcp/"), _p("message", "startswith", "View by user1"), _p("message", "endswith", "USER99")]}),
        _count_sql("contains(command_line, '/dev/tcp/') OR starts_with(message, 'view by user1') OR ends_with(message, 'user99')"),
    ),
    "cnd_cidr": (
        _count({"any": [_p("source_ip", "cidr", "10.1.0.0/16"), _p("destination_ip", "cidr", "10.9.64.0/18"), _p("source_ip", "cidr", "203.0.113.8/29")]}),
        _count_sql("source_ip LIKE '10.1.%' OR split_part(destination_ip, '.', 3)::INT BETWEEN 64 AND 127 OR (source_ip LIKE '203.%' AND split_part(source_ip, '.', 4)::INT BETWEEN 8 AND 15)"),
    ),
    "cnd_exists": (
        _count({"all": [_p("process_name", "exists", False), _p("target_username", "exists")]}),
        _count_sql("process_name IS NULL AND target_username IS NOT NULL"),
    ),
    "cnd_ports": (
        _count({"any": [{"all": [_p("destination_port", "gte", 30), _p("destination_port", "lt", 60)]}, _p("destination_port", "gt", 110)]}),
        _count_sql("destination_port >= 30 AND destination_port < 60 OR destination_port > 110"),
    ),
    "cnd_matches": (
        _count(_p("command_line", "matches", r"(?i)\b(?:CURL|wget)\b[^|]{0,2048}\|\s*sh\b")),
        _count_sql("regexp_matches(command_line, '(?i)\\b(?:CURL|wget)\\b[^|]{0,900}\\|\\s*sh\\b')"),
    ),
    "cnd_not_any_all": (
        _count({"all": [{"not": _p("target_username", "eq", "root")}, {"any": [_p("event_category", "eq", "iam"), {"not": _p("service", "exists")}]}]}),
        _count_sql("NOT coalesce(target_username = 'root', FALSE) AND (category = 'iam' OR service IS NULL)"),
    ),
    "cnd_fields": (
        lambda s, d: events(s, d).groupBy(
            field("attributes.group_name").alias("group_name"),
            field("target_account", True).alias("target_account"),
            F.split_part(field("destination", True), F.lit(":"), F.lit(2)).alias("port"),
        ).agg(F.count("*").alias("n")),
        with_(EV, body="SELECT group_name, target_username AS target_account, destination_port::VARCHAR AS port, count(*) AS n FROM ev GROUP BY ALL"),
    ),
    "cnd_exclusions": (
        lambda s, d: apply_exclusions(
            events(s, d),
            [
                {"field": "source_ip", "value": "10.0.3.0/24"},
                {"field": "username", "value": "USER5"},
                {"field": "host", "value": "srv-8", "active_from": START, "active_until": END},
            ],
        ).groupBy("host").agg(F.count("*").alias("n")),
        with_(EV, body="""SELECT host, count(*) AS n FROM ev WHERE NOT (source_ip LIKE '10.0.3.%' OR username = 'user5'
  OR (host = 'srv-8' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20 12:00:00')) GROUP BY 1"""),
    ),
    "cnd_allowlist": (
        lambda s, d: exclude_listed(events(s, d), _allowlist(s, d)).groupBy("host").agg(F.count("*").alias("n")),
        with_(EV, body="""SELECT host, count(*) AS n FROM ev WHERE NOT (EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND
    source_ip LIKE '10.' || (c_custkey % 2) || '.' || (c_custkey % 5) || '.%' AND split_part(source_ip, '.', 4)::INT // 2 = c_custkey % 3 + c_custkey % 2)
  OR EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 1 AND username = 'user' || c_custkey
    AND ts >= TIMESTAMP '2024-01-02' + to_days((c_custkey % 20)::INT) AND ts < TIMESTAMP '2024-01-05' + to_days((c_custkey % 20)::INT))
  OR EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 2 AND source_ip = '203.0.113.' || (c_custkey % 9))) GROUP BY 1"""),
    ),
    "cnd_group_required": (
        lambda s, d: require_group(events(s, d), ["host", "target_account"]).groupBy("host").agg(F.count("*").alias("n")),
        with_(EV, body="SELECT host, count(*) AS n FROM ev WHERE target_username IS NOT NULL GROUP BY 1"),
    ),
    "det_single": (
        lambda s, d: run.evidence_of(events(s, d), [tuned("PRIV-001"), tuned("PROC-001")])
        .groupBy("rule_id", "indicator", "host").agg(F.count("*").alias("n"), F.min("us").alias("first_us")),
        with_(EV, PRIV, PROC, body="""SELECT 'PRIV-001' AS rule_id, indicator, host, count(*) AS n, min(us) AS first_us FROM pr WHERE indicator IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'PROC-001', indicator, host, count(*), min(us) FROM pc WHERE indicator IS NOT NULL GROUP BY ALL"""),
    ),
    "det_range_run": (
        lambda s, d: run.run_rules(events(s, d), [AUTH1, AUTH3, tuned("PRIV-001")], START, END).select(*RANGE_COLUMNS),
        with_(EV, *RANGE, body=f"{RANGE_ALL} SELECT rule_id, event_count, first_us, last_us FROM found"),
    ),
    "det_range_batch_run": (
        lambda s, d: run.run_rules(events(s, d), [AUTH1, AUTH3, tuned("PRIV-001")], START, END, "b-2024-01-10").select(*RANGE_COLUMNS),
        with_(EV, *RANGE, body=f"{RANGE_ALL} SELECT rule_id, event_count, first_us, last_us FROM found WHERE list_contains(batches, 'b-2024-01-10')"),
    ),
    "det_threshold": (
        lambda s, d: _matches(detect.evaluate(events(s, d), AUTH1)),
        _burst_sql("f1", "AUTH-001", ["source_ip", "host", "username"], B1),
    ),
    "det_distinct": (
        lambda s, d: _matches(detect.evaluate(events(s, d), AUTH3), F.countDistinct("value").alias("distinct_count")),
        _burst_sql("f3", "AUTH-003", ["source_ip"], B3, ", count(DISTINCT username) AS distinct_count"),
    ),
    "det_distinct_sources": (
        lambda s, d: _matches(detect.evaluate(events(s, d), AUTH5), F.countDistinct("value").alias("distinct_count")),
        _burst_sql("f5", "AUTH-005", ["username"], B5, ", count(DISTINCT source_ip) AS distinct_count"),
    ),
    "det_distinct_destinations": (
        lambda s, d: _matches(detect.evaluate(events(s, d), NET1), F.countDistinct("value").alias("distinct_count")),
        _burst_sql("fn", "NET-001", ["source_ip"], BN, ", count(DISTINCT destination_ip || ':' || destination_port) AS distinct_count"),
    ),
    "det_sequence": (
        lambda s, d: _matches(detect.evaluate(events(s, d), AUTH2)),
        with_(EV, P2, body="""SELECT 'AUTH-002|' || source_ip || '|' || username || '|' || host || '|' || final_id AS match_id,
  count(*) AS event_count, min(us) AS first_us, max(us) AS last_us FROM p2_e GROUP BY source_ip, username, host, final_id"""),
    ),
    "det_sequence_account": (
        lambda s, d: _matches(detect.evaluate(events(s, d), ACCT1)),
        with_(EV, PA, body="""SELECT 'ACCT-001|' || host || '|' || target_username || '|' || final_id AS match_id,
  count(*) AS event_count, min(us) AS first_us, max(us) AS last_us FROM pa_e GROUP BY host, target_username, final_id"""),
    ),
    "det_sequence_greedy": (
        lambda s, d: _matches(detect.evaluate(events(s, d), AUTH2_TWO)),
        with_("RECURSIVE " + EV.strip(), f"""
q_r AS (SELECT source_ip, username, host, us, id, outcome = 'failure' AS s1,
  row_number() OVER (PARTITION BY source_ip, username, host ORDER BY us, id) AS nth FROM ev WHERE ({FAIL}) OR ({GOOD})),
q_w AS (
  SELECT *, CASE WHEN s1 THEN [{{'us': us, 'id': id}}] ELSE [] END AS pending, NULL::STRUCT(us BIGINT, id VARCHAR)[] AS taken FROM q_r WHERE nth = 1
  UNION ALL
  SELECT r.*, CASE WHEN r.s1 THEN list_append(list_filter(w.pending, lambda x: x.us >= r.us - {7 * DAY}), {{'us': r.us, 'id': r.id}})
      WHEN len(list_filter(w.pending, lambda x: x.us >= r.us - {7 * DAY})) >= 2 THEN []
      ELSE w.pending END,
    CASE WHEN NOT r.s1 AND len(list_filter(w.pending, lambda x: x.us >= r.us - {7 * DAY})) >= 2
      THEN list_filter(w.pending, lambda x: x.us >= r.us - {7 * DAY}) END
  FROM q_w w JOIN q_r r ON r.source_ip = w.source_ip AND r.username = w.username AND r.host = w.host AND r.nth = w.nth + 1)""",
        body="""SELECT 'AUTH-002|' || source_ip || '|' || username || '|' || host || '|' || id AS match_id,
  len(taken) + 1 AS event_count, list_min([x.us FOR x IN taken]) AS first_us, us AS last_us FROM q_w WHERE taken IS NOT NULL"""),
    ),
    "det_sequence3": (
        lambda s, d: _matches(detect.evaluate(events(s, d), SEQ3)),
        with_("RECURSIVE " + EV.strip(), SEQ3_SQL, body="""SELECT 'SEQ-003|' || host || '|' || id AS match_id,
  len(taken) AS event_count, list_min([x.us FOR x IN taken]) AS first_us, us AS last_us FROM m_w WHERE taken IS NOT NULL"""),
    ),
    "det_new_value": (
        lambda s, d: detect.evaluate(events(s, d), tuned("AUTH-004")).select("id", "username", "value", "history_count", "us"),
        with_(EV, NV, body="SELECT id, username, v AS value, history AS history_count, us FROM nv"),
    ),
    "det_new_value_history": (
        _on_history,
        with_(EV, NV, body=f"""SELECT run, id, username, v AS value, history AS history_count, us FROM (
  SELECT *, row_number() OVER (PARTITION BY run, username, v ORDER BY us, id) AS nth FROM (
    SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-19 06:00:00' THEN 0 ELSE 1 END AS run FROM nv_c WHERE same = 0 AND history >= 5 AND ts >= TIMESTAMP '2024-01-16 00:00:00'))
WHERE nth = 1"""),
    ),
    "det_network": (
        lambda s, d: events(s, d).groupBy(to_network(F.col("source_ip")).alias("network")).agg(F.count("*").alias("n")),
        with_(EV, body=f"SELECT {NET.format('source_ip')} AS network, count(*) AS n FROM ev GROUP BY 1"),
    ),
    "det_history": (
        lambda s, d: detect.merge_history(
            detect.compact_history(events(s, d).filter("timestamp < '2024-01-15'"), tuned("AUTH-004")),
            detect.compact_history(events(s, d).filter("timestamp >= '2024-01-15'"), tuned("AUTH-004")),
            ["_k0"],
        ).groupBy(F.col("_k0").alias("username"), F.col("v").alias("value")).agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us")),
        with_(EV, body=f"SELECT username, {NET.format('source_ip')} AS value, count(*) AS n, max(us) AS last_us FROM ev WHERE {GOOD} GROUP BY ALL"),
    ),
    "det_nine_rules": (
        lambda s, d: run.run_rules(events(s, d), TUNED).groupBy("rule_id").agg(
            F.count("*").alias("detections"), F.sum("event_count").alias("events"), F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"), F.sum(F.size("evidence_ids")).cast("bigint").alias("cited"),
        ),
        with_(EV, B1, B3, B5, BN, PRIV, PROC, P2, PA, NV, body="""
SELECT rule_id, count(*) AS detections, sum(n)::BIGINT AS events, min(a) AS first_us, max(b) AS last_us, sum(least(n, 100))::BIGINT AS cited FROM (
  SELECT 'AUTH-001' AS rule_id, count(*) AS n, min(us) AS a, max(us) AS b FROM f1_e GROUP BY source_ip, host, username, t0
  UNION ALL SELECT 'AUTH-003', count(*), min(us), max(us) FROM f3_e GROUP BY source_ip, t0
  UNION ALL SELECT 'AUTH-005', count(*), min(us), max(us) FROM f5_e GROUP BY username, t0
  UNION ALL SELECT 'NET-001', count(*), min(us), max(us) FROM fn_e GROUP BY source_ip, t0
  UNION ALL SELECT 'AUTH-002', count(*), min(us), max(us) FROM p2_e GROUP BY source_ip, username, host, final_id
  UNION ALL SELECT 'ACCT-001', count(*), min(us), max(us) FROM pa_e GROUP BY host, target_username, final_id
  UNION ALL SELECT 'AUTH-004', 1, us, us FROM nv
  UNION ALL SELECT 'PRIV-001', 1, us, us FROM pr WHERE indicator IS NOT NULL
  UNION ALL SELECT 'PROC-001', 1, us, us FROM pc WHERE indicator IS NOT NULL) GROUP BY rule_id"""),
    ),
    "det_rule_results": (
        lambda s, d: run.run_isolated(events(s, d), [*TUNED, BROKEN, dict(tuned("PROC-001"), id="FAILS")], evaluator=_failing)[1],
        with_(EV, B1, B3, B5, BN, PRIV, PROC, P2, PA, NV, body="""
SELECT rule_id, candidates, detections, NULL::VARCHAR AS error FROM (
  SELECT 'AUTH-001' AS rule_id, (SELECT count(*) FROM f1_m) AS candidates, (SELECT count(*) FROM f1_t) AS detections
  UNION ALL SELECT 'AUTH-002', (SELECT count(*) FROM p2_r), (SELECT count(*) FROM p2_d)
  UNION ALL SELECT 'AUTH-003', (SELECT count(*) FROM f3_m), (SELECT count(*) FROM f3_t)
  UNION ALL SELECT 'AUTH-004', (SELECT count(*) FROM nv_m), (SELECT count(*) FROM nv)
  UNION ALL SELECT 'AUTH-005', (SELECT count(*) FROM f5_m), (SELECT count(*) FROM f5_t)
  UNION ALL SELECT 'ACCT-001', (SELECT count(*) FROM pa_r), (SELECT count(*) FROM pa_d)
  UNION ALL SELECT 'NET-001', (SELECT count(*) FROM fn_m), (SELECT count(*) FROM fn_t)
  UNION ALL SELECT 'PRIV-001', (SELECT count(*) FROM pr), (SELECT count(*) FROM pr WHERE indicator IS NOT NULL)
  UNION ALL SELECT 'PROC-001', (SELECT count(*) FROM pc), (SELECT count(*) FROM pc WHERE indicator IS NOT NULL))
UNION ALL SELECT 'BROKEN', 0, 0, 'evaluation_error' UNION ALL SELECT 'FAILS', 0, 0, 'evaluation_error'"""),
    ),
    "det_batch_run": (
        lambda s, d: run.run_rules(events(s, d), [AUTH1], batch_id="b-2024-01-10").select("match_id", "event_count", "first_us"),
        with_(EV, B1, body="""SELECT 'AUTH-001|' || source_ip || '|' || host || '|' || username || '|' || t0 AS match_id, count(*) AS event_count,
  min(us) AS first_us FROM f1_e GROUP BY source_ip, host, username, t0 HAVING bool_or(batch_id = 'b-2024-01-10')"""),
    ),
    "det_build": (
        lambda s, d: run.run_rules(events(s, d), [AUTH3]).select(
            "match_id", "severity", "event_count", F.col("distinct_count").cast("bigint"), "values_sample",
            F.col("facts")["host"].alias("hosts"), F.col("facts")["source_ip_scope"].alias("scope"),
        ),
        with_(EV, B3, body="""
, seen AS (SELECT source_ip, t0, username, min((us, id)) AS s FROM f3_e GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source_ip, t0 ORDER BY s) AS r FROM seen),
  sample AS (SELECT source_ip, t0, count(*) AS values, string_agg(username, ', ' ORDER BY r) FILTER (WHERE r <= 5) AS names FROM ranked GROUP BY ALL)
SELECT 'AUTH-003|' || source_ip || '|' || t0 AS match_id, 'medium' AS severity, count(*) AS event_count, any_value(values) AS distinct_count,
  any_value(names) || CASE WHEN any_value(values) > 5 THEN ', …' ELSE '' END AS values_sample,
  CASE WHEN count(DISTINCT host) = 1 THEN min(host) ELSE 'several (' || count(DISTINCT host) || ')' END AS hosts,
  min(source_ip_scope) AS scope FROM f3_e JOIN sample USING (source_ip, t0) GROUP BY source_ip, t0""").replace("\n, seen", ", seen"),
    ),
    "det_entities": (
        lambda s, d: explain.entities(explain.field_values(detect.evaluate(events(s, d), AUTH3)))
        .select("match_id", "field", F.array_join("top", ",").alias("top")).filter("field in ('host', 'username')"),
        with_(EV, B3, """
v AS (SELECT source_ip, t0, 'host' AS field, host AS text, count(*) AS n, min((us, id)) AS s FROM f3_e GROUP BY ALL
  UNION ALL SELECT source_ip, t0, 'username', username, count(*), min((us, id)) FROM f3_e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_ip, t0, field ORDER BY n DESC, s) AS k FROM v)""",
        body="SELECT 'AUTH-003|' || source_ip || '|' || t0 AS match_id, field, string_agg(text, ',' ORDER BY k) AS top FROM r WHERE k <= 10 GROUP BY source_ip, t0, field"),
    ),
    "det_cap_evidence": (
        lambda s, d: explain.cap_evidence(
            events(s, d).select(F.col("source_ip").alias("match_id"), F.unix_micros("timestamp").alias("us"), "id")
        ).select("match_id", F.size("evidence_ids").alias("kept"), F.array_join("evidence_ids", ",").alias("ids")),
        with_(EV, """r AS (SELECT source_ip, us, id, row_number() OVER (PARTITION BY source_ip ORDER BY us, id) AS a,
  row_number() OVER (PARTITION BY source_ip ORDER BY us DESC, id DESC) AS b FROM ev)""",
        body="SELECT source_ip AS match_id, count(*)::INT AS kept, string_agg(id, ',' ORDER BY us, id) AS ids FROM r WHERE a <= 50 OR b <= 50 GROUP BY 1"),
    ),
    "det_explanation": (
        lambda s, d: run.run_rules(events(s, d), [AUTH1]).select("match_id", "explanation"),
        with_(EV, B1, """
m AS (SELECT source_ip, host, username, t0, count(*) AS n, min(us) AS a, max(us) AS b, (max(us) - min(us)) // 1000000 AS sec,
  min(source_ip_scope) AS scope FROM f1_e GROUP BY source_ip, host, username, t0),
w AS (SELECT *, CASE WHEN sec < 60 THEN sec || ' s'
  WHEN sec % 86400 = 0 THEN (sec // 86400) || CASE WHEN sec = 86400 THEN ' day' ELSE ' days' END
  ELSE concat_ws(' ', CASE WHEN sec >= 3600 THEN (sec // 3600) || ' h' END,
    CASE WHEN sec % 3600 >= 60 THEN (sec % 3600 // 60) || ' min' END,
    CASE WHEN sec < 3600 AND sec % 60 > 0 THEN (sec % 60) || ' s' END) END AS span FROM m)""",
        body="""SELECT 'AUTH-001|' || source_ip || '|' || host || '|' || username || '|' || t0 AS match_id,
  n || ' failed SSH logons for "' || username || '" on ' || host || ' from ' || source_ip || ' (' || scope || ') within ' || span ||
  ', between ' || strftime(make_timestamp(a), '%Y-%m-%d %H:%M:%S UTC') || ' and ' || strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S UTC') ||
  '. This rule alerts at 2 failures within 1 day.' AS explanation FROM w"""),
    ),
    "det_backtest": (
        lambda s, d: run.backtest(
            events(s, d), tuned("AUTH-003"), threshold=3, time_window="24h",
            exclusions=[{"field": "username", "value": "user5"}],
        )[1].groupBy("excluded", "matched").agg(F.count("*").alias("n")),
        with_(EV, body=f"SELECT username = 'user5' AS excluded, {FAIL} AS matched, count(*) AS n FROM ev GROUP BY ALL"),
    ),
    "det_rule_stats": (
        lambda s, d: run.rule_stats(
            run.evidence_of(events(s, d), [AUTH1, AUTH3]).groupBy("rule_id", "match_id").agg(F.max("us").alias("last_us"))
        ),
        with_(EV, B1, B3, body="""SELECT 'AUTH-001' AS rule_id, count(*) AS match_count, max(hi) AS last_match_us FROM f1_t
UNION ALL SELECT 'AUTH-003', count(*), max(hi) FROM f3_t"""),
    ),
    "det_run_history": (
        lambda s, d: run.run_history(
            events(s, d).groupBy(F.col("batch_id").alias("id")).agg(
                F.max("timestamp").alias("started_at"), F.count("*").alias("events")
            ).withColumn("trigger", F.when(F.col("events") % 2 == 0, "ingest").otherwise("manual")), "ingest", 5,
        ).select("id", "trigger", "events"),
        with_(EV, body="""SELECT batch_id AS id, 'ingest' AS trigger, count(*) AS events FROM ev GROUP BY 1
HAVING count(*) % 2 = 0 ORDER BY max(ts) DESC LIMIT 5"""),
    ),
    "hnt_hunt": (
        lambda s, d: hunts.hunt(
            events(s, d),
            [_p("event_outcome", "eq", "failure"), _p("source_ip", "cidr", "203.0.113.0/24"), _p("message", "contains", "USER1")],
            START, END,
        ).select("id", "username", "source_ip"),
        with_(EV, body=f"SELECT id, username, source_ip FROM ev WHERE {RANGE} AND outcome = 'failure' AND source_ip LIKE '203.0.113.%' AND contains(message, 'user1')"),
    ),
    "hnt_attribute": (
        lambda s, d: events(s, d).withColumn("attributes_json", F.to_json("attributes"))
        .filter(hunts.attribute_filter("invalid_user", "eq", True)).select("id"),
        with_(EV, body="SELECT id FROM ev WHERE invalid_user"),
    ),
    "hnt_resolve_range": (
        lambda s, d: hunts.in_range(events(s, d), *hunts.resolve_range("7d", now=END)).groupBy("host").agg(F.count("*").alias("n")),
        with_(EV, body="SELECT host, count(*) AS n FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1"),
    ),
    "hnt_keyset_page": (
        lambda s, d: hunts.keyset_page(events(s, d), 25, (datetime(2024, 1, 15, tzinfo=UTC), "000000004000")).select("id", "has_more"),
        with_(EV, body="SELECT id, TRUE AS has_more FROM ev WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, id DESC LIMIT 25"),
    ),
    "hnt_capped_count": (
        lambda s, d: hunts.capped_count(events(s, d).filter("event_outcome = 'failure'"), 1000),
        with_(EV, body="SELECT least(count(*), 1000) AS total, count(*) > 1000 AS capped FROM ev WHERE outcome = 'failure'"),
    ),
    "hnt_success_after_failures": (
        lambda s, d: hunts.success_after_failures(events(s, d), 2, 1440),
        with_(EV, body=f"""SELECT * FROM (SELECT s.id AS event_id, s.us, s.host, s.username, s.source_ip,
  count(f.id) AS failures, min(f.us) AS first_failure_us FROM ev s JOIN ev f ON f.username = s.username AND f.source_ip = s.source_ip
  AND f.us >= s.us - {DAY} AND f.us < s.us WHERE s.{GOOD.replace(' AND ', ' AND s.')} AND f.{FAIL.replace(' AND ', ' AND f.')}
  GROUP BY ALL) WHERE failures >= 2"""),
    ),
    "hnt_first_seen_source": (
        lambda s, d: hunts.first_seen_source(events(s, d), 14, 5, START, END),
        with_(EV, NV, body=f"""SELECT event_id, us, host, username, source_ip, network, history FROM (
  SELECT id AS event_id, us, host, username, source_ip, v AS network, history,
    row_number() OVER (PARTITION BY username, v ORDER BY us, id) AS k FROM nv_c WHERE same = 0 AND history >= 5 AND {RANGE}) WHERE k = 1"""),
    ),
    "hnt_rare_process": (
        lambda s, d: hunts.rare_process(events(s, d), 34).withColumn("hosts", F.array_join("hosts", ",")),
        with_(EV, body="""SELECT process_name, array_to_string(list_sort(list(DISTINCT host))[1:10], ',') AS hosts, count(*) AS executions,
  min(us) AS first_us, max(us) AS last_us FROM ev WHERE process_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT host) <= 34"""),
    ),
    "hnt_one_source_many_accounts": (
        lambda s, d: hunts.one_source_many_accounts(events(s, d), 5).withColumn("sample_accounts", F.array_join("sample_accounts", ",")),
        with_(EV, body=f"""SELECT source_ip, count(DISTINCT username) AS accounts, array_to_string(list_sort(list(DISTINCT username))[1:10], ',') AS sample_accounts,
  count(*) AS failures, min(us) AS first_us, max(us) AS last_us FROM ev WHERE {FAIL} GROUP BY 1 HAVING count(DISTINCT username) >= 5"""),
    ),
    "src_scan_events": (
        lambda s, d: scan_events(events(s, d), START, END, event_action="logon", host="SRV-4").select("id", "username"),
        with_(EV, body=f"SELECT id, username FROM ev WHERE {RANGE} AND action = 'logon' AND host = 'srv-4'"),
    ),
}
