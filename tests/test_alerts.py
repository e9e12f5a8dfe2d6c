"""Alert folding, priority, correlation and workflow on small frames."""

import random


import pytest
from frames import event, frame
from pyspark.sql import functions as F

from emberwatch.operators import alerts as A
from emberwatch.operators import correlate as C
from emberwatch.operators import incidents, workflow
from emberwatch.operators.assembly import Walk
from emberwatch.operators.priority import alert_priority, band
from emberwatch.plans.rules import tuned
from emberwatch.plans.run import run_rules

RULES = [tuned("AUTH-001", threshold=3)]


def test_bands_and_points(spark):
    edges = spark.createDataFrame([(s,) for s in (24, 25, 49, 50, 74, 75)], "s int")
    assert [r.b for r in edges.select(band(F.col("s")).alias("b")).collect()] == ["low", "medium", "medium", "high", "high", "critical"]
    cols = ("severity string, confidence string, kind string, threshold int, peak_count bigint, asset_name string, asset_level string, "
            "actor string, actor_privileged boolean, target string, target_privileged boolean")
    rows = [
        ("medium", "medium", "threshold", 5, 9, None, None, None, None, None, None),
        ("medium", "medium", "threshold", 5, 10, "web", "low", "bob", False, None, None),
        ("high", "high", "single", None, 99, "web", "critical", "root", True, "adm", True),
        ("low", "low", "distinct", 5, 10, "web", "high", None, None, "adm", True),
        ("critical", "high", "threshold", 2, 9, "web", "critical", "root", True, None, None),
    ]
    got = [(r.priority_score, [f["factor"] for f in r.priority_breakdown]) for r in alert_priority(spark.createDataFrame(rows, cols)).collect()]
    assert [g[0] for g in got] == [38, 38, 80, 35, 100]
    assert got[2][1] == ["severity", "confidence", "asset", "identity"] and got[3][1][-1] == "evidence"


def test_alerts_extend_once_and_reopen_anew(spark):
    first = frame(spark, [event(i, i) for i in range(3)])
    both = frame(spark, [event(i, i) for i in range(3)] + [event(i, 4000 + i) for i in range(10, 14)])
    a1, l1 = A.apply_detections(run_rules(first, RULES), RULES, 1)
    one = a1.first()
    assert (a1.count(), one.event_count, one.detection_count, one.status) == (1, 3, 1, "NEW")
    found = run_rules(both, RULES)
    a2, l2 = A.apply_detections(found, RULES, 2, a1, l1)
    two = a2.first()
    assert (a2.count(), two.event_count, two.detection_count, two.peak_count, two.created_us, len(two.history)) == (1, 7, 2, 4, 1, 2)
    assert A.apply_detections(found, RULES, 3, a2, l2)[1].count() == l2.count() == 7
    closed = a1.withColumn("status", F.lit("RESOLVED"))
    a3, _ = A.apply_detections(found, RULES, 4, closed, l1)
    fresh = a3.filter("status = 'NEW'").first()
    assert a3.count() == 2 and fresh.previous_alert_id == one.id and fresh.event_count == 4


COLUMNS = ("id string, rule_id string, indicator string, title string, severity string, status string, host string, username string, "
           "target_username string, source_ip string, first_us bigint, last_us bigint, hosts array<string>, users array<string>, "
           "sources array<string>, tactics array<string>, techniques array<string>, succeeded boolean, access boolean")
MIN = 60_000_000


def subject(i, at, host="h", user=None, source=None, technique="T1", access=False, severity="medium", last=None):
    return (f"a{i:03d}", f"R-{technique}", None, f"t{i}", severity, "NEW", host, user, None, source, at, last or at, [host] if host else [],
            [user] if user else [], [source] if source else [], [], [technique], access, access)


@pytest.mark.parametrize(
    "a,b,strength",
    [
        (dict(user="u"), dict(user="u"), "STRONG"),
        (dict(source="10.0.0.1"), dict(source="10.0.0.1"), "STRONG"),
        (dict(host="x", source="203.0.113.9"), dict(host="y", source="203.0.113.9"), "MEDIUM"),
        (dict(technique="T2"), dict(access=True), "MEDIUM"),
        (dict(technique="T1"), dict(access=True), "WEAK"),
        (dict(host="x", source="10.0.0.1"), dict(host="y", source="10.0.0.1"), "WEAK"),
        (dict(host="x", user="u"), dict(host="y", user="u"), "WEAK"),
        (dict(host="x"), dict(host="y"), None),
    ],
)
def test_link_strength(spark, a, b, strength):
    for gap, inside in ((20 * MIN, True), (120 * MIN, True), (120 * MIN + 1, False)):
        rows = spark.createDataFrame([subject(1, 10**15 + gap, **a), subject(2, 10**15, **b)], COLUMNS)
        pair = spark.createDataFrame([("a001", "a002")], "id string, other string")
        got = [r.strength for r in C.score_links(pair, rows).collect()]
        want = strength if inside else None
        if want == "MEDIUM" and "technique" in a and gap > 30 * MIN:
            want = "WEAK"
        assert got == ([want] if want else [])
        linking = strength in ("STRONG", "MEDIUM") and inside
        if linking:
            assert ("a001", "a002") in {tuple(r) for r in C.candidate_pairs(rows).collect()}


def meeting(spark):
    """Alerts of very different spans that share several things at once."""
    rng, day = random.Random(8), 24 * 60 * MIN
    rows = []
    for i in range(150):
        at = 10**15 + rng.randrange(6000) * MIN
        one = list(subject(i, at, host=f"h{rng.randrange(4)}", user=f"u{rng.randrange(6)}", technique=f"T{rng.randrange(3)}",
                           access=rng.random() < 0.3, last=at + rng.choice([0, 0, MIN, 5 * day])))
        one[14] = [f"203.0.113.{k}" for k in range(3) if rng.random() < 0.4] + ["10.0.0.1"]
        rows.append(tuple(one))
    return spark.createDataFrame(rows, COLUMNS)


def test_pairs_meet_once_and_never_move(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 7)
    df = meeting(spark)
    facts = [r.asDict() for r in df.collect()]

    def meets(a, b):
        host, near = set(a["hosts"]) & set(b["hosts"]), a["first_us"] <= b["last_us"] + C.CORRELATION_WINDOW and a["last_us"] >= b["first_us"] - C.CORRELATION_WINDOW
        sources = set(a["sources"]) & set(b["sources"])
        return near and (bool(host and (set(a["users"]) & set(b["users"]) or sources or b["access"])) or any(x.startswith("203") for x in sources))

    want = sorted((a["id"], b["id"]) for a in facts for b in facts if a["id"] != b["id"] and meets(a, b))
    pairs = C.candidate_pairs(df)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 500
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    twice = C.candidate_pairs(df.unionByName(df.limit(9)))  # an id with several rows
    assert sorted(map(tuple, twice.collect())) == want


def test_links_are_scored_where_pairs_meet(spark):
    df = meeting(spark)
    joins = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("Join")
    plain, carried = C.candidate_pairs(df), C.candidate_pairs(df, facts=True)
    rows = lambda links: sorted(repr(r) for r in links.collect())
    got = C.score_links(carried, df)
    assert joins(got) == joins(carried) and rows(got) == rows(C.score_links(plain, df))
    repeated = df.unionByName(df.limit(9))
    assert rows(C.score_links(C.candidate_pairs(repeated, facts=True), repeated)) == rows(C.score_links(plain, repeated))


def test_assembly_by_component_equals_one_walk(spark):
    rng = random.Random(5)
    rows = [
        subject(i, 10**15 + rng.randrange(6000) * MIN, host=f"h{rng.randrange(12)}", user=f"u{rng.randrange(12)}" if rng.random() < 0.6 else None,
                source=f"203.0.113.{rng.randrange(20)}" if rng.random() < 0.4 else None, technique=f"T{rng.randrange(3)}",
                access=rng.random() < 0.2, severity=rng.choice(["low", "medium", "high"]))
        for i in range(160)
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    assert df.transform(C.components).select("component").distinct().count() > 3
    got = {(r.incident_id, r.alert_id, r.strength) for r in C.assemble_incidents(df).collect()}
    whole = df.toPandas()
    whole["external"], whole["open"], whole["prior"], whole["incident_open"], whole["apart"] = whole["sources"], True, None, None, None
    want = Walk(whole, C.CORRELATION_WINDOW, C.SEQUENCE_WINDOW).run()
    assert got == set(zip(want.incident_id, want.alert_id, want.strength)) and len(got) > 50


def test_prior_incidents_and_unlinked_pairs(spark):
    rows = spark.createDataFrame([subject(1, 10**15, user="u"), subject(2, 10**15 + MIN, user="u"), subject(3, 10**15 + 2 * MIN, user="u")], COLUMNS)
    prior = spark.createDataFrame([("a001", "i1", True)], "alert_id string, incident_id string, incident_open boolean")
    got = {(r.incident_id, r.alert_id) for r in C.assemble_incidents(rows, prior).collect()}
    assert got == {("i1", "a002"), ("i1", "a003")}
    apart = spark.createDataFrame([("a003", "i1")], "alert_id string, incident_id string")
    assert {(r.incident_id, r.alert_id) for r in C.assemble_incidents(rows, prior, apart).collect()} == {("i1", "a002")}


def test_status_changes_replay_in_order(spark):
    items = spark.createDataFrame([("a", "NEW"), ("b", "NEW")], "item_id string, status string")
    day = 86_400_000_000
    log = [
        ("a", "1", 1, "RESOLVED", "benign_expected", None, "not_allowed"),
        ("a", "2", 2, "TRIAGED", None, None, None),
        ("a", "3", 3, "TRIAGED", None, None, "already"),
        ("a", "4", day + 1, "RESOLVED", None, None, "disposition_required"),
        ("a", "5", day + 2, "RESOLVED", "benign_expected", None, None),
        ("a", "6", 3 * day, "TRIAGED", None, None, "reason_required"),
        ("a", "7", 3 * day + 1, "TRIAGED", None, "new facts", None),
        ("b", "8", 5, "FALSE_POSITIVE", None, None, "reason_required"),
        ("b", "9", 6, "IN_PROGRESS", "benign_expected", None, "disposition_unexpected"),
    ]
    changes = spark.createDataFrame([c[:6] for c in log], "item_id string, change_id string, at bigint, to_status string, disposition string, reason string")
    done = workflow.fold_transitions(items, changes)
    assert {r.change_id: r.code for r in done.collect()} == {c[1]: c[6] for c in log}
    assert {r.item_id: r.status for r in workflow.final_status(items, done).collect()} == {"a": "TRIAGED", "b": "NEW"}


def test_explanations(spark):
    rows = frame(spark, [event(i, i * 10, host=f"web-0{i % 2}", username=f"u{i}") for i in range(6)])
    found = run_rules(rows, [tuned("AUTH-003")]).first()
    assert found.explanation.startswith("203.0.113.45 (external) failed to log on as 6 different accounts (u0, u1, u2, u3, u4, …) within 50 s, on several (2).")
    assert found.evidence_ids == [f"e{i:06d}" for i in range(6)] and found.entities["host"] == ["web-00", "web-01"]


def test_an_item_with_most_changes_is_replayed_in_chunks(spark):
    pick, states = random.Random(11), list(workflow.INCIDENT_TRANSITIONS)
    log = [
        (f"i{0 if pick.random() < 0.8 else pick.randrange(1, 30)}", f"c{k:05}", 10**15 + pick.randrange(500), pick.choice(states[:5]),
         pick.choice([None, "benign"]), pick.choice([None, "", "done"]), pick.choice([None, "again"]))
        for k in range(3000)
    ]
    now, want = {f"i{k}": "OPEN" for k in range(30)}, {}
    for item, change, _, to, disposition, resolution, reason in sorted(log, key=lambda c: (c[0], c[2], c[1])):
        at = now[item]
        code = (
            "already" if to == at else "not_allowed" if to not in workflow.INCIDENT_TRANSITIONS[at]
            else "resolution_required" if to == "RESOLVED" and not (disposition and resolution)
            else "resolution_unexpected" if to != "RESOLVED" and (disposition or resolution)
            else "reason_required" if (at, to) == ("RESOLVED", "INVESTIGATING") and not reason else None
        )
        want[change] = (at, code)
        now[item] = to if code is None else at
    items = spark.createDataFrame([(i, "OPEN") for i in now], "item_id string, status string")
    kinds = "item_id string, change_id string, at bigint, to_status string, disposition string, resolution string, reason string"
    changes = spark.createDataFrame(log, kinds).repartition(7)
    for chunk in (1, 37, workflow.CHUNK):
        done = workflow.fold_incident_transitions(items, changes, chunk)
        assert {r.change_id: (r.from_status, r.code) for r in done.collect()} == want
    assert {r.item_id: r.status for r in workflow.final_status(items, done).collect()} == now


def cited(spark):
    events = frame(spark, [event(1), event(2, 5, host="web-02")])
    return events, spark.createDataFrame([("a", "e000001"), ("a", "e000002")], "alert_id string, event_id string")


def test_context_meets_events_once(spark):
    events, links = cited(spark)
    assets = spark.createDataFrame([("7", "web-02", ["10.0.0.9"], "high")], "id string, hostname string, ip_addresses array<string>, criticality string")
    people = spark.createDataFrame([("3", "root", "privileged")], "id string, username string, privilege_level string")
    got = A.alert_context(links, events, assets, people)
    assert "event_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.first()
    assert (r.asset_name, r.asset_level, r.actor, r.actor_privileged) == ("web-02", "high", "root", True)
    assert r.last_us - r.first_us == 5_000_000


def test_page_of_a_timeline_is_sorted_once(spark):
    events, links = cited(spark)
    first, last = (r[0] for r in events.selectExpr("unix_micros(timestamp) AS us").orderBy("us").collect())
    members = spark.createDataFrame([("i", "a")], "incident_id string, alert_id string")
    raised = spark.createDataFrame([("a", last + 1, "t", "R")], "id string, created_us bigint, title string, rule_id string")
    done = spark.createDataFrame([("i", 4, last + 2, "x"), ("i", 3, first - 1, "y")], "incident_id string, seq bigint, at bigint, text string")
    got = incidents.incident_timeline("i", members, links, events, raised, done, after=(first, "1event", "e000001"), limit=2)
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ref, r.rules) for r in got.collect()] == [("e000002", ["R"]), ("a", None)]
