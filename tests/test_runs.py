"""Runs of several rules: one broken rule does not stop the others."""

from datetime import timedelta

import pytest
from frames import T0
from pyspark.sql import functions as F
from test_detect import FAIL, random_rows, to_frame
from test_detect import GOOD as SUCCESS

from emberwatch.operators import detect
from emberwatch.plans import run

GOOD_RULE = dict(id="OK", kind="threshold", match=FAIL, group_by=["username"], threshold=3, time_window="100s")
SINGLE = dict(id="ONE", kind="single", match=FAIL, group_by=["username"])
UNKNOWN = dict(GOOD_RULE, id="UNKNOWN", match={"field": "nothing", "op": "eq", "value": 1})
OFF = dict(GOOD_RULE, id="OFF", enabled=False)


def failing(rows, rule, *span):
    found = detect.evaluate(rows, rule, *span)
    return found.withColumn("value", F.raise_error(F.lit("x")).cast("string")) if rule["id"] == "FAILS" else found


def test_broken_rules_stay_apart(spark):
    df = to_frame(spark, random_rows(31, n=200))
    rules = [UNKNOWN, GOOD_RULE, dict(SINGLE, id="FAILS"), SINGLE, OFF]
    evidence, results = run.run_isolated(df, rules, evaluator=failing)
    failures = df.filter("event_outcome = 'failure'").count()
    bursts = detect.evaluate(df, GOOD_RULE).select("match_id").distinct().count()
    assert bursts and sorted(map(tuple, results.collect()), key=str) == sorted(
        [("UNKNOWN", 0, 0, "evaluation_error"), ("OK", failures, bursts, None), ("FAILS", 0, 0, "evaluation_error"), ("ONE", failures, failures, None)], key=str
    )
    assert {r[0] for r in evidence.select("rule_id").distinct().collect()} == {"OK", "ONE"}


def test_without_broken_rules_the_evidence_is_that_of_a_run(spark):
    df = to_frame(spark, random_rows(32, n=200))
    evidence, _ = run.run_isolated(df, [GOOD_RULE, SINGLE])
    rows = lambda d: sorted(d.select("match_id", "id").collect())
    assert rows(evidence) == rows(run.evidence_of(df, [GOOD_RULE, SINGLE]))


SEQUENCE = dict(id="SEQ", kind="sequence", group_by=["username"], threshold=2, time_window="900s",
                steps=[dict(name="a", match=FAIL), dict(name="b", match=SUCCESS)])
NEW = dict(id="NEW", kind="new_value", match=SUCCESS, group_by=["username"], value_field="source_ip", lookback="3000s", min_history=2)
SPARED = dict(GOOD_RULE, id="SPARED", exclusions=[{"field": "username", "value": "u1"}])
NOTHING = dict(SINGLE, id="NOTHING", match={"field": "message", "op": "eq", "value": "never"})
EVERY = [GOOD_RULE, SINGLE, SEQUENCE, NEW, SPARED, NOTHING, OFF]


@pytest.mark.parametrize("bounded", [False, True])
def test_one_scan_gives_the_evidence_of_each_rule(spark, bounded):
    df = to_frame(spark, random_rows(35, n=400))
    span = (T0 + timedelta(seconds=6000), T0 + timedelta(seconds=14000)) if bounded else ()
    rows = lambda d: sorted(d.select("rule_id", "match_id", "id", "value", "history_count", "step_no").collect(), key=str)
    want = rows(run.evidence_of(df, EVERY, *span))
    found = run.evidence_at_once(df, EVERY, *span)
    assert {r["rule_id"] for r in want} == {"OK", "ONE", "SEQ", "NEW", "SPARED"} and rows(found) == want


def test_one_scan_with_a_rule_on_history(spark):
    df = to_frame(spark, random_rows(36, n=400))
    start, end = T0 + timedelta(seconds=6000), T0 + timedelta(seconds=14000)
    sums = detect.compact_history(df.filter(F.col("timestamp") < F.lit(start)), NEW)
    rows = lambda d: sorted(d.select("rule_id", "match_id", "id", "value", "history_count").collect(), key=str)
    assert rows(run.evidence_at_once(df, EVERY, start, end, {"NEW": sums})) == rows(run.evidence_of(df, EVERY, start, end))


def test_candidates_keep_only_columns_in_use(spark):
    df = to_frame(spark, random_rows(37, n=50))
    rows = run.candidate_rows(df, [GOOD_RULE, SEQUENCE])
    assert "message" not in rows.columns and {"username", "event_outcome", "timestamp", "rule_part"} <= set(rows.columns)
    assert "message" in run.candidate_rows(df, [NOTHING, SINGLE]).columns
    assert run.evidence_at_once(df.limit(0), EVERY).collect() == []


def test_a_range_counts_what_it_reads(spark):
    df = to_frame(spark, random_rows(33, n=200))
    start, end = T0 + timedelta(seconds=5000), T0 + timedelta(seconds=9000)
    _, results = run.run_isolated(df, [SINGLE], start, end)
    inside = df.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") <= F.lit(end)) & (F.col("event_outcome") == "failure"))
    assert results.first()["candidates"] == inside.count() > 0


def test_only_broken_rules_and_no_rules(spark):
    df = to_frame(spark, random_rows(34, n=20))
    evidence, results = run.run_isolated(df, [UNKNOWN])
    assert evidence.collect() == [] and results.first()["error"] == "evaluation_error"
    assert run.run_isolated(df, [])[1].collect() == []
