"""A detection run: every enabled rule over the events of a time range."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.conditions import compile_condition, excluded, holds
from emberwatch.lineage import cut, stored
from emberwatch.operators.detect import evaluate, micros
from emberwatch.operators.explain import build_detections

EVIDENCE_COLUMNS = [
    "rule_id", "match_id", "group_values", "value", "history_count", "indicator", "step_no", "us", "id",
    "batch_id", "attributes", "host", "username", "target_username", "source_ip", "source_ip_scope",
    "destination_ip", "destination_port", "process_name", "command_line",
]


def reach(rule: dict) -> int:
    """How far around new events a rule must look, in microseconds."""
    return max(micros(rule.get("time_window")) or 0, micros(rule.get("max_gap")) or 0)


def to_micros(moment: datetime) -> int:
    return micros(moment - datetime.fromtimestamp(0, moment.tzinfo))


def _low(rule: dict, start: datetime | None) -> list[int]:
    """From when a run over [start, ...] reads events for a rule, if it is bounded."""
    return [] if start is None else [to_micros(start) - reach(rule) - (micros(rule.get("lookback")) or 0)]


def _high(rule: dict, end: datetime | None) -> list[int]:
    return [] if end is None else [to_micros(end) + reach(rule)]


def window_for(events: DataFrame, rule: dict, start: datetime | None, end: datetime | None) -> DataFrame:
    """The events a run over [start, end] reads for a rule: widened by the rule's reach, and by
    its lookback before the start for history."""
    for low in _low(rule, start):
        events = events.filter(F.col("timestamp") >= F.timestamp_micros(F.lit(low)))
    for high in _high(rule, end):
        events = events.filter(F.col("timestamp") <= F.timestamp_micros(F.lit(high)))
    return events


def evidence_of(
    events: DataFrame,
    rules: list[dict],
    start: datetime | None = None,
    end: datetime | None = None,
    history: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Evidence of all enabled rules, one plan per rule over the shared scan. `history`: by rule id, the
    sums (compact_history) of the events before `start`, for rules of new values."""
    low = None if start is None else to_micros(start)
    high = None if end is None else to_micros(end)
    kept = history or {}

    def found(rule: dict) -> DataFrame:
        if rule["id"] in kept:  # narrows the events itself, to whole slices
            return evaluate(events, rule, low, high, kept[rule["id"]])
        return evaluate(window_for(events, rule, start, end), rule, low, high)

    parts = [found(rule).select(*EVIDENCE_COLUMNS) for rule in rules if rule.get("enabled", True)]
    return reduce(DataFrame.unionByName, parts)


def _mentioned(part) -> set[str]:
    """All texts of a rule; the names of the fields that it uses are among them."""
    if isinstance(part, dict):
        part = [*part.keys(), *part.values()]
    if isinstance(part, list | tuple | set):
        return set().union(*map(_mentioned, part))
    return {part} if isinstance(part, str) else set()


def candidate_rows(events: DataFrame, rules: list[dict], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One scan for all rules: a row per event and rule that it is a candidate of, `rule_part` names the rule,
    with the columns that evidence and these rules use."""
    used = {"timestamp", *EVIDENCE_COLUMNS}.union(*map(_mentioned, rules))
    tests = {}
    for rule in rules:
        inside = [F.col("timestamp") >= F.timestamp_micros(F.lit(low)) for low in _low(rule, start)]
        inside += [F.col("timestamp") <= F.timestamp_micros(F.lit(high)) for high in _high(rule, end)]
        tests[rule["id"]] = reduce(lambda a, b: a & b, [candidates(events, rule), *inside])
    hit = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    rows = events.filter(reduce(lambda a, b: a | b, tests.values()))
    return rows.select(*[c for c in events.columns if c in used], F.explode(hit).alias("rule_part"))


def evidence_at_once(
    events: DataFrame,
    rules: list[dict],
    start: datetime | None = None,
    end: datetime | None = None,
    history: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """As evidence_of, for runs of several rules: the events are read once, their candidates are written in a
    folder per rule, and each rule reads its own. A rule with stored history reads events itself."""
    kept, enabled = history or {}, [r for r in rules if r.get("enabled", True)]
    shared = [r for r in enabled if r["id"] not in kept]
    if len(shared) < 2:
        return evidence_of(events, rules, start, end, history)
    rows = stored(candidate_rows(events, shared, start, end), "rule_part")
    parts = [evidence_of(rows.filter(F.col("rule_part") == r["id"]).drop("rule_part"), [r], start, end) for r in shared]
    parts += [evidence_of(events, [r], start, end, kept) for r in enabled if r["id"] in kept]
    return reduce(DataFrame.unionByName, parts)


def run_rules(
    events: DataFrame,
    rules: list[dict],
    start: datetime | None = None,
    end: datetime | None = None,
    batch_id: str | None = None,
    history: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Detections of all enabled rules. A batch run keeps those that touch the batch."""
    # The evidence is read by several aggregations, and each rule's plan is deep: keep it once.
    found = build_detections(cut(evidence_at_once(events, rules, start, end, history)), rules)
    return found if batch_id is None else found.filter(F.array_contains("batch_ids", batch_id))


def run_with_evidence(
    events: DataFrame,
    rules: list[dict],
    start: datetime | None = None,
    end: datetime | None = None,
    history: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Detections, and all their evidence (match_id, us, id) as a table beside them."""
    evidence = cut(evidence_at_once(events, rules, start, end, history))
    return build_detections(evidence, rules), evidence.select("match_id", "us", "id")


def candidates(events: DataFrame, rule: dict):
    """The condition that makes an event a candidate of a rule."""
    if rule["kind"] == "sequence":
        tests = [compile_condition(step.get("match")) for step in rule["steps"]]
        return reduce(lambda a, b: a | b, tests)
    return compile_condition(rule["match"])


EVALUATION_ERROR = "evaluation_error"
RESULT = "rule_id string, candidates bigint, detections bigint, error string"


def _apart(parts: dict, together: Callable, alone: Callable) -> dict:
    """What `together` makes of all parts at once; if that fails, what `alone` makes of each, without those that
    fail. So a run costs one action, and only one with a broken rule pays for taking the rules one by one."""
    try:
        return together(parts) if parts else {}
    except Exception:  # some rule fails at run time: which one shows below
        made = {}
        for name, part in parts.items():
            try:
                made[name] = alone(part)
            except Exception:
                continue
        return made


def run_isolated(
    events: DataFrame,
    rules: list[dict],
    start: datetime | None = None,
    end: datetime | None = None,
    evaluator: Callable[..., DataFrame] = evaluate,
) -> tuple[DataFrame, DataFrame]:
    """Evidence of all enabled rules as a table, and per rule its candidates, its detections and its error.
    A rule that cannot be planned or fails at run time gives no evidence and does not stop the
    others."""
    low = None if start is None else to_micros(start)
    high = None if end is None else to_micros(end)
    plans, tests, enabled = {}, {}, [r for r in rules if r.get("enabled", True)]
    for rule in enabled:
        try:
            part = window_for(events, rule, start, end)
            found = evaluator(part, rule, low, high).select(*EVIDENCE_COLUMNS)
            counted = part.filter(candidates(events, rule)).agg(F.count("*").alias("n"))
            plans[rule["id"]], tests[rule["id"]] = found, counted
        except Exception:  # a rule that cannot be planned
            continue
    whole = lambda parts: {"": stored(reduce(DataFrame.unionByName, parts.values()))}
    made = _apart(plans, whole, stored)
    evidence = reduce(DataFrame.unionByName, made.values()) if made else None
    named = lambda n, df: df.select(F.lit(n).alias("rule_id"), "n")
    good = {n: named(n, t) for n, t in tests.items() if "" in made or n in made}
    rows = lambda df: {r["rule_id"]: r["n"] for r in df.collect()}
    # One row per rule each.
    count = _apart(good, lambda parts: rows(reduce(DataFrame.unionByName, parts.values())), lambda df: df.first()["n"])
    matches = rows(evidence.groupBy("rule_id").agg(F.count_distinct("match_id").alias("n"))) if made else {}
    results = [
        (r["id"], count.get(r["id"], 0), matches.get(r["id"], 0) if r["id"] in count else 0, None if r["id"] in count else EVALUATION_ERROR)
        for r in enabled
    ]
    if evidence is None:
        kinds = {"value": "string", "history_count": "bigint", "step_no": "int", "us": "bigint", "destination_port": "int",
                 "group_values": "array<string>", "attributes": "map<string,string>"}
        evidence = events.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in EVIDENCE_COLUMNS))
    return evidence, events.sparkSession.createDataFrame(results, RESULT)


def rule_stats(detections: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Per rule: matches, last match, and failed runs (rows of `results` with an error)."""
    stats = detections.groupBy("rule_id").agg(
        F.count("*").alias("match_count"), F.max("last_us").alias("last_match_us")
    )
    if results is None:
        return stats
    errors = results.groupBy("rule_id").agg(F.count_if(F.col("error").isNotNull()).alias("error_count"))
    return stats.join(errors, "rule_id", "full").na.fill(0, ["match_count", "error_count"])


def run_history(runs: DataFrame, trigger: str | None = None, limit: int = 50) -> DataFrame:
    """Runs, newest first."""
    if trigger is not None:
        runs = runs.filter(F.col("trigger") == trigger)
    return runs.orderBy(F.col("started_at").desc(), "id").limit(limit)


def backtest(events: DataFrame, rule: dict, **changes) -> tuple[DataFrame, DataFrame]:
    """A what-if run with other numbers: its detections, and per event why it did or did not
    count (`excluded`, `matched`, and the steps it matches)."""
    tried = {**rule, **changes}
    matched = F.lit(False) if tried["kind"] == "sequence" else holds(tried["match"])
    steps = F.array_compact(
        F.array(*[F.when(holds(s.get("match")), F.lit(s["name"])) for s in tried.get("steps", [])])
    ) if tried.get("steps") else F.array().cast("array<string>")
    reasons = events.select(
        "id",
        excluded(tried.get("exclusions") or []).alias("excluded"),
        matched.alias("matched"),
        steps.alias("steps"),
    )
    return run_rules(events, [tried]), reasons

