"""From evidence rows to detections: counts, times, shared values, entities, sampled evidence
and text. One pass over the evidence of any number of rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.conditions import field
from emberwatch.functions.text import duration_text, stamp_text
from emberwatch.lineage import stored
from emberwatch.operators.detect import micros

# What an explanation shows and how much of it.
EVIDENCE_HEAD = EVIDENCE_TAIL = 50
MAX_ENTITY_VALUES = 10
SAMPLE_SIZE = 5
ENTITY_FIELDS = ["host", "username", "target_username", "source_ip", "destination_ip", "process_name"]
SHARED_FIELDS = [
    "host", "username", "target_username", "target_account", "source_ip", "source_ip_scope",
    "destination", "process_name", "command_line",
]


def field_values(evidence: DataFrame) -> DataFrame:
    """One row per (match, field, value): how often and when first seen."""
    names = list(dict.fromkeys([*ENTITY_FIELDS, *SHARED_FIELDS]))
    pairs = F.array(
        *[F.struct(F.lit(n).alias("field"), field(n, derived=True).cast("string").alias("text")) for n in names],
        F.struct(F.lit("_distinct").alias("field"), F.col("value").alias("text")),
    )
    return (
        evidence.select("match_id", "us", "id", F.explode(pairs).alias("p"))
        .filter("p.text is not null and p.text != ''")
        .groupBy("match_id", F.col("p.field").alias("field"), F.col("p.text").alias("text"))
        .agg(F.count("*").alias("n"), F.min(F.struct("us", "id")).alias("seen"))
    )


def entities(values: DataFrame) -> DataFrame:
    """The most frequent values per match and entity field, first seen first among equals."""
    w = Window.partitionBy("match_id", "field").orderBy(F.col("n").desc(), "seen")
    return (
        values.filter(F.col("field").isin(ENTITY_FIELDS))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= MAX_ENTITY_VALUES)
        .groupBy("match_id", "field")
        .agg(_in_order("rank", "text").alias("top"))
    )


def _in_order(order: str, value: str) -> Column:
    ranked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("r"), F.col(value).alias("v"))))
    return F.transform(ranked, lambda x: x["v"])


def cap_evidence(evidence: DataFrame) -> DataFrame:
    """The first and last events of each match, in order. Both limits are applied before rows are
    moved (rank limits), so a huge match never meets in one task."""
    rows = evidence.select("match_id", "us", "id")
    up = Window.partitionBy("match_id").orderBy("us", "id")
    down = Window.partitionBy("match_id").orderBy(F.col("us").desc(), F.col("id").desc())
    head = rows.withColumn("_r", F.row_number().over(up)).filter(F.col("_r") <= EVIDENCE_HEAD)
    tail = rows.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") <= EVIDENCE_TAIL)
    kept = F.array_sort(F.collect_set(F.struct("us", "id")))
    return (
        head.unionByName(tail)
        .groupBy("match_id")
        .agg(F.transform(kept, lambda e: e["id"]).alias("evidence_ids"))
    )


def summarize(evidence: DataFrame) -> DataFrame:
    """The numbers of each match."""
    last = F.struct("us", "id")
    return evidence.groupBy("rule_id", "match_id").agg(
        F.first("group_values").alias("group_values"),
        F.max("indicator").alias("indicator"),
        F.count("*").alias("event_count"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max_by("attributes", last).alias("last_attributes"),
        F.max(F.when(F.col("history_count").isNotNull(), F.col("value"))).alias("value"),
        F.max("history_count").alias("history_count"),
        F.max("step_no").alias("last_step"),
        *[F.count_if(F.col("step_no") == i).alias(f"step{i}_count") for i in range(5)],
        *[F.max(F.when(F.col("step_no") == i, F.col("us"))).alias(f"step{i}_us") for i in range(5)],
        F.array_sort(F.collect_set("batch_id")).alias("batch_ids"),
    )


def build_detections(evidence: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per match with everything an analyst or the alert step needs."""
    values = stored(field_values(evidence))  # counted once, read three times
    shared = values.filter(F.col("field") != "_distinct").groupBy("match_id", "field").agg(
        F.count("*").alias("n"), F.min("text").alias("only")
    )
    shared = shared.groupBy("match_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "field",
                    F.when(F.col("n") == 1, F.col("only")).otherwise(
                        F.concat(F.lit("several ("), F.col("n").cast("string"), F.lit(")"))
                    ),
                )
            )
        ).alias("_shared")
    )
    tops = entities(values).groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "top"))).alias("entities")
    )
    w = Window.partitionBy("match_id").orderBy("seen")
    counted = values.filter("field = '_distinct'")
    sample = (
        counted.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= SAMPLE_SIZE)
        .groupBy("match_id")
        .agg(F.array_join(_in_order("rank", "text"), ", ").alias("_sample"))
        .join(counted.groupBy("match_id").agg(F.count("*").alias("_values")), "match_id")
    )
    rows = (
        summarize(evidence)
        .join(cap_evidence(evidence), "match_id")
        .join(shared, "match_id", "left")
        .join(tops, "match_id", "left")
        .join(sample, "match_id", "left")
    )
    return _describe(rows, rules)


def _per_rule(rules: list[dict], value) -> Column:
    """A column that depends on the rule, as a chain over the rules of the run."""
    out = F.lit(None)
    for rule in rules:
        found = value(rule)
        if found is not None:
            out = F.when(F.col("rule_id") == rule["id"], found).otherwise(out)
    return out


def _per_indicator(rule: dict, name: str, default) -> Column:
    out = F.lit(default)
    for entry in rule.get("indicators") or []:
        if entry.get(name):
            out = F.when(F.col("indicator") == entry["id"], F.lit(entry[name])).otherwise(out)
    return out


def _describe(rows: DataFrame, rules: list[dict]) -> DataFrame:
    rule_value = lambda n: _per_rule(rules, lambda r: F.lit(r[n]) if r.get(n) else None)
    distinct = [r["id"] for r in rules if r["kind"] == "distinct"]
    is_distinct = F.col("rule_id").isin(distinct) if distinct else F.lit(False)
    gap = F.lit(None).cast("bigint")
    for i in range(1, 5):
        gap = F.when(F.col("last_step") == i, F.col(f"step{i}_us") - F.col(f"step{i - 1}_us")).otherwise(gap)
    rows = rows.withColumns(
        {
            "rule_name": rule_value("name").cast("string"),
            "kind": rule_value("kind").cast("string"),
            "category": rule_value("category").cast("string"),
            "threshold": rule_value("threshold").cast("int"),
            "severity": _per_rule(rules, lambda r: _per_indicator(r, "severity", r["severity"])),
            "confidence": _per_rule(rules, lambda r: _per_indicator(r, "confidence", r["confidence"])),
            "indicator_name": _per_rule(rules, lambda r: _per_indicator(r, "name", None)).cast("string"),
            "group_names": _per_rule(rules, lambda r: F.array(*[F.lit(g) for g in r["group_by"]])),
            "window_us": _per_rule(rules, lambda r: F.lit(micros(r.get("time_window")))).cast("bigint"),
            "lookback_us": _per_rule(rules, lambda r: F.lit(micros(r.get("lookback")))).cast("bigint"),
            "gap_us": gap,
            "distinct_count": F.when(is_distinct, F.col("_values")),
            "values_sample": F.when(
                is_distinct,
                F.concat("_sample", F.when(F.col("_values") > SAMPLE_SIZE, F.lit(", …")).otherwise("")),
            ),
        }
    )
    rows = rows.withColumn("facts", _facts(rows, rules))
    text = lambda n: _per_rule(rules, lambda r: render_text(r[n], F.col("facts"), r))
    steps = _per_rule(
        rules, lambda r: F.array(*[render_text(t, F.col("facts"), r) for t in r.get("response", [])])
    )
    return rows.withColumns({"explanation": text("explanation"), "response": steps}).drop(
        "_shared", "_sample", "_values", "last_step", *[f"step{i}_us" for i in range(5)]
    )


def _facts(rows: DataFrame, rules: list[dict]) -> Column:
    group = F.map_from_arrays("group_names", "group_values")
    shared = {
        name: F.coalesce(
            F.try_element_at(group, F.lit(name)),
            F.try_element_at(F.col("_shared"), F.lit(name)),
            F.lit("unknown"),
        )
        for name in SHARED_FIELDS
    }
    plain = {
        "rule_id": F.col("rule_id"),
        "rule_name": F.col("rule_name"),
        "count": F.col("event_count").cast("string"),
        "first_seen": stamp_text(F.col("first_us")),
        "last_seen": stamp_text(F.col("last_us")),
        "span": duration_text(F.col("last_us") - F.col("first_us")),
        **shared,
        "threshold": F.col("threshold").cast("string"),
        "time_window": duration_text(F.col("window_us")),
        "lookback": duration_text(F.col("lookback_us")),
        "gap": duration_text(F.col("gap_us")),
        "distinct_count": F.col("distinct_count").cast("string"),
        "values_sample": F.col("values_sample"),
        "value": F.col("value"),
        "history_count": F.col("history_count").cast("string"),
        "indicator": F.col("indicator"),
        "indicator_name": F.col("indicator_name"),
    }
    for rule in rules:
        for i, step in enumerate(rule.get("steps") or []):
            name, count = f"{step['name']}_count", F.col(f"step{i}_count").cast("string")
            own = F.when(F.col("rule_id") == rule["id"], count)
            plain[name] = F.coalesce(plain[name], own) if name in plain else own
    entries = [F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in plain.items()]
    attributes = F.transform(
        F.map_entries(F.coalesce("last_attributes", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.concat(F.lit("attr_"), e["key"]).alias("k"), e["value"].alias("v")),
    )
    taken = list(plain)
    attributes = F.filter(attributes, lambda e: ~e["k"].isin(taken))
    return F.map_from_entries(F.filter(F.concat(F.array(*entries), attributes), lambda e: e["v"].isNotNull()))


_PLACEHOLDER = re.compile(r"\$(?:(\$)|([A-Za-z_][A-Za-z0-9_]*)|\{([A-Za-z_][A-Za-z0-9_]*)\})")


def render_text(template: str, facts: Column, rule: dict | None = None) -> Column:
    """`$name` and `${name}` replaced from the facts; unknown names stay as written."""
    parts, at = [], 0
    for hit in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[at : hit.start()]))
        name = hit[2] or hit[3]
        parts.append(
            F.lit("$") if hit[1] else F.coalesce(F.try_element_at(facts, F.lit(name)), F.lit(hit[0]))
        )
        at = hit.end()
    return F.concat(*parts, F.lit(template[at:]))
