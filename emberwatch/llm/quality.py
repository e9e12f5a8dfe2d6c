"""Quality rules as a short-circuit cascade, DataFrame functions only.

Every rule is a test on features of one document. How often each set of rules rejects, and how
much work a rule has per document, is measured on a sample; the rules are then ordered by what
they reject, of the documents still there, per unit of work. A document meets the rules in that
order up to the first that rejects it. A document is kept if no rule rejects it, so the sample
decides about cost alone, never about a verdict.

Null text counts as no words. Other columns may be null or have any name: they are not read.
Repeated rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SAMPLE_ROWS = 5000
BLANK = r"[ \\t\\n\\x0B\\f\\r]"


@dataclass(frozen=True)
class Rule:
    """`rejects` is SQL over the features; `work` is what it costs, SQL over them as well."""

    name: str
    rejects: str
    work: str


#: Work is counted in characters passed over by a scan; a step over an array costs as much as 20.
RULES = [
    Rule("symbols", "n_symbols > 0.05 * word_chars", "1"),
    Rule("repeated lines", "10 * n_dup_lines > 3 * size(lines)", "1"),
    Rule("word length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "1"),
    Rule("few different words", "20 * size(array_distinct(words)) < n_words", "20 * n_words"),
    Rule(
        "stuttering",
        "10 * size(filter(words, (w, i) -> i > 0 AND w = get(words, i - 1))) > 3 * n_words",
        "40 * n_words",
    ),
    Rule("few letters", r"2 * regexp_count(text, '\\p{L}') < word_chars", "word_chars"),
]

_TRIMMED = "btrim(text, ' \\t\\n\\u000b\\u000c\\r')"  # SQL strings know no \f
_WORDS = f"CASE WHEN {_TRIMMED} = '' THEN cast(array() AS array<string>) ELSE split({_TRIMMED}, '{BLANK}+') END"
_LINES = r"filter(split(text, '\n'), x -> x RLIKE '[^ \\t\\n\\x0B\\f\\r]')"
_HASHES = f"""CASE WHEN n_words < {WINDOW} THEN cast(array() AS array<bigint>)
    ELSE transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({
        ", ".join(f"get(words, i + {k})" for k in range(WINDOW))})) END"""


def let(values: list[tuple[str, str]], body: str) -> str:
    """SQL that computes each value once, by name, before the next and before the body. Columns
    would do until a filter above them is pushed down and copies them into every place of use."""
    for name, value in reversed(values):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body


#: Windows sorted by hash and place; the places of those next to an equal one; the words they cover.
_REPEATED = "CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE " + let(
    [
        ("sorted", "sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i)))"),
        (
            "found",
            """filter(sorted, (x, k) -> (k > 0 AND get(sorted, k - 1).h = x.h)
                OR (k + 1 < size(sorted) AND get(sorted, k + 1).h = x.h))""",
        ),
    ],
    f"""aggregate(sort_array(transform(found, x -> x.i)), struct(0L AS n, 0 AS past),
        (a, i) -> struct(a.n + i + {WINDOW} - greatest(a.past, i) AS n, i + {WINDOW} AS past), a -> a.n)""",
) + " END"

FEATURES = [
    ("text", "coalesce(text, '')"),
    ("words", _WORDS),
    ("n_words", "size(words)"),
    ("lines", _LINES),
    ("word_chars", "cast(length(array_join(words, '')) AS long)"),
    ("n_symbols", "cast(regexp_count(text, '[#*$%&|<>]') AS long)"),
    ("n_dup_lines", "cast(size(lines) - size(array_distinct(lines)) AS long)"),
    ("hashes", _HASHES),
    ("n_repeat_words", _REPEATED),
    ("base_failed", "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"),
]


def plan_rules(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[dict]:
    """The order of the rules with what was measured: work per document, and documents rejected
    of those that no earlier rule rejects. The sample is about `rows` documents chosen by a hash
    of their text; of it, one row per set of rules comes to the driver."""
    keep = min(1_000_000, 1_000_000 * rows // max(docs.count(), 1) + 1)
    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < keep)
    bits = " + ".join(f"{2**k} * cast(({r.rejects}) AS int)" for k, r in enumerate(rules))
    work = ", ".join(f"cast({r.work} AS double) AS w{k}" for k, r in enumerate(rules))
    body = f"struct(base_failed, CASE WHEN base_failed THEN 0 ELSE {bits} END AS bits, {work})"
    measured = part.select(F.expr(let(FEATURES, body)).alias("f")).groupBy("f.base_failed", "f.bits")
    sums = [F.sum(f"f.w{k}").alias(f"w{k}") for k in range(len(rules))]
    sets = [s for s in measured.agg(F.count("*").alias("n"), *sums).collect() if not s["base_failed"]]
    seen = max(1, sum(s["n"] for s in sets))
    left, order = list(range(len(rules))), []
    while left:
        gain = {k: sum(s["n"] for s in sets if s["bits"] >> k & 1) for k in left}
        cost = {k: max(sum(s[f"w{k}"] for s in sets), 1.0) / seen for k in left}
        best = max(left, key=lambda k: (gain[k] / cost[k], -cost[k], -k))
        order.append({"rule": rules[best], "rejected": gain[best], "work": cost[best]})
        sets = [s for s in sets if not s["bits"] >> best & 1]
        left.remove(best)
    return order


def verdict(order: list[dict]) -> str:
    """SQL of the first rule in this order that rejects, or null: CASE evaluates none beyond it."""
    cases = "".join(f" WHEN {s['rule'].rejects} THEN '{s['rule'].name}'" for s in order)
    return f"CASE WHEN base_failed THEN 'base'{cases} END"


def judge(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: counts, base_failed, rejected_by (null if kept) and kept."""
    body = f"""struct(cast(n_words AS long) AS n_words, word_chars, n_symbols, n_dup_lines,
        n_repeat_words, base_failed, {verdict(plan_rules(docs, rules, rows))} AS rejected_by)"""
    judged = docs.select("doc_id", F.expr(let(FEATURES, body)).alias("f")).select("doc_id", "f.*")
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rejected = F.expr(let(FEATURES, verdict(plan_rules(docs, rules, rows))))
    whole = docs.select(F.struct("*").alias("_row"), "text")
    return whole.where(rejected.isNull()).select("_row.*")
