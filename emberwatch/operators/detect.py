"""The five kinds of detection. Each takes the event frame and a rule dict and returns its
evidence: the events of every match with `match_id` and the facts of the match.

Times are microseconds (`us`); group values are text columns `_k0`, `_k1`, ...
"""

from __future__ import annotations

from bisect import bisect_left
from datetime import timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.conditions import (
    apply_exclusions,
    compile_condition,
    field,
    holds,
    require_group,
)
from emberwatch.functions.net import to_network
from emberwatch.lineage import stored
from emberwatch.operators import slices as S

FACTS = {"value": "string", "history_count": "bigint", "indicator": "string", "step_no": "int"}


def micros(span: timedelta | str | None) -> int | None:
    """Microseconds of a timedelta or of `60s`, `5m`, `24h`, `14d`."""
    if span is None:
        return None
    if isinstance(span, str):
        unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[span[-1]]
        span = timedelta(**{unit: int(span[:-1])})
    return span // timedelta(microseconds=1)


def group_keys(rule: dict) -> list[str]:
    return [f"_k{i}" for i in range(len(rule["group_by"]))]


def prepared(events: DataFrame, rule: dict) -> DataFrame:
    """Exclusions, then the grouping columns and the time in microseconds."""
    rows = require_group(apply_exclusions(events, rule.get("exclusions") or []), rule["group_by"])
    keys = {
        k: field(name, derived=True).cast("string")
        for k, name in zip(group_keys(rule), rule["group_by"])
    }
    return rows.withColumns({"us": F.unix_micros("timestamp"), **keys})


def _match_id(rule: dict, keys: list[str], *parts: Column | str) -> Column:
    return F.concat_ws("|", F.lit(rule["id"]), *keys, *parts)


def _evidence(rows: DataFrame, rule: dict, **facts: Column) -> DataFrame:
    keys = group_keys(rule)
    found = {
        name: facts.get(name, F.lit(None)).cast(kind) for name, kind in FACTS.items()
    }
    return rows.withColumns(
        {
            "rule_id": F.lit(rule["id"]),
            "group_values": F.array(*keys) if keys else F.array().cast("array<string>"),
            **found,
        }
    ).drop(*keys)


def matching(events: DataFrame, rule: dict) -> DataFrame:
    return prepared(events.filter(compile_condition(rule["match"])), rule)


# ---------- single ----------


def detect_single(events: DataFrame, rule: dict) -> DataFrame:
    """Every matching event, named by the first indicator (in order) that holds for it."""
    rows = matching(events, rule)
    indicator = F.lit(None).cast("string")
    if rule.get("indicators"):
        for entry in reversed(rule["indicators"]):
            indicator = F.when(holds(entry["match"]), F.lit(entry["id"])).otherwise(indicator)
        rows = rows.withColumn("_indicator", indicator).filter("_indicator is not null")
        indicator = F.col("_indicator")
    keys = group_keys(rule)
    rows = rows.withColumn("match_id", _match_id(rule, keys, indicator, "id"))
    return _evidence(rows, rule, indicator=indicator).drop("_indicator")


# ---------- threshold and distinct ----------


def threshold_spans(rows: DataFrame, keys: list[str], needed: int, window: int) -> DataFrame:
    """Bursts of at least `needed` rows within `window`; rows: keys, us, id."""
    w = S.by_slice(keys, "us", "id")
    placed = S.spread(S.look_back(rows, S.width_for(window), window), keys)
    nth = F.lag("us", needed - 1).over(w) if needed > 1 else F.col("us")
    flagged = placed.withColumns({"_prev": F.lag("us").over(w), "_nth": nth}).filter("_own")
    return _burst_spans(flagged, keys, window, F.col("us") - F.col("_nth") <= window)


def distinct_spans(rows: DataFrame, keys: list[str], needed: int, window: int) -> DataFrame:
    """Bursts with at least `needed` different values within `window`; rows: keys, us, id, v.

    A value enters the window at its first row and leaves `window` after its last one (within
    that slice); the running sum of entries and exits is the number of values inside."""
    w = S.by_slice(keys, "us", "id")
    same = Window.partitionBy(*keys, "_s", "v").orderBy("us", "id")
    placed = S.spread(S.look_back(rows, S.width_for(window), window), keys).withColumns(
        {"_before": F.lag("us").over(same), "_after": F.lead("us").over(same)}
    ).withColumn("_prev", F.lag("us").over(w))
    enters = F.col("_before").isNull() | (F.col("us") - F.col("_before") > window)
    leaves = F.col("_after").isNull() | (F.col("_after") - F.col("us") > window)
    moves = F.array_compact(
        F.array(
            F.struct(
                F.col("us").alias("at"), F.lit(0).alias("late"), enters.cast("int").alias("step")
            ),
            F.when(
                leaves,
                F.struct(
                    (F.col("us") + window).alias("at"), F.lit(1).alias("late"), F.lit(-1).alias("step")
                ),
            ),
        )
    )
    swept = placed.withColumn("_m", F.explode(moves)).withColumns(
        {"at": F.col("_m.at"), "late": F.col("_m.late"), "step": F.col("_m.step")}
    )
    inside = F.sum("step").over(
        S.by_slice(keys, "at", "late", "id").rowsBetween(Window.unboundedPreceding, 0)
    )
    flagged = swept.withColumn("_inside", inside).filter("_own and late = 0")
    return _burst_spans(flagged, keys, window, F.col("_inside") >= needed)


def _burst_spans(flagged: DataFrame, keys: list[str], window: int, hit: Column) -> DataFrame:
    start = F.col("_prev").isNull() | (F.col("us") - F.col("_prev") > window)
    rows = flagged.select(
        *keys, "_s", "us", "id", start.alias("_start"), F.coalesce(hit, F.lit(False)).alias("_hit")
    )
    return S.sessions(rows, keys).withColumn("lo", F.col("t0") - window)


def _burst_evidence(rows: DataFrame, spans: DataFrame, rule: dict, window: int) -> DataFrame:
    keys = group_keys(rule)
    spans = spans.withColumn("match_id", _match_id(rule, keys, F.col("t0").cast("string")))
    found = S.rows_in_spans(rows, spans, keys, S.width_for(window)).drop("lo", "hi", "t0")
    return _evidence(found, rule)


def detect_threshold(events: DataFrame, rule: dict) -> DataFrame:
    rows, keys, window = matching(events, rule), group_keys(rule), micros(rule["time_window"])
    spans = threshold_spans(rows.select(*keys, "us", "id"), keys, rule["threshold"], window)
    return _burst_evidence(rows, spans, rule, window)


def detect_distinct(events: DataFrame, rule: dict) -> DataFrame:
    v = field(rule["distinct_field"], derived=True).cast("string")
    rows = matching(events, rule).withColumn("v", v).filter("v is not null and v != ''")
    keys, window = group_keys(rule), micros(rule["time_window"])
    spans = distinct_spans(rows.select(*keys, "us", "id", "v"), keys, rule["threshold"], window)
    return _burst_evidence(rows, spans, rule, window).withColumn("value", F.col("v")).drop("v")


# ---------- new_value ----------


def _value(rule: dict) -> Column:
    c = field(rule["value_field"], derived=True)
    c = F.when(c.cast("string") != "", c.cast("string"))
    return to_network(c) if rule.get("value_transform") == "ip_network" else c


def compact_history(events: DataFrame, rule: dict) -> DataFrame:
    """Observations summed to one row per (key, value, slice): count, first event, last time.
    This is the form in which history is kept between runs; `merge_history` adds two of them."""
    keys, lookback = group_keys(rule), micros(rule["lookback"])
    rows = matching(events, rule).withColumn("v", _value(rule)).filter("v is not null")
    return _compacted(rows, keys, _history_width(lookback))


def _history_width(lookback: int) -> int:
    return max(lookback // 64, 1)


def _compacted(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    return (
        S.own_slice(rows.select(*keys, "us", "id", "v"), width)
        .groupBy(*keys, "v", "_s")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("us", "id")).alias("first"),
            F.max("us").alias("last_us"),
        )
    )


def merge_history(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return (
        left.unionByName(right)
        .groupBy(*keys, "v", "_s")
        .agg(
            F.sum("n").alias("n"),
            F.min("first").alias("first"),
            F.max("last_us").alias("last_us"),
        )
    )


def history_ranges(rule: dict, start: int, end: int) -> list[tuple[int, int]]:
    """The half-open spans of time, in whole slices, of which a run over [start, end] needs the events themselves
    when the history before `start` is stored: the run's own, and as long a one at the old edge of its lookback."""
    lookback = micros(rule["lookback"])
    width = _history_width(lookback)
    old = ((start - lookback) // width * width, ((end - lookback) // width + 1) * width)
    new = (start // width * width, end + 1)
    return [old, new] if old[1] < new[0] else [(old[0], new[1])]


def new_values(
    rows: DataFrame,
    keys: list[str],
    lookback: int,
    min_history: int,
    start: int | None = None,
    end: int | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """First time per (keys, v) that v was unseen for `lookback` while the key had at least
    `min_history` earlier rows in it; rows: keys, us, id, v. `start`/`end` bound what is
    reported; earlier rows still count as history.

    Only the first row of a (key, value, slice) can be unseen, so the raw rows are summed once;
    they are read again only in the slices at both ends of a candidate's lookback. With `history`, the sums of all
    that came before `start`, rows are needed in history_ranges() only."""
    width = _history_width(lookback)
    if history is None:
        compact = _compacted(rows, keys, width)
    else:
        now = _compacted(rows.filter(F.col("us").between(start, end)), keys, width)
        compact = merge_history(history.filter(F.col("_s") >= (start - lookback) // width), now, keys)
    seen = Window.partitionBy(*keys, "v").orderBy("_s")
    gap = F.col("first.us") - F.lag("last_us").over(seen)
    fresh = (
        compact.withColumn("_gap", gap)
        .filter(F.col("_gap").isNull() | (F.col("_gap") > lookback))
        .select(*keys, "v", F.col("first.us").alias("us"), F.col("first.id").alias("id"))
    )
    if start is not None:
        fresh = fresh.filter(F.col("us") >= start)
    if end is not None:
        fresh = fresh.filter(F.col("us") <= end)
    marks = fresh.select(
        *keys,
        "v",
        "id",
        F.col("us").alias("t"),
        F.explode(
            F.array(
                F.struct((F.col("us") - lookback).alias("at"), F.lit(-1).alias("sign")),
                F.struct(F.col("us").alias("at"), F.lit(1).alias("sign")),
            )
        ).alias("m"),
    ).select(*keys, "v", "id", "t", F.col("m.at").alias("us"), F.col("m.sign").alias("sign"))
    marks = S.own_slice(marks, width)
    edges = marks.select(*keys, "_s").distinct()
    nearby = (
        S.own_slice(rows.select(*keys, "us"), width)
        .join(edges, [*keys, "_s"], "left_semi")
        .groupBy(*keys, "_s", "us")
        .agg(F.count("*").alias("n"))
    )
    # At equal times a mark comes before the rows: it counts what is strictly earlier.
    merged = marks.withColumn("n", F.lit(0).cast("bigint")).unionByName(nearby, True)
    local = F.sum("n").over(
        Window.partitionBy(*keys, "_s")
        .orderBy("us", F.col("sign").isNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    per_slice = compact.groupBy(*keys, "_s").agg(F.sum("n").alias("n"))
    # The count before a mark also needs all earlier slices; marks may fall into empty ones.
    spine = per_slice.unionByName(edges.withColumn("n", F.lit(0).cast("bigint")))
    totals = S.prefix_counts(spine, keys, F.col("n")).select(*keys, "_s", "_before")
    counted = (
        merged.withColumn("_local", local)
        .filter("sign is not null")
        .join(totals, [*keys, "_s"])
        .groupBy(*keys, "v", "id", F.col("t").alias("us"))
        .agg(F.sum(F.col("sign") * (F.col("_local") + F.col("_before"))).alias("history_count"))
        .filter(F.col("history_count") >= min_history)
    )
    return (
        counted.groupBy(*keys, "v")
        .agg(F.min(F.struct("us", "id", "history_count")).alias("_first"))
        .select(*keys, "v", "_first.us", "_first.id", "_first.history_count")
    )


def detect_new_value(
    events: DataFrame,
    rule: dict,
    start: int | None = None,
    end: int | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Of events outside [start, end] the lookback before it is read, or with `history` (compact_history of all events
    before `start`, no others) only the narrow spans of history_ranges()."""
    if history is not None:
        if start is None or end is None:
            raise ValueError("a run on stored history needs its start and its end")
        at = lambda us: F.timestamp_micros(F.lit(us))
        spans = [(F.col("timestamp") >= at(a)) & (F.col("timestamp") < at(b)) for a, b in history_ranges(rule, start, end)]
        events = events.filter(reduce(lambda one, other: one | other, spans))
    keys, lookback = group_keys(rule), micros(rule["lookback"])
    rows = matching(events, rule).withColumn("v", _value(rule)).filter("v is not null")
    found = new_values(
        rows.select(*keys, "us", "id", "v"), keys, lookback, rule["min_history"], start, end, history
    )
    found = found.withColumn("match_id", _match_id(rule, keys, "v", "id"))
    hit = rows.drop("v").join(found, [*keys, "us", "id"])
    return _evidence(hit, rule, value=F.col("v"), history_count=F.col("history_count")).drop("v")


# ---------- sequence ----------


def two_step_finals(
    rows: DataFrame,
    keys: list[str],
    needed: int,
    window: int,
    max_gap: int | None,
    disjoint: bool = False,
) -> DataFrame:
    """Final events that complete a two-step sequence; rows: keys, us, id, s1, s2.

    A final is able when its `needed`-th last first-step event is inside the window (and the last
    one within max_gap). Able finals are taken greedily: the next one needs `needed` first-step
    events after the one taken before it, because evidence is used once. An able final with that
    many new ones since the previous able final is always taken; only the dense runs in
    between need the walk in `_walk_runs`."""
    width = S.width_for(2 * window)
    w = S.by_slice(keys, "us", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(*keys, "_s", "s1").orderBy("us", "id")
    one = F.col("s1").cast("int")
    nth = F.lag("us", needed - 1).over(first) if needed > 1 else F.col("us")
    placed = (
        S.spread(S.look_back(rows, width, 2 * window), keys)
        .withColumn("_nth", F.when(F.col("s1"), nth))
        .withColumns(
            {
                "_first": F.last("_nth", ignorenulls=True).over(before),
                "_last": F.last(F.when(F.col("s1"), F.col("us")), ignorenulls=True).over(before),
                "_c": F.coalesce(F.sum(one).over(before), F.lit(0)),
                "_ci": F.sum(one).over(upto),
                "_own_c": F.coalesce(
                    F.sum(F.when(F.col("_own"), one).otherwise(0)).over(before), F.lit(0)
                ),
            }
        )
    )
    able = F.col("s2") & (F.col("us") - F.col("_first") <= window)
    if max_gap is not None:
        able = able & (F.col("us") - F.col("_last") <= max_gap)
    finals = placed.filter(able).withColumns(
        {"_jump": F.col("_c") - F.lag("_ci").over(w), "_new": F.col("_c") - F.lag("_c").over(w)}
    )
    # Without any first-step event since the able final before it, a final is never taken.
    finals = finals.filter("_own and (_new is null or _new > 0)")
    anchor = F.coalesce(F.col("_jump") >= needed, F.lit(True))
    if needed == 1 and disjoint:
        return finals.select(*keys, "us", "id")
    totals = S.prefix_counts(S.own_slice(rows, width), keys, one).select(*keys, "_s", "_before")
    numbered = finals.join(totals, [*keys, "_s"]).select(
        *keys,
        "_s",
        "us",
        "id",
        anchor.alias("anchor"),
        (F.col("_before") + F.col("_own_c")).alias("c"),
        (F.col("_before") + F.col("_own_c") + one).alias("ci"),
    )
    return _walk_runs(numbered, keys, needed)


def _walk(pdf: pd.DataFrame, entry: int, needed: int) -> tuple[list[int], int]:
    taken, state = [], entry
    for i, (anchor, c, ci) in enumerate(zip(pdf["anchor"], pdf["c"], pdf["ci"])):
        if anchor or c - state >= needed:
            taken.append(i)
            state = ci
    return taken, state


def _walk_runs(finals: DataFrame, keys: list[str], needed: int) -> DataFrame:
    """Takes able finals greedily along runs of them.

    All a slice must know of the past is how many first-step events lie between the last taken
    final and its own first able one, counted up to `needed`. So each slice first answers for
    every such number, the answers are chained per key (one small row per slice), and then each
    slice is walked once. Slices of anchors only are never sent to Python."""
    place = [f for f in finals.schema.fields if f.name in (*keys, "_s")]
    number = lambda name: T.StructField(name, T.LongType())
    ends = T.StructField("ends", T.ArrayType(T.LongType()))
    table = T.StructType([*place, number("first_c"), ends])
    state = T.StructType([*place, number("entry")])
    chosen = T.StructType([f for f in finals.schema.fields if f.name in (*keys, "us", "id")])

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        first = int(pdf["c"].iloc[0])
        results = [int(_walk(pdf, first - since, needed)[1]) for since in range(needed + 1)]
        return pdf.iloc[:1].assign(first_c=first, ends=[results])[table.names]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        entries, taken = [], None
        for first, results in zip(pdf["first_c"], pdf["ends"]):
            since = needed if taken is None else min(first - taken, needed)
            entries.append(first - since)
            taken = results[since]
        return pdf.assign(entry=entries)[state.names]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        return pdf.iloc[_walk(pdf, int(pdf["entry"].iloc[0]), needed)[0]][chosen.names]

    slices = finals.groupBy(*keys, "_s").agg(
        F.min("c").alias("first_c"), F.max("ci").alias("last_ci"), F.min("anchor").alias("pure")
    )
    mixed_slices = slices.filter("not pure").select(*keys, "_s")
    mixed = finals.join(mixed_slices, [*keys, "_s"], "left_semi")
    pure = slices.filter("pure").join(mixed_slices.select(*keys).distinct(), keys, "left_semi")
    same_end = F.array_repeat(F.col("last_ci"), needed + 1).alias("ends")
    tables = (
        mixed.groupBy(*keys, "_s")
        .applyInPandas(answers, table)
        .unionByName(pure.select(*keys, "_s", "first_c", same_end))
    )
    states = tables.groupBy(*keys).applyInPandas(chain, state)
    walked = mixed.join(states, [*keys, "_s"]).groupBy(*keys, "_s").applyInPandas(walk, chosen)
    plain = finals.join(slices.filter("pure").select(*keys, "_s"), [*keys, "_s"], "left_semi")
    return plain.select(*keys, "us", "id").unionByName(walked)


def _disjoint(steps: list[dict]) -> bool:
    """True when the two steps ask the same field for different values: no event is both."""
    wanted = [
        {c["field"]: c["value"] for c in (m.get("all") or [m]) if c.get("op") == "eq"}
        for m in (step.get("match") or {} for step in steps)
    ]
    return any(name in wanted[1] and wanted[1][name] != v for name, v in wanted[0].items())


def _two_steps(rows: DataFrame, keys: list[str], rule: dict, window: int) -> DataFrame:
    finals = two_step_finals(
        rows.select(*keys, "us", "id", "s1", "s2"),
        keys,
        rule["threshold"],
        window,
        micros(rule.get("max_gap")),
        _disjoint(rule["steps"]),
    )
    # Every first-step event belongs to the next completed sequence, if that is close enough.
    width = S.width_for(window)
    marks = S.look_ahead(finals.withColumn("_final", F.lit(True)), width, window)
    steps = S.own_slice(rows.filter("s1 or s2").withColumn("_final", F.lit(False)), width)
    lined = S.spread(steps.withColumn("_own", F.lit(True)).unionByName(marks, True), keys)
    w = Window.partitionBy(*keys, "_s").orderBy("us", "id", F.col("_final").desc())
    back = Window.partitionBy(*keys, "_s").orderBy(F.col("us").desc(), F.col("id").desc(), "_final")
    ahead = F.last(F.when(F.col("_final"), F.struct("us", "id")), ignorenulls=True).over(
        back.rowsBetween(Window.unboundedPreceding, 0)
    )
    is_final = (F.lag("id").over(w) == F.col("id")) & F.lag("_final").over(w)
    return (
        lined.withColumns({"_next": ahead, "_done": F.coalesce(is_final, F.lit(False)),
                           "_self": F.lag(F.struct("us", "id")).over(w)})
        .filter("not _final")
        .withColumn("_to", F.when(F.col("_done"), F.col("_self")).otherwise(F.col("_next")))
        .filter(
            F.col("_done")
            | (F.col("s1") & F.col("_to").isNotNull() & (F.col("_to.us") - F.col("us") <= window))
        )
        .withColumn("step_no", F.when(F.col("_done"), 1).otherwise(0))
        .withColumns({"final_us": F.col("_to.us"), "final_id": F.col("_to.id")})
        .drop("_next", "_done", "_self", "_to", "_final", "_own", "_s")
    )


#: Rows of one piece of a key's timeline, but for a single short span of time that has more.
PIECE_ROWS = 20_000
LEFT = "array<struct<step:int,us:bigint,id:string>>"


def _pieces(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Adds `_p`: each key's timeline in pieces of consecutive short slices, by rows and not by time, so a
    busy key or hour has more of them."""
    placed = S.own_slice(rows, max(window // 16, 1_000_000))
    before = S.prefix_counts(placed, keys, F.lit(1))
    piece = F.floor(F.col("_before") / PIECE_ROWS).cast("bigint").alias("_p")
    return placed.join(before.select(*keys, "_s", piece), [*keys, "_s"]).drop("_s")


def _many_steps(rows: DataFrame, keys: list[str], rule: dict, window: int) -> DataFrame:
    """Three or more steps. What a piece finds depends on the events that are still unused when it begins,
    which is what the piece before it leaves over. So every piece is first played as if nothing was left
    over; then those whose beginning turns out different are played again, until none does. By induction
    along a key the result is that of playing it in one go. Mostly two or three turns are enough, as
    what a piece leaves over seldom depends on its beginning; no key or session is played in one task."""
    k = len(rule["steps"])
    gap = micros(rule.get("max_gap"))
    needed = [rule["threshold"], *[s.get("min_count", 1) for s in rule["steps"][1:]]]
    flags = [f"s{i + 1}" for i in range(k)]
    place = [*keys, "_p"]
    light = stored(_pieces(rows.select(*keys, "us", "id", *flags), keys, window))
    begins = light.groupBy(*place).agg(F.min("us").alias("_begin"))
    line = stored(begins.withColumn("_prev", F.lag("_p").over(Window.partitionBy(*keys).orderBy("_p"))))
    names = [f for f in light.schema.fields if f.name in place]
    out = T.StructType(
        [*names, *[f for f in light.schema.fields if f.name in ("us", "id")],
         T.StructField("final_us", T.LongType()), T.StructField("final_id", T.StringType()),
         T.StructField("step_no", T.IntegerType()), T.StructField("l_step", T.ArrayType(T.IntegerType())),
         T.StructField("l_us", T.ArrayType(T.LongType())), T.StructField("l_id", T.ArrayType(T.StringType()))]
    )

    def play(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return pd.DataFrame(columns=out.names)
        here = tuple(pdf[place].iloc[0])
        waiting, found = _Waiting(needed, gap), []
        for left in asked["left"].iloc[0]:
            waiting.lines[left["step"]].append((left["us"], left["id"]))
        pdf = pdf.sort_values(["us", "id"])
        for us, event, steps in zip(pdf["us"].tolist(), pdf["id"], pdf[flags].to_numpy(bool).tolist(), strict=True):
            waiting.forget(us - window)
            parts = waiting.complete((us, event)) if steps[-1] else []
            found += [(*here, *e, us, event, i, None, None, None) for i, part in enumerate(parts) for e in part]
            if not parts:
                waiting.add((us, event), steps)
        over = [(step, *e) for step, events in enumerate(waiting.lines) for e in events]
        ends = [list(column) for column in zip(*over, strict=True)] or [[], [], []]
        return pd.DataFrame([*found, (*here, *[None] * 5, *ends)], columns=out.names).astype(object)

    none = F.array().cast(LEFT)
    asked, ended, turns = stored(line.select(*place, none.alias("left"))), None, []
    begun = asked
    while True:
        mine = light.join(asked.select(*place), place, "left_semi")
        ran = stored(mine.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(play, out))
        turns.append((asked, ran))
        zipped = F.arrays_zip(F.col("l_step").alias("step"), F.col("l_us").alias("us"), F.col("l_id").alias("id"))
        ends = ran.where("l_step is not null").select(*place, zipped.cast(LEFT).alias("over"))
        ended = stored(ends if ended is None else ended.join(asked.select(*place), place, "left_anti").unionByName(ends))
        over = ended.select(*keys, F.col("_p").alias("_prev"), "over")
        near = F.filter(F.coalesce("over", none), lambda e: e["us"] >= F.col("_begin") - window)
        now = line.join(over, [*keys, "_prev"], "left").select(*place, near.alias("left"))
        changed = now.join(begun.select(*place, F.col("left").alias("_was")), place).where("left != _was").drop("_was")
        asked = stored(changed)
        if asked.isEmpty():
            break
        begun = stored(begun.join(asked.select(*place), place, "left_anti").unionByName(asked))
    # A piece counts as it was played last.
    found = None
    for turn, (was, ran) in enumerate(turns):
        part = ran.where("l_step is null").drop("l_step", "l_us", "l_id")
        for later, _ in turns[turn + 1 :]:
            part = part.join(later.select(*place), place, "left_anti")
        found = part if found is None else found.unionByName(part)
    return rows.join(found.drop("_p"), [*keys, "us", "id"])


class _Waiting:
    """Events that no sequence has used: a line (time, id) per step but the last,
    each in time order and one window long."""

    def __init__(self, needed: list[int], gap: int | None):
        self.needed, self.gap = [max(1, n) for n in needed[:-1]], gap
        self.lines: list[list[tuple]] = [[] for _ in self.needed]

    def add(self, event: tuple, steps: list[bool]) -> None:
        for line, fits in zip(self.lines, steps, strict=False):
            if fits:
                line.append(event)

    def forget(self, before: int) -> None:
        for line in self.lines:
            del line[: bisect_left(line, (before,))]

    def complete(self, final: tuple) -> list[list[tuple]]:
        """The parts of a sequence that this event ends, taken out of the lines; none if a step has
        too few events ahead of the next one's first, or the last of them is too far from it."""
        parts = [[final]]
        for line, least in zip(reversed(self.lines), reversed(self.needed), strict=True):
            first = parts[-1][0]
            ahead = bisect_left(line, first)
            if ahead < least or (self.gap is not None and first[0] - line[ahead - 1][0] > self.gap):
                return []
            parts.append(line[:ahead])
        used = {event for part in parts for event in part}
        self.lines = [[event for event in line if event not in used] for line in self.lines]
        return parts[::-1]


def detect_sequence(events: DataFrame, rule: dict) -> DataFrame:
    """Ordered steps of one group inside the window; evidence is used once."""
    keys, window, steps = group_keys(rule), micros(rule["time_window"]), rule["steps"]
    tests = {f"s{i + 1}": holds(step.get("match")) for i, step in enumerate(steps)}
    relevant = events.withColumns(tests).filter(" or ".join(tests))
    rows = prepared(relevant, rule)
    found = (_two_steps if len(steps) == 2 else _many_steps)(rows, keys, rule, window)
    found = found.withColumn("match_id", _match_id(rule, keys, "final_id"))
    found = _evidence(found, rule, step_no=F.col("step_no"))
    return found.drop(*tests, "final_us", "final_id")


def evaluate(
    events: DataFrame,
    rule: dict,
    start: int | None = None,
    end: int | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Evidence of one rule, by its kind; `history` is for rules of new values."""
    kind = rule["kind"]
    if kind == "new_value":
        return detect_new_value(events, rule, start, end, history)
    return {
        "single": detect_single,
        "threshold": detect_threshold,
        "distinct": detect_distinct,
        "sequence": detect_sequence,
    }[kind](events, rule)
