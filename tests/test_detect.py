"""The evaluators against a plain restatement of their meaning on random data with ties."""

import random
from collections import defaultdict
from datetime import UTC, datetime

import pytest
from frames import T0, event, frame
from pyspark.sql import functions as F

from emberwatch.operators import detect

FAIL = {"field": "event_outcome", "op": "eq", "value": "failure"}
GOOD = {"field": "event_outcome", "op": "eq", "value": "success"}


def random_rows(seed, n=700, span=20000, keys=3, values=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows share one key
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(keys)}"
        rows.append(
            dict(
                n=i,
                t=rng.randrange(span) if rng.random() < 0.5 else rng.randrange(span // 10) * 10,
                username=user,
                event_outcome=rng.choice(["failure", "failure", "success"]),
                source_ip=f"10.0.{rng.randrange(values)}.{rng.randrange(3)}",
                event_action=rng.choice(["logon", "logoff"]),
            )
        )
    return rows


def to_frame(spark, rows):
    return frame(
        spark,
        [event(r["n"], r["t"], **{k: v for k, v in r.items() if k not in ("n", "t")}) for r in rows],
    )


def groups(rows, keep):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["t"], r["n"])):
        if keep(r):
            found[r["username"]].append(r)
    return found


def bursts(rows, window, big_enough):
    """Evidence sets: the window that is first big enough, then all that follow without a gap."""
    out, i, begin = [], 0, 0
    while i < len(rows):
        inside = [r for r in rows[begin : i + 1] if rows[i]["t"] - r["t"] <= window]
        if not big_enough(inside):
            i += 1
            continue
        j = i
        while j + 1 < len(rows) and rows[j + 1]["t"] - rows[j]["t"] <= window:
            j += 1
        out.append(frozenset(r["n"] for r in inside + rows[i + 1 : j + 1]))
        i = begin = j + 1
    return out


def evidence_sets(df):
    found = defaultdict(set)
    for r in df.select("match_id", "id").collect():
        found[r[0]].add(int(r[1][1:]))
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("seed,needed,window", [(1, 3, 100), (2, 5, 300), (3, 1, 60), (4, 12, 4000)])
def test_threshold(spark, seed, needed, window):
    rows = random_rows(seed)
    rule = dict(id="T", kind="threshold", match=FAIL, group_by=["username"], threshold=needed,
                time_window=f"{window}s")
    want = [
        sorted(b)
        for g in groups(rows, lambda r: r["event_outcome"] == "failure").values()
        for b in bursts(g, window, lambda x: len(x) >= needed)
    ]
    assert evidence_sets(detect.evaluate(to_frame(spark, rows), rule)) == sorted(want)


@pytest.mark.parametrize("seed,needed,window", [(5, 3, 100), (6, 4, 300), (7, 6, 2000)])
def test_distinct(spark, seed, needed, window):
    rows = random_rows(seed)
    rule = dict(id="D", kind="distinct", match=FAIL, group_by=["username"], distinct_field="source_ip",
                threshold=needed, time_window=f"{window}s")
    want = [
        sorted(b)
        for g in groups(rows, lambda r: r["event_outcome"] == "failure").values()
        for b in bursts(g, window, lambda x: len({r["source_ip"] for r in x}) >= needed)
    ]
    assert evidence_sets(detect.evaluate(to_frame(spark, rows), rule)) == sorted(want)


def sequence_sets(rows, steps, needed, window, gap):
    out = []
    for members in groups(rows, lambda r: any(s(r) for s in steps)).values():
        used = set()
        for final in members:
            if final["n"] in used or not steps[-1](final):
                continue
            parts = [[final]]
            for step, least in zip(reversed(steps[:-1]), reversed(needed)):
                edge = (parts[0][0]["t"], parts[0][0]["n"])
                part = [
                    r for r in members
                    if r["n"] not in used and r["t"] >= final["t"] - window
                    and (r["t"], r["n"]) < edge and step(r)
                ]
                if len(part) < least or (gap is not None and edge[0] - part[-1]["t"] > gap):
                    parts = None
                    break
                parts.insert(0, part)
            if parts:
                ids = {r["n"] for p in parts for r in p}
                used |= ids
                out.append(sorted(ids))
    return sorted(out)


@pytest.mark.parametrize(
    "seed,needed,window,gap",
    [(8, 1, 100, None), (9, 3, 300, 100), (10, 2, 1500, None), (11, 5, 6000, 50), (12, 3, 3600, 3000)],
)
def test_sequence_two_steps(spark, seed, needed, window, gap):
    rows = random_rows(seed)
    rule = dict(id="S", kind="sequence", group_by=["username"], threshold=needed, time_window=f"{window}s",
                steps=[dict(name="a", match=FAIL), dict(name="b", match=GOOD)])
    if gap:
        rule["max_gap"] = f"{gap}s"
    steps = [lambda r: r["event_outcome"] == "failure", lambda r: r["event_outcome"] == "success"]
    want = sequence_sets(rows, steps, [needed], window, gap)
    assert want and evidence_sets(detect.evaluate(to_frame(spark, rows), rule)) == want


@pytest.mark.parametrize("seed,needed", [(13, 1), (14, 3)])
def test_sequence_overlapping_steps(spark, seed, needed):
    rows = random_rows(seed)
    logon = {"field": "event_action", "op": "eq", "value": "logon"}
    rule = dict(id="S", kind="sequence", group_by=["username"], threshold=needed, time_window="2000s",
                steps=[dict(name="a", match=FAIL), dict(name="b", match=logon)])
    steps = [lambda r: r["event_outcome"] == "failure", lambda r: r["event_action"] == "logon"]
    want = sequence_sets(rows, steps, [needed], 2000, None)
    assert want and evidence_sets(detect.evaluate(to_frame(spark, rows), rule)) == want


def test_sequence_three_steps(spark):
    rows = random_rows(15)
    rule = dict(id="S", kind="sequence", group_by=["username"], threshold=1, time_window="900s", max_gap="300s",
                steps=[dict(name="a", match={"all": [FAIL, {"field": "event_action", "op": "eq", "value": "logon"}]}),
                       dict(name="b", match={"all": [FAIL, {"field": "event_action", "op": "eq", "value": "logoff"}]}), dict(name="c", match=GOOD)])
    steps = [
        lambda r: r["event_outcome"] == "failure" and r["event_action"] == "logon",
        lambda r: r["event_outcome"] == "failure" and r["event_action"] == "logoff",
        lambda r: r["event_outcome"] == "success",
    ]
    want = sequence_sets(rows, steps, [1, 1], 900, 300)
    assert want and evidence_sets(detect.evaluate(to_frame(spark, rows), rule)) == want


@pytest.mark.parametrize("piece", [9, 200])
def test_sequence_in_pieces_is_the_sequence_in_one_go(spark, monkeypatch, piece):
    """Four steps with counts; what is left over crosses many pieces."""
    monkeypatch.setattr(detect, "PIECE_ROWS", piece)
    rows = random_rows(25)
    both = lambda *tests: {"all": list(tests)}
    logon, logoff = ({"field": "event_action", "op": "eq", "value": v} for v in ("logon", "logoff"))
    rule = dict(id="S", kind="sequence", group_by=["username"], threshold=2, time_window="1500s", max_gap="750s",
                steps=[dict(name="a", match=both(FAIL, logon)), dict(name="b", match=both(FAIL, logoff), min_count=1),
                       dict(name="c", match=both(GOOD, logon)), dict(name="d", match=GOOD)])
    steps = [
        lambda r: r["event_outcome"] == "failure" and r["event_action"] == "logon",
        lambda r: r["event_outcome"] == "failure" and r["event_action"] == "logoff",
        lambda r: r["event_outcome"] == "success" and r["event_action"] == "logon",
        lambda r: r["event_outcome"] == "success",
    ]
    want = sequence_sets(rows, steps, [2, 1, 1], 1500, 750)
    assert want and evidence_sets(detect.evaluate(to_frame(spark, rows), rule)) == want


def test_sequence_three_steps_without_events(spark):
    rule = dict(id="S", kind="sequence", group_by=["username"], threshold=1, time_window="900s",
                steps=[dict(name=n, match=FAIL) for n in "abc"])
    assert detect.evaluate(to_frame(spark, random_rows(1, n=5)).limit(0), rule).collect() == []


@pytest.mark.parametrize("seed,lookback,least,values", [(16, 500, 2, 40), (17, 3000, 5, 60), (18, 64, 1, 10)])
def test_new_value(spark, seed, lookback, least, values):
    rows = random_rows(seed, values=values)
    rule = dict(id="N", kind="new_value", match=GOOD, group_by=["username"], value_field="source_ip",
                value_transform="ip_network", lookback=f"{lookback}s", min_history=least)
    want = set()
    for user, members in groups(rows, lambda r: r["event_outcome"] == "success").items():
        done = set()
        for r in members:
            net = r["source_ip"].rsplit(".", 1)[0]
            past = [p for p in members if r["t"] - lookback <= p["t"] < r["t"]]
            if len(past) >= least and net not in {p["source_ip"].rsplit(".", 1)[0] for p in past} and net not in done:
                done.add(net)
                want.add((user, net + ".0/24", r["n"], len(past)))
    got = detect.evaluate(to_frame(spark, rows), rule).select("username", "value", "id", "history_count")
    assert want and {(r[0], r[1], int(r[2][1:]), r[3]) for r in got.collect()} == want


@pytest.mark.parametrize("seed,lookback,cuts", [(41, 3000, (4000, 4321, 9000)), (42, 640, (3000, 6000, 6001)), (43, 20000, (1, 5000, 20000))])
def test_new_value_on_stored_history_equals_the_full_run(spark, seed, lookback, cuts):
    rule = dict(id="N", kind="new_value", match=GOOD, group_by=["username"], value_field="source_ip",
                value_transform="ip_network", lookback=f"{lookback}s", min_history=2)
    df = to_frame(spark, random_rows(seed, values=50)).cache()
    at = [detect.micros(T0 - datetime.fromtimestamp(0, UTC)) + c * 1_000_000 for c in cuts]
    before = lambda low, high: df.filter((F.unix_micros("timestamp") >= low) & (F.unix_micros("timestamp") < high))
    rows = lambda found: sorted(map(tuple, found.select("username", "value", "id", "history_count").collect()))
    history, some = detect.compact_history(before(0, at[0]), rule), 0
    for start, end in zip(at, at[1:], strict=False):
        spans = [(F.unix_micros("timestamp") >= a) & (F.unix_micros("timestamp") < b) for a, b in detect.history_ranges(rule, start, end - 1)]
        near = df.filter(spans[0] | spans[-1])
        want = rows(detect.evaluate(df, rule, start, end - 1))
        assert rows(detect.evaluate(near, rule, start, end - 1, history)) == want
        some += len(want)
        history = detect.merge_history(history, detect.compact_history(before(start, end), rule), ["_k0"])
    assert some
    with pytest.raises(ValueError, match="start and its end"):
        detect.evaluate(df, rule, at[0], None, history)


def test_single_takes_the_first_indicator(spark):
    rows = frame(spark, [event(1, command_line="x /dev/tcp/ y"), event(2, command_line="x"), event(3, host=None)])
    rule = dict(id="P", kind="single", match={"field": "event_category", "op": "exists"}, group_by=["host"],
                indicators=[dict(id="tcp", match={"field": "command_line", "op": "contains", "value": "/DEV/tcp/"}),
                            dict(id="any", match={"field": "command_line", "op": "exists"})])
    got = {(r.id, r.indicator) for r in detect.evaluate(rows, rule).collect()}
    assert got == {("e000001", "tcp"), ("e000002", "any")}
