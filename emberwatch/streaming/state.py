"""Detection with state per key: low latency, bounded lateness.

Events of a key wait until the watermark has passed them, so each key is always read in order; events
that come after the watermark has passed their time are dropped. Keys are dealt to buckets by their hash, and a bucket
is one state: what waits is appended to, a piece for each batch, and what a rule remembers of its keys is one
value. So a batch asks the state store a few times per bucket, however many keys there are. A timer per bucket, at the
earliest waiting event or the end of what is kept, does the work.
What is remembered is bounded by the rule: one window (or lookback) per key. A stream that ends is completed by `closing` rows,
which move the watermark past all others."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from emberwatch.functions.conditions import holds
from emberwatch.operators.detect import _value, group_keys, matching, micros, prepared

COLUMNS = ["us", "id", "v", "s1", "s2"]
#: How many states the keys are dealt to. More of them make each smaller; a stream keeps its number.
BUCKETS = 1_024
#: Workers have no session that could read a type from text.
PIECE = T.StructType([T.StructField("rows", T.BinaryType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain_names(keys: list[str]) -> list[str]:
    """Names without the underscore, with which pandas would not hand them over."""
    return [k.lstrip("_") for k in keys]


class Keyed(StatefulProcessor):
    """Waiting events of a bucket's keys. Once they are due, each key's are handed to `fold` in order, with what is
    remembered of the key; it returns what it found, what to remember (None: nothing), and until when."""

    out = ""

    def __init__(self, width: int) -> None:
        self.width = width
        self.names = [*[f"_k{i}" for i in range(width)], *[c.split()[0] for c in self.out.split(", ")]]

    def init(self, handle) -> None:
        self.handle, self.done = handle, {}
        self.waiting = handle.getListState("waiting", PIECE)
        self.memory = handle.getValueState("memory", PIECE)

    def fold(self, kept, due: list[tuple], mark: int) -> tuple[list[tuple], object, int | None]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, events = timerValues.getCurrentWatermarkInMs() * 1000, []
        for pdf in rows:
            pdf = pdf.loc[pdf["us"] > mark, [*_plain_names(self.names[: self.width]), *COLUMNS]].astype(object)
            events += pdf.where(pdf.notna(), None).values.tolist()
        if events:
            self._wait(events)
        yield from ()

    def _wait(self, events: list) -> None:
        self.waiting.appendValue((pickle.dumps(events),))
        self.handle.registerTimer(min(e[self.width] for e in events) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, width = timerValues.getCurrentWatermarkInMs() * 1000, self.width
        if self.done.get(key) == mark:  # an earlier timer of the bucket has seen to all that is due by now
            return
        self.done[key] = mark
        due, rest = [], []
        for (piece,) in self.waiting.get():
            for event in pickle.loads(piece):
                (due if event[width] <= mark else rest).append(event)
        if due:
            self.waiting.clear()
            if rest:
                self._wait(rest)
        elif rest:
            self.handle.registerTimer(min(e[width] for e in rest) // 1000 + 1)
        due.sort(key=lambda e: e[: width + 2])
        old = self.memory.get()
        kept = pickle.loads(old[0]) if old else {}
        new = {k: [e[width:] for e in events] for k, events in groupby(due, key=lambda e: tuple(e[:width]))}
        found, until = [], None
        for k in list(dict.fromkeys(chain(kept, new))):
            rows, memory, end = self.fold(kept.get(k), new.get(k, []), mark)
            found += [(*k, *row) for row in rows]
            if memory is None:
                kept.pop(k, None)
            else:
                kept[k] = memory
            if end is not None:
                until = end if until is None else min(until, end)
        if kept:
            self.memory.update((pickle.dumps(kept),))
        elif old:
            self.memory.clear()
        if until is not None:
            self.handle.registerTimer(max(until, mark) // 1000 + 1)
        if found:
            yield pd.DataFrame(found, columns=self.names)

    def close(self) -> None:
        pass


class Bursts(Keyed):
    """Threshold bursts: the last times, and the burst that is going on."""

    out = "lo bigint, hi bigint, n bigint"

    def __init__(self, rule: dict, width: int) -> None:
        super().__init__(width)
        self.needed, self.window = rule["threshold"], micros(rule["time_window"])

    def fold(self, kept, due: list[tuple], mark: int) -> tuple[list[tuple], object, int | None]:
        (recent, going), out = kept or ([], None), []
        for us in chain([e[0] for e in due], [None]):
            now = mark if us is None else us  # last of all: is the burst over by now?
            if going and now - going[1] > self.window:
                out.append(tuple(going))
                going, recent = None, []
            if recent and recent[0] < now - self.window:
                recent = recent[bisect_left(recent, now - self.window) :]
            if us is None:
                break
            if going:
                going = (going[0], us, going[2] + 1)
                continue
            recent.append(us)
            if len(recent) >= self.needed:
                going, recent = (recent[0], us, len(recent)), []
        last = going[1] if going else recent[-1] if recent else None
        return out, None if last is None else (recent, going), None if last is None else last + self.window + 1000


class Pairs(Keyed):
    """Two-step sequences: first-step events of one window that are not used yet."""

    out = "final_us bigint, final_id string, n bigint"

    def __init__(self, rule: dict, width: int) -> None:
        super().__init__(width)
        self.needed, self.window, self.gap = rule["threshold"], micros(rule["time_window"]), micros(rule.get("max_gap"))

    def fold(self, kept, due: list[tuple], mark: int) -> tuple[list[tuple], object, int | None]:
        pending, at, out = kept or [], 0, []  # those before `at` are too old
        for us, ident, _, first, last in due:
            at = bisect_left(pending, us - self.window, at)
            count = len(pending) - at
            near = count >= self.needed and (self.gap is None or us - pending[-1] <= self.gap)
            if last and near:
                out.append((us, ident, count + 1))
                pending, at = [], 0
            elif first:
                pending.append(us)
        pending = pending[bisect_left(pending, mark - self.window, at) :]
        return out, pending or None, pending[-1] + self.window + 1000 if pending else None


class NewValues(Keyed):
    """Values unseen in the lookback: the times of the lookback in order, and of a value its last time and whether it was told."""

    out = "us bigint, id string, value string, history bigint"

    def __init__(self, rule: dict, width: int) -> None:
        super().__init__(width)
        self.lookback, self.least = micros(rule["lookback"]), rule["min_history"]

    def fold(self, kept, due: list[tuple], mark: int) -> tuple[list[tuple], object, int | None]:
        (times, values), out = kept or ([], {}), []
        for us, ident, value, *_ in due:
            last, told = values.get(value, (None, False))
            if not told and (last is None or last < us - self.lookback):
                history = bisect_left(times, us) - bisect_left(times, us - self.lookback)
                if history >= self.least:
                    out.append((us, ident, value, history))
                    told = True
            values[value] = (us, told)
            times.append(us)
        # Later events are after the mark, and look no further back than this.
        times = times[bisect_left(times, mark - self.lookback) :]
        if not times:
            # Nothing is near any more: values that were never told need not be known.
            values = {v: known for v, known in values.items() if known[1]}
        return out, (times, values) if times or values else None, times[-1] + self.lookback + 1000 if times else None


def _stateful(rows: DataFrame, keys: list[str], machine: Keyed, lateness: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = ", ".join([*[f"{k} string" for k in keys], machine.out])
    bucket = F.pmod(F.xxhash64(*_plain_names(keys)), F.lit(BUCKETS))
    return (
        rows.withWatermark("timestamp", lateness)
        .withColumnsRenamed(dict(zip(keys, _plain_names(keys))))
        .select("timestamp", *_plain_names(keys), *COLUMNS, bucket.alias("bucket"))
        .groupBy("bucket")
        .transformWithStateInPandas(machine, schema, "append", "eventTime")
    )


def _plain(rows: DataFrame, **given) -> DataFrame:
    blank = {"v": F.lit(None).cast("string"), "s1": F.lit(False), "s2": F.lit(False)}
    return rows.withColumns({**blank, **given})


def stream_bursts(events: DataFrame, rule: dict, lateness: str) -> DataFrame:
    """Finished bursts: first and last time and number of events."""
    keys = group_keys(rule)
    return _stateful(_plain(matching(events, rule)), keys, Bursts(rule, len(keys)), lateness)


def stream_sequence(events: DataFrame, rule: dict, lateness: str) -> DataFrame:
    """Completed two-step sequences."""
    first, last = (holds(s.get("match")) for s in rule["steps"])
    rows = _plain(prepared(events, rule), s1=first, s2=last).filter("s1 or s2")
    keys = group_keys(rule)
    return _stateful(rows, keys, Pairs(rule, len(keys)), lateness)


def stream_new_value(events: DataFrame, rule: dict, lateness: str) -> DataFrame:
    """Values new for their key."""
    rows = _plain(matching(events, rule), v=_value(rule)).filter("v is not null")
    keys = group_keys(rule)
    return _stateful(rows, keys, NewValues(rule, len(keys)), lateness)


def closing(events: DataFrame, group_by: list[str], after: str) -> DataFrame:
    """Rows that end a stream: of each kind of event the last one, so much later and each for a key of its
    own. Once they have been read, the watermark is past everything before them: all that waits is taken and
    all that is going on is closed with the next batch (which may be closing rows of a later time)."""
    kinds = ["event_category", "event_action", "event_outcome", "service"]
    last = events.groupBy(*kinds).agg(F.max_by(F.struct(*events.columns), "timestamp").alias("_row")).select("_row.*")
    apart = {c: F.concat(F.lit("closing-"), "id") for c in group_by}
    later = F.col("timestamp") + F.expr(f"INTERVAL {after}")
    return last.withColumns({**apart, "id": F.concat(F.lit("closing-"), "id"), "timestamp": later})
