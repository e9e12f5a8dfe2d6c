"""Streaming jobs against their batch twins on the same rows."""

import re
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from frames import event
from test_detect import FAIL, GOOD, random_rows, to_frame
from test_parsers import raw

from emberwatch.operators import detect
from emberwatch.operators.reports import daily_counts
from emberwatch.plans import catalog_streaming
from emberwatch.schema import EVENT_SCHEMA, RAW_SCHEMA
from emberwatch.streaming import jobs, state


def as_stream(spark, folder, df, parts=4, outcome="failure"):
    """The rows in time order over several files, one per micro-batch, and a last far-off event."""
    rows = sorted(df.collect(), key=lambda r: r["timestamp"])
    size = len(rows) // parts + 1
    chunks = [rows[i : i + size] for i in range(0, len(rows), size)]
    chunks.append([event(999999, 9_000_000, username="marker", event_outcome=outcome)])
    chunks.append([event(999998, 9_900_000, username="marker", event_outcome=outcome)])
    for chunk in chunks:
        spark.createDataFrame(chunk, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    files = sorted(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(files) == len(chunks)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    return stream.sparkSession.table(name).filter("_k0 != 'marker'").collect()


def evidence(df):
    found = defaultdict(list)
    for r in df.select("match_id", "us", "username").collect():
        found[r[0]].append((r[2], r[1]))
    return found.values()


def test_bursts(spark, tmp_path):
    rule = dict(id="T", kind="threshold", match=FAIL, group_by=["username"], threshold=3, time_window="100s")
    df = to_frame(spark, random_rows(21, n=300))
    want = {(e[0][0], min(u for _, u in e), max(u for _, u in e), len(e)) for e in evidence(detect.evaluate(df, rule))}
    got = drained(state.stream_bursts(as_stream(spark, tmp_path / "in", df), rule, "60 seconds"), "bursts", tmp_path)
    assert want and {tuple(r) for r in got} == want


def test_sequence(spark, tmp_path):
    rule = dict(id="S", kind="sequence", group_by=["username"], threshold=2, time_window="600s", max_gap="300s",
                steps=[dict(name="a", match=FAIL), dict(name="b", match=GOOD)])
    df = to_frame(spark, random_rows(22, n=300))
    want = {(e[0][0], max(u for _, u in e), len(e)) for e in evidence(detect.evaluate(df, rule))}
    got = drained(state.stream_sequence(as_stream(spark, tmp_path / "in", df), rule, "60 seconds"), "pairs", tmp_path)
    assert want and {(r["_k0"], r["final_us"], r["n"]) for r in got} == want


def test_new_value(spark, tmp_path):
    rule = dict(id="N", kind="new_value", match=GOOD, group_by=["username"], value_field="source_ip", lookback="3000s", min_history=3)
    df = to_frame(spark, random_rows(23, n=300, values=30))
    want = {(r[0], r[1], r[2], r[3]) for r in detect.evaluate(df, rule).select("username", "id", "value", "history_count").collect()}
    got = drained(state.stream_new_value(as_stream(spark, tmp_path / "in", df, outcome="success"), rule, "60 seconds"), "news", tmp_path)
    assert want and {(r["_k0"], r["id"], r["value"], r["history"]) for r in got} == want


class Kept:
    """A state store of one bucket that counts what it is asked."""

    def __init__(self):
        self.states, self.timers, self.calls = {}, [], 0

    def getListState(self, name, schema):
        return self

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def asked(self, value):
        self.calls += 1
        return value


class KeptList(Kept):
    values = ()

    def appendValue(self, value):
        self.values = self.asked((*self.values, value))

    def get(self):
        return iter(self.asked(self.values))

    def clear(self):
        self.values = self.asked(())


class KeptValue(KeptList):
    values = None

    def get(self):
        return self.asked(self.values)

    def update(self, value):
        self.values = self.asked(value)

    def clear(self):
        self.values = self.asked(None)


@pytest.mark.parametrize("kind", ["bursts", "pairs", "news"])
def test_state_is_asked_a_few_times_for_many_keys(kind):
    """Three batches of a bucket of 400 keys: late rows and timers of earlier batches among them."""
    rule = dict(threshold=1 if kind == "pairs" else 2, time_window="100s", lookback="100s", min_history=1)
    made = {"bursts": state.Bursts, "pairs": state.Pairs, "news": state.NewValues}[kind](rule, 1)
    handle = Kept()
    handle.getListState, handle.getValueState = lambda *_: waiting, lambda *_: memory
    waiting, memory = KeptList(), KeptValue()
    made.init(handle)
    second, out = 1_000_000, []
    at = lambda mark: SimpleNamespace(getCurrentWatermarkInMs=lambda: mark * 1000)
    for batch, mark in ((0, 0), (1, 150), (2, 400)):
        rows = [(f"key{k}", (batch * 200 + 1 + 10 * i) * second, f"e{i}", f"v{i}", i == 0, i == 1) for k in range(400) for i in range(2)]
        rows.append(("key0", mark * second, "late", "late", True, True))
        list(made.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["k0", *state.COLUMNS])]), at(mark)))
        if mark:
            for _ in range(2):
                out += [tuple(r) for f in made.handleExpiredTimer((7,), at(mark), None) for r in f.itertuples(index=False)]
    key = lambda rows: sorted(r[1:] for r in rows if r[0] == "key5")
    starts = [1, 201]
    want = {"bursts": [(s * second, (s + 10) * second, 2) for s in starts], "pairs": [((s + 10) * second, "e1", 2) for s in starts],
            "news": [(11 * second, "e1", "v1", 1)]}[kind]
    assert key(out) == want and len({r[0] for r in out}) == 400
    assert waiting.calls + memory.calls < 20


def test_parts_arrive_whole_from_several_tasks(spark, tmp_path):
    seen, place = [], tmp_path / "in"

    def start(stream):
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        return writer.foreachBatch(lambda batch, epoch: seen.append((epoch, sorted(r[0] for r in batch.collect())))).start()

    parts = (spark.range(a, a + 30, 1, 5) for a in (0, 100, 200))
    catalog_streaming._arrive(spark, parts, str(place), start)
    assert seen == [(k, list(range(a, a + 30))) for k, a in enumerate((0, 100, 200))]
    assert len(list(place.glob("*.parquet"))) == 15


def test_detect_and_summaries_are_exact(spark, tmp_path):
    rule = dict(id="T", name="t", kind="threshold", category="c", severity="low", confidence="low", match=FAIL, group_by=["username"],
                threshold=3, time_window="900s", mitre=[], explanation="$count", response=[])
    df = to_frame(spark, random_rows(24, n=200))
    folder = tmp_path / "in"
    for i in (1, 0):  # the later half arrives first
        part = df.filter(f"cast(substring(id, 2) as int) % 2 = {i}")
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = lambda: spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    jobs.stream_detect(stream(), [rule], str(tmp_path / "ev"), str(tmp_path / "det"), name="d1", checkpoint=str(tmp_path / "c1")).awaitTermination(240)
    last = spark.read.parquet(str(tmp_path / "det")).filter("stream_batch = 1").select("match_id", "event_count").collect()
    whole = detect.evaluate(df, rule).groupBy("match_id").count().collect()
    assert last and {tuple(r) for r in last} <= {tuple(r) for r in whole}
    jobs.stream_daily_summaries(stream(), str(tmp_path / "sum"), name="d2", checkpoint=str(tmp_path / "c2")).awaitTermination(240)
    daily, logons = jobs.read_summaries(spark, str(tmp_path / "sum"))
    plain = daily_counts(df, df.withColumn("received_at", df["timestamp"]))
    rows = lambda d: {(r["kind"], r["day"], r["records"]) for r in d.collect()}
    assert rows(daily) == rows(plain) and logons.count() > 0


def test_ingest_takes_a_record_once(spark, tmp_path):
    line = "Sep 25 10:31:0{} web-01 sshd[1]: Failed password for root from 203.0.113.45 port 5 ssh2"
    for n in (1, 2):  # the second file sends the first record again
        rows = [raw(i, "linux_auth", line.format(i)) for i in range(1, n + 1)]
        spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sources = spark.createDataFrame([("s1", "linux_auth", "UTC", None, None)], "id string, source_type string, timezone string, default_host string, allowed_hosts array<string>")
    assets = spark.createDataFrame([], "id string, hostname string, ip_addresses array<string>, criticality string")
    people = spark.createDataFrame([], "id string, username string, privilege_level string")
    stream = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    raw_path, ev_path = str(tmp_path / "raw"), str(tmp_path / "events")
    jobs.stream_ingest(stream, sources, assets, people, raw_path, ev_path, name="i1", checkpoint=str(tmp_path / "c")).awaitTermination(280)
    assert spark.read.parquet(raw_path).count() == 2 and spark.read.parquet(ev_path).count() == 2
    deduped = jobs.stream_dedup(spark.readStream.schema(RAW_SCHEMA).parquet(str(tmp_path / "in")), "1 hour")
    q = deduped.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_known_fingerprints_read_only_buckets_that_may_hold_them(spark, tmp_path):
    import hashlib

    prints = jobs.Prints(str(tmp_path / "prints"), 2)
    digest = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    frame_of = lambda ks: spark.createDataFrame([(digest(k),) for k in ks], "fingerprint string")
    assert prints.known(frame_of([1, 2]), 0) is None
    prints.add(frame_of(range(300)), 0)
    prints.add(frame_of(range(300, 600)), 1)
    assert prints.known(frame_of(range(600, 640)), 2) is None  # nothing is read for new records
    found = prints.known(frame_of([7, 450, 9999]), 2)
    assert {digest(7), digest(450)} <= {r[0] for r in found.collect()}
    assert {r[0][:2] for r in found.collect()} == {digest(7)[:2], digest(450)[:2]}
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]* IN ", plan), plan
    assert prints.known(frame_of(range(300, 310)), 1) is None  # a batch that is retried does not see itself
    prints.add(frame_of(range(300, 600)), 1)
    assert spark.read.parquet(prints.prints).count() == 600
