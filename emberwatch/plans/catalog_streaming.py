"""Streaming jobs run over the event table as a stream, to their end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.lineage import checkpoint_folder
from emberwatch.plans.catalog_detect import AUTH1, AUTH2, B1, NV, P2, QUERIES as BATCH
from emberwatch.plans.catalog_reports import QUERIES as REPORTS
from emberwatch.plans.oracle import EV, IDENTITIES, with_
from emberwatch.plans.rules import tuned
from emberwatch.sources import sample
from emberwatch.streaming import jobs, state


def _folder(spark, name: str) -> str:
    """A new folder of this run in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def _events(spark, folder: str):
    """The event table read as a stream, in the same projection as the batch queries."""
    return sample.project_events(
        spark.readStream.schema(sample.warehouse(spark, folder, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )


def _daily(spark, folder: str):
    out = _folder(spark, "daily")
    jobs.stream_daily_summaries(_events(spark, folder), out, "daily", checkpoint=f"{out}/_log").awaitTermination()
    daily, _ = jobs.read_summaries(spark, out)
    return daily.filter("kind = 'event'").select("kind", F.col("day").cast("string").alias("day"), "records")


def _logons(spark, folder: str):
    out = _folder(spark, "logons")
    jobs.stream_daily_summaries(_events(spark, folder), out, "logons", checkpoint=f"{out}/_log").awaitTermination()
    return jobs.read_summaries(spark, out)[1].withColumn("day", F.col("day").cast("string"))


def _detect(spark, folder: str):
    out = _folder(spark, "detect")
    jobs.stream_detect(_events(spark, folder), [AUTH1], f"{out}/events", f"{out}/found", "found", checkpoint=f"{out}/_log").awaitTermination()
    return spark.read.parquet(f"{out}/found").select("match_id", "event_count", "first_us", "last_us")


def _dedup(spark, folder: str):
    out = _folder(spark, "dedup")
    records = _events(spark, folder).select(
        F.col("message").cast("binary").alias("raw_data"), "source_id", F.col("timestamp").alias("received_at")
    )
    query = (
        jobs.stream_dedup(records, "40 days").writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/_log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("fingerprint")


def _in_turn(spark, folder: str, columns: list[str]) -> Iterator[DataFrame]:
    """The event table in seven parts that arrive one after the other: five by time, of which each has rows that are up to
    half an hour late, and two of closing rows."""
    events = sample.events(spark, folder)
    span = events.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    late = F.col("timestamp") + F.make_dt_interval(mins=F.pmod(F.xxhash64("id"), F.lit(4)).cast("int") * 10)
    step = (span["b"] - span["a"]) / 5
    for k in range(5):
        low, high = span["a"] + k * step, span["a"] + (k + 1) * step
        yield events.where((late >= low if k else F.lit(True)) & (late < high if k < 4 else F.lit(True)))
    for after in ("1000 DAYS", "1100 DAYS"):
        yield state.closing(events, columns, after)


def _arrive(spark, parts: Iterator[DataFrame], place: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part is written by all tasks that have rows of it and read to its end as one batch, before the next one is; the
    query goes on from its checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(place)
        start(spark.readStream.schema(part.schema).parquet(place)).awaitTermination()


def _stateful(make, rule):
    def query(spark, folder: str):
        out, schema = _folder(spark, "state"), []

        def start(stream: DataFrame) -> StreamingQuery:
            found = make(stream, rule, "1 hour")
            schema[:] = [found.schema]
            writer = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/_log")
            return writer.trigger(availableNow=True).start()

        _arrive(spark, _in_turn(spark, folder, rule["group_by"]), f"{out}/in", start)
        return spark.read.schema(schema[0]).parquet(f"{out}/rows")

    return query


def _resent(spark, folder: str) -> Iterator[DataFrame]:
    """Access-log records in four parts; a sixth of each part comes again with the next one."""
    rows = sample.raw_records(spark, folder, "http_access")
    again = rows.where("record_no % 6 = 0").withColumns(
        {"record_no": F.col("record_no") + 1_000_000_000, "received_at": F.col("received_at") + F.expr("INTERVAL 1 DAY")}
    )
    for k in range(4):
        yield rows.where(f"record_no % 4 = {k}").unionByName(again.where(f"record_no % 4 = {k - 1}"))


def _ingest(spark, folder: str):
    out = _folder(spark, "ingest")
    sources = sample.events(spark, folder).select(F.col("source_id").alias("id")).distinct().withColumns({
        "source_type": F.lit("http_access"), "timezone": F.lit("UTC"), "default_host": F.lit("app-01"),
        "allowed_hosts": F.lit(None).cast("array<string>"),
    })
    _arrive(spark, _resent(spark, folder), f"{out}/in", lambda stream: jobs.stream_ingest(
        stream, sources, sample.assets(spark, folder), sample.identities(spark, folder),
        f"{out}/raw", f"{out}/events", "ingest", checkpoint=f"{out}/_log",
    ))
    taken = spark.read.parquet(f"{out}/events").select(
        F.col("raw_event_id").alias("fingerprint"), F.unix_micros("timestamp").alias("us"), "username", "identity_id"
    )
    return spark.read.parquet(f"{out}/raw").select("record_no", "fingerprint", "parse_status").join(taken, "fingerprint", "left")


QUERIES: dict[str, tuple] = {
    "str_daily_summaries": (
        _daily,
        with_(EV, body="SELECT 'event' AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS records FROM ev GROUP BY 2"),
    ),
    "str_logon_summaries": (_logons, REPORTS["rpt_logon_success_daily"][1]),
    "str_detect": (_detect, BATCH["det_threshold"][1]),
    "str_dedup": (
        _dedup,
        with_(EV, body="SELECT DISTINCT sha256((n % 4)::VARCHAR || chr(31) || message) AS fingerprint FROM ev"),
    ),
    "str_ingest": (
        _ingest,
        with_(EV, IDENTITIES, body="""SELECT n AS record_no, sha256((n % 4)::VARCHAR || chr(31) || source_ip || ' - ' || username || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S')
  || ' +0000] "GET /p/' || (n % 60000) || '?q=' || host || ' HTTP/1.1" ' || CASE outcome WHEN 'success' THEN 200 ELSE 403 END || ' ' || (n % 60000) || ' "-" "agent"') AS fingerprint,
  'PARSED' AS parse_status, us // 1000000 * 1000000 AS us, username, i.id AS identity_id
FROM ev LEFT JOIN identities i USING (username)"""),
    ),
    "str_bursts": (
        _stateful(state.stream_bursts, AUTH1),
        with_(EV, B1, body="""SELECT source_ip AS _k0, host AS _k1, username AS _k2, min(us) AS lo, max(us) AS hi, count(*) AS n
FROM f1_e GROUP BY source_ip, host, username, t0"""),
    ),
    "str_sequence": (
        _stateful(state.stream_sequence, AUTH2),
        with_(EV, P2, body="""SELECT source_ip AS _k0, username AS _k1, host AS _k2, final_us, final_id, count(*) AS n
FROM p2_e GROUP BY source_ip, username, host, final_us, final_id"""),
    ),
    "str_new_value": (
        _stateful(state.stream_new_value, tuned("AUTH-004")),
        with_(EV, NV, body="SELECT username AS _k0, us, id, v AS value, history FROM nv"),
    ),
}
