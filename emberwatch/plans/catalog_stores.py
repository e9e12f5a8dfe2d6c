"""What the writers store, read back by the readers: sample rows written to a folder of the run."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from emberwatch.lineage import checkpoint_folder
from emberwatch.plans.catalog_detect import END, RANGE, START
from emberwatch.plans.oracle import EV, with_
from emberwatch.sources import readers, sample, writers

LINE = """source_ip || ' - ' || username || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /p/' || (n % 60000) || '?q=' || host
  || ' HTTP/1.1" ' || CASE outcome WHEN 'success' THEN 200 ELSE 403 END || ' ' || (n % 60000) || ' "-" "agent"'"""
PER_PAYLOAD = 100


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def _lines(s, d):
    """Access-log lines as text files: a third end in CR LF, and every fifth is followed by a blank line."""
    out, text = _folder(s, "lines"), F.col("raw_data").cast("string")
    ended = F.when(F.col("record_no") % 3 == 0, F.concat(text, F.lit("\r"))).otherwise(text)
    blank = F.when(F.col("record_no") % 10 == 0, F.lit("")).when(F.col("record_no") % 5 == 0, F.lit(" \t"))
    rows = sample.raw_records(s, d, "http_access").select(F.explode(F.array_compact(F.array(ended, blank))).alias("value"))
    rows.write.text(out)
    read = readers.read_log_lines(s, out)
    return read.select(F.sha2("raw_data", 256).alias("line"), "is_valid_utf8")


def _arrays(s, d):
    """Access-log lines as payloads of so many records, one per file."""
    out = _folder(s, "payloads")
    rows = sample.raw_records(s, d, "http_access").withColumn("payload", F.expr(f"record_no div {PER_PAYLOAD}"))
    listed = F.array_sort(F.collect_list(F.struct("record_no", F.col("raw_data").cast("string").alias("text"))))
    payloads = rows.groupBy("payload").agg(listed.alias("rows"))
    payloads = payloads.select(F.to_json(F.struct(F.col("rows.text").alias("records"))).alias("value"))
    payloads.write.option("maxRecordsPerFile", 1).text(out)
    return readers.read_record_arrays(s, out).select("record_no", F.sha2("raw_data", 256).alias("line"))


def _raw(s, d):
    """Raw records of two formats, in two batches; one format of some days read back."""
    out = _folder(s, "raw")
    for kind in ("http_access", "generic_json"):
        writers.write_raw(sample.raw_records(s, d, kind), out)
    stored = s.read.parquet(out).filter("received_date BETWEEN '2024-01-08' AND '2024-01-12' AND source_type = 'http_access'")
    return stored.select("record_no", F.col("received_date").cast("string").alias("day"), F.sha2("raw_data", 256).alias("line"))


def _events(s, d):
    """The event store in two appends, read back by range and category; only its days are read."""
    out, events = _folder(s, "events"), sample.events(s, d)
    for half in (0, 1):
        writers.write_events(events.filter(F.col("id").cast("bigint") % 2 == half), out, 500)
    stored = readers.scan_events(s.read.parquet(out), START, END, event_category="authentication")
    return stored.select("id", F.col("event_date").cast("string").alias("day"), "username")


def _snapshots(s, d):
    """Two versions of a table; the first one stays as it was."""
    out, events = _folder(s, "versions"), sample.events(s, d)
    counted = events.groupBy("event_category").agg(F.count("*").alias("n"))
    first = writers.write_snapshot(counted, out, "1")
    second = writers.write_snapshot(counted.filter("event_category != 'iam'").withColumn("n", F.col("n") + 1), out, "2")
    writers.write_snapshot(counted.filter("event_category != 'iam'"), out, "2")  # a version written again is replaced
    read = lambda path, v: s.read.parquet(path).withColumn("version", F.lit(v))
    return read(first, 1).unionByName(read(second, 2))


QUERIES: dict[str, tuple] = {
    "src_log_lines": (_lines, with_(EV, body=f"SELECT sha256({LINE}) AS line, TRUE AS is_valid_utf8 FROM ev")),
    "src_record_arrays": (
        _arrays,
        with_(EV, body=f"""SELECT row_number() OVER (PARTITION BY n // {PER_PAYLOAD} ORDER BY n) - 1 AS record_no, sha256({LINE}) AS line FROM ev"""),
    ),
    "snk_raw": (
        _raw,
        with_(EV, body=f"""SELECT n AS record_no, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, sha256({LINE}) AS line FROM ev
WHERE CAST(ts + INTERVAL 1 HOUR AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'"""),
    ),
    "snk_events": (
        _events,
        with_(EV, body=f"SELECT id, strftime(ts, '%Y-%m-%d') AS day, username FROM ev WHERE {RANGE} AND category = 'authentication'"),
    ),
    "snk_snapshot": (
        _snapshots,
        with_(EV, body="""SELECT category AS event_category, count(*) AS n, 1 AS version FROM ev GROUP BY 1
UNION ALL SELECT category, count(*), 2 FROM ev WHERE category <> 'iam' GROUP BY 1"""),
    ),
}
