"""Continuous forms of ingest, detection and summaries.

Jobs that write use foreachBatch and put each micro-batch into its own `stream_batch` folder, written
whole: a batch that is retried after a failure replaces what it left, and reads nothing of itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.lineage import checkpoint_folder, cut, stored
from emberwatch.operators.ingest import fingerprint, ingest
from emberwatch.operators.reports import daily_counts, logon_success_daily, merge_daily_counts, merge_logons
from emberwatch.plans.run import evidence_of
from emberwatch.operators.explain import build_detections

BATCH = "stream_batch"


def _write(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={epoch}")


def _others(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """What other batches stored, or None before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path).filter(F.col(BATCH) != epoch)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None, **trigger):
    """Starts `step` for every micro-batch; the default trigger takes what is there and ends."""
    folder = checkpoint or f"{checkpoint_folder(stream.sparkSession)}/{name}"
    writer = stream.writeStream.queryName(name).option("checkpointLocation", folder)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(step).start()


# ---------- ingest ----------


class Prints:
    """The fingerprints of all stored records, by batch and bucket (their first hexadecimal digits; more
    of them for a larger store), and beside them a filter per bucket: 2**20 bits of which each fingerprint sets two, kept as the words that are not zero.

    A batch first asks the filters of its own buckets, then reads only the buckets that may hold a record of
    it: new records read next to nothing, however much is stored. Each batch writes folders of its own."""

    def __init__(self, path: str, digits: int = 1) -> None:
        self.prints, self.filters, self.digits = f"{path}/prints", f"{path}/filters", digits

    def bucket(self) -> Column:
        return F.concat(F.lit("p"), F.substring("fingerprint", 1, self.digits)).alias("bucket")

    def _slots(self, prints: DataFrame) -> DataFrame:
        """fingerprint, bucket, place, bit, twice: a fingerprint's digits are as good as a hash."""
        slot = lambda at: F.conv(F.substring("fingerprint", at, 5), 16, 10).cast("bigint")
        rows = prints.select("fingerprint", self.bucket(), F.explode(F.array(slot(11), slot(16))).alias("slot"))
        bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))").alias("bit")
        return rows.select("fingerprint", "bucket", F.expr("slot div 64").alias("place"), bit)

    @staticmethod
    def _buckets(rows: DataFrame) -> list[str]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # 16 ** digits at most

    def known(self, prints: DataFrame, epoch: int) -> DataFrame | None:
        """The stored fingerprints among these, of other batches; None if there cannot be any."""
        spark = prints.sparkSession
        filters = _others(spark, self.filters, epoch)
        if filters is None:
            return None
        asked = stored(self._slots(prints))
        words = filters.where(F.col("bucket").isin(self._buckets(asked)))
        words = words.groupBy("bucket", "place").agg(F.bit_or("bits").alias("bits"))
        met = asked.join(words, ["bucket", "place"], "left")
        met = met.groupBy("fingerprint", "bucket").agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("met"))
        maybe = stored(met.where("met").drop("met"))
        buckets = self._buckets(maybe)
        if not buckets:
            return None
        return _others(spark, self.prints, epoch).where(F.col("bucket").isin(buckets)).select("fingerprint")

    def add(self, prints: DataFrame, epoch: int) -> None:
        rows = prints.select("fingerprint", self.bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.prints}/{BATCH}={epoch}")
        words = self._slots(prints).groupBy("bucket", "place").agg(F.bit_or("bit").alias("bits"))
        words.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.filters}/{BATCH}={epoch}")


def ingest_step(sources: DataFrame, assets: DataFrame, identities: DataFrame, raw_path: str, events_path: str, digits: int = 1):
    """Evidence first, then events; records stored by any other batch are not taken again. Fingerprints are kept
    beside the raw records."""
    prints = Prints(f"{raw_path.rstrip('/')}-prints", digits)

    def step(records: DataFrame, epoch: int) -> None:
        records = records.withColumn("fingerprint", fingerprint())
        _, raw, events = ingest(records, sources, assets, identities, prints.known(records.select("fingerprint").distinct(), epoch))
        _write(raw, raw_path, epoch)
        _write(events, events_path, epoch)
        # Last: a batch that fails before this is taken again whole.
        prints.add(raw, epoch)

    return step


def stream_ingest(stream: DataFrame, sources: DataFrame, assets: DataFrame, identities: DataFrame, raw_path: str, events_path: str, name: str = "ingest", **options):
    return run_batches(stream, ingest_step(sources, assets, identities, raw_path, events_path), name, **options)


def stream_dedup(stream: DataFrame, within: str) -> DataFrame:
    """Resent records dropped while the first copy is at most `within` old; state is bounded by it.
    stream_ingest is exact for any age."""
    rows = stream.withColumn("fingerprint", fingerprint())
    return rows.withWatermark("received_at", within).dropDuplicatesWithinWatermark(["fingerprint"])


# ---------- summaries ----------


def summary_step(path: str):
    """Partial sums of each batch; `read_summaries` adds them."""

    def step(events: DataFrame, epoch: int) -> None:
        # Events that carry their receive time are counted by it; others by their own time.
        received = "received_at" if "received_at" in events.columns else "timestamp"
        raw = events.select(F.col(received).alias("received_at"))
        _write(daily_counts(events, raw), f"{path}/daily", epoch)
        _write(logon_success_daily(events), f"{path}/logons", epoch)

    return step


def stream_daily_summaries(events: DataFrame, path: str, name: str = "summaries", **options):
    return run_batches(events, summary_step(path), name, **options)


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    daily = spark.read.parquet(f"{path}/daily").drop(BATCH)
    logons = spark.read.parquet(f"{path}/logons").drop(BATCH)
    empty = lambda df: df.limit(0)
    return merge_daily_counts(daily, empty(daily)), merge_logons(logons, empty(logons))


# ---------- detection, exact for any lateness ----------


def detect_step(rules: list[dict], events_path: str, out_path: str):
    """Stores the batch, reads stored events around its span again, and keeps detections that touch
    it. Late events are therefore never lost."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mine = batch.withColumn("batch_id", F.lit(f"stream-{epoch}"))
        _write(mine, events_path, epoch)
        span = mine.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
        if span["a"] is None:
            return
        stored = spark.read.parquet(events_path).drop(BATCH)
        # A run over the span of the batch: each rule reads as far around it as it reaches, and a
        # new-value rule reports what is new within the span, measured by its lookback before it.
        evidence = evidence_of(stored, rules, span["a"], span["b"])
        found = build_detections(cut(evidence), rules)
        _write(found.filter(F.array_contains("batch_ids", f"stream-{epoch}")), out_path, epoch)

    return step


def stream_detect(events: DataFrame, rules: list[dict], events_path: str, out_path: str, name: str = "detect", **options):
    return run_batches(events, detect_step(rules, events_path, out_path), name, **options)
