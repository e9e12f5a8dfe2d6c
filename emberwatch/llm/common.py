"""Helpers of the operators here: tables, the run folder, text that every operator reads alike."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberwatch.lineage import checkpoint_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Stands for a null id where rows pass through pandas, which has no null for whole numbers.
NO_ID = -(2**63)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a given table; others, whatever their names, are never read."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def run_folder(spark: SparkSession) -> str:
    """A new folder of the shared one that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_folder(spark).rstrip('/')}/emberwatch-llm/{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written once as Parquet in the run folder and read back, so that losing an executor
    later repeats a read and not the work before it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only if a count shows that it has few rows (of some numbers each);
    otherwise left to a shuffled join. df must be cheap to count: a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root: for each node of the edges (a, b; longs) the smallest node that it reaches.

    Rounds of large and small stars until nothing changes: every edge is moved to the smallest
    neighbour of one of its ends. No node's neighbours are gathered, only their minimum is. Minima
    are broadcast while few edges are left, and joined by a shuffle beyond that."""

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        total = F.sum(F.expr("cast(xxhash64(a, b) AS decimal(38, 0))"))
        df = df.where("a <> b").distinct().observe(seen, F.count("*").alias("n"), total.alias("total"))
        return staged(df, folder, name), (seen.get["n"], seen.get["total"])

    now, before = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    turn = 0
    while True:
        size = F.broadcast if 2 * before[0] <= BROADCAST_ROWS else (lambda df: df)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(size(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large, folder, f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(size(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, after = kept(small.unionByName(least.select("a", F.col("m").alias("b"))), f"small{turn}")
        if after == before:
            break
        before, turn = after, turn + 1
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
