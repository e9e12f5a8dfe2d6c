"""Time slices: how a key with very many rows is spread over tasks.

A window function over `partitionBy(key)` puts all rows of a key into one task. Here a key's
timeline is cut into slices, each (key, slice) is its own partition, and rows near a border are
copied to the neighbouring slice (`reach`), so every row sees all rows within reach of it.
What must cross more than one slice (a burst that goes on, a running count) is carried by one
small row per (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def width_for(reach: int) -> int:
    """Slices several times wider than the reach, so few rows are copied."""
    return max(4 * reach, HOUR)


def slice_of(us: Column, width: int) -> Column:
    w = F.lit(width).cast("bigint")
    return F.floor((us - F.pmod(us, w)) / w).cast("bigint")


def own_slice(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("_s", slice_of(F.col("us"), width))


def look_back(rows: DataFrame, width: int, reach: int) -> DataFrame:
    """Adds `_s` and `_own`; each slice also gets the rows up to `reach` before it. The width
    must not be smaller than the reach."""
    s = slice_of(F.col("us"), width)
    copy = F.when(F.col("us") + reach >= (s + 1) * width, F.struct((s + 1).alias("s"), F.lit(False)))
    places = F.array_compact(F.array(F.struct(s.alias("s"), F.lit(True)), copy))
    placed = rows.withColumn("_p", F.explode(places))
    return placed.select(
        *rows.columns, F.col("_p.s").alias("_s"), F.col("_p.col2").alias("_own")
    )


def look_ahead(rows: DataFrame, width: int, reach: int) -> DataFrame:
    """As look_back, with the rows up to `reach` after a slice."""
    s = slice_of(F.col("us"), width)
    copy = F.when(F.col("us") - reach < s * width, F.struct((s - 1).alias("s"), F.lit(False)))
    places = F.array_compact(F.array(F.struct(s.alias("s"), F.lit(True)), copy))
    placed = rows.withColumn("_p", F.explode(places))
    return placed.select(
        *rows.columns, F.col("_p.s").alias("_s"), F.col("_p.col2").alias("_own")
    )


def by_slice(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys, "_s").orderBy(*order)


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One exchange that serves every window over (keys, slice, anything)."""
    return rows.repartition(*keys, "_s")


def prefix_counts(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Per (keys, slice): the total of `amount` in all earlier slices (`_before`). The input is
    summed per slice before it is moved."""
    per = rows.groupBy(*keys, "_s").agg(F.sum(amount).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *keys, "_s", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")
    )


def sessions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the slice-local pieces of gap-separated sessions.

    `rows`: own rows with `us`, `_s`, `_start` (first row of a session) and `_hit`. Returns one
    row per session that has a hit: its first hit `t0` and its last time `hi`."""
    w = by_slice(keys, "us", "id").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        rows.withColumn("_piece", F.max(F.when(F.col("_start"), F.col("us"))).over(w))
        .groupBy(*keys, "_s", "_piece")
        .agg(F.min(F.when(F.col("_hit"), F.col("us"))).alias("t0"), F.max("us").alias("hi"))
    )
    stitched = Window.partitionBy(*keys).orderBy("_s", F.col("_piece").asc_nulls_first())
    running = F.last("_piece", ignorenulls=True).over(
        stitched.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        pieces.withColumn("_session", running)
        .groupBy(*keys, "_session")
        .agg(F.min("t0").alias("t0"), F.max("hi").alias("hi"))
        .filter(F.col("t0").isNotNull())
        .drop("_session")
    )


def rows_in_spans(rows: DataFrame, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows whose time lies in a span (`lo`..`hi`) of their key, joined slice by slice. Spans of
    one key must not overlap by more than a few per slice."""
    placed = spans.withColumn(
        "_s", F.explode(F.sequence(slice_of(F.col("lo"), width), slice_of(F.col("hi"), width)))
    )
    return (
        own_slice(rows, width)
        .join(placed, [*keys, "_s"])
        .filter(F.col("us").between(F.col("lo"), F.col("hi")))
        .drop("_s")
    )
