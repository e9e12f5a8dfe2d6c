"""Allowlists as tables: events that an entry covers leave by joins, however many entries there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.net import address_bits
from emberwatch.functions.text import fold

NAMES = ["username", "target_username", "host"]
SCHEMA = "field string, value string, active_from timestamp, active_until timestamp"


def _wrong(entries: DataFrame) -> Column:
    start, end = F.col("active_from"), F.col("active_until")
    known = F.col("field").isin("source_ip", *NAMES) & F.col("value").isNotNull()
    window = (start.isNull() & end.isNull()) | (start < end)
    network = (F.col("field") != "source_ip") | (F.col("bits").isNotNull() & F.col("length").between(0, F.length("bits")))
    return ~(F.coalesce(known, F.lit(False)) & F.coalesce(window, F.lit(False)) & F.coalesce(network, F.lit(False)))


def exclude_listed(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Events that no entry covers. `entries`: field (source_ip, username, target_username or host), value
    (an address or network for source_ip) and a window of event time, or nulls for always.

    Names meet in one anti join per field, networks in one per address version and prefix length that occur,
    on the leading bits; so the plan does not grow with the list, and a join's sizes decide how it
    runs. A wrong entry fails the query. No entries keep all events; a null or unreadable value of an event is
    never covered."""
    network = F.col("field") == "source_ip"
    parts = entries.select(
        "field", "value", "active_from", "active_until",
        F.when(network, address_bits(F.split_part("value", F.lit("/"), F.lit(1)))).alias("bits"),
        F.when(F.col("value").contains("/"), F.split_part("value", F.lit("/"), F.lit(2)).try_cast("int")).alias("given"),
    )
    parts = parts.withColumn("length", F.when(F.col("value").contains("/"), F.col("given")).otherwise(F.length("bits")))
    if wrong := parts.filter(_wrong(parts)).select("field", "value").first():
        raise ValueError(f"not an allowlist entry: {wrong['field']!r} {wrong['value']!r}")
    kinds = parts.select("field", F.length("bits").alias("size"), F.when(network, F.col("length")).alias("length")).distinct()
    bits = address_bits(F.col("source_ip"))
    for kind in sorted(kinds.collect(), key=str):  # three names, 33 and 129 prefix lengths at most
        mine = parts.filter(F.col("field") == kind["field"])
        if kind["field"] == "source_ip":
            mine = mine.filter((F.length("bits") == kind["size"]) & (F.col("length") == kind["length"]))
            key = F.substring("bits", 1, kind["length"])
            have = F.when(F.length(bits) == kind["size"], F.substring(bits, 1, kind["length"]))
        else:
            key, have = fold("value"), fold(kind["field"])
        listed = mine.select(key.alias("_listed"), F.col("active_from").alias("_from"), F.col("active_until").alias("_until"))
        within = F.col("_from").isNull() | ((F.col("timestamp") >= F.col("_from")) & (F.col("timestamp") < F.col("_until")))
        events = events.join(listed.distinct(), (have == F.col("_listed")) & within, "left_anti")
    return events
