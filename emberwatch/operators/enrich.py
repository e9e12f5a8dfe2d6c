"""Context from the inventory, attached to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.net import ip_scope
from emberwatch.schema import INTERNAL_NETWORKS


def short_name(host: Column) -> Column:
    return F.split_part(host, F.lit("."), F.lit(1))


def with_ip_scope(df: DataFrame, internal: list[str] = INTERNAL_NETWORKS) -> DataFrame:
    return df.withColumn("source_ip_scope", ip_scope(F.col("source_ip"), internal))


def match_assets(hosts: DataFrame, assets: DataFrame) -> DataFrame:
    """(host, host_ip) pairs to `asset_id`: the exact name, then the short label as a full name, then
    the only asset with that label, then the address (the first listed asset wins)."""
    names = assets.groupBy(F.col("hostname").alias("name")).agg(F.min("id").alias("asset"))
    labels = (
        assets.groupBy(short_name(F.col("hostname")).alias("name"))
        .agg(F.min("id").alias("asset"), F.count("*").alias("n"))
        .filter("n = 1")
        .select("name", "asset")
    )
    short = names.unionByName(labels.join(names, "name", "left_anti"))
    addresses = assets.select(F.col("id"), F.explode("ip_addresses").alias("name")).groupBy("name").agg(
        F.min("id").alias("asset")
    )
    pairs = hosts.select("host", "host_ip").distinct()
    for alias, table, key in (
        ("_exact", names, F.col("host")),
        ("_short", short, short_name(F.col("host"))),
        ("_ip", addresses, F.col("host_ip")),
    ):
        found = table.select(F.col("name").alias("_name"), F.col("asset").alias(alias))
        pairs = pairs.join(found, key == F.col("_name"), "left").drop("_name")
    host = F.col("host").isNotNull() & (F.col("host") != "")
    by_name = F.when(host, F.coalesce("_exact", "_short"))
    return pairs.select("host", "host_ip", F.coalesce(by_name, "_ip").alias("asset_id"))


def with_asset(df: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds asset_id and asset_criticality. Names are resolved once per distinct host, then
    joined to the rows."""
    levels = assets.select(F.col("id").alias("asset_id"), F.col("criticality").alias("asset_criticality"))
    resolved = match_assets(df, assets).filter("asset_id is not null").join(levels, "asset_id")
    resolved = resolved.select(F.col("host").alias("_h"), F.col("host_ip").alias("_i"), "asset_id", "asset_criticality")
    rows = df.drop("asset_id", "asset_criticality")
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("host_ip").eqNullSafe(F.col("_i"))
    return rows.join(resolved, same, "left").drop("_h", "_i")


def with_identity(df: DataFrame, identities: DataFrame) -> DataFrame:
    """Adds identity_id and identity_privileged by exact username."""
    known = identities.select(
        "username",
        F.col("id").alias("identity_id"),
        (F.col("privilege_level") == "privileged").alias("identity_privileged"),
    )
    return df.drop("identity_id", "identity_privileged").join(known, "username", "left")


def enrich(
    df: DataFrame, assets: DataFrame, identities: DataFrame, internal: list[str] = INTERNAL_NETWORKS
) -> DataFrame:
    return with_identity(with_asset(with_ip_scope(df, internal), assets), identities)
