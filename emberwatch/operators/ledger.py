"""The audit ledger: hash chain, anchors, filters and masking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.text import SECRET_KEY, redact

GENESIS = "0" * 64
#: Sequence numbers in a block, and blocks in a group.
BLOCK, GROUP = 100_000, 1000
HASHED = [
    "id", "occurred_at", "action", "result", "actor_id", "actor_label", "entity_type", "entity_id",
    "client_ip", "request_id", "details",
]
MAX_TEXT, MAX_ITEMS = 300, 20


def entry_hash(prev: Column, get: Callable[[str], Column] = F.col) -> Column:
    """SHA-256 of the previous hash and the entry's fields as one JSON array."""
    parts = [prev.cast("string"), *[get(c).cast("string") for c in HASHED]]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def _ledger(by: list[str]) -> Column:
    """One text for the ledger of an entry; null is a value like others."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in by])) if by else F.lit("")


def _carries(ends: DataFrame, group: int) -> DataFrame:
    """The last hash before each block, from `ends`, a row per block. In a group of blocks it is that of the
    block before; at a group's start it is the last of the nearest earlier group, from a row per group."""
    ends = ends.withColumn("_g", F.expr(f"_b div {group}"))
    tops = ends.groupBy("_l", "_g").agg(F.max_by("_end", "_b").alias("_top"))
    above = F.lag("_top").over(Window.partitionBy("_l").orderBy("_g"))
    inside = F.lag("_end").over(Window.partitionBy("_l", "_g").orderBy("_b"))
    tops = tops.select("_l", "_g", above.alias("_above"))
    return ends.withColumn("_in", inside).join(tops, ["_l", "_g"]).select("_l", "_b", F.coalesce("_in", "_above").alias("_carry"))


def _blocks(log: DataFrame, block: int, by: list[str], group: int) -> DataFrame:
    """Entries with the hash before each. Inside a block of sequence numbers it is the entry before;
    at a block's start it is the last of the nearest earlier block."""
    rows = log.filter("entry_hash is not null").withColumns({"_l": _ledger(by), "_b": F.expr(f"seq div {block}")})
    ends = rows.groupBy("_l", "_b").agg(F.max_by("entry_hash", "seq").alias("_end"))
    inside = Window.partitionBy("_l", "_b").orderBy("seq")
    return (
        rows.withColumn("_lag", F.lag("entry_hash").over(inside))
        .join(_carries(ends, group), ["_l", "_b"])
        .withColumn("expected_prev", F.coalesce("_lag", "_carry", F.lit(GENESIS)))
    )


def check_entries(log: DataFrame, block: int = BLOCK, by: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """Every chained entry with whether its own hash and its link are right; `by` tells ledgers apart, each a
    chain of its own. An entry without a previous hash has no right link."""
    rows = _blocks(log, block, by or [], group)
    return rows.withColumns(
        {
            "hash_ok": F.col("entry_hash") == entry_hash(F.col("prev_hash")),
            "link_ok": F.coalesce(F.col("prev_hash") == F.col("expected_prev"), F.lit(False)),
        }
    ).drop("_l", "_b", "_lag", "_carry")


def _answer() -> list[Column]:
    return [
        F.count("*").alias("chained"),
        F.min(F.when(~(F.col("hash_ok") & F.col("link_ok")), F.col("seq"))).alias("first_broken"),
        F.max("seq").alias("head_seq"),
        F.max_by("entry_hash", "seq").alias("head_hash"),
    ]


def verify_chain(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: chained and legacy entries, first broken one, and the head."""
    checked = check_entries(log, block).agg(*_answer())
    legacy = log.agg(F.count_if(F.col("entry_hash").isNull()).alias("legacy"))
    return checked.withColumn("_one", F.lit(1)).join(legacy.withColumn("_one", F.lit(1)), "_one").drop("_one")


def verify_chains(log: DataFrame, by: list[str], block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """As verify_chain, a row per ledger; one with legacy entries only has no head."""
    checked = check_entries(log, block, by, group).groupBy(*by).agg(*_answer()).withColumn("_l", _ledger(by))
    legacy = log.groupBy(*by).agg(F.count_if(F.col("entry_hash").isNull()).alias("legacy")).withColumn("_l", _ledger(by))
    return legacy.join(checked.drop(*by), "_l", "left").drop("_l").na.fill(0, ["chained"])


def check_anchors(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchored (seq, hash) pairs that the log does not have as they were."""
    stored = log.select("seq", "entry_hash", F.lit(True).alias("_there"))
    rows = anchors.join(stored, "seq", "left")
    problem = F.when(F.col("_there").isNull() | F.col("entry_hash").isNull(), F.lit("missing")).when(
        F.col("entry_hash") != F.col("hash"), F.lit("different")
    )
    return rows.select("seq", problem.alias("problem")).filter("problem is not null")


def filter_audit(
    log: DataFrame,
    actions: list[str] | None = None,
    result: str | None = None,
    actor_id: str | None = None,
    entity_type: str | None = None,
    entity_id: str | None = None,
    since=None,
    until=None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest first; `since` is inclusive, `until` is not."""
    if actions:
        log = log.filter(F.col("action").isin(actions))
    wanted = {"result": result, "actor_id": actor_id, "entity_type": entity_type, "entity_id": entity_id}
    for name, value in wanted.items():
        if value is not None:
            log = log.filter(F.col(name) == value)
    if since is not None:
        log = log.filter(F.col("occurred_at") >= F.lit(since))
    if until is not None:
        log = log.filter(F.col("occurred_at") < F.lit(until))
    return log.orderBy(F.col("occurred_at").desc(), "id").offset(offset).limit(limit)


def redact_columns(log: DataFrame, columns: list[str]) -> DataFrame:
    """Masks tokens, bearer values, URL credentials and key=value secrets in text columns."""
    return log.withColumns({c: redact(F.col(c)) for c in columns})


def safe_details(details: str = "details_map") -> Column:
    """A map of details without secret-looking keys, values masked and shortened."""
    entries = F.slice(F.map_entries(details), 1, MAX_ITEMS)
    kept = F.filter(entries, lambda e: ~e["key"].rlike(SECRET_KEY))
    return F.map_from_entries(
        F.transform(kept, lambda e: F.struct(F.substring(e["key"], 1, 64), F.substring(redact(e["value"]), 1, MAX_TEXT)))
    )
