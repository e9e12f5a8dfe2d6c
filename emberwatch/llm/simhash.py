"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in three bits at most; exact.

A fingerprint has a bit where more than half of the hashes of a text's three-word shingles have it.
Equal fingerprints are one node. Two that differ in three bits agree in one of four 16-bit blocks, so
nodes are dealt by (block, its value): a bucket. A bucket is compared in tiles in the order of the bit
counts, by exclusive-or and bit count in numpy; pairs of tiles whose bit counts are further apart than the
radius are left out. A bucket beyond TILE nodes is cut by bit count and hash into tiles, and only
pairs of tiles within the radius meet, each pair in a cell of its own. A cell gives a forest of its
links, not all its pairs, so a group of near copies costs as many edges as it has nodes.

Null text, empty text and text without words have fingerprint zero and are linked like any other.
Rows with a null doc_id have a fingerprint, link nothing and have a null component_id. Rows that
repeat a doc_id are one document with the links of all its rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID, components, run_folder, small_or_shuffled, staged

WIDTH, SEED, RADIUS = 3, 42, 3
TILE = 4096
#: Nodes to a side of one numpy comparison: its matrix of 64-bit numbers stays in the cache.
STEP = 256
_BLOCK = 65536


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, "i8")
    while part := [digest(line[a:b], SEED) for a, b in islice(spans, _BLOCK)]:
        counts += np.unpackbits(np.array(part, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i4")
    bits = 2 * counts > len(words) - width + 1
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.array([fingerprint(t, width) for t in frame["text"]], "u8")
            yield pd.DataFrame({"doc": frame["doc"].to_numpy("i8"), "fp": found.view("i8")})

    return run


class Forest:
    """Connected rows of one batch of cells: each row names the first row it is connected with."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def _meet(fp: np.ndarray, side: np.ndarray, radius: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the row pairs (a, b) are links: near enough, and not both of one side of a cell."""
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    return near & ((side[a] != side[b]) | (side[a] == 2))


def compare(cell: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked in whole cells. Rows come by cell, then by bit count."""
    ones, n = np.bitwise_count(fp).astype("i2"), len(fp)
    forest = Forest(n)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[first, n])
    of_row = np.repeat(sizes, sizes)
    small = np.flatnonzero(of_row <= STEP // 4)
    for d in range(1, STEP // 4):
        small = small[small + d < n]
        small = small[cell[small] == cell[small + d]]
        if not len(small):
            break
        hit = small[_meet(fp, side, radius, small, small + d)]
        forest.join(hit, hit + d)
    for at, size in zip(first[sizes > STEP // 4], sizes[sizes > STEP // 4], strict=True):
        for a in range(at, at + size, STEP):
            to = min(a + STEP, at + size)
            for b in range(a, at + size, STEP):
                if ones[b] - ones[to - 1] > radius:
                    break
                upto = min(b + STEP, at + size)
                i, j = np.nonzero(np.bitwise_count(fp[a:to, None] ^ fp[None, b:upto]) <= radius)
                i, j = i + a, j + b
                keep = (i < j) & ((side[i] != side[j]) | (side[i] == 2)) & (forest.root[i] != forest.root[j])
                forest.join(i[keep], j[keep])
    moved = np.flatnonzero(forest.root != np.arange(n))
    return fp[moved], fp[forest.root[moved]]


def _cells(radius: int):
    """Rows sorted by cell: whole cells are compared as soon as they are there."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy("i8").view("u8")
        a, b = compare(rows["cell"].to_numpy("i8"), fp, rows["side"].to_numpy("i4"), radius)
        return pd.DataFrame({"a": a.view("i8"), "b": b.view("i8")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = int(np.searchsorted(frame["cell"].to_numpy("i8"), frame["cell"].iloc[-1]))
            if last or (waiting and waiting[-1]["cell"].iloc[-1] != frame["cell"].iloc[0]):
                yield done(pd.concat([*waiting, frame.iloc[:last]], ignore_index=True))
                waiting = []
            waiting.append(frame.iloc[last:])
        if waiting:
            yield done(pd.concat(waiting, ignore_index=True))

    return run


def _placed(nodes: DataFrame, folder: str, radius: int, tile: int) -> DataFrame:
    """cell, ones, fp, side: every node in its bucket of each block, large buckets as pairs of tiles.
    Side 2 meets all of its cell, 0 and 1 meet each other. Two cells under one hash would only compare more."""
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(_BLOCK - 1)) + k * _BLOCK
    buckets = F.explode(F.array(*[block(k) for k in range(radius + 1)]))
    rows = nodes.select("fp", F.bit_count("fp").alias("ones"), buckets.alias("bucket"))
    # At most (radius + 1) * 65536 buckets, whatever the input.
    sizes = staged(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile), folder, "large")
    small = rows.join(F.broadcast(sizes), "bucket", "left_anti")
    small = small.select(F.xxhash64("bucket").alias("cell"), "ones", "fp", F.lit(2).alias("side"))
    large = rows.join(F.broadcast(sizes.select("bucket")), "bucket")
    counted = large.groupBy("bucket", "ones").agg(F.count("*").alias("n"))
    chunks = small_or_shuffled(staged(counted.select("bucket", "ones", F.ceil(F.col("n") / tile).alias("chunks")), folder, "tiles"))
    own = large.join(chunks, ["bucket", "ones"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks"))).drop("chunks")
    other = chunks.select(
        "bucket", F.col("ones").alias("there"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    )
    other = small_or_shuffled(staged(other, folder, "others"))
    pairs = own.join(other, "bucket").where(F.abs(F.col("ones") - F.col("there")) <= radius)
    mine, theirs = F.struct("ones", "own"), F.struct(F.col("there").alias("ones"), F.col("chunk").alias("own"))
    side = F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1)
    cell = F.xxhash64("bucket", F.least(mine, theirs), F.greatest(mine, theirs))
    return small.unionByName(pairs.select(cell.alias("cell"), "ones", "fp", side.alias("side")))


def link(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    if not 0 <= radius <= 3:
        raise ValueError("a radius beyond three bits needs more blocks than the four of a fingerprint")
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    found = staged(texts.mapInPandas(_fingerprints(width), "doc long, fp long"), folder, "fingerprints")
    named = found.where(F.col("doc") != NO_ID)
    nodes = staged(named.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("n")), folder, "nodes")
    rows = _placed(nodes, folder, radius, tile)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(parts, "cell").sortWithinPartitions("cell", "ones", "fp")
    links = sorted_rows.mapInPandas(_cells(radius), "a long, b long")
    several = named.groupBy("doc").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c").drop("c")
    several = small_or_shuffled(staged(several, folder, "several"))
    same_doc = named.join(several, "doc").select(F.col("fp").alias("a"), "b").where("a <> b")
    reached = staged(components(staged(links.unionByName(same_doc), folder, "links"), f"{folder}/parts"), folder, "reached")
    linked = staged(nodes.join(small_or_shuffled(reached.withColumnRenamed("node", "fp")), "fp"), folder, "linked")
    least = small_or_shuffled(staged(linked.groupBy("root").agg(F.min("first").alias("component")), folder, "least"))
    of_linked = linked.join(least, "root").select("fp", "component")
    alone = nodes.where("n > 1").join(small_or_shuffled(linked.select("fp")), "fp", "left_anti")
    groups = of_linked.unionByName(alone.select("fp", F.col("first").alias("component")))
    groups = small_or_shuffled(staged(groups, folder, "groups"))
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return found.join(groups, "fp", "left").select(
        doc.alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(doc.isNotNull(), F.coalesce("component", doc)).alias("component_id"),
    )
