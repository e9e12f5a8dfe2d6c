"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of a given length that
are found in a given number of documents lose all their lines, except in the largest doc_id that
holds them. All distinct keys are counted, then indexed by a sharded minimal perfect hash: per
shard some bit levels, and arrays of fingerprints, counts and largest ids. Documents do not join
lines. They send packed bundles of hashes to the shards, where a bundle is looked up in the
arrays, and get back only the hashes that they lose.

A common line is one entry per bundle with the ids of its documents, and bundles of one shard are
spread over `salts` tasks, each with the shard's arrays, read as a stream: no task holds a group.

Null or empty text is one empty line. Repeated rows with one doc_id count as one document and are
cut alike; rows with a null doc_id are together one document that any other id exceeds. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID, run_folder, staged

MIN_POINTS, MIN_DOCS = 40, 5
SHARD_KEYS, SALTS = 50_000, 8
_STRIP = b" \t\n\x0b\x0c\r"
MADE = [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def key_hash(line: bytes, min_points: int = MIN_POINTS) -> bytes | None:
    """128 bits of a line's key, or null for a short one."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_points or (len(key) < 4 * min_points and len(key.decode()) < min_points):
        return None
    return xxhash.xxh3_128_digest(key)


def _hashes(min_points: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = []
            for text in frame["text"]:
                found = {key_hash(x, min_points) for x in (text or "").encode().split(b"\n")}
                packed.append(b"".join(sorted(found - {None})))
            yield pd.DataFrame({"doc": frame["doc"], "packed": packed})

    return run


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys = np.frombuffer(b"".join(frame["packed"]), "<i8").reshape(-1, 2)
        docs = np.repeat(frame["doc"].to_numpy("i8"), [len(p) // 16 for p in frame["packed"]])
        yield pd.DataFrame({"hi": keys[:, 0], "lo": keys[:, 1], "doc": docs})


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.array([level], "u8") * np.uint64(0x9E3779B97F4A7C15)  # arrays wrap around silently
    mixed = (keys["hi"] + step) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= (mixed >> np.uint64(32)) ^ keys["lo"]
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype("i8")


def build_shard(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit levels of a minimal perfect hash over different keys, and each key's number.

    A key sits at the first level where no other key shares its bit; twice as many bits as keys
    that are left make a level, so that each takes in more than half of them."""
    levels, left, number, taken = [], np.arange(len(keys)), np.empty(len(keys), "i8"), 0
    while len(left):
        size = 2 * len(left) + 1
        at = _place(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        sits = alone[at]
        number[left[sits]] = taken + (np.cumsum(alone) - 1)[at[sits]]
        taken += int(alone.sum())
        left = left[~sits]
    return levels, number


class Shard:
    """Arrays of one shard, ready for look-ups. An unknown key meets a foreign fingerprint."""

    def __init__(self, levels: list[np.ndarray], marks: np.ndarray, counts: np.ndarray, largest: np.ndarray):
        self.levels, self.marks, self.counts, self.largest = levels, marks, counts, largest
        taken, self.ranks = 0, []
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - 1 + taken)
            taken += int(bits.sum())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1 for a key that is not in the shard."""
        number, left = np.full(len(keys), -1, "i8"), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _place(keys[left], level, len(bits))
            sits = bits[at]
            number[left[sits]] = ranks[at[sits]]
            left = left[~sits]
        if len(self.marks):
            number[(number >= 0) & (self.marks[number] != keys["lo"])] = -1
        return number

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> Shard:
        levels, number = build_shard(keys)
        order = np.argsort(number)
        return Shard(levels, keys["lo"][order], counts[order], largest[order])

    def pack(self) -> bytes:
        sizes = np.array([len(self.marks), *map(len, self.levels)], "<i8")
        parts = [np.array([len(sizes)], "<i8"), sizes, self.marks.astype("<u8"), self.counts.astype("<i8")]
        parts += [self.largest.astype("<i8"), *[np.packbits(b) for b in self.levels]]
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def unpack(data: bytes) -> Shard:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        at, arrays = 8 + 8 * n, []
        for kind in ("<u8", "<i8", "<i8"):
            arrays.append(np.frombuffer(data, kind, sizes[0], at))
            at += 8 * int(sizes[0])
        levels = []
        for size in map(int, sizes[1:]):
            packed = np.frombuffer(data, "u1", (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += (size + 7) // 8
        return Shard(levels, *arrays)


def _index(frame: pd.DataFrame) -> pd.DataFrame:
    keys = np.empty(len(frame), KEY)
    keys["hi"], keys["lo"] = frame["hi"].to_numpy().view("u8"), frame["lo"].to_numpy().view("u8")
    shard = Shard.build(keys, frame["n_docs"].to_numpy(), frame["largest"].to_numpy())
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "data": [shard.pack()]})


def _bundles(shards: int):
    """Packs the hashes of a batch of documents by shard: each hash once, with its documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = np.frombuffer(b"".join(frame["packed"]), KEY)
            docs = np.repeat(frame["doc"].to_numpy("i8"), [len(p) // 16 for p in frame["packed"]])
            order = np.lexsort((docs, keys["lo"], keys["hi"], keys["hi"] % np.uint64(shards)))
            keys, docs = keys[order], docs[order]
            where = keys["hi"] % np.uint64(shards)
            edges = np.flatnonzero(np.diff(where)) + 1
            rows = []
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if a < b:
                    first = np.r_[True, keys[a + 1 : b] != keys[a : b - 1]]
                    counts = np.diff(np.r_[np.flatnonzero(first), b - a])
                    data = np.array([len(counts)], "<i8").tobytes() + keys[a:b][first].tobytes()
                    rows.append((int(where[a]), data + counts.astype("<i8").tobytes() + docs[a:b].tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "data"])

    return run


def _look_up(min_docs: int):
    """Rows of a task in order: a shard's arrays, then the bundles for it, one after another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for frame in frames:
            for kind, data in zip(frame["kind"], frame["data"], strict=True):
                if kind == 0:
                    shard = Shard.unpack(data)
                    continue
                n = int(np.frombuffer(data, "<i8", 1)[0])
                keys = np.frombuffer(data, KEY, n, 8)
                counts = np.frombuffer(data, "<i8", n, 8 + 16 * n)
                docs = np.frombuffer(data, "<i8", -1, 8 + 24 * n)
                number = shard.find(keys)
                lost = (number >= 0) & (shard.counts[number] >= min_docs)
                each = np.repeat(lost, counts)
                keep = np.repeat(shard.largest[number], counts) == docs
                hits = np.repeat(keys, counts)[each & ~keep]
                yield pd.DataFrame(
                    {"doc": docs[each & ~keep], "hit": [h.tobytes() for h in hits]}
                )

    return run


def _cut(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, hits in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if hits:
                    gone = set(hits)
                    kept = [x for x in lines if key_hash(x, min_points) not in gone]
                data = b"\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(data).hexdigest(), data.decode()))
            made = [list(column) for column in zip(*rows, strict=True)] or [[], [], [], []]
            arrays = [pa.array(x, kind) for x, (_, kind) in zip(made, MADE, strict=True)]
            rest = [name for name in batch.schema.names if name not in ("text", "hits")]
            yield pa.RecordBatch.from_arrays(
                arrays + [batch[name] for name in rest], names=[name for name, _ in MADE] + rest
            )

    return run


def shared_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For each document that loses lines: doc and the hashes that it loses."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), "text")
    packed = staged(ids.mapInPandas(_hashes(min_points), "doc long, packed binary"), folder, "packed")
    packed = packed.where("length(packed) > 0")
    lines = packed.mapInPandas(_unpack, "hi long, lo long, doc long")
    counted = lines.groupBy("hi", "lo").agg(
        F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("largest")
    )
    counted = staged(counted, folder, "counted")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    # hi is unsigned in the shards' arithmetic.
    shard = F.expr(f"pmod(pmod(shiftrightunsigned(hi, 1), {shards}) * 2 + (hi & 1), {shards})")
    index = counted.withColumn("shard", shard).groupBy("shard").applyInPandas(_index, "shard long, data binary")
    index = staged(index, folder, "index")
    bundles = packed.mapInPandas(_bundles(shards), "shard long, data binary")
    salt = F.pmod(F.xxhash64("data"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.array(*[F.lit(s) for s in range(SALTS)]))
    streams = index.select("shard", salts.alias("salt"), F.lit(0).alias("kind"), "data").unionByName(
        bundles.select("shard", salt.alias("salt"), F.lit(1).alias("kind"), "data")
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = streams.repartition(width, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    hits = streams.select("kind", "data").mapInPandas(_look_up(min_docs), "doc long, hit binary")
    return hits.groupBy("doc").agg(F.collect_list("hit").alias("hits"))


def dedup_lines(
    docs: DataFrame, *carried: str, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per document: n_lines, n_dropped, kept_sha256, kept_text; then the carried
    columns as _c0, _c1 and so on, whatever their names are."""
    hits = shared_lines(docs, min_points, min_docs)
    key = F.coalesce("doc_id", F.lit(NO_ID)).cast("long")
    named = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)]
    mine = docs.select("text", key.alias("doc"), *named)
    # The side that is built is the one of hits: it has no text.
    joined = mine.join(hits.hint("shuffle_hash"), "doc", "left").drop("doc")
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "hits"))
    made = "n_lines long, n_dropped long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_cut(min_points), made + kinds)


def cut_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with the kept text in place of their own, all columns otherwise as they were."""
    done = dedup_lines(docs, *docs.columns, min_points=min_points, min_docs=min_docs)
    text = F.when(F.col(f"_c{docs.columns.index('text')}").isNotNull(), F.col("kept_text"))
    return done.select(*[(text if c == "text" else F.col(f"_c{k}")).alias(c) for k, c in enumerate(docs.columns)])
