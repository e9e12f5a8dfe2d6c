"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Documents are tokenized where they lie; a longer one than a sequence is cut, and only counts per
length reach the driver: at most as many numbers as a sequence has tokens. There, lengths are
placed from the longest to the shortest, each time as many pieces at once as the fullest kind of
open sequence that still fits them has sequences. That gives slots: pieces of one length with ranks
from a to b go to sequences from s on, at one offset. Pieces get their rank within their length
(running sums over small groups, so no length is one task) and take their slot by a join on it.

Null text is an empty document: only the end token. Repeated rows are packed each for itself; an
empty table packs into nothing. Ties of rank are broken by doc_id, piece and content.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID, run_folder, staged

SEQUENCE, END = 2048, 0
CACHED = 400_000
GROUP_PIECES = 20_000
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a text may not be cut at its blanks: they form runs.
_RUNS = re.compile(r"\s\s|\x00")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for
    itself, the other bytes for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as packed 32-bit numbers.

    The file's own vocabulary runs in tiktoken's BPE core, several times faster; texts that hold
    one of the file's added tokens go to the tokenizers library itself. Words with their blank in
    front are encoded once and remembered, up to a bound."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        letters = _byte_letters()
        added = [t["content"] for t in config["added_tokens"]]
        ranks = {
            bytes(letters[c] for c in token): number
            for token, number in config["model"]["vocab"].items()
            if token not in added
        }
        self.core = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.added.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if _RUNS.search(text):
            return array("I", self.core.encode_ordinary(text)).tobytes()
        known, out = self.known, []
        for word in text.replace(" ", "\x00 ").split("\x00"):
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHED:
                    known.clear()
                ids = array("I", self.core.encode_ordinary(word)).tobytes()
                if len(word) < 100:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def _pieces(tokenizer: str, size: int, end: int, keep_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, last = Encoder(tokenizer), array("I", [end]).tobytes()
        for frame in frames:
            rows = []
            for text, doc in zip(frame["text"], frame["doc"], strict=True):
                ids = encoder.encode(text or "") + last
                n = len(ids) // 4
                first = n % size or size
                for k, a in enumerate([0, *range(first, n, size)]):
                    b = min(a + size, n) if k else first
                    data = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(data), data if keep_ids else b""))
            out = pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids_crc32", "data"])
            yield out if keep_ids else out.drop(columns="data")

    return run


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, count, first sequence, offset), and how many sequences there are.

    Best fit, longest first, over counts. Open sequences with as much room as others are kept as
    ranges of sequence numbers, so the work depends on different lengths, not on documents."""
    room: dict[int, list[tuple[int, int]]] = {}
    slots, opened = [], 0

    def fill(first: int, count: int, free: int, length: int, rank: int, left: int) -> int:
        """Places pieces in up to `count` sequences with `free` room each; how many were placed. Once a
        piece is in, that sequence is the fullest that fits, so it takes as many as it has room for."""
        each, placed = free // length, 0
        for wide, used in ((each, min(count, left // each)), (left % each, 1 if left // each < count else 0)):
            if wide and used:
                for k in range(wide):
                    slots.append((length, rank + placed, used, first, size - free + k * length))
                    placed += used
                if free > wide * length:
                    room.setdefault(free - wide * length, []).append((first, used))
                first, count = first + used, count - used
        if count:
            room.setdefault(free, []).append((first, count))
        return placed

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = min((r for r in room if r >= length), default=0)
            if free:
                ranges = room[free]
                first, count = ranges.pop()
                if not ranges:
                    del room[free]
            else:
                free, first, count = size, opened, -(-left // (size // length))
                opened += count
            placed = fill(first, count, free, length, rank, left)
            rank, left = rank + placed, left - placed
    return slots, opened


def pack(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with
    keep_ids also `data`, the ids as little-endian unsigned 32-bit numbers."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    kinds = "doc long, piece int, start long, length long, ids_crc32 long" + ", data binary" * keep_ids
    mine = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    pieces = staged(mine.mapInPandas(_pieces(tokenizer, size, end, keep_ids), kinds), folder, "pieces")
    groups = max(64, pieces.count() // GROUP_PIECES)
    group = F.pmod(F.xxhash64("doc", "piece"), F.lit(groups)).cast("int")
    pieces = pieces.withColumn("part", group)
    counts = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), folder, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc", "piece", "ids_crc32")
    ranked = pieces.withColumn("_nth", F.row_number().over(inside) - 1).join(offsets, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("_nth"))
    # Slots are found by rank ranges; a slot is cut at multiples of a step so that a piece meets
    # only the few slots of its own step.
    step = _step(histogram)
    cut = [
        (length, b, max(rank, b * step), min(rank + n, b * step + step), rank, first, offset)
        for length, rank, n, first, offset in slots
        for b in range(rank // step, (rank + n - 1) // step + 1)
    ]
    table = spark.createDataFrame(
        pd.DataFrame(cut, columns=["length", "block", "low", "high", "from_rank", "first", "offset"]).astype("int64"),
        "length long, block long, low long, high long, from_rank long, first long, offset long",
    )
    on_block = ranked.withColumn("block", F.floor(F.col("rank") / step))
    inside_slot = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = on_block.join(table, ["length", "block"]).where(inside_slot)
    sequence = F.col("first") + F.col("rank") - F.col("from_rank")
    return placed.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "piece", "start", "length", "ids_crc32",
        sequence.alias("sequence_id"), "offset", *["data"] * keep_ids,
    )


def _step(histogram: dict[int, int]) -> int:
    """Ranks per block: the slot table keeps at most some ten thousand rows more than it has slots."""
    return max(1024, sum(histogram.values()) // 10_000)
