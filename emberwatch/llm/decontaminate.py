"""Benchmark decontamination: passages of documents that copy test items, edited copies included.

A document's score for an item is that of the best Smith-Waterman alignment over words, over the best
possible for the item; from a threshold on it is a leak. No alignment that reaches the threshold is
missed. If its m matches and e errors give 2m - e >= t, at most (2m - t) / 2 of the m - 1 steps from match
to match hold two errors or more, so ceil(t / 2) - 1 steps (`need`) hold one at most: there, two words
that are next to each other or one word apart in the item are so in the document, too. A document is
aligned with an item where so many near pairs of the item begin within the longest span that such an
alignment can have.

Items are looked up by their rarer pairs: of the places where an item's pairs begin, all but the
need - TIMES whose pairs most items share. TIMES of the steps above begin at the others.

Documents are read once per block of test items, and not shuffled; blocks are of bounded size, each
sent to all tasks. Items with fewer words than `gram` cannot be told from chance and match nothing, nor
does null or empty text. Rows with a null doc_id give leaks with a null doc_id; repeated rows give
one leak for a document and item, the best one, and so do several texts of an item; items with a null
item_id have no name to report and are searched by drop_leaks only. Ties go to the earliest place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID, run_folder, small_or_shuffled, staged

GRAM, SCORE, BLOCK_WORDS = 4, 0.5, 2_000_000
#: So many of an item's rarer pairs lead to it; documents looked up at a time.
TIMES, BATCH = 3, 64
MATCH, MISMATCH, GAP = 2, -1, -1
_TOKEN = re.compile(r"\w+")
_ODD = 0x9E3779B97F4A7C15


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (length[0] numbers), then those of the next, and so on."""
    skipped = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(begin - skipped, length)


class Pairs:
    """The near pairs of a block of items: which items have which, and by which an item is looked up."""

    def __init__(self, items: list[str], gram: int = GRAM, score: float = SCORE):
        if score * gram <= 1:
            raise ValueError("a score that one word in common reaches tells nothing")
        self.words = [tokens(t) for t in items]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for t in self.words for w in t}))}
        size = np.array([len(t) for t in self.words], "i8")
        least = np.ceil(MATCH * score * size - 1e-9).astype("i8")
        self.need = -(-least // MATCH) - 1
        self.times = np.minimum(self.need, TIMES)
        self.span = np.maximum(3 * size - least, 1)  # words of a document that such an alignment covers
        owner, begin, key = [], [], []
        for k, words in enumerate(self.words):
            if len(words) >= gram:
                at, of = self.pairs_of(self.numbers(words))
                owner.append(np.full(len(at), k))
                begin.append(at)
                key.append(of)
        none = np.empty(0, "i8")
        owner, begin = (np.concatenate([none, *x]) for x in (owner, begin))
        self.keys, pair = np.unique(np.concatenate([none, *key]), return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.keys)] = True
        # Rows by item: its pairs, each once.
        owners, self.of_item = np.divmod(np.unique(owner * len(self.keys) + pair), max(1, len(self.keys)))
        self.item_at = np.searchsorted(owners, np.arange(len(items) + 1))
        # Rows by pair: the items that are looked up by it.
        items_with = np.bincount(self.of_item, minlength=len(self.keys))
        seeds = []
        cuts = np.searchsorted(owner, np.arange(len(items) + 1)).tolist()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a == b:
                continue
            common = np.bincount(begin[a:b], items_with[pair[a:b]])
            rare = np.ones(len(common), bool)
            rare[np.argsort(-common, kind="stable")[: self.need[k] - self.times[k]]] = False
            of = np.unique(pair[a:b][rare[begin[a:b]]])
            seeds.append(np.stack([of, np.full(len(of), k)]))
        rows = np.concatenate([np.empty((2, 0), "i8"), *seeds], axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        self.seeded, self.seed_at = rows[1], np.searchsorted(rows[0], np.arange(len(self.keys) + 1))

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], "i8")

    @staticmethod
    def pairs_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair of known words begins, and which; the words are neighbours or one word apart."""
        at = np.flatnonzero(numbers)
        where = [at[:0]]
        keys = [at[:0]]
        for far in (1, 2):
            here = at[at < len(numbers) - far]
            other = numbers[here + far]
            here, other = here[other > 0], other[other > 0]
            where.append(here)
            keys.append((numbers[here] << 32) | other)
        return np.concatenate(where), np.concatenate(keys)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype("u8") * np.uint64(_ODD)) >> np.uint64(44)

    def regions(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item, first and past-the-last word) of the parts of documents to align."""
        # Laid end to end; two unknown words between documents keep pairs within each.
        start = np.cumsum([0, *[len(n) + 2 for n in docs]])
        flat = np.zeros(int(start[-1]), "i8")
        for at, numbers in zip(start.tolist(), docs, strict=False):
            flat[at : at + len(numbers)] = numbers
        at, key = self.pairs_of(flat)
        maybe = self.maybe[self._slot(key)]
        at, key = at[maybe], key[maybe]
        if not len(at):
            return []
        pair = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[pair] == key
        at, pair = at[hit], pair[hit]
        doc = np.searchsorted(start, at, "right") - 1
        n_items, n_keys = len(self.words), len(self.keys)
        owners = self.seed_at[pair + 1] - self.seed_at[pair]
        met = np.repeat(doc, owners) * n_items + self.seeded[_ranges(self.seed_at[pair], owners)]
        met, times = np.unique(met, return_counts=True)
        met = met[times >= self.times[met % n_items]]
        if not len(met):
            return []
        # All near pairs of the items met, where the document has them.
        doc_pair = doc * n_keys + pair
        order = np.argsort(doc_pair, kind="stable")
        at, doc_pair = at[order], doc_pair[order]
        items = met % n_items
        own = self.item_at[items + 1] - self.item_at[items]
        wanted = np.repeat(met // n_items, own) * n_keys + self.of_item[_ranges(self.item_at[items], own)]
        low, high = np.searchsorted(doc_pair, wanted), np.searchsorted(doc_pair, wanted, "right")
        which = np.repeat(np.repeat(np.arange(len(met)), own), high - low)
        which, place = np.divmod(np.unique(which * len(flat) + at[_ranges(low, high - low)]), len(flat))
        # The need-th place from each on, if there is one and it is within the span.
        need, span = self.need[items][which], self.span[items][which]
        last = np.arange(len(which)) + need - 1
        inside = np.minimum(last, len(which) - 1)
        dense = (last < len(which)) & (which[inside] == which) & (place[inside] - place < span)
        found: list[tuple[int, int, int, int]] = []
        for k in np.flatnonzero(dense).tolist():
            d, i = (int(x) for x in np.divmod(met[which[k]], n_items))
            a = max(0, int(place[k] - start[d] - span[k]))
            b = min(len(docs[d]), int(place[inside[k]] - start[d] + span[k]) + 2)
            if found and found[-1][:2] == (d, i) and a <= found[-1][3]:
                found[-1] = (d, i, found[-1][2], b)
            else:
                found.append((d, i, a, b))
        return found


def align(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Smith-Waterman over words with linear gaps: best score, first and past-the-last word of the
    passage in that alignment. A row at a time: a gap along the row is a running maximum."""
    names = {w: k for k, w in enumerate(dict.fromkeys(item))}
    own = np.array([names[w] for w in item])
    other = np.array([names.get(w, -1) for w in passage])
    n = len(other)
    steps = np.arange(n + 1) * -GAP
    score, begin = np.zeros(n + 1, "i8"), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in own:
        diagonal = score[:-1] + np.where(other == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        here = np.maximum(np.maximum(diagonal, up), 0)
        came = np.where(here == 0, np.arange(1, n + 1), np.where(here == diagonal, begin[:-1], begin[1:]))
        here, came = np.r_[0, here], np.r_[0, came]
        lifted = here + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, begin = top - steps, came[source]
        k = int(score.argmax())
        if score[k] > best:
            best, span = int(score[k]), (int(begin[k]), k)
    return best, *span


def _search(shared, numbers: list[int], score: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Pairs = shared.value
        for frame in frames:
            docs, rows = frame["doc"].tolist(), []
            for begin in range(0, len(docs), BATCH):
                split = [tokens(t) for t in frame["text"].iloc[begin : begin + BATCH]]
                for d, k, a, b in pairs.regions([pairs.numbers(words) for words in split]):
                    item = pairs.words[k]
                    best, first, past = align(item, split[d][a:b])
                    if best >= score * MATCH * len(item) - 1e-9:
                        rows.append((docs[begin + d], numbers[k], best / (MATCH * len(item)), a + first, a + past))
            yield pd.DataFrame(rows, columns=["doc", "item", "score", "first_word", "past_word"])

    return run


def leaks(docs: DataFrame, items: DataFrame, gram: int = GRAM, score: float = SCORE) -> DataFrame:
    """One row per document and item that it copies: doc_id, item_id, score (over 0 to 1), first_word
    and past_word (places of the copy among the document's words)."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    kept = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    kept = kept.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id())
    kept = staged(kept, folder, "items")
    blocks = max(1, -(-int(kept.agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * BLOCK_WORDS)))
    found = None
    for k in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "text").collect()  # of bounded size
        pairs = spark.sparkContext.broadcast(Pairs([r["text"] for r in rows], gram, score))
        kinds = "doc long, item long, score double, first_word long, past_word long"
        part = texts.mapInPandas(_search(pairs, [r["item"] for r in rows], score), kinds)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("score", "first_word", "past_word"), F.struct("score", -F.col("first_word")))
    found = found.join(small_or_shuffled(kept.select("item", "item_id")), "item")
    found = found.groupBy("doc", "item_id").agg(best.alias("best"))
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return found.select(doc.alias("doc_id"), "item_id", "best.*")


def drop_leaks(docs: DataFrame, items: DataFrame, gram: int = GRAM, score: float = SCORE) -> DataFrame:
    """The rows that copy no item, with all their columns; other rows of a leaking doc_id stay."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    found = leaks(rows, items.select(F.xxhash64("text").alias("item_id"), "text"), gram, score)
    found = found.select(F.col("doc_id").alias("_leak")).distinct()
    folder = run_folder(docs.sparkSession)
    found = small_or_shuffled(staged(found, folder, "leaking"))
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == found["_leak"], "left_anti")
