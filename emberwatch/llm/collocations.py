"""Phrase collocations per language, by best-first branch and bound; exact.

f counts a phrase, n the words of its language. Cutting phrase P after k words scores
floor(1000 * f(P) * n / (f(first part) * f(rest))); the lowest cut counts. As f(P) is at most f of either
part, a phrase scores at most 1000 * n / f of its first word, and the same holds for its last word: the
counts of what it grows from bound it. So the frontier is opened best bound first, in bands of word counts
from `least` upwards. In a band, phrases grow word by word to the right of a first word, and to
the left of a last word, of that band, from phrases counted before; counts below `least` end a branch. A
phrase whose two end words are open has all its parts and all its extensions counted, so its score and
whether it survives are final. A language is settled once it has `top` surviving scores above
the bound of the rarest word that is not open (above, so no tie is missed), or when all words are open;
later bands leave it out.

Texts become blocks once: per task and language the common words that occur, and the texts as numbers of
these. What a task needs to know of the counted phrases comes as bit filters of a fixed size (FILTER bits),
whatever the corpus: a wrong hit only counts a phrase that the sum drops. Counts are summed by the phrase
itself. Tasks sum before the shuffle, so a language or phrase with most of the rows is one row per flush;
the best `top` of a language are cut in each task before they are ranked.

Null text is empty; a null lang is `und`. A phrase inside a longer counted one with the same count is
dropped; it is enough to look at phrases one word longer, as the counts between the two are equal then.
Repeated rows all count. Tables without words give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import run_folder, small_or_shuffled, staged

LEAST, LONGEST, TOP = 100, 5, 2000
FIRST, GROWTH = 400, 8
FILTER = 2**25
FLUSH, BLOCK = 300_000, 400_000
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, phrase string, f long"


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text, A-Z lower-cased."""
    return [p.split() for p in (text or "").encode().translate(_FOLD).split(b"\n")]


class Tally:
    """Counts per language, handed on whenever they are many."""

    def __init__(self):
        self.counts: dict[str, Counter] = {}

    def add(self, lang: str, phrases) -> None:
        self.counts.setdefault(lang, Counter()).update(phrases)

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > FLUSH

    def flush(self) -> pd.DataFrame:
        lang = [name for name, c in self.counts.items() for _ in c]
        phrase = [p and p.decode() for c in self.counts.values() for p in c]
        f = [n for c in self.counts.values() for n in c.values()]
        self.counts = {}
        return pd.DataFrame({"lang": pd.Series(lang, dtype=object), "phrase": pd.Series(phrase, dtype=object), "f": np.array(f, "i8")})


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words, and of all words under a null phrase."""
    tally = Tally()
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            words = list(chain.from_iterable(pieces(text)))
            if words:
                tally.add(lang, words)
                tally.counts[lang][None] += len(words)
            if tally.full():
                yield tally.flush()
    yield tally.flush()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def grams(hashes: np.ndarray, lang: str, width: int) -> np.ndarray:
    """Hashes of the phrases of so many words of one language that start at each word."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def slots(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(FILTER)
    return found % size, (found * _ODD >> np.uint64(20)) % size


class Filter:
    """Which phrases may have been counted: never misses one."""

    def __init__(self, words: np.ndarray):
        self.bits = words

    def has(self, found: np.ndarray) -> np.ndarray:
        at, bits = slots(found), self.bits
        one = np.uint64(1)
        test = lambda s: (bits[(s >> np.uint64(6)).astype("i8")] >> (s & np.uint64(63))) & one
        return (test(at[0]) & test(at[1])).astype(bool)


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for lang, phrase in zip(frame["lang"], frame["phrase"], strict=True):
            words = phrase.encode().split()
            found.append(grams(hashes(words), lang, len(words)))
        at = np.concatenate(slots(np.concatenate(found))) if found else np.empty(0, "u8")
        bit = np.left_shift(np.uint64(1), at & np.uint64(63))
        yield pd.DataFrame({"place": (at >> np.uint64(6)).astype("i8"), "bit": bit.view("i8")})


def filter_of(phrases: DataFrame) -> Filter:
    """The filter of (lang, phrase) rows: at most FILTER / 64 numbers come to the driver."""
    places = phrases.select("lang", "phrase").mapInPandas(_slots, "place long, bit long")
    found = places.groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(FILTER // 64, "u8")
    words[found["place"].to_numpy("i8")] = found["bits"].to_numpy("i8").view("u8")
    return Filter(words)


class Block:
    """Some texts of one language: its common words once, and the texts as their numbers. -1 stands between
    pieces and for words that are not common; no phrase goes over it."""

    def __init__(self):
        self.parts: list[list[bytes]] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        for part in pieces(text):
            if len(part) > 1:
                self.parts.append(part)
                self.size += len(part) + 1

    def close(self, lang: str, usual: Filter) -> tuple[str, bytes, bytes]:
        kinds = list(set(chain.from_iterable(self.parts)))
        common = usual.has(grams(hashes(kinds), lang, 1))
        kinds = [w for w, yes in zip(kinds, common.tolist(), strict=True) if yes]
        number = dict(zip(kinds, range(len(kinds)), strict=True))
        flat = chain.from_iterable(chain(part, (None,)) for part in self.parts)
        codes = np.array([number.get(w, -1) for w in flat], "<i4")
        self.parts, self.size = [], 0
        inside = codes >= 0
        beside = np.r_[False, inside[:-1]] | np.r_[inside[1:], False]
        codes[~beside] = -1  # alone between two breaks
        codes = codes[(codes >= 0) | np.r_[True, codes[:-1] >= 0][: len(codes)]]
        return lang, b"\n".join(kinds), codes.tobytes()


def _blocks(usual: Filter):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[str, Block] = {}

        def closed(langs: list[str]) -> pd.DataFrame:
            return pd.DataFrame([blocks[x].close(x, usual) for x in langs], columns=["lang", "kinds", "codes"])

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                block = blocks.setdefault(lang, Block())
                block.add(text)
                if block.size > BLOCK:
                    yield closed([lang])
        yield closed([x for x, block in blocks.items() if block.size])

    return run


def grown(lang: str, kinds: list[bytes], codes: np.ndarray, width: int, opened: Filter, shorter: Filter | None):
    """Phrases of so many common words with an open word at an end, whose parts one word shorter may
    have `least` occurrences; and how often each is there."""
    n = len(codes) - width + 1
    if n < 1:
        return []
    of = hashes(kinds)
    new = np.r_[opened.has(grams(of, lang, 1)), False]  # -1 is the last one
    fits = new[codes[:n]] | new[codes[width - 1 :]]
    for k in range(width):
        fits &= codes[k : n + k] >= 0
    starts = np.flatnonzero(fits)
    if not len(starts):
        return []
    found = np.stack([codes[starts + k] for k in range(width)], 1)
    _, first, counts = np.unique(_keys(found, len(kinds)), return_index=True, return_counts=True)
    found = found[first]
    if shorter is not None:
        head = shorter.has(_rolled(of, found[:, :-1], lang)) | ~new[found[:, 0]]
        tail = shorter.has(_rolled(of, found[:, 1:], lang)) | ~new[found[:, -1]]
        found, counts = found[head & tail], counts[head & tail]
    return [(b" ".join([kinds[k] for k in row]), n) for row, n in zip(found.tolist(), counts.tolist(), strict=True)]


def _keys(rows: np.ndarray, kinds: int) -> np.ndarray:
    """One number for each different row of word numbers."""
    key, most = rows[:, 0].astype("i8"), kinds
    for k in range(1, rows.shape[1]):
        if most * kinds >= 2**62:
            key, most = np.unique(key, return_inverse=True)[1], len(key)
        key, most = key * kinds + rows[:, k], most * kinds
    return key


def _rolled(of: np.ndarray, rows: np.ndarray, lang: str) -> np.ndarray:
    """The same hashes as grams gives, for rows of word numbers."""
    out = np.full(len(rows), np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    for k in range(rows.shape[1]):
        out = (out ^ of[rows[:, k]]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def _phrases(width: int, opened: Filter, shorter: Filter | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for frame in frames:
            for lang, kinds, codes in zip(frame["lang"], frame["kinds"], frame["codes"], strict=True):
                kinds, codes = kinds.split(b"\n") if kinds else [], np.frombuffer(codes, "<i4")
                tally.add(lang, dict(grown(lang, kinds, codes, width, opened, shorter)))
                if tally.full():
                    yield tally.flush()
        yield tally.flush()

    return run


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _scored(counts: DataFrame, totals: DataFrame, folder: str) -> DataFrame:
    """Surviving phrases of which both end words are open: a, l, r, n and the score of the lowest cut."""
    words = F.split("phrase", " ", -1)
    longer = counts.where("size > 2").select("lang", F.col("f").alias("a"), words.alias("w"))
    part = lambda at, less: _joined(F.slice("w", at, F.size("w") - less))
    inside = longer.select("lang", "a", F.explode(F.array(part(1, 1), part(2, 1))).alias("phrase")).distinct()
    whole = counts.where("size > 1 and closed").select("lang", "phrase", F.col("f").alias("a"))
    whole = whole.join(inside, ["lang", "phrase", "a"], "left_anti")
    at = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    cuts = whole.withColumn("w", words).withColumn("k", at)
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _joined(F.expr("slice(w, 1, k)")).alias("left"),
        _joined(F.expr("slice(w, k + 1, size(w) - k)")).alias("right"),
    )
    of = small_or_shuffled(staged(counts.select("lang", "phrase", "f"), folder, "counts"))
    side = lambda name, f: of.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), "under": big("l") * big("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = F.min_by(F.struct("l", "r"), F.struct("score", "k")).alias("cut")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(best, F.min("score").alias("score"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "score")


def mine(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, first: int = FIRST, growth: int = GROWTH
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` of each language."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    summed = lambda df: df.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = staged(summed(texts.mapInPandas(_words, _COUNTS)).where(f"phrase is null or f >= {least}"), folder, "words")
    totals = small_or_shuffled(staged(words.where("phrase is null").select("lang", F.col("f").alias("n")), folder, "totals"))
    words = words.where("phrase is not null")
    blocks = staged(texts.mapInPandas(_blocks(filter_of(words)), "lang string, kinds binary, codes binary"), folder, "blocks")
    ends = small_or_shuffled(words)
    edge = lambda word, name: ends.select("lang", F.col("phrase").alias(word), F.col("f").alias(name))
    going, before, limit, turn = totals.select("lang"), 0, first, 0
    counted: dict[int, list[DataFrame]] = {}
    while True:
        at = f"{folder}/band{turn}"
        band = words.where((F.col("f") > before) & (F.col("f") <= limit)).join(going, "lang", "left_semi")
        opened, shorter = filter_of(band), None
        for width in range(2, longest + 1):
            found = summed(blocks.mapInPandas(_phrases(width, opened, shorter), _COUNTS)).where(f"f >= {least}")
            found = found.withColumns({"head": F.substring_index("phrase", " ", 1), "tail": F.substring_index("phrase", " ", -1)})
            found = found.join(edge("head", "f1"), ["lang", "head"]).join(edge("tail", "f2"), ["lang", "tail"])
            found = found.where(F.least("f1", "f2") > before).select("lang", "phrase", "f", F.greatest("f1", "f2").alias("end"))
            counted.setdefault(width, []).append(staged(found, at, f"phrases{width}"))
            if all(df.isEmpty() for df in counted[width]):
                break
            shorter = filter_of(_union(counted[width]))
        every = words.select("lang", "phrase", "f", F.col("f").alias("end"), F.lit(1).alias("size"))
        for width, parts in counted.items():
            every = every.unionByName(_union(parts).withColumn("size", F.lit(width)))
        every = staged(every.join(going, "lang", "left_semi").withColumn("closed", F.col("end") <= limit), at, "every")
        scored = staged(_scored(every, totals, at), at, "scored")
        # Nothing that is not open reaches 1000 * n / (count of the rarest word that is not open).
        rest = words.where(F.col("f") > limit).groupBy("lang").agg(F.min("f").alias("next"))
        bounds = going.join(totals, "lang").join(rest, "lang", "left")
        bounds = bounds.withColumn("bound", F.expr("1000 * cast(n as decimal(38,0)) div next"))
        above = scored.join(small_or_shuffled(staged(bounds, at, "bounds")), "lang").where("score > bound")
        above = above.groupBy("lang").agg(F.count("*").alias("above"))
        state = bounds.join(above, "lang", "left").withColumn(
            "settled", F.col("next").isNull() | (F.coalesce("above", F.lit(0)) >= top)
        )
        state = staged(state, at, "state")
        done = scored.join(small_or_shuffled(state.where("settled").select("lang")), "lang", "left_semi")
        out = done if turn == 0 else out.unionByName(done)
        going = small_or_shuffled(staged(state.where("not settled").select("lang"), at, "going"))
        if going.isEmpty():
            break
        before, limit, turn = limit, limit * growth, turn + 1
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
