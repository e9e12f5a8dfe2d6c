"""N-gram Jaccard join: documents whose shingle sets overlap by 85 % are linked; exact.

Shingles are hashed to 64 bits. The set of a document is dealt by hash into parts, one more than
two linked documents of that size can differ in shingles (and some spare ones): as a shingle spoils
one part only, linked documents have as many parts in common, whole, as there are more parts than
shingles in which they can differ. Documents that share a part are paired and their common parts
counted; pairs with enough are candidates. A part of more than OFTEN documents makes no pairs: it
counts for every pair of documents that have such parts, and documents with enough of these alone are
tied as stars. Candidates are few beyond the links, so blocks of connected ones do not grow together
as the corpus grows; no link leaves a block.

Within a block a T-occurrence search finds the links. Documents come by size; each asks an inverted
index of the earlier ones for those with at least T of its shingles. DivideSkip: the longest lists are
set aside, the short ones are heap-merged for documents that occur T minus that many times, and these
are binary-probed in the long lists. Lists leave out documents that are already connected with the
asking one. Equal sets are collapsed before, and blocks beyond a size are cut into cells: pairs of
chunks of like size, so a task holds two chunks at most.

Null text and text without words have empty sets, linked with nothing. Rows with a null doc_id are
not linked. Repeated rows with one doc_id are one document with the links of all its rows. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID, components, run_folder, small_or_shuffled, staged

WIDTH, PERCENT, CHUNK = 4, 85, 1500
#: Documents with a part in common that are still paired with each other.
OFTEN = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """64-bit hashes of words, the last ones remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def words(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()  # bytes: A-Z and the six blanks only
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for word in [w for w in set(found) if w not in known]:
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.array([known[w] for w in found], "u8")


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than that are one shingle."""
    n = len(words) - width + 1
    if not len(words):
        return words
    if n < 1:
        n, width = 1, len(words)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = (out ^ words[k : k + n]) * _ODD
        out ^= out >> np.uint64(31)
    return np.unique(out * _MIX)


def bands(percent: int = PERCENT, most: int = 2**40) -> list[int]:
    """Lower ends of size bands, each two steps of the size ratio wide."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 10000 // (percent * percent))))
    return ends


class Parts:
    def __init__(self, percent: int = PERCENT):
        self.percent, self.ends = percent, bands(percent)

    def of(self, found: np.ndarray) -> np.ndarray:
        """Signatures of a set's parts: for its own band, where it may be the smaller of two linked
        sets, and for the band below, if it may be the larger one of a set there."""
        return self.asked(found)[0]

    def asked(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures, and with each how many any linked set has in common with this one at least."""
        n, out, needs = len(found), [], []
        if not n:
            return found, found
        k = int(np.searchsorted(self.ends, n, "right")) - 1
        smallest = -(-self.percent * n // 100)
        for band in (k, k - 1):
            if band < 0 or (band < k and smallest >= self.ends[k]):
                continue
            differ = (100 - self.percent) * (self.ends[band + 1] - 1) // self.percent
            if not differ:  # only equal sets are linked
                continue
            parts = differ + 1 + max(1, differ // 8)
            at = ((found >> np.uint64(13)) % np.uint64(parts)).astype("i8")
            order = np.argsort(at, kind="stable")
            at, mixed = at[order], ((found ^ (found >> np.uint64(29))) * _ODD)[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sums = np.add.reduceat(mixed, first) + at[first].astype("u8") * _MIX
            if parts - len(first) >= parts - differ:  # all that two sets share may be empty parts
                empty = np.setdiff1d(np.arange(parts), at[first]).astype("u8")
                sums = np.r_[sums, empty * _MIX]
            sums = (sums ^ (sums >> np.uint64(32))) * _MIX + np.uint64(band)
            out.append((sums ^ (sums >> np.uint64(29))) * _ODD)
            spoilt = min(differ, (100 - self.percent) * n // self.percent)
            needs.append(np.full(len(sums), max(1, len(first) - spoilt), "u8"))
        return (np.concatenate(out), np.concatenate(needs)) if out else (found[:0], found[:0])


def _sets(width: int, percent: int):
    """Per document: the size of its set, a digest of it, and its part signatures, each with the number
    needed in its last byte."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, parts = Hasher(), Parts(percent)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc"], frame["text"], strict=True):
                found = shingles(hasher.words(text), width)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                sigs, needs = parts.asked(found if doc != NO_ID else found[:0])
                packed = (sigs & ~np.uint64(255)) | np.minimum(needs, np.uint64(255))
                rows.append((doc, len(found), digest, packed.tobytes()))
            yield pd.DataFrame(rows, columns=["doc", "n", "digest", "sigs"])

    return run


def _once(sigs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, document and need of each pair of the first two, sorted, with its least need; and
    where signatures begin."""
    keys, needs = sigs >> 8, sigs & 255
    order = np.lexsort((needs, docs, keys))
    keys, docs, needs = keys[order], docs[order], needs[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])][: len(keys)]
    keys, docs, needs = keys[new], docs[new], needs[new]
    return keys, docs, needs, np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])


def _rows_of(often: int, beyond: bool):
    """Document and signature. Of the documents of a batch that have a signature, the first ones are
    enough to show that it is a frequent one; the others are given only if asked for those beyond."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = np.frombuffer(b"".join(frame["sigs"]), "<i8")
            docs = np.repeat(frame["doc"].to_numpy("i8"), [len(p) // 8 for p in frame["sigs"]])
            keys, docs, needs, first = _once(values, docs)
            turn = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
            mine = turn > often if beyond else turn <= often
            yield pd.DataFrame({"a": docs[mine], "b": ((keys << 8) | needs)[mine]})

    return run


def _groups(often: int):
    """Of rows sorted by signature: pairs of documents that share one, and how many they need; of
    frequent signatures each document, the signature, and the need as a negative number."""

    def of(sigs: np.ndarray, docs: np.ndarray) -> pd.DataFrame:
        same = sigs[1:] >> 8 == sigs[:-1] >> 8
        shared = np.r_[False, same] | np.r_[same, False]
        keys, docs, needs, first = _once(sigs[shared[: len(sigs)]], docs[shared[: len(sigs)]])
        sizes = np.diff(np.r_[first, len(keys)])
        many = np.repeat(sizes > often, sizes)
        out = [(docs[many], keys[many], -needs[many])]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= often)]):
            at = first[sizes == size][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            out.append((docs[x], docs[y], np.maximum(needs[x], needs[y])))
        a, b, need = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b, "need": need.astype("i4")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs = docs = np.empty(0, "i8")
        for frame in frames:
            sigs, docs = np.r_[sigs, frame["b"].to_numpy("i8")], np.r_[docs, frame["a"].to_numpy("i8")]
            whole = np.searchsorted(sigs, (sigs[-1] >> 8) << 8) if len(sigs) else 0
            if whole:
                yield of(sigs[:whole], docs[:whole])
                sigs, docs = sigs[whole:], docs[whole:]
        yield of(sigs, docs)

    return run


def _candidates(known: DataFrame, folder: str) -> DataFrame:
    """a, b: pairs of documents that tie all that can be linked, from rows of doc and sigs."""
    pairs, width = "a long, b long", int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = known.mapInPandas(_rows_of(OFTEN, False), pairs).repartition(width, F.shiftright("b", 8))
    met = sigs.sortWithinPartitions("b", "a").mapInPandas(_groups(OFTEN), f"{pairs}, need int")
    met = staged(met, folder, "met")
    beyond = known.mapInPandas(_rows_of(OFTEN, True), pairs)
    beyond = beyond.select("a", F.shiftright("b", 8).alias("b"), F.expr("cast(b & 255L AS int) AS need"))
    often = staged(met.where("need < 0").withColumn("need", -F.col("need")).unionByName(beyond), folder, "often")
    # What pairs have in common beyond the parts they were paired by is no more than either has of frequent ones.
    more = staged(often.groupBy("a").agg(F.count("*").alias("h"), F.min("need").alias("need")), folder, "more")
    size = small_or_shuffled(more.select("a", "h"))
    counted = met.where("need > 0").groupBy("a", "b").agg(F.count("*").alias("k"), F.min("need").alias("need"))
    counted = counted.join(size, "a", "left").withColumnRenamed("h", "ha")
    counted = counted.join(size.withColumnsRenamed({"a": "b", "h": "hb"}), "b", "left")
    near = counted.where("k + least(coalesce(ha, 0), coalesce(hb, 0)) >= need").select("a", "b")
    tied = often.join(small_or_shuffled(more.where("h >= need").select("a")), "a").select("a", "b")
    first = staged(tied.groupBy("b").agg(F.min("a").alias("lead")), folder, "leads")
    return near.unionByName(tied.join(small_or_shuffled(first), "b").select("a", F.col("lead").alias("b")))


class Search:
    """T-occurrence search over the sets of one cell, with the components found so far. Documents are
    known by their turn: the smallest set asks first. Lists hold turns, in rising order."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        self.sets, self.percent = [sets[k] for k in self.order], percent
        self.sizes = [len(s) for s in self.sets]
        self.root = np.arange(len(sets))
        self.lists: dict[int, list[int]] = {}
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, "u8"), 0)
        self.shared = tokens[counts > 1] if sets else tokens
        self.links: list[tuple[int, int]] = []

    def linked(self, x: int, y: int, inside: int) -> bool:
        return 100 * inside >= self.percent * (self.sizes[x] + self.sizes[y] - inside)

    def join(self, x: int, y: int) -> None:
        self.root[self.root == self.root[y]] = self.root[x]
        self.links.append((self.order[x], self.order[y]))

    def tokens(self, x: int) -> list[int]:
        own = self.sets[x]
        if not len(self.shared):
            return []
        at = np.minimum(np.searchsorted(self.shared, own), len(self.shared) - 1)
        return own[self.shared[at] == own].tolist()

    def run(self, sides: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that join all that are linked, of those between two sides if there are such."""
        self.sides = [sides[k] for k in self.order] if sides else None
        for x in range(len(self.sets)):
            tokens = self.tokens(x)
            self.ask(x, tokens)
            for t in tokens:
                self.lists.setdefault(t, []).append(x)
        return self.links

    def ask(self, x: int, tokens: list[int]) -> None:
        n = self.sizes[x]
        smallest = -(-self.percent * n // 100)
        need = -(-self.percent * (n + smallest) // (100 + self.percent))
        lists = [self.lists[t] for t in tokens if t in self.lists]
        if len(lists) < need:
            return
        lists.sort(key=len)
        # A near copy is mostly found at once; the search then leaves out all it is connected with.
        for y in dict.fromkeys(one[-1] for one in lists[:: max(1, len(lists) // 3)]):
            if self.root[x] != self.root[y] and self.sizes[y] >= smallest:
                if self.linked(x, y, len(np.intersect1d(self.sets[x], self.sets[y], True))):
                    self.join(x, y)
        aside = min(need - 1, int(need / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        self.divide_skip(x, [self.open(x, one, smallest) for one in short], long, need - aside)

    def open(self, x: int, one: list[int], smallest: int) -> list[int]:
        """A list without documents that x is connected with or that are too small."""
        if len(one) > 8:
            turns = np.array(one)
            one = turns[self.root[turns] != self.root[x]].tolist()
        mine, root, sizes = self.root[x], self.root, self.sizes
        found = [y for y in one if root[y] != mine and sizes[y] >= smallest]
        if self.sides:
            side = self.sides[x]
            found = [y for y in found if self.sides[y] != side]
        return found

    def divide_skip(self, x: int, short: list[list[int]], long: list[list[int]], least: int) -> None:
        candidates: list[tuple[int, int]] = []
        last, count = -1, 0
        for y in heapq.merge(*short):
            if y != last:
                if count >= least:
                    candidates.append((last, count))
                last, count = y, 0
            count += 1
        if count >= least:
            candidates.append((last, count))
        for y, inside in candidates:
            if self.root[x] == self.root[y]:
                continue
            need = -(-self.percent * (self.sizes[x] + self.sizes[y]) // (100 + self.percent))
            for k, one in enumerate(long):
                if inside + len(long) - k < need:
                    break
                at = bisect_left(one, y)
                inside += at < len(one) and one[at] == y
            if self.linked(x, y, inside):
                self.join(x, y)


def _cell(width: int, percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc", ignore_index=True)
        hasher = Hasher()
        sets = [shingles(hasher.words(t), width) for t in frame["text"]]
        sides, docs = frame["side"].tolist(), frame["doc"].to_numpy()
        links = Search(sets, percent).run(sides if len(set(sides)) > 1 else None)
        a, b = [docs[x] for x, _ in links], [docs[y] for _, y in links]
        return pd.DataFrame({"a": np.array(a, "i8"), "b": np.array(b, "i8")})

    return run


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    kinds = "doc long, n long, digest binary, sigs binary"
    sets = staged(texts.mapInPandas(_sets(width, percent), kinds), folder, "sets")
    known = sets.where(F.col("digest").isNotNull() & (F.col("doc") != NO_ID))
    first = known.groupBy("digest").agg(F.min("doc").alias("b"), F.count("*").alias("k"))
    equal = known.select(F.col("doc").alias("a"), "n", "digest").join(first.where("k > 1"), "digest")
    copies = staged(equal.where("a <> b").select("a", "b", "n", "digest"), folder, "equal")
    equal = copies.select("a", "b")
    pairs = "a long, b long"
    gone = small_or_shuffled(copies.select(F.col("a").alias("doc"), "digest"))
    alone = known.where("length(sigs) > 0").join(gone, ["doc", "digest"], "left_anti").select("doc", "sigs")
    blocks = components(_candidates(alone, folder).unionByName(equal), f"{folder}/blocks")
    # A document has a place for each size of its rows, unless all rows of that size are copies.
    sizes = known.groupBy(F.col("doc").alias("node"), "n").agg(F.count("*").alias("rows"))
    copies = copies.groupBy(F.col("a").alias("node"), "n").agg(F.count("*").alias("copied"))
    sizes = sizes.join(copies, ["node", "n"], "left").where("rows > coalesce(copied, 0)").select("node", "n")
    cells = _cells(staged(blocks.join(sizes, "node"), folder, "blocks_of"), percent)
    cells = small_or_shuffled(staged(cells, folder, "cells"))
    inside = texts.join(cells, texts["doc"] == cells["node"]).select("block", "cell", "side", "doc", "text")
    inside = inside.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "cell")  # few rows, long work
    found = inside.groupBy("block", "cell").applyInPandas(_cell(width, percent), pairs)
    links = components(staged(found, folder, "found").unionByName(equal), f"{folder}/links")
    named = sets.select("doc", "n").join(links, F.col("doc") == F.col("node"), "left")
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return named.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", doc).alias("component_id"))


def _cells(blocks: DataFrame, percent: int) -> DataFrame:
    """node, block, cell and side: a small block is one cell. A large one is cut by size, two bands at
    most for a pair, and each band by hash into chunks; each pair of chunks is a cell with two sides."""
    sizes = blocks.groupBy(F.col("root").alias("block")).agg(F.count("*").alias("k"))
    step = float(np.log(100 / percent))
    mine = blocks.select("node", "n", F.col("root").alias("block")).join(sizes, "block")
    small = mine.where((F.col("k") > 1) & (F.col("k") <= CHUNK)).select(
        "node", "block", F.lit("all").alias("cell"), F.lit(0).alias("side")
    )
    large = mine.where(F.col("k") > CHUNK).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step))
    chunks = large.groupBy("block", "band").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).alias("chunks"))
    above = chunks.select("block", (F.col("band") - 1).alias("band"), F.col("chunks").alias("above"))
    below = chunks.select("block", (F.col("band") + 1).alias("band"), F.col("chunks").alias("below"))
    counts = chunks.join(above, ["block", "band"], "left").join(below, ["block", "band"], "left").na.fill(0)
    large = large.join(counts, ["block", "band"])
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    places = F.expr("""concat(
        transform(sequence(0L, chunks - 1), o -> named_struct(
            'cell', concat(band, ':', least(o, own), '-', band, ':', greatest(o, own)),
            'side', if(own < o, 0, 1))),
        if(above > 0, transform(sequence(0L, above - 1), o -> named_struct(
            'cell', concat(band, ':', own, '-', band + 1, ':', o), 'side', 0)), array()),
        if(below > 0, transform(sequence(0L, below - 1), o -> named_struct(
            'cell', concat(band - 1, ':', o, '-', band, ':', own), 'side', 1)), array()))""")
    large = large.withColumn("place", F.explode(places))
    return small.unionByName(large.select("node", "block", "place.cell", "place.side"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, of which each linked group keeps its smallest doc_id."""
    linked = link(docs, width, percent).where(F.col("component_id") < F.col("doc_id"))
    gone = staged(linked.select(F.col("doc_id").alias("_gone")).distinct(), run_folder(docs.sparkSession), "gone")
    return docs.join(small_or_shuffled(gone), docs["doc_id"] == gone["_gone"], "left_anti")
