"""Language-model scores of whole documents: smoothed unigrams, and a gated recurrent model.

Words are counted over all training documents. The most frequent ones, a table of bounded size, go to
all tasks; scores of other words come from a join of their hashes with all counts, each of which is
rare by definition, so no join key is hot. After counting, texts are split into words once more and written
down as the model's word numbers; training and scoring read those.

The recurrent model (recurrent.py) predicts the end of a text, the most frequent words, in number about the
square root of all counted ones, and one symbol for other words; such a word then has its smoothed share
of them. It is trained on all training documents, each in one round, in shards that each train one copy
from the same start; the copies are averaged in a tree, and the next round starts from there.

Null text is empty: one token, its end. Rows with a null doc_id are not held out. Repeated rows count
and are scored each for itself; an empty table gives nothing; without training documents all
counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm import recurrent
from emberwatch.llm.common import NO_ID, run_folder, staged
from emberwatch.llm.language import held_out

ADD = 0.1
#: Words whose counts go to all tasks (12 bytes each).
KNOWN_WORDS = 200_000
#: The recurrent model trains in ROUNDS rounds of shards.
ROUNDS, SHARD_DOCS, FAN_IN = 2, 1000, 16
END = 0  # the hash that stands for the end of a text
#: Characters of texts that are numbered at a time, beyond one text, and words remembered by a task.
PART_CHARS, REMEMBERED = 1_000_000, 400_000


def words(text: str | None) -> list[bytes]:
    """Bytes: lower() and split() take A-Z and the six blanks only."""
    return (text or "").encode().lower().split()


class Names:
    """64-bit hashes of words; the latest are remembered up to a bound."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def of(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for word in [w for w in set(found) if w not in known]:
            known[word] = xxhash.xxh3_64_intdigest(word) or 1
        return np.array([known[w] for w in found], "u8").view("i8")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts within a task, let go of when they grow large."""
    names, sums = Names(), Counter()

    def flush() -> pd.DataFrame:
        hashes = names.of(list(sums)) if len(sums) <= names.bound else np.concatenate(
            [names.of(part) for part in _chunks(list(sums), names.bound)]
        )
        return pd.DataFrame({"h": hashes, "c": np.fromiter(sums.values(), "i8", len(sums))})

    ends = 0
    for frame in frames:
        for text in frame["text"]:
            sums.update(words(text))
        ends += len(frame)
        if len(sums) > 300_000:
            yield flush()
            sums.clear()
    yield flush()
    yield pd.DataFrame({"h": [END], "c": [ends]})


def _chunks(items: list, size: int) -> list[list]:
    return [items[k : k + size] for k in range(0, len(items), size)]


class Vocabulary:
    """Counts of the most frequent words, sorted by hash, and totals of all. `rank` is a word's number in
    the recurrent model: 0 is its symbol for other words, 1 the end of a text, if counted."""

    def __init__(self, top: pd.DataFrame, tokens: int, kinds: int):
        top = top.assign(word=top["h"] != END).sort_values(["word", "c", "h"], ascending=[True, False, True], ignore_index=True)
        self.tokens, self.kinds, self.side = tokens, kinds, recurrent.side_for(kinds)
        size = self.side**2
        inside = top[: size - 1]
        self.other_tokens = tokens - int(inside["c"].sum())
        self.other_kinds = kinds - len(inside)
        self.model_counts = np.r_[self.other_tokens, inside["c"].to_numpy("i8")]
        order = np.argsort(top["h"].to_numpy("i8"))
        self.hashes, self.counts = top["h"].to_numpy("i8")[order], top["c"].to_numpy("i8")[order]
        self.ranks = np.where(order < size - 1, order + 1, 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ranks; count -1 for words that are not among the most frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes), "i8")
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.counts[at], -1), np.where(hit, self.ranks[at], 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.kinds + 1)))

    def other(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.other_tokens + ADD * (self.other_kinds + 1)))


class Codes(dict):
    """Running numbers of words met, and what the vocabulary says of each: hash, whether it is known, its
    shares of the base score and of the model's symbol for other words, its rank. The empty word is the end."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.fresh = vocabulary, []
        self.columns = self._look_up([])

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def _look_up(self, found: list[bytes]) -> list[np.ndarray]:
        hashes = np.array([(xxhash.xxh3_64_intdigest(w) or 1) if w else END for w in found], "u8").view("i8")
        counts, ranks = self.vocabulary.find(hashes)
        there, more = counts >= 0, np.zeros(len(hashes))
        base = np.where(there, self.vocabulary.base(np.maximum(counts, 0)), 0) if there.any() else np.zeros(len(hashes))
        other = there & (ranks == 0)
        more[other] = self.vocabulary.other(counts[other])
        return [hashes, there, base, more, ranks.astype("u2")]

    def of(self, found: list[bytes]) -> list[np.ndarray]:
        """The columns for each of these words."""
        if len(self) > REMEMBERED:
            self.clear()
            self.columns = self._look_up([])
        numbers = np.fromiter(map(self.__getitem__, found), "i8", len(found))
        if self.fresh:
            self.columns = [np.concatenate(pair) for pair in zip(self.columns, self._look_up(self.fresh), strict=True)]
            self.fresh = []
        return [column[numbers] for column in self.columns]


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in turn, in parts of PART_CHARS characters or one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > PART_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


CODED = "doc long, n_tokens long, n_known long, base double, more double, rare binary, times binary, ranks binary"


def _code(vocabulary):
    """Per document what the frequent words give, the other words with how often they occur, and all words'
    numbers in the model, 16 bits each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(vocabulary.value)
        for frame in frames:
            docs, at = frame["doc"].to_numpy("i8"), 0
            for part in _parts(frame["text"].tolist()):
                found, lengths = [], []
                for text in part:
                    more = words(text)
                    found += more
                    found.append(b"")
                    lengths.append(len(more) + 1)
                hashes, there, base, more, ranks = codes.of(found)
                text, ends = np.repeat(np.arange(len(part)), lengths), np.cumsum(lengths)
                rare, times = [], []
                for a, b in zip(ends - lengths, ends, strict=True):
                    kinds, n = np.unique(hashes[a:b][~there[a:b]], return_counts=True)
                    rare.append(kinds.tobytes())
                    times.append(n.astype("i8").tobytes())
                yield pd.DataFrame(
                    {
                        "doc": docs[at : at + len(part)],
                        "n_tokens": lengths,
                        "n_known": np.bincount(text, there, len(part)).astype("i8"),
                        "base": np.bincount(text, base, len(part)),
                        "more": np.bincount(text, more, len(part)),
                        "rare": rare,
                        "times": times,
                        "ranks": [ranks[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)],
                    }
                )
                at += len(part)

    return run


def coded(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows of CODED, one per document, with a number `row` of their own; doc is NO_ID for null ids."""
    numbered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    return numbered.mapInPandas(_code(vocabulary), CODED).withColumn("row", F.monotonically_increasing_id())


def _ranks(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(data, "u2") for data in frame["ranks"]]


def _train(start: bytes):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = _ranks(frame.sort_values("row"))  # the same copy, should a task run again
        weights = recurrent.train(recurrent.unpack(start), texts)
        tokens = float(sum(map(len, texts)))
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "weight": [tokens], "data": [recurrent.pack(weights)]})

    return run


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("data")
    total = frame["weight"].sum()
    mean = sum(w / total * np.frombuffer(d, "f4").astype("f8") for w, d in zip(frame["weight"], frame["data"], strict=True))
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "weight": [total], "data": [mean.astype("f4").tobytes()]})


def lessons(codes: DataFrame, turn: int) -> DataFrame:
    """The training documents of a round; each is in one round. Copies and repeated rows are spread, as
    every row has a number of its own."""
    taught = codes.where((F.col("doc") == NO_ID) | ~held_out(F.col("doc"), 10, 0))
    return taught.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == turn).select("row", "doc", "ranks")


def fit(codes: DataFrame, vocabulary, folder: str) -> bytes:
    """The recurrent model's weights. Shards grow in number with the documents, not in size; a mean
    takes about FAN_IN copies."""
    start = recurrent.pack(recurrent.initial(vocabulary.value.model_counts, vocabulary.value.side))
    kinds = "shard long, weight double, data binary"
    for turn in range(ROUNDS):
        now = lessons(codes, turn)
        left, level = max(1, now.count() // SHARD_DOCS), 0
        now = now.withColumn("shard", F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(left)))
        now = staged(now.groupBy("shard").applyInPandas(_train(start), kinds), folder, f"round{turn}")
        while left > 1:
            left = -(-left // FAN_IN)
            now = now.withColumn("shard", F.pmod("shard", F.lit(left))).groupBy("shard")
            now, level = staged(now.applyInPandas(_average, kinds), folder, f"mean{turn}-{level}"), level + 1
        row = now.first()
        start = bytes(row["data"]) if row else start
    return start


SCORED = "row long, doc long, n_tokens long, n_known long, base double, more double"


def _score(weights: bytes):
    """The model's score of each document, added to what `more` holds for its words outside the model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = recurrent.unpack(weights)
        for frame in frames:
            more = frame["more"] + recurrent.score(model, _ranks(frame)) / np.log(10)
            yield frame.drop(columns="ranks").assign(more=more)

    return run


def _rare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame(
            {
                "row": np.repeat(frame["row"].to_numpy("i8"), [len(p) // 8 for p in frame["rare"]]),
                "h": np.frombuffer(b"".join(frame["rare"]), "i8"),
                "times": np.frombuffer(b"".join(frame["times"]), "i8"),
            }
        )


def _known_from(counts: DataFrame) -> int:
    """The least count of a known word: as low as KNOWN_WORDS allows, by steps of a twelfth or so.
    Some hundred rows reach the driver, however many words there are."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least"))
    words_so_far, least = 0, 2**62
    for row in sorted(sizes.collect(), key=lambda r: -r["step"]):
        words_so_far += row["n"]
        if words_so_far > KNOWN_WORDS:
            break
        least = row["least"]
    return least


def log_likelihood(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    out = held_out(F.col("doc_id"), 10, 0)
    training = docs.select("doc_id", "text").where(~out)
    counts = training.select("text").mapInPandas(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = staged(counts.where("c > 0"), folder, "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where((F.col("c") >= _known_from(counts)) | (F.col("h") == END)).toPandas()
    shared = spark.sparkContext.broadcast(Vocabulary(top, tokens, kinds))
    # Rows are told apart by a number of their own, given once and written down with their codes.
    codes = staged(coded(docs, shared), folder, "codes")
    columns = ["row", "doc", "n_tokens", "n_known", "base", "more"]
    first = codes.select(*columns, "ranks").mapInPandas(_score(fit(codes, shared, folder)), SCORED)
    rare = codes.where("length(rare) > 0").select("row", "rare", "times").mapInPandas(_rare, "row long, h long, times long")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + ADD) / (tokens + ADD * (kinds + 1)))
    other = F.log10((c + ADD) / (shared.value.other_tokens + ADD * (shared.value.other_kinds + 1)))
    sums = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(base * F.col("times")).alias("_base"),
        F.sum(other * F.col("times")).alias("_more"),
    )
    whole = first.join(sums, "row", "left").na.fill(0)
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return whole.select(
        doc.alias("doc_id"), held_out(doc, 10, 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.col("_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("_base")).alias("base_score"), (F.col("more") + F.col("_more")).alias("score"),
    )
