"""Language identification: each document as a mixture of languages, found by expectation-maximisation.

For every language that occurs in the learning documents, counts of letter trigrams (hashed; letters
folded to lower case, all else one blank) are summed over all of them. A document's trigrams have
likelihoods under each language; its proportions are fitted by EM, and its set of languages grows from
the best single one as long as that raises the likelihood by more than a penalty per language. The
prediction is the language of the largest proportion, which is the score.

Null texts and texts without a letter are `und` with score 0, as are all if nothing was learned. Ties
go to the first language by name. Null or empty lang values teach nothing; rows with a null doc_id
are not held out. Repeated rows count and are judged each for itself; an empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID, run_folder, staged

BUCKETS = 1 << 16
SMOOTHING, ROUNDS, PENALTY = 0.05, 12, 3.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, "u4")
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams of a text; empty if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "u4")
    letters = _letters()[points]
    if not letters.any():
        return np.empty(0, "i8")
    letters = np.r_[np.uint32(0), letters, np.uint32(0)]
    keep = (letters[1:] > 0) | (letters[:-1] > 0)
    letters = letters[np.r_[True, keep]]
    if len(letters) < 3:
        letters = np.r_[letters, np.zeros(3 - len(letters), "u4")]
    key = (letters[:-2] * np.uint32(0x9E3779B1) ^ letters[1:-1]) * np.uint32(0x85EBCA77) ^ letters[2:]
    key *= np.uint32(0xC2B2AE3D)
    return (key >> np.uint32(16)).astype("i8")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, "i8")
            found = trigrams(text)
            if len(found) > BUCKETS // 4:
                sums[lang] += np.bincount(found, minlength=BUCKETS)
            else:
                np.add.at(sums[lang], found, 1)
    for lang, counts in sums.items():
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": seen, "n": counts[seen]})


class Model:
    """Log-likelihoods of buckets by language. Its size is languages times buckets."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.zeros((len(counts), BUCKETS))
        for k, lang in enumerate(self.languages):
            table[k] = counts[lang] + SMOOTHING
            table[k] /= table[k].sum()
        self.odds = table.astype("f4")
        self.logs = np.log(table).astype("f4")

    def mixture(self, found: np.ndarray) -> tuple[float, dict[int, float]]:
        """Penalised log-likelihood and proportions of the chosen languages."""
        buckets, n = np.unique(found, return_counts=True)
        single = self.logs[:, buckets] @ n
        order = np.argsort(-single, kind="stable")
        chosen = {int(order[0]): 1.0}
        penalty = PENALTY * np.log(len(found) + 1)
        best = float(single[order[0]]) - penalty
        for more in map(int, order[1:]):
            names = [*chosen, more]
            odds = self.odds[np.ix_(names, buckets)].astype("f8")
            share = np.full(len(names), 1 / len(names))
            for _ in range(ROUNDS):
                parts = share[:, None] * odds
                share = (parts / parts.sum(0)) @ n / len(found)
            value = float(np.log(share @ odds) @ n) - penalty * len(names)
            if value <= best:
                break
            best, chosen = value, dict(zip(names, share.tolist(), strict=True))
        return best, chosen

    def predict(self, text: str | None) -> tuple[str, float]:
        found = trigrams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        _, chosen = self.mixture(found)
        best = min(chosen, key=lambda k: (-chosen[k], self.languages[k]))
        return self.languages[best], min(1.0, float(chosen[best]))


def held_out(doc_id: Column, every: int = 4, which: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % every == which, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Counts over all texts that have a language; what reaches the driver is bounded by languages
    times buckets."""
    taught = docs.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").select("lang", "text")
    counts = taught.mapInPandas(_count, "lang string, bucket int, n long")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = staged(summed, run_folder(docs.sparkSession), "trigrams").toPandas()
    found = {}
    for lang, part in summed.groupby("lang"):
        found[lang] = np.zeros(BUCKETS, "i8")
        found[lang][part["bucket"]] = part["n"]
    return Model(found)


def _predict(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        for frame in frames:
            found = [model.predict(t) for t in frame["text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score"])
            out.insert(0, "doc", frame["doc"])
            yield out

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learning from what is not held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    found = texts.mapInPandas(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc long, lang_pred string, score double")
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return found.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "lang_pred", "score")
