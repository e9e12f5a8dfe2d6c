"""Hash chains against a plain walk along each ledger."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import ledger

SCHEMA = "book string, seq long, " + ", ".join(f"{c} string" for c in ledger.HASHED) + ", prev_hash string, entry_hash string"


def digest(prev, fields):
    return hashlib.sha256(json.dumps([prev, *fields], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def books(seed, n=240):
    """Entries of four ledgers, one with a third of them and one without a name; gaps between numbers are wide."""
    rng = random.Random(seed)
    found, at = {}, 0
    for _ in range(n):
        at += rng.choice([1, 1, 2, 40, 500])
        book = "hot" if rng.random() < 0.34 else rng.choice(["a", "null", None])
        prev = found[book][-1][-1] if book in found else ledger.GENESIS
        fields = [rng.choice([None, "", "x", 'qu"ote', "\u00e9", str(at)]) for _ in ledger.HASHED]
        found.setdefault(book, []).append([book, at, *fields, prev, digest(prev, fields)])
    return found


def walk(entries):
    """Number, first broken entry and head of one ledger, entry after entry."""
    prev, broken = ledger.GENESIS, None
    for _, seq, *fields, said, stored in entries:
        if broken is None and (said != prev or digest(said, fields) != stored):
            broken = seq
        prev = stored
    return len(entries), broken, entries[-1][1], entries[-1][-1]


@pytest.mark.parametrize("harm", ["none", "edit", "removal", "both", "no link"])
def test_chains_match_a_plain_walk(spark, harm):
    found, rng = books(5), random.Random(harm)
    for entries in found.values():
        if harm in ("edit", "both"):
            entries[rng.randrange(len(entries))][4] = "edited"
        if harm in ("removal", "both"):
            del entries[rng.randrange(1, len(entries) - 1)]
        if harm == "no link":
            entries[rng.randrange(len(entries))][-2] = None
    old = [["a", 0, *[None] * len(ledger.HASHED), None, None], ["old", 3, *[None] * len(ledger.HASHED), None, None]]
    log = spark.createDataFrame([tuple(e) for es in found.values() for e in es] + [tuple(e) for e in old], SCHEMA).repartition(3)
    want = {book: (*walk(entries), int(book == "a")) for book, entries in found.items()} | {"old": (0, None, None, None, 1)}
    for block, group in ((50, 3), (1, 1), (10**6, 10)):
        got = ledger.verify_chains(log, ["book"], block, group)
        assert {r[0]: tuple(r)[1:] for r in got.select("book", "chained", "first_broken", "head_seq", "head_hash", "legacy").collect()} == want
    one = ledger.verify_chain(log.filter("book = 'hot'"), 50).select("chained", "first_broken", "head_seq", "head_hash", "legacy").first()
    assert tuple(one) == (*want["hot"][:4], 0)


def test_empty_logs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ledger.verify_chains(empty, ["book"]).collect() == []
    assert ledger.verify_chain(empty).select("chained", "first_broken", "legacy").first() == (0, None, 0)


def test_no_entry_is_dropped(spark):
    log = spark.createDataFrame([tuple(e) for es in books(6).values() for e in es], SCHEMA)
    checked = ledger.check_entries(log, 7, ["book"], 2)
    assert checked.count() == log.count() and checked.filter(~(F.col("hash_ok") & F.col("link_ok"))).count() == 0
