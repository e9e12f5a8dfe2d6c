import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import plain
import pytest

from emberwatch.llm import collocations, sql


def by_hand(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        scored = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(q) for q, b in often.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(
        [(t, g, "p", "f", "k") for t, g in rows], "text string, lang string, phrase string, f string, kinds string"
    )
    out = collocations.mine(df.repartition(3), **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def texts(seed=4, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Über", "é", "a", "a"]
    fixed = ["new York City hall", "a a a a", "once upon a time there", "Ice\tcream", "of the"]
    rows = []
    for k in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(30)]
        marks = [rng.choice([" ", " ", " ", ", ", ".\n", "\x0b", " !? ", "\t"]) for _ in parts]
        rows.append(("".join(p + m for p, m in zip(parts, marks, strict=True)), ["en", "fr", None, ""][k % 4]))
    return rows


@pytest.mark.parametrize(("top", "first", "growth"), [(12, 20, 8), (40, 10**6, 2)])
def test_matches_definition(spark, top, first, growth):
    rows = texts()
    want = by_hand(rows, 5, top)
    assert mined(spark, rows, least=5, top=top, first=first, growth=growth) == want
    assert len(want) > 20


def test_odd_rows(spark):
    long = "one two three four five six " * 9000
    rows = [(None, "en"), ("", "en"), (" \t\n.,;", "fr"), ("x", None), (long, "en"), (long, "en"), ("\x00 \x1c \x85 " * 50, "de")]
    assert mined(spark, rows, least=20, top=50, first=30) == by_hand(rows, 20, 50)


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en")]) == []


def test_scores_beyond_64_bits(spark):
    n = 10**17
    parts = [("a b", 2, n // 10, 5), ("a", 1, n // 5, 5), ("b", 1, n // 7, 5)]
    counts = spark.createDataFrame([("en", p, f, s, True) for p, s, f, _ in parts], "lang string, phrase string, f long, size int, closed boolean")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    from emberwatch.llm.common import run_folder

    got = collocations._scored(counts, totals, run_folder(spark)).collect()[0]
    assert got["score"] == 1000 * (n // 10) * n // ((n // 5) * (n // 7))


def test_settles_before_all_words_are_open(spark, monkeypatch):
    opened, whole = [], collocations.filter_of
    monkeypatch.setattr(collocations, "filter_of", lambda df: opened.append(df) or whole(df))
    rows = texts(9, 200)
    assert mined(spark, rows, least=5, top=3, first=20, growth=4) == by_hand(rows, 5, 3)
    some = len(opened)
    opened.clear()
    mined(spark, rows, least=5, top=10**6, first=20, growth=4)
    assert some < len(opened)


def test_keys_tell_rows_apart():
    rows = np.random.default_rng(2).integers(0, 3, (500, 5))
    for kinds in (3, 2**20, 2**40):
        key = collocations._keys(rows, kinds)
        assert len(np.unique(key)) == len(np.unique(rows, axis=0))


def test_sql(spark):
    rows = texts(3, 100)
    data = pd.DataFrame(rows, columns=["text", "lang"])
    df = collocations.mine(spark.createDataFrame(rows, "text string, lang string"), least=5, top=30, first=20)
    assert plain.plain_rows(df) == plain.sql(sql.collocations(5, 30), documents=data)
