import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import plain
import pytest

pytest.importorskip("emberwatch.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from emberwatch.llm import lm_score, packing, recurrent  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.rows(list(range(23))), plain.SCHEMA).repartition(4).cache()


def test_encoder_gives_the_ids_of_the_tokenizers_library(spark):
    whole, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "a  b", "x \n y", "tab\t end ", "it's we'll 'Sam", "  nb", "ends ", "\x1c a", "日本 語", "<|endoftext|> a", "a\x00b", "é" * 50]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def packed_rows_are_valid(rows, texts, size):
    whole, pieces, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    lengths = []
    for doc, found in pieces.items():
        ids = whole.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(found, key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part)) and r["length"] <= size
            assert k == 0 or r["length"] == size
            at += r["length"]
            lengths.append(r["length"])
        assert at == len(ids) and len(found) == -(-len(ids) // size)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return lengths, len(sequences)


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("size", [2048, 64])
def test_packing_is_exact_and_as_dense_as_best_fit(docs, size):
    rows = packing.pack(docs, PATH, size=size).collect()
    lengths, sequences = packed_rows_are_valid(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, size)
    assert sequences == best_fit(lengths, size)


def test_packing_edges(spark):
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (3, None), (3, None)], "doc_id long, text string")
    rows = packing.pack(odd, PATH, keep_ids=True).collect()
    assert Counter((r["doc_id"], r["length"]) for r in rows) == {(None, 2): 2, (3, 1): 2}
    assert sorted(r["offset"] for r in rows) == [0, 2, 4, 5] and len(rows[0]["data"]) == 4 * rows[0]["length"]
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_plan_equals_best_fit_on_counts():
    pick = random.Random(2)
    for _ in range(40):
        lengths = [pick.randint(1, 100) for _ in range(pick.randint(0, 300))]
        slots, opened = packing.plan(dict(Counter(lengths)), 100)
        assert opened == best_fit(lengths, 100)
        ranks = defaultdict(set)
        for length, rank, n, _, _ in slots:
            ranks[length] |= set(range(rank, rank + n))
        assert {k: len(v) for k, v in ranks.items()} == dict(Counter(lengths))


def test_base_scores_match_a_plain_count(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {100 + k: plain.paragraph(k) for k in range(40)}
    given = spark.createDataFrame([(d, t, "c") for d, t in texts.items()], "doc_id long, text string, score string")
    tokens = {d: plain.WORD.findall(plain.lower(t or "")) + [None] for d, t in texts.items()}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm_score.log_likelihood(given).collect()}
    assert set(got) == set(texts) and {r["train_tokens"] for r in got.values()} == {total}
    for d, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        assert got[d]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[d]["held_out"], got[d]["n_tokens"]) == (out[d], len(ws))
        assert got[d]["n_known"] == sum(counts[w] > 0 for w in ws) and got[d]["score"] < 0


def test_words_beyond_the_known_ones_are_scored_alike(spark, docs, monkeypatch):
    whole = {r["doc_id"]: r for r in lm_score.log_likelihood(docs).collect()}
    monkeypatch.setattr(lm_score, "KNOWN_WORDS", recurrent.SIZE + 3)
    for r in lm_score.log_likelihood(docs).collect():
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], rel=1e-9)
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]
        assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=0.2)


@pytest.mark.parametrize("n", [40, 1500])
def test_every_training_document_teaches_once(spark, monkeypatch, n):
    given = spark.createDataFrame([(k, f"a b {k}") for k in range(n)] + [(None, None)], "doc_id long, text string")
    top = pd.DataFrame({"h": lm_score.Names().of([b"a", b"b"]), "c": [n, n]})
    shared = spark.sparkContext.broadcast(lm_score.Vocabulary(top, 4 * n, n + 2))
    codes = lm_score.coded(given, shared).cache()
    taught = [r["doc"] for turn in range(lm_score.ROUNDS) for r in lm_score.lessons(codes, turn).collect()]
    assert Counter(taught) == Counter([*(k for k in range(n) if zlib.crc32(str(k).encode()) % 10), lm_score.NO_ID])
    weights = []
    monkeypatch.setattr(lm_score, "staged", lambda df, folder, name: weights.append(df) or df)
    lm_score.fit(codes, shared, "")
    rounds = [df for df in weights if df.count()]
    assert sum(r["weight"] for df in rounds for r in df.collect()) == 4 * (len(taught) - 1) + 1  # three words and an end each, and the null text's end


def test_scores_edges(spark):
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (30, None)], "doc_id long, text string")
    got = lm_score.log_likelihood(odd).collect()
    assert sorted((r["n_tokens"], r["held_out"]) for r in got)[1:] == [(3, False), (3, False)]
    assert lm_score.log_likelihood(odd.limit(0)).count() == 0


def slow_score(weights, words):
    state, last, total = np.zeros((1, recurrent.UNITS), "f4"), np.array([recurrent.SIZE]), 0.0
    for word in words:
        state = recurrent.step(weights, state, last)[0]
        last = np.array([word])
        total += float(recurrent.outputs(weights, state, last)[0])
    return total


def test_recurrent_model_is_a_distribution_and_carries_its_state():
    pick = np.random.default_rng(1)
    weights = recurrent.initial(np.arange(500, 0, -1))
    state = pick.standard_normal((1, recurrent.UNITS)).astype("f4") * 0.5
    every = recurrent.outputs(weights, np.repeat(state, recurrent.SIZE, 0), np.arange(recurrent.SIZE))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    texts = [pick.integers(0, recurrent.SIZE, n) for n in (1, 5, 31, 32, 33, 100, 3)]
    assert recurrent.score(weights, texts) == pytest.approx([slow_score(weights, t) for t in texts], rel=1e-4)


def test_a_larger_vocabulary_has_more_classes_and_is_a_distribution():
    assert [recurrent.side_for(n) for n in (0, 1000, 24**4, 24**4 + 1, 10**7, 10**12)] == [24, 24, 24, 25, 57, 255]
    pick, side = np.random.default_rng(2), 30
    weights = recurrent.initial(np.arange(900, 0, -1), side)
    every = recurrent.outputs(weights, np.zeros((900, recurrent.UNITS), "f4"), np.arange(900))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    texts = [pick.integers(0, 900, n) for n in (700, 3, 40, 1)]
    taught = recurrent.train(weights, texts)
    assert all((recurrent.unpack(recurrent.pack(taught))[k] == v).all() for k, v in taught.items())
    assert recurrent.score(taught, texts[:1])[0] > recurrent.score(weights, texts[:1])[0]


def test_the_last_words_of_a_shard_teach_too():
    """131 words in one lane and 257 in two: places that fill up the last lane teach nothing, the words do."""
    for n in (131, 257):
        texts = [np.arange(n) % 5, np.array([7])]
        weights = recurrent.initial(np.ones(recurrent.SIZE))
        other = [texts[0], np.array([9])]
        with_seven, with_nine = recurrent.train(weights, texts), recurrent.train(weights, other)
        assert recurrent.score(with_seven, texts[1:])[0] > recurrent.score(with_nine, texts[1:])[0]


def test_the_end_of_a_text_has_a_rank_however_rare():
    counts = pd.DataFrame({"h": [*range(1, 5000), lm_score.END], "c": [9] * 4999 + [1]})
    known = lm_score.Vocabulary(counts, 9 * 4999 + 1, 5000)
    assert known.find(np.array([lm_score.END]))[1][0] == 1 and known.side == 24
    codes = lm_score.Codes(known)
    hashes, there, base, _, ranks = codes.of([b"", b"never met", b""])
    assert (hashes[0], there.tolist(), ranks.tolist()) == (lm_score.END, [True, False, True], [1, 0, 1])
    assert base[0] == pytest.approx(math.log10(1.1 / (9 * 4999 + 1 + 500.1))) and base[1] == 0


def test_recurrent_model_learns_order():
    pick = np.random.default_rng(4)
    texts = [np.tile(np.arange(k, k + 6), 10) for k in pick.integers(0, 12, 400)]
    weights = recurrent.initial(np.bincount(np.concatenate(texts), minlength=recurrent.SIZE))
    before = recurrent.score(weights, texts[:20]).sum()
    for _ in range(3):
        weights = recurrent.train(weights, texts)
    assert recurrent.score(weights, texts[:20]).sum() > 0.8 * before
    assert all((recurrent.unpack(recurrent.pack(weights))[k] == v).all() for k, v in weights.items())


def test_gradients_match_differences():
    """Backpropagation of the outputs against finite differences of their log-probability."""
    pick = np.random.default_rng(6)
    weights = recurrent.initial(np.ones(recurrent.SIZE))
    states = pick.standard_normal((40, recurrent.UNITS)).astype("f4") * 0.3
    words = pick.integers(0, recurrent.SIZE, 40)
    _, to_state, slopes = recurrent.outputs(weights, states, words, train=True)
    for name, at in (("class", (3, 5)), ("class", (recurrent.UNITS, 2)), ("word", (words[0] // recurrent.WORDS, 1, 4))):
        up, down = ({k: v.astype("f8") for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        change = -(recurrent.outputs(up, states, words).sum() - recurrent.outputs(down, states, words).sum()) / 2e-3
        assert slopes[name][at] == pytest.approx(change, rel=0.02, abs=2e-3)
    moved = states.astype("f8")
    moved[2, 3] += 1e-3
    change = -(recurrent.outputs(weights, moved, words).sum() - recurrent.outputs(weights, states.astype("f8"), words).sum()) / 1e-3
    assert to_state[2, 3] == pytest.approx(change, rel=0.05, abs=2e-3)
