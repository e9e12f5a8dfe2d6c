import random

import numpy as np
import plain
import pytest
import xxhash

from emberwatch.llm import simhash


def by_hand(text):
    words = plain.WORD.findall(plain.lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints):
    """doc -> smallest doc reachable, from (doc, fingerprint) pairs."""
    root = {d: d for d, _ in prints}
    edges = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_fingerprint_matches_definition():
    long = plain.paragraph(1, 3000)
    for text in [None, "", " \t\n", "one", "One two", "a b c", "A\x0bB\x0cC d", "Über ßtraße ÄÖ é x", plain.paragraph(3), long]:
        assert simhash.fingerprint(text) == by_hand(text)


def near_copies(seed=7):
    rng = random.Random(seed)
    rows = plain.rows(list(range(40)))
    for k in range(60):
        words = plain.paragraph(k, 40).split(" ")
        for copy in range(1 + k % 4):
            for _ in range(copy * rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((100 + 10 * k + copy, " ".join(words), "en", None, None, "7", "no", "d", "h", "r", "n", "t"))
    return rows


@pytest.mark.parametrize("tile", [4096, 3])
def test_link_matches_all_pairs(spark, tile):
    rows = near_copies()
    got = simhash.link(spark.createDataFrame(rows, plain.SCHEMA).repartition(5), tile=tile).collect()
    prints = [(r[0], by_hand(r[1])) for r in rows]
    want = groups(prints)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (d, f"{p:016x}", want[d]) for d, p in prints
    )
    assert any(want[d] != d for d, _ in prints if d >= 100)


def test_repeated_and_null_ids(spark):
    a, b, c = plain.paragraph(1), plain.paragraph(2), plain.paragraph(3)
    rows = [(1, a), (5, a), (5, b), (7, b), (None, b), (None, None), (9, c), (9, c), (3, None), (4, "")]
    got = simhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [
        (1, 1), (3, 3), (4, 3), (5, 1), (5, 1), (7, 1), (9, 9), (9, 9),
    ]
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, cell string, component string")
    assert simhash.link(empty).collect() == []


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_compare_connects_what_is_near(n):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 2**63, n, "u8")
    fp[n // 2 :] = fp[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n - n // 2).astype("u8"))
    fp[: n // 10] = fp[0] ^ rng.integers(0, 8, n // 10, "u8")  # a dense group
    fp = np.unique(fp)
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    a, b = simhash.compare(np.zeros(len(fp), "i8"), fp, np.full(len(fp), 2))
    assert len(a) < max(1, len(fp))
    near = {(int(x), int(y)) for x, y in zip(a, b, strict=True)}
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in near:
        root[find(x)] = find(y)
    for k, x in enumerate(fp.tolist()):
        for y in fp[k + 1 :][np.bitwise_count(fp[k + 1 :] ^ fp[k]) <= 3].tolist():
            assert find(x) == find(y)
