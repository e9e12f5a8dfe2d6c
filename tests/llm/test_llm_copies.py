import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

pytest.importorskip("emberwatch.llm")

from emberwatch.llm import jaccard_join, line_dedup, sql  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(plain.rows(list(range(23))), plain.SCHEMA).repartition(5).cache()


def test_lines_match_sql(docs):
    got = line_dedup.dedup_lines(docs, "doc_id").withColumnRenamed("_c0", "doc_id").drop("kept_text")
    assert plain.plain_rows(got) == plain.sql(sql.LINES, documents=docs.select("doc_id", "text").toPandas())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = line_dedup.cut_lines(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] or "" for r in cut.collect()} == plain.line_dedup(texts)
    assert {r["n_words"] for r in cut.collect()} == {"7"} and cut.where("text IS NULL").count() == 1


def test_lines_edges(spark):
    text = f"{plain.SHARED}\nmore"
    odd = spark.createDataFrame([(k, text) for k in (1, 1, 2, 3, None, None)], "doc_id long, text string")
    same = {r["n_dropped"] for r in line_dedup.dedup_lines(odd).collect()}
    assert same == {0}  # four different documents, the null one included
    more = odd.unionByName(spark.createDataFrame([(9, text)], odd.schema))
    got = sorted((r["n_dropped"], r["kept_sha256"]) for r in line_dedup.dedup_lines(more).collect())
    assert [n for n, _ in got] == [0, 1, 1, 1, 1, 1, 1]
    assert got[1][1] == hashlib.sha256(b"more").hexdigest()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_round_trips():
    random = np.random.default_rng(3)
    keys = np.empty(3000, line_dedup.KEY)
    keys["hi"], keys["lo"] = random.integers(0, 2**63, (2, 3000), "u8")
    _, number = line_dedup.build_shard(keys[:2000])
    assert sorted(number) == list(range(2000))
    counts = np.arange(2000)
    shard = line_dedup.Shard.unpack(line_dedup.Shard.build(keys[:2000], counts, counts * 2).pack())
    found = shard.find(keys)
    assert (found[2000:] == -1).all()
    assert (shard.counts[found[:2000]] == counts).all() and (shard.largest[found[:2000]] == counts * 2).all()


def near_copies(seed: int, groups: int = 12) -> dict[int, str]:
    pick, found = random.Random(seed), {}
    for g in range(groups):
        words = [f"w{g}n{k}" for k in range(pick.choice([5, 9, 20, 60, 200]))]
        for _ in range(pick.randint(1, 6)):
            mine = list(words)
            for _ in range(pick.randint(0, max(1, len(words) // 40))):
                mine[pick.randrange(len(mine))] = f"x{pick.random()}"
            found[len(found)] = " ".join(mine) + pick.choice(["", " end", "\nend of it"])
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_brute_force(spark, docs, seed):
    texts = near_copies(seed) | {1000 + r["doc_id"]: r["text"] for r in docs.collect()}
    given = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r for r in jaccard_join.link(given.repartition(6)).collect()}
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(plain.shingle_set(t)) for d, t in texts.items()}
    assert {d: r["component_id"] for d, r in got.items()} == plain.jaccard_groups(texts)


def test_large_blocks_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    texts = {}
    for k in range(40):
        words = [f"w{i}" for i in range(60 + k)]
        words[k % 50] = f"other{k}"
        texts[k] = " ".join(words)
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(given).collect()}
    assert got == plain.jaccard_groups(texts)
    stays = jaccard_join.keep_first(given)
    assert {r["doc_id"] for r in stays.collect()} == set(got.values())


def test_links_edges(spark):
    odd = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "A b\nc d e")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(odd).collect())
    assert got == {(None, 2, None): 2, (4, 2, 2): 2, (2, 2, 2): 1}
    assert jaccard_join.link(odd.limit(0)).count() == 0
    assert jaccard_join.keep_first(odd).count() == 3


def test_parts_of_linked_sets_agree():
    random, parts = np.random.default_rng(5), jaccard_join.Parts()
    for n in [*range(1, 60), 200, 333, 1500]:
        for _ in range(20):
            a = np.unique(random.integers(0, 2**63, n, "u8"))
            b = np.unique(np.r_[a[random.random(len(a)) > 0.08], random.integers(0, 2**63, int(n * 0.08), "u8")])
            inside = len(np.intersect1d(a, b))
            if len(b) and 100 * inside >= 85 * (len(a) + len(b) - inside) and len(a) + len(b) > 2 * inside:
                assert len(np.intersect1d(parts.of(a), parts.of(b))), (n, inside)


def test_components_of_long_chains(spark, tmp_path):
    from emberwatch.llm.common import components

    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 102), (102, 101), (7, 7)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), str(tmp_path))
    roots = defaultdict(set)
    for r in got.collect():
        roots[r["root"]].add(r["node"])
    assert roots == {0: set(range(61)), 100: {100, 101, 102}}


@pytest.mark.parametrize("chunk", [3, 1500])
def test_a_document_has_the_links_of_all_its_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b + " more")]
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (5, 1), (7, 1)}
    pick = random.Random(chunk)
    rows = [(pick.randrange(45), t) for seed in (3, 4) for t in near_copies(seed, 9).values() for _ in range(pick.choice([1, 1, 2]))]
    root = {d: d for d, _ in rows}
    each = plain.jaccard_groups(dict(enumerate(t for _, t in rows)))
    for _ in rows:
        for k, first in each.items():
            low = min(root[rows[k][0]], root[rows[first][0]])
            root[rows[k][0]] = root[rows[first][0]] = low
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == set(root.items())


def test_common_passages_make_no_blocks(spark, monkeypatch):
    seen, cells = [], jaccard_join._cells
    monkeypatch.setattr(jaccard_join, "_cells", lambda blocks, percent: seen.extend(blocks.collect()) or cells(blocks, percent))
    common = " ".join(f"common{i}" for i in range(60))
    texts = {k: f"{common} " + " ".join(f"own{k}n{i}" for i in range(60)) for k in range(40)}
    texts |= {50: texts[7] + " end", 51: texts[7] + " end of it"}
    got = jaccard_join.link(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain.jaccard_groups(texts)
    assert {7, 50, 51} <= {r["node"] for r in seen} and len(seen) < 15


@pytest.mark.parametrize("often", [1, 3])
def test_frequent_parts_lose_no_link(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "CHUNK", 20)
    texts = near_copies(7, 10)
    words = [f"w{i}" for i in range(120)]
    for k in range(40):
        mine = list(words)
        mine[3 * k % 120] = f"other{k}"
        texts[100 + k] = " ".join(mine)
    texts |= {200 + k: " ".join(words[:90] + [f"own{k}n{i}" for i in range(40)]) for k in range(8)}
    texts |= {300: texts[104], 301: texts[104].upper(), 302: texts[200]}
    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(given).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain.jaccard_groups(texts)


def test_linked_sets_have_as_many_parts_in_common_as_they_need():
    random, parts = np.random.default_rng(6), jaccard_join.Parts()
    for n in [*range(3, 70), 200, 777]:
        for _ in range(20):
            a = np.unique(random.integers(0, 2**63, n, "u8"))
            b = np.unique(np.r_[a[random.random(len(a)) > 0.07], random.integers(0, 2**63, int(n * 0.08), "u8")])
            inside = len(np.intersect1d(a, b))
            if len(b) and 100 * inside >= 85 * (len(a) + len(b) - inside) and len(a) + len(b) > 2 * inside:
                (sa, na), (sb, nb) = parts.asked(a), parts.asked(b)
                both, x, y = np.intersect1d(sa, sb, return_indices=True)
                assert len(both) >= np.maximum(na[x], nb[y]).min(), (n, inside)


def test_stage_keeps_documents_of_a_common_passage_without_comparing_them(spark, monkeypatch):
    import corpus_pipeline

    seen, cells = [], jaccard_join._cells
    monkeypatch.setattr(jaccard_join, "_cells", lambda blocks, percent: seen.extend(blocks.collect()) or cells(blocks, percent))
    common = " ".join(f"license{i}" for i in range(100))
    texts = {k: f"{common} " + " ".join(f"own{k}n{i}" for i in range(100)) for k in range(30)}
    texts |= {90: texts[4] + " end", 91: texts[5]}
    given = spark.createDataFrame([(d, t, "en") for d, t in texts.items()], "doc_id long, text string, lang string")
    stays = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, given, "")
    assert stays.columns == given.columns
    assert sorted((r["doc_id"], r["text"]) for r in stays.collect()) == [(k, texts[k]) for k in range(30)]
    assert {4, 90} <= {r["node"] for r in seen} and len(seen) < 15
