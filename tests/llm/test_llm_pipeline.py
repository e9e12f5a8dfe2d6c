import plain
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_models import best_fit, packed_rows_are_valid  # noqa: E402


def test_pipeline_matches_plain_stages(spark, tmp_path):
    item = "which of the seven bridges did the old mathematician cross twice before his famous proof was done"
    texts = {d: t for d, t, *_ in plain.rows(list(range(23)))}
    texts |= {30 + k: plain.paragraph(40 + k) for k in range(6)} | {40: f"{plain.paragraph(50, 2)}\n{item}\n{plain.paragraph(73, 2)}"}
    rows = [(d, t, "en", "s", len(t) if t else None) for d, t in texts.items()]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")

    wanted = {d: t for d, t in texts.items() if plain.good(t)}
    wanted = plain.line_dedup(wanted)
    wanted = {d: wanted[d] for d in set(plain.jaccard_groups(wanted).values())}
    leaks = {d for d, _ in plain.leaking(wanted, {1: item})}
    assert 40 in leaks
    wanted = {d: t for d, t in wanted.items() if d not in leaks}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths, sequences = packed_rows_are_valid(got, wanted, 2048)
    assert sequences == best_fit(lengths, 2048)


def test_stages_pass_empty_tables_and_keep_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], plain.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in plain.SCHEMA.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
