"""The queries of this subpackage by name, with their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import collocations, decontaminate, hard_negatives, jaccard_join, language, licenses, line_dedup, lm_score, packing, quality, simhash, sql, url_templates, warc
from emberwatch.llm.common import table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents", "doc_id", "text")).drop("rejected_by")


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url")
    labelled = url_templates.page_labels(pages, table(spark, folder, "labels", "doc_id", "quality"))
    return url_templates.judge_urls(pages, labelled)


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate.leaks(docs, table(spark, folder, "benchmark", "item_id", "text"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    done = line_dedup.dedup_lines(docs, "doc_id").withColumnRenamed("_c0", "doc_id")
    return done.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents", "doc_id", "text"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages", "page_id", "url", "html"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents", "doc_id", "text", "lang"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.log_likelihood(table(spark, folder, "documents", "doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link(table(spark, folder, "documents", "doc_id", "text"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents", "lang", "text"))


def op12_hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.prepared(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.link(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, sql.QUALITY),
    "op2_url_filters": (op2_url_filters, sql.URLS),
    "op3_benchmark_decontamination": (op3_benchmark_decontamination, None),
    "op4_line_dedup": (op4_line_dedup, sql.LINES),
    "op10_ngram_jaccard_join": (op10_ngram_jaccard_join, sql.JACCARD),
    "op5_license_scans": (op5_license_scans, None),
    "op6_warc": (op6_warc, None),
    "op7_language_id": (op7_language_id, None),
    "op8_lm_scoring": (op8_lm_scoring, None),
    "op9_best_fit_packing": (op9_best_fit_packing, None),
    "op11_phrase_collocations": (op11_phrase_collocations, sql.COLLOCATIONS),
    "op12_hard_negative_mining": (op12_hard_negative_mining, sql.HARD_NEGATIVES),
    "op13_simhash_near_dedup": (op13_simhash_near_dedup, None),
}


def queries() -> dict:
    return {name: parts[0] for name, parts in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: parts[1] for name, parts in QUERIES.items() if parts[1]}
