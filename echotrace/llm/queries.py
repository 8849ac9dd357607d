"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm import (gga_packing, html_tree, importance_resampling, minmax_dedup, mix_sources, periodic_runs,
                           pfor_tokens, posting_ann, quality_crf, rule_ensemble, secret_ledger, suffix_dedup,
                           url_templates)
from echotrace.llm.common import docs_of, pages_of, read_table, scratch_path
from echotrace.llm.token_ids import tokenizer_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line labelling on every document."""
    docs = docs_of(spark, sf_dir)
    model = quality_crf.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.verdicts(docs.select("doc_id", "text"), model).drop("text")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without strings of 100 bytes that start earlier too."""
    return suffix_dedup.remove_repeats(docs_of(spark, sf_dir)).drop("kept_text")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: words taken of each."""
    return mix_sources.mix(docs_of(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_ledger.scan_documents(docs_of(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url."""
    labels = url_templates.page_labels(read_table(spark, sf_dir, "labels"))
    return url_templates.judge(pages_of(spark, sf_dir).select("page_id", "url"), labels).drop("bad_share")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 4096 tokens."""
    return gga_packing.pack_documents(docs_of(spark, sf_dir), tokenizer_path())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    found = minmax_dedup.near_duplicates(docs_of(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = scratch_path(spark, "token-files")
    pfor_tokens.write_files(docs_of(spark, sf_dir), path, tokenizer_path(), end_id=2)
    return pfor_tokens.read_documents(spark, path)


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every vector whose id is divisible by 20."""
    return posting_ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_tree.extract(pages_of(spark, sf_dir))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs, labels = docs_of(spark, sf_dir), read_table(spark, sf_dir, "labels")
    model = rule_ensemble.train(docs, labels.where(~rule_ensemble.held_out(F.col("doc_id"))))
    return rule_ensemble.classify(docs.select("doc_id", "text"), model, threshold=0.3).select(
        "doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw of a tenth of all documents in proportion to their likeness to the benchmark's words."""
    found = importance_resampling.resample(docs_of(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words in every document, and the text without their repeats."""
    texts = periodic_runs.with_planted_period(docs_of(spark, sf_dir))
    return periodic_runs.digests(periodic_runs.find_runs(texts, min_exponent=4, min_length=6))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_mix_sources": op3_mix_sources,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_files": op8_token_files,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_main_text": op10_main_text,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {
    "op3_mix_sources": mix_sources.MIX_SQL.format(documents="documents"),
    "op4_secret_scan": secret_ledger.LEDGER_SQL.format(documents="documents"),
    "op5_url_filter": url_templates.templates_sql(),
    "op7_near_duplicates": minmax_dedup.NEAR_SQL,
    "op12_importance_resampling": importance_resampling.resample_sql(seed=2024),
}
