"""The corpus pipeline: five stages over ``documents``, each one of the corpus operators.

1. quality rules: documents that the line labelling or the base rules reject go;
2. near duplicates: one document of each group stays (five-word shingles, similarity 0.8);
3. secret scans: found spans are masked in the texts;
4. source mix: documents are left out or repeated so that sources meet their targets;
5. best-fit packing: the mix as pieces placed in sequences.

Each stage works on what its predecessor kept, written as Parquet and read again; it
handles empty tables, null columns and extra columns as its operator's docstring says.
The rows cannot be written as SQL (the first stage fits a model); the stages are
tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echotrace.llm import gga_packing, minmax_dedup, mix_sources, quality_crf, secret_ledger
from echotrace.llm.common import docs_of, read_table, scratch_path
from echotrace.llm.token_ids import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_crf.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.kept_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.one_of_each_group(docs, shingle=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gga_packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    out = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return STAGES[-1][1](spark, out, sf_dir)
