"""Views that turn the driver tables into the inputs the operators expect.

They are pure derivations of whole tables (every document, every page, every
benchmark passage); the same definitions are written in DuckDB SQL in
``echotrace.plans.oracle``.

* ``posts``    every document as a post: first line as title (every fifth
               title carries a ``&keyword=`` suffix), text, keyword, account,
               url of the page with the same id.
* ``articles`` every document as an article with a link; a third of the links
               look like portal links with a publisher id.  Matching excludes
               the pair (post i, article i), so no text meets itself.
* ``pairs``    neighbouring documents, plus benchmark passages against the
               documents that share a run of eight words with them.
* ``tokens``   long token table ``(doc_id, pos, token)``.
* ``dictionary`` synthetic (surface, tag) table: every token, tagged by its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import regex as R
from echotrace.functions.segment import words
from echotrace.functions.tokens import cut_words, score_text, whitespace_tokens
from echotrace.functions.text import py_strip
from echotrace.session import read_table

#: Words in a row that a passage and a document share.
RUN_WORDS = 8
#: Texts hashed at once inside a task.
HASHED_ROWS = 256


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").alias("d")
    p = read_table(spark, sf_dir, "pages").select("page_id", "url").alias("p")
    title = F.concat(
        F.substring_index(F.col("d.text"), "\n", 1),
        F.when(F.col("d.doc_id") % 5 == 0, F.concat(F.lit("&keyword=k"), F.col("d.lang"))).otherwise(F.lit("")),
    )
    keyword = (F.when(F.col("d.lang") == "en", "the").when(F.col("d.lang") == "fr", "les")
                .when(F.col("d.lang") == "de", "und").otherwise("que"))
    return (d.join(p, F.col("p.page_id") == F.col("d.doc_id"), "left")
             .select(F.col("d.doc_id").alias("idx"), title.alias("title"), F.col("d.text").alias("content"),
                     keyword.alias("keyword"), F.col("d.source").alias("account"), F.col("p.url").alias("url")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    portal = F.concat(F.lit("https://n.news.portal.example/mnews/article/"),
                      F.lpad((F.col("doc_id") % 7).cast("string"), 3, "0"), F.lit("/"),
                      F.col("doc_id").cast("string"))
    plain = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("article_id"),
                    F.when(F.col("doc_id") % 3 == 0, portal).otherwise(plain).alias("link"),
                    F.col("text").alias("body"))


def _runs(df: DataFrame, id_col: str) -> DataFrame:
    """(id, run): distinct runs of ``RUN_WORDS`` words anywhere in the text."""
    w = df.select(id_col, words("text").alias("_w")).where(F.size("_w") >= RUN_WORDS)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (RUN_WORDS - 1)),
                       lambda i: F.array_join(F.slice("_w", i, RUN_WORDS), " "))
    return w.select(id_col, F.explode(F.array_distinct(runs)).alias("run"))


def _run_hashes(df: DataFrame, id_col: str) -> DataFrame:
    """(id, h): hashes of the runs, many texts at once; equal runs have equal hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, HASHED_ROWS):
                part = batch.slice(lo, HASHED_ROWS)
                lists = cut_words(part.column("w"))
                row, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
                word = pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False))[flat.indices.to_numpy()]
                n = len(word) - RUN_WORDS + 1
                if n <= 0:
                    continue
                h = np.zeros(n, np.uint64)
                for k in range(RUN_WORDS):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + word[k:n + k]
                at = np.flatnonzero(row[:n] == row[RUN_WORDS - 1:])
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row[at])), pa.array(h[at].view(np.int64))], [id_col, "h"])
            pa.default_memory_pool().release_unused()

    spaced = F.regexp_replace(py_strip(F.coalesce("text", F.lit(""))), R.WS + "+", " ")  # its words are cut in the task
    return df.select(id_col, spaced.alias("w")).mapInArrow(run, f"{id_col} long, h long")


def _passage_candidates(bench: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, texts): passages and documents that share a run of words.

    Whole passages and whole documents are shingled.  Hashes of the runs pick the
    documents that can share one; only theirs are spelled out and joined exactly, with
    ids only, and the texts follow for the pairs found."""
    some = _run_hashes(docs, "doc_id").join(_run_hashes(bench, "item_id").select("h").distinct(), "h", "left_semi").select("doc_id").distinct()
    near = (_runs(bench, "item_id").join(_runs(docs.join(some, "doc_id", "left_semi"), "doc_id"), "run")
                .select("item_id", "doc_id").distinct())
    return (near.join(bench.select("item_id", F.col("text").alias("i_text")), "item_id")
                .join(docs.select("doc_id", F.col("text").alias("d_text")), "doc_id")
                .select("item_id", "doc_id", "i_text", "d_text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark")
    a, b = docs.alias("a"), docs.alias("b")
    neighbours = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1).select(
        F.concat(F.lit("n"), F.col("a.doc_id").cast("string")).alias("pair_id"),
        F.col("a.text").alias("article"), F.col("b.text").alias("post"))
    passages = _passage_candidates(bench, docs).select(
        F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit("_"), F.col("doc_id").cast("string")).alias("pair_id"),
        F.col("i_text").alias("article"), F.col("d_text").alias("post"))
    return neighbours.unionByName(passages)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(read_table(spark, sf_dir, "documents"), "doc_id")


def token_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns with every token of ``text`` and its position."""
    toks = whitespace_tokens(score_text("text"))
    return docs.select(*kept, F.posexplode_outer(toks).alias("pos", "token")).where(F.col("pos").isNotNull())


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    toks = F.array_distinct(whitespace_tokens(score_text("text")))
    tag = (F.when(F.length("surface") % 4 == 0, "ncn").when(F.length("surface") % 4 == 1, "pvg")
            .when(F.length("surface") % 4 == 2, "jcs").otherwise("mag"))
    return (d.select(F.explode_outer(toks).alias("surface")).where(F.col("surface").isNotNull())
             .distinct().select("surface", tag.alias("tag")))
