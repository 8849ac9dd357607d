"""the post-cleaning job, one lazy plan.

Order of the reference: title prefix (P1) -> URL exclusion (F1) -> keyword
present and no banned term (F2, F3) -> trust filter (F4) -> ending filter (F5)
-> sink.  Every stage is a flag column on the same rows, so the kept output,
the removed halves and the stage counters (A8) all come from one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions.text import preprocess_title
from echotrace.operators import filters as flt


@dataclass
class CleanParams:
    excluded_urls: object = field(default_factory=list)          # F1 list or DataFrame
    banned: list = field(default_factory=list)                   # F3 [(column, term)]
    untrusted_phrases: object = field(default_factory=list)      # F4
    untrusted_domains: object = field(default_factory=list)      # F4
    trusted_domains: object = field(default_factory=list)        # F4
    ending: str = "다."                                           # F5 ending A
    ending_exception: str = "니다."                                # F5 ending B
    keep_term: str = "만평"                                        # F5 cartoon term


def flag_posts(posts: DataFrame, p: CleanParams) -> DataFrame:
    """Adds ``stage``: 0 kept, 1 URL excluded, 2 keyword/banned, 3 untrusted,
    4 ending filter — the first filter that removes the row.  Lists given as
    DataFrames are joined by the text (``filters.contains_flags``)."""
    df = posts.withColumn("title", preprocess_title("title"))
    df = flt.list_flags(df, flt.as_text("url"), {"_url": p.excluded_urls})
    df = flt.list_flags(df, flt.as_text("content"), {"_phrase": p.untrusted_phrases, "_domain": p.untrusted_domains,
                                                     "_trusted": p.trusted_domains})
    search_out = ~flt.keyword_present() | flt.banned_term_flag(p.banned)
    untrusted = (F.col("_phrase") | F.col("_domain")) & ~F.col("_trusted")
    ending = flt.ending_flag(p.ending, p.ending_exception, p.keep_term)
    stage = (F.when(F.col("_url"), 1).when(search_out, 2).when(untrusted, 3).when(ending, 4).otherwise(0))
    return df.withColumn("stage", stage).drop("_url", "_phrase", "_domain", "_trusted")


def clean_posts(posts: DataFrame, p: CleanParams) -> DataFrame:
    return flag_posts(posts, p).where(F.col("stage") == 0).drop("stage")


def removed_posts(posts: DataFrame, p: CleanParams) -> DataFrame:
    return flag_posts(posts, p).where(F.col("stage") != 0)


def counters() -> list[Column]:
    """Kept / removed per stage, as aggregates over ``stage``."""
    s = F.col("stage")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(s != 1).alias("after_url"),
        F.count_if(s == 2).alias("removed_search"),
        F.count_if((s == 0) | (s >= 3)).alias("after_search"),
        F.count_if(s == 3).alias("removed_untrusted"),
        F.count_if((s == 0) | (s == 4)).alias("kept_untrusted"),
        F.count_if(s == 4).alias("removed_ending"),
        F.count_if(s == 0).alias("kept"),
    ]


def stage_counts(posts: DataFrame, p: CleanParams) -> DataFrame:
    """The counters in one aggregation of their own (``plans.jobs.clean_job`` observes them while it writes)."""
    return flag_posts(posts, p).agg(*counters())
