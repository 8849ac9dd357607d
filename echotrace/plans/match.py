"""A10: original-article matching, one composed job.

posts -> search queries (P2, P4, P5, P6) -> exact top-5 retrieval per query
(J4, W2) -> link policy (F6, F7, F8) -> seen-link de-duplication (W1) ->
copy ratio of every surviving candidate (A5) -> best per post (A6, W3) ->
left merge with defaults (J6) -> bucket statistics (A7) appended (U1).

Each post and each candidate article is tokenised once for scoring.  Python runs
only inside the retrieval blocks, on arrays of a bounded number of articles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.functions.text import clean_text, hyperlink, round_ratio
from echotrace.functions.tokens import Tokenizer, score_tokens
from echotrace.operators import links, retrieve
from echotrace.operators.score import pair_cosine, store_terms, term_rows
from echotrace.session import cut_lineage, stored
from echotrace.sources import sinks


@dataclass
class MatchParams:
    k: int = 5
    stopwords: list = field(default_factory=list)
    excluded_domains: object = field(default_factory=list)
    portal: str = "naver.com"
    channels: dict = field(default_factory=dict)
    oids: DataFrame | None = None  # (channel, oid) table in place of the id lists in ``channels``
    min_body: int = 300
    noun_prefix: str = "n"
    exclude_self: bool = True
    tokenizer: Tokenizer | None = None
    literal_escape: bool = False
    #: Names of bucketed tables of all articles' and all posts' terms: written by the first run, read by later ones.
    term_tables: tuple[str, str] | None = None
    term_buckets: int = 64


def candidates(posts: DataFrame, articles: DataFrame, dictionary: DataFrame, p: MatchParams,
               cleaned: DataFrame | None = None) -> DataFrame:
    """``(idx, cand_pos, q_pos, rank, article_id, link, body)`` in result order."""
    q = retrieve.search_queries(posts, dictionary, noun_prefix=p.noun_prefix, cleaned=cleaned,
                                literal_escape=p.literal_escape)
    hits = retrieve.top_k(q, articles.select("article_id", "body"), k=p.k, tokenizer=p.tokenizer,
                          stopwords=p.stopwords, exclude_self=p.exclude_self)
    hits = hits.join(articles.select("article_id", "link", "body"), "article_id")
    hits = links.apply_policy(hits, p.excluded_domains, p.portal, p.channels, p.min_body, oids=p.oids)
    return retrieve.first_seen(hits, "link")


def scored_candidates(posts: DataFrame, articles: DataFrame, dictionary: DataFrame, p: MatchParams) -> DataFrame:
    """Candidates with ``cosine`` and the rounded ``copy_ratio``."""
    # the posts' cleaned texts feed both the queries and the scoring: clean once
    cleaned = stored(retrieve.clean_post_texts(posts, literal_escape=p.literal_escape))
    cand = cut_lineage(candidates(posts, articles, dictionary, p, cleaned)
                       .select("idx", "cand_pos", "article_id", "link"))
    post_text = cleaned.select("idx", F.concat("title_c", F.lit(" "), "content_c").alias("text"))
    if p.term_tables is None:  # only texts of candidates are cleaned and counted
        post_text = post_text.join(cand.select("idx").distinct(), "idx", "left_semi")
        articles = stored(articles.select("article_id", "body").join(cand.select("article_id").distinct(), "article_id", "left_semi"))
    art_text = articles.select("article_id", clean_text("body", p.literal_escape).alias("text"))
    b_terms = term_rows(post_text, "idx", score_tokens("text", p.tokenizer, p.stopwords))
    a_terms = term_rows(art_text, "article_id", score_tokens("text", p.tokenizer, p.stopwords))
    if p.term_tables is not None:
        a_terms, b_terms = (store_terms(t, name, p.term_buckets) for t, name in zip((a_terms, b_terms), p.term_tables))
    keys = cand.select(F.concat_ws(":", F.col("idx").cast("string"), F.col("cand_pos").cast("string")).alias("pair"),
                       F.col("article_id").alias("a_id"), F.col("idx").alias("b_id"), "idx", "cand_pos", "link")
    cos = pair_cosine(keys.select("pair", "a_id", "b_id"), a_terms, b_terms).select("pair", "cosine")
    return (keys.join(cos, "pair").drop("pair")
                .withColumnRenamed("a_id", "article_id").drop("b_id")
                .withColumn("copy_ratio", round_ratio("cosine")))


def best_matches(scored: DataFrame) -> DataFrame:
    """Max rounded ratio per post, the earlier candidate wins ties."""
    return (scored.groupBy("idx")
                  .agg(F.min_by(F.struct("article_id", "link", "copy_ratio", "cosine"),
                                F.struct((-F.col("copy_ratio")).alias("neg"), F.col("cand_pos"))).alias("b"))
                  .select("idx", "b.article_id", "b.link", "b.copy_ratio", "b.cosine"))


def evidence_of(best: DataFrame, posts: DataFrame, articles: DataFrame, literal_escape: bool = False) -> DataFrame:
    """Evidence text of every matched post; only articles that some post matches are cleaned."""
    titles = posts.select("idx", clean_text("title", literal_escape).alias("title"))
    matched = articles.join(best.select("article_id").distinct(), "article_id", "left_semi")
    return sinks.evidence(best.join(titles, "idx").join(
        matched.select("article_id", clean_text("body", literal_escape).alias("body")), "article_id"))


def with_best(posts: DataFrame, best: DataFrame) -> DataFrame:
    """Every post with all its columns, ``article_link`` ('' when none) and
    ``copy_ratio`` (0.0 when none)."""
    b = best.select(F.col("idx").alias("_i"), hyperlink("link").alias("_link"), F.col("copy_ratio").alias("_ratio"))
    kept = [c for c in posts.columns if c not in ("article_link", "copy_ratio")]
    return (posts.select(*kept).join(b, F.col("idx") == F.col("_i"), "left")
                 .select(*kept, F.coalesce("_link", F.lit("")).alias("article_link"),
                         F.coalesce("_ratio", F.lit(0.0)).alias("copy_ratio")))


def match_posts(posts: DataFrame, articles: DataFrame, dictionary: DataFrame, p: MatchParams) -> DataFrame:
    return with_best(posts, best_matches(scored_candidates(posts, articles, dictionary, p)))


def bucket_stats(result: DataFrame, ratio: str = "copy_ratio") -> DataFrame:
    """Matched (>0), [0.5, 0.9), >= 0.9 and (0, 0.5) counts in one pass."""
    r = F.col(ratio)
    agg = result.agg(F.count_if(r > 0).alias("matched"), F.count_if(r >= 0.9).alias("ge90"),
                     F.count_if(r >= 0.5).alias("ge50_all"))
    return agg.select("matched", (F.col("ge50_all") - F.col("ge90")).alias("ge50"), "ge90",
                      (F.col("matched") - F.col("ge50_all")).alias("gt0"))


# Labels of the four statistics rows and the count suffix.
STAT_LABELS = ["매칭건수", "0.5 이상", "0.9 이상", "0 이상"]
COUNT_SUFFIX = "건"


def with_stats_rows(result: DataFrame, ratio: str = "copy_ratio") -> DataFrame:
    """The result plus four statistics rows (``label``, ``count_text``);
    the other columns of those rows are null."""
    s = bucket_stats(result, ratio)
    rows = s.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("stat_pos"), F.lit(lbl).alias("label"),
                 F.concat(F.col(c).cast("string"), F.lit(COUNT_SUFFIX)).alias("count_text"))
        for i, (lbl, c) in enumerate(zip(STAT_LABELS, ["matched", "ge50", "ge90", "gt0"]))])).alias("r")).select("r.*")
    return result.unionByName(rows, allowMissingColumns=True)
