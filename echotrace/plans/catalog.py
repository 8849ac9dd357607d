"""Registered queries over the driver tables and their DuckDB oracles.

Every query reads whole tables (or views Spark derives from them); list
parameters are small literal DataFrames, as a user would pass their own lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import text as tx
from echotrace.operators import filters as flt
from echotrace.operators import score
from echotrace.functions import segment as seg
from echotrace.operators import pages as pg
from echotrace.operators import lattice
from echotrace.operators import links as lk
from echotrace.operators import retrieve
from echotrace.sources import sinks
from echotrace.operators import tags as tg
from echotrace.session import cut_lineage, read_table, scratch_path
from echotrace.sources import readers as rd
from echotrace.sources.corpus_source import read_corpus_chunks, write_text_files
from echotrace.sources.reference_data import CLASS_TAGSET, TAG_HIERARCHY_LINES
from echotrace.functions.text import normalize_for_score as _norm
from echotrace.functions.tokens import require_string, tokens_by_table
from echotrace.functions.tokens import whitespace_tokens as _wst
from echotrace.plans import clean, fixtures, jobs, match, oracle

# Parameters of the Latin fixtures (small literal lists, see FIXTURES.md).
STOPWORDS = ["a", "an", "the", "of", "and", "to", "in", "is", "le", "la", "les", "de", "des", "et",
             "der", "die", "das", "und", "el", "los", "que", "y"]


CLEAN = clean.CleanParams(
    excluded_urls=["spam-farm", "cheap-pills"],
    banned=[("content", "license"), ("title", "license"), ("account", "src19")],
    untrusted_phrases=["MIT License", "Released under"],
    untrusted_domains=["@"],
    trusted_domains=["ing "],
    ending="nd.", ending_exception="and.", keep_term="xyz",
)
POST_COLS = ["idx", "title", "content", "keyword", "account", "url"]

MATCH = match.MatchParams(
    k=5, stopwords=STOPWORDS,
    excluded_domains=["src7.example.com"],
    portal="portal.example",
    channels={"n.news.portal.example": ["001", "003", "005"],
              "sports.portal.example": ["002"],
              "entertain.portal.example": ["004"]},
)


def _match_inputs(spark, sf_dir):
    return fixtures.posts(spark, sf_dir), fixtures.articles(spark, sf_dir), fixtures.dictionary(spark, sf_dir)


# ------------------------------------------------------------------ A5
def q_copy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.copy_ratio(fixtures.pairs(spark, sf_dir), "pair_id", "article", "post", stopwords=STOPWORDS)


def q_copy_ratio_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: mean over the article's sentences."""
    return score.copy_ratio(fixtures.pairs(spark, sf_dir), "pair_id", "article", "post", stopwords=STOPWORDS, per_sentence=True).select(
        "pair_id", F.round("cosine", 9).alias("cosine"), F.round("cosine", 2).alias("ratio"))


def first_letters(texts: pa.Array, n: int = 5) -> pa.ListArray:
    """A plain stemmer: white-space words cut to their first ``n`` characters."""
    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten()
    owner, some = pc.list_parent_indices(lists), pc.not_equal(words, "")
    owner, words = owner.filter(some).to_numpy(), pc.utf8_slice_codeunits(words.filter(some), 0, n)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()), words)


def q_copy_ratio_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents scored with a tokenizer of choice, a table function over the texts."""
    docs = read_table(spark, sf_dir, "documents")
    stop = rd.list_frame(spark, STOPWORDS, "token")
    terms = score.terms_of_rows(tokens_by_table(docs, "doc_id", F.col("text"), first_letters, stop))
    a, b = docs.select(F.col("doc_id").alias("a_id")), docs.select(F.col("doc_id").alias("b_id"))
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 1).withColumn("pair", F.concat(F.lit("n"), F.col("a_id").cast("string")))
    return score.pair_cosine(pairs, terms, terms).select(F.col("pair").alias("pair_id"), "cosine")


# ------------------------------------------------------------------ cleaning
def q_clean_posts(spark, sf_dir):
    return clean.clean_posts(fixtures.posts(spark, sf_dir), CLEAN).select(*POST_COLS)


def q_clean_stage_counts(spark, sf_dir):
    return clean.stage_counts(fixtures.posts(spark, sf_dir), CLEAN)


def q_removed_posts(spark, sf_dir):
    return clean.removed_posts(fixtures.posts(spark, sf_dir), CLEAN).select("idx", "stage")


def q_title_prefix(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select("idx", tx.preprocess_title("title").alias("title"))


def q_url_exclusion(spark, sf_dir):
    return flt.exclude_urls(fixtures.posts(spark, sf_dir), CLEAN.excluded_urls).select("idx", "url")


def q_keyword_filter(spark, sf_dir):
    return flt.keep_keyword_posts(fixtures.posts(spark, sf_dir)).select("idx", "keyword")


def q_banned_terms(spark, sf_dir):
    return flt.drop_banned(fixtures.posts(spark, sf_dir), CLEAN.banned).select("idx", "account")


def q_trust_filter(spark, sf_dir):
    p = fixtures.posts(spark, sf_dir)
    flag = flt.untrusted_flag(CLEAN.untrusted_phrases, CLEAN.untrusted_domains, CLEAN.trusted_domains)
    return p.select("idx", flag.alias("removed"))


def q_ending_filter(spark, sf_dir):
    p = fixtures.posts(spark, sf_dir).withColumn("title", tx.preprocess_title("title"))
    return p.select("idx", flt.ending_flag(CLEAN.ending, CLEAN.ending_exception, CLEAN.keep_term).alias("removed"))


def q_column_counts(spark, sf_dir):
    return flt.non_null_counts(fixtures.posts(spark, sf_dir), POST_COLS)


# ------------------------------------------------------------------ matching
def q_search_queries(spark, sf_dir):
    posts, _, d = _match_inputs(spark, sf_dir)
    return retrieve.search_queries(posts, d, noun_prefix=MATCH.noun_prefix)


def q_retrieve_top5(spark, sf_dir):
    posts, arts, d = _match_inputs(spark, sf_dir)
    qs = retrieve.search_queries(posts, d, noun_prefix=MATCH.noun_prefix)
    return retrieve.top_k(qs, arts.select("article_id", "body"), k=MATCH.k,
                          stopwords=MATCH.stopwords)


def q_match_candidates(spark, sf_dir):
    posts, arts, d = _match_inputs(spark, sf_dir)
    return match.scored_candidates(posts, arts, d, MATCH).select(
        "idx", "cand_pos", "article_id", "link", "cosine", "copy_ratio")


def q_match_posts(spark, sf_dir):
    posts, arts, d = _match_inputs(spark, sf_dir)
    return match.match_posts(posts, arts, d, MATCH).select("idx", "article_link", "copy_ratio")


def q_match_stats(spark, sf_dir):
    return match.bucket_stats(q_match_posts(spark, sf_dir))


FLAGSHIP = q_match_posts


def q_match_report(spark, sf_dir):
    return match.with_stats_rows(q_match_posts(spark, sf_dir)).select(
        "idx", "article_link", "copy_ratio", "stat_pos", "label", "count_text")


def q_match_evidence(spark, sf_dir):
    """Evidence text of every matched post (title, link and article body)."""
    posts, arts, d = _match_inputs(spark, sf_dir)
    best = cut_lineage(match.best_matches(match.scored_candidates(posts, arts, d, MATCH)))
    return match.evidence_of(best, posts, arts)


def q_link_policy(spark, sf_dir):
    a = fixtures.articles(spark, sf_dir)
    return a.select("article_id",
                    lk.link_allowed("link", MATCH.excluded_domains).alias("link_ok"),
                    lk.channel_allowed("link", MATCH.portal, MATCH.channels).alias("channel_ok"),
                    lk.body_long_enough("body", MATCH.min_body).alias("body_ok"))


def q_title_keywords(spark, sf_dir):
    posts, _, d = _match_inputs(spark, sf_dir)
    t = posts.select("idx", tx.truncate(tx.clean_text(tx.clean_text("title"))).alias("title_q"))
    return retrieve.title_nouns(t, d, "idx", "title_q", MATCH.noun_prefix)


def q_unsegmented_nouns(spark, sf_dir):
    """The first five nouns of every title written without spaces, cut by the dictionary lattice."""
    posts, _, d = _match_inputs(spark, sf_dir)
    title = tx.truncate(tx.clean_text(tx.clean_text("title")))
    glued = posts.select("idx", F.array_join(_wst(F.lower(_norm(title))), "").alias("word"))
    nouns = tg.noun_rows(lattice.segmented(glued, d), prefix=MATCH.noun_prefix)
    first = nouns.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("m_pos", "morph"))).alias("n"))
    return first.select("idx", F.array_join(F.slice(F.transform("n", lambda x: x["morph"]), 1, 5), " ").alias("keywords"))


def q_word_groups(spark, sf_dir):
    """The words of every document split after each word that ends a
    sentence (indices from the data)."""
    d = _docs(spark, sf_dir).select("doc_id", seg.words("text").alias("w"))
    # positions after each word ending a sentence, computed in one pass
    d = d.withColumn("ends", F.filter(F.transform("w", lambda x, i: F.when(x.rlike("[.!?]$"), i + 1)),
                                      lambda i: i.isNotNull() & (i < F.size("w"))))
    g = d.select("doc_id", tx.partition_array("w", "ends").alias("groups"))
    # outer: no inferred size() filter that would re-derive the groups per row;
    # there is always at least one group, so the rows are the same
    return g.select("doc_id", F.posexplode_outer("groups").alias("g_pos", "words")).select(
        "doc_id", "g_pos", F.size("words").alias("n_words"), F.array_join("words", " ").alias("text"))


# ------------------------------------------------------------------ pages
FIXTURE_SELECTORS = {"example.com": "article", "example.net": "div.ad", "example.org": "article p"}


def q_extract_bodies(spark, sf_dir):
    return pg.extract_bodies(read_table(spark, sf_dir, "pages"))


def q_extract_bodies_selector(spark, sf_dir):
    return pg.extract_bodies(read_table(spark, sf_dir, "pages"), FIXTURE_SELECTORS)


def q_long_bodies(spark, sf_dir):
    b = pg.extract_bodies(read_table(spark, sf_dir, "pages"))
    return b.where(F.length("body") > MATCH.min_body).select("page_id", F.length("body").alias("n_chars"))


def q_url_keys(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", tx.url_host("url").alias("host"), tx.domain_key("url").alias("domain_key"),
                    tx.oid_from_url("url").alias("oid"))


def q_article_oids(spark, sf_dir):
    a = fixtures.articles(spark, sf_dir)
    return a.select("article_id", tx.oid_from_url("link").alias("oid"), tx.domain_key("link").alias("domain_key"))


# ------------------------------------------------------------------ column functions
def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def q_clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("clean"),
                                       tx.clean_text("text", literal_escape=True).alias("clean_literal"))


def q_normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_for_score("text").alias("norm"))


def q_first_sentences(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", seg.first_sentences("text").alias("s"))
    return d.select("doc_id", "s.first", "s.second", "s.last")


def q_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(seg.sentences("text")).alias("s_pos", "sentence"))


def q_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(seg.words("text")).alias("pos", "word"))


def q_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(seg.lines("text")).alias("line_pos", "line"))


def q_concordance(spark, sf_dir):
    return seg.concordance(_docs(spark, sf_dir).select("doc_id", "text"), "text", "the").select(
        "doc_id", "pos", "context")


def q_text_utils(spark, sf_dir):
    d = _docs(spark, sf_dir)
    hx = F.when(F.length("text") > 0, tx.char2hex("text"))
    return d.select("doc_id", tx.normalize_punctuation("text").alias("punct"),
                    tx.delete_links("text").alias("no_links"), tx.delete_mentions("text").alias("no_mentions"),
                    hx.alias("first_hex"), tx.hex2char(hx).alias("first_char"),
                    tx.truncate("text").alias("head100"),
                    tx.safe_file_name("doc_id", F.substring_index("text", "\n", 1)).alias("file_name"))


def q_tokens(spark, sf_dir):
    return fixtures.tokens(spark, sf_dir)


def q_dictionary(spark, sf_dir):
    return fixtures.dictionary(spark, sf_dir)

# ------------------------------------------------------------------ tags
def _doc_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", _wst(F.lower(_norm("text"))).alias("toks"))


def q_tag_tokens(spark, sf_dir):
    return tg.tag_with_dictionary(fixtures.tokens(spark, sf_dir), fixtures.dictionary(spark, sf_dir))


def q_noun_tokens(spark, sf_dir):
    t = tg.tag_with_dictionary(fixtures.tokens(spark, sf_dir), fixtures.dictionary(spark, sf_dir), default_tag=None)
    return tg.noun_rows(t, prefix="n").select("doc_id", "pos", "token")


def q_tag_classes(spark, sf_dir):
    t = q_tag_tokens(spark, sf_dir)
    ts = rd.tagset_frame(spark, CLASS_TAGSET, "classes")
    g = (t.groupBy("tag").agg(F.count(F.lit(1)).alias("n_tokens"))
          .withColumn("tag22", tg.tag_class("tag", 22)).withColumn("tag9", tg.tag_class("tag", 9)))
    g = tg.describe_tags(g, ts, "tag22")
    return g.select("tag", "tag22", "tag9", F.col("description").alias("desc22"), "n_tokens")


def q_joined_forms(spark, sf_dir):
    t = q_tag_tokens(spark, sf_dir)
    j = t.select("doc_id", "pos", tg.joined("token", "tag").alias("joined"))
    back = tg.split_last_slash("joined")
    return j.select("doc_id", "pos", "joined", back["morph"].alias("morph"), back["tag"].alias("tag"))


def _tab_render(toks):
    lines = F.transform(toks, lambda w, i: F.when(i % 7 == 6, w).otherwise(
        F.concat(w, F.lit("\t"), F.when(F.length(w) % 2 == 0, "NNG").otherwise("VV"), F.lit(",x,y"))))
    return F.concat(F.array_join(lines, "\n"), F.lit("\nEOS\n"))


def q_tab_parse(spark, sf_dir):
    d = _doc_tokens(spark, sf_dir).select("doc_id", _tab_render(F.col("toks")).alias("out"))
    return tg.parse_tab_output(d, "doc_id", "out").withColumnRenamed("id", "doc_id")


def _block_render(toks):
    def block(w):
        split2 = F.concat(F.substring(w, F.lit(1), F.length(w) - 2), F.lit("/ncn+"),
                          F.substring(w, -2, 2), F.lit("/jcs"))
        alts = F.concat(w, F.lit("\n\t"), w, F.lit("/ncn"),
                        F.when(F.length(w) >= 4, F.concat(F.lit("\n\t"), split2)).otherwise(F.lit("")))
        return alts
    return F.array_join(F.transform(toks, block), "\n\n")


def q_block_parse(spark, sf_dir):
    d = _doc_tokens(spark, sf_dir).select("doc_id", _block_render(F.col("toks")).alias("out"))
    return tg.parse_block_output(d, "doc_id", "out").withColumnRenamed("id", "doc_id")


def _analyzed_lines(dct):
    s = F.col("surface")
    line = F.concat(s, F.lit("\t"), s, F.lit("/"), F.col("tag"),
                    F.when(F.length(s) >= 4, F.concat(F.lit("^"), F.substring(s, F.lit(1), F.length(s) - 2), F.lit("/ncn+"),
                                                      F.substring(s, -2, 2), F.lit("/jcs"))).otherwise(F.lit("")))
    return dct.select(line.alias("value"))


def q_token_analyses(spark, sf_dir):
    an = rd.parse_analyzed_dictionary(_analyzed_lines(fixtures.dictionary(spark, sf_dir)))
    docs = _docs(spark, sf_dir)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    occ = tg.occurrences(fixtures.token_rows(docs.join(again, "doc_id", "left"), "doc_id", "again"), "doc_id", "pos", "again")
    # the analyses of a token depend on nothing else, so each stands for all its occurrences
    j = tg.candidate_analyses(occ, an)
    return j.groupBy("token").agg(
        F.sum("n_tokens").alias("n_rows"), (F.max("n_places") * F.countDistinct("alt_no")).alias("n_alternatives"),
        F.sum(F.when(F.col("a_tag") == "jcs", F.col("n_tokens")).otherwise(0)).alias("n_jcs"))


def q_user_dictionary(spark, sf_dir):
    dct = fixtures.dictionary(spark, sf_dir)
    lines = dct.select(F.when(F.length("surface") % 10 == 0, F.col("surface"))
                        .otherwise(F.concat("surface", F.lit("\t"), "tag")).alias("value"))
    return rd.parse_user_dictionary(lines)


def q_tag_groups(spark, sf_dir):
    edges = rd.parse_tag_hierarchy(rd.lines_frame(spark, TAG_HIERARCHY_LINES))
    cl = tg.closure(edges)
    counts = q_tag_tokens(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n_tokens"))
    return counts.join(cl.select(F.col("member").alias("tag"), "group", "is_leaf"), "tag").select(
        "tag", "group", "is_leaf", "n_tokens")


def _line_tokens(docs, token):
    """(doc_id, line_pos, pos, token) of the lines."""
    d = docs.select("doc_id", F.posexplode_outer(seg.lines("text")).alias("line_pos", "line")).where(F.col("line_pos").isNotNull())
    t = d.select("doc_id", "line_pos", F.posexplode_outer(_wst(F.lower(_norm("line")))).alias("pos", token))
    return t.where(F.col("pos").isNotNull())


def q_line_groups(spark, sf_dir):
    t = _line_tokens(_docs(spark, sf_dir), "token")
    t = tg.tag_with_dictionary(t, fixtures.dictionary(spark, sf_dir))
    g = tg.group_tokens(t.withColumnRenamed("token", "morph"), ["doc_id", "line_pos"], "pos", ["morph", "tag"])
    return g.select("doc_id", "line_pos", F.size("tokens").alias("n_tokens"),
                    F.array_join(F.transform("tokens", lambda x: F.concat(x["morph"], F.lit("/"), x["tag"])), " ")
                     .alias("joined"))


# ------------------------------------------------------------------ readers and sinks: written and read back
def q_post_rows(spark, sf_dir):
    """Posts with whole bodies from several CSV files, numbered in file order."""
    path = scratch_path(spark, "post-rows")
    sheet = _docs(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias(" 게시글제목 "), F.col("source").alias("계정명"),
                                        F.col("text").alias("게시글내용"))
    files = max(5, sheet.rdd.getNumPartitions())  # a quoted sheet is read whole by one task, so more text means more files
    (sheet.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
          .write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path))
    return rd.read_posts(spark, path, "csv", escape='"', multiLine=True).select(
        "idx", F.col("doc_id").cast("long").alias("doc_id"), "title", "account", "content")


def q_post_cells(spark, sf_dir):
    """Title cells that carry a link, flattened into title and url."""
    path = scratch_path(spark, "post-cells")
    posts = fixtures.posts(spark, sf_dir)
    posts.select(F.col("idx").alias("nr"), F.struct(F.col("title").alias("value"), F.col("url").alias("link")).alias("게시글제목 "),
                 F.col("content").alias(" 게시글내용")).write.parquet(path)
    return rd.read_posts(spark, path).select("nr", "title", "url", "content")


def q_reference_list(spark, sf_dir):
    """S3: one column of a list file, nulls dropped."""
    path = scratch_path(spark, "list")
    src = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit("/"), "doc_id")).alias(" 도메인 "))
    src.write.option("header", True).csv(path)
    return rd.load_list(spark, path, "도메인").select("value")


def _write_oids(spark, sf_dir, path):
    a = fixtures.articles(spark, sf_dir).select(tx.oid_from_url("link").cast("int").alias("oid"))
    a.write.option("header", True).csv(path)


def q_publisher_ids(spark, sf_dir):
    """Zero-filled distinct ids of a numeric column with gaps."""
    path = scratch_path(spark, "oids")
    _write_oids(spark, sf_dir, path)
    return rd.load_oids(spark, path)


def q_channel_links(spark, sf_dir):
    """Allowed links with the ids as a (channel, oid) table."""
    a = fixtures.articles(spark, sf_dir).select("article_id", "link")
    oids = rd.channel_oids({ch: rd.list_frame(spark, ids, "oid") for ch, ids in MATCH.channels.items()})
    return lk.channel_filter(a, MATCH.portal, list(MATCH.channels), oids).select("article_id")


def q_stop_word_lines(spark, sf_dir):
    """Stripped, non-empty, distinct lines; every word of every text is a line."""
    path = scratch_path(spark, "stop-words")
    (_docs(spark, sf_dir).select(F.explode(seg.words("text")).alias("w"))
        .select(F.concat(F.lit(" "), "w", F.lit("  ")).alias("value")).write.text(path))
    return rd.load_stopwords(spark, path)


def _write_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    _docs(spark, sf_dir).select(F.col("text").alias("value")).where("value is not null").write.text(path)
    return path


def q_corpus_lines(spark, sf_dir):
    """Lines of all files of a corpus folder, whole texts."""
    return rd.read_corpus_lines(spark, _write_corpus(spark, sf_dir)).where("line <> ''").select("line")


def q_corpus_chunks(spark, sf_dir):
    """Bytes and characters of a corpus folder, read in chunks at character bounds."""
    chunks = read_corpus_chunks(spark, _write_corpus(spark, sf_dir), chunk_bytes=1 << 16)
    return chunks.agg(F.sum(F.octet_length("content")).alias("n_bytes"), F.sum(F.length("content")).alias("n_chars"),
                      F.max(F.octet_length("content") <= (1 << 16) + 3).alias("bounded"))


def q_corpus_listing(spark, sf_dir):
    """Files and bytes of a corpus folder."""
    return rd.corpus_listing(spark, _write_corpus(spark, sf_dir)).agg(F.sum("file_size").alias("n_bytes"))


def q_evidence_files(spark, sf_dir):
    """One text file per article, written by tasks that commit, and read back."""
    path = scratch_path(spark, "evidence-files")
    arts = fixtures.articles(spark, sf_dir).select(F.col("article_id").alias("idx"), F.lit("t").alias("title"), "link", "body")
    write_text_files(sinks.evidence(arts), path)
    back = spark.read.text(f"{path}/part-*", wholetext=True)
    return back.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def q_ragged_rows(spark, sf_dir):
    """The lines of each document as one CSV record, of any number of fields, through a file."""
    path = scratch_path(spark, "ragged")
    d = _docs(spark, sf_dir)
    fields = F.concat(F.array(F.col("doc_id").cast("string")), F.split(F.coalesce("text", F.lit("")), "\n", -1),
                      F.array(F.concat(F.lit('say "'), F.col("source"), F.lit('",\n'))))
    sinks.write_ragged_csv(d.select(fields.alias("fields")), path)
    f = rd.read_ragged_csv(spark, path).select("fields")
    return f.select(F.element_at("fields", 1).cast("long").alias("doc_id"), F.size("fields").alias("n_fields"),
                    F.array_join(F.slice("fields", 2, F.size("fields") - 2), "\n", "").alias("text"), F.element_at("fields", -1).alias("last"))


def q_tagset_rows(spark, sf_dir):
    """JSON objects tag -> description, one per document; nested values and broken files among them."""
    d = _docs(spark, sf_dir)
    tag = F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"))
    content = (F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"'), tag, F.lit('": ')))  # broken
                .when(F.col("doc_id") % 10 == 1, F.concat(F.lit('{"'), tag, F.lit('": {"n": ['), F.col("n_chars").cast("string"), F.lit("]}}")))
                .otherwise(F.to_json(F.create_map(tag, F.col("n_chars").cast("string"), F.concat(tag, F.lit("+")), F.col("source")))))
    path = scratch_path(spark, "tagsets")
    d.select(F.concat("source", F.lit("-"), "doc_id", F.lit(".json")).alias("file_name"), content.alias("content")).write.parquet(path)
    return rd.parse_tagsets(spark.read.parquet(path))


def q_token_csv(spark, sf_dir):
    """Rows of strings through CSV; empty fields are null."""
    path = scratch_path(spark, "token-csv")
    t = fixtures.tokens(spark, sf_dir).select(F.col("doc_id").cast("string"), F.when(F.col("pos") % 5 != 0, F.col("token")).alias("t"))
    sinks.write_token_csv(t, path)
    return rd.read_token_csv(spark, path).select(F.col("_c0").alias("doc_id"), F.col("_c1").alias("token"))


def q_result_sink(spark, sf_dir):
    """The cleaned posts written and read again."""
    path = scratch_path(spark, "result")
    sinks.write_result(clean.clean_posts(fixtures.posts(spark, sf_dir), CLEAN), path)
    return spark.read.parquet(path).select(*POST_COLS)


def q_appended_lines(spark, sf_dir):
    """Lines appended in two runs."""
    path = scratch_path(spark, "lines")
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("value"))
    sinks.append_lines(d, path)
    sinks.append_lines(d.where(F.col("value").endswith("7")), path)
    return spark.read.text(path).select("value")


def q_empty_result(spark, sf_dir):
    """L2: a result without rows keeps its columns."""
    path = scratch_path(spark, "empty")
    sinks.write_result(fixtures.posts(spark, sf_dir).where(F.col("idx") < 0), path)
    return spark.read.parquet(path).select(*POST_COLS)


def _clean_job_inputs(spark, sf_dir):
    posts = scratch_path(spark, "posts")
    fixtures.posts(spark, sf_dir).write.parquet(posts)
    lists = {}
    for name in ("excluded_urls", "untrusted_phrases", "untrusted_domains", "trusted_domains"):
        path = scratch_path(spark, name)
        rd.list_frame(spark, getattr(CLEAN, name)).write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
        lists[name] = (path, "value")
    return posts, scratch_path(spark, "cleaned"), lists


def q_clean_job(spark, sf_dir):
    """F11 from path to path, with the lists joined as tables."""
    return jobs.clean_job(spark, *_clean_job_inputs(spark, sf_dir), CLEAN).select(*POST_COLS)


def q_clean_job_counts(spark, sf_dir):
    """The counters of a cleaning job, observed while it writes."""
    _, seen = jobs.clean_job_counted(spark, *_clean_job_inputs(spark, sf_dir), CLEAN)
    return spark.createDataFrame([tuple(seen.values())], ", ".join(f"{k} long" for k in seen))


def q_match_job(spark, sf_dir):
    """A10 from path to path: all post columns and the two result columns."""
    _, arts, d = _match_inputs(spark, sf_dir)
    posts = scratch_path(spark, "posts")
    fixtures.posts(spark, sf_dir).write.parquet(posts)
    return jobs.match_job(spark, posts, arts, d, scratch_path(spark, "matched"), scratch_path(spark, "evidence"), MATCH).select(
        *POST_COLS, "article_link", "copy_ratio")


def q_string_guard(spark, sf_dir):
    """The guard passes a string column on."""
    return require_string(_docs(spark, sf_dir), "text").select("doc_id", F.length("text").alias("n"))


def _tagged_groups(spark, sf_dir):
    t = q_tag_tokens(spark, sf_dir).withColumnRenamed("token", "morph")
    return tg.group_tokens(t, ["doc_id"], "pos", ["morph", "tag"])


def q_morph_rows(spark, sf_dir):
    """The morphs of every tagged document, in order."""
    g = _tagged_groups(spark, sf_dir)
    return g.select("doc_id", F.posexplode(tg.morphs("tokens")).alias("pos", "morph"))


def q_flat_groups(spark, sf_dir):
    """The groups of a document's lines as rows again."""
    # texts move instead of their tokens: the groups are made where the document's rows are
    t = _line_tokens(_docs(spark, sf_dir).select("doc_id", "text").repartition("doc_id"), "morph").withColumn("tag", F.length("morph"))
    g = tg.group_tokens(t, ["doc_id", "line_pos"], "pos", ["morph", "tag"])
    return tg.flatten_groups(g, ["doc_id"], "line_pos").select("doc_id", "line_pos", "pos_in_group", "morph")


_STAGE = oracle.clean_stage(oracle.POSTS_V, CLEAN)
_STAGE_COUNTS = f"""
        SELECT count(*) AS total, CAST(count_if(stage <> 1) AS BIGINT) AS after_url, CAST(count_if(stage = 2) AS BIGINT) AS removed_search,
               CAST(count_if(stage = 0 OR stage >= 3) AS BIGINT) AS after_search, CAST(count_if(stage = 3) AS BIGINT) AS removed_untrusted,
               CAST(count_if(stage = 0 OR stage = 4) AS BIGINT) AS kept_untrusted, CAST(count_if(stage = 4) AS BIGINT) AS removed_ending,
               CAST(count_if(stage = 0) AS BIGINT) AS kept
        FROM ({_STAGE}) s"""
_F1, _F2, _FL = oracle.first_sentences("text")
_W = oracle.words("text")
_TEXT_UTILS = f"""
SELECT doc_id, translate(text, {oracle.q(tx.PUNCT_FROM)}, {oracle.q(tx.PUNCT_TO)}) AS punct,
       {oracle.rr('text', 'http' + oracle.R.non_ws + '+')} AS no_links,
       {oracle.rr('text', '@' + oracle.R.non_ws + '+')} AS no_mentions,
       CASE WHEN length(text) > 0 THEN '0x' || lower(hex(unicode(text))) END AS first_hex,
       CASE WHEN length(text) > 0 THEN chr(unicode(text)) END AS first_char,
       coalesce(substr(text, 1, 100), '') AS head100,
       printf('%03d_%s.txt', doc_id + 1,
              substr(regexp_replace(coalesce(split_part(text, chr(10), 1), ''), '[\\\\/*?:"<>|]', '', 'g'), 1, 50))
         AS file_name
FROM documents"""
_P = oracle.POSTS_V

_DICT = oracle.dict_v()
_QS = oracle.search_queries(oracle.POSTS_V, _DICT, MATCH.noun_prefix)
_SCORED = oracle.match_scored(oracle.POSTS_V, oracle.ARTICLES_V, _DICT, MATCH)
_MATCH = f"SELECT idx, article_link, copy_ratio FROM ({_SCORED}) m WHERE is_best"

_TOKV = oracle.tokens_v()
_TAGGED = f"SELECT t.doc_id, t.pos, t.token, coalesce(d.tag, 'ncn') AS tag FROM ({_TOKV}) t LEFT JOIN ({_DICT}) d ON d.surface = t.token"
_TEXT_TOKENS = oracle.ws_tokens("lower(" + oracle.normalize_for_score("text") + ")")
_DOCTOK = f"SELECT doc_id, {_TEXT_TOKENS} AS toks FROM documents"
_TAGSET_VALUES = ", ".join(f"({oracle.q(k)}, {oracle.q(v)})" for k, v in CLASS_TAGSET.items())
_EDGES = " UNION ALL ".join(
    f"SELECT {oracle.q(parts[1])} AS parent, {oracle.q(c)} AS child"
    for parts in (ln.split() for ln in TAG_HIERARCHY_LINES.splitlines() if ln.startswith("TSET"))
    for c in parts[2:])


def _cls(col, n):
    return (f"(CASE WHEN lower({col}) IN ('unk', 'iwg') OR {col} IS NULL OR {col} = '' THEN NULL "
            f"WHEN starts_with(lower({col}), 's') THEN 'S' WHEN starts_with(lower({col}), 'f') THEN 'F' "
            f"ELSE upper(substr(lower({col}), 1, {n})) END)")


_STOP_LIST = ", ".join(oracle.q(w) for w in STOPWORDS)
_STEMS = f"""
WITH t AS (SELECT * FROM (SELECT doc_id, unnest(list_transform({_TEXT_TOKENS}, lambda x: substr(x, 1, 5))) AS token FROM documents)
           WHERE token NOT IN ({_STOP_LIST})),
f AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY doc_id, token),
n AS (SELECT doc_id, count(*) AS n, sum(tf * tf) AS t FROM f GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
sh AS (SELECT p.a, sum(x.tf * y.tf) AS dot, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb
       FROM p JOIN f x ON x.doc_id = p.a JOIN f y ON y.doc_id = p.b AND y.token = x.token GROUP BY p.a)
SELECT 'n' || p.a AS pair_id, CASE WHEN coalesce(na.n, 0) > 0 AND coalesce(nb.n, 0) > 0
         THEN {oracle.cosine('coalesce(sh.dot, 0)', 'coalesce(sh.sa, 0)', 'na.t', 'coalesce(sh.sb, 0)', 'nb.t')} ELSE 0.0 END AS cosine
FROM p LEFT JOIN n na ON na.doc_id = p.a LEFT JOIN n nb ON nb.doc_id = p.b LEFT JOIN sh ON sh.a = p.a"""

SQL = {
    "copy_ratio_stems": _STEMS,
    "tag_tokens": _TAGGED,
    "noun_tokens": f"SELECT t.doc_id, t.pos, t.token FROM ({_TOKV}) t JOIN ({_DICT}) d ON d.surface = t.token "
                   f"WHERE starts_with(d.tag, 'n')",
    "tag_classes": f"""SELECT g.tag, {_cls('g.tag', 2)} AS tag22, {_cls('g.tag', 1)} AS tag9,
        ts.description AS desc22, g.n_tokens
        FROM (SELECT tag, count(*) AS n_tokens FROM ({_TAGGED}) t GROUP BY tag) g
        LEFT JOIN (VALUES {_TAGSET_VALUES}) ts(tag, description) ON ts.tag = {_cls('g.tag', 2)}""",
    "joined_forms": f"SELECT doc_id, pos, token || '/' || tag AS joined, token AS morph, tag FROM ({_TAGGED}) t",
    "tab_parse": f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos,
        CASE WHEN pos % 7 = 6 THEN '' ELSE w END AS morph,
        CASE WHEN pos % 7 = 6 THEN 'SY' WHEN length(w) % 2 = 0 THEN 'NNG' ELSE 'VV' END AS tag
        FROM (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS w FROM ({_DOCTOK}) a) b""",
    "block_parse": f"""
        WITH w AS (SELECT doc_id, unnest(range(len(toks))) AS block_pos, unnest(toks) AS w FROM ({_DOCTOK}) a)
        SELECT doc_id, CAST(block_pos AS BIGINT) AS block_pos, w AS surface, 0 AS alt_no, 0 AS m_pos,
               w AS morph, 'ncn' AS tag FROM w
        UNION ALL SELECT doc_id, block_pos, w, 1, 0, substr(w, 1, length(w) - 2), 'ncn' FROM w WHERE length(w) >= 4
        UNION ALL SELECT doc_id, block_pos, w, 1, 1, substr(w, length(w) - 1, 2), 'jcs' FROM w WHERE length(w) >= 4""",
    "token_analyses": f"""
        WITH an AS (SELECT surface, 0 AS alt_no, tag AS a_tag FROM ({_DICT}) d
                    UNION ALL SELECT surface, 1, 'ncn' FROM ({_DICT}) d WHERE length(surface) >= 4
                    UNION ALL SELECT surface, 1, 'jcs' FROM ({_DICT}) d WHERE length(surface) >= 4)
        SELECT t.token, count(*) AS n_rows, count(DISTINCT (t.doc_id, t.pos, an.alt_no)) AS n_alternatives,
               CAST(count_if(an.a_tag = 'jcs') AS BIGINT) AS n_jcs
        FROM ({_TOKV}) t JOIN an ON an.surface = t.token GROUP BY t.token""",
    "user_dictionary": f"SELECT surface, CASE WHEN length(surface) % 10 = 0 THEN 'NNP' ELSE tag END AS tag FROM ({_DICT}) d",
    "tag_groups": f"""
        WITH RECURSIVE e AS ({_EDGES}),
        c(parent, child) AS (SELECT parent, child FROM e UNION SELECT c.parent, e.child FROM c JOIN e ON e.parent = c.child)
        SELECT t.tag, c.parent AS "group", c.child NOT IN (SELECT parent FROM e) AS is_leaf, t.n_tokens
        FROM (SELECT tag, count(*) AS n_tokens FROM ({_TAGGED}) x GROUP BY tag) t JOIN c ON c.child = t.tag""",
    "line_groups": f"""
        WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_pos, unnest(ls) AS line
                   FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS ls
                         FROM documents) a),
        t AS (SELECT doc_id, line_pos, unnest(range(len(tk))) AS pos, unnest(tk) AS token
              FROM (SELECT doc_id, line_pos, {oracle.ws_tokens(f"lower({oracle.normalize_for_score('line')})")} AS tk FROM l) b)
        SELECT t.doc_id, CAST(t.line_pos AS INTEGER) AS line_pos, CAST(count(*) AS INTEGER) AS n_tokens,
               string_agg(t.token || '/' || coalesce(d.tag, 'ncn'), ' ' ORDER BY t.pos) AS joined
        FROM t LEFT JOIN ({_DICT}) d ON d.surface = t.token GROUP BY t.doc_id, t.line_pos""",
    "url_keys": f"""SELECT page_id, {oracle.url_host('url')} AS host, {oracle.domain_key('url')} AS domain_key,
        nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1),
               '/article/(\\p{{Nd}}{{3}})/\\p{{Nd}}+', 1), '') AS oid FROM pages""",
    "article_oids": f"""SELECT article_id,
        nullif(regexp_extract(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1),
               '/article/(\\p{{Nd}}{{3}})/\\p{{Nd}}+', 1), '') AS oid, {oracle.domain_key('link')} AS domain_key
        FROM ({oracle.ARTICLES_V}) a""",
    "clean_text": f"SELECT doc_id, {oracle.clean_text('text')} AS clean, "
                  f"{oracle.clean_text('text', literal_escape=True)} AS clean_literal FROM documents",
    "normalize_text": f"SELECT doc_id, {oracle.normalize_for_score('text')} AS norm FROM documents",
    "first_sentences": f"SELECT doc_id, {_F1} AS first, {_F2} AS second, {_FL} AS last FROM documents",
    "sentences": f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS s_pos, unnest(l) AS sentence
        FROM (SELECT doc_id, {oracle.sentences('text')} AS l FROM documents) x""",
    "words": f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS word
        FROM (SELECT doc_id, {_W} AS l FROM documents) x""",
    "lines": f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_pos, unnest(l) AS line
        FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l
              FROM documents) x""",
    "concordance": f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos,
        array_to_string(list_slice(l, greatest(pos - 3, 0) + 1, pos + 3), ' ') AS context
        FROM (SELECT doc_id, l, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {_W} AS l FROM documents) a) b
        WHERE contains(l[pos + 1], 'the')""",
    "text_utils": _TEXT_UTILS,
    "tokens": oracle.tokens_v(),
    "dictionary": oracle.dict_v(),
    "search_queries": _QS,
    "retrieve_top5": oracle.top_k(_QS, f"SELECT article_id, body FROM ({oracle.ARTICLES_V}) a0",
                                  MATCH.stopwords, MATCH.k, MATCH.exclude_self),
    "match_candidates": f"SELECT idx, CAST(cand_pos AS INTEGER) AS cand_pos, article_id, link, cosine, copy_ratio "
                        f"FROM ({_SCORED}) m WHERE NOT is_best",
    "match_posts": _MATCH,
    "match_report": f"""SELECT idx, article_link, copy_ratio, NULL::INTEGER AS stat_pos, NULL::VARCHAR AS label,
            NULL::VARCHAR AS count_text FROM ({_MATCH}) m
        UNION ALL
        SELECT NULL, NULL, NULL, v.stat_pos, v.label, CAST(v.n AS VARCHAR) || '건'
        FROM (SELECT count_if(copy_ratio > 0) AS matched, count_if(copy_ratio >= 0.9) AS ge90,
                     count_if(copy_ratio >= 0.5) AS ge50_all FROM ({_MATCH}) m) s,
             LATERAL (VALUES (0, '매칭건수', s.matched), (1, '0.5 이상', s.ge50_all - s.ge90),
                             (2, '0.9 이상', s.ge90), (3, '0 이상', s.matched - s.ge50_all)) v(stat_pos, label, n)""",
    "match_evidence": f"""
        WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY copy_ratio DESC, cand_pos) AS rn
                                  FROM ({_SCORED}) m WHERE NOT is_best) x WHERE rn = 1),
        w AS (SELECT b.idx, b.link, {oracle.clean_text('p.title')} AS title, {oracle.clean_text('a.body')} AS body
              FROM b JOIN ({oracle.POSTS_V}) p ON p.idx = b.idx JOIN ({oracle.ARTICLES_V}) a ON a.article_id = b.article_id)
        SELECT idx, CASE WHEN idx + 1 < 1000 THEN lpad(CAST(idx + 1 AS VARCHAR), 3, '0') ELSE CAST(idx + 1 AS VARCHAR) END
               || '_' || substr(regexp_replace(title, '[\\\\/*?:"<>|]', '', 'g'), 1, 50) || '.txt' AS file_name,
               '[URL] ' || link || chr(10) || chr(10) || body AS content FROM w""",
    "link_policy": f"""SELECT article_id,
        coalesce(link <> '', FALSE) AND NOT {oracle.contains_any('link', MATCH.excluded_domains)} AS link_ok,
        {oracle.link_policy('link', "repeat('x', 1000)", [], MATCH.portal, MATCH.channels)} AS channel_ok,
        coalesce(length(body) > {MATCH.min_body}, FALSE) AS body_ok
        FROM ({oracle.ARTICLES_V}) a""",
    "title_keywords": oracle.title_keywords(oracle.POSTS_V, _DICT, MATCH.noun_prefix),
    "match_stats": f"""SELECT CAST(count_if(copy_ratio > 0) AS BIGINT) AS matched,
        CAST(count_if(copy_ratio >= 0.5) - count_if(copy_ratio >= 0.9) AS BIGINT) AS ge50,
        CAST(count_if(copy_ratio >= 0.9) AS BIGINT) AS ge90,
        CAST(count_if(copy_ratio > 0) - count_if(copy_ratio >= 0.5) AS BIGINT) AS gt0 FROM ({_MATCH}) m""",
    "copy_ratio": oracle.copy_ratio(oracle.PAIRS_V, "pair_id", STOPWORDS),
    "clean_posts": f"SELECT idx, title, content, keyword, account, url FROM ({_STAGE}) s WHERE stage = 0",
    "clean_stage_counts": _STAGE_COUNTS,
    "removed_posts": f"SELECT idx, stage FROM ({_STAGE}) s WHERE stage <> 0",
    "title_prefix": f"SELECT idx, split_part(title, '&keyword=', 1) AS title FROM ({_P}) p",
    "url_exclusion": f"SELECT idx, url FROM ({_P}) p WHERE NOT "
                     + oracle.contains_any("coalesce(url, 'None')", CLEAN.excluded_urls),
    "keyword_filter": f"""SELECT idx, keyword FROM ({_P}) p
        WHERE coalesce(contains(lower(coalesce(title, 'None')), lower(keyword))
                       OR contains(lower(coalesce(content, 'None')), lower(keyword)), FALSE)""",
    "banned_terms": f"SELECT idx, account FROM ({_P}) p WHERE NOT ("
                    + " OR ".join(f"regexp_matches(coalesce({c}, ''), {oracle.q(t)}, 'i')" for c, t in CLEAN.banned)
                    + ")",
    "trust_filter": f"""SELECT idx, (({oracle.contains_any("coalesce(content, 'None')", CLEAN.untrusted_phrases)}
                         OR {oracle.contains_any("coalesce(content, 'None')", CLEAN.untrusted_domains)})
                         AND NOT {oracle.contains_any("coalesce(content, 'None')", CLEAN.trusted_domains)}) AS removed
                       FROM ({_P}) p""",
    "ending_filter": f"""SELECT idx,
        ((NOT coalesce(contains(t, 'nd.'), FALSE) OR coalesce(contains(t, 'and.'), FALSE))
         AND (NOT coalesce(contains(content, 'nd.'), FALSE) OR coalesce(contains(content, 'and.'), FALSE))
         AND NOT coalesce(contains(t, 'xyz'), FALSE) AND NOT coalesce(contains(content, 'xyz'), FALSE)) AS removed
        FROM (SELECT idx, split_part(title, '&keyword=', 1) AS t, content FROM ({_P}) p0) p""",
    "column_counts": f"""SELECT count(idx) AS idx, count(title) AS title, count(content) AS content,
        count(keyword) AS keyword, count(account) AS account, count(url) AS url FROM ({_P}) p""",
    "copy_ratio_sentences": f"""
        WITH p AS ({oracle.PAIRS_V}),
        u AS (SELECT pair_id, unnest(range(len(l))) AS s_pos, unnest(l) AS article, post
              FROM (SELECT pair_id, {oracle.sentences('article')} AS l, post FROM p) x),
        c AS ({oracle.copy_ratio("SELECT pair_id || '#' || s_pos AS unit, article, post FROM u", "unit", STOPWORDS)}),
        k AS (SELECT u.pair_id, c.cosine FROM u JOIN c ON c.unit = u.pair_id || '#' || u.s_pos
              WHERE len({oracle.score_tokens('u.article', STOPWORDS)}) > 0 OR len({oracle.score_tokens('u.post', STOPWORDS)}) > 0)
        SELECT p.pair_id, round(coalesce(a.cosine, 0.0), 9) AS cosine, round(coalesce(a.cosine, 0.0), 2) AS ratio
        FROM p LEFT JOIN (SELECT pair_id, avg(cosine) AS cosine FROM k GROUP BY pair_id) a ON a.pair_id = p.pair_id""",
    "word_groups": f"""
        WITH w AS (SELECT doc_id, l, unnest(range(len(l))) AS pos, unnest(l) AS word FROM (SELECT doc_id, {_W} AS l FROM documents) x),
        g AS (SELECT doc_id, pos, word, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (
                     PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g_pos FROM w)
        SELECT doc_id, CAST(g_pos AS INTEGER) AS g_pos, CAST(count(*) AS INTEGER) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text
        FROM g GROUP BY doc_id, g_pos
        UNION ALL SELECT doc_id, 0, 0, '' FROM documents WHERE len({_W}) = 0""",
    "post_rows": """SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, doc_id, split_part(text, chr(10), 1) AS title,
        source AS account, text AS content FROM documents""",
    "reference_list": "SELECT source || '/' || doc_id AS value FROM documents WHERE doc_id % 3 <> 0",
    "publisher_ids": "SELECT DISTINCT lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0') AS oid FROM documents WHERE doc_id % 3 = 0",
    "channel_links": f"""SELECT article_id FROM ({oracle.ARTICLES_V}) a
        WHERE NOT contains(link, 'portal.example') OR article_id % 7 IN (1, 3, 5)""",
    "stop_word_lines": f"SELECT DISTINCT unnest(l) AS word FROM (SELECT {_W} AS l FROM documents) x",
    "corpus_lines": "SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) x WHERE line <> ''",
    "corpus_chunks": """SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
        TRUE AS bounded FROM documents""",
    "corpus_listing": "SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents",
    "evidence_files": f"""SELECT CASE WHEN article_id + 1 < 1000 THEN lpad(CAST(article_id + 1 AS VARCHAR), 3, '0')
               ELSE CAST(article_id + 1 AS VARCHAR) END || '_t.txt' AS file_name,
        '[URL] ' || link || chr(10) || chr(10) || body AS content FROM ({oracle.ARTICLES_V}) a""",
    "ragged_rows": """SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) + 2 AS INTEGER) AS n_fields,
        coalesce(text, '') AS text, 'say "' || source || '",' || chr(10) AS last FROM documents""",
    "tagset_rows": """SELECT source || '-' || doc_id AS tagset, lang || '_' || doc_id AS tag,
               CASE WHEN doc_id % 10 = 1 THEN '{"n":[' || n_chars || ']}' ELSE CAST(n_chars AS VARCHAR) END AS description
        FROM documents WHERE doc_id % 10 <> 0
        UNION ALL SELECT source || '-' || doc_id, lang || '_' || doc_id || '+', source FROM documents WHERE doc_id % 10 > 1""",
    "post_cells": f"SELECT idx AS nr, title, url, content FROM ({_P}) p",
    "token_csv": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN pos % 5 <> 0 THEN token END AS token FROM ({_TOKV}) t",
    "result_sink": f"SELECT idx, title, content, keyword, account, url FROM ({_STAGE}) s WHERE stage = 0",
    "appended_lines": """SELECT CAST(doc_id AS VARCHAR) AS value FROM documents
        UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 = 7""",
    "empty_result": f"SELECT idx, title, content, keyword, account, url FROM ({_P}) p WHERE idx < 0",
    "clean_job": f"SELECT idx, title, content, keyword, account, url FROM ({_STAGE}) s WHERE stage = 0",
    "clean_job_counts": f"SELECT * FROM ({_STAGE_COUNTS}) c",
    "match_job": f"""SELECT p.idx, p.title, p.content, p.keyword, p.account, p.url, m.article_link, m.copy_ratio
        FROM ({_P}) p JOIN ({_MATCH}) m ON m.idx = p.idx""",
    "string_guard": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents",
    "morph_rows": f"SELECT doc_id, pos, token AS morph FROM ({_TOKV}) t",
    "flat_groups": f"""
        WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_pos, unnest(ls) AS line
                   FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS ls FROM documents) a)
        SELECT doc_id, CAST(line_pos AS INTEGER) AS line_pos, CAST(unnest(range(len(tk))) AS INTEGER) AS pos_in_group, unnest(tk) AS morph
        FROM (SELECT doc_id, line_pos, {oracle.ws_tokens("lower(" + oracle.normalize_for_score('line') + ")")} AS tk FROM l) b""",
}

QUERIES = {
    "tag_tokens": q_tag_tokens,
    "noun_tokens": q_noun_tokens,
    "tag_classes": q_tag_classes,
    "joined_forms": q_joined_forms,
    "tab_parse": q_tab_parse,
    "block_parse": q_block_parse,
    "token_analyses": q_token_analyses,
    "user_dictionary": q_user_dictionary,
    "tag_groups": q_tag_groups,
    "line_groups": q_line_groups,
    "extract_bodies": q_extract_bodies,
    "extract_bodies_selector": q_extract_bodies_selector,
    "long_bodies": q_long_bodies,
    "url_keys": q_url_keys,
    "article_oids": q_article_oids,
    "clean_text": q_clean_text,
    "normalize_text": q_normalize_text,
    "first_sentences": q_first_sentences,
    "sentences": q_sentences,
    "words": q_words,
    "lines": q_lines,
    "concordance": q_concordance,
    "text_utils": q_text_utils,
    "tokens": q_tokens,
    "dictionary": q_dictionary,
    "search_queries": q_search_queries,
    "retrieve_top5": q_retrieve_top5,
    "match_candidates": q_match_candidates,
    "match_posts": q_match_posts,
    "match_report": q_match_report,
    "match_evidence": q_match_evidence,
    "link_policy": q_link_policy,
    "title_keywords": q_title_keywords,
    "unsegmented_nouns": q_unsegmented_nouns,
    "word_groups": q_word_groups,
    "match_stats": q_match_stats,
    "copy_ratio": q_copy_ratio,
    "copy_ratio_stems": q_copy_ratio_stems,
    "clean_posts": q_clean_posts,
    "clean_stage_counts": q_clean_stage_counts,
    "removed_posts": q_removed_posts,
    "title_prefix": q_title_prefix,
    "url_exclusion": q_url_exclusion,
    "keyword_filter": q_keyword_filter,
    "banned_terms": q_banned_terms,
    "trust_filter": q_trust_filter,
    "ending_filter": q_ending_filter,
    "column_counts": q_column_counts,
    "copy_ratio_sentences": q_copy_ratio_sentences,
    "post_rows": q_post_rows,
    "reference_list": q_reference_list,
    "publisher_ids": q_publisher_ids,
    "channel_links": q_channel_links,
    "stop_word_lines": q_stop_word_lines,
    "corpus_lines": q_corpus_lines,
    "corpus_listing": q_corpus_listing,
    "corpus_chunks": q_corpus_chunks,
    "evidence_files": q_evidence_files,
    "ragged_rows": q_ragged_rows,
    "post_cells": q_post_cells,
    "tagset_rows": q_tagset_rows,
    "token_csv": q_token_csv,
    "result_sink": q_result_sink,
    "appended_lines": q_appended_lines,
    "empty_result": q_empty_result,
    "clean_job": q_clean_job,
    "clean_job_counts": q_clean_job_counts,
    "match_job": q_match_job,
    "string_guard": q_string_guard,
    "morph_rows": q_morph_rows,
    "flat_groups": q_flat_groups,
}
