"""DuckDB spellings of the same expressions, for the SQL oracle.

Built from the shared pattern table in ``echotrace.functions.regex`` so the
Spark plan and the oracle cannot drift apart.  RE2 has no look-around; the
two sentence rules that need it are written with anchored extraction.
"""

from __future__ import annotations

from echotrace.functions import regex as RX
from echotrace.functions.regex import RE2 as R
from echotrace.operators.score import IDF_EXCLUSIVE_SQ


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(RX.WS_STRING)})"


def clean_text(expr: str, literal_escape: bool = False) -> str:
    s = f"coalesce(CAST({expr} AS VARCHAR), 'nan')"
    out = s
    for pattern, repl in R.clean_text_steps():
        out = rr(out, pattern, repl)
    out = rr(out, RX.CLEAN_TEXT_TOKENS if literal_escape else RX.CLEAN_TEXT_CHARSET, " ")
    out = strip(rr(out, R.ws + "+", " "))
    return f"(CASE WHEN lower({strip(s)}) = 'nan' THEN '' ELSE {out} END)"


def normalize_for_score(expr: str) -> str:
    s = rr(f"coalesce({expr}, '')", R.not_word_not_ws)
    return strip(rr(s, R.ws + "+", " "))


def ws_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({strip(expr)}, {q(R.ws + '+')}), lambda t: t <> '')"


def score_tokens(expr: str, stopwords=()) -> str:
    toks = ws_tokens(f"lower({normalize_for_score(expr)})")
    words = sorted(set(stopwords))
    if not words:
        return toks
    arr = "[" + ", ".join(q(w) for w in words) + "]"
    return f"list_filter({toks}, lambda t: NOT list_contains({arr}, t))"


def cosine(dot: str, sa: str, ta: str, sb: str, tb: str) -> str:
    c2 = repr(IDF_EXCLUSIVE_SQ)
    na2 = f"(CAST({sa} AS DOUBLE) + {c2} * CAST(({ta}) - ({sa}) AS DOUBLE))"
    nb2 = f"(CAST({sb} AS DOUBLE) + {c2} * CAST(({tb}) - ({sb}) AS DOUBLE))"
    return f"(CAST({dot} AS DOUBLE) / sqrt({na2} * {nb2}))"


def first_last_sentence(expr: str) -> tuple[str, str]:
    """First sentence and (stripped) last sentence of a one-paragraph text.
    A boundary follows ``. ! ?`` before whitespace or a Hangul syllable."""
    p = strip(expr)
    nxt = "(?:" + R.ws + "|[가-힣])"
    first = f"coalesce(nullif(regexp_extract({p}, {q('(?s)^(.*?[.!?])' + nxt)}, 1), ''), {p})"
    last_raw = f"regexp_extract({p}, {q('(?s)^.*[.!?](' + nxt + '.*)$')}, 1)"
    last = f"(CASE WHEN {last_raw} = '' THEN {strip(p)} ELSE {strip(last_raw)} END)"
    return first, last


# ------------------------------------------------------------------ fixtures
POSTS_V = """
SELECT d.doc_id AS idx,
       split_part(d.text, chr(10), 1)
         || CASE WHEN d.doc_id % 5 = 0 THEN '&keyword=k' || d.lang ELSE '' END AS title,
       d.text AS content,
       CASE d.lang WHEN 'en' THEN 'the' WHEN 'fr' THEN 'les'
                   WHEN 'de' THEN 'und' ELSE 'que' END AS keyword,
       d.source AS account, p.url AS url
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
"""

ARTICLES_V = """
SELECT doc_id AS article_id,
       CASE WHEN doc_id % 3 = 0
            THEN 'https://n.news.portal.example/mnews/article/'
                 || lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0') || '/' || CAST(doc_id AS VARCHAR)
            ELSE 'https://' || source || '.example.com/' || CAST(doc_id AS VARCHAR) END AS link,
       text AS body
FROM documents
"""

PAIRS_V = """
SELECT 'n' || CAST(a.doc_id AS VARCHAR) AS pair_id, a.text AS article, b.text AS post
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
UNION ALL
SELECT 'b' || CAST(i.item_id AS VARCHAR) || '_' || CAST(d.doc_id AS VARCHAR), i.text, d.text
FROM (SELECT DISTINCT a.item_id, b.doc_id FROM (%s) a JOIN (%s) b ON a.run = b.run) n
JOIN benchmark i ON i.item_id = n.item_id JOIN documents d ON d.doc_id = n.doc_id
"""


def runs(table: str, id_col: str, n: int = 8) -> str:
    """Distinct runs of ``n`` whitespace words of every text."""
    return (f"SELECT DISTINCT {id_col}, array_to_string(w[i:i + {n - 1}], ' ') AS run FROM (SELECT {id_col}, w, "
            f"unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {id_col}, {words('text')} AS w FROM {table}) x) y")


def tokens_v() -> str:
    toks = ws_tokens(f"lower({normalize_for_score('text')})")
    return f"""
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token
FROM (SELECT doc_id, {toks} AS l FROM documents) s
"""


def dict_v() -> str:
    return f"""
SELECT token AS surface,
       CASE length(token) % 4 WHEN 0 THEN 'ncn' WHEN 1 THEN 'pvg'
                              WHEN 2 THEN 'jcs' ELSE 'mag' END AS tag
FROM ({tokens_v()}) t GROUP BY token
"""


def copy_ratio(pairs_sql: str, key: str = "pair_id", stopwords=()) -> str:
    """Whole-text copy ratio of every pair, same closed form as the plan."""
    ta = score_tokens("article", stopwords)
    tp = score_tokens("post", stopwords)
    return f"""
WITH p AS ({pairs_sql}),
ta AS (SELECT {key} AS pair, unnest({ta}) AS token FROM p),
tp AS (SELECT {key} AS pair, unnest({tp}) AS token FROM p),
fa AS (SELECT pair, token, count(*) AS tf FROM ta GROUP BY pair, token),
fb AS (SELECT pair, token, count(*) AS tf FROM tp GROUP BY pair, token),
na AS (SELECT pair, count(*) AS n, sum(tf * tf) AS t FROM fa GROUP BY pair),
nb AS (SELECT pair, count(*) AS n, sum(tf * tf) AS t FROM fb GROUP BY pair),
sh AS (SELECT fa.pair, sum(fa.tf * fb.tf) AS dot, sum(fa.tf * fa.tf) AS sa, sum(fb.tf * fb.tf) AS sb
       FROM fa JOIN fb ON fa.pair = fb.pair AND fa.token = fb.token GROUP BY fa.pair),
c AS (
  SELECT p.{key} AS {key},
         CASE WHEN coalesce(na.n, 0) > 0 AND coalesce(nb.n, 0) > 0
              THEN {cosine('coalesce(sh.dot, 0)', 'coalesce(sh.sa, 0)', 'na.t', 'coalesce(sh.sb, 0)', 'nb.t')}
              ELSE 0.0 END AS cosine
  FROM p LEFT JOIN na ON na.pair = p.{key} LEFT JOIN nb ON nb.pair = p.{key}
         LEFT JOIN sh ON sh.pair = p.{key})
SELECT {key}, cosine, round_even(cosine, 3) AS copy_ratio FROM c
"""


# ------------------------------------------------------------------ cleaning
def contains_any(expr: str, values) -> str:
    vals = [str(v) for v in values if v is not None]
    if not vals:
        return "FALSE"
    return "(" + " OR ".join(f"coalesce(contains({expr}, {q(v)}), FALSE)" for v in vals) + ")"


def clean_stage(posts_sql: str, p) -> str:
    """Posts with the ``stage`` column of ``echotrace.plans.clean.flag_posts``."""
    body = "coalesce(CAST(content AS VARCHAR), 'None')"
    kw = ("coalesce(contains(lower(coalesce(CAST(title AS VARCHAR), 'None')), lower(keyword)) "
          "OR contains(lower(coalesce(CAST(content AS VARCHAR), 'None')), lower(keyword)), FALSE)")
    banned = " OR ".join(f"regexp_matches(coalesce({c}, ''), {q(t)}, 'i')" for c, t in p.banned) or "FALSE"

    def has(c, s):
        return f"coalesce(contains({c}, {q(s)}), FALSE)"
    untrusted = (f"(({contains_any(body, p.untrusted_phrases)} OR {contains_any(body, p.untrusted_domains)}) "
                 f"AND NOT {contains_any(body, p.trusted_domains)})")
    ending = (f"((NOT {has('title', p.ending)} OR {has('title', p.ending_exception)}) "
              f"AND (NOT {has('content', p.ending)} OR {has('content', p.ending_exception)}) "
              f"AND NOT {has('title', p.keep_term)} AND NOT {has('content', p.keep_term)})")
    url_out = contains_any("coalesce(url, 'None')", p.excluded_urls)
    return f"""
SELECT *, CASE WHEN {url_out} THEN 1 WHEN (NOT {kw}) OR ({banned}) THEN 2
               WHEN {untrusted} THEN 3 WHEN {ending} THEN 4 ELSE 0 END AS stage
FROM (SELECT idx, split_part(title, '&keyword=', 1) AS title, content, keyword, account, url
      FROM ({posts_sql}) p0) p1
"""


# ------------------------------------------------------------------ matching
def _tok(expr: str, stopwords) -> str:
    return score_tokens(expr, stopwords)


def search_queries(posts_sql: str, dict_sql: str, noun_prefix: str = "n") -> str:
    """``(idx, q_pos, query)`` like ``retrieve.search_queries``."""
    first, last = first_last_sentence("content_c")
    tr = lambda e: f"coalesce(substr({e}, 1, 100), '')"
    nouns_tok = ws_tokens(f"lower({normalize_for_score('title_q')})")
    return f"""
WITH base AS (
  SELECT idx, {clean_text('title')} AS title_c, {clean_text('content')} AS content_c,
         {clean_text('keyword')} AS press_c FROM ({posts_sql}) p),
sq AS (
  SELECT idx, press_c, {tr(clean_text('title_c'))} AS title_q,
         {tr(clean_text(first))} AS first_q, {tr(clean_text("''"))} AS second_q,
         {tr(clean_text(last))} AS last_q FROM base),
tt AS (SELECT idx, unnest(range(len(l))) AS pos, unnest(l) AS surface
       FROM (SELECT idx, {nouns_tok} AS l FROM sq) x),
kw AS (SELECT tt.idx, array_to_string(list(tt.surface ORDER BY tt.pos)[1:5], ' ') AS keywords
       FROM tt JOIN ({dict_sql}) d ON d.surface = tt.surface
       WHERE starts_with(d.tag, {q(noun_prefix)}) GROUP BY tt.idx),
slots AS (
  SELECT sq.idx, s.slot, s.q FROM sq LEFT JOIN kw ON kw.idx = sq.idx,
  LATERAL (SELECT * FROM (VALUES (0, sq.title_q),
                  (1, {tr("coalesce(kw.keywords, '')")} || ' ' || sq.press_c),
                  (2, sq.first_q), (3, sq.second_q), (4, sq.last_q)) v(slot, q)) s
  WHERE s.q <> ''),
firsts AS (SELECT idx, q, min(slot) AS slot FROM slots GROUP BY idx, q)
SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS INTEGER) AS q_pos, q AS query
FROM firsts
"""


def top_k(queries_sql: str, articles_sql: str, stopwords, k: int = 5, exclude_self: bool = True) -> str:
    """Exact top-k by brute force: every query token against every article."""
    self_cond = "AND a.article_id <> q.idx" if exclude_self else ""
    return f"""
WITH qs AS ({queries_sql}),
arts AS ({articles_sql}),
atok AS (SELECT article_id, unnest(list_distinct({_tok('body', stopwords)})) AS token FROM arts),
dfs AS (SELECT token, count(*) AS df FROM atok GROUP BY token),
nd AS (SELECT count(*) AS n FROM arts),
qt AS (SELECT idx, q_pos, unnest(list_distinct({_tok('query', stopwords)})) AS token FROM qs),
sims AS (
  SELECT q.idx, q.q_pos, a.article_id, sum(ln((1.0 + nd.n) / (1.0 + dfs.df)) + 1.0) AS sim
  FROM qt q JOIN atok a ON a.token = q.token JOIN dfs ON dfs.token = q.token CROSS JOIN nd
  WHERE TRUE {self_cond}
  GROUP BY q.idx, q.q_pos, a.article_id),
ranked AS (
  SELECT idx, q_pos, article_id, round(sim, 9) AS sim,
         row_number() OVER (PARTITION BY idx, q_pos ORDER BY round(sim, 9) DESC, article_id) AS rank
  FROM sims)
SELECT idx, q_pos, CAST(rank AS INTEGER) AS rank, article_id, sim FROM ranked WHERE rank <= {k}
"""


def link_policy(link: str, body: str, excluded_domains, portal: str, channels: dict, min_len: int = 300) -> str:
    conds = [f"coalesce({link} <> '', FALSE)", f"NOT {contains_any(link, excluded_domains)}",
             f"coalesce(length({body}) > {min_len}, FALSE)"]
    oid = (f"nullif(regexp_extract(coalesce(regexp_extract({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), "
           f"{q('/article/(' + R.digit + '{3})/' + R.digit + '+')}, 1), '')")
    ok = [f"{oid} IS NOT NULL"]
    for marker, ids in channels.items():
        arr = "[" + ", ".join(q(str(v)) for v in ids) + "]::VARCHAR[]"
        ok.append(f"NOT (contains({link}, {q(marker)}) AND NOT coalesce(list_contains({arr}, {oid}), FALSE))")
    conds.append(f"(NOT coalesce(contains({link}, {q(portal)}), FALSE) OR ({' AND '.join(ok)}))")
    return " AND ".join(conds)


def match_posts(posts_sql: str, articles_sql: str, dict_sql: str, p) -> str:
    """``(idx, article_link, copy_ratio)`` for every post, like ``match.match_posts``;
    also exposes the CTE ``scored`` for the per-candidate query."""
    return f"SELECT idx, article_link, copy_ratio FROM ({match_scored(posts_sql, articles_sql, dict_sql, p)}) m WHERE is_best"


def match_scored(posts_sql: str, articles_sql: str, dict_sql: str, p) -> str:
    qs = search_queries(posts_sql, dict_sql, p.noun_prefix)
    hits = top_k(qs, f"SELECT article_id, body FROM ({articles_sql}) a0", p.stopwords, p.k, p.exclude_self)
    sw = p.stopwords
    return f"""
WITH hits AS ({hits}),
arts AS ({articles_sql}),
pol AS (SELECT h.idx, h.q_pos, h.rank, h.article_id, a.link FROM hits h JOIN arts a ON a.article_id = h.article_id
        WHERE {link_policy('a.link', 'a.body', p.excluded_domains, p.portal, p.channels, p.min_body)}),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx, link ORDER BY q_pos, rank) AS rn FROM pol) x
          WHERE rn = 1),
cand AS (SELECT idx, article_id, link,
                row_number() OVER (PARTITION BY idx ORDER BY q_pos, rank) - 1 AS cand_pos FROM dedup),
pt AS (SELECT idx, {clean_text('title')} || ' ' || {clean_text('content')} AS text FROM ({posts_sql}) p
       WHERE idx IN (SELECT idx FROM cand)),
atx AS (SELECT article_id, {clean_text('body')} AS text FROM arts WHERE article_id IN (SELECT article_id FROM cand)),
fb AS (SELECT id, token, count(*) AS tf FROM (SELECT idx AS id, unnest({_tok('text', sw)}) AS token FROM pt) x
       GROUP BY id, token),
fa AS (SELECT id, token, count(*) AS tf FROM (SELECT article_id AS id, unnest({_tok('text', sw)}) AS token FROM atx) x
       GROUP BY id, token),
nb AS (SELECT id, count(*) AS n, sum(tf * tf) AS t FROM fb GROUP BY id),
na AS (SELECT id, count(*) AS n, sum(tf * tf) AS t FROM fa GROUP BY id),
sh AS (SELECT c.idx, c.cand_pos, sum(fa.tf * fb.tf) AS dot, sum(fa.tf * fa.tf) AS sa, sum(fb.tf * fb.tf) AS sb
       FROM cand c JOIN fb ON fb.id = c.idx JOIN fa ON fa.id = c.article_id AND fa.token = fb.token
       GROUP BY c.idx, c.cand_pos),
sc AS (
  SELECT c.idx, c.cand_pos, c.article_id, c.link,
         CASE WHEN coalesce(na.n, 0) > 0 AND coalesce(nb.n, 0) > 0
              THEN {cosine('coalesce(sh.dot, 0)', 'coalesce(sh.sa, 0)', 'na.t', 'coalesce(sh.sb, 0)', 'nb.t')}
              ELSE 0.0 END AS cosine
  FROM cand c LEFT JOIN na ON na.id = c.article_id LEFT JOIN nb ON nb.id = c.idx
       LEFT JOIN sh ON sh.idx = c.idx AND sh.cand_pos = c.cand_pos),
sr AS (SELECT *, round_even(cosine, 3) AS copy_ratio FROM sc),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY copy_ratio DESC, cand_pos) AS rn
                        FROM sr) x WHERE rn = 1)
SELECT sr.idx, sr.cand_pos, sr.article_id, sr.link, sr.cosine, sr.copy_ratio, FALSE AS is_best,
       '' AS article_link FROM sr
UNION ALL
SELECT p.idx, NULL, NULL, NULL, NULL, coalesce(b.copy_ratio, 0.0), TRUE,
       coalesce('=HYPERLINK("' || b.link || '")', '') FROM ({posts_sql}) p LEFT JOIN best b ON b.idx = p.idx
"""


# ------------------------------------------------------------------ segmentation
def words(expr: str) -> str:
    return ws_tokens(f"coalesce({expr}, '')")


def first_sentences(expr: str) -> tuple[str, str, str]:
    """(first, second, last) of ``segment.first_sentences`` for any text."""
    paras = f"string_split_regex({strip(f'coalesce({expr}, chr(0))')}, '\\n{{2,}}')"
    # chr(0) stands for a missing text and never occurs in real text
    p1 = f"(CASE WHEN {expr} IS NULL THEN '' ELSE {paras}[1] END)"
    p2 = f"(CASE WHEN {expr} IS NULL OR len({paras}) < 2 THEN '' ELSE {paras}[2] END)"
    pl = f"(CASE WHEN {expr} IS NULL THEN '' ELSE {paras}[-1] END)"
    f1, _ = first_last_sentence(p1)
    f2, _ = first_last_sentence(p2)
    _, last = first_last_sentence(pl)
    return (f"(CASE WHEN {p1} = '' THEN '' ELSE {f1} END)",
            f"(CASE WHEN {p2} = '' THEN '' ELSE {f2} END)",
            f"(CASE WHEN {pl} = '' THEN '' ELSE {last} END)")


def sentences(expr: str) -> str:
    """P10 without look-behind: mark each gap after . ! ? with NUL, split."""
    marked = f"regexp_replace(coalesce({expr}, ''), {q('([.!?])' + R.ws + '+')}, '\\1' || chr(0), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(0)), lambda s: {strip('s')}), lambda s: s <> '')"


def url_host(expr: str) -> str:
    return f"lower(coalesce(regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"


def domain_key(expr: str) -> str:
    parts = f"string_split({url_host(expr)}, '.')"
    return f"(CASE WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '.') ELSE array_to_string({parts}, '.') END)"


def title_keywords(posts_sql: str, dict_sql: str, noun_prefix: str = "n") -> str:
    """``(idx, keywords)`` for posts whose title has a noun."""
    tr = lambda e: f"coalesce(substr({e}, 1, 100), '')"
    nouns_tok = ws_tokens(f"lower({normalize_for_score('title_q')})")
    return f"""
WITH sq AS (SELECT idx, {tr(clean_text(clean_text('title')))} AS title_q FROM ({posts_sql}) p),
tt AS (SELECT idx, unnest(range(len(l))) AS pos, unnest(l) AS surface FROM (SELECT idx, {nouns_tok} AS l FROM sq) x)
SELECT tt.idx, array_to_string(list(tt.surface ORDER BY tt.pos)[1:5], ' ') AS keywords
FROM tt JOIN ({dict_sql}) d ON d.surface = tt.surface
WHERE starts_with(d.tag, {q(noun_prefix)}) GROUP BY tt.idx
"""


PAIRS_V = PAIRS_V % (runs("benchmark", "item_id"), runs("documents", "doc_id"))
