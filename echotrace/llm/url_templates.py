"""URL filtering by a path-template tree of labelled purity.

Per host the paths form a tree of segments.  Segments that vary by nature
(numbers, mixed letters and digits, long hex) become classes at once, each page
row-locally; the table then shrinks to one row per (host, segment list) with the
counts of pages, labelled pages and bad pages.  Level by level from the root,
children of a node are merged

* into the wildcard ``*`` when they are rare (less than ``min_support`` labelled
  pages: too few to tell apart) or like the node: their bad share lies within ``z``
  standard errors of the share of all its children (two-sided test of a proportion);
* into a wildcard ``*k`` of their own when they are unlike the node but like one
  another: of those whose bad share falls into band ``k`` of five, the ones within ``z``
  standard errors of the band's common share (a lone child keeps its name).

The tree grows until no path has a further segment.  Below a node whose children
have less than ``min_support`` labelled pages together, or only good or only bad
ones, every merge is ``*``: its rows get the rest of their template at once.  With
a ``depth`` the segments below it are one tail segment ``**``.

A template is rejected when its smoothed purity

    (bad + k * host_share) / (labelled + k),  host_share = (bad_h + k * g) / (labelled_h + k)

reaches ``reject_at`` (g: bad share of all labelled pages).  Templates without a
label fall back on the host, hosts without a label on g.  Explicit allow and
block rules come first: the longest rule that fits wins.

Hot hosts only meet as counts: pages are pre-aggregated before every shuffle, sums
over the children of a node are map-side combined and joined back by (host, template,
salt), and the verdict is joined back on (host, shape, salt).

Defined results: a null url, or one without ``://``, has an empty host and path;
repeated urls get the same verdict; labels that are missing or null count as
unlabelled; several labels of a page: bad if any is; without any label the method
allows everything; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.llm.common import cut
from echotrace.session import stored

SALTS = 64
#: Bands of bad share in which branches unlike their node are compared with one another.
BANDS = 5


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def shape_of(path: Column, depth: int | None) -> Column:
    """Segments of a path with variable ones as classes; what lies below ``depth`` (if any) is one tail segment."""
    def segment(x: Column) -> Column:
        ext = F.regexp_extract(x, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.regexp_replace(x, r"\.[A-Za-z]{1,5}$", "")
        kind = (F.when(stem.rlike(r"^[0-9]+$"), "{n}")
                 .when(stem.rlike(r"^[0-9a-fA-F-]{16,}$"), "{hex}")
                 .when(stem.rlike(r"[0-9]"), "{mixed}").otherwise(stem))
        return F.concat(kind, ext)

    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    if depth is None:
        return F.transform(parts, segment)
    shape = F.transform(F.slice(parts, 1, depth), segment)
    return F.concat(shape, F.when(F.size(parts) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


def templates(pages: DataFrame, labels: DataFrame, depth: int | None = None, min_support: int = 5, z: float = 1.96,
              smooth: float = 4.0, reject_at: float = 0.5) -> DataFrame:
    """One row per (host, shape): template, counts, purity and verdict.

    ``pages``: page_id, host, path.  ``labels``: doc_id, bad (0/1 or null).
    ``depth``: most segments that are read (None: all).
    """
    shaped = pages.select("page_id", "host", shape_of(F.col("path"), depth).alias("shape"))
    bad = labels.where(F.col("bad").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("bad").alias("bad"))
    nodes = (shaped.join(bad, F.col("page_id") == F.col("l_id"), "left")
                   .groupBy("host", "shape")
                   .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_lab"),
                        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_bad"))
                   .withColumn("template", F.lit("")).withColumn("open", F.size("shape") > 0))
    # stored, not checkpointed: a checkpoint hands on what the planner knows of its rows, which doubles with every level
    nodes, level = stored(nodes), 0
    while not nodes.where("open").isEmpty():
        level += 1
        # the node a row passes at this level: its parent's template and its own segment
        nodes = nodes.withColumn("seg", F.when(F.col("open"), F.get("shape", F.lit(level - 1))))
        child = (nodes.where(F.col("seg").isNotNull()).groupBy("host", "template", "seg")
                      .agg(F.sum("n_lab").alias("c_lab"), F.sum("n_bad").alias("c_bad")))
        child = cut(child.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS))))

        def pooled(rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
            """``rows`` with sums over all rows of equal ``by``, joined back by ``by`` and salt."""
            sums = rows.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in names.items()])
            sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in by], *names,
                               F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_salt"))
            on = F.col("salt") == F.col("s_salt")
            for c in by:
                on = on & F.col(c).eqNullSafe(F.col(f"s_{c}"))
            return rows.join(sums, on).drop(*[f"s_{c}" for c in by], "s_salt")

        def off(share: Column, of: Column, n: str) -> Column:
            """Whether a share of ``n`` pages lies beyond the standard errors of the share ``of``."""
            return F.abs(share - of) > z * F.sqrt(of * (1 - of) / F.greatest(F.col(n), F.lit(1)))

        child = pooled(child, ["host", "template"], {"p_lab": "c_lab", "p_bad": "c_bad"})
        share = F.col("c_bad") / F.greatest(F.col("c_lab"), F.lit(1))
        child = (child.withColumn("alike", (F.col("p_lab") < min_support) | (F.col("p_bad") == 0) | (F.col("p_bad") == F.col("p_lab")))
                      .withColumn("band", F.when((F.col("c_lab") >= min_support)
                                                 & off(share, F.col("p_bad") / F.greatest(F.col("p_lab"), F.lit(1)), "c_lab"),
                                                 F.least(F.floor(BANDS * share), F.lit(BANDS - 1)).cast("int"))))
        child = pooled(child, ["host", "template", "band"], {"b_lab": "c_lab", "b_bad": "c_bad"})
        own = (F.col("b_lab") == F.col("c_lab")) | off(share, F.col("b_bad") / F.greatest(F.col("b_lab"), F.lit(1)), "c_lab")
        named = (F.when(F.col("band").isNull(), "*").when(own, F.col("seg")).otherwise(F.concat(F.lit("*"), F.col("band").cast("string"))))
        child = child.select(F.col("host").alias("c_host"), F.col("template").alias("c_template"), F.col("seg").alias("c_seg"), "alike",
                             named.alias("named"))
        nodes = (nodes.join(child, (F.col("host") == F.col("c_host")) & (F.col("template") == F.col("c_template"))
                            & (F.col("seg") == F.col("c_seg")), "left")
                      .withColumn("template", F.when(F.col("named").isNull(), F.col("template"))
                                               .when(F.col("alike"), F.concat("template", F.repeat(F.lit("/*"), F.size("shape") - (level - 1))))
                                               .otherwise(F.concat("template", F.lit("/"), "named")))
                      .withColumn("open", F.col("named").isNotNull() & ~F.col("alike") & (F.size("shape") > level))
                      .select("host", "shape", "n", "n_lab", "n_bad", "template", "open"))
        nodes = stored(nodes)
    everything = nodes.agg((F.sum("n_bad") / F.greatest(F.sum("n_lab"), F.lit(1))).alias("g")).collect()[0]["g"]
    hosts = (nodes.groupBy("host").agg(F.sum("n_lab").alias("h_lab"), F.sum("n_bad").alias("h_bad"))
                  .select(F.col("host").alias("h_host"), "h_lab",
                          ((F.col("h_bad") + smooth * F.lit(everything or 0.0)) / (F.col("h_lab") + smooth)).alias("host_share")))
    pure = (nodes.groupBy("host", "template").agg(F.sum("n_lab").alias("t_lab"), F.sum("n_bad").alias("t_bad"))
                 .join(hosts, F.col("host") == F.col("h_host"))
                 .select(F.col("host").alias("t_host"), F.col("template").alias("t_template"), "t_lab", "t_bad",
                         ((F.col("t_bad") + smooth * F.col("host_share")) / (F.col("t_lab") + smooth)).alias("bad_share")))
    return (nodes.join(pure, (F.col("host") == F.col("t_host")) & (F.col("template") == F.col("t_template")))
                 .select("host", "shape", "template", F.col("t_lab").alias("n_labelled"), F.col("t_bad").alias("n_bad"),
                         "bad_share", F.when(F.col("bad_share") >= reject_at, "block").otherwise("allow").alias("verdict")))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES, depth: int | None = None, **params) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, template, bad_share."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    tree = (templates(parsed, labels, depth, **params)
            .select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "bad_share",
                    F.col("verdict").alias("t_verdict"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keyed = parsed.select("page_id", "host", "path", shape_of(F.col("path"), depth).alias("shape"),
                          F.pmod(F.xxhash64("path", "page_id"), F.lit(SALTS)).alias("salt"))
    joined = keyed.join(tree, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape"))
                        & (F.col("salt") == F.col("t_salt")))
    return joined.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.col("t_verdict")).alias("verdict"),
                         "template", "bad_share")


def page_labels(labels: DataFrame) -> DataFrame:
    """doc_id, bad: a page is bad when its document is labelled low quality or toxic."""
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), F.lit(None).cast("int")).otherwise(
        ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    return labels.select("doc_id", bad.alias("bad"))


def templates_sql(min_support: int = 5, z: float = 1.96, smooth: float = 4.0, reject_at: float = 0.5) -> str:
    """The same rows over ``pages`` and ``labels``; the tree grows by recursion, as deep as the paths are."""
    ends = r"'\.[A-Za-z]{1,5}$'"
    off = lambda share, of, n: f"abs({share} - {of}) > {z} * sqrt({of} * (1 - {of}) / greatest({n}, 1))"
    fits = [f"(s.host = '{r.host}' OR ends_with(s.host, '.{r.host}')) AND starts_with(s.path, '{r.path}')" for r in RULES]
    longest = sorted(zip(RULES, fits), key=lambda x: -len(x[0].text))
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for r, f in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in longest) + " END"
    return f"""
WITH RECURSIVE rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
parts AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM parsed),
shaped AS (
  SELECT page_id, host, path, list_transform(parts, lambda x:
    CASE WHEN regexp_matches(regexp_replace(x, {ends}, ''), '^[0-9]+$') THEN '{{n}}'
         WHEN regexp_matches(regexp_replace(x, {ends}, ''), '^[0-9a-fA-F-]{{16,}}$') THEN '{{hex}}'
         WHEN regexp_matches(regexp_replace(x, {ends}, ''), '[0-9]') THEN '{{mixed}}' ELSE regexp_replace(x, {ends}, '') END
    || regexp_extract(x, {ends})) AS shape FROM parts),
lab AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels
        WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
tree AS (
  SELECT host, shape, count(bad)::BIGINT AS n_lab, coalesce(sum(bad), 0)::BIGINT AS n_bad, '' AS template, 0 AS level
  FROM shaped LEFT JOIN lab ON doc_id = page_id GROUP BY host, shape
  UNION ALL
  SELECT host, shape, n_lab, n_bad, template || '/' || CASE WHEN band IS NULL THEN '*'
           WHEN b_lab = c_lab OR {off('c_share', '(b_bad / greatest(b_lab, 1))', 'c_lab')} THEN seg ELSE '*' || band END, level + 1
  FROM (SELECT *, sum(n_lab) OVER of_band AS b_lab, sum(n_bad) OVER of_band AS b_bad
        FROM (SELECT *, CASE WHEN c_lab >= {min_support} AND {off('c_share', 'p', 'c_lab')}
                             THEN least(floor({BANDS} * c_share), {BANDS - 1})::INTEGER END AS band
              FROM (SELECT *, c_bad / greatest(c_lab, 1) AS c_share, p_bad / greatest(p_lab, 1) AS p
                    FROM (SELECT host, shape, n_lab, n_bad, template, level, shape[level + 1] AS seg,
                                 sum(n_lab) OVER of_child AS c_lab, sum(n_bad) OVER of_child AS c_bad,
                                 sum(n_lab) OVER of_node AS p_lab, sum(n_bad) OVER of_node AS p_bad
                          FROM tree WHERE len(shape) > level
                          WINDOW of_child AS (PARTITION BY host, template, shape[level + 1]), of_node AS (PARTITION BY host, template))))
        WINDOW of_band AS (PARTITION BY host, template, band))),
leaves AS (SELECT host, shape, any_value(n_lab) AS n_lab, any_value(n_bad) AS n_bad, arg_max(template, level) AS template
           FROM tree GROUP BY host, shape),
g AS (SELECT coalesce(sum(n_bad) / greatest(sum(n_lab), 1), 0) AS g FROM leaves),
h AS (SELECT host, (sum(n_bad) + {smooth} * (SELECT g FROM g)) / (sum(n_lab) + {smooth}) AS host_share FROM leaves GROUP BY host),
t AS (SELECT x.host, x.template, (sum(n_bad) + {smooth} * any_value(host_share)) / (sum(n_lab) + {smooth}) AS bad_share
      FROM leaves x JOIN h ON h.host = x.host GROUP BY x.host, x.template)
SELECT s.page_id, s.host, s.path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN t.bad_share >= {reject_at} THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM shaped s JOIN leaves n ON n.host = s.host AND n.shape = s.shape JOIN t ON t.host = n.host AND t.template = n.template
"""
