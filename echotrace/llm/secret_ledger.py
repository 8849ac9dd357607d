"""Secret scans over an incremental blob ledger.

A *version* is any row that carries a text: a document, or one historical state
of a file.  Versions are content-addressed (sha-256 of the text), so a text that
occurs under many paths is one blob.  The ledger holds one row per blob and scan:
the rule versions it was scanned with (``scanned``, e.g. ``hex@1``) and what they
found.  A scan works only on (blob, rule version) pairs the ledger does not hold;
findings are joined back to every path of the blob.

Spark's regular expressions return the matched strings, not their places.  The
place follows from lengths: the pieces between matches (``split``) and the
matches themselves (``regexp_extract_all``) alternate, so a running sum over the
hits of a blob gives each start.  Everything is DataFrame functions.

A blob held by a third of all rows is scanned once; findings are joined back to
narrow rows by (blob, salt).

Defined results: a null text is the empty text and has no span; repeated rows
each get the blob's findings; an empty table gives an empty result; offsets are
code points, end exclusive, on the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One kind of secret; ``pattern`` needs ``group`` to have ``min_len`` characters."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules of the contract.  A run of 24+ (16+ after AKIA)
#: characters is the same as a whole run whose short cases are dropped.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published token shapes: key headers, JSON web tokens, code-host and chat tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("githost", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

SALTS = 32

LEDGER_SCHEMA = "blob string, scanned array<string>, found array<struct<kind:string,start:long,end:long>>"


def _hits(rule: Rule, text: Column, todo: Column) -> Column:
    """Array of (kind, i, gap, len, keep) of one rule: the gap before each match and its length."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    if rule.group:
        kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.min_len)
    else:
        kept = F.transform(whole, lambda m: F.length(m) >= rule.min_len)
    zipped = F.transform(
        F.arrays_zip(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(whole)).alias("gap"),
                     F.transform(whole, F.length).alias("len"), kept.alias("keep")),
        lambda z, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), z["gap"].cast("long").alias("gap"),
                              z["len"].cast("long").alias("len"), z["keep"].alias("keep")))
    return F.when(F.array_contains(todo, rule.key) & F.rlike(text, pattern), zipped)


def blobs_of(versions: DataFrame, content: str = "text") -> DataFrame:
    """All columns of ``versions`` renamed away except ``blob`` and ``content``."""
    text = F.coalesce(F.col(content), F.lit(""))
    return versions.select(F.sha2(text, 256).alias("blob"), text.alias("content"))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the (blob, rule version) pairs that ``ledger`` lacks.

    ``blobs``: blob, content; a blob may be listed more than once.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        work = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        work = (blobs.join(seen, "blob", "left")
                     .withColumn("todo", F.array_except(wanted, F.coalesce(F.col("seen"), F.array().cast("array<string>"))))
                     .where(F.size("todo") > 0))
    none = F.array().cast("array<struct<kind:string,i:int,gap:long,len:long,keep:boolean>>")
    hits = F.concat(*[F.coalesce(_hits(r, F.col("content"), F.col("todo")), none) for r in rules])
    scanned = work.select("blob", "todo", hits.alias("hits"))
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    order = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    run = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # one row per blob; all later steps keep this partitioning
    once = scanned.groupBy("blob").agg(F.first("todo").alias("todo"), F.first("hits").alias("hits"))
    rows = once.select("blob", "todo", F.explode_outer("hits").alias("x")).select("blob", "todo", "x.*")
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
                  .withColumn("span", F.when(F.col("keep"), F.struct(
                      (F.col("end") - F.col("len")).alias("start"), order.alias("nr"), F.col("kind"), F.col("end")))))
    return (placed.groupBy("blob")
                  .agg(F.first("todo").alias("scanned"), F.array_sort(F.collect_list("span")).alias("spans"))
                  .select("blob", "scanned", F.coalesce(F.transform("spans", lambda s: F.struct(
                      s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), empty).alias("found")))


def unseen_content(versions: DataFrame, id_col: str, content: str = "text") -> DataFrame:
    """(blob, content) with one row per blob: the row with the smallest id stands for it.

    Only ids and digests are aggregated (map-side combined); the texts move once.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    rows = versions.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("content"))
    first = rows.groupBy("blob").agg(F.min("id").alias("first_id")).withColumnRenamed("blob", "first_blob")
    return rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("first_blob")),
                     "left_semi").select("blob", "content")


def merged_ledger(ledger: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The ledger after a scan; append ``fresh`` to keep it."""
    return fresh if ledger is None else ledger.select("blob", "scanned", "found").unionByName(fresh)


def findings_by_path(versions: DataFrame, ledger: DataFrame, id_col: str, content: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: id, blob, found (sorted by start, then rule order; current rule versions only)."""
    paths = versions.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("blob"))
    hit = ledger.where(F.size("found") > 0).select(F.col("blob").alias("hit_blob"), "found")
    # several scans of one blob (new rule versions) leave several rows
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    hit = (hit.groupBy("hit_blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
              .withColumn("found", F.transform(F.array_sort(F.transform("found", lambda s: F.struct(
                  s["start"].alias("start"), F.element_at(order, s["kind"]).alias("nr"), s["kind"].alias("kind"),
                  s["end"].alias("end")))), lambda s: F.struct(
                  s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    # few blobs have a finding: each goes to every salt, so the paths of a hot blob are spread
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    hit = hit.withColumn("hit_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (paths.join(hit, (F.col("blob") == F.col("hit_blob")) & (F.col("salt") == F.col("hit_salt")), "left")
                 .select("id", "blob", F.coalesce("found", empty).alias("found")))


def span_text(found: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The whole scan for a table with doc_id and text: one row per row."""
    fresh = scan_blobs(unseen_content(docs, "doc_id"), ledger)
    found = findings_by_path(docs, merged_ledger(ledger, fresh), "doc_id")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` (doc_id, text, and any columns) with every found span replaced by ``mask``.

    Overlapping spans give one mask.  Rows without a finding keep their text as it
    is.  A column ``n_chars`` follows the changed texts.  Findings are joined back by
    (blob, salt), so copies of one text never meet in one task.  The pieces of a text
    between its masks are cut from the array of its characters and joined once.
    """
    fresh = scan_blobs(unseen_content(docs, "doc_id"))
    hit = fresh.where(F.size("found") > 0).select(
        F.col("blob").alias("__blob"), F.explode(F.sequence(F.lit(0), F.lit(REDACT_SALTS - 1))).alias("__s"), F.col("found").alias("__found"))
    keyed = docs.withColumns({"__key": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256),
                              "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(REDACT_SALTS)).cast("int")})
    joined = keyed.join(hit, (F.col("__key") == F.col("__blob")) & (F.col("__salt") == F.col("__s")), "left")
    # spans in order as disjoint masks: (end of the text kept before it, start of the text kept behind it)
    merged = F.aggregate(
        "__found", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                             F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))))
    found = joined.withColumn("__masks", F.when(F.col("__found").isNotNull(), merged))
    # one pair per kept piece: from the end of one mask to the start of the next
    found = found.withColumn("__from", F.concat(F.array(F.lit(0).cast("long")), F.transform("__masks", lambda m: m["end"])))
    found = found.withColumn("__upto", F.concat(F.transform("__masks", lambda m: m["start"]), F.array(F.length("text").cast("long"))))
    found = found.withColumn("__chars", F.when(F.col("__masks").isNotNull(), F.split("text", "")))
    pieces = F.transform(F.arrays_zip("__from", "__upto"), lambda x: F.array_join(F.slice(
        F.col("__chars"), (x["__from"] + 1).cast("int"), (x["__upto"] - x["__from"]).cast("int")), ""))
    out = found.withColumn("__text", F.when(F.col("__masks").isNull(), F.col("text")).otherwise(F.array_join(pieces, mask)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__masks").isNull(), F.col("n_chars")).otherwise(
            F.length("__text").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col("__text")).select(*docs.columns)


#: Groups to which the rows of one text are dealt when findings are joined back.
REDACT_SALTS = 16


#: The same rows from the base rules and the further rules, whole texts, without the ledger.
def _sql_spans(kind: str, nr: int, pattern: str, group: int, min_len: int) -> str:
    """List of (start, nr, kind, end) of one rule: running sums over the pieces between matches."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, {nr} AS nr, '{kind}' AS kind, e - l AS s, e FROM (
    SELECT rid, l, k, sum(g + l) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
      SELECT rid, i, length(gaps[i]) AS g, length(whole[i]) AS l, length(kept[i]) AS k
      FROM (SELECT rid, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS whole,
                   regexp_extract_all(t, '{p}', {group}) AS kept FROM versions WHERE regexp_matches(t, '{p}')),
           unnest(range(1, len(whole) + 1)) AS u(i)))
  WHERE k >= {min_len}"""


LEDGER_SQL = """
WITH versions AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {documents}),
spans AS (""" + "  UNION ALL".join(
    _sql_spans(r.kind, i, r.pattern, r.group, r.min_len) for i, r in enumerate(RULES)).replace("{", "{{").replace("}", "}}") + """),
joined AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nr) FILTER (nr < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nr) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM versions LEFT JOIN joined USING (rid)
"""
