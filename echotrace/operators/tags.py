"""Token and tag tables.

The reference wraps native morphological analysers; the data work around
them — parsing their output, joined forms, grouping, tag roll-up, noun
filters, dictionary lookups — is plain column and join work here.  Long form
is ``(id, …, pos, morph, tag)``; arrays of ``struct<morph, tag>`` are built
only inside one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions import regex as R
from echotrace.functions.text import _c, py_strip
from echotrace.session import cut_lineage
from echotrace.sources.reference_data import UNKNOWN_TAG

# Python str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
# Fixed value. One morpheme of an analysis: shortest text, a slash, a word tag, optional '+'.
MORPH_TAG = r"(.+?/" + R.WORD + r"+)\+?"
# Line breaks other than \n, and the morphemes of a line from its first character that is no white space on.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_MORPHS = r"\G(?:^" + R.WS + "*+)?+" + MORPH_TAG


def splitlines(col) -> Column:
    """``str.splitlines()``: no trailing empty line for a final line break."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), LINE_BREAK, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_last_slash(col) -> Column:
    """T5: ``rsplit('/', 1)`` -> ``struct(morph, tag)``; no slash -> tag null."""
    c = _c(col)
    has = F.contains(c, F.lit("/"))
    tag = F.substring_index(c, "/", -1)
    return F.struct(F.when(has, F.substr(c, F.lit(1), F.length(c) - F.length(tag) - 1)).otherwise(c).alias("morph"),
                    F.when(has, tag).alias("tag"))


def joined(morph, tag) -> Column:
    """T4: ``morph/tag``."""
    return F.concat_ws("/", _c(morph), _c(tag))


# ---------------------------------------------------------------- T1
def parse_block_output(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Block output: blank-line-separated blocks, the first line of a block is
    the surface, every other line one candidate analysis ``m/t+m/t``.

    Returns ``(id, block_pos, surface, alt_no, m_pos, morph, tag)``; the
    flattened form is these rows in (block_pos, alt_no, m_pos) order.  A block
    without analyses is one row with null ``alt_no``, ``m_pos``, ``morph`` and
    ``tag``.  Parsed inside the row: no shuffle."""
    # a stripped text ends with no line break, so its lines joined by \n are the text with every break as \n
    texts = df.select(F.col(id_col).alias("id"), py_strip(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    other = reduce(Column.__or__, [F.contains("_t", F.lit(c)) for c in OTHER_BREAKS])
    text = F.when(other, F.regexp_replace("_t", LINE_BREAK, "\n")).otherwise(F.col("_t"))
    blocks = texts.select("id", F.posexplode_outer(F.split(text, "\n\n", -1)).alias("block_pos", "_b"))
    rows = (blocks.select("id", F.col("block_pos").cast("long").alias("block_pos"), F.trim(F.col("_b"), F.lit("\n")).alias("_b"))
                  .where(F.col("_b") != "").withColumn("surface", F.substring_index("_b", "\n", 1)))
    rest = F.substr(F.col("_b"), F.length("surface") + 2)  # no empty lines inside a block
    alts = rows.select("id", "block_pos", "surface", F.posexplode_outer(
        F.when(F.length("_b") > F.length("surface"), F.split(rest, "\n", -1))).alias("alt_no", "line"))
    ms = alts.select("id", "block_pos", "surface", "alt_no", F.posexplode_outer(
        F.regexp_extract_all("line", F.lit(LINE_MORPHS), 1)).alias("m_pos", "mt"))
    part = split_last_slash("mt")
    return ms.select("id", "block_pos", "surface", "alt_no", "m_pos", part["morph"].alias("morph"), part["tag"].alias("tag"))


# ---------------------------------------------------------------- T2
def parse_tab_output(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tab output: ``surface<TAB>tag,features…`` per line, the last line
    (end marker) dropped; an empty or malformed line gives ``('', 'SY')``.
    Returns ``(id, pos, morph, tag)``."""
    ls = splitlines(F.col(text_col))
    body = F.slice(ls, 1, F.greatest(F.size(ls) - 1, F.lit(0)))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(body).alias("pos", "line"))
    parts = F.split(F.col("line"), "\t", 2)
    ok = (F.col("line") != "") & (F.size(parts) == 2)
    return rows.select("id", "pos",
                       F.when(ok, F.try_element_at(parts, F.lit(1))).otherwise(F.lit("")).alias("morph"),
                       F.when(ok, F.substring_index(F.try_element_at(parts, F.lit(2)), ",", 1)).otherwise(F.lit("SY"))
                        .alias("tag"))


# ---------------------------------------------------------------- T3 / F10
def morphs(tagged) -> Column:
    """T3 on an ``array<struct<morph, tag>>`` column."""
    return F.transform(_c(tagged), lambda s: s["morph"])


def nouns(tagged, prefix: str = "N", exact: str | None = None) -> Column:
    """morphs whose tag starts with ``prefix`` (``N``, ``NN``) or equals
    ``exact`` (``Noun``)."""
    if exact is not None:
        keep = lambda s: s["tag"] == exact
    else:
        keep = lambda s: s["tag"].startswith(prefix)
    return F.transform(F.filter(_c(tagged), keep), lambda s: s["morph"])


def noun_rows(df: DataFrame, tag: str = "tag", prefix: str = "N", exact: str | None = None) -> DataFrame:
    cond = (F.col(tag) == exact) if exact is not None else F.col(tag).startswith(prefix)
    return df.where(cond)


# ---------------------------------------------------------------- T6
def group_tokens(df: DataFrame, keys: list[str], order: str, cols: list[str], name: str = "tokens") -> DataFrame:
    """``flatten=False``: one ordered ``array<struct>`` per group (a word, a
    line); a group never exceeds the text it came from."""
    return (df.groupBy(*keys)
              .agg(F.sort_array(F.collect_list(F.struct(order, *cols))).alias("_g"))
              .select(*keys, F.transform("_g", lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias(name)))


def flatten_groups(df: DataFrame, keys: list[str], group_order: str, name: str = "tokens") -> DataFrame:
    """``flatten=True``: the groups' elements as rows, in group order."""
    # outer, so that no size() filter on the groups can be inferred
    return df.select(*keys, group_order, F.posexplode_outer(name).alias("pos_in_group", "_t")).where(
        F.col("pos_in_group").isNotNull()).select(*keys, group_order, "pos_in_group", "_t.*")


# ---------------------------------------------------------------- T7
def tag_class(tag, ntags: int = 9) -> Column:
    """Roll a fine tag up to the 22- or 9-class set: ``s*`` -> S, ``f`` -> F,
    otherwise the upper-cased first two letters (22) or first letter (9);
    ``unk`` and ``iwg`` belong to no class (null)."""
    if ntags not in (9, 22):
        raise ValueError(f"no class set with {ntags} tags; 9 or 22")
    t = F.lower(_c(tag))
    n = 2 if ntags == 22 else 1
    return (F.when(t.isin("unk", "iwg") | t.isNull() | (t == ""), F.lit(None).cast("string"))
             .when(t.startswith("s"), F.lit("S"))
             .when(t.startswith("f"), F.lit("F"))
             .otherwise(F.upper(F.substring(t, 1, n))))


# ---------------------------------------------------------------- T8
def closure(edges: DataFrame) -> DataFrame:
    """Tag-set membership closure: every (group, member) reachable through the
    hierarchy, with ``is_leaf`` for members that are not groups themselves.

    Paths are doubled until nothing new appears, so a chain of any depth takes a
    logarithmic number of steps; each step is checkpointed, so the plan stays flat."""
    reach = cut_lineage(edges.select("parent", "child").distinct())
    n = reach.count()
    while True:
        step = (reach.alias("f").join(reach.alias("e"), F.col("f.child") == F.col("e.parent"))
                     .select(F.col("f.parent").alias("parent"), F.col("e.child").alias("child")))
        reach = cut_lineage(reach.unionByName(step).distinct())
        grown = reach.count()
        if grown == n:
            break
        n = grown
    groups = edges.select(F.col("parent").alias("child")).distinct().withColumn("_g", F.lit(True))
    return (reach.join(groups, "child", "left")
                 .select(F.col("parent").alias("group"), F.col("child").alias("member"),
                         F.col("_g").isNull().alias("is_leaf")))


# ---------------------------------------------------------------- J7 / J8 / J9
def first_entries(dictionary: DataFrame, order: str | None = None) -> DataFrame:
    """One tag per surface: the first line of the dictionary wins (``order`` is
    the line number; without one the smallest tag)."""
    by = F.col(order) if order else F.col("tag")
    return dictionary.groupBy("surface").agg(F.min_by("tag", by).alias("tag"))


def tag_with_dictionary(tokens: DataFrame, dictionary: DataFrame, token: str = "token",
                        default_tag: str | None = UNKNOWN_TAG, order: str | None = None) -> DataFrame:
    """Each token's dictionary tag (``first_entries``); unknown tokens get ``default_tag``.
    The planner picks broadcast only when the dictionary is small at run time."""
    d = first_entries(dictionary, order).select(F.col("surface").alias(token), F.col("tag").alias("_dtag"))
    out = tokens.join(d, token, "left")
    tag = F.coalesce("_dtag", F.lit(default_tag)) if default_tag is not None else F.col("_dtag")
    return out.withColumn("tag", tag).drop("_dtag")


def occurrences(tokens: DataFrame, id_col: str, pos: str, repeated: str, token: str = "token") -> DataFrame:
    """``(token, n_tokens, n_places)``: rows of every token and its distinct (id, position) pairs without nulls.

    Where ``repeated`` is null the id belongs to one text, so its positions differ; only the
    places of the other ids are compared.  Counts are combined before the shuffle."""
    place = [F.when(F.col(repeated).isNotNull(), F.col(c)).alias(n) for c, n in ((id_col, "_id"), (pos, "_pos"))]
    some = F.col(id_col).isNotNull() & F.col(pos).isNotNull()
    found = tokens.groupBy(token, *place).agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("m"))
    places = F.when(F.col("_id").isNull() | F.col("_pos").isNull(), F.col("m")).otherwise(F.lit(1))
    return found.groupBy(token).agg(F.sum("n").alias("n_tokens"), F.sum(places).alias("n_places"))


def candidate_analyses(tokens: DataFrame, analyses: DataFrame, token: str = "token") -> DataFrame:
    """Every alternative analysis of every token (one-to-many)."""
    a = analyses.select(F.col("surface").alias(token), "alt_no", "m_pos", "morph", F.col("tag").alias("a_tag"))
    return tokens.join(a, token)


def describe_tags(df: DataFrame, tagset: DataFrame, tag: str = "tag") -> DataFrame:
    """Tag description lookup (left join; unknown tags keep null)."""
    t = tagset.select(F.col("tag").alias(tag), "description")
    return df.join(t, tag, "left")
