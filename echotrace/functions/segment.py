"""Segmentation: sentences, lines, words, concordance.

Column functions return arrays; the ``*_rows`` helpers explode them into
ordered rows with an explicit 0-based position (never rely on row order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions import regex as R
from echotrace.functions.text import _c, py_strip


# ---------------------------------------------------------------- P4
def _first_piece(p: Column) -> Column:
    return F.element_at(F.split(py_strip(p), R.SENTENCE_BOUNDARY, -1), 1)


def first_sentences(col) -> Column:
    """``struct(first, second, last)``: first sentence of paragraph 1, first of
    paragraph 2, last of the last paragraph.  Paragraphs are separated by two or
    more newlines; a sentence ends after ``. ! ?`` before whitespace or Hangul."""
    text = F.coalesce(_c(col), F.lit(""))
    paras = F.split(py_strip(text), R.PARAGRAPH_GAP, -1)
    n = F.size(paras)
    p1 = F.element_at(paras, 1)
    plast = F.element_at(paras, -1)
    first = F.when(p1 != "", _first_piece(p1)).otherwise(F.lit(""))
    second = F.when((n > 1) & (F.element_at(paras, 2) != ""), _first_piece(F.element_at(paras, 2))).otherwise(F.lit(""))
    last = F.when(plast != "", py_strip(F.element_at(F.split(py_strip(plast), R.SENTENCE_BOUNDARY, -1), -1))) \
        .otherwise(F.lit(""))
    return F.struct(first.alias("first"), second.alias("second"), last.alias("last"))


# ---------------------------------------------------------------- P10
def sentences(col) -> Column:
    """Split after ``. ! ?`` followed by whitespace; pieces trimmed, blanks dropped."""
    pieces = F.transform(F.split(F.coalesce(_c(col), F.lit("")), R.SENTENCE_GAP, -1), py_strip)
    return F.filter(pieces, lambda x: x != "")


# ---------------------------------------------------------------- P21
def words(col) -> Column:
    """``str.split()``: whitespace-separated words, no empty strings."""
    return F.filter(F.split(py_strip(F.coalesce(_c(col), F.lit(""))), R.WS + "+", -1), lambda x: x != "")


# ---------------------------------------------------------------- P22
def lines(col) -> Column:
    """``str.split('\\n')`` with empty lines skipped."""
    return F.filter(F.split(F.coalesce(_c(col), F.lit("")), "\n", -1), lambda x: x != "")


def explode_positions(df: DataFrame, array_col: Column, pos: str = "pos", value: str = "value") -> DataFrame:
    """Rows ``(…, pos, value)`` of an array column, 0-based positions."""
    return df.select("*", F.posexplode(array_col).alias(pos, value))


# ---------------------------------------------------------------- P19 / P20
def concordance_positions(text_col, phrase) -> Column:
    """0-based indices of whitespace words that contain ``phrase`` (one pass
    over the word array)."""
    return hit_positions(words(text_col), phrase)


def hit_positions(terms: Column, phrase) -> Column:
    ph = phrase if isinstance(phrase, Column) else F.lit(phrase)
    marks = F.transform(terms, lambda x, i: F.when(F.contains(x, ph), i))
    return F.filter(marks, lambda i: i.isNotNull())


def concordance(df: DataFrame, text_col: str, phrase, width: int = 3) -> DataFrame:
    """One row per hit: ``(…, pos, context)``; context is the words
    ``[max(0, pos-width), pos+width)`` joined by one space.  Only hits are
    exploded, so a long text with few hits stays a few rows."""
    out = df.withColumn("_terms", words(text_col))
    out = out.withColumn("_hits", hit_positions(F.col("_terms"), phrase))
    out = out.select("*", F.explode("_hits").alias("pos"))
    start = F.greatest(F.col("pos") - width, F.lit(0))
    ctx = F.array_join(F.slice(F.col("_terms"), start + 1, F.col("pos") + width - start), " ")
    return out.withColumn("context", ctx).drop("_terms", "_hits")
