"""Column -> Column text functions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none calls Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from echotrace.functions import regex as R


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends.
    Spark's one-argument ``trim`` only removes spaces; the two-argument form
    with the whitespace set is exact and far cheaper than a regex."""
    return F.trim(_c(col), F.lit(R.WS_STRING))


# ---------------------------------------------------------------- P1
def preprocess_title(col) -> Column:
    """Text before the first ``&keyword=``; null stays null."""
    return F.substring_index(_c(col), "&keyword=", 1)


# ---------------------------------------------------------------- P2
def _replace_where(col: Column, signs: tuple[str, ...], pattern: str, repl: str) -> Column:
    """``regexp_replace`` that runs only on texts holding one of the ``signs`` (each match holds one; none: on all)."""
    if not signs:
        return F.regexp_replace(col, pattern, repl)

    def step(v: Column) -> Column:  # v: the text so far, computed once
        return F.when(reduce(Column.__or__, [F.contains(v, F.lit(x)) for x in signs]), F.regexp_replace(v, pattern, repl)).otherwise(v)

    return F.element_at(F.transform(F.array(col), step), 1)


def clean_text(col, literal_escape: bool = False) -> Column:
    """Post/article cleaner: 11 ordered steps then strip.

    Null (a missing cell) and any text equal to ``nan`` after strip/lower give
    ``''``.  With ``literal_escape=False`` (default, the reference's behaviour)
    the last class is a character set, so every ``_``, ``x``, ``0`` and ``D``
    becomes a space; ``literal_escape=True`` treats ``_x000D_`` as one token.
    """
    s = F.coalesce(_c(col).cast("string"), F.lit("nan"))
    out = s
    for (pattern, repl), signs in zip(R.CLEAN_TEXT_STEPS, R.CLEAN_TEXT_SIGNS, strict=True):
        out = _replace_where(out, signs, pattern, repl)
    out = F.regexp_replace(out, R.CLEAN_TEXT_TOKENS if literal_escape else R.CLEAN_TEXT_CHARSET, " ")
    out = F.regexp_replace(out, R.WS + "+", " ")
    out = py_strip(out)
    return F.when(F.lower(py_strip(s)) == F.lit("nan"), F.lit("")).otherwise(out)


# ---------------------------------------------------------------- P3
def truncate(col, n: int = 100) -> Column:
    """First ``n`` characters; null or empty -> ''."""
    return F.coalesce(F.substring(_c(col), 1, n), F.lit(""))


# ---------------------------------------------------------------- P7
def oid_from_url(col) -> Column:
    """Publisher id: the 3 digits after ``/article/`` in the URL path."""
    path = F.try_parse_url(_c(col), F.lit("PATH"))
    return F.nullif(F.regexp_extract(path, "/article/(" + R.DIGIT + "{3})/" + R.DIGIT + "+", 1), F.lit(""))


# ---------------------------------------------------------------- P8
def url_host(col) -> Column:
    """Lower-cased host of a URL, '' when it has none (urlparse().hostname)."""
    return F.lower(F.coalesce(F.try_parse_url(_c(col), F.lit("HOST")), F.lit("")))


def domain_key(col) -> Column:
    """Last two labels of the host (``www.ytn.co.kr`` -> ``co.kr``).
    A one-label host is returned whole, like Python's slice."""
    parts = F.split(url_host(col), r"\.", -1)
    return F.array_join(F.when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(parts), ".")


# ---------------------------------------------------------------- P9
def normalize_for_score(col) -> Column:
    """Drop characters that are neither word nor space, collapse spaces, strip."""
    s = F.regexp_replace(F.coalesce(_c(col), F.lit("")), R.NOT_WORD_NOT_WS, "")
    return py_strip(F.regexp_replace(s, R.WS + "+", " "))


# ---------------------------------------------------------------- P11 / P12
def safe_file_name(idx_col, title_col, max_len: int = 50) -> Column:
    """``NNN_title.txt``: 1-based index with 3 digits (more if needed),
    title without ``\\/*?:"<>|`` cut to 50 characters."""
    safe = F.substring(F.regexp_replace(F.coalesce(_c(title_col), F.lit("")), r'[\\/*?:"<>|]', ""), 1, max_len)
    return F.format_string("%03d_%s.txt", (_c(idx_col) + 1).cast("long"), safe)


def hyperlink(col) -> Column:
    return F.concat(F.lit('=HYPERLINK("'), _c(col), F.lit('")'))


# ---------------------------------------------------------------- P13
# Ambiguous punctuation and its plain replacement, one to one,
# in the reference's order: · ․ ㆍ ･ ～ ❑ ‘ ’ “ ” 「 」 -> / / / / ~ - ' ' " " < >
PUNCT_FROM = "·․ㆍ･～❑‘’“”「」"
PUNCT_TO = "////~-''\"\"<>"


def normalize_punctuation(col) -> Column:
    return F.translate(_c(col), PUNCT_FROM, PUNCT_TO)


# ---------------------------------------------------------------- P14 / P15
def delete_links(col) -> Column:
    return F.regexp_replace(_c(col), "http" + R.JAVA.non_ws + "+", "")


def delete_mentions(col) -> Column:
    return F.regexp_replace(_c(col), "@" + R.JAVA.non_ws + "+", "")


# ---------------------------------------------------------------- P16 / P17
def char2hex(col) -> Column:
    """Code point of the first character as ``0x..`` in lower case."""
    return F.concat(F.lit("0x"), F.lower(F.hex(F.ascii(_c(col)))))


def hex2char(col) -> Column:
    """Hex code point (with or without ``0x``) -> character (UTF-32 decode)."""
    digits = F.regexp_replace(py_strip(_c(col)), "^0[xX]", "")
    return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")


# ---------------------------------------------------------------- P18
def partition_array(arr_col, idx_col) -> Column:
    """Cut an array in front of each of the ascending 0-based indices; the
    pieces in order, empty ones included.  The lambda walks the (start, end)
    pairs only; pass materialised columns so the array is not rebuilt per group."""
    arr, idx = _c(arr_col), _c(idx_col)
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), idx).alias("s"),
                          F.concat(idx, F.array(F.size(arr))).alias("e"))
    return F.transform(bounds, lambda b: F.slice(arr, b["s"] + 1, F.greatest(b["e"] - b["s"], F.lit(0))))


# ---------------------------------------------------------------- P24
def round_ratio(col, digits: int = 3) -> Column:
    """Python ``round(x, 3)`` on a double: half to even."""
    return F.bround(_c(col), digits)
