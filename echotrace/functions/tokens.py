"""Tokenizers and stop-word removal.

A tokenizer is any ``Column -> Column<array<string>>``; the default splits on
whitespace, ``word_tokens`` keeps ``\\w+`` runs.  A pandas UDF returning
``array<string>`` may be passed instead (Arrow-batched, off the hot path).
Text is lower-cased before tokenising, as the vectoriser of the reference does.
An analyser that works on many texts at once can be a table function instead
(``table_tokenizer``): Arrow batches in, token rows out, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.functions import regex as R
from echotrace.functions.text import _c, normalize_for_score, py_strip

Tokenizer = Callable[[Column], Column]
#: Texts that a table function tokenises at once.
TOKENIZED_ROWS = 256


def whitespace_tokens(col) -> Column:
    return F.filter(F.split(py_strip(_c(col)), R.WS + "+", -1), lambda x: x != "")


def word_tokens(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(R.WORD + "+"), 0)


def score_tokens(col, tokenizer: Tokenizer | None = None, stopwords: Iterable[str] | None = None) -> Column:
    """Tokens used by the copy ratio and retrieval: normalise (P9), lower-case,
    tokenise (X1), drop stop words (F9; duplicates stay, order kept)."""
    tok = tokenizer or whitespace_tokens
    toks = tok(score_text(col))
    return remove_stopwords(toks, stopwords)


def score_text(col) -> Column:
    """The text that ``score_tokens`` cuts by default: normalised (P9) and lower-cased, one space between tokens."""
    return F.lower(normalize_for_score(col))


def cut_words(texts: pa.Array, stopwords: Iterable[str] = ()) -> pa.ListArray:
    """The default ``score_tokens`` of many texts at once, out of their ``score_text``."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.string()), " ")
    words = lists.flatten().dictionary_encode()
    dropped = pc.is_in(words.dictionary, value_set=pa.array(["", *stopwords], pa.string()))
    kept = pc.invert(dropped.take(words.indices))
    owner = pc.list_parent_indices(lists).filter(kept).to_numpy()
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(kept).cast(pa.string()))


def remove_stopwords(tokens_col, stopwords: Iterable[str] | None) -> Column:
    """Filter an array column against a stop list (a hash set for more than ten words).
    Stop words are compared as given (not lower-cased), like the reference."""
    words = sorted(set(stopwords or []))
    if not words:
        return _c(tokens_col)
    return F.filter(_c(tokens_col), lambda x: ~x.isin(words))


def remove_stopwords_rows(token_rows: DataFrame, stop_df: DataFrame, token: str = "token") -> DataFrame:
    """Unbounded stop lists: long token table anti-joined with a one-column
    stop-word table (Spark/AQE picks broadcast only if the list is small)."""
    return token_rows.join(stop_df.select(F.col(stop_df.columns[0]).alias(token)).distinct(), token, "left_anti")


def require_string(df: DataFrame, *cols: str) -> DataFrame:
    """The phrase input must be a string column; checked on the schema
    before any job is planned."""
    for c in cols:
        dt = df.schema[c].dataType
        if not isinstance(dt, T.StringType):
            raise TypeError(f"phrase input should be string, not {dt.simpleString()} (column {c!r})")
    return df


def table_tokenizer(tokenize: Callable[[pa.Array], pa.ListArray]):
    """X1 as an Arrow table function over ``TABLE(id, text)``, many texts a call: ``(id, pos, token)``.

    ``tokenize`` maps an array of texts to one of token lists; nulls give no tokens.  Each text
    is cut by itself, so the table may be partitioned in any way."""

    @F.arrow_udtf(returnType="id bigint, pos int, token string")
    class Tokens:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            for lo in range(0, rows.num_rows, TOKENIZED_ROWS):
                part = rows.slice(lo, TOKENIZED_ROWS)
                lists = tokenize(pc.fill_null(part.column("text"), ""))
                owner, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten().cast(pa.string())
                pos = np.arange(len(owner)) - np.searchsorted(owner, owner)
                yield pa.table({"id": part.column("id").take(pa.array(owner)), "pos": pa.array(pos, pa.int32()), "token": flat})

    return Tokens


def tokens_by_table(df: DataFrame, id_col: str, text: Column, tokenize: Callable[[pa.Array], pa.ListArray],
                    stopwords: DataFrame | None = None) -> DataFrame:
    """``(id, pos, token)`` of the normalised, lower-cased texts by a table function; stop words (a one-column table) removed."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), score_text(text).alias("text"))
    rows = table_tokenizer(tokenize)(texts.asTable())  # where the texts are: no shuffle
    return rows if stopwords is None else remove_stopwords_rows(rows, stopwords)
