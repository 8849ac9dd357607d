"""Helpers of the corpus operator tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A column named like outputs of most operators.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, target string, found int, blob string"


def sentence(rng, n):
    syllables = ["ka", "lo", "mi", "ter", "un", "ves", "or", "das", "pe", "ru", "é", "ß"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """documents with clashing extra columns from (doc_id, text, source) rows."""
    data = [(i, t, "xx", s, None if t is None else len(t), i is None, "extra", 7, "b") for i, t, s in rows]
    return spark.createDataFrame(data, DOCS)
