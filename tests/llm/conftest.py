import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_shared import sentence  # noqa: E402


@pytest.fixture
def edge_rows():
    """nulls, empty and white-space texts, ties, repeated rows, a very long text."""
    import random

    rng = random.Random(5)
    a, b = sentence(rng, 80), sentence(rng, 70)
    long_text = "\n".join(sentence(rng, 12) for _ in range(3000))
    return [(1, a, "s1"), (2, a, "s2"), (3, a + " tail", "s1"), (3, a + " tail", "s1"), (4, None, "s1"), (5, "", None), (6, " \t\n\x0b", "s2"),
            (7, b, None), (None, b, "s3"), (None, None, None), (8, "one", "s1"), (9, "one two", "s1"), (10, "x" * 5000, "s2"),
            (11, long_text, "s2"), (12, long_text[:4000], "s3"), (13, "a b c d " * 60, "s1"), (14, "# * $ % & | < >\n" * 30, "s1"),
            (15, "ÉTÉ 😀 " * 40, "s4"), (-3, b.upper(), "s4")]
