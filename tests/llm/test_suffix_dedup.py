import hashlib
import random

import numpy as np
from tests_llm_shared import frame, sentence

from echotrace.llm import suffix_dedup as S


def brute(rows):
    """rows of (doc_id, text) in document order -> (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p] += 1
                gone[p + 100 if p + 100 < len(b) else len(b)] -= 1
            seen.add(b[p:p + 100])
        covered = np.cumsum(gone)[:len(b)] > 0
        rest = bytes(x for x, c in zip(b, covered) if not c)
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(b), int(covered.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = {(r[0], r[1]): w for r, w in zip(order, brute(order))}
    got = S.remove_repeats(frame(spark, [(i, t, "s") for i, t in rows])).drop("kept_text").collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    for (i, _), w in want.items():
        assert w in by_id[i], i


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    passage, other = sentence(rng, 40), sentence(rng, 30)
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "ab" * 300), (5, "z" * 1000), (6, passage + " end"), (7, "start " + passage),
            (8, passage[10:] + other), (9, other + passage + other), (10, "\x00" * 400 + "é" * 200), (11, "é" * 120 + passage),
            (None, passage), (12, sentence(rng, 3000) + passage + sentence(rng, 500))]
    rows += [(20 + i, sentence(rng, 20) + passage + sentence(rng, 15)) for i in range(30)]
    check(spark, rows)
    # the same with every key dealt again by single starts, and stretches cut short
    monkeypatch.setattr(S, "HOT_CHUNKS", 1)
    check(spark, rows)


def test_long_text_in_stretches_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(2)
    long_text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    long_text += long_text[1000:3000]
    digests = []
    for stretch in (1 << 20, 1000):
        found = []
        texts = S.pa.array([long_text])
        monkeypatch.setattr(S, "STRETCH", stretch)
        for data, ends, begins, shift, _, _ in S._stretches(texts, np.array([1]), np.array([0])):
            h, start, count, anchor = S.contexts(data, ends)
            for a, s, c in zip(h, start, count):
                found += [(int(a), int(shift[0] + s + k)) for k in range(c)]
        digests.append(sorted(found))
    assert digests[0] == digests[1]  # every start has the same anchor, wherever the text is cut
    monkeypatch.undo()
    rows = [(1, long_text), (1, long_text), (2, long_text[500:2000])]
    got = S.remove_repeats(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    first = [r for r in got if r.doc_id == 1]
    assert first[0].n_removed == first[1].n_removed == brute([rows[0]])[0][1]
    assert [r.n_removed for r in got if r.doc_id == 2] == [1500]
    assert S.remove_repeats(frame(spark, [])).count() == 0


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(0)
    for letters in (2, 4, 200):
        body = rng.integers(1, letters + 1, 600).astype(np.uint8)
        text = np.concatenate([body, np.zeros(S.LENGTH + 8, np.uint8)])
        wanted = np.zeros(len(text), bool)
        wanted[rng.choice(500, 300, replace=False)] = True
        order = S.suffix_order(text, wanted)
        raw = text.tobytes()
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [raw[i:i + S.LENGTH] for i in order]
        assert keys == sorted(keys)
        lcp = S.common_prefixes(text, order)
        for i in range(1, len(order)):
            a, b = keys[i - 1], keys[i]
            n = next((k for k in range(S.LENGTH) if a[k] != b[k]), S.LENGTH)
            assert lcp[i] == n


def test_thousands_of_texts_without_an_id(spark):
    rng = random.Random(6)
    passage = sentence(rng, 40)
    texts = [f"{i} " + sentence(rng, 1 + i % 90) + ("" if i % 500 else chr(65 + i // 500) + passage) for i in range(3000)]
    rows = [(None, t) for t in texts] + [(4, t[::-1]) for t in texts[:1500] if passage not in t] + [(S.LAST_ID, passage), (None, texts[0])]
    got = S.remove_repeats(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == sorted((i or 0, len(t.encode())) for i, t in rows)
    # the passage stands first in the row with the last id: all others lose exactly its bytes
    want = sorted((i or 0, t.replace(passage, "") if i is None else t) for i, t in rows)
    assert sorted((r.doc_id or 0, bytes(r.kept_text).decode()) for r in got) == want
