"""Quality rules by line labelling with a linear-chain conditional random field.

Every line of a text gets one of two labels, content or boilerplate.  Feature
bins of the line (length, symbols, capitals, repetition, sentence ends, ...)
give state scores, neighbouring labels give transition scores, and Viterbi
decoding finds the best label sequence of the text.  The share of words on
content lines decides whether the text stays.

The model is fitted on a bounded sample: ``sample_docs`` labelled documents of
each class, chosen by hash order, and of each at most ``sample_lines``
consecutive lines.  The lines of a good document count as content, those of a
poor one as boilerplate.  Only their feature bins reach the driver.  Decoding
covers every line of every text and needs no shuffle at all.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows get equal verdicts; an empty table gives an empty result; without
labelled documents of both classes every line is content, so the base rules
alone decide; labels that are null or not 0/1 are ignored, and a document with
several labels is poor if one of them says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import codes, counted, line_bounds, plain_strings, raw_bytes, slices, word_lists

#: Upper bounds of the feature bins; a value falls into the first bin whose bound it does not exceed.
BINS = {
    "words": (0, 1, 4, 9, 19, 49, 99),
    "symbols": (0.0, 0.005, 0.02, 0.05, 0.1),
    "capitals": (0.05, 0.15, 0.3, 0.6),
    "exclaims": (0.0, 0.1, 0.5),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "doubled": (0.0, 0.05, 0.2),
    "sentence_ends": (0.0, 0.02, 0.1, 0.3),
    "digits": (0.0, 0.05, 0.2),
    "pipes": (0.0, 0.1, 0.3),
    "seen_before": (0.5,),
}
WIDTHS = [len(b) + 1 for b in BINS.values()]
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
N_FEATURES = int(sum(WIDTHS))

VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, n_lines long, n_content_lines long, content_share double")


@dataclass(frozen=True)
class CrfModel:
    """State weights per feature bin (bins x 2), transition weights (2 x 2); label 1 is content."""

    state: np.ndarray
    transition: np.ndarray

    @staticmethod
    def neutral() -> CrfModel:
        state = np.zeros((N_FEATURES, 2))
        state[:, 1] = 1.0
        return CrfModel(state, np.zeros((2, 2)))


def _class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(members)] = 1
    return table


SPACE = _class_table(b" \t\n\x0b\x0c\r")
SYMBOL = _class_table(b"#*$%&|<>")
UPPER = _class_table(bytes(range(65, 91)))
LETTER = _class_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100)))
DIGIT = _class_table(bytes(range(48, 58)))
ENDS = _class_table(b".?!")


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(counts per text, feature bins per line, lines per text, words per line) of a string array without nulls."""
    data, offsets = raw_bytes(texts)
    starts, ends, lines_of = line_bounds(data, offsets)
    n_texts, n_lines = len(texts), len(starts)
    text_of_line = np.repeat(np.arange(n_texts), lines_of)
    total = lambda table: counted(table[data], starts, ends)

    words, words_of = word_lists(texts)
    word, vocabulary = codes(words)
    n_words = len(word)
    size = max(1, len(vocabulary))
    dark = SPACE[data] == 0
    begins = dark.copy()
    begins[1:] &= ~dark[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = dark[offsets[:-1][offsets[:-1] < len(data)]]
    line_words = counted(begins, starts, ends)
    line_of_word = np.repeat(np.arange(n_lines), line_words)
    text_of_word = np.repeat(np.arange(n_texts), words_of)

    # words in 3-word windows that occur twice or more in the text
    repeated = np.zeros(n_words, bool)
    if n_words >= 3:
        same = text_of_word[:-2] == text_of_word[2:]
        at = np.flatnonzero(same)
        pair, pairs = codes(word[at] * size + word[at + 1])
        triple, triples = codes(pair * size + word[at + 2])
        window, _ = codes(triple * n_texts + text_of_word[at])
        hit = at[np.bincount(window)[window] >= 2] if len(window) else at
        for k in range(3):
            repeated[hit + k] = True

    # lines with a word that equal an earlier line of the text
    split = pc.split_pattern(texts, "\n")
    line, _ = codes(split.flatten())
    line_in_text, _ = codes(line * n_texts + text_of_line)
    highest = np.maximum.accumulate(np.concatenate([[-1], line_in_text]))[:-1] if n_lines else line_in_text
    seen = line_in_text <= highest
    dup = seen & (line_words > 0)

    letters, chars = np.maximum(total(LETTER), 1), np.maximum(ends - starts, 1)
    per_word = np.maximum(line_words, 1)
    distinct, first = codes(line_of_word * size + word)
    distinct_words = np.bincount((first.to_numpy() // size) if len(first) else np.zeros(0, np.int64), minlength=n_lines)
    doubled = np.zeros(n_lines, np.int64)
    if n_words >= 2:
        twice = (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        doubled = np.bincount(line_of_word[1:][twice], minlength=n_lines)
    symbols = total(SYMBOL)
    values = {
        "words": line_words,
        "symbols": symbols / chars,
        "capitals": total(UPPER) / letters,
        "exclaims": total(_class_table(b"!")) / per_word,
        "distinct": np.where(line_words >= 5, distinct_words / per_word, 1.0),
        "doubled": doubled / per_word,
        "sentence_ends": total(ENDS) / per_word,
        "digits": total(DIGIT) / chars,
        "pipes": total(_class_table(b"|")) / per_word,
        "seen_before": seen.astype(float),
    }
    bins = np.stack([np.searchsorted(BINS[k], v, side="left") for k, v in values.items()], axis=1).astype(np.int64)

    per_text = lambda x: np.bincount(text_of_line, weights=x, minlength=n_texts).astype(np.int64)
    # continuation bytes of UTF-8 are no code points
    counts = {
        "n_words": words_of.astype(np.int64),
        "word_chars": counted(dark & ((data & 0xC0) != 0x80), offsets[:-1], offsets[1:]),
        "n_symbols": per_text(symbols),
        "n_dup_lines": per_text(dup),
        "n_repeat_words": np.bincount(text_of_word[repeated], minlength=n_texts).astype(np.int64),
    }
    return counts, bins + OFFSETS, lines_of, line_words


def viterbi(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best label sequence of one text; ties prefer content."""
    (t00, t01), (t10, t11) = transition.tolist()
    a, b = 0.0, 0.0
    back = []
    for i, (s0, s1) in enumerate(scores.tolist()):
        if i:
            from0 = a + t00 > b + t10, a + t01 > b + t11
            a, b = (a + t00 if from0[0] else b + t10), (a + t01 if from0[1] else b + t11)
            back.append(from0)
        a, b = a + s0, b + s1
    label = 0 if a > b else 1
    path = [label]
    for from0 in reversed(back):
        label = 0 if from0[label] else 1
        path.append(label)
    return np.array(path[::-1], np.int64)


def _judge_slice(texts: pa.Array, model: CrfModel, min_words: int, max_repeat: int, min_share: float) -> dict[str, np.ndarray]:
    counts, features, lines_of, line_words = measure(texts)
    scores = model.state[features].sum(axis=1) if len(features) else np.zeros((0, 2))
    last = np.cumsum(lines_of)
    content_lines, content_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, (lo, hi) in enumerate(zip((last - lines_of).tolist(), last.tolist())):
        labels = viterbi(scores[lo:hi], model.transition)
        content_lines[i] = labels.sum()
        content_words[i] = (labels * line_words[lo:hi]).sum()
    n = counts["n_words"]
    failed = (n < min_words) | (100 * counts["n_repeat_words"] > max_repeat * n)
    share = content_words / np.maximum(n, 1)
    return counts | {"base_failed": failed, "kept": ~failed & (share >= min_share), "n_lines": lines_of,
                     "n_content_lines": content_lines, "content_share": share}


def verdicts(docs: DataFrame, model: CrfModel, text: str = "text", min_words: int = 50, max_repeat: int = 50,
             min_share: float = 0.5) -> DataFrame:
    """The columns of ``docs`` (names of verdict columns excluded) and the verdict on ``text``."""
    ours = [f.split()[0] for f in VERDICT.split(", ")]
    carried = [c for c in docs.columns if c not in ours or c == text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema) + ", " + VERDICT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = _judge_slice(plain_strings(part.column(text)), model, min_words, max_repeat, min_share)
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(found[c]) for c in ours], carried + ours)

    return docs.select(*carried).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, model: CrfModel, text: str = "text", min_words: int = 50, max_repeat: int = 50,
                   min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged) that the verdict keeps."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = _judge_slice(plain_strings(part.column(text)), model, min_words, max_repeat, min_share)
                yield pa.RecordBatch.from_arrays(part.columns, names).filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = 600, sample_lines: int = 60,
                    ) -> list[tuple[int, np.ndarray]]:
    """(label, feature bins of consecutive lines) of a bounded sample of labelled documents.

    ``labels``: doc_id, quality.  The sample is ``sample_docs`` ids of each class
    in the order of their hash, a list of at most ``2 * sample_docs`` longs.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
                   .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    chosen = None
    for k in (0, 1):
        part = (known.where(F.col("quality") == k).join(docs.select("doc_id"), "doc_id", "left_semi")
                     .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    if not picked:
        return []
    some = docs.where(F.col("doc_id").isin(list(picked))).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, features, lines_of, _ = measure(plain_strings(part.column("text")))
                last, out = np.cumsum(lines_of), []
                for doc_id, lo, hi in zip(part.column("doc_id").to_pylist(), (last - lines_of).tolist(), last.tolist()):
                    shift = (doc_id * 2654435761) % max(1, hi - lo - sample_lines + 1)
                    out.append(features[lo + shift:min(hi, lo + shift + sample_lines)].astype(np.int16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bins"])

    rows = some.mapInArrow(run, "doc_id long, bins binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [(picked[r["doc_id"]], np.frombuffer(r["bins"], np.int16).reshape(-1, len(WIDTHS)).astype(np.int64)) for r in rows]


def fit(sample: list[tuple[int, np.ndarray]], rounds: int = 150, l2: float = 1.0, rate: float = 0.1) -> CrfModel:
    """Penalised maximum likelihood by gradient steps; sequences of one length band run together."""
    if {label for label, _ in sample} != {0, 1}:
        return CrfModel.neutral()
    share = {k: sum(1 for label, _ in sample if label == k) for k in (0, 1)}
    longest = max(len(x) for _, x in sample)
    n, width = len(sample), len(WIDTHS)
    feats = np.full((n, longest, width), -1, np.int64)
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), np.int64)
    weight = np.zeros(n)
    for i, (label, x) in enumerate(sample):
        feats[i, :len(x)], mask[i, :len(x)], gold[i, :len(x)] = x, True, label
        weight[i] = 0.5 * n / share[label] / len(x)
    state, trans = np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2))
    m, v = [np.zeros_like(state), np.zeros_like(trans)], [np.zeros_like(state), np.zeros_like(trans)]
    steps = [np.flatnonzero(mask[:, t]) for t in range(longest)]
    flat = feats[mask]
    seen_state = np.zeros_like(state)
    token_weight = (weight[:, None] * mask)[mask]
    for k in range(width):
        np.add.at(seen_state, (flat[:, k], gold[mask]), token_weight)
    for step in range(1, rounds + 1):
        scores = np.where(mask[:, :, None], state[feats].sum(axis=2), 0.0)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = scores[:, 0]
        for t in range(1, longest):
            r = steps[t]
            alpha[r, t] = scores[r, t] + np.logaddexp(alpha[r, t - 1, 0, None] + trans[0], alpha[r, t - 1, 1, None] + trans[1])
        expected = np.zeros_like(trans)
        observed = np.zeros_like(trans)
        for t in range(longest - 1, 0, -1):
            r = steps[t]
            ahead = scores[r, t] + beta[r, t]
            beta[r, t - 1] = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
            joint = alpha[r, t - 1][:, :, None] + trans + ahead[:, None, :]
            joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(r), 4), axis=1)[:, None, None])
            expected += (joint * weight[r, None, None]).sum(axis=0)
            np.add.at(observed, (gold[r, t - 1], gold[r, t]), weight[r])
        post = alpha + beta
        post = np.exp(post - np.logaddexp(post[..., 0], post[..., 1])[..., None])[mask] * token_weight[:, None]
        grad_state = seen_state.copy()
        for k in range(width):
            np.add.at(grad_state, flat[:, k], -post)
        grads = [(grad_state - l2 * state * n / 1000) / n, (observed - expected - l2 * trans * n / 1000) / n]
        for j, (p, g) in enumerate(zip((state, trans), grads)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            p += rate * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
    return CrfModel(state[:N_FEATURES].copy(), trans)


def train(docs: DataFrame, labels: DataFrame, **bounds) -> CrfModel:
    return fit(training_sample(docs, labels, **bounds))
