"""Token ids of whole texts with a public tokenizer, part by part inside Arrow tasks.

For a tokenizer whose pre-tokens never span white space (checked by
``tests/llm``) the ids of a text are those of its white-space pieces in order.
A piece of Latin letters followed by ASCII punctuation is two parts, which the
pre-tokenizer separates anyway; any other piece is one.  The bytes of a slice of
texts are cut into parts by NumPy, ASCII letters lower-cased (the tokenizer does so
itself; pieces that could hold a special token stay as they are), and the parts
dictionary-encoded.  Only distinct parts meet Python: a bounded memo knows the ids
of those met before, the others go to the library in one batch.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from echotrace.llm.arrow_text import codes, raw_bytes

#: Distinct parts kept per worker process; beyond it the memo starts anew (speed only).
MEMO_PARTS = 600_000

_SPACE, _LETTER, _MARK, _OTHER = range(4)
#: Class of each byte: white space, ASCII letter or first/second byte of a Latin-1 letter, ASCII punctuation, other.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
for _lo, _hi, _kind in ((65, 91, _LETTER), (97, 123, _LETTER), (33, 48, _MARK), (58, 65, _MARK), (91, 97, _MARK), (123, 127, _MARK)):
    _CLASS[_lo:_hi] = _kind
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Second bytes of the two signs among the Latin-1 letters (U+00D7, U+00F7).
_SIGNS = (0x97, 0xB7)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """ids of many texts; ``end_id`` is appended to each."""

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab()
        #: Whether an id ends a word, where the vocabulary says so.
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool) if suffix else None
        if suffix:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.size, self.first = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        """One encoder per worker process and vocabulary."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _library_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in order, ids per part) from the library.

        Words of letters alone go as one text, and the ids that end a word part them
        again, unless their number tells that some word was split."""
        if self.closes is not None:
            words = [i for i, p in enumerate(parts) if p.isalpha()]
            joined = " ".join([parts[i] for i in words])
            ids = np.array(self.library.encode(joined, add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.closes[ids]) + 1
            if len(stop) == len(words) and (not words or stop[-1] == len(ids)):
                rest = [i for i, p in enumerate(parts) if not p.isalpha()]
                others = [e.ids for e in self.library.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)]
                size = np.zeros(len(parts), np.int64)
                size[words] = np.diff(stop, prepend=0)
                size[rest] = [len(x) for x in others]
                is_word = np.zeros(len(parts), bool)
                is_word[words] = True
                flat, of_word = np.zeros(int(size.sum()), np.uint32), np.repeat(is_word, size)
                flat[of_word] = ids
                flat[~of_word] = [i for x in others for i in x]
                return flat, size
        found = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _known(self, parts: list[str]) -> np.ndarray:
        """Memo number of each distinct part; new ones are encoded."""
        get = self.memo.get
        found = np.array([get(p, -1) for p in parts], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.memo and len(self.memo) + len(new) > MEMO_PARTS:
                self._forget()
                return self._known(parts)
            fresh = [parts[i] for i in new.tolist()]
            found[new] = np.arange(len(self.memo), len(self.memo) + len(new))
            self.memo.update(zip(fresh, found[new].tolist()))
            ids, size = self._library_ids(fresh)
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
            self.first = np.cumsum(self.size) - self.size
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of all texts in order, ids per text) for a string array without nulls."""
        parts, parts_of = text_parts(texts)
        code, vocabulary = codes(parts)
        known = self._known(_strings(vocabulary))
        # the ids of this slice's parts side by side; the end id is one more part behind those of each text
        flat, size = self.flat[_spread(self.first[known], self.size[known])], np.append(self.size[known], 1).astype(np.int32)
        flat, first = np.append(flat, np.uint32(end_id)), (np.cumsum(size) - size).astype(np.int32)
        closing = np.cumsum(parts_of + 1) - 1
        sequence = np.full(len(code) + len(texts), len(known), np.int32)
        inner = np.ones(len(sequence), bool)
        inner[closing] = False
        sequence[inner] = code
        lengths = size[sequence]
        ends = np.cumsum(lengths)
        return flat[_spread(first[sequence], lengths, ends)], np.diff(ends[closing], prepend=0)


def _strings(parts: pa.Array) -> list[str]:
    """Python strings of an array of parts; no part holds white space."""
    if not len(parts):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


def _spread(first: np.ndarray, length: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Places first, first + 1, ... of ``length`` each, one after another."""
    ends = np.cumsum(length) if ends is None else ends
    place = np.repeat((first - (ends - length)).astype(np.int32), length)
    place += np.arange(len(place), dtype=np.int32)
    return place


def _running(flags: np.ndarray) -> np.ndarray:
    """Number of set flags before each place and behind the last."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def text_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts of all texts in order, parts per text): white-space pieces, cut between Latin letters and punctuation."""
    raw, offsets = raw_bytes(texts)
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != _SIGNS[0]) & (raw[lead + 1] != _SIGNS[1])]
    kind[lead] = kind[lead + 1] = _LETTER
    dark = kind != _SPACE
    edge = np.zeros(len(raw) + 1, bool)  # between two texts
    edge[offsets] = True
    begins = dark.copy()
    begins[1:] &= ~dark[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(raw))  # white space included
    # a piece is cut at its first mark if letters stand before it and only marks (and white space) behind
    letter = _running(kind == _LETTER)
    mark = np.flatnonzero(kind == _MARK)
    at = np.searchsorted(mark, start)
    cut = np.where(at < len(mark), mark[np.minimum(at, max(0, len(mark) - 1))], len(raw)) if len(mark) else np.full(len(start), len(raw))
    cut = np.minimum(cut, end)
    other = _running(kind == _OTHER)
    both = (cut > start) & (cut < end) & (letter[cut] - letter[start] == cut - start) & (letter[end] == letter[cut]) & (other[end] == other[cut])
    begins[cut[both]] = True
    low = _LOWER[raw]
    if len(raw) and bool(((raw[:-1] == 60) & (raw[1:] == 124)).any()):  # "<|" may begin a special token
        special = _running((raw == 60) & (np.append(raw[1:], 0) == 124))
        for i in np.flatnonzero(special[end] > special[start]).tolist():
            low[start[i]:end[i]] = raw[start[i]:end[i]]
    before = _running(dark)
    first = np.flatnonzero(begins)
    places = np.append(before[first], before[-1])
    parts = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(places), pa.py_buffer(low[dark])])
    return parts, np.diff(np.searchsorted(first, offsets))
