"""Exact removal of repeated passages with a two-stage suffix array.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start).

Every such string has an anchor: of the 32-byte grams inside it the one with the
least hash (the rightmost of equals).  The anchor depends on the string alone, so
equal strings have equal anchors at equal offsets, and each anchor owns a
contiguous run of starts, its *context*.  That deals the suffixes out:

1. One pass over the texts gives the contexts as digests.  Equal contexts inside a
   slice of texts are pre-aggregated; a shuffle by anchor drops contexts whose
   anchor has no other context and decides repeats of equal contexts.
2. Contexts whose anchor has different surroundings are cut into chunks of up to
   16 starts, keyed by the bytes all starts of the chunk share.  Digests tell which
   keys have different chunks; only those chunks are cut from the texts and dealt
   by key.  Where very many chunks share a key, their single starts are dealt.
3. Each task sorts the suffixes of its chunks in two stages.  Only suffixes
   smaller than their successors are sorted directly (by 8-byte words, to the
   depth that matters).  The rest is induced by scanning the buckets in order:
   a larger suffix goes to the next free place of its bucket when its successor
   is met.  Adjacent common prefixes give the classes of equal strings, and of a
   class only the earliest start is kept.
4. The starts that were not kept cover the bytes to remove.

Defined results: a null text is empty; texts below ``LENGTH`` bytes stay whole;
rows with the same id and text are one document and get equal results, rows with
the same id and another text come in the order of a text digest; a null id comes
last; an empty table gives an empty result.  Whole texts are read; a very long
one is scanned in overlapping stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import plain_strings, raw_bytes, slices
from echotrace.llm.common import cut

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # the anchor lies at most so far behind the start
CHUNK = 16
CORE = LENGTH - CHUNK + 1
STRETCH = 3 << 20
#: Different chunks of one key that one task sorts together.
HOT_CHUNKS = 5_000
#: Bytes of chunks in one suffix array; its working memory is about a hundred times as much.
BUILD_BYTES = 1 << 19
LAST_ID = (1 << 63) - 1
REMOVED, CANDIDATE, KEPT = 0, 1, 2
#: A document is (doc, tie): id, and a long that tells rows of one id with different texts apart.
#: A place is one long: start (31 bits), nothing (14), kind (2), detail (16).
#: Detail of a context: shared (1), distance to its anchor (7), starts (7); of kept starts: their bits.
SHARED = 1 << 15

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D


def pack(start, kind, detail):
    return (start << 32) | (kind << 16) | detail


def start_of(place):
    return place >> 32


def kind_of(place):
    return (place >> 16) & 3


def with_kind(place, kind):
    return (place & ~(3 << 16)) | (kind << 16)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at every place that has them."""
    h, width, factor = BYTE[data], 1, BASE
    while width < GRAM:
        h = h[:-width] * _U(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return _mix(h)


def contexts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, starts, anchor place) of all contexts in concatenated texts; ``ends`` of the texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    bits = _U(max(1, int(len(data)).bit_length()))
    low = (_U(1) << bits) - _U(1)
    key = ((h >> bits) << bits) | (low - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= REACH + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    anchor = (low - (key & low)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for k in ends.tolist():  # a string never crosses the end of its text
        valid[max(0, k - LENGTH + 1):k] = False
    start = np.flatnonzero(valid)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    anchor = anchor[start]
    change = np.flatnonzero(np.diff(anchor) != 0) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.concatenate([first, [len(start)]]))
    return h[anchor[first]], start[first], count, anchor[first]


def span_digests(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit digests of the bytes [start, stop) for each (starts, stops)."""
    n = len(data)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * power, out=run[1:])
    # bring the sum to the place 0 by the inverse power
    back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return [_mix(((run[stop] - run[start]) * back[np.minimum(start, n - 1)]) ^ _mix((stop - start).astype(np.uint64)))
            for start, stop in spans]


def _different(*columns: np.ndarray) -> np.ndarray:
    """Flags of sorted rows that differ from the row before (rows listed twice are one document)."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): the id (null: the last), and what tells rows of one id apart: 63 bits of a
    text digest, below zero for ids and from zero on for nulls (which come behind the last id)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.xxhash64(text).bitwiseAND(F.lit(LAST_ID))
    tie = F.when(F.col("doc_id").isNull(), digest).otherwise(-1 - digest)
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), tie.alias("tie"), text.alias("text"))


def _stretches(texts: pa.Array, docs: np.ndarray, ties: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, ends, document and start of each piece): short texts together, long ones in overlapping stretches."""
    data, offsets = raw_bytes(texts)
    if len(texts) > 1 or len(data) <= 2 * STRETCH:
        yield data, offsets[1:], offsets[:-1], np.zeros(len(texts), np.int64), docs, ties
        return
    for lo in range(0, len(data) - LENGTH + 1, STRETCH):
        piece = data[lo:lo + STRETCH + LENGTH - 1]
        yield piece, np.array([len(piece)]), np.array([0]), np.array([lo]), docs, ties


def _digested(docs: DataFrame) -> DataFrame:
    """(key, digest, doc, tie, place): contexts, pre-aggregated inside slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                all_docs = part.column("doc").to_numpy()
                all_ties = part.column("tie").to_numpy()
                for data, ends, begins, shift, docs_, ties in _stretches(plain_strings(part.column("text")), all_docs, all_ties):
                    h, start, count, anchor = contexts(data, ends)
                    if not len(h):
                        continue
                    digest, = span_digests(data, (start, start + count + LENGTH - 1))
                    of = np.searchsorted(ends, start, side="right")
                    doc, tie = docs_[of], ties[of]
                    place = pack(start - begins[of] + shift[of], CANDIDATE, (anchor - start) << 7 | count)
                    order = np.lexsort((start_of(place), tie, doc, digest, h))
                    order = order[_different(h[order], digest[order], doc[order], tie[order], place[order])]
                    h, digest, doc, tie, place = (x[order] for x in (h, digest, doc, tie, place))
                    new_h = np.concatenate([[True], h[1:] != h[:-1]])
                    new_c = new_h | np.concatenate([[True], digest[1:] != digest[:-1]])
                    group = np.cumsum(new_h) - 1
                    several = np.bincount(group, weights=new_c)[group] > 1
                    # one row of each anchor goes to the anchor's key; what is decided already is spread by digest
                    key = np.where(new_h, h, _mix(digest ^ place.astype(np.uint64) ^ tie.astype(np.uint64)))
                    place = np.where(new_c, place | np.where(several, SHARED, 0), with_kind(place, REMOVED))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.astype(np.int64)), pa.array(digest.astype(np.int64)), pa.array(doc), pa.array(tie), pa.array(place)],
                        ["key", "digest", "doc", "tie", "place"])

    return docs.mapInArrow(run, "key long, digest long, doc long, tie long, place long")


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows that end where the sorted ``key`` changes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut_at = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut_at:
                yield table.slice(0, cut_at)
                held = table.slice(cut_at).to_batches()
                count = table.num_rows - cut_at
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _decided(digested: DataFrame) -> DataFrame:
    """(doc, tie, place): removed contexts and those that need their bytes compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, "key", 200_000):
            key, digest, doc, tie, place = (table.column(c).to_numpy() for c in ("key", "digest", "doc", "tie", "place"))
            order = np.lexsort((start_of(place), tie, doc, digest, kind_of(place) == REMOVED, key))
            key, digest, doc, tie, place = (x[order] for x in (key, digest, doc, tie, place))
            live = kind_of(place) == CANDIDATE
            new = _different(key, live, digest, doc, tie, place & ~SHARED)
            key, digest, doc, tie, place, live = (x[new] for x in (key, digest, doc, tie, place, live))
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new_c = new_key | np.concatenate([[True], digest[1:] != digest[:-1]])
            group = np.cumsum(new_key) - 1
            several = np.bincount(group, weights=(new_c & live) + 1 * (live & (place & SHARED != 0)))[group] > 1
            later = live & ~new_c
            place = np.where(later, with_kind(place, REMOVED), place)
            keep = ~live | later | several
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, tie, place & ~SHARED)], ["doc", "tie", "place"])

    return digested.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, tie long, place long")


def _per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("doc").alias("p_doc"), F.col("tie").alias("p_tie")).agg(F.collect_list("place").alias("places"))


def _same_document():
    return (F.col("doc") == F.col("p_doc")) & (F.col("tie") == F.col("p_tie"))


def _chunk_digests(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(ck, cd, doc, tie, at, detail): candidate contexts in chunks of up to 16 starts.

    ck and cd are digests of the bytes all starts share and of the whole chunk, at = first start,
    detail = (place of the shared bytes behind the first start, starts)."""
    joined = docs.join(places, _same_document()).select("doc", "tie", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                data, offsets, place, of = _placed(part)
                start, ahead, count = start_of(place), (place >> 7) & 0x7F, place & 0x7F
                # starts at distances ahead, ahead - 1, ... from the anchor; chunk by distance // CHUNK
                first, last = ahead // CHUNK, (ahead - count + 1) // CHUNK
                n = first - last + 1
                row = np.repeat(np.arange(len(place)), n)
                nr = first[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                anchor = (start + ahead)[row]
                lo = np.maximum(start[row], anchor - (nr * CHUNK + CHUNK - 1))
                hi = np.minimum(start[row] + count[row] - 1, anchor - nr * CHUNK)
                core, shift = anchor - nr * CHUNK, offsets[:-1][of[row]]
                ck, cd = span_digests(data, (shift + core, shift + core + CORE), (shift + lo, shift + hi + LENGTH))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ck.astype(np.int64)), pa.array(cd.astype(np.int64)), pa.array(part.column("doc").to_numpy()[of[row]]),
                     pa.array(part.column("tie").to_numpy()[of[row]]), pa.array(lo), pa.array((core - lo) << 5 | (hi - lo + 1))],
                    ["ck", "cd", "doc", "tie", "at", "detail"])

    return joined.mapInArrow(run, "ck long, cd long, doc long, tie long, at long, detail long")


def _placed(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(bytes, offsets, places, text of each place) of rows with text and places."""
    data, offsets = raw_bytes(plain_strings(part.column("text")))
    lists = part.column("places")
    of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    return data, offsets, lists.flatten().to_numpy(), of


def _judged(digests: DataFrame) -> DataFrame:
    """(doc, tie, place) of the first occurrence of every chunk.

    A chunk that shares its bytes with no other is kept; others are to be sorted together
    (CANDIDATE), or by single starts where very many share the bytes (REMOVED)."""
    distinct = digests.groupBy("ck", "cd").agg(F.min(F.struct("doc", "tie", "at", "detail")).alias("first"))
    alike = distinct.groupBy("ck").agg(F.count(F.lit(1)).alias("alike"))
    kind = F.when(F.col("alike") == 1, KEPT).when(F.col("alike") <= HOT_CHUNKS, CANDIDATE).otherwise(REMOVED).cast("long")
    starts = F.col("first.detail").bitwiseAND(31).cast("int")
    bits = F.element_at(F.array(*[F.lit((1 << n) - 1).cast("long") for n in range(1, CHUNK + 1)]), starts)
    detail = F.when(F.col("alike") == 1, bits).otherwise(F.col("first.detail"))
    place = F.shiftleft("first.at", 32).bitwiseOR(F.shiftleft(kind, 16)).bitwiseOR(detail)
    return distinct.join(alike, "ck").select("first.doc", "first.tie", place.alias("place"))


def _chunks(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(ck, chunk, doc, tie, at): the bytes of the chunks to be sorted, or of their single starts."""
    joined = docs.join(places, _same_document()).select("doc", "tie", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                data, offsets, place, of = _placed(part)
                together = kind_of(place) == CANDIDATE
                detail = place & 0xFFFF
                n = np.where(together, 1, detail & 31)
                row = np.repeat(np.arange(len(place)), n)
                lo = start_of(place)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hi = np.where(together[row], lo + (detail[row] & 31) - 1, lo)
                shift = offsets[:-1][of[row]]
                core = np.where(together[row], lo + (detail[row] >> 5), lo)
                ck, = span_digests(data, (shift + core, shift + core + np.where(together[row], CORE, LENGTH)))
                raw = data.tobytes()
                pieces = [raw[a:b] for a, b in zip((shift + lo).tolist(), (shift + hi + LENGTH).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ck.astype(np.int64)), pa.array(pieces, pa.binary()), pa.array(part.column("doc").to_numpy()[of[row]]),
                     pa.array(part.column("tie").to_numpy()[of[row]]), pa.array(lo)], ["ck", "chunk", "doc", "tie", "at"])

    return joined.mapInArrow(run, "ck long, chunk binary, doc long, tie long, at long")


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places where ``wanted`` holds, in the order of their suffixes to a depth of LENGTH bytes.

    ``text`` ends in LENGTH + 8 zero bytes, and so does each string in it.
    """
    n = len(text)
    smaller = np.ones(n, bool)  # smaller than its successor
    rising = text[:-1] < text[1:]
    equal = text[:-1] == text[1:]
    # an equal pair takes the kind of its successor: look up the end of the run
    run_end = np.arange(n)
    stops = np.flatnonzero(~equal)
    run_end[:-1] = stops[np.minimum(np.searchsorted(stops, np.arange(n - 1)), len(stops) - 1)] if len(stops) else n - 1
    smaller[:-1] = rising[np.minimum(run_end[:-1], n - 2)]
    places = np.flatnonzero(smaller)
    # a larger suffix needs its successors up to the next smaller one
    upto = places[np.minimum(np.searchsorted(places, np.arange(n)), len(places) - 1)]
    depth = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(depth, at, 1)
    np.add.at(depth, upto[at] + 1, -1)
    needed = np.cumsum(depth)[:n] > 0

    direct = np.flatnonzero(needed & smaller)
    direct = direct[_direct_sort(text, direct)]
    first = text[direct]
    waiting: dict[int, list[np.ndarray]] = {}
    bounds = np.searchsorted(first, np.arange(257))
    out = []

    def induce(found: np.ndarray, bucket: int) -> np.ndarray:
        """Places before ``found`` that are larger suffixes: into their buckets, in order."""
        before = found[found > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        if not len(before):
            return before
        letter = text[before]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        for part in np.split(before, np.flatnonzero(np.diff(letter)) + 1):
            if text[part[0]] != bucket:
                waiting.setdefault(int(text[part[0]]), []).append(part)
        return before[letter == bucket]

    for bucket in range(256):
        level = np.concatenate(waiting.pop(bucket)) if bucket in waiting else np.zeros(0, np.int64)
        while len(level):
            out.append(level)
            level = induce(level, bucket)
        sorted_here = direct[bounds[bucket]:bounds[bucket + 1]]
        if len(sorted_here):
            out.append(sorted_here)
            induce(sorted_here, bucket)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def _word(text: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Eight bytes behind ``at``, as a number that sorts like the bytes."""
    view = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[np.minimum(at + 8 * w, len(text) - 8)]).view(">u8").reshape(-1).astype(np.uint64)


def _direct_sort(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``at`` by their first LENGTH + 4 bytes; words are read only while there are ties."""
    n = len(at)
    order = np.argsort(_word(text, at, 0), kind="stable")
    word = _word(text, at[order], 0)
    rank = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) if n else np.zeros(0, np.int64)
    for w in range(1, -(-LENGTH // 8)):
        tied = np.zeros(n, bool)
        same = rank[1:] == rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            break
        where = np.flatnonzero(tied)
        word = _word(text, at[order[where]], w)
        sub = np.lexsort((word, rank[where]))
        order[where] = order[where][sub]
        word, old = word[sub], rank[where]
        step = np.zeros(n, np.int64)
        inner = np.concatenate([[False], (old[1:] == old[:-1]) & (word[1:] != word[:-1])])
        step[where[inner]] = 1
        step[1:] += rank[1:] != rank[:-1]
        rank = np.cumsum(step)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, at most LENGTH bytes."""
    lcp = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for w in range(-(-LENGTH // 8)):
        if not len(active):
            break
        a, b = _word(text, order[active - 1], w), _word(text, order[active], w)
        same = a == b
        differ = active[~same]
        high = (a ^ b)[~same].astype(">u8").view(np.uint8).reshape(-1, 8)
        lcp[differ] = 8 * w + np.argmax(high != 0, axis=1)
        active = active[same]
    lcp[active] = LENGTH
    return np.minimum(lcp, LENGTH)


def _kept_starts(chunk: pa.Array, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each chunk the bits of its starts that are the earliest of their class."""
    offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
    size = np.diff(offsets)
    raw = np.frombuffer(chunk.buffers()[2], np.uint8)
    width = CHUNK - 1 + LENGTH + LENGTH + 8
    text = np.zeros((len(chunk), width), np.uint8)
    text[np.arange(width)[None, :] < size[:, None]] = raw[offsets[0]:offsets[-1]]
    text = text.reshape(-1)
    starts = np.arange(width)[None, :] <= (size - LENGTH)[:, None]
    order = suffix_order(text, starts.reshape(-1))
    group = np.cumsum(common_prefixes(text, order) < LENGTH)
    row, col = np.divmod(order, width)
    earliest = np.lexsort((at[row] + col, tie[row], doc[row], group))
    lead = np.concatenate([[True], group[earliest][1:] != group[earliest][:-1]])
    kept = earliest[lead]
    bits = np.zeros(len(chunk), np.int64)
    np.bitwise_or.at(bits, row[kept], 1 << col[kept])
    return bits


def _sorted_chunks(chunks: DataFrame) -> DataFrame:
    """(doc, tie, place) of the kept starts of the chunks, by the suffix array of all chunks of a key."""
    work = (chunks.groupBy("ck", "chunk").agg(F.min(F.struct("doc", "tie", "at")).alias("first"))
                  .select("ck", "chunk", "first.doc", "first.tie", "first.at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, "ck", BUILD_BYTES // LENGTH):
            doc, tie, at = (table.column(c).to_numpy() for c in ("doc", "tie", "at"))
            chunk = pa.concat_arrays(table.column("chunk").chunks)
            bits = _kept_starts(chunk, doc, tie, at)
            place = pack(at, KEPT, bits)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(place)], ["doc", "tie", "place"])

    return work.repartition("ck").sortWithinPartitions("ck").mapInArrow(run, "doc long, tie long, place long")


def removed_starts(n_bytes: int, places: np.ndarray) -> np.ndarray:
    """Flags of the starts whose string occurs earlier."""
    gone = np.zeros(n_bytes + 1, np.int64)
    kind, start, detail = kind_of(places), start_of(places), places & 0xFFFF
    runs = kind != KEPT
    np.add.at(gone, start[runs], 1)
    np.add.at(gone, start[runs] + (detail[runs] & 0x7F), -1)
    gone = np.cumsum(gone)[:n_bytes] > 0
    for i in range(CHUNK):
        bit = (kind == KEPT) & (detail >> i & 1 == 1)
        gone[start[bit] + i] = False
    return gone


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    ``kept_text`` holds the remaining bytes; a cut inside a character leaves them undecoded.
    """
    keyed = _keyed(docs)
    places = cut(_decided(_digested(keyed)))
    kind = F.shiftright("place", 16).bitwiseAND(3)
    judged = _judged(_chunk_digests(keyed, _per_document(places.where(kind == CANDIDATE))))
    kept = _sorted_chunks(_chunks(keyed, _per_document(judged.where(kind != KEPT))))
    found = _per_document(places.unionByName(judged.where(kind == KEPT)).unionByName(kept))
    # the texts are dealt by (doc, tie) once: here and for the chunks it is the same exchange,
    # and the digests of the chunks are one exchange too, so nothing is materialised in between
    joined = keyed.join(found, _same_document(), "left").select("doc", "tie", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STRETCH):
                data, offsets = raw_bytes(plain_strings(part.column("text")))
                rows: list[tuple] = []
                for lo, hi, places in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("places")):
                    text, n_removed, n_spans = data[lo:hi], 0, 0
                    if places.is_valid and len(places):
                        gone = removed_starts(hi - lo, places.values.to_numpy())
                        run_sum = np.concatenate([[0], np.cumsum(gone)])
                        at = np.arange(1, hi - lo + 1)
                        covered = run_sum[at] > run_sum[np.maximum(at - LENGTH, 0)]
                        n_removed = int(covered.sum())
                        n_spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                        text = text[~covered]
                    rest = text.tobytes()
                    rows.append((hi - lo, n_removed, n_spans, hashlib.sha256(rest).hexdigest(), rest))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                doc_id = pa.array(part.column("doc").to_numpy(), mask=part.column("tie").to_numpy() >= 0)
                yield pa.RecordBatch.from_arrays(
                    [doc_id] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
