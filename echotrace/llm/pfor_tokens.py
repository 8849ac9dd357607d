"""Token files of patched frame-of-reference blocks.

A part holds whole documents.  Its ids are cut into blocks of 128.  Of each
block the minimum is subtracted, and the differences are packed at the bit width
that ``percentile`` of them need; larger ones keep their low bits in place and
their full difference in the block's exception list.  Starts of all blocks are
indexed, so any block can be read alone.  Layout of a part (little-endian):

    "PFOR" | u32 n_docs | u64 n_ids | u32 n_blocks
    n_docs  x u32   ids per document
    n_blocks x u32  start of each block behind the index
    blocks: u32 minimum | u8 width | u8 exceptions | 16 * width bytes | u8 places | u32 differences

Documents are dealt out by doc_id range and written by Spark as one file per
range, a row per part (file number, part number, first document, ids, bytes), so
a task that is retried on another executor leaves no half-written file, and any
store that Spark reaches will do.  Files in number order, parts in number order
and documents inside a part are in ascending doc_id order.

Defined results: a null or empty text has only the end id; rows with the same
doc_id stay separate documents; null ids come first; an empty table gives empty
files.  One document is never split over parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import plain_strings, slices
from echotrace.llm.token_ids import WordEncoder

BLOCK = 128
PERCENTILE = 95
HEADER = struct.Struct("<4sIQI")


def _bits_needed(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, per_doc: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One part from ids (unsigned 32-bit) and the number of ids of each document."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n % BLOCK:
        padded[n:] = ids[-1]
    table = padded.reshape(n_blocks, BLOCK)
    low = table.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = (table - low[:, None]).astype(np.uint64)
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _bits_needed(np.partition(diff, at, axis=1)[:, at]) if n_blocks else np.zeros(0, np.int64)
    over = diff >> width[:, None].astype(np.uint64) != 0
    n_over = over.sum(axis=1)
    size = 6 + BLOCK // 8 * width + 5 * n_over
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    heads = np.zeros(n_blocks, [("low", "<u4"), ("width", "u1"), ("over", "u1")])
    heads["low"], heads["width"], heads["over"] = low, width, n_over
    if n_blocks:
        body[start[:, None] + np.arange(6)] = heads.view(np.uint8).reshape(n_blocks, 6)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        part = diff[rows] & np.uint64((1 << w) - 1)
        words = np.zeros((len(rows), BLOCK * w // 64), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            words[:, word] |= part[:, j] << np.uint64(shift)
            if shift + w > 64:
                words[:, word + 1] |= part[:, j] >> np.uint64(64 - shift)
        body[start[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)] = words.view(np.uint8).reshape(len(rows), -1)
    block, place = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    lists = (start + 6 + BLOCK // 8 * width)[block]
    body[lists + nth] = place
    values = diff[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(lists + n_over[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return b"".join([HEADER.pack(b"PFOR", len(per_doc), n, n_blocks), per_doc.astype("<u4").tobytes(),
                     start.astype("<u4").tobytes(), body.tobytes()])


def unpack(part: bytes, blocks: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per document) of a part; ``blocks`` picks some blocks by the index."""
    magic, n_docs, n, n_blocks = HEADER.unpack_from(part)
    if magic != b"PFOR":
        raise ValueError("not a token part")
    per_doc = np.frombuffer(part, "<u4", n_docs, HEADER.size).astype(np.int64)
    start = np.frombuffer(part, "<u4", n_blocks, HEADER.size + 4 * n_docs).astype(np.int64)
    body = np.frombuffer(part, np.uint8, offset=HEADER.size + 4 * n_docs + 4 * n_blocks)
    chosen = np.arange(n_blocks)[blocks]
    start = start[chosen]
    heads = np.ascontiguousarray(body[start[:, None] + np.arange(6)]).view(
        [("low", "<u4"), ("width", "u1"), ("over", "u1")]).reshape(-1) if len(start) else np.zeros(0, [("low", "<u4"), ("width", "u1"), ("over", "u1")])
    width, n_over = heads["width"].astype(np.int64), heads["over"].astype(np.int64)
    diff = np.zeros((len(start), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words = np.ascontiguousarray(body[start[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)]).view("<u8")
        mask = np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            value = words[:, word] >> np.uint64(shift)
            if shift + w > 64:
                value = value | (words[:, word + 1] << np.uint64(64 - shift))
            diff[rows, j] = value & mask
    block = np.repeat(np.arange(len(start)), n_over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    lists = (start + 6 + BLOCK // 8 * width)[block]
    values = np.ascontiguousarray(body[(lists + n_over[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    diff[block, body[lists + nth]] = values
    ids = (diff + heads["low"].astype(np.uint64)[:, None]).astype(np.uint32).reshape(-1)
    if len(chosen) and chosen[-1] == n_blocks - 1:
        ids = ids[:len(ids) - (n_blocks * BLOCK - n)]
    return ids, per_doc


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files to ``path``.

    Rows are dealt out by (doc_id, row number of the scan): equal ids can be split.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file_nr, part_nr = WordEncoder.at(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text"):
                ids, per_doc = encoder.encode(plain_strings(some.column("text")), end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_nr], pa.int64()), pa.array([part_nr], pa.int64()), pa.array([len(ids)], pa.int64()),
                     pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([pack(ids, per_doc)], pa.binary())],
                    ["file_nr", "part_nr", "n_ids", "doc_ids", "part"])
                part_nr += 1

    (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row").asc())
         .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("row").asc())
         .select("doc_id", "text")
         .mapInArrow(run, "file_nr long, part_nr long, n_ids long, doc_ids array<long>, part binary")
         .write.mode("overwrite").parquet(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    files = spark.read.parquet(path)
    per_file = files.groupBy("file_nr").agg(F.sum("n_ids").alias("ids"))
    before_file = per_file.select(F.col("file_nr").alias("f"), (F.sum("ids").over(Window.orderBy("file_nr")) - F.col("ids"))
                                  .alias("file_start"))  # one row per file
    in_file = Window.partitionBy("file_nr").orderBy("part_nr")
    parts = (files.select("file_nr", "part_nr", (F.sum("n_ids").over(in_file) - F.col("n_ids")).alias("part_start"))
                  .join(before_file, F.col("file_nr") == F.col("f"))
                  .select(F.col("file_nr").alias("p_file"), F.col("part_nr").alias("p_part"),
                          (F.col("file_start") + F.col("part_start")).alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_nr, part_nr, doc_ids, part in zip(*[batch.column(c).to_pylist() for c in ("file_nr", "part_nr", "doc_ids")],
                                                       batch.column("part")):
                ids, per_doc = unpack(part.as_py())
                ends = np.cumsum(per_doc)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), per_doc.tolist())]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_nr] * k, pa.int64()), pa.array([part_nr] * k, pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array(ends - per_doc, pa.int64()), pa.array(per_doc, pa.int64()), pa.array(crc, pa.int64())],
                    ["file_nr", "part_nr", "doc_id", "at", "n_tokens", "ids_crc32"])

    # few parts at a time in a worker: a part is megabytes
    read = files.select("file_nr", "part_nr", "doc_ids", "part").mapInArrow(
        run, "file_nr long, part_nr long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (read.join(parts, (F.col("file_nr") == F.col("p_file")) & (F.col("part_nr") == F.col("p_part")))
                .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
