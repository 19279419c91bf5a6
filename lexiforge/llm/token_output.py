"""Token-ID output: Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and as many equally wide values as fit in
60 bits. Blocks of 1024 ids start at a word of their own, whose offset is stored,
so blocks are encoded side by side and words of one selector are decoded at once.
A value that needs more than 60 bits is an escape: the word is all ones and the
value follows in a list of its own.

A file's record (one row of a Parquet file, so every store that Spark writes to
will do) holds whole documents: their ids and lengths, the place of the first id
in the shard, and the payload. Shards are ranges of doc_id in ascending order, as
many as the input's bytes need. Ranges go on by the text's hash and the row's place
in the input, so an id with very many rows, or rows without id, fill several shards.

Defined results: a null or empty text is the end id alone; a very long text is a
record of its own; rows without doc_id come first; rows with the same doc_id (ties)
are ordered by the hash of their text, and equal rows by their place; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents, plan_bytes, table_path
from .tokens import default_path, encoder, with_end

#: Values in a word and their width, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
RECORD_IDS = 1 << 18
#: Bytes of input, as Spark estimates them from the files, that make a shard.
SHARD_BYTES = 128 << 20
_ESCAPE = np.uint64((1 << 60) - 1)
_MAGIC = b"S8B1"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 61 marks an escape."""
    out = np.zeros(len(values), np.uint8)
    for w in np.unique(WIDTHS)[:-1]:
        out += values >= (np.uint64(1) << np.uint64(w))
    need = np.unique(WIDTHS).astype(np.uint8)[out]
    need[values >= _ESCAPE] = 61
    return need


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Values of up to 64 bits as a payload."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    n_blocks = -(-n // block)
    padded = np.zeros(n_blocks * (block + 240), np.uint8)
    need = _bits(values)
    escapes = values[need == 61]
    stored = np.where(need == 61, _ESCAPE, values)
    need[need == 61] = 60
    lanes = padded.reshape(n_blocks, block + 240)
    full = n // block
    lanes[:full, :block] = need[: full * block].reshape(full, block)
    if n % block:
        lanes[full, : n % block] = need[full * block :]
    most, spans = lanes, {1: lanes}
    k = 1
    while k < 240:
        nxt = most.copy()
        nxt[:, :-k] = np.maximum(most[:, :-k], most[:, k:])
        k, most = 2 * k, nxt
        spans[k] = nxt
    choice = np.full((n_blocks, block), 15, np.uint8)
    for s in range(14, -1, -1):
        count, half = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        high = spans[half][:, :block]
        if half < count:
            high = np.maximum(high, spans[half][:, count - half : count - half + block])
        choice[high <= WIDTHS[s]] = s
    choice = choice.ravel()
    jump = COUNTS[choice]
    at = np.arange(n_blocks) * block
    stop = np.minimum(at + block, n)
    is_start = np.zeros(n_blocks * block, bool)
    while len(at):
        is_start[at] = True
        at = at + jump[at]
        going = at < stop
        at, stop = at[going], stop[going]
    start = np.flatnonzero(is_start)
    selector = choice[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    end = np.minimum((start // block + 1) * block, n)
    for s in np.unique(selector).tolist():
        if not WIDTHS[s]:
            continue
        mine = np.flatnonzero(selector == s)
        for j in range(int(COUNTS[s])):
            where = start[mine] + j
            value = np.where(where < end[mine], stored[np.minimum(where, n - 1)], np.uint64(0))
            words[mine] |= value << np.uint64(int(WIDTHS[s]) * j)
    offsets = np.searchsorted(start, np.arange(n_blocks) * block).astype(np.uint32)
    return b"".join([_MAGIC, struct.pack("<IIII", n, block, len(words), len(escapes)), offsets.tobytes(), words.tobytes(), escapes.tobytes()])


def decode(payload: bytes) -> np.ndarray:
    """The values of a payload."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, block, n_words, n_escapes = struct.unpack_from("<IIII", payload, 4)
    n_blocks = -(-n // block)
    offsets = np.frombuffer(payload, np.uint32, n_blocks, 20).astype(np.int64)
    words = np.frombuffer(payload, np.uint64, n_words, 20 + 4 * n_blocks)
    escapes = np.frombuffer(payload, np.uint64, n_escapes, 20 + 4 * n_blocks + 8 * n_words)
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    starts = ends - COUNTS[selector]
    of = np.repeat(np.arange(n_blocks), np.diff(np.append(offsets, n_words)))
    first = of * block + starts - starts[offsets][of] if n_words else starts
    limit = np.minimum((of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        if not WIDTHS[s]:
            continue
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            where = first[mine] + j
            ok = where < limit[mine]
            out[where[ok]] = ((words[mine] >> np.uint64(int(WIDTHS[s]) * j)) & mask)[ok]
    if n_escapes:
        out[out == _ESCAPE] = escapes
    return out


RECORD = "shard int, first long, doc_ids array<long>, lengths array<long>, payload binary"


def input_bytes(docs: DataFrame, text_col: str) -> int:
    """The optimizer's estimate, or where it has none, the bytes of all texts."""
    size = plan_bytes(docs.select(text_col))
    return size if size < 1 << 60 else docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write the ids of all documents in ascending order of `id_col`."""
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs, text_col) // SHARD_BYTES))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = ["doc_id", "h", "place"]
    placed = docs.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in ts.blocks(batch.column(1), RECORD_IDS * 4):
                values, bounds = with_end(*enc.encode(data, offsets), end_id)
                yield pa.RecordBatch.from_pylist([{"shard": shard, "first": first, "doc_ids": ids[i:j], "lengths": np.diff(bounds).tolist(), "payload": encode(values)}], schema=_RECORD)
                first += len(values)

    ordered.mapInArrow(run, RECORD).write.option("compression", "zstd").parquet(path)


_RECORD = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every document."""
    return _read(spark, path, lambda ids: pa.array([x for x in ids], pa.list_(pa.int64())), "ids array<long>")


def digest_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, decoded from the files."""
    return _read(spark, path, lambda ids: pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64()), "ids_crc32 long")


def _read(spark: SparkSession, path: str, made, column: str) -> DataFrame:
    records = spark.read.schema(RECORD).parquet(path)
    totals = records.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    sizes = np.zeros(max((r.shard for r in totals), default=-1) + 2, np.int64)  # 8 bytes a shard
    for r in totals:
        sizes[r.shard + 1] = r.n
    before = np.cumsum(sizes)
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"])
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                start = before[row["shard"]] + row["first"] + ends - row["lengths"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(row["lengths"], pa.int64()), made(np.split(ids, ends[:-1]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", name])

    return records.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-ids")
    write_token_ids(documents(spark, sf_dir), path, default_path("word_bpe_49k.json"))
    return digest_token_ids(spark, path)
