"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text is a bag of hashed terms: its byte trigrams, runs of four character
classes, and words that say how much it repeats itself. Terms are weighted by
log frequency and by their rarity over all documents; a truncated singular value
decomposition of a bounded sample of labelled rows gives the latent space. Each
document then meets all labelled vectors, in blocks of exact cosine products, and
its nearest neighbours vote with weights that grow with their similarity.

Defined results: a null or empty text is the null vector, on which every labelled
vector has the same vote; neighbours of equal similarity to the last one (ties)
share its place evenly; a very long text is a block of its own; without labelled
rows every score is 0.5; labels of rows without text or with a null label aren't
learnt; of several labels of a document the mean decides, of several texts of an
id the one of lowest hash is learnt; repeated rows each give a row; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents

N_GRAMS, N_SHAPES = 2048, 2048
STYLES, STYLE_BINS = 5, 12
TERMS = N_GRAMS + N_SHAPES + STYLES * STYLE_BINS
STYLE_WEIGHT = 4.0
#: Labelled rows that are learnt from, at most; the lowest by hash of the id.
LABELLED = 4096
#: Texts whose features are made at once: 4156 values each.
BLOCK_ROWS = 1024
RANK, NEIGHBOURS, POWER = 64, 15, 4.0
THRESHOLD = 0.7

_CLASS = np.full(256, 5, np.uint8)  # other marks
_CLASS[:128] = 6
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 4
for _k, _c in enumerate(b"#*$%&|<>!?.,;:()[]{}=@_-/\"'"):
    _CLASS[_c] = 7 + _k


def _bag(key: np.ndarray, n_terms: int, bounds: np.ndarray, width: int) -> np.ndarray:
    """Counts of hashed n-grams that lie in one document."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))[: len(key)]
    ok = np.ones(len(key), bool)
    for b in bounds[1:-1]:
        ok[max(0, b - width + 1) : b] = False
    flat = doc[ok] * n_terms + key[ok]
    return np.bincount(flat, minlength=n * n_terms)[: n * n_terms].reshape(n, n_terms)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log frequencies of the terms of each text."""
    n = len(offsets) - 1
    s = ts.scan(data, offsets, ts.SPACE)
    out = np.zeros((n, TERMS), np.float32)
    if len(data) >= 4:
        d = s.data.astype(np.uint32)
        grams = d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)
        grams ^= grams >> np.uint32(15)
        out[:, :N_GRAMS] = _bag((grams % N_GRAMS).astype(np.int64), N_GRAMS, offsets, 3)
        c = _CLASS[data].astype(np.uint32)
        shapes = ((c[:-3] * 37 + c[1:-2]) * 37 + c[2:-1]) * np.uint32(37) + c[3:]
        shapes *= np.uint32(0x9E3779B1)
        shapes ^= shapes >> np.uint32(16)
        out[:, N_GRAMS : N_GRAMS + N_SHAPES] = _bag((shapes % N_SHAPES).astype(np.int64), N_SHAPES, offsets, 4)
        np.log1p(out, out=out)
    words = np.maximum(1, s.n_words)
    same = np.zeros(len(s.hash), bool)
    same[1:] = (s.hash[1:] == s.hash[:-1]) & (s.doc[1:] == s.doc[:-1])
    keys = ts.mix(s.hash + s.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(s.doc[first], minlength=n) / words
    letters = np.maximum(1, ts.per_doc((_CLASS[data] == 1) | (_CLASS[data] == 2), offsets))
    style = np.stack([
        ts.per_doc(same, s.first) / words,
        1 - distinct,
        ts.per_doc(_CLASS[data] == 2, offsets) / letters,
        ts.per_doc(_CLASS[data] > 6, offsets) / (8.0 * words),
        np.log2(words) / 16,
    ], 1)
    bins = np.minimum((np.clip(style, 0, 1) * STYLE_BINS).astype(int), STYLE_BINS - 1)
    some = np.flatnonzero(s.n_words > 0)
    for k in range(STYLES):
        out[some, N_GRAMS + N_SHAPES + k * STYLE_BINS + bins[some, k]] = STYLE_WEIGHT
    return out


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(0), block_rows=BLOCK_ROWS):
                df += (features(data, offsets) > 0).sum(0)
                n += j - i
        yield pa.RecordBatch.from_pydict({"term": np.append(np.arange(TERMS), -1), "df": np.append(df, n)})

    found = docs.select(text_col).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(TERMS + 1, np.int64)
    for r in found:
        df[r.term] = r.df
    return df[:-1], int(df[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents, by ascending id.

    Of several texts of an id, the one of lowest hash is learnt; they are reduced to
    one by a grouping, before anything is collected.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ts.blocks(batch.column(2), block_rows=BLOCK_ROWS):
                rows = features(data, offsets)
                doc, term = np.nonzero(rows)
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([term[a:b].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                        pa.array([rows[d, term[bounds[d] : bounds[d + 1]]].astype("<f4").tobytes() for d in range(j - i)], pa.binary()),
                    ],
                    names=["id", "label", "term", "value"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    chosen = texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    found = sorted(chosen.mapInArrow(run, "id long, label int, term binary, value binary").collect(), key=lambda r: r.id)
    rows = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        rows[k, np.frombuffer(r.term, "<u2")] = np.frombuffer(r.value, "<f4")
    return rows, np.array([r.label for r in found], np.float32)


def latent_space(rows: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the rows, by randomised subspace iteration."""
    k = min(rank, *rows.shape)
    q = np.random.default_rng(seed).standard_normal((rows.shape[1], min(k + 16, *rows.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, vt = np.linalg.svd(rows @ q, full_matrices=False)
    return (q @ vt.T[:, :k]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(1e-12, np.linalg.norm(rows, axis=1, keepdims=True))


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS, power: float = POWER, block: int = 1024) -> np.ndarray:
    """Weighted share of label 1 among the nearest of the known unit vectors.

    Vectors that are as near as the last neighbour share its place, or places, evenly.
    """
    out = np.full(len(vectors), 0.5)
    if not len(known):
        return out
    k = min(neighbours, len(known))
    for a in range(0, len(vectors), block):
        cosine = vectors[a : a + block] @ known.T
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
        row, near = np.nonzero(cosine >= last[:, None])
        value = cosine[row, near].astype(np.float64)
        tied = value == last[row]
        n, n_tied = len(cosine), np.bincount(row[tied], minlength=len(cosine))
        places = k - np.bincount(row[~tied], minlength=n)
        weight = np.maximum(value, 1e-6) ** power * np.where(tied, (places / n_tied)[row], 1.0)
        out[a : a + block] = np.bincount(row, weight * labels[near], n) / np.bincount(row, weight, n)
    null = ~vectors.any(axis=1)
    out[null] = labels.mean()
    return np.clip(out, 0, 1)


def is_held_out(column, modulus: int = 4, remainder: int = 2):
    """Whether the CRC-32 of the id as text leaves the remainder; false without id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labelled: int = LABELLED, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, score and predicted."""
    df, n = document_frequency(docs, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    rows, learnt = labelled_sample(docs, labels, label_col, id_col, text_col, most_labelled)
    rows = unit(rows * idf)
    space = latent_space(rows) if len(rows) else np.zeros((TERMS, 1), np.float32)
    model = docs.sparkSession.sparkContext.broadcast((idf[:, None] * space, unit(rows @ space), learnt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, known, learnt = model.value
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for i, j, data, offsets in ts.blocks(batch.column(1), block_rows=BLOCK_ROWS):
                score = vote(unit(features(data, offsets) @ project), known, learnt)
                held = [x is not None and zlib.crc32(str(x).encode()) % 4 == 2 for x in ids.slice(i, j - i).to_pylist()]
                columns = [ids.slice(i, j - i), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
