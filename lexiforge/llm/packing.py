"""Packing by order-preserving dynamic programming.

The documents of a partition are one stream of tokens, in the order in which they
are read. Cuts may stand after documents, at no cost, or after sentences, at a
penalty for the truncated document, and at a higher one between words inside a
sentence, of which every 16 tokens offer one. Where even words are longer than a
sequence, it is cut anywhere. The cheapest cuts minimise padding plus penalties:

    best[j] = penalty[j] + min(best[i] + size - (place[j] - place[i]))

over the cuts i at most `size` tokens before j. The minimum of best[i] + place[i]
over that sliding window comes from a monotone queue, so a stream takes time in
proportion to its cuts. The stream is optimised in stretches; the last sequence
of a stretch is open and goes into the next. Nothing is shuffled, and a sequence
never spans partitions.

Defined results: a null or empty text is the end id alone; a very long text is cut
like any other; of equally cheap cuts (ties) the latest is taken; every id lies in
exactly one piece; rows are packed one by one, so repeated rows each give pieces;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents
from .tokens import default_path, encoder, with_end

SIZE = 2048
#: Penalties of a cut after a sentence, between words, and anywhere.
COSTS = (16.0, 64.0, 256.0)
#: Of so many tokens, one word boundary is offered as a cut.
WORD_STEP = 16
#: Tokens that are optimised together.
STRETCH = 1 << 18
#: Bytes of texts that are encoded together.
ENCODED_BYTES = 1 << 20


def best_cuts(place: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Chosen cut places, ascending, the last one included; place 0 is implied.

    `place` ascends strictly, with no gap over `size`.
    """
    places, costs = [0, *place.tolist()], [0.0, *penalty.tolist()]
    best, origin = [0.0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    key = [0.0] * len(places)
    for j in range(1, len(places)):
        at = places[j]
        while places[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        origin[j] = i
        best[j] = key[i] + size - at + costs[j]
        key[j] = best[j] + at
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = origin[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, kind: np.ndarray, size: int, costs: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end and what each costs."""
    n, (sentence, word, forced) = len(ids), costs
    cost = np.full(n + 1, np.inf)
    kinds = kind[ids]
    between = np.flatnonzero(kinds & 2)
    cost[between[np.diff(between // WORD_STEP, prepend=-1) > 0]] = word
    cost[1:][kinds & 1 > 0] = sentence
    cost[doc_ends] = 0.0
    cost[n] = 0.0
    place = np.flatnonzero(np.isfinite(cost))
    place = place[place > 0]
    gap = np.diff(place, prepend=0)
    if (gap > size).any():
        more = [np.arange(p - g + size, p, size) for p, g in zip(place[gap > size].tolist(), gap[gap > size].tolist(), strict=True)]
        cost[np.concatenate(more)] = forced
        place = np.flatnonzero(np.isfinite(cost))
        place = place[place > 0]
    return place, cost[place]


@lru_cache(maxsize=2)
def token_kinds(vocabulary: str) -> np.ndarray:
    """1: ids that end a sentence (a full stop, ! or ? at their end, or a newline); 2: ids that begin a word."""
    tokenizer = encoder(vocabulary).whole
    out = np.zeros(tokenizer.get_vocab_size() + 2, np.uint8)
    for token, i in tokenizer.get_vocab().items():  # byte-level signs: Ċ is a newline, Ġ a blank
        out[i] = (token.endswith((".", "!", "?")) or "Ċ" in token) + 2 * token.startswith(("Ġ", "Ċ"))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Packer:
    """Takes documents in order and gives their pieces."""

    def __init__(self, kind: np.ndarray, first_sequence: int, size: int = SIZE, costs: tuple[float, float, float] = COSTS, stretch: int = STRETCH):
        self.kind, self.size, self.costs, self.stretch = kind, size, costs, stretch
        self.sequence = first_sequence
        self.names: list[int | None] = []
        self.starts: list[int] = []  # ids of the document before what is held
        self.totals: list[int] = []
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, name: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.names.append(name)
        self.starts.append(0)
        self.totals.append(len(ids))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.stretch:
            yield from self.flush(False)

    def flush(self, final: bool) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        ids = np.concatenate(self.held)
        ends = np.cumsum([len(x) for x in self.held])
        cuts = np.array(best_cuts(*cut_places(ids, ends, self.kind, self.size, self.costs), self.size))
        done = len(ids) if final else int(cuts[-2]) if len(cuts) > 1 else 0
        if done:
            cuts = cuts[cuts <= done]
            bounds = np.union1d(np.append(ends[ends <= done], 0), cuts)
            start, length = bounds[:-1], np.diff(bounds)
            doc = np.searchsorted(ends, start, "right")
            sequence = np.searchsorted(cuts, start, "right")
            offset = start - np.append(0, cuts)[sequence]
            began = np.append(0, ends)[doc] - np.array(self.starts)[doc]
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.names[d] for d in doc.tolist()], pa.int64()), pa.array(start - began), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.array(self.totals)[doc]), pa.array(self.sequence + sequence), pa.array(offset)],
                names=NAMES,
            )
            self.sequence += len(cuts)
        keep = int(np.searchsorted(ends, done, "right"))
        if keep < len(ends):
            inside = done - (int(ends[keep - 1]) if keep else 0)
            self.held[keep] = self.held[keep][inside:]
            self.starts[keep] += inside
        for x in (self.names, self.starts, self.totals, self.held):
            del x[:keep]
        self.n = sum(map(len, self.held))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = SIZE, costs: tuple[float, float, float] = COSTS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        packer = Packer(token_kinds(vocabulary), TaskContext.get().partitionId() << 40, size, costs)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in ts.blocks(batch.column(1), ENCODED_BYTES):
                ids, bounds = with_end(*enc.encode(data, offsets), end_id)
                for name, a, b in zip(names[i:j], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    yield from packer.add(name, ids[a:b])
        yield from packer.flush(True)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))
