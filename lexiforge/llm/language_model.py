"""LM scoring with a gated recurrent language model in numpy.

The model is a GRU over words. Its output softmax is factored: a distribution
over frequency classes and one over the words of the class; instead of words that
aren't among the 2048 most frequent, classes have trees of such words, so that the vocabulary
grows with the counts that are broadcast, but for words met less than 8 times, from
which the model learns how likely unseen ones are. Words outside it are one symbol, whose probability is shared among them by their counts
in all training documents, so every text has a probability. Training is
truncated backpropagation over windows; the state goes on from window to window,
in training and in scoring, so that the score is that of the complete document.

Counts are of all training documents. The weights are learnt in rounds: in each,
every partition, small ones together, trains a copy on its part of that round's training documents,
dealt to rounds by hash, and the copies are averaged by the tokens they saw. All
rounds together learn from every training document once (`fraction` may lower it).

Counts of frequent words (a bounded number) are broadcast. All others are joined:
each document sends the words that it lacks counts for. Words are known by 64-bit
fingerprints.

Defined results: a null or empty text is the end token alone; a very long text is
scored as a whole; words of equal count (ties) are ordered by fingerprint; a row without id
isn't held out; repeated rows each give a row (and count in training each); with
no training documents every count is 0 and the model is uniform; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import documents, plan_bytes, written

#: Words of the softmax, with the symbol for all others; words of a class; widths.
VOCABULARY, CLASS_SIZE, HIDDEN = 1 << 18, 64, 32
#: Words of plain classes. The others are the leaves of trees of SUPER words, nodes of BRANCH children in DEPTH levels; a class may have trees for words.
HEAD, BRANCH, DEPTH = 2048, 8, 3
SUPER = BRANCH**DEPTH
#: Words met less often have no output: held-out documents hold more of them than their counts say.
LEAST_COUNT = 8
#: Frequent words whose counts are broadcast: 16 bytes each.
BROADCAST_WORDS = 1 << 18
ROUNDS, FRACTION = 2, 1.0
#: Lanes at first and at most: they double after every so many windows, which makes tokens a little cheaper, and steps fewer.
LANES, MOST_LANES, WINDOWS, WINDOW, RATE = 64, 256, 64, 16, 0.05
#: Rate of nodes above the lowest, of the rate of all others.
MID_RATE = 0.25
#: Largest norm of a step's gradient over the weights that all words share.
CLIP = 0.2
#: States whose outputs are made at once, so that they stay in a core's cache.
CHUNK = 2048
#: Tokens of documents that wait for a lane, of which long ones go first.
WAITING = 1 << 22
#: Tokens that must be left for lanes to double and for long documents to go first: fewer are learnt from better in more steps.
ENOUGH = 1 << 18
#: States of the nodes that are made side by side, as many rows for each; nodes with more are made alone.
SIDE = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Fingerprint of the end of a text, which no word has but by chance.
END = np.uint64(0x1D8E4E27C47D124F)
FLUSH = 1 << 20
#: Bytes of files from which a copy learns at least, where that leaves a copy for each core.
COPY_BYTES = 32 << 20
#: Bytes of texts that are scored side by side, at least if a batch has them, and lanes of a step.
SCORED_BYTES, SCORED_LANES = 1 << 24, 512
#: Bytes of texts whose words are counted at once.
COUNTED_BYTES = 1 << 22
HELD_MODULUS, HELD_REMAINDER = 7, 2


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % HELD_MODULUS == HELD_REMAINDER for i in ids], bool)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words with an end after each text, and the bounds."""
    s = ts.scan(data, offsets, ts.SPACE)
    bounds = s.first + np.arange(len(s.first))
    out = np.full(bounds[-1], END, np.uint64)
    out[np.arange(len(s.hash)) + s.doc] = s.hash
    return out, bounds


def hashes_of_blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many texts, of which some are scanned at once."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))
    found = [token_hashes(d, o) for _, _, d, o in ts.blocks(texts)]
    return np.concatenate([h for h, _ in found]), np.cumsum(np.concatenate([[0], *(np.diff(b) for _, b in found)]))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, c) of all tokens of the documents that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            words, where = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            learnt = ~held_out(batch.column(0).to_pylist())
            for _, _, data, offsets in ts.blocks(batch.column(1).filter(pa.array(learnt))):
                held.append(np.unique(token_hashes(data, offsets)[0], return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of frequent words, and the places of the softmax.

    Place 0 is the symbol for words outside; places follow by frequency.
    """

    keys: np.ndarray  # fingerprints of frequent words, sorted
    counts: np.ndarray
    place: np.ndarray  # of each key; 0 if outside
    size: int  # places, a multiple of the class size; beyond HEAD, of SUPER
    unigram: np.ndarray  # counts by place
    total: int  # N
    distinct: int  # V
    outside_total: int
    outside_distinct: int

    @property
    def outside_log(self) -> float:
        return math.log10(self.outside_total + self.outside_distinct + 1)

    @property
    def base_log(self) -> float:
        return math.log10(self.total + self.distinct + 1)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of tokens; the count is -1 where it isn't here."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        first, shift = self.by_first_bits
        at = first.take((hashes >> shift).view(np.int64))
        found = self.keys.take(at)
        while len(less := np.flatnonzero(found < hashes)):  # keys of the same first bits come before
            less = less[at[less] + 1 < len(self.keys)]
            if not len(less):
                break
            at[less] += 1
            found[less] = self.keys.take(at[less])
        known = found == hashes
        return np.where(known, self.place.take(at), 0), np.where(known, self.counts.take(at), -1)

    @functools.cached_property
    def by_first_bits(self) -> tuple[np.ndarray, np.uint64]:
        """The first key that isn't less, for the first bits of fingerprints, four times as many as keys; and the bits after those."""
        bits = min(24, len(self.keys).bit_length() + 2)
        shift = np.uint64(64 - bits)
        first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << shift)
        return np.minimum(first, len(self.keys) - 1).astype(np.int32), shift

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "by_first_bits"}


def build_vocabulary(counts: DataFrame, size: int = VOCABULARY, frequent: int = BROADCAST_WORDS) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    keys, numbers = np.array(top.column("word")).astype(np.int64).view(np.uint64), np.array(top.column("c")).astype(np.int64)
    inside = min(size - 1, int((numbers >= LEAST_COUNT).sum()))
    size = max(CLASS_SIZE, -(-(inside + 1) // CLASS_SIZE) * CLASS_SIZE)
    if size > HEAD:
        size = HEAD + -(-(inside + 1 - HEAD) // SUPER) * SUPER
    place = np.zeros(len(keys), np.int64)
    place[:inside] = np.arange(1, inside + 1)
    unigram = np.zeros(size, np.int64)
    unigram[1 : inside + 1] = numbers[:inside]
    unigram[0] = total - unigram.sum()
    order = np.argsort(keys)
    return Vocabulary(keys[order], numbers[order], place[order], size, unigram, total, distinct, int(unigram[0]), distinct - inside)


def _exps(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows of logits, in place, and their sums; a row's own maximum is taken off only where it must be.

    Below 60 and above -60 neither exponentials nor sums leave what 32 bits hold.
    """
    if p.size and not (p.max() < 60 and p.min() > -60):
        p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    return p, p @ np.ones(p.shape[1], p.dtype)


def _log_softmax(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of one column of each row; `p` is used up."""
    rows = np.arange(len(at))
    if p.size and not (p.max() < 60 and p.min() > -60):
        p -= p.max(1, keepdims=True)
    said = p[rows, at]
    return said - np.log(_exps(p)[1])


def _less_said(p: np.ndarray, said: np.ndarray, scale: np.floating) -> np.ndarray:
    """Gradient of the loss by logits, which are used up."""
    p, total = _exps(p)
    p *= (scale / total)[:, None]
    p[np.arange(len(said)), said] -= scale
    return p


def _with_one(states: np.ndarray) -> np.ndarray:
    """The states with a 1 after each, which weighs a bias, and a row of zeros after all."""
    out = np.zeros((len(states) + 1, states.shape[1] + 1), states.dtype)
    out[:-1, :-1], out[:-1, -1] = states, 1
    return out


def _runs(kind: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, after the last) of each value of a sorted array."""
    if len(kind):
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        yield from zip(kind[first].tolist(), first.tolist(), [*first[1:].tolist(), len(kind)], strict=True)


def _side_by_side(node: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted nodes, indices of the states of each) of states that are sorted by node, about `rows` states at once.

    A node of fewer states than the others beside it has len(node) for the rest.
    """
    if not len(node):
        return
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    count = np.diff(np.append(first, len(node)))
    rank = np.argsort(count, kind="stable")
    i = 0
    for size, end in zip(SIDE, np.searchsorted(count[rank], SIDE, "right").tolist(), strict=True):
        steps = np.arange(size)
        while i < end:
            some = np.sort(rank[i : min(end, i + max(1, rows // size))])
            at = first[some, None] + steps
            if size > 1:
                at[steps >= count[some, None]] = len(node)
            yield node[first[some]], at
            i += len(some)
    for k in rank[i:].tolist():
        yield node[first[k] : first[k] + 1], np.arange(first[k], first[k] + count[k])[None]


class GRU:
    """Weights, forward pass and truncated backpropagation."""

    DENSE = ("embed", "w", "u", "b", "class_w", "class_b", "word_w")
    #: Of the words beyond HEAD: the children of all nodes above the lowest, and a row of each word as input and, in its node, as output.
    TAIL = ("mid_w", "tail_in", "tail_out")

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        head, h = min(vocabulary.size, HEAD), hidden
        tail = vocabulary.size - head
        self.head = head
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        smooth = vocabulary.unigram + 0.5
        smooth = smooth / smooth.sum()
        sums, counted = smooth[head:], []
        for _ in range(DEPTH if tail else 0):  # from the words up
            children = sums.reshape(-1, BRANCH)
            sums = children.sum(1)
            counted.append(np.log(children / sums[:, None]).astype(np.float32))
        words = np.concatenate([smooth[:head], sums, np.full(-len(sums) % CLASS_SIZE, 1e-12)]).reshape(-1, CLASS_SIZE)
        n = len(words)
        self.embed, self.w, self.u = small(head, h), small(h, 3 * h) * 3, small(h, 3 * h) * 2
        self.b = np.zeros(3 * h, np.float32)
        self.b[:h] = 1.0  # the update gate keeps the state at first
        self.class_w, self.class_b = small(h, n), np.log(words.sum(1)).astype(np.float32)
        self.word_w = np.concatenate([small(n, h, CLASS_SIZE), np.log(words / words.sum(1, keepdims=True)).astype(np.float32)[:, None]], 1)
        self.NAMES = self.DENSE
        if tail:  # all zero at first: words by their counts
            self.NAMES = self.DENSE + self.TAIL
            self.counted = np.concatenate(counted[::-1])
            self.above = np.cumsum([0, *map(len, counted[:0:-1])])  # the first node of each level
            self.mid_w, self.tail_in, self.tail_out = (np.zeros(x, np.float32) for x in ((self.above[-1], BRANCH, h + 1), (tail, h), (tail // BRANCH, BRANCH, h + 1)))
        self.hidden, self.seen = h, 0
        self.past, self.rate = None, 0.0  # of the nodes, while they learn

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def shared(self) -> list[str]:
        """Names of the weights that are averaged as a whole, not by rows."""
        return [n for n in self.NAMES if n[:4] != "tail"]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.shared()])

    def tail_rows(self, low: int, high: int) -> np.ndarray:
        """Rows of words beyond HEAD, as input and as output."""
        return np.concatenate([self.tail_in[low:high], self.tail_out.reshape(-1, self.hidden + 1)[low:high]], 1)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.shared():
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size

    def read(self, places: np.ndarray) -> np.ndarray:
        """Rows of words as input."""
        out = self.embed[np.minimum(places, self.head - 1)]
        if len(self.NAMES) > len(self.DENSE):
            rest = np.flatnonzero(places >= self.head)
            out[rest] = self.tail_in[places[rest] - self.head]
        return out

    def classes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each sorted word, and the child of the class: the word, or its tree."""
        n = int(np.searchsorted(places, self.head))
        return np.divmod(np.append(places[:n], self.head + (places[n:] - self.head) // SUPER), CLASS_SIZE)

    def nodes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted nodes of sorted words beyond HEAD, level by level, and the child of each."""
        found = [places - self.head]
        for _ in range(DEPTH):
            found.append(found[-1] // BRANCH)
        return np.concatenate([x + a for x, a in zip(found[:0:-1], self.above, strict=True)]), np.concatenate(found[-2::-1]) % BRANCH

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights (nodes x children x width) of sorted nodes, and the logits of the counts."""
        n, out = int(np.searchsorted(nodes, len(self.mid_w))), np.empty((len(nodes), *self.tail_out.shape[1:]), self.tail_out.dtype)
        np.take(self.mid_w, nodes[:n], 0, out=out[:n], mode="clip")
        np.take(self.tail_out, nodes[n:] - len(self.mid_w), 0, out=out[n:], mode="clip")
        return out, self.counted.take(nodes, 0)

    def learn_children(self, nodes: np.ndarray, w: np.ndarray, p: np.ndarray, states: np.ndarray) -> None:
        """A step of sorted nodes by their gradients by logits; `w` is used up. Each row of weights has one scale, by Adagrad."""
        n, past = int(np.searchsorted(nodes, len(self.mid_w))), self.past.take(nodes, 0)
        if p.shape[1] == 1:  # of one state: the gradient's squares are those of the logits', times the state's
            p, states = p[:, 0], states[:, 0]
            past += p * p * (np.einsum("nk,nk->n", states, states) / states.shape[-1])[:, None]
        else:
            change = np.matmul(p.swapaxes(1, 2), states)
            past += np.einsum("nck,nck->nc", change, change) / change.dtype.type(change.shape[-1])
        self.past[nodes] = past
        scale = self.rate / np.sqrt(past)
        scale[:n] *= MID_RATE
        if p.ndim == 2:
            p *= scale
            change = np.einsum("nc,nk->nck", p, states)
        else:
            change *= scale[:, :, None]
        w -= change
        self.mid_w[nodes[:n]], self.tail_out[nodes[n:] - len(self.mid_w)] = w[:n], w[n:]

    def gates(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """z (how much is kept), r, the candidate and its recurrent part."""
        return tuple(g.T for g in self.gates_of_columns((x * self.halved()).T, h.T, (self.u * self.halved()).T))

    def halved(self) -> np.ndarray:
        """Factors of the gates' inputs: 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2."""
        return np.repeat(np.array([0.5, 0.5, 1], self.u.dtype), self.hidden)

    def gates_of_columns(self, x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of halved inputs and weights, with a lane in each column, so that a gate of all lanes is one run of memory."""
        k = self.hidden
        rec = u @ h
        zr = x[: 2 * k] + rec[: 2 * k]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:k], zr[k:]
        c = r * rec[2 * k :]
        c += x[2 * k :]
        np.tanh(c, out=c)
        return z, r, c, rec[2 * k :]

    def table(self) -> np.ndarray:
        """The input's part of the gates, for the words of plain classes."""
        return self.embed @ self.w + self.b

    def of_classes(self, states: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Logits of the words of each state's class; states are sorted by class."""
        p = np.empty((len(states), CLASS_SIZE), states.dtype)
        for k, a, b in _runs(kind):
            np.dot(states[a:b], self.word_w[k], out=p[a:b])
        return p

    def log_probability(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(target | state), by class and word; the states may have a 1 after each already."""
        order = np.argsort(target)
        if states.shape[1] == self.hidden:
            states = _with_one(states)[:-1]
        y, s, out = target[order], np.zeros((len(target) + 1, states.shape[1]), states.dtype), np.empty(len(target), states.dtype)
        np.take(states, order, 0, out=s[:-1], mode="clip")
        (kind, child), w = self.classes(y), np.concatenate([self.class_w, self.class_b[None]])
        for a in range(0, len(y), CHUNK):
            mine = slice(a, min(a + CHUNK, len(y)))
            out[mine] = _log_softmax(s[mine] @ w, kind[mine])
            out[mine] += _log_softmax(self.of_classes(s[mine], kind[mine]), child[mine])
        if n := len(y) - int(np.searchsorted(y, self.head)):
            node, child = self.nodes(y[-n:])
            row, more = np.append(np.arange(len(node)) % n + len(y) - n, len(y)), np.empty(len(node) + 1, s.dtype)
            child = np.append(child, 0)
            for met, at in _side_by_side(node, CHUNK):
                w, counted = self.children(met)
                p = np.matmul(s.take(row.take(at), 0), w.swapaxes(1, 2))
                p += counted[:, None]
                more[at.ravel()] = _log_softmax(p.reshape(-1, BRANCH), child.take(at.ravel()))
            out[-n:] += more[:-1].reshape(-1, n).sum(0)
        said = np.empty_like(out)
        said[order] = out
        return said

    def score(self, places: np.ndarray, bounds: np.ndarray, window: int = 32, step_rows: int = 1 << 15) -> np.ndarray:
        """Log10 probability of each document's places, the state carried through.

        Documents run side by side, the longest first, so those that go on are
        always the first lanes. A step is made for SCORED_LANES of them at once, so
        that their gates stay in cache.
        """
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        size, first = size[order], bounds[:-1][order]
        k, halved, out = self.hidden, self.halved(), np.zeros(len(size))
        table, w, b, u = self.table() * halved, self.w * halved, self.b * halved, self.u * halved
        # Of the two gates and of the candidate, each a run of memory.
        tables, us = ([np.ascontiguousarray(x[:, : 2 * k]), np.ascontiguousarray(x[:, 2 * k :])] for x in (table, u))
        for a in range(0, len(size), 4096):  # lanes side by side
            n, begin, total = size[a : a + 4096], first[a : a + 4096], np.zeros(len(size[a : a + 4096]))
            alive = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left").tolist()
            h, target = np.zeros((len(n), k), np.float32), None
            states, said = np.ones((step_rows + len(n), k + 1), np.float32), np.empty(step_rows + len(n), places.dtype)
            rows, lanes = 0, []
            for t, m in enumerate(alive):
                before, target = target, places[begin[:m] + t]
                for i in range(0, m, SCORED_LANES):
                    j = min(i + SCORED_LANES, m)
                    now = h[i:j]
                    if before is None:
                        zr, x = np.repeat(b[None, : 2 * k], j - i, 0), np.repeat(b[None, 2 * k :], j - i, 0)
                    else:
                        zr, x = (y.take(before[i:j], 0, mode="clip") for y in tables)
                        if len(rest := np.flatnonzero(before[i:j] >= self.head)):
                            of_rest = self.tail_in.take(before[i + rest] - self.head, 0) @ w
                            of_rest += b
                            zr[rest], x[rest] = of_rest[:, : 2 * k], of_rest[:, 2 * k :]
                    zr += now @ us[0]
                    np.tanh(zr, out=zr)
                    zr += 1
                    zr *= 0.5
                    c = now @ us[1]
                    c *= zr[:, k:]
                    c += x
                    np.tanh(c, out=c)
                    now -= c
                    now *= zr[:, :k]
                    now += c
                    states[rows + i : rows + j, :k] = now
                said[rows : rows + m] = target
                lanes.append(m)
                rows += m
                if rows >= step_rows or t + 1 == len(alive):
                    scored = self.log_probability(states[:rows], said[:rows])
                    at = 0
                    for m in lanes:
                        total[:m] += scored[at : at + m]
                        at += m
                    rows, lanes = 0, []
            out[order[a : a + 4096]] = total
        return out / math.log(10)

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h0: np.ndarray, fresh: np.ndarray) -> tuple[list, np.ndarray]:
        """Gradients of the mean loss over a window (lanes x steps), and the state after it.

        Those of embeddings and of the words' softmax are (rows, gradients of the rows).

        `fresh` marks steps at which a lane begins a document; -1 is no target.
        """
        lanes, steps = inputs.shape
        k, words = self.hidden, inputs.T.ravel()  # all lanes of a step, then those of the next
        read = np.ones((steps, lanes, k + 1), self.embed.dtype)  # a 1 weighs the bias
        read[:, :, :k] = self.read(np.maximum(words, 0)).reshape(steps, lanes, k)
        read[inputs.T < 0, :k] = 0  # a document's first word follows no word
        halved = self.halved()
        w, u = (np.ascontiguousarray((x * halved).T) for x in (np.concatenate([self.w, self.b[None]]), self.u))
        h, kept, states = h0.T, [], np.empty((steps, lanes, k), read.dtype)
        for t in range(steps):
            if fresh[:, t].any():
                h = np.where(fresh[:, t], h.dtype.type(0), h)
            z, r, c, rec = self.gates_of_columns(w @ read[t].T, h, u)
            kept.append((h, z, r, c, rec))
            h = h - c
            h *= z
            h += c
            states[t] = h.T
        states, flat = states.reshape(-1, k), targets.T.ravel()
        ok = np.flatnonzero(flat >= 0)
        ok = ok[np.argsort(flat[ok])]
        scale = states.dtype.type(1.0 / max(1, len(ok)))
        g: dict = {"u": np.zeros_like(self.u)}
        s, y = _with_one(states.take(ok, 0)), flat[ok]
        (kind, child), d, class_w = self.classes(y), np.empty_like(s), np.concatenate([self.class_w, self.class_b[None]])
        d[-1] = 0
        of_class = np.zeros_like(class_w)
        for a in range(0, len(y), CHUNK):
            mine, said = s[a : min(a + CHUNK, len(y))], kind[a : a + CHUNK]
            p = _less_said(mine @ class_w, said, scale)
            of_class += mine.T @ p
            np.matmul(p, class_w.T, out=d[a : a + len(said)])
        g["class_w"], g["class_b"] = of_class[:-1], of_class[-1]
        p, runs = _less_said(self.of_classes(s[:-1], kind), child, scale), list(_runs(kind))
        g["word_w"] = np.array([r[0] for r in runs], np.int64), np.empty((len(runs), k + 1, CLASS_SIZE), s.dtype)
        found, d_mine = g["word_w"][1], np.empty_like(s)
        d_mine[-1] = 0
        for i, (c, a, b) in enumerate(runs):
            these = p[a:b]
            np.dot(s[a:b].T, these, out=found[i])
            np.dot(these, self.word_w[c].T, out=d_mine[a:b])
        d += d_mine
        if len(self.NAMES) > len(self.DENSE):
            n = len(y) - int(np.searchsorted(y, self.head))
            node, child = self.nodes(y[len(y) - n :])
            row, child, d_mine = np.append(np.arange(len(node)) % max(n, 1) + len(y) - n, len(y)), np.append(child, 0), np.empty((len(node) + 1, k + 1), s.dtype)
            found = []
            for met, at in _side_by_side(node, CHUNK // 4):
                w, counted = self.children(met)
                these = s.take(row.take(at), 0)
                p = np.matmul(these, w.swapaxes(1, 2))
                p += counted[:, None]
                p = _less_said(p.reshape(-1, BRANCH), child.take(at.ravel()), scale).reshape(p.shape)
                d_mine[at] = np.matmul(p, w)
                # States of zeros add nothing to the weights.
                if self.past is None:
                    found.append((met, np.matmul(p.swapaxes(1, 2), these)))
                else:
                    self.learn_children(met, w, p, these)
            if n:
                d[len(y) - n : -1] += d_mine[:-1].reshape(-1, n, k + 1).sum(0)
            if found:
                rows = np.concatenate([r for r, _ in found])
                order, cut = np.argsort(rows), int((rows < len(self.mid_w)).sum())
                rows, each = rows[order], np.concatenate([x for _, x in found])[order]
                g["mid_w"], g["tail_out"] = (rows[:cut], each[:cut]), (rows[cut:] - len(self.mid_w), each[cut:])
            else:
                g["mid_w"], g["tail_out"] = ((np.zeros(0, np.int64), x[:0]) for x in (self.mid_w, self.tail_out))
        d = d[:-1, :-1]
        d_states = np.zeros_like(states)
        d_states[ok] = d
        d_states = np.ascontiguousarray(d_states.reshape(steps, lanes, k).transpose(0, 2, 1))
        # Of the candidate's inputs, of the gates' and of the candidate's recurrent part: the first three are the inputs', the last three the states'.
        back, d_all, d_read = np.zeros((k, lanes), s.dtype), np.empty((4 * k, lanes), s.dtype), np.empty((steps, lanes, k), s.dtype)
        dc, d_z, d_r, d_rec, d_x, d_h = d_all[:k], d_all[k : 2 * k], d_all[2 * k : 3 * k], d_all[3 * k :], d_all[: 3 * k], d_all[k:]
        w, of_w = np.concatenate([self.w[:, 2 * k :], self.w[:, : 2 * k]], 1).T, np.zeros((k + 1, 3 * k), s.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, rec = kept[t]
            dh = d_states[t]
            dh += back
            back = dh * z
            np.subtract(dh, back, out=dc)  # of the candidate
            np.subtract(before, c, out=d_z)
            d_z *= dc
            d_z *= z
            c *= c
            np.subtract(1, c, out=c)
            dc *= c
            np.multiply(dc, r, out=d_rec)
            np.multiply(d_rec, rec, out=d_r)
            np.subtract(1, r, out=r)
            d_r *= r
            g["u"] += before @ d_h.T
            of_w += read[t].T @ d_x.T
            np.matmul(d_x.T, w, out=d_read[t])
            back += self.u @ d_h
            if fresh[:, t].any():
                back[:, fresh[:, t]] = 0
        of_w = np.concatenate([of_w[:, k:], of_w[:, :k]], 1)
        g["w"], g["b"] = of_w[:-1], of_w[-1]
        some = np.flatnonzero(words >= 0)
        order = some[np.argsort(words[some])]
        rows = words[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else order
        rows = rows[first]
        each = np.add.reduceat(d_read.reshape(-1, k).take(order, 0), first) if len(rows) else np.zeros((0, k), s.dtype)
        cut = np.searchsorted(rows, self.head)
        g["embed"], g["tail_in"] = (rows[:cut], each[:cut]), (rows[cut:] - self.head, each[cut:])
        return [g[n] for n in self.NAMES], h.T


class Adagrad:
    """Steps scaled by past gradients; rows without a gradient aren't touched.

    Rows of words beyond HEAD and of the nodes above them have one scale each, which keeps them small;
    from now on the model's nodes learn where their gradients are made, and give none.
    """

    def __init__(self, model: GRU, rate: float = RATE):
        self.model, self.rate = model, rate
        self.past = [np.full_like(x[..., :1] if n in GRU.TAIL else x, 1e-6) for n, x in zip(getattr(model, "NAMES", ()), model.weights(), strict=True)]
        if "mid_w" in getattr(model, "NAMES", ()):
            model.past, model.rate = np.full(model.counted.shape, 1e-8, np.float32), rate

    def step(self, gradients: list) -> None:
        """Change the weights; the gradients are used up.

        Those of the weights that all words share are clipped together.
        """
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in gradients if not isinstance(g, tuple)))
        if norm > CLIP:
            gradients = [g if isinstance(g, tuple) else g * np.float32(CLIP / norm) for g in gradients]
        for x, g, v in zip(self.model.weights(), gradients, self.past, strict=True):
            rows = None
            if isinstance(g, tuple):
                rows, g = g
                rows = None if len(rows) == len(x) else rows
            if v.shape != x.shape:
                rows = slice(None) if rows is None else rows
                squares = v[rows]
                squares += (np.einsum("...j,...j->...", g, g) / g.dtype.type(g.shape[-1]))[..., None]
                v[rows] = squares
                g *= self.rate / np.sqrt(squares)
                x[rows] -= g
                continue
            squares = g * g
            if rows is None:
                v += squares
                np.sqrt(v, out=squares)
            else:
                squares += v[rows]
                v[rows] = squares
                np.sqrt(squares, out=squares)
            g /= squares
            g *= self.rate
            if rows is None:
                x -= g
            else:
                x[rows] -= g


def keep_heap() -> None:
    """Free one large array: malloc then takes all smaller ones from a heap that it keeps, where it would return pages after each step."""
    np.empty(8 << 20, np.uint8)


def train(model: GRU, documents_: Iterator[np.ndarray], lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> int:
    """Train on documents (places with the end) and return the tokens seen.

    Every lane reads one document after the other; its state goes on between
    windows and starts anew with a document, which begins a window. Lanes double
    while there are documents to read, and lanes without any go.
    """
    keep_heap()
    steps, seen, turns, most = Adagrad(model, rate), 0, 0, max(lanes, MOST_LANES)
    held = np.zeros(0, np.int32)  # tokens of the documents being read or waiting
    at, end, waiting = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), []
    fresh, h, more = np.zeros(lanes, bool), np.zeros((lanes, model.hidden), np.float32), True
    while True:
        free = np.flatnonzero(at >= end)
        if len(free) > len(waiting) and more:
            # A lane keeps the token before its place, as the next input.
            back = np.where(fresh | (at >= end), 0, 1)
            parts, size = [held[a - k : b] for a, b, k in zip(at, end, back, strict=True)], 0
            at, base = np.cumsum([0, *map(len, parts)])[:-1] + back, sum(map(len, parts))
            end = at - back + [len(p) for p in parts]
            todo = [held[a:b] for a, b in waiting]
            while size < WAITING or len(todo) < len(free):
                if (doc := next(documents_, None)) is None:
                    more = False
                    break
                todo.append(doc)
                size += len(doc)
            cuts = (base + np.cumsum([0, *map(len, todo)])).tolist()
            # Documents that take long in a lane go first, so that in the end few steps have few lanes.
            waiting = list(zip(cuts[:-1], cuts[1:], strict=True))
            if cuts[-1] > ENOUGH:
                long = cuts[-1] // (16 * most)
                waiting.sort(key=lambda w: max(w[1] - w[0], long), reverse=True)
            left, waiting = cuts[-1] - cuts[0], waiting[::-1]
            held = np.concatenate([*parts, *todo]) if parts or todo else held
        for lane in free[: len(waiting)].tolist():
            at[lane], end[lane] = waiting.pop()
            left -= int(end[lane] - at[lane])
            fresh[lane] = True
        if not more and not waiting and (at >= end).any():
            on = at < end
            at, end, fresh, h = at[on], end[on], fresh[on], h[on]
        if not len(at):
            model.past = None
            return seen
        places = at[:, None] + np.arange(window)
        here = places < end[:, None]
        targets = np.where(here, held[np.minimum(places, len(held) - 1)], -1)
        inputs = np.where(here, held[np.clip(places - 1, 0, len(held) - 1)], -1)
        inputs[fresh, 0] = -1
        begun = np.zeros((len(at), window), bool)
        begun[:, 0] = fresh
        gradients, h = model.gradients(inputs, targets, h, begun)
        steps.step(gradients)
        seen += int(here.sum())
        at, fresh, turns = np.minimum(at + window, end), np.zeros(len(at), bool), turns + 1
        if turns % WINDOWS == 0 and (more or left > ENOUGH) and len(at) < most:
            n = min(len(at), most - len(at))
            at, end = np.append(at, np.zeros(n, np.int64)), np.append(end, np.zeros(n, np.int64))
            fresh, h = np.append(fresh, np.zeros(n, bool)), np.concatenate([h, np.zeros((n, model.hidden), h.dtype)])


_PART, _ROWS = 1 << 14, 256


def _changes(width: int) -> np.dtype:
    """A changed row of words beyond HEAD: its place in the part, and the change in 8 bits."""
    return np.dtype([("i", "u1"), ("scale", "f4"), ("d", "i1", (width,))])


def _packed(rows: np.ndarray, change: np.ndarray) -> bytes:
    out = np.zeros(len(rows), _changes(change.shape[1]))
    scale = np.abs(change).max(1, initial=0) / 127
    out["i"], out["scale"] = rows, scale
    out["d"] = np.rint(change / np.maximum(scale, 1e-30)[:, None])
    return out.tobytes()


def _unpacked(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(packed, _changes(width))
    return x["i"], x["d"] * x["scale"][:, None]


def _averaged(found: DataFrame, model: GRU) -> int:
    """Load weights averaged by tokens seen, and return the tokens.

    Parts of the shared weights are averaged by part and lane first, then by part.
    Negative parts are changed rows, each averaged over those who changed it; they
    have one lane, so the second step leaves them as they are.
    """
    width = 2 * model.hidden + 1

    def mean(table):
        n = np.array(table.column("n"), dtype=np.float64)
        if table.column("part")[0].as_py() < 0:
            total, change = np.zeros(_ROWS), np.zeros((_ROWS, width), np.float32)
            for b, weight in zip(table.column("w").to_pylist(), n.tolist(), strict=True):
                i, d = _unpacked(b, width)
                total[i] += weight
                change[i] += d * np.float32(weight)
            some = np.flatnonzero(total)
            w = _packed(some, change[some] / total[some, None].astype(np.float32))
        else:
            rows = np.stack([np.frombuffer(b, np.float32) for b in table.column("w").to_pylist()])
            w = (rows * (n / n.sum())[:, None]).sum(0).astype(np.float32).tobytes()
        return pa.table({"part": table.column("part")[:1], "lane": pa.array([0], pa.int32()), "n": pa.array([int(n.sum())]), "w": pa.array([w], pa.binary())})

    schema = "part int, lane int, n long, w binary"
    rows = found.groupBy("part", "lane").applyInArrow(mean, schema).groupBy("part").applyInArrow(mean, schema).collect()
    if not rows:
        return 0
    flat, seen = model.flat(), 0
    for r in rows:
        if r.part >= 0:
            flat[r.part * _PART : r.part * _PART + len(r.w) // 4] = np.frombuffer(r.w, np.float32)
            seen = r.n
        else:
            i, d = _unpacked(r.w, width)
            at = (-1 - r.part) * _ROWS + i.astype(np.int64)
            model.tail_in[at] += d[:, : model.hidden]
            model.tail_out.reshape(-1, model.hidden + 1)[at] += d[:, model.hidden :]
    model.load(flat)
    return seen


def learn(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> GRU:
    """Rounds of training in all partitions and averaging; `seen` of the model is the tokens it learnt from."""
    model, sc = GRU(vocabulary), docs.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)
    chosen = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), F.lit(1_000_000)).alias("share"))
    copies = max(sc.defaultParallelism, min(plan_bytes(docs) // COPY_BYTES, 1 << 24))
    for turn in range(rounds):
        low, high = (int(1e6 * fraction * k / rounds) for k in (turn, turn + 1))
        shipped = sc.broadcast(model if turn else None)  # the first is made by its seed

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            mine, before = GRU(words.value), shipped.value
            tail = len(mine.NAMES) > len(mine.DENSE)
            if before is not None:
                mine.load(before.flat())
                if tail:
                    mine.tail_in[:], mine.tail_out[:] = before.tail_in, before.tail_out

            def places() -> Iterator[np.ndarray]:
                for batch in batches:
                    learnt = ~held_out(batch.column(0).to_pylist())
                    for _, _, data, offsets in ts.blocks(batch.column(1).filter(pa.array(learnt))):
                        hashes, bounds = token_hashes(data, offsets)
                        place, _ = words.value.look_up(hashes)
                        yield from np.split(place.astype(np.int32), bounds[1:-1])

            seen = train(mine, places())
            if seen:
                flat, lane = mine.flat(), TaskContext.get().partitionId() % 16
                found = [(k, lane, flat[k * _PART : (k + 1) * _PART].tobytes()) for k in range(-(-len(flat) // _PART))]
                for a in range(0, len(mine.tail_in) if tail else 0, _ROWS):
                    change = mine.tail_rows(a, a + _ROWS)
                    if before is not None:
                        change -= before.tail_rows(a, a + _ROWS)
                    if len(some := np.flatnonzero(change.any(1))):
                        found.append((-1 - a // _ROWS, 0, _packed(some, change[some])))
                for a in range(0, len(found), 64):
                    part, lanes, w = zip(*found[a : a + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lanes, pa.int32()), pa.array([seen] * len(part), pa.int64()), pa.array(w, pa.binary())], names=["part", "lane", "n", "w"])

        share = chosen.where((F.col("share") >= low) & (F.col("share") < high)).select("i", "t").coalesce(copies)
        model.seen += _averaged(share.mapInArrow(run, "part int, lane int, n long, w binary"), model)
        shipped.unpersist()
    return model


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, outside long, rare array<long>, times array<int>"
_SCORED_NAMES = [c.split()[0] for c in _SCORED.split(", ")]


def counted(vocabulary: Vocabulary, row: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Places of a block's tokens, their number by document, and the columns but for the model's part of the score."""
    hashes, bounds = hashes_of_blocks(data, offsets)
    place, count = vocabulary.look_up(hashes)
    n, logs = len(ids), np.log10(np.maximum(count, 0) + 1.0)
    doc, outside = np.repeat(np.arange(n), np.diff(bounds)), place == 0
    missing = np.flatnonzero(count < 0)
    order = missing[np.lexsort((hashes[missing], doc[missing]))]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(order))).astype(np.int32)
    cuts = np.searchsorted(doc[order[start]], np.arange(n + 1)).astype(np.int32)
    columns = {
        "row": pa.array(np.arange(row, row + n)), "doc_id": ids, "held_out": pa.array(held_out(ids.to_pylist())), "n_tokens": pa.array(np.diff(bounds)),
        "n_known": pa.array(ts.per_doc(count > 0, bounds)), "base": pa.array(np.bincount(doc, logs, n)),
        "model": np.bincount(doc[outside], logs[outside], n), "outside": pa.array(ts.per_doc(outside, bounds)),
        "rare": pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[order[start]].view(np.int64))), "times": pa.ListArray.from_arrays(pa.array(cuts), pa.array(times)),
    }
    return place.astype(np.int32), np.diff(bounds), columns


def score_documents(docs: DataFrame, rounds: int = ROUNDS, fraction: float = FRACTION, vocabulary_size: int = VOCABULARY, frequent: int = BROADCAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base score and the model's score, in log10."""
    counts = written(count_tokens(docs, id_col, text_col), "counts")
    vocabulary = build_vocabulary(counts, vocabulary_size, frequent)
    model, sc = learn(docs, vocabulary, rounds, fraction, id_col, text_col), docs.sparkSession.sparkContext
    words, shipped = sc.broadcast(vocabulary), sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        row, vocabulary, model = TaskContext.get().partitionId() << 40, words.value, shipped.value
        for batch in batches:
            held, size = [], 0
            for i, j, data, offsets in ts.blocks(batch.column(1), COUNTED_BYTES):
                held.append(counted(vocabulary, row, batch.column(0).slice(i, j - i), data, offsets))
                row, size = row + j - i, size + len(data)
                if size >= SCORED_BYTES or j == len(batch):
                    scores = model.score(np.concatenate([p for p, _, _ in held]), np.cumsum(np.concatenate([[0], *(n for _, n, _ in held)])))
                    for _, n, columns in held:
                        mine, scores = scores[: len(n)], scores[len(n) :]
                        columns["model"] = pa.array(mine + columns["model"])
                        yield pa.RecordBatch.from_arrays([columns[c] for c in _SCORED_NAMES], names=_SCORED_NAMES)
                    held, size = [], 0

    scored = written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    more, n = F.coalesce("more", F.lit(0.0)), F.col("n_tokens")
    return scored.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - n * vocabulary.base_log).alias("base_score"), (F.col("model") + more - F.col("outside") * vocabulary.outside_log).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
