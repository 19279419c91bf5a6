import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import language_model as lm

from .cases import SCHEMA, TEXTS, lower, rows, space_words


def small_vocabulary():
    n = 100
    unigram = np.zeros(128, np.int64)
    unigram[: n + 1] = np.arange(n + 1, 0, -1)
    return lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 128, unigram, int(unigram.sum()), n, 5, 3)


def test_probabilities_sum_to_one():
    model = lm.GRU(small_vocabulary(), 6)
    state = np.random.default_rng(0).standard_normal((1, 6)).astype(np.float32)
    logs = [model.log_probability(state, np.array([k]))[0] for k in range(128)]
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_score_carries_the_state():
    model, rng = lm.GRU(small_vocabulary(), 6), np.random.default_rng(1)
    docs = [rng.integers(0, 128, n) for n in (5, 1, 700, 33)]
    bounds = np.cumsum([0, *map(len, docs)])
    got = model.score(np.concatenate(docs), bounds, step_rows=50)
    for d, g in zip(docs, got, strict=True):
        h, x, total = np.zeros((1, 6), np.float32), model.b[None], 0.0
        for y in d.tolist():
            z, _, c, _ = model.gates(x, h)
            h = c + z * (h - c)
            total += model.log_probability(h, np.array([y]))[0]
            x = model.table()[[y]]
        assert abs(g - total / math.log(10)) < 1e-3 * len(d)


def test_gradients_equal_differences():
    model, rng = lm.GRU(small_vocabulary(), 4), np.random.default_rng(2)
    for name, x in zip(model.NAMES, model.weights(), strict=True):
        setattr(model, name, x.astype(np.float64))
    targets = rng.integers(0, 128, (3, 5))
    targets[2, 3:] = -1
    inputs = np.concatenate([np.full((3, 1), -1), targets[:, :-1]], 1)
    fresh = np.zeros((3, 5), bool)
    fresh[:, 0] = fresh[1, 3] = True
    inputs[1, 3] = -1
    h0 = np.zeros((3, 4))

    def loss():
        h, total, n = h0, 0.0, 0
        for t in range(5):
            h = np.where(fresh[:, t : t + 1], 0, h)
            x = np.where(inputs[:, t : t + 1] < 0, model.b, model.table()[np.maximum(inputs[:, t], 0)])
            z, _, c, _ = model.gates(x, h)
            h = c + z * (h - c)
            ok = targets[:, t] >= 0
            total -= model.log_probability(h[ok], targets[ok, t]).sum()
            n += ok.sum()
        return total / n

    gradients, _ = model.gradients(inputs, targets, h0, fresh)
    for name, x, g in zip(model.NAMES, model.weights(), gradients, strict=True):
        if isinstance(g, tuple):
            whole = np.zeros_like(x)
            whole[g[0]] = g[1]
            g = whole
        flat, flat_g = x.reshape(-1), np.asarray(g).reshape(-1)
        for k in rng.choice(x.size, 12):
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            down = loss()
            flat[k] = was
            assert flat_g[k] == pytest.approx((up - down) / 2e-5, abs=2e-5), name


def test_training_learns():
    model = lm.GRU(small_vocabulary(), 16)
    rng = np.random.default_rng(3)
    docs = [np.tile([a, a + 1, a + 2, a + 3], 12) for a in rng.integers(1, 60, 300)]
    held = [np.tile([a, a + 1, a + 2, a + 3], 12) for a in (3, 20, 41)]
    bounds, flat = np.arange(4) * 48, np.concatenate(held)
    before = model.score(flat, bounds).sum()
    assert lm.train(model, iter(docs), lanes=8, rate=0.1) == 300 * 48
    assert model.score(flat, bounds).sum() > 0.6 * before


def brute(table):
    tokens = [(i, [*space_words(lower(t)), None]) for i, t in table]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in table]
    count = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted((i, h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for (i, ws), h in zip(tokens, held, strict=True))


@pytest.mark.parametrize("frequent", [20, 1 << 18])
def test_base_equals_brute_force(spark, frequent):
    texts = TEXTS + [f"some words {k} and {k % 3} THE the Ünd ünd" for k in range(30)]
    df = spark.createDataFrame(rows(texts) + rows(texts[:4]), SCHEMA)
    got = lm.score_documents(df, vocabulary_size=64, frequent=frequent).collect()
    assert sorted((*r[:5], round(r.base_score, 5)) for r in got) == brute([(r[0], r[1]) for r in rows(texts) + rows(texts[:4])])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_and_all_held_out(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    df = spark.createDataFrame([(i, "a b", None, None, None, None, None) for i in held], SCHEMA)
    got = lm.score_documents(df).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0)] * 2


def test_held_out_documents_beat_the_base(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fraction=0.25).where("held_out").collect()
    assert sum(r.score for r in got) > 0.985 * sum(r.base_score for r in got)
    print("score against base:", sum(r.score for r in got) / sum(r.base_score for r in got))


def test_learns_from_every_training_document(spark):
    """At the defaults: all training tokens are learnt from, and held-out documents gain."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocabulary = lm.build_vocabulary(lm.count_tokens(docs))
    assert lm.learn(docs, vocabulary).seen == vocabulary.total
    got = lm.score_documents(docs).where("held_out").collect()
    assert sum(r.score for r in got) > 0.985 * sum(r.base_score for r in got)
    print("score against base:", sum(r.score for r in got) / sum(r.base_score for r in got))


def test_lanes_that_grow_read_every_token_once():
    class Seen:
        hidden = 1

        def weights(self):
            return []

        def gradients(self, inputs, targets, h, fresh):
            for x, y, f in zip(inputs, targets, fresh, strict=True):
                ok = y >= 0
                assert not f[1:].any() and (ok[:-1] >= ok[1:]).all()
                read.extend(zip(x[ok].tolist(), y[ok].tolist(), strict=True))
            return [], h

    read, rng = [], np.random.default_rng(4)
    docs = [rng.integers(0, 1000, n) for n in [*rng.integers(1, 90, 3000), 5000]]
    assert lm.train(Seen(), iter(docs), lanes=4) == sum(map(len, docs))
    assert Counter(read) == Counter((a, b) for d in docs for a, b in zip([-1, *d[:-1].tolist()], d.tolist(), strict=True))


def large_vocabulary():
    """4096 words of plain classes and 8192 more, of which the last are padding."""
    unigram = np.zeros(4096 * 3, np.int64)
    unigram[:12_001] = 1 + 100_000 // np.arange(1, 12_002)
    return lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 4096 * 3, unigram, int(unigram.sum()), 12_000, 5, 3)


def test_words_beyond_plain_classes():
    model, rng = lm.GRU(large_vocabulary(), 4), np.random.default_rng(6)
    for name, x in zip(model.NAMES, model.weights(), strict=True):
        setattr(model, name, x.astype(np.float64) + (rng.standard_normal(x.shape) * 0.1 if name[:4] in ("tail", "mid_") else 0))
    state = rng.standard_normal((1, 4))
    logs = model.log_probability(np.repeat(state, 4096 * 3, 0), np.arange(4096 * 3))
    assert abs(np.exp(logs).sum() - 1) < 1e-5
    targets = np.array([[9, 4100, 12_000, 4101, 9000], [4100, 70, 8191, 8192, 4100]])
    inputs = np.concatenate([np.full((2, 1), -1), targets[:, :-1]], 1)
    fresh = np.array([[True] + [False] * 4] * 2)

    def loss():
        h, total = np.zeros((2, 4)), 0.0
        for t in range(5):
            x = np.where(inputs[:, t : t + 1] < 0, model.b, model.read(np.maximum(inputs[:, t], 0)) @ model.w + model.b)
            z, _, c, _ = model.gates(x, h)
            h = c + z * (h - c)
            total -= model.log_probability(h, targets[:, t]).sum()
        return total / 10

    gradients, _ = model.gradients(inputs, targets, np.zeros((2, 4)), fresh)
    for name, x, g in zip(model.NAMES, model.weights(), gradients, strict=True):
        rows, g = g if isinstance(g, tuple) else (np.arange(len(x)), g)
        for k in rng.choice(g.size, min(12, g.size), replace=False):
            at = np.unravel_index(k, g.shape)
            place = (rows[at[0]], *at[1:])
            was = x[place]
            x[place] = was + 1e-5
            up = loss()
            x[place] = was - 1e-5
            down = loss()
            x[place] = was
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-5), name


def test_vocabulary_grows_with_the_counts(spark):
    """Words beyond the 4096 most frequent have outputs of their own, which learn."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = lm.count_tokens(docs)
    vocabulary = lm.build_vocabulary(counts)
    assert vocabulary.size > 4096 and vocabulary.outside_distinct == counts.where("c < 8").count()
    model = lm.learn(docs, vocabulary)
    assert np.abs(model.tail_in).max() > 0 and np.abs(model.tail_out).max() > 0


def test_a_long_document_is_read_beside_others():
    """It goes first, although it comes last, so that few steps have few lanes."""

    class Lanes:
        hidden = 1

        def weights(self):
            return []

        def gradients(self, inputs, targets, h, fresh):
            lanes.append(len(inputs))
            return [], h

    lanes = []
    docs = [np.arange(16)] * 60_000 + [np.arange(16 * 150)]
    assert lm.train(Lanes(), iter(docs)) == sum(map(len, docs))
    assert len(lanes) <= 340 and sum(n < 64 for n in lanes) < 10


def test_copies_learn_from_enough(spark, monkeypatch):
    """Many small partitions don't each send a model."""
    sent, averaged = [], lm._averaged
    monkeypatch.setattr(lm, "_averaged", lambda found, model: sent.append(found.rdd.getNumPartitions()) or averaged(found, model))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(60)
    vocabulary = lm.build_vocabulary(lm.count_tokens(df), 64)
    assert lm.learn(df, vocabulary).seen == vocabulary.total
    assert max(sent) <= max(spark.sparkContext.defaultParallelism, 1)


def test_large_logits():
    p = np.random.default_rng(8).standard_normal((5, 16)) * [[1], [30], [200], [5000], [1]]
    p[4] -= 9000
    said = np.arange(5)
    want = p - p.max(1, keepdims=True)
    want = want[said, said] - np.log(np.exp(want).sum(1))
    assert np.allclose(lm._log_softmax(p.astype(np.float32), said), want, rtol=1e-4, atol=1e-3)


def test_look_up_by_first_bits():
    rng = np.random.default_rng(9)
    near = np.uint64(7 << 60) + np.arange(40, dtype=np.uint64)  # all of the same first bits
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 500, np.uint64), near, [np.uint64(0), ~np.uint64(0)]]))
    place, counts = rng.permutation(len(keys)), rng.integers(1, 99, len(keys))
    v = lm.Vocabulary(keys, counts, place, 64, np.zeros(64, np.int64), 0, 0, 0, 0)
    asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 5000, np.uint64)])
    said = {k: (p, c) for k, p, c in zip(keys.tolist(), place.tolist(), counts.tolist(), strict=True)}
    assert list(zip(*(x.tolist() for x in v.look_up(asked)), strict=True)) == [said.get(k, (0, -1)) for k in asked.tolist()]
    assert len(v.by_first_bits[0]) > len(keys) and "by_first_bits" not in pickle.loads(pickle.dumps(v)).__dict__


def test_nodes_learn_as_their_gradients_say():
    """Where gradients are made, rows of nodes take the step of Adagrad with one scale a row."""
    rng = np.random.default_rng(10)
    model, same = lm.GRU(large_vocabulary(), 4), lm.GRU(large_vocabulary(), 4)
    targets = np.concatenate([rng.integers(4096, 12_000, (30, 4)), np.full((30, 2), 4100), np.full((30, 1), 7)], 1)
    inputs, fresh = np.concatenate([np.full((30, 1), -1), targets[:, :-1]], 1), np.zeros((30, 7), bool)
    steps = lm.Adagrad(same, 0.05)
    for _ in range(2):
        gradients, _ = model.gradients(inputs, targets, np.zeros((30, 4), np.float32), fresh)
        found = dict(zip(model.NAMES, gradients, strict=True))
        if model.seen == 0:
            past = {n: np.full(getattr(model, n).shape[:2], steps.model.past[0, 0]) for n in ("mid_w", "tail_out")}
            model.seen = 1
        for name, rate in (("mid_w", 0.05 * lm.MID_RATE), ("tail_out", 0.05)):
            rows, g = found[name]
            past[name][rows] += (g * g).mean(2)
            getattr(model, name)[rows] -= rate * g / np.sqrt(past[name][rows])[..., None]
        same.gradients(inputs, targets, np.zeros((30, 4), np.float32), fresh)
        assert np.abs(model.mid_w).max() > 0 and np.abs(model.tail_out).max() > 0
        assert np.allclose(model.mid_w, same.mid_w, atol=1e-5) and np.allclose(model.tail_out, same.tail_out, atol=1e-5)


def test_classes_of_a_large_vocabulary_are_few():
    """Trees of rare words are children of classes, so that each token's first softmax stays short."""
    unigram = 1 + 10_000_000 // np.arange(1, lm.VOCABULARY + 1)
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), lm.VOCABULARY, unigram, int(unigram.sum()), lm.VOCABULARY, 0, 0)
    model = lm.GRU(v, 2)
    assert len(model.class_b) <= 72
    rare = np.array([5000, 100_000, lm.VOCABULARY - 1])
    shares = np.exp(model.log_probability(np.zeros((3, 2), np.float32), rare))
    assert np.allclose(shares, (unigram[rare] + 0.5) / (unigram + 0.5).sum(), rtol=1e-3)


def test_blocks_are_counted_apart_and_scored_together():
    model, texts = small_vocabulary(), pa.array(["a b a", "", None, "c  D d", "x" * 50, "a"], pa.large_string())
    data, offsets = lm.ts.text_buffers(texts)
    place, n, whole = lm.counted(model, 0, pa.array(range(6)), data, offsets)
    parts = [lm.counted(model, i, pa.array(range(i, j)), d, o) for i, j, d, o in lm.ts.blocks(texts, 6)]
    assert len(parts) > 2 and np.concatenate([p for p, _, _ in parts]).tolist() == place.tolist() and n.tolist() == [4, 1, 1, 4, 2, 2]
    for name in whole:
        assert [x for _, _, c in parts for x in c[name].tolist()] == whole[name].tolist()
