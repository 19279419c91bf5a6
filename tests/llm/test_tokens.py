import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.llm import packing, token_output
from lexiforge.llm import textscan as ts
from lexiforge.llm.tokens import Encoder, _load, default_path

from .cases import SCHEMA, TEXTS, rows

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ENCODERS = {f: Encoder(default_path(f), cache_entries=50) for f in FILES}
WHOLE = {f: _load(default_path(f)) for f in FILES}
ODD = [" lead", "trail  ", "a   b", "a\n\n\nb", "a \nb", "x  y", "<|endoftext|> it's don't 'S", "J̌İ ΟΔΟΣ ", "a,.b ,. 12,5 foo***", "\n", "  ", "résumé.", "a\x1cb\x85c", "​  x"]


def encoded(name, texts):
    out = []
    for _, _, data, offsets in ts.blocks(pa.array(texts, pa.string()), 100):
        ids, bounds = ENCODERS[name].encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def wanted(name, texts):
    return [WHOLE[name].encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    texts = [t for t in TEXTS if t is None or len(t) < 10_000] + ODD
    assert encoded(name, texts) == wanted(name, texts)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.text(alphabet="aB. ,\n\t' ́s1*é", max_size=20)), max_size=5))
def test_ids_on_random_texts(name, texts):
    assert encoded(name, texts) == wanted(name, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.just(2**60 - 1)), max_size=400), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    assert (token_output.decode(token_output.encode(values, block)) == values).all()


def test_simple8b_runs():
    values = np.concatenate([np.zeros(5000), np.ones(3000), np.random.default_rng(0).integers(0, 50_000, 30_000)]).astype(np.uint64)
    coded = token_output.encode(values)
    assert (token_output.decode(coded) == values).all() and len(coded) < 2.9 * 30_000 + 2000
    assert len(token_output.decode(token_output.encode(values[:0]))) == 0
    with pytest.raises(ValueError):
        token_output.decode(b"nothing of this kind")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    shuffled = rows() + [(3, "another", None, None, None, None, None), (None, "no id", None, None, None, None, None)]
    random.Random(2).shuffle(shuffled)
    path = str(tmp_path / "ids")
    df = spark.createDataFrame(shuffled, SCHEMA)
    token_output.write_token_ids(df, path, default_path(FILES[0]), partitions=3)
    got = sorted(token_output.digest_token_ids(spark, path).collect(), key=lambda r: r.start)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    in_order = sorted(shuffled, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    start = 0
    for r, (i, t, *_) in zip(got, in_order, strict=True):
        ids = wanted(FILES[0], [t])[0] + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
    one = {r.doc_id: r.ids for r in token_output.read_token_ids(spark, path).collect()}
    assert one[4] == wanted(FILES[0], [TEXTS[4]])[0] + [2]
    token_output.write_token_ids(df.limit(0), path + "0", default_path(FILES[0]))
    assert token_output.digest_token_ids(spark, path + "0").count() == 0


def test_a_hot_id_fills_several_shards(spark, tmp_path, monkeypatch):
    path, texts = str(tmp_path / "hot"), ["same text"] * 300 + [f"text {k}" for k in range(100)]
    df = spark.createDataFrame([(7, t) for t in texts] + [(None, "none")] * 50 + [(9, "last")], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(token_output, "SHARD_BYTES", 500)
    token_output.write_token_ids(df, path, default_path(FILES[0]))
    by_shard = {r.shard: r.n for r in spark.read.parquet(path).groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()}
    assert len(by_shard) >= 6 and max(by_shard.values()) < 200
    got = sorted(token_output.digest_token_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 50 + [7] * 400 + [9]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert Counter(r.ids_crc32 for r in got) == Counter(crc(x + [2]) for x in wanted(FILES[0], texts + ["none"] * 50 + ["last"]))


def brute_cost(place, penalty, size):
    places, best = [0, *place], [0.0]
    for j in range(1, len(places)):
        best.append(penalty[j - 1] + min(best[i] + size - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= size))
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 5)), min_size=1, max_size=60))
def test_cuts_are_the_cheapest(steps):
    place, penalty = np.cumsum([a for a, _ in steps]), np.array([float(b) for _, b in steps])
    cuts = packing.best_cuts(place, penalty, 10)
    at = dict(zip(place.tolist(), penalty.tolist(), strict=True))
    cost = sum(10 - (b - a) + at[b] for a, b in zip([0, *cuts], cuts, strict=False))
    assert cost == brute_cost(place.tolist(), penalty.tolist(), 10) and cuts[-1] == place[-1]


def check_pieces(got, docs, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for name, ids in docs.items():
        at = 0
        for r in sorted(by_doc[name], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return sum(map(len, docs.values())), len(by_sequence)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.sampled_from([20, 60, 1000]))
def test_packer(sizes, stretch):
    is_end = np.zeros(100, np.uint8)
    is_end[::7] = 1
    is_end[::5] |= 2
    rng = np.random.default_rng(len(sizes))
    docs = {i: rng.integers(0, 100, n).tolist() for i, n in enumerate(sizes)}
    packer, got = packing.Packer(is_end, 5 << 40, size=16, stretch=stretch), []
    for i, ids in docs.items():
        for b in packer.add(i, np.array(ids, np.uint32)):
            got += b.to_pylist()
    for b in packer.flush(True):
        got += b.to_pylist()
    check_pieces(got, docs, 16)


def test_pack_tables(spark):
    path = default_path(FILES[1])
    df = spark.createDataFrame(rows(), SCHEMA)
    got = [r.asDict() for r in packing.pack(df, path).collect()]
    docs = {i: x + [1] for i, x in enumerate(wanted(FILES[1], TEXTS))}
    check_pieces(got, docs, 2048)
    assert packing.pack(df.limit(0), path).count() == 0
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(df, path)
    total, full = sum(r.length for r in got.collect()), got.select("sequence_id").distinct().count()
    assert total / (full * 2048) > 0.98


def test_vocabulary_files_are_as_expected():
    for f in FILES:
        with open(default_path(f), encoding="utf-8") as x:
            assert json.load(x)["model"]["type"] == "BPE"
