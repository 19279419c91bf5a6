import random

import numpy as np
import pytest

from lexiforge.llm import near_dedup as nd
from lexiforge.llm import shared
from lexiforge.llm.components import connected_components

from .cases import SCHEMA, TEXTS, lower, rows, same_rows, space_words


def brute(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = space_words(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in sets]


def corpus(seed, copies):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = list(TEXTS) + ["Same short", "same SHORT", "same"]
    for _ in range(3):
        base = rng.choices(vocabulary, k=80)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [" ".join(rng.choices(vocabulary, k=50)) for _ in range(10)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "percent", "tile", "tile_bytes", "small"), [(3, 85, 1024, 4000, 0), (5, 80, 8, 1 << 20, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, n, percent, tile, tile_bytes, small):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", small)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.02)
    monkeypatch.setattr(nd, "TILE", tile)
    monkeypatch.setattr(nd, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(nd, "SALT", 10)
    texts = corpus(n, 60)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = sorted(map(tuple, nd.near_duplicates(df, n, percent).collect()))
    assert got == brute(texts, n, percent)
    kept = nd.drop_near_duplicates(df, n, percent)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in got if r[3]]


def test_query_equals_its_sql(spark, tmp_path):
    same_rows(spark, tmp_path, nd.op2_near_dedup, nd.ORACLE, documents=(rows(corpus(7, 20)) + [(None, TEXTS[4], None, None, None, None, None)], SCHEMA))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, "one two three four five six", "x", k) for k in range(3)], "doc_id long, text string, _gone string, h long")
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(0, "one two three four five six", "x", 0)]


def test_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(df).count() == 0
    text = "one two three four five six"
    df = spark.createDataFrame(rows([text, text]) + rows([text]) + [(None, text, None, None, None, None, None)], SCHEMA)
    got = nd.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(0, 0, True), (0, 0, True), (1, 0, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert dict(map(tuple, got.collect())) == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minima_estimate_similarity():
    x = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    s = nd.signatures(np.concatenate([x[:3000], x[1000:]]), np.array([0, 3000, 6000]))
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
