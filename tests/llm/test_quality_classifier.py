import random
import zlib

import numpy as np

from lexiforge.llm import quality_classifier as qc

from .cases import SCHEMA, rows

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in qc.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([(r.predicted == q) for q, r in truth]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_odd_tables(spark):
    df = spark.createDataFrame([*rows(), *rows()[:3], (None, "no id at all", None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 0, 1), (5, None, 0), (None, 1, 0), (99, 1, 0), (0, 1, 0)], LABELS)
    got = qc.score_quality(df, labels).collect()
    assert len(got) == 17 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in qc.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert qc.score_quality(df.limit(0), labels).count() == 0


def test_vote_equals_brute_force():
    rng = np.random.default_rng(3)
    known, labels = qc.unit(rng.standard_normal((300, 8))), rng.integers(0, 2, 300).astype(np.float32)
    vectors = qc.unit(rng.standard_normal((70, 8)))
    got = qc.vote(vectors, known, labels, 5, 2.0, block=16)
    for v, g in zip(vectors, got, strict=True):
        cosine = known @ v
        near = sorted(range(300), key=lambda i: -cosine[i])[:5]
        weights = [cosine[i] ** 2 for i in near]
        assert abs(g - sum(w * labels[i] for w, i in zip(weights, near, strict=True)) / sum(weights)) < 1e-9


def test_features_of_a_block_equal_those_of_each_text():
    from lexiforge.llm import textscan as ts
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choices("ab É|.\n", k=rng.randrange(0, 30))) for _ in range(40)]
    (_, _, data, offsets), = ts.blocks(pa.array(texts))
    together = qc.features(data, offsets)
    for t, row in zip(texts, together, strict=True):
        (_, _, d, o), = ts.blocks(pa.array([t]))
        if len(d) >= 4:
            assert (qc.features(d, o)[0] == row).all()
