import random
from collections import Counter

import pytest

from lexiforge.llm import shared
from lexiforge.operators import stored


@pytest.mark.parametrize("small", [0, 1 << 20])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("binary", [False, True])
def test_single_partners_with_hot_and_null_keys(spark, monkeypatch, small, how, binary):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", small)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.1)
    rng = random.Random(3)
    said = (lambda k: None if k is None else k.to_bytes(16, "big")) if binary else (lambda k: k)
    keys = [rng.choice([7, 7, 7, 9, None, None, rng.randrange(100, 140)]) for _ in range(400)]
    count = Counter(k for k in keys if k is not None and k % 3)
    rows = spark.createDataFrame([(said(k), i) for i, k in enumerate(keys)], f"k {'binary' if binary else 'long'}, i long")
    singles = shared.written(spark.createDataFrame([(said(k), n, f"v{k}") for k, n in count.items()], f"k {'binary' if binary else 'long'}, n long, v string"), "singles")
    got = shared.join_singles(rows, singles, ["k"], ["i"], how)
    want = [(i, f"v{k}" if k in count else None) for i, k in enumerate(keys) if how == "left" or k in count]
    assert sorted(got.columns) == ["i", "k", "v"] and sorted(map(tuple, got.select("i", "v").collect())) == want


def test_scratch_deletes_what_is_not_kept(spark):
    with stored.scratch():
        gone = stored.stored(spark.range(3), "gone")
        with stored.scratch():
            kept = stored.stored(spark.range(4), "kept", keep=True)
            inner = stored.stored(spark.range(5), "inner")
        assert inner._stored_in not in stored._MADE and gone.count() == 3
    assert gone._stored_in not in stored._MADE and kept.count() == 4
    stored.released(kept)
    assert kept._stored_in not in stored._MADE


def test_free_name(spark):
    df = spark.createDataFrame([(1, 2)], "x int, X_ int")
    assert shared.free_name(df, "x") == "x__" and shared.free_name(df, "y") == "y"
