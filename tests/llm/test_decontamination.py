import hashlib
import random
from collections import Counter

import pytest

from lexiforge.llm import decontamination as dc

from .cases import SCHEMA, TEXTS, alnum_words, rows, same_rows

ITEM = "item_id long, text string, lang string"


def brute(text, items):
    words = alnum_words(text)
    hit, met = set(), set()
    for name, t in items:
        w = alnum_words(t)
        if name is None or not w:
            continue
        n = min(10, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                met.add(str(name))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["Été", "l’été"]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([10, 11, 30, 3, 9, 1, 200, 12])]
    items += [(None, "a b c"), (20, None), (21, "..."), (2, "twice the same id in these words here for all times"), (6, items[6][1])]
    texts = list(TEXTS)
    for _ in range(60):
        body = rng.choices(vocabulary, k=rng.randrange(0, 60))
        w = items[rng.randrange(8)][1].split()
        a = rng.randrange(len(w))
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + [x.upper() + ",;!"[a % 3] for x in w[a : a + rng.randrange(5, 20)]] + body[at:]))
    return texts, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 0])
def test_equals_brute_force(spark, monkeypatch, block_bytes):
    texts, items = corpus()
    df = spark.createDataFrame(rows(texts) + rows(texts[:5]), SCHEMA)
    if block_bytes == 0:  # with a map this small most of what passes is no item's
        monkeypatch.setattr(dc, "MAP_BITS", 1 << 8)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEM)
    got = dc.contamination(df, bench, block_bytes=block_bytes).collect()
    want = Counter((i, *brute(t, items)) for k in (texts, texts[:5]) for i, t in enumerate(k))
    assert Counter(tuple(r[:6]) for r in got) == want
    assert sum(r.contaminated for r in got) > 20
    clean = dc.drop_contaminated(df, bench, block_bytes=block_bytes)
    assert clean.schema == df.schema
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in got if not r.contaminated)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    df = spark.createDataFrame(rows(), SCHEMA)
    assert all(not r.contaminated and r.n_words == len(alnum_words(TEXTS[r.doc_id])) for r in dc.contamination(df, none).collect())
    assert dc.contamination(df.limit(0), none).count() == 0
    assert dc.drop_contaminated(df, none).count() == len(TEXTS)
    assert dc.contamination(df, none, block_bytes=-1).where("contaminated").count() == 0 and dc.drop_contaminated(df, none, block_bytes=-1).count() == len(TEXTS)


def test_rows_without_id_and_clashing_columns(spark):
    item = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(None, item, 1, "x"), (None, "clean text here", 2, "y"), (3, item + " more", 3, "z")], "doc_id long, text string, k1 long, _k2 string")
    bench = spark.createDataFrame([(1, item, "x")], ITEM)
    for block_bytes in (1 << 20, 0):
        got = {(r.doc_id, r.n_words): r.n_hit for r in dc.contamination(df, bench, block_bytes=block_bytes).collect()}
        assert got == {(None, 12): 12, (None, 3): 0, (3, 13): 12}
        kept = dc.drop_contaminated(df, bench, block_bytes=block_bytes)
        assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(None, "clean text here", 2, "y")]


def test_query_equals_its_sql(spark, tmp_path):
    texts, items = corpus()
    same_rows(spark, tmp_path, dc.op4_decontamination, dc.ORACLE, documents=(rows(texts) + rows(texts[:5]), SCHEMA), benchmark=([(i, t, "x") for i, t in items], ITEM))
