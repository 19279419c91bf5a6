import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from lexiforge.llm import quality_rules as qr
from lexiforge.llm import textscan as ts

from .cases import SCHEMA, TEXTS, rows, same_rows, space_words


def brute(text):
    text = text or ""
    words = space_words(text)
    lines = [x for x in text.split("\n") if space_words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def stats(texts):
    out = []
    for _, _, data, offsets in ts.blocks(pa.array(texts, pa.string()), 64):
        b = qr.Block(data, offsets)
        out += zip(b.n_words, b.word_chars(), b.symbols(), b.dup_lines(), b.repeat_words(), strict=True)
    return [tuple(map(int, x)) for x in out]


def test_statistics_equal_brute_force():
    assert stats(TEXTS) == [brute(t)[:5] for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té|", max_size=60), max_size=8))
def test_statistics_on_random_texts(texts):
    assert stats(texts) == [brute(t)[:5] for t in texts]


def test_report(spark):
    df = spark.createDataFrame(rows() + rows(), SCHEMA)
    got = qr.quality_report(df).collect()
    want = Counter((i, *brute(t)) for i, t in enumerate(TEXTS) for _ in range(2))
    assert Counter(tuple(r[:7]) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert 10 in kept and not {8, 9, 12} & kept


def test_empty_table_and_filter(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert qr.quality_report(df).count() == 0
    assert qr.keep_quality(df).schema == df.schema
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = qr.keep_quality(df)
    assert kept.schema == df.schema
    want = {r.doc_id for r in qr.quality_report(df).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want


def block_of(texts):
    (_, n, data, offsets), *_ = ts.blocks(pa.array(texts, pa.string()), 1 << 30)
    return qr.Block(data, offsets), np.ones(n, bool)


def test_order_never_changes_the_verdict():
    block, alive = block_of([t for t in TEXTS if t])
    one = qr.cascade(block, list(qr.DEFAULT_RULES), alive)
    assert (one == qr.cascade(block, list(qr.DEFAULT_RULES)[::-1], alive)).all()
    assert qr.ordered(list(qr.DEFAULT_RULES), {"capitals": (1.0, 0.5), "symbols": (1.0, 0.1)})[0].name == "capitals"


def test_rules_see_survivors_only():
    seen = []

    def counting(rule):
        def rejects(block):
            seen.append((rule.name, len(block)))
            return rule.rejects(block)

        return qr.Rule(rule.name, rejects)

    texts = ["word " * 20, "### $$$ *** ### $$$", "A B C D E F", "fine words in here " * 3] * 100
    judge = qr.Cascade([counting(r) for r in (qr.capitals_rule(), qr.symbol_rule(), qr.stutter_rule())], sample_rows=400)
    block, alive = block_of(texts)
    first = judge.keeps(block, alive)
    assert [n for _, n in seen] == [400] * 3
    seen.clear()
    again = judge.keeps(*block_of(texts))
    assert (first == again).all() and again.tolist() == [False, False, False, True] * 100
    assert [n for _, n in seen] == [400, 300, 200]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abA \n\té|", max_size=40), min_size=1, max_size=8), st.data())
def test_part_of_a_block(texts, data):
    block, _ = block_of(texts)
    some = sorted(data.draw(st.sets(st.integers(0, len(texts) - 1))))
    if data.draw(st.booleans()):
        assert len(block.n_words)
    part, own = block.only(np.array(some, np.int64)), None
    if some:
        own, _ = block_of([texts[i] for i in some])
        for f in ("word_chars", "symbols", "repeat_words"):
            assert getattr(part, f)().tolist() == getattr(own, f)().tolist()
        assert part.n_words.tolist() == own.n_words.tolist() and part.data.tobytes() == own.data.tobytes()
    else:
        assert len(part) == 0


def test_query_equals_its_sql(spark, tmp_path):
    same_rows(spark, tmp_path, qr.op3_quality_rules, qr.ORACLE, documents=(rows() + rows(), SCHEMA))
