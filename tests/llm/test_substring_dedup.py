import random
import re
from collections import Counter

from lexiforge.llm import shared
from lexiforge.llm import substring_dedup as sd

from .cases import SCHEMA, TEXTS, lower, rows, same_rows


def brute(table, least=20, context=8):
    seen, texts = {}, []
    for i, text in dict.fromkeys(table):
        at, units, words = 0, [], []
        for unit in re.split(r"\n|(?<=[.!?]) ", text or ""):
            found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", unit)]
            if found:
                units.append((at + found[0][0], at + found[-1][1], len(found), len(words)))
                words += [lower(unit[a:b]) for a, b in found]
            at += len(unit) + 1
        texts.append((i, [(a, b, n, tuple(words[k : k + max(n, context)])) for a, b, n, k in units]))
    for i, a, said in sorted((i, a, said) for i, units in texts for a, _, _, said in units):
        seen.setdefault(said, (i, a))
    out = Counter()
    for i, units in texts:
        run = []
        for a, b, n, said in [*units, (0, 0, 0, None)]:
            if said is not None and (i, a) != seen[said]:
                run.append((i, a, b, n, *seen[said]))
                continue
            if sum(u[3] for u in run) >= least:
                out.update(run)
            run = []
    return out


def texts():
    rng = random.Random(8)
    parts = ["One two three four five six seven eight.", "one  two three FOUR five six\tseven eight.", "Été un deux trois quatre cinq six sept huit!", "short one.", "\n", "a b c d e f g h i j k?", "tail without an end of at least eight words"]
    return TEXTS + [rng.choice([" ", ""]).join(rng.choices([p + " " for p in parts], k=rng.randrange(0, 8))) for _ in range(60)]


def test_equals_brute_force(spark, monkeypatch):
    table = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in table + table[20:40]] + [(None, TEXTS[6], None, None, None, None, None)], SCHEMA)
    for small, hot in ((1 << 20, 1e-4), (0, 1e-4), (0, 0.05), (0, 2.0)):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", small)
        monkeypatch.setattr(shared, "HOT_SHARE", hot)
        got = Counter(map(tuple, sd.repeated_units(df).collect()))
        assert got == brute(table) and len(got) > 50
    assert Counter(map(tuple, sd.repeated_units(df, 8, 3).collect())) == brute(table, 8, 3)


def test_query_equals_its_sql(spark, tmp_path):
    same_rows(spark, tmp_path, sd.op8_substring_dedup, sd.ORACLE, documents=(rows(texts()) + rows(texts()[:5]) + [(None, TEXTS[6], None, None, None, None, None)], SCHEMA))


def test_lone_sentences_stay_and_passages_go(spark):
    passage = "Alpha beta gamma delta one two three four five. Yes. So it went on for a good while longer here! No. Then all of them left the house by the back door."
    table = [f"First words of a text. {passage} Its own end of some more words.", f"Another beginning here, {passage} And another end.", "Own. Alpha beta gamma delta one two three four five. Other."]
    got = sd.repeated_units(spark.createDataFrame(rows(table), SCHEMA)).collect()
    assert {r.doc_id for r in got} == {1}
    assert [table[1][r.start : r.end] for r in sorted(got, key=lambda r: r.start)] == ["Yes.", "So it went on for a good while longer here!", "No.", "Then all of them left the house by the back door."]


def test_removal_keeps_offsets(spark):
    text = "Keep this one. One two three four five six seven eight."
    df = spark.createDataFrame(rows([text, "é " + text, None, "one two three four five six seven eight. One two three four five six seven eight."]), SCHEMA)
    out = {r.doc_id: r for r in sd.remove_repeats(df, 8).collect()}
    assert out[0].deduplicated == text and out[0].removed is None and out[2].deduplicated is None
    assert out[1].deduplicated == "é Keep this one. " and [tuple(r) for r in out[1].removed] == [(17, 57)]
    assert out[1].text[17:57] == "One two three four five six seven eight."
    assert len(out[3].removed) == 2
    assert sd.repeated_units(df.limit(0)).count() == 0 and sd.remove_repeats(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    text = "One two three four five six seven eight."
    df = spark.createDataFrame([(k, text, "mine", "own") for k in range(2)], "doc_id long, text string, removed string, Deduplicated string")
    out = {r.doc_id: r for r in sd.remove_repeats(df, 8).collect()}
    assert out[1].removed == "mine" and out[1].Deduplicated == "own" and out[1].deduplicated_ == "" and len(out[1].removed_) == 1
