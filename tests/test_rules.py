"""The plain rules, and the native expressions against them."""

import random
import re
import sys
import time
import unicodedata
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lexiforge.config import PostEditSettings
from lexiforge.functions import plain
from lexiforge.functions import text as tx
from lexiforge.operators import chunks, engines, glossary, postedit, routing, segments, tokens

TERMS = (("lot", "batch"), ("recette", "acceptance test"), ("recette de lot", "batch acceptance"), ("mot", "mot$1\\x"), ("!!", "?!"))
TEXTS = [
    "", "  ", "Recette du lot.", "RECETTE et recette", "recette et Recette de LOT!!", "îlot et lot, lot_1 lot lot", "Lot", "L", "lot lot lot", "mot\\ $1 mot", "une  recette\t\tici\n  indent  x ",
    "See http://a.b/c?d=1 and `code x` v1.2.3 or 3,5% of a_b camelCase x1 --flag ${y} {{z}} %(w)s a.b@c.de ```f\nx```", "__LT_PROTECTED_0000__ text", "One. Two! Three?  Four", "É. À b",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


def test_last_match_decides_the_casing():
    assert plain.apply_glossary("Recette puis recette", TERMS) == ("acceptance test puis acceptance test", 2)
    assert plain.apply_glossary("recette puis RECETTE", TERMS) == ("ACCEPTANCE TEST puis ACCEPTANCE TEST", 2)
    assert plain.apply_glossary("recette puis Recette", TERMS)[0] == "Acceptance test puis Acceptance test"
    assert plain.apply_glossary("îlot lots", TERMS) == ("îlot lots", 0)
    assert plain.apply_glossary("password", (("password", "password reset"),))[0] == "password reset"


def test_literals_are_no_templates():
    text, marks, _ = plain.protect_terms("mot", TERMS)
    assert plain.restore_terms(text, marks) == ("mot$1\\x", 1)
    assert plain.restore_terms(text.strip("_").lower().replace("_", " "), marks) == ("mot$1\\x", 1)


@pytest.mark.parametrize("native", [True, False])
def test_glossary_equals_the_plain_rules(spark, monkeypatch, native):
    monkeypatch.setattr(glossary, "NATIVE_TERMS", 24 if native else 0)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices(["lot", "Lot", "LOT", "recette", "Recette de lot", "mot", "!!", "é", "lot,", "xlot"], k=9)) for _ in range(60)]
    df = glossary.protect(glossary.apply(frame(spark, texts), TERMS), TERMS)
    df = glossary.restore(df, TERMS, "protected", "protected_map")
    for r in df.collect():
        assert (r.applied, r.applied_n) == plain.apply_glossary(r.text, TERMS)
        text, marks, n = plain.protect_terms(r.text, TERMS)
        assert (r.protected, [(m.ph, m.lit) for m in r.protected_map], r.protected_n) == (text, marks, n)
        assert (r.restored, r.restored_n) == plain.restore_terms(text, marks)


def test_no_glossary(spark):
    r = glossary.restore(glossary.protect(glossary.apply(frame(spark, ["x lot"]), ()), ()), (), "protected", "protected_map").first()
    assert (r.applied, r.applied_n, r.protected, r.restored, r.restored_n) == ("x lot", 0, "x lot", "x lot", 0)


def test_tokens_equal_the_plain_rules(spark):
    df = tokens.protect_targets(tokens.protect_tokens(frame(spark)), TERMS)
    df = df.withColumn("back", tokens.restore_tokens(F.col("marked"), F.col("marked_map")))
    for r in df.collect():
        text, pairs = plain.protect_tokens(r.text)
        assert (r.marked, [(m.ph, m.lit) for m in r.marked_map]) == (text, pairs)
        text, pairs = plain.protect_targets(r.text, TERMS)
        assert (r.shielded, [(m.ph, m.lit) for m in r.shielded_map]) == (text, pairs)
        if "PROTECTED" not in r.text:
            assert r.back == r.text


def test_small_expressions(spark):
    for r in frame(spark).select("text", tx.normalize_spacing(F.col("text")).alias("n"), tx.sentences(F.col("text")).alias("s"), tx.lines(F.col("text")).alias("l"), tx.edge_preserved(F.col("text"), F.lit(" t ")).alias("e")).collect():
        assert r.n == plain.normalize_spacing(r.text) and r.l == r.text.splitlines()
        stripped = r.text.strip()
        lead, tail = r.text[: len(r.text) - len(r.text.lstrip())], r.text[len(r.text.rstrip()) :]
        if stripped:
            assert r.e == (lead + "t" + tail if lead or tail else " t ")
    got = {r.text: r.s for r in frame(spark).select("text", tx.sentences(F.col("text")).alias("s")).collect()}
    assert got[""] == [""] and got["  "] == ["  "] and got["One. Two! Three?  Four"] == ["One.", "Two!", "Three?", "Four"] and got["É. À b"] == ["É.", "À b"]


def test_validator_agrees_with_the_plain_rules(spark):
    pairs = [("__LT_PROTECTED_0000__", "5"), ("__LT_GLOSSARY_PROTECTED_0001__", "batch")]
    draft = "a __LT_PROTECTED_0000__ b __LT_GLOSSARY_PROTECTED_0001__"
    cases = [draft, "", " ", draft + draft, draft.replace("0000", "0002"), draft.replace("__LT_GLOSSARY_PROTECTED_0001__", "batch"), draft.replace(" ", "\n"), draft + "\n\n\n\n", draft[2:]]
    marks = F.array(*(F.struct(F.lit(p).alias("ph"), F.lit(t).alias("lit")) for p, t in pairs))
    got = frame(spark, cases).withColumn("why", tokens.failure(F.lit("s"), F.lit(draft), F.col("text"), marks, 1.4)).orderBy("k").collect()
    assert [r.why for r in got] == [plain.failure("s", draft, c, pairs, 1.4) for c in cases]


def test_reinjection():
    pairs = [("__LT_PROTECTED_0000__", "5"), ("__LT_GLOSSARY_PROTECTED_0000__", "acceptance test")]
    assert plain.reinject("5 and acceptance   TEST", pairs) == "__LT_PROTECTED_0000__ and __LT_GLOSSARY_PROTECTED_0000__"
    assert plain.reinject("15 and 5", pairs) == "15 and __LT_PROTECTED_0000__"
    assert plain.canonical("lt protected 0000 x", pairs) == "__LT_PROTECTED_0000__ x"
    assert plain.replace_once_outside("__LT_X__ x x", "x", "y") == ("__LT_X__ y x", True)
    assert plain.replace_once_outside("text", "", "y") == ("text", False)


def test_a_repeated_target_is_refused():
    settings = PostEditSettings()
    entries = (("lot", "batch"),)
    out = plain.post_edit(engines.echo, "s", "batch and batch once more in a draft", entries, settings, "safe")
    assert out.fallback and out.reason == "glossary_placeholder_mismatch"
    assert plain.judge("s", "one batch", "one batch", entries, settings).reason is None


def test_post_edit_outcomes():
    settings, draft = PostEditSettings(), "Version 1.2.3 is here , and 5 more"
    assert plain.post_edit(None, "s", draft, (), settings, "safe") == (draft, False, 0, None)
    assert plain.post_edit(engines.fail, "s", draft, (), settings, "safe") == (draft, True, 0, "llm_exception")
    assert plain.post_edit(engines.rewrite, "s", draft, (), settings, "safe").text == draft.replace(" ,", ",")
    assert plain.post_edit(engines.mangle, "s", draft, (), settings, "safe").text == draft
    kept = PostEditSettings(fallback_to_draft=False)
    assert plain.post_edit(lambda *_: "", "s", draft, (), kept, "safe") == ("", False, 0, "empty_output")


def test_router_rules(spark):
    cases = {
        "short": "short_plain_segment", "x" * 48: "default_safe", "x" * 160: "long_natural_language_segment", "a b. " + "c" * 50: "multi_sentence_prose", "see `x` " + "c" * 50: "technical_token_density",
        "__LT_A__ and __LT_B__ " + "c" * 40: "high_placeholder_density", "__LT_A____LT_B__ " + "c" * 40: "default_safe",
    }
    df = frame(spark, list(cases)).withColumnRenamed("text", "draft")
    assert {r.draft: r.decision.reason for r in routing.route(df).collect()} == cases
    assert {r.decision.reason for r in routing.route(df, PostEditSettings(policy="off")).collect()} == {"mode_off"}
    forced = {r.draft: tuple(r.decision) for r in routing.route(df, PostEditSettings(policy="smart")).collect()}
    assert forced["x" * 48] == (True, "smart", "forced_mode") and forced["short"] == (False, None, "short_plain_segment")
    low = routing.route(df, PostEditSettings(skip_high_placeholder_ratio=0.01)).collect()
    assert {tuple(r.decision) for r in low if r.draft.startswith("__LT_A__ ")} == {(False, None, "high_placeholder_density")}


def cut(run, most, chars):
    """Pieces of a run of (place, length), each as long as the limits allow, and what ended them."""
    pieces = []
    while run:
        n = max(k for k in range(1, len(run) + 1) if k == 1 or k <= most and sum(size for _, size in run[:k]) <= chars)
        pieces.append((run[:n], chunks.MAX_SEGMENTS if n == most else chunks.MAX_CHARS))
        run = run[n:]
    return pieces


def brute_chunks(rows, most, chars):
    """Runs of eligible segments first, each cut by the limits; then why each run ends."""
    runs, out = [list(g) for _, g in groupby(enumerate(rows), key=lambda x: x[1][1])], []
    for at, run in enumerate(runs):
        if run[0][1][1]:
            pieces = cut([(k, n) for k, (n, _) in run], most, chars)
            before = len(runs[at - 1]) if at else 0
            if at + 1 < len(runs):
                last = chunks.MODE_CHANGE
            else:  # the unit's end has no reason but one left over from a gap that no chunk used up
                last = chunks.MODE_CHANGE if len(pieces) == 1 and before > (at > 1) else None
            whys = [why for _, why in pieces[:-1]] + [last]
            out += [([k for k, _ in piece], sum(n for _, n in piece), why) for (piece, _), why in zip(pieces, whys, strict=True)]
    return out


def test_packer_equals_a_loop(spark):
    rng, s = random.Random(6), PostEditSettings(enable_chunking=True, chunk_max_chars=100, chunk_max_segments=3)
    units = [[(rng.randrange(1, 70), rng.random() < 0.7) for _ in range(rng.randrange(1, 14))] for _ in range(150)]
    rows = [(u, 0, k, "x" * n, 0, ("safe",), can) for u, unit in enumerate(units) for k, (n, can) in enumerate(unit)]
    df = spark.createDataFrame(rows, "doc_id long, unit_idx int, seg_idx int, draft string, mark_count int, decision struct<mode:string>, can_chunk boolean")
    got = {}
    for r in chunks.pack(df, s).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append((r.segment_indices, r.character_count, r.boundary_reason))
    assert all(got.get(u, []) == brute_chunks(unit, 3, 100) for u, unit in enumerate(units))


def test_payload_and_parsing(spark):
    texts = ["a b", "c\nd", "e"]
    whole = plain.chunk_payload(texts)
    cases = [whole, whole.replace("[/SEGMENT_1]", ""), whole + " more", whole.replace("SEGMENT_1", "SEGMENT_7"), "x " + whole]
    df = frame(spark, cases).withColumns({"p": chunks.parsed(F.col("text"), F.lit(3)), "made": chunks.payload(F.array(*map(F.lit, texts)))}).orderBy("k")
    assert [(r.p.texts, r.p.reason) for r in df.collect()] == [plain.parse_chunk(c, 3) for c in cases]
    assert df.first().made == whole


def test_chunk_fallback_goes_over_all_members():
    rows = [{"seg_idx": k, "source": f"s{k}", "draft": f"draft number {k} of a unit with some words", "marks": [], "mode": "safe"} for k in range(3)]
    chunk = {"segment_indices": [0, 1, 2], "routing_mode": "safe", "boundary_reason": None, "character_count": 9, "placeholder_count": 0}
    s = PostEditSettings(enable_chunking=True)
    out = postedit.Unit(rows, (), s, engines.echo).run([chunk])
    assert (out["llm_calls"], out["llm_calls_saved_by_chunking"], out["chunk_fallbacks"]) == (1, 2, 0)
    out = postedit.Unit(rows, (), s, engines.broken_markers).run([chunk])
    assert (out["llm_calls"], out["llm_calls_saved_by_chunking"], out["chunk_fallbacks"]) == (4, 0, 1) and dict(out["validation_failures"]) == {"missing_segment": 1}
    out = postedit.Unit(rows, (), s, None).run([chunk])
    assert (out["llm_calls"], out["chunk_fallbacks"], [e["final"] for e in out["edited"]]) == (4, 1, [r["draft"] for r in rows])


def test_latency_is_the_engines_alone():
    def slow(source, draft, entries, mode):
        time.sleep(0.02)
        return draft

    rows = [{"seg_idx": 4, "source": "s", "draft": "a draft of some words", "marks": [], "mode": "safe"}]
    out = postedit.Unit(rows, (), PostEditSettings(), slow).run([])
    assert 0.02 <= out["avg_llm_latency_per_segment"] < 0.2
    assert postedit.Unit(rows, (), PostEditSettings(), None).run([])["avg_llm_latency_per_segment"] == 0


def test_native_classes_are_pythons(spark):
    """Every assigned code point but surrogates: a word character, white space, and the edge of a term."""
    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    c = F.col("text")
    df = frame(spark, signs).select(
        "text", F.rlike(c, F.lit(tx.java_pattern(r"\w"))).alias("w"), tx.is_blank(c).alias("s"), F.rlike(F.concat(F.lit("lot"), c), F.lit(tx.term_pattern("lot"))).alias("after"),
        F.rlike(F.concat(c, F.lit("LOT")), F.lit(tx.term_pattern("lot"))).alias("before"), F.rlike(c, F.lit(r"\p{Cn}")).alias("new"),
    )
    known = df.collect()
    # Characters of a later Unicode version than this Java's are left to it.
    assert {r.text for r in known if r.w != bool(re.match(r"\w", r.text))} <= {r.text for r in known if r.new}
    for r in known:
        assert r.s == r.text.isspace(), hex(ord(r.text))
        if not r.new:
            assert r.after == bool(plain.bounded("lot", True).search("lot" + r.text)) and r.before == bool(plain.bounded("lot", True).search(r.text + "LOT")), hex(ord(r.text))


ODD = ["lot\u0301", "lot\u200d", "LOT\u00b2", "lot\u2040x", "\u0301lot", "lot\u1d7ce", "lot\u216b", "lot_", "\u203flot", "one.\x1ctwo", "a\u200cb lot", "LT\u0301GLOSSARY TERM 0000", "__LT_GLOSSARY_TERM_0000__\u00b2", "x\x1f lot"]


@pytest.mark.parametrize("native", [True, False])
def test_marks_joiners_and_numbers_at_terms(spark, monkeypatch, native):
    monkeypatch.setattr(glossary, "NATIVE_TERMS", 24 if native else 0)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(["lot", "Lot", "\u0301", "\u200d", "\u00b2", "\u2040", "_", " ", "\x1c", "recette", "é", "-"], k=8)) for _ in range(150)]
    df = glossary.protect(glossary.apply(frame(spark, texts), TERMS), TERMS)
    df = glossary.finish(glossary.restore(df, TERMS, "protected", "protected_map"), TERMS, "protected", "protected_map")
    for r in df.collect():
        assert (r.applied, r.applied_n) == plain.apply_glossary(r.text, TERMS)
        text, marks, n = plain.protect_terms(r.text, TERMS)
        assert (r.protected, r.protected_n) == (text, n) and (r.restored, r.restored_n) == plain.restore_terms(text, marks)
        back, n = plain.restore_terms(text, marks)
        final, m = plain.apply_glossary(back, TERMS)
        assert (r.final, r.final_n) == (plain.normalize_spacing(final), n + m)


def test_odd_tokens_equal_the_plain_rules(spark):
    rng = random.Random(5)
    parts = ["a_b", "x1", "v1.2", "3,5%", "5", "\u0301", "\u200d", "\u00b2", "\u2040", " ", "\x1c", "é", "cmd --flag=1", "a@b.cd", "http://x/y", "`c`", "camelCase"]
    for r in tokens.protect_tokens(frame(spark, ["".join(rng.choices(parts, k=6)) for _ in range(400)])).collect():
        assert (r.marked, [(m.ph, m.lit) for m in r.marked_map]) == plain.protect_tokens(r.text)


def test_prompt_and_budget():
    said = plain.prompt("s", "d", (("a", "b"),), "safe")
    assert "SAFE MODE" in said and "- a => b" in said and "8)" not in said and said.endswith("[OUTPUT]\n")
    assert "8)" in plain.prompt("s", "[SEGMENT_0]", (), "smart") and "(none)" in plain.prompt("s", "d", (), "smart")
    assert [plain.token_budget("x" * n, m) for n, m in ((1, "safe"), (100, "safe"), (100, "smart"), (9999, "smart"))] == [24, 71, 101, 256]


def test_preview_counts_documents_without_units(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_units for r in segments.preview(segments.line_units(docs), docs).collect()} == {1: 3, 2: 0, 3: 0}
