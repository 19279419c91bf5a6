"""The pipeline against brute force, stage by stage, and its queries' registration."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry
from lexiforge.llm.tokens import _load, default_path

from .cases import LONG, SCHEMA, TEXTS, rows
from .test_decontamination import brute as hits
from .test_near_dedup import brute as groups
from .test_quality_rules import brute as quality
from .test_tokens import crc

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept", "score"]


def corpus():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "light", "quiet", "morning", "paper") for b in ("", "s", "ing", "ed", "er", "ly")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    item = " ".join(f"question{k}" for k in range(15))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    texts = TEXTS + [base, " ".join(near), base, prose(60), prose(40) + " " + item + " " + prose(20), prose(30) + ' token = "abcdefgh12345678" ' + prose(30), prose(2000)]
    return texts, [(1, item)]


def test_stages(spark, tmp_path):
    texts, items = corpus()
    spark.createDataFrame(rows(texts), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == COLUMNS
        seen[name] = (before, docs.orderBy("doc_id").collect())
    before, after = seen["quality"]
    failed = {r.doc_id for r in before if quality(r.text)[5]}
    assert not failed & {r.doc_id for r in after}
    assert {len(TEXTS) + k for k in range(7)} <= {r.doc_id for r in after}
    before, after = seen["near_dedup"]
    root = groups([r.text for r in before], 5, 80)
    assert [r.doc_id for r in after] == [r.doc_id for r, g in zip(before, root, strict=True) if g[3]]
    assert len(after) == len(before) - 2
    before, after = seen["decontamination"]
    assert [r.doc_id for r in after] == [r.doc_id for r in before if not hits(r.text, items)[4]] and len(after) == len(before) - 1
    before, after = seen["secrets"]
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    assert sum("[SECRET]" in r.text for r in after) == 1 and all(r.text == b.text for r, b in zip(after, before, strict=True) if "[SECRET]" not in r.text)
    before, after = seen["packing"]
    whole, pieces = _load(default_path("byte_bpe_50k.json")), defaultdict(list)
    for r in after:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {r.doc_id for r in before}
    for r in before:
        ids, at = whole.encode(r.text, add_special_tokens=False).ids + [1], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_repeated_rows_and_rows_without_id(spark, tmp_path):
    texts, items = corpus()
    odd = [(None, t, "en", "src1", 0, "a", "b") for t in texts[-7:] + [None, "", LONG]]
    spark.createDataFrame(rows(texts) + rows(texts) + odd, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items + [(None, "no id"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter((r.doc_id, r.text) for r in docs.collect()) if name != "packing" else Counter(r.doc_id for r in docs.collect())
    ids = lambda name: {i for i, _ in kept[name] if i is not None}
    assert all(n % 2 == 0 for (i, _), n in kept["quality"].items() if i is not None)
    copies = {len(TEXTS) + 1, len(TEXTS) + 2}
    assert ids("near_dedup") == ids("quality") - copies
    assert {x: n for x, n in kept["near_dedup"].items() if x[0] is None} == {x: n for x, n in kept["quality"].items() if x[0] is None}
    leak = len(TEXTS) + 4
    assert ids("decontamination") == ids("near_dedup") - {leak} and not any(t == texts[leak] for _, t in kept["decontamination"])
    assert sum(kept["secrets"].values()) == sum(kept["decontamination"].values()) and not any("abcdefgh12345678" in t for _, t in kept["secrets"])
    assert set(kept["packing"]) == ids("secrets") | {None}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert {"pipeline"} <= set(names) and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names) and all(map(callable, names.values())) and all(isinstance(x, str) for x in entry.oracle_sql().values())
