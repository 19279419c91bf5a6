"""Formats, the whole plan, the API, the command line, streams and the entry."""

import json
import re
import subprocess
import sys
import uuid
from pathlib import Path

import pytest

from lexiforge import api, cli
from lexiforge.config import EngineMode, PostEditSettings, RunConfig
from lexiforge.functions import plain
from lexiforge.operators import engines
from lexiforge.operators.segments import units_of
from lexiforge.plans import catalog, reports
from lexiforge.plans.translate import translate_units
from lexiforge.sources import documents, formats
from lexiforge.sources.glossaries import GlossaryError, load
from lexiforge.streaming.translate import routed_stream, translate_stream

from . import builders


def test_docx_keeps_runs_and_other_parts():
    raw = builders.docx()
    units = formats.read_docx(raw)
    assert units == ["Title", "Plain ", "bold", "", "a1", "b1"]
    new = formats.write_docx(raw, [u.upper() for u in units[:-1]])
    assert formats.read_docx(new) == ["TITLE", "PLAIN ", "BOLD", "", "A1", "b1"]
    assert b"<w:b" in formats.zipfile.ZipFile(formats.io.BytesIO(new)).read("word/document.xml")
    assert formats.zipfile.ZipFile(formats.io.BytesIO(new)).read("media/x.bin") == b"\x00\x01"


def test_pptx_goes_by_slide_order_and_into_groups():
    raw = builders.pptx()
    units = formats.read_pptx(raw)
    assert units == ["One", "Two", "Inner", "Last", "c1", ""]
    assert formats.read_pptx(formats.write_pptx(raw, ["1", "2", "3", "4", "5"])) == ["1", "2", "3", "4", "5", ""]


def test_xlsx_takes_text_cells_only_and_keeps_their_edges():
    raw = builders.xlsx()
    assert formats.text_cells(raw) == [("Main", "A1", "Hello"), ("Main", "D5", " edge ")]
    assert formats.read_xlsx(formats.write_xlsx(raw, ["Bonjour", "bord"])) == ["Bonjour", " bord "]
    with pytest.raises(ValueError, match="count mismatch"):
        formats.write_xlsx(raw, ["only one"])


def test_ooxml_declares_every_prefix():
    raw = builders.docx_with_prefixes()
    new = formats.write_docx(raw, ["Erster", *formats.read_docx(raw)[1:]])
    part = formats.zipfile.ZipFile(formats.io.BytesIO(new)).read("word/document.xml")
    root = part[part.index(b"<w:document") : part.index(b">", part.index(b"<w:document"))].decode()
    prefixes = set(re.findall(r"xmlns:(\w+)=", root))
    assert prefixes == {"mc", "w", "r", "w14", "w15"} and len(re.findall("xmlns:", root)) == 5
    assert set(re.search(r'mc:Ignorable="([^"]*)"', root).group(1).split()) <= prefixes
    assert b'w14:paraId="1A"' in part and b"w:hyperlink" in part and formats.read_docx(new)[0] == "Erster"
    for raw, read, write in ((builders.pptx(), formats.read_pptx, formats.write_pptx), (builders.xlsx(), formats.read_xlsx, formats.write_xlsx)):
        new = write(raw, [t + " x" if t else t for t in read(raw)])
        with formats.zipfile.ZipFile(formats.io.BytesIO(raw)) as old, formats.zipfile.ZipFile(formats.io.BytesIO(new)) as now:
            for name in old.namelist():
                declared = lambda z: {p for p, _ in formats._declared(z.read(name))} if name.endswith((".xml", ".rels")) else set()  # noqa: E731, B023
                assert declared(old) <= declared(now), name


def test_docx_links_and_merged_cells():
    raw = builders.docx_with_prefixes()
    units = formats.read_docx(raw)
    assert units == ["First", "linked text", "wide", "wide", "tall", "a", "b", "tall"]
    assert formats.locate_docx(raw)[1:5] == ["block=1", "block=2,row=0,cell=0,paragraph=0,run=0", "block=2,row=0,cell=1,paragraph=0,run=0", "block=2,row=0,cell=2,paragraph=0,run=0"]
    assert formats.read_docx(formats.write_docx(raw, [u.upper() for u in units])) == [u.upper() for u in units]


def test_pdf_with_object_streams_and_two_byte_fonts():
    text = "Größe, naïve façade — 東京 with some words"
    assert formats.read_pdf(builders.modern_pdf(text)) == [f"{text}\nABC\ncafé form"]
    with pytest.raises(ValueError, match="Encrypted"):
        formats.read_pdf(builders.modern_pdf(text, key=True))
    assert formats.FORMATS[".pdf"].located(builders.modern_pdf(text)) == [(f"{text}\nABC\ncafé form", "page=0")]


@pytest.mark.parametrize("compress", [False, True])
def test_pdf(compress):
    raw = builders.pdf(["A first line of text (here)", "and a second"], ["Page two"], compress=compress)
    assert formats.read_pdf(raw) == ["A first line of text (here)\nand a second", "Page two"]
    assert formats.write_sidecar(raw, [" a ", "", "b"]) == b"a\n\nb\n"
    with pytest.raises(ValueError, match="meaningful"):
        formats.read_pdf(builders.pdf([""]))
    with pytest.raises(ValueError, match="Invalid PDF"):
        formats.read_pdf(b"nothing", "x.pdf")


def test_text_and_markdown():
    assert formats.read_txt(b"a\r\nb\rc") == ["a\nb\nc"] and formats.write_txt(b"", ["a", "b"]) == b"a\nb"
    assert formats.read_md(b"# a\n\nb\n") == ["# a", "", "b"] and formats.read_md(b"") == [] and formats.write_md(b"", []) == b"\n"
    with pytest.raises(ValueError, match="Unsupported format"):
        formats.format_of("x.rtf")


def test_many_files(spark, tmp_path):
    for name, raw in (("a.docx", builders.docx()), ("b.xlsx", builders.xlsx()), ("c.md", b"x\ny\n"), ("d.pdf", b"broken"), ("e.txt", "é".encode())):
        (tmp_path / name).write_bytes(raw)
    files = documents.read_files(spark, str(tmp_path))
    units, rejected = documents.extract(files)
    assert {r.locator for r in units.where("unit_idx = 0").collect()} == {"block=0,run=0", "Main!A1", None}
    assert units.count() == 6 + 2 + 2 + 1 and [r.error[:11] for r in rejected.collect()] == ["Invalid PDF"]
    rebuilt = {Path(r.path).name: r for r in documents.rebuild(files, units).collect()}
    assert formats.read_docx(rebuilt["a.docx"].content) == formats.read_docx(builders.docx())
    assert rebuilt["c.md"].content == b"x\ny\n" and rebuilt["e.txt"].content == "é".encode()


def test_glossary_files(tmp_path):
    def made(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return tmp_path / name

    assert load(None).entries == ()
    assert load(made("a.json", '{" lot ": "batch"}')).entries == (("lot", "batch"),)
    found = load(made("b.yaml", "source_language: FR\ntarget_language: en\nentries:\n  lot: batch\n"), "fr", "en")
    assert found.source_language == "fr" and found.entries == (("lot", "batch"),)
    assert load(made("e.yml", "")).entries == ()
    for name, text, why in (("c.json", "[1]", "no object"), ("d.json", '{"": "x"}', "empty source"), ("f.json", '{"a": ""}', "empty target"), ("g.txt", "", "no glossary"), ("h.json", '{"entries": [], "x": 1}', "as an object"), ("i.json", '{"entries": {"a": "b"}, "source_language": 5}', "language code")):
        with pytest.raises(GlossaryError, match=why):
            load(made(name, text))
    with pytest.raises(GlossaryError, match="mismatch"):
        load(tmp_path / "b.yaml", "en", "fr")


class Broken:
    def translate(self, text):
        if "bad" in text:
            raise RuntimeError("no model")
        return text.upper()


def test_failing_segments_keep_their_source(spark):
    units = units_of(spark.createDataFrame([(1, "good one. bad lot. good two."), (2, "")], "doc_id long, text string"))
    text, report = translate_units(units, RunConfig(glossary=(("lot", "batch"),)), engines.BatchEngine("broken", Broken))
    assert {r.doc_id: r.text for r in text.collect()} == {1: "GOOD ONE. bad batch. GOOD TWO.", 2: ""}
    r = report.where("doc_id = 1").first()
    assert (r.segment_count, r.translated_count, r.error_count, r.errors, r.routing_reasons) == (3, 2, 1, ["no model"], {"segment_error": 1, "short_plain_segment": 2})


def test_counts_sum_all_stages(spark):
    units = units_of(spark.createDataFrame([(1, "une recette ici")], "doc_id long, text string"))
    _, report = translate_units(units, RunConfig(glossary=(("recette", "acceptance test"),)), engines.identity())
    assert report.first().glossary_replacements == 2


def test_hybrid_chunks_and_reports(spark):
    long = "this sentence is long enough to be edited by the engine, it is."
    docs = spark.createDataFrame([(k, " ".join([long] * 5 + ["short one."] + [long] * 2)) for k in range(3)], "doc_id long, text string")
    config = RunConfig(engine=EngineMode.HYBRID, settings=PostEditSettings(enable_chunking=True))
    text, report = translate_units(units_of(docs), config, engines.identity(), engines.echo)
    assert {r.text for r in text.collect()} == {docs.first().text}
    merged = reports.merge_reports(report)
    r = merged.where("doc_id = 0").first()
    assert (r.segment_count, r.llm_chunks_built, r.llm_calls, r.llm_skipped, r.llm_calls_saved_by_chunking, r.max_chunk_size) == (8, 2, 3, 1, 4, 4)
    assert r.avg_chunk_size == 3 and r.chunk_boundary_reasons == {"stopped_due_to_max_segments": 1} and len(r.chunk_trace) == 2 and len(r.routing_trace) == 8
    total = reports.summarize(merged).first()
    assert (total.reports, total.segments, total.llm_skip_rate, total.llm_calls_saved_by_chunking) == (3, 24, 0.125, 12)


def test_missing_runtimes_are_errors_and_fallbacks(spark, tmp_path):
    done = api.translate_text(spark, "Un lot. Deux lots.", "fr", "en", report=True)
    assert done.text == "Un lot. Deux lots." and done.report["error_count"] == 2 and "Argos" in done.report["errors"][0]
    model = tmp_path / "model.gguf"
    model.touch()
    long = "this sentence is long enough to be edited by the engine, it is."
    done = api.translate_text(spark, long, "fr", "en", engine="llm", llm_model=model)
    assert done.text == long and done.report["fallback_count"] == 1 and done.report["validation_failures"] == {"llm_exception": 1}


def test_argos_adapter(monkeypatch):
    import types

    asked = []

    class Language:
        def __init__(self, code):
            self.code = code

        def get_translation(self, target):
            asked.append((self.code, target.code))
            return types.SimpleNamespace(translate=str.upper)

    module = types.ModuleType("argostranslate")
    module.translate = types.SimpleNamespace(get_installed_languages=lambda: [Language("fr"), Language("en")])
    monkeypatch.setitem(sys.modules, "argostranslate", module)
    engine = engines.argos("fr", "en").load()
    assert engine.translate("  ") == "  " and not asked
    assert [engine.translate("un"), engine.translate("deux")] == ["UN", "DEUX"] and asked == [("fr", "en")]
    with pytest.raises(RuntimeError, match="no language de"):
        engines.Argos("fr", "de").translate("un")


LOADED = []


def fake_model(settings):
    LOADED.append(settings)

    def call(prompt, **options):
        LOADED.append((prompt, options))
        return {"choices": [{"text": "  edited \n"}]}

    return call


def test_language_model_adapter():
    settings = PostEditSettings(model_path="m.gguf", max_tokens=100)
    edit = engines.LanguageModel(settings, fake_model)
    assert edit("s", " ", (), "safe") == " " and not LOADED
    assert [edit("src", "a draft", (("a", "b"),), m) for m in ("safe", "smart")] == ["edited", "edited"]
    assert LOADED[0] is settings and len(LOADED) == 3
    prompt, options = LOADED[2]
    assert prompt == plain.prompt("src", "a draft", (("a", "b"),), "smart") and options == {"max_tokens": 24, "temperature": 0.0, "top_k": 1, "top_p": 1.0, "seed": 0, "stop": ["[/OUTPUT]", "\n\n"]}
    assert engines.LanguageModel(PostEditSettings(), fake_model)("s", "d", (), "safe") == "d"


class Counting:
    """Counts its calls in a folder, as workers are other processes."""

    def __init__(self, folder):
        self.folder = folder

    def _called(self):
        (self.folder / uuid.uuid4().hex).touch()

    def translate(self, text):
        self._called()
        return text + "!"

    def edit(self, source, draft, entries, mode):
        self._called()
        return draft

    def calls(self):
        return len(list(self.folder.iterdir()))


@pytest.mark.parametrize("chunking", [False, True])
def test_engines_are_asked_once(spark, tmp_path, chunking):
    long = "this sentence is long enough to be edited by the engine, it is."
    docs = spark.createDataFrame([(k, " ".join([long] * (k % 5 + 1) + ["short one."] + [long] * 2)) for k in range(12)], "doc_id long, text string")
    for name in ("mt", "edit", "api_mt", "api_edit"):
        (tmp_path / name).mkdir()
    mt, edit = Counting(tmp_path / "mt"), Counting(tmp_path / "edit")
    config = RunConfig(engine=EngineMode.HYBRID, settings=PostEditSettings(enable_chunking=chunking))
    text, report = translate_units(units_of(docs), config, engines.BatchEngine("counting", lambda: mt), edit.edit)
    assert text.join(report, ["doc_id", "unit_idx"]).count() == text.count() == 12
    merged = reports.merge_reports(report).collect()
    assert mt.calls() == sum(r.segment_count for r in merged) and edit.calls() == sum(r.llm_calls for r in merged)
    mt, edit = Counting(tmp_path / "api_mt"), Counting(tmp_path / "api_edit")
    model = tmp_path / "model.gguf"
    model.touch()
    done = api.translate_text(spark, " ".join([long] * 3), "fr", "en", engine="hybrid", llm_model=model, translator=engines.BatchEngine("counting", lambda: mt), edit=edit.edit)
    assert done.report["segment_count"] == mt.calls() == 3 and edit.calls() == done.report["llm_calls"] == 3


def test_summary_of_partial_reports(spark, tmp_path):
    for k, said in enumerate(({"segment_count": 12, "llm_skipped": 3, "validation_failures": {"placeholder_mismatch": 2}, "llm_calls_saved_by_chunking": 3}, {"segment_count": 8, "llm_safe_segments": 4, "validation_failures": {"placeholder_mismatch": 1, "empty_output": 1}})):
        (tmp_path / f"{k}.json").write_text(json.dumps(said))
    said = api.summarize_files(spark, [tmp_path / "0.json", tmp_path / "1.json"])
    assert said["segments"] == 20 and said["llm_skip_rate"] == 0.15 and said["safe_share"] == 0.2 and said["llm_calls_saved_by_chunking"] == 3
    assert list(said["validation_failures"].items()) == [("placeholder_mismatch", 3), ("empty_output", 1)]


def test_api_and_command_line(spark, tmp_path, capsys):
    done = api.translate_text(spark, "Une recette. Et un lot.", "fr", "en", report=True, translator=engines.tag(" [en]"))
    assert done.text == "Une recette. [en] Et un lot. [en]" and done.report["segment_count"] == 2
    assert reports.readable(done.report).splitlines()[1] == "Segments processed: 2" and len(reports.readable(done.report).splitlines()) == 19
    assert api.translate_text(spark, "x", "fr", "en", report_json="y.json").warnings
    source = tmp_path / "a.md"
    source.write_text("# Titre\n\nTexte.\n")
    assert cli.main(["translate", str(source), str(tmp_path / "b.md"), "--source", "fr", "--target", "en", "--translator", "tag", "--report", "--report-json", str(tmp_path / "deep" / "r.json")], spark) == 0
    assert (tmp_path / "b.md").read_text() == "# Titre [en]\n\nTexte. [en]\n"
    said = json.loads((tmp_path / "deep" / "r.json").read_text())
    assert len(said) == 28 and said["segment_count"] == 3
    assert cli.main(["preview", str(source)]) == 0 and cli.main(["gui"]) == 0
    assert cli.main(["report-summary", str(tmp_path / "deep" / "r.json")], spark) == 0
    capsys.readouterr()
    for args, why in ((["preview", "none.md"], "does not exist"), (["preview", str(tmp_path)], "not a file"), (["text", "x", "--source", "fr", "--target", "fr"], "different"), (["text", "x", "--source", "xx", "--target", "fr"], "Unsupported language"), (["text", "x", "--source", "fr", "--target", "en", "--engine", "z"], "Unsupported engine"), (["text", "x", "--source", "fr", "--target", "en", "--engine", "llm"], "model path"), (["text", "x", "--source", "fr", "--target", "en", "--glossary", "no.json"], "does not exist"), (["text", "x", "--source", "fr", "--target", "en", "--n-ctx", "0"], "greater than 0")):
        assert cli.main(args, spark) == 2 and why in capsys.readouterr().err
    with pytest.raises(ValueError, match="empty"):
        api.translate_text(spark, "  ", "fr", "en")
    empty = tmp_path / "empty.md"
    empty.write_text("")
    assert api.translate_file(spark, empty, tmp_path / "out.md", "fr", "en", report=True).report["segment_count"] == 0 and (tmp_path / "out.md").read_text() == "\n"
    pdf = tmp_path / "x.pdf"
    pdf.write_bytes(builders.pdf(["Some text that is long enough to be read"]))
    with pytest.raises(ValueError, match="txt"):
        api.translate_file(spark, pdf, tmp_path / "x2.pdf", "fr", "en")


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Un lot. Deux lots."), (2, "Trois.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    assert routed_stream(stream, RunConfig()).isStreaming
    translate_stream(stream, RunConfig(), str(tmp_path / "out"), str(tmp_path / "state"), engines.tag("!")).awaitTermination(120)
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "Un lot.! Deux lots.!", 2: "Trois.!"}


SMALL = list(catalog.ORACLES)


@pytest.mark.parametrize("name", SMALL)
def test_queries_equal_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    wanted = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    near = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert near(map(tuple, df.select(*columns).collect())) == near(wanted.fetchall())


def test_entry_without_the_pipeline_package(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "lexiforge"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else __import__("shutil").copytree(root / name, tmp_path / name, ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'segment_documents' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
