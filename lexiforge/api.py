"""Translate a text or a file, or count a file's units, with checks of the request."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from .config import LANGUAGES, EngineMode, PostEditSettings, RunConfig
from .functions import plain
from .operators import engines
from .operators.stored import released, stored
from .plans import reports as rp
from .plans.translate import translated
from .sources.formats import FORMATS, format_of
from .sources.glossaries import SUFFIXES, load
from .sources.reports import write_report


@dataclass
class TextOutput:
    text: str
    report: dict | None
    warnings: list[str] = field(default_factory=list)


@dataclass
class FileOutput:
    output_path: Path
    report: dict | None
    warnings: list[str] = field(default_factory=list)


@dataclass
class PreviewOutput:
    input_path: Path
    units: int


def language(value: str) -> str:
    found = value.strip().lower()
    if found not in LANGUAGES:
        raise ValueError(f"Unsupported language: {value}. Supported: {', '.join(LANGUAGES)}")
    return found


def engine_mode(value: str) -> EngineMode:
    try:
        return EngineMode(value.strip().lower())
    except ValueError as problem:
        raise ValueError(f"Unsupported engine: {value}. Supported: {', '.join(EngineMode)}") from problem


def glossary_path(value: str | Path | None) -> Path | None:
    if value is None:
        return None
    path = Path(value)
    if not path.exists():
        raise ValueError(f"Glossary file does not exist: {path}")
    if not path.is_file():
        raise ValueError(f"Glossary path is not a file: {path}")
    if path.suffix.lower() not in SUFFIXES:
        raise ValueError(f"Unsupported glossary format: {path.suffix}")
    return path


def input_path(value: str | Path) -> Path:
    path = Path(value)
    if not path.exists():
        raise ValueError(f"Input file does not exist: {path}")
    if not path.is_file():
        raise ValueError(f"Input path is not a file: {path}")
    format_of(str(path))
    return path


def build_config(source: str, target: str, engine: str = "argos", glossary: str | Path | None = None, llm_model: str | Path | None = None, n_ctx: int = 1024, n_batch: int = 64, n_threads: int = 2, policy: str = "auto", chunking: bool = False) -> RunConfig:
    source, target = language(source), language(target)
    if source == target:
        raise ValueError("Source and target languages must be different")
    mode, terms = engine_mode(engine), glossary_path(glossary)
    if mode != EngineMode.ARGOS and llm_model is None:
        raise ValueError(f"Engine '{mode}' requires a model path")
    if llm_model is not None and not Path(llm_model).exists():
        raise ValueError(f"Model file does not exist: {llm_model}")
    for name, value in (("n_ctx", n_ctx), ("n_batch", n_batch), ("n_threads", n_threads)):
        if value <= 0:
            raise ValueError(f"{name} must be greater than 0")
    settings = PostEditSettings(enabled=mode != EngineMode.ARGOS, model_path=str(llm_model) if llm_model else None, n_ctx=n_ctx, n_batch=n_batch, n_threads=n_threads, policy=policy, enable_chunking=chunking)
    return RunConfig(source, target, mode, load(terms, source, target).entries, settings)


def _run(spark: SparkSession, texts: list[str], config: RunConfig, engine, edit: plain.Edit | None) -> tuple[list[str], dict]:
    """Translated units and the merged report of one document.

    Where no engine is given, Argos Translate makes the drafts and the local model
    of the settings edits them; what isn't installed is in the report's errors.
    """
    engine = engine or engines.argos(config.source_language, config.target_language)
    edit = edit or (engines.LanguageModel(config.settings) if config.engine != EngineMode.ARGOS else None)
    began = time.perf_counter()
    units = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "doc_id long, unit_idx int, text string")
    done = stored(translated(units, config, engine, edit), "translated")
    try:
        texts_by_unit = {r.unit_idx: r.text for r in done.select("unit_idx", "text").collect()}
        merged = rp.merge_reports(done.drop("text", "segments")).collect()
    finally:
        released(done)
    said = merged[0].asDict(recursive=True) if merged else empty_report()
    return [texts_by_unit.get(k, "") for k in range(len(texts))], said | {"elapsed_seconds": time.perf_counter() - began}


def empty_report() -> dict:
    kinds = {"errors": [], "routing_trace": [], "chunk_trace": []} | {m: {} for m in rp.MAPS} | dict.fromkeys((*rp.MEANS, "elapsed_seconds"), 0.0)
    return {k: kinds.get(k, 0) for k in rp.KEYS_IN_ORDER}


def _report_out(said: dict, report: bool, report_json: str | Path | None) -> tuple[dict | None, list[str]]:
    if report_json is not None and not report:
        return said, ["report_json is ignored without report"]
    if report and report_json is not None:
        write_report(said, report_json)
    return said, []


def translate_text(spark: SparkSession, content: str, source: str, target: str, report: bool = False, report_json: str | Path | None = None, translator=None, edit: plain.Edit | None = None, **options) -> TextOutput:
    if not content.strip():
        raise ValueError("Content must not be empty")
    texts, said = _run(spark, [content], build_config(source, target, **options), translator, edit)
    return TextOutput(texts[0], *_report_out(said, report, report_json))


def translate_file(spark: SparkSession, path: str | Path, output: str | Path, source: str, target: str, report: bool = False, report_json: str | Path | None = None, translator=None, edit: plain.Edit | None = None, **options) -> FileOutput:
    path, output = input_path(path), Path(output)
    config, kind = build_config(source, target, **options), format_of(str(path))
    content = path.read_bytes()
    units = kind.read(content, path.name)
    texts, said = _run(spark, units, config, translator, edit) if units else ([], empty_report())
    if kind.suffix == ".pdf" and output.suffix.lower() != ".txt":
        raise ValueError("PDF output must be a .txt file")
    output.write_bytes(kind.write(content, texts))
    return FileOutput(output, *_report_out(said, report, report_json))


def preview_file(path: str | Path) -> PreviewOutput:
    path = input_path(path)
    return PreviewOutput(path, len(format_of(str(path)).read(path.read_bytes(), path.name)))


def summarize_files(spark: SparkSession, paths: list[str | Path]) -> dict:
    """The summary of report files, with all failures ranked."""
    from .sources.reports import read_reports

    df = read_reports(spark, [str(p) for p in paths])
    said = rp.summarize(df).first().asDict()
    return said | {"validation_failures": {r.reason: r.n for r in rp.failure_ranking(df).collect()}}


__all__ = ["FORMATS", "preview_file", "summarize_files", "translate_file", "translate_text"]
