"""The translation plan: units to segments, drafts, routes, post-edit and output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineMode, RunConfig
from ..operators import engines, glossary
from ..operators.postedit import post_edit_units, reported
from ..operators.routing import route
from ..operators.segments import KEYS, rejoin, segment
from ..operators.stored import stored
from .reports import unit_report


def prepare(units: DataFrame, config: RunConfig, engine=None) -> DataFrame:
    """Segments with source, draft, marks, replaced, error and the router's columns.

    A segment whose engine failed has its source as draft and is never edited.
    """
    entries = config.glossary
    segments = segment(units.select(*KEYS, "text")).withColumnRenamed("text", "source")
    marked = glossary.protect(segments, entries, "source", "prepared")
    engine = engines.identity() if config.engine == EngineMode.LLM or engine is None else engine
    raw = engine.draft(marked, "prepared", "raw")
    applied = glossary.apply(raw, entries, "raw", "with_terms")
    restored = glossary.restore(applied, entries, "with_terms", "prepared_map", "restored")
    failed = F.col("raw_error").isNotNull()
    drafts = restored.select(
        *KEYS, "seg_idx", "source", F.when(failed, F.col("source")).otherwise(F.col("restored")).alias("draft"),
        F.when(failed, F.array().cast(glossary.MARKS)).otherwise(F.col("prepared_map")).alias("marks"),
        (F.col("prepared_n") + F.when(failed, 0).otherwise(F.col("with_terms_n") + F.col("restored_n"))).alias("replaced"), F.col("raw_error").alias("error"),
    )
    routed = route(drafts, config.settings, targets=[t for _, t in entries])
    none = F.struct(F.lit(False).alias("use_llm"), F.lit(None).cast("string").alias("mode"), F.lit("segment_error").alias("reason"))
    return routed.withColumns({"decision": F.when(F.col("error").isNotNull(), none).otherwise(F.col("decision")), "can_chunk": F.col("can_chunk") & F.col("error").isNull()})


def translated(units: DataFrame, config: RunConfig, engine=None, edit=None) -> DataFrame:
    """One row per unit: its text, its segments and its report.

    A plan with one exchange, in which every engine is asked once for a segment
    or chunk. Each action on it asks the engines anew.
    """
    prepared = prepare(units, config, engine)
    if config.engine != EngineMode.ARGOS:
        return unit_report(post_edit_units(prepared, config.glossary, config.settings, edit))
    finished = glossary.finish(prepared, config.glossary, "draft", "marks", "text").withColumn("replaced", F.col("replaced") + F.col("text_n"))
    rows = finished.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("seg_idx", "text", *reported()))).alias("rows"))
    segments = F.transform("rows", lambda x: F.struct(x["seg_idx"].alias("seg_idx"), x["text"].alias("final")))
    return unit_report(rows.withColumns({"text": F.array_join(F.transform("rows", lambda x: x["text"]), " "), "segments": segments}))


def translated_text(units: DataFrame, config: RunConfig, engine=None, edit=None) -> DataFrame:
    """(doc_id, unit_idx, text) alone, without the work that only reports need; a lazy plan."""
    if config.engine != EngineMode.ARGOS:
        return translated(units, config, engine, edit).select(*KEYS, "text")
    return rejoin(glossary.finish(prepare(units, config, engine), config.glossary, "draft", "marks", "text"))


def translate_units(units: DataFrame, config: RunConfig, engine=None, edit=None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, unit_idx, text) of every unit, and a report of every unit.

    Where an engine is no column expression, the units are stored first, so that
    both come from the same answers of the engine.
    """
    done = translated(units, config, engine, edit)
    if edit is not None or not (engine is None or isinstance(engine, engines.NativeEngine)):
        done = stored(done, "translated")
        return done.select(*KEYS, "text"), done.drop("text", "segments")
    return translated_text(units, config, engine), done.drop("text", "segments")
