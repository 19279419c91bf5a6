"""Reports of units, documents and runs, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.postedit import COUNTS
from ..operators.segments import KEYS

MAPS = ("validation_failures", "routing_reasons", "chunk_boundary_reasons", "chunk_merge_reasons")
MEANS = ("avg_chunk_size", "avg_llm_latency_per_segment", "avg_llm_latency_per_chunk")
SUMMED = ("segment_count", "translated_count", "skipped_count", "error_count", "llm_safe_segments", "llm_smart_segments", *(c for c in COUNTS if c != "max_chunk_size"))

#: Reports as JSON files hold them; absent keys are null.
SCHEMA = (
    "segment_count long, translated_count long, skipped_count long, elapsed_seconds double, error_count long, errors array<string>, fallback_count long, glossary_replacements long, llm_calls long, llm_skipped long,"
    " llm_safe_segments long, llm_smart_segments long, llm_chunks_built long, avg_chunk_size double, max_chunk_size long, chunk_fallbacks long, segment_fallbacks long, avg_llm_latency_per_segment double,"
    " avg_llm_latency_per_chunk double, llm_calls_saved_by_chunking long, validation_failures map<string,long>, placeholder_mismatch_count long, glossary_placeholder_mismatch_count long, routing_reasons map<string,long>,"
    " chunk_boundary_reasons map<string,long>, chunk_merge_reasons map<string,long>, routing_trace array<struct<segment_index:int,mode:string,reason:string,char_count:int,placeholder_count:int>>,"
    " chunk_trace array<struct<segment_indices:array<int>,routing_mode:string,character_count:int,placeholder_count:int,merge_reason:string,boundary_reason:string>>"
)
KEYS_IN_ORDER = (
    "segment_count", "translated_count", "skipped_count", "elapsed_seconds", "error_count", "errors", "fallback_count", "glossary_replacements", "llm_calls", "llm_skipped",
    "llm_safe_segments", "llm_smart_segments", "llm_chunks_built", "avg_chunk_size", "max_chunk_size", "chunk_fallbacks", "segment_fallbacks", "avg_llm_latency_per_segment",
    "avg_llm_latency_per_chunk", "llm_calls_saved_by_chunking", "validation_failures", "placeholder_mismatch_count", "glossary_placeholder_mismatch_count", "routing_reasons",
    "chunk_boundary_reasons", "chunk_merge_reasons", "routing_trace", "chunk_trace",
)
_TRACE = "array<struct<segment_indices:array<int>,routing_mode:string,character_count:int,placeholder_count:int,merge_reason:string,boundary_reason:string>>"


def histogram(values: Column) -> Column:
    """Counts of the values of a collected list, as a map by key."""
    keys = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(values, lambda v: v == k)).cast("long")))


def _empty_map() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))


def unit_report(units: DataFrame) -> DataFrame:
    """Adds the report to units, in place of `rows`, their segments as the router saw them.

    What the post-edit counted is taken where it is there, and is nothing elsewhere.
    """
    rows = F.col("rows")
    failed = F.filter(rows, lambda x: x["error"].isNotNull())
    count = lambda mode: F.size(F.filter(rows, lambda x: x["mode"] == mode)).cast("long")
    entry = lambda x: F.struct(x["seg_idx"].alias("segment_index"), F.when(x["use_llm"], x["mode"]).otherwise("skip").alias("mode"), x["reason"].alias("reason"), x["chars"].alias("char_count"), F.when(x["error"].isNull(), x["mark_count"]).otherwise(0).alias("placeholder_count"))
    own = {
        "segment_count": F.size(rows).cast("long"), "error_count": F.size(failed).cast("long"), "translated_count": (F.size(rows) - F.size(failed)).cast("long"), "skipped_count": F.lit(0).cast("long"),
        "errors": F.transform(failed, lambda x: x["error"]), "llm_safe_segments": count("safe"), "llm_smart_segments": count("smart"), "routing_trace": F.transform(rows, entry), "routing_reasons": histogram(F.transform(rows, lambda x: x["reason"])),
    }
    if "llm_calls" not in units.columns:
        own |= {c: F.lit(0).cast("long") for c in COUNTS} | {c: F.lit(0.0) for c in MEANS} | {c: _empty_map() for c in MAPS if c != "routing_reasons"} | {"chunk_trace": F.array().cast(_TRACE)}
        own["glossary_replacements"] = F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + x["replaced"])
    of = lambda key: F.coalesce(F.try_element_at("validation_failures", F.lit(key)), F.lit(0)).cast("long")
    return units.withColumns(own).withColumns({"placeholder_mismatch_count": of("placeholder_mismatch"), "glossary_placeholder_mismatch_count": of("glossary_placeholder_mismatch")}).drop("rows")


def _added(maps: Column) -> Column:
    """Maps of a group added key by key, as one map sorted by key."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"), lambda n, e: n + e["value"])))


def merge_reports(reports: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Reports of units as one per document: sums, weighted means, maps added.

    Segment latencies are weighted by calls, one at least, chunks' by chunks built.
    One aggregation, so units are read, and made, once.
    """
    keys = keys or ["doc_id"]
    calls, chunks = F.greatest("llm_calls", F.lit(1)), F.greatest("llm_chunks_built", F.lit(1))
    over = lambda total, n: F.coalesce(F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0))
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", c))), lambda x: x[c])).alias(c)
    return reports.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in SUMMED), F.max("max_chunk_size").alias("max_chunk_size"), over(F.col("avg_chunk_size") * F.col("llm_chunks_built"), "llm_chunks_built").alias("avg_chunk_size"),
        over(F.col("avg_llm_latency_per_segment") * calls, "llm_calls").alias("avg_llm_latency_per_segment"), over(F.col("avg_llm_latency_per_chunk") * chunks, "llm_chunks_built").alias("avg_llm_latency_per_chunk"),
        F.sum("placeholder_mismatch_count").alias("placeholder_mismatch_count"), F.sum("glossary_placeholder_mismatch_count").alias("glossary_placeholder_mismatch_count"),
        ordered("errors"), ordered("routing_trace"), ordered("chunk_trace"), *(F.collect_list(m).alias(m) for m in MAPS),
    ).withColumns({m: _added(F.col(m)) for m in MAPS})


def _share(part: str) -> Column:
    return F.coalesce(F.sum(part), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("segment_count"), F.lit(0)))


def summarize(reports: DataFrame, rounded: bool = True) -> DataFrame:
    """One row over all reports; absent columns' nulls count as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    near = (lambda c, n: F.round(c, n)) if rounded else (lambda c, n: c)
    size = F.coalesce(F.try_divide(F.sum(F.coalesce("avg_chunk_size", F.lit(0.0)) * F.coalesce("llm_chunks_built", F.lit(0))), F.sum("llm_chunks_built")), F.lit(0.0))
    return reports.agg(
        F.count("*").alias("reports"), F.coalesce(F.sum("segment_count"), F.lit(0)).cast("long").alias("segments"), near(_share("llm_skipped"), 4).alias("llm_skip_rate"), near(_share("llm_safe_segments"), 4).alias("safe_share"),
        near(_share("llm_smart_segments"), 4).alias("smart_share"), total("chunk_fallbacks"), total("segment_fallbacks"), near(size, 3).alias("avg_chunk_size"), total("llm_calls_saved_by_chunking"),
    )


def failure_ranking(reports: DataFrame, column: str = "validation_failures") -> DataFrame:
    """All reasons with their counts and places: the most frequent first, then by name."""
    counted = reports.select(F.explode(column).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
    # There are as many rows as the rules have reasons.
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason"))).orderBy("place")


#: Lines of the readable report: label and how its value is shown. Fixed values.
LINES = (
    ("Segments processed", "{segment_count}"),
    ("LLM skipped", "{llm_skipped}"),
    ("SAFE segments", "{llm_safe_segments}"),
    ("SMART segments", "{llm_smart_segments}"),
    ("LLM calls", "{llm_calls}"),
    ("Chunks built", "{llm_chunks_built} (avg size={avg_chunk_size:.2f}, max size={max_chunk_size})"),
    ("Chunk fallbacks", "{chunk_fallbacks}"),
    ("Segment fallbacks", "{segment_fallbacks}"),
    ("Fallbacks", "{fallback_count}"),
    ("Validation failures", "{validation_failures}"),
    ("Placeholder mismatches", "{placeholder_mismatch_count}"),
    ("Glossary placeholder mismatches", "{glossary_placeholder_mismatch_count}"),
    ("Avg LLM latency per segment", "{avg_llm_latency_per_segment:.3f}s"),
    ("Avg LLM latency per chunk", "{avg_llm_latency_per_chunk:.3f}s"),
    ("Estimated calls saved by chunking", "{llm_calls_saved_by_chunking}"),
    ("Errors", "{error_count}"),
    ("Glossary replacements", "{glossary_replacements}"),
    ("Time", "{elapsed_seconds:.3f}s"),
)


def readable(report: dict) -> str:
    return "\n".join(["Execution report", *(f"{label}: {shown.format(**report)}" for label, shown in LINES)])


def rounded(report: dict) -> dict:
    """A report as it is written: seconds to 6 places, the mean chunk size to 3."""
    places = {"elapsed_seconds": 6, "avg_llm_latency_per_segment": 6, "avg_llm_latency_per_chunk": 6, "avg_chunk_size": 3}
    return {k: round(report[k], places[k]) if k in places else report[k] for k in KEYS_IN_ORDER if k in report}
