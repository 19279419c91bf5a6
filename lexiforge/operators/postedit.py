"""Post-edit of routed drafts, in chunks and one by one, with fallbacks.

A unit's segments are one row here, as they were in the unit's text, so chunk
fallback can go over a chunk's members in order without a further shuffle.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PostEditSettings
from ..functions import plain
from . import glossary
from .chunks import MERGED, chunks_of
from .segments import KEYS

COUNTS = ("glossary_replacements", "fallback_count", "llm_calls", "llm_skipped", "llm_chunks_built", "max_chunk_size", "chunk_fallbacks", "segment_fallbacks", "llm_calls_saved_by_chunking")
EDITED = (
    "edited array<struct<seg_idx:int,final:string,failure_reason:string>>, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", avg_chunk_size double, avg_llm_latency_per_segment double, avg_llm_latency_per_chunk double"
    + ", validation_failures map<string,long>, chunk_boundary_reasons map<string,long>, chunk_merge_reasons map<string,long>"
    + ", chunk_trace array<struct<segment_indices:array<int>,routing_mode:string,character_count:int,placeholder_count:int,merge_reason:string,boundary_reason:string>>"
)


def reported() -> list[Column]:
    """What reports ask of a segment."""
    said = {c: F.col(f"decision.{c}") for c in ("use_llm", "mode", "reason")}
    return [F.col("error"), *(x.alias(c) for c, x in said.items()), F.length("draft").alias("chars"), F.col("mark_count"), F.col("replaced")]


class Unit:
    """The post-edit of a unit's routed segments and what it counts."""

    def __init__(self, rows: list[dict], entries: plain.Entries, settings: PostEditSettings, edit: plain.Edit | None):
        self.rows, self.entries, self.settings, self.edit = {r["seg_idx"]: r for r in rows}, entries, settings, edit
        self.drafts = {k: r["draft"] for k, r in self.rows.items()}
        self.reasons: dict[int, str | None] = dict.fromkeys(self.rows)
        self.n = Counter()
        self.failures, self.boundaries, self.merged = Counter(), Counter(), Counter()
        self.sizes: list[int] = []
        self.segment_s: list[float] = []
        self.chunk_s: list[float] = []
        self.handled: set[int] = set()
        self.trace: list[dict] = []

    def _timed(self, *asked) -> str:
        """The engine's answer; its time alone is a segment's latency."""
        began = time.perf_counter()
        try:
            return self.edit(*asked)
        finally:
            self.segment_s[-1] = time.perf_counter() - began

    def single(self, k: int) -> None:
        row = self.rows[k]
        self.n["llm_calls"] += 1
        self.segment_s.append(0.0)
        out = plain.post_edit(self._timed if self.edit else None, row["source"], self.drafts[k], self.entries, self.settings, row["mode"])
        self.drafts[k] = out.text
        self.reasons[k] = out.reason
        self.n["fallback_count"] += out.fallback
        self.n["segment_fallbacks"] += out.fallback
        self.n["glossary_replacements"] += out.replaced
        if out.reason:
            self.failures[out.reason] += 1

    def chunk(self, chunk: dict) -> None:
        """One call for all members; after any failure each member alone.

        Members that were taken before the failing one keep their new drafts and
        are edited again.
        """
        members = chunk["segment_indices"]
        self.sizes.append(len(members))
        self.merged[MERGED] += 1
        if chunk["boundary_reason"]:
            self.boundaries[chunk["boundary_reason"]] += 1
        self.trace.append({k: chunk[k] for k in ("segment_indices", "routing_mode", "character_count", "placeholder_count", "boundary_reason")} | {"merge_reason": MERGED})
        self.n["llm_calls"] += 1
        began = time.perf_counter()
        ok = self._together(members, chunk["routing_mode"])
        self.chunk_s.append(time.perf_counter() - began)
        if ok:
            self.n["llm_calls_saved_by_chunking"] += max(0, len(members) - 1)
        else:
            self.n["chunk_fallbacks"] += 1
            for k in members:
                self.single(k)
        self.handled.update(members)

    def _together(self, members: list[int], mode: str) -> bool:
        try:
            if self.edit is None:
                raise RuntimeError("no engine")
            candidate = self.edit(plain.chunk_payload([self.rows[k]["source"] for k in members]), plain.chunk_payload([self.drafts[k] for k in members]), self.entries, mode)
        except Exception:  # noqa: BLE001 - an engine's failure is a fallback
            return False
        texts, reason = plain.parse_chunk(candidate, len(members))
        if texts is None:
            self.failures[reason] += 1
            return False
        for k, text in zip(members, texts, strict=True):
            out = plain.judge(self.rows[k]["source"], self.drafts[k], text, self.entries, self.settings)
            if out.fallback:
                self.failures[out.reason] += 1
                return False
            self.drafts[k] = out.text
            self.n["glossary_replacements"] += out.replaced
        return True

    def run(self, chunks: list[dict]) -> dict:
        for c in chunks:
            self.chunk(c)
        for k in self.rows:
            if k not in self.handled:
                self.single(k)
        edited = []
        for k, row in self.rows.items():
            text, restored = plain.restore_terms(self.drafts[k], [(m["ph"], m["lit"]) for m in row["marks"] or []])
            text, applied = plain.apply_glossary(text, self.entries)
            self.n["glossary_replacements"] += restored + applied
            edited.append({"seg_idx": k, "final": plain.normalize_spacing(text), "failure_reason": self.reasons[k]})
        self.n["llm_chunks_built"], self.n["max_chunk_size"] = len(self.sizes), max(self.sizes, default=0)
        mean = lambda x: sum(x) / len(x) if x else 0.0
        return {
            "edited": edited, **{c: self.n[c] for c in COUNTS}, "avg_chunk_size": mean(self.sizes), "avg_llm_latency_per_segment": mean(self.segment_s), "avg_llm_latency_per_chunk": mean(self.chunk_s),
            "validation_failures": list(self.failures.items()), "chunk_boundary_reasons": list(self.boundaries.items()), "chunk_merge_reasons": list(self.merged.items()), "chunk_trace": self.trace,
        }


def _arrow_schema() -> pa.Schema:
    counts = pa.map_(pa.string(), pa.int64())
    segment = pa.struct([("seg_idx", pa.int32()), ("final", pa.string()), ("failure_reason", pa.string())])
    chunk = pa.struct([("segment_indices", pa.list_(pa.int32())), ("routing_mode", pa.string()), ("character_count", pa.int32()), ("placeholder_count", pa.int32()), ("merge_reason", pa.string()), ("boundary_reason", pa.string())])
    return pa.schema(
        [("edited", pa.list_(segment)), *((c, pa.int64()) for c in COUNTS)]
        + [(c, pa.float64()) for c in ("avg_chunk_size", "avg_llm_latency_per_segment", "avg_llm_latency_per_chunk")]
        + [("validation_failures", counts), ("chunk_boundary_reasons", counts), ("chunk_merge_reasons", counts), ("chunk_trace", pa.list_(chunk))]
    )


def post_edit_units(routed: DataFrame, entries: plain.Entries, settings: PostEditSettings, edit: plain.Edit | None) -> DataFrame:
    """One row per unit: its text, its segments, `rows` for the report and what was counted.

    `routed` has source, draft, marks, replaced, error, decision, mark_count and
    chunk eligibility. Chunks are packed from the unit's one row. Python gets the
    routed segments alone; all others are finished by column expressions.
    """
    called = F.col("decision.use_llm") & F.col("decision.mode").isNotNull()
    done = glossary.finish(routed.withColumns({"_called": F.coalesce(called, F.lit(False)), "_left": F.when(F.coalesce(called, F.lit(False)), F.lit(None)).otherwise(F.col("draft"))}), entries, "_left", "marks", "_text")
    row = F.struct(
        "seg_idx", "draft", F.col("_text").alias("text"), F.col("_called").alias("called"), F.col("can_chunk").alias("can"), F.when(F.col("_called"), F.col("source")).alias("source"), F.when(F.col("_called"), F.col("marks")).alias("marks"),
        *reported()[:-1], (F.col("replaced") + F.col("_text_n")).alias("replaced"),
    )
    units = done.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    asked = F.transform(F.filter("rows", lambda x: x["called"]), lambda x: F.struct(*(x[c].alias(c) for c in ("seg_idx", "source", "draft", "marks", "mode"))))
    open_rows = F.transform("rows", lambda x: F.struct(x["seg_idx"].alias("seg_idx"), x["chars"].alias("chars"), x["mark_count"].alias("marks"), x["mode"].alias("mode"), x["can"].alias("can")))
    chunks = chunks_of(open_rows, settings, 2) if settings.enable_chunking else F.lit(None).cast("array<struct<segment_indices:array<int>,character_count:int,placeholder_count:int,routing_mode:string,boundary_reason:string>>")
    kept = F.transform("rows", lambda x: F.struct(*(x[c].alias(c) for c in ("seg_idx", "draft", "text", "error", "use_llm", "mode", "reason", "chars", "mark_count", "replaced"))))
    units = units.select(*KEYS, asked.alias("asked"), chunks.alias("chunks"), kept.alias("rows"))
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            made = pa.RecordBatch.from_pylist([Unit(rows, entries, settings, edit).run(packed or []) for rows, packed in work], schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *made.columns], names=[*KEYS, "rows", *schema.names])

    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    out = units.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*KEYS, "rows")) + ", " + EDITED)
    by_place = F.map_from_arrays(F.transform("edited", lambda e: e["seg_idx"]), F.col("edited"))
    segment = lambda x, e: F.struct(x["seg_idx"].alias("seg_idx"), x["draft"].alias("draft"), F.coalesce(e["final"], x["text"]).alias("final"), e["failure_reason"].alias("failure_reason"))
    out = out.withColumn("_edits", by_place).withColumn("segments", F.transform("rows", lambda x: segment(x, F.try_element_at("_edits", x["seg_idx"])))).drop("_edits")
    return out.withColumns({
        "text": F.array_join(F.transform("segments", lambda x: x["final"]), " "), "llm_skipped": (F.size("rows") - F.size("edited")).cast("long"),
        "glossary_replacements": F.col("glossary_replacements") + F.aggregate("rows", F.lit(0).cast("long"), lambda n, x: n + x["replaced"]),
    }).drop("edited")


def reinject_placeholders(df: DataFrame, candidate: str, marks: str, into: str = "reinjected") -> DataFrame:
    """Adds the candidate in canonical form, literals put back as placeholders."""
    at = (df.columns.index(candidate), df.columns.index(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                pairs = [(p["ph"], p["lit"]) for p in pairs or []]
                out.append(None if text is None else plain.reinject(plain.canonical(text, pairs), pairs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, df.withColumn(into, F.lit(None).cast("string")).schema)
