"""Packing of neighbouring segments into bounded calls, payloads and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PostEditSettings
from ..functions import text as tx
from .segments import KEYS

MERGED = "merged_consecutive_prose_segments"
MODE_CHANGE, MAX_SEGMENTS, MAX_CHARS = "stopped_due_to_mode_change", "stopped_due_to_max_segments", "stopped_due_to_max_chars"

_STATE = "struct<done:array<struct<segment_indices:array<int>,character_count:int,placeholder_count:int,routing_mode:string,boundary_reason:string>>,idx:array<int>,chars:int,marks:int,mode:string,why:string>"


def _packed(rows: Column, s: PostEditSettings) -> Column:
    """Chunks of a unit's ordered segments, as a fold whose state is the open chunk.

    The reason of an ineligible segment is carried while no chunk is open, as far
    as the next chunk that ends without a reason of its own.
    """
    none = F.lit(None).cast("string")
    start = F.struct(F.array().alias("done"), F.array().alias("idx"), F.lit(0).alias("chars"), F.lit(0).alias("marks"), none.alias("mode"), none.alias("why")).cast(_STATE)

    def closed(a: Column, why: Column) -> Column:
        chunk = F.struct(a["idx"].alias("segment_indices"), a["chars"].alias("character_count"), a["marks"].alias("placeholder_count"), a["mode"].alias("routing_mode"), why.alias("boundary_reason"))
        return F.concat(a["done"], F.array(chunk))

    def state(done: Column, idx: Column, chars: Column, marks: Column, mode: Column, why: Column) -> Column:
        return F.struct(done.alias("done"), idx.alias("idx"), chars.alias("chars"), marks.alias("marks"), mode.alias("mode"), why.alias("why")).cast(_STATE)

    def step(a: Column, x: Column) -> Column:
        is_open, size = F.size(a["idx"]) > 0, F.size(a["idx"])
        zero = F.lit(0)
        stopped = F.when(is_open, state(closed(a, F.lit(MODE_CHANGE)), F.array().cast("array<int>"), zero, zero, none, none)).otherwise(state(a["done"], a["idx"], zero, zero, none, F.lit(MODE_CHANGE)))
        full = is_open & ((size >= s.chunk_max_segments) | (a["chars"] + x["chars"] > s.chunk_max_chars))
        why = F.when(size >= s.chunk_max_segments, MAX_SEGMENTS).otherwise(MAX_CHARS)
        anew = state(closed(a, why), F.array(x["seg_idx"]), x["chars"], x["marks"], x["mode"], none)
        longer = state(a["done"], F.concat(a["idx"], F.array(x["seg_idx"])), a["chars"] + x["chars"], a["marks"] + x["marks"], F.when(is_open, a["mode"]).otherwise(x["mode"]), a["why"])
        return F.when(~x["can"], stopped).when(full, anew).otherwise(longer)

    return F.aggregate(rows, start, step, lambda a: F.when(F.size(a["idx"]) > 0, closed(a, a["why"])).otherwise(a["done"]))


def chunks_of(rows: Column, settings: PostEditSettings, least_size: int = 1) -> Column:
    """Chunks of a unit's ordered segments (seg_idx, chars, marks, mode, can)."""
    return F.filter(_packed(rows, settings), lambda c: (F.size(c["segment_indices"]) >= least_size) & c["routing_mode"].isNotNull())


def pack(routed: DataFrame, settings: PostEditSettings, least_size: int = 1, draft: str = "draft") -> DataFrame:
    """One row per chunk: its segments, size, mode of the first member and why it ended.

    Chunks never span units; a unit's segments are gathered in order for the fold.
    """
    row = F.struct("seg_idx", F.length(draft).alias("chars"), F.col("mark_count").alias("marks"), F.col("decision.mode").alias("mode"), F.col("can_chunk").alias("can"))
    units = routed.groupBy(*KEYS).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    chunks = units.select(*KEYS, F.posexplode(chunks_of(F.col("rows"), settings, least_size)).alias("chunk_idx", "c")).select(*KEYS, "chunk_idx", "c.*")
    return chunks.withColumn("merge_reason", F.lit(MERGED))


def payload(texts: Column) -> Column:
    """Texts as numbered blocks with a blank line between them."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("[SEGMENT_"), i.cast("string"), F.lit("]\n"), x, F.lit("\n[/SEGMENT_"), i.cast("string"), F.lit("]"))), "\n\n")


BLOCK = r"(?Us)\[SEGMENT_(\d+)\]\n(.*?)\n\[/SEGMENT_\1\]"


def parsed(candidate: Column, expected: Column) -> Column:
    """texts and reason: the bodies of all blocks, or why there are none."""
    numbers, bodies = F.regexp_extract_all(candidate, F.lit(BLOCK), F.lit(1)), F.regexp_extract_all(candidate, F.lit(BLOCK), F.lit(2))
    rest = F.regexp_replace(candidate, BLOCK, "")
    in_order = F.forall(F.transform(numbers, lambda x, i: x.cast("int") == i), lambda ok: ok)
    reason = F.when(F.size(numbers) != expected, "missing_segment").when(~in_order | ~tx.is_blank(rest), "malformed_markers")
    return F.struct(F.when(reason.isNull(), F.transform(bodies, tx.strip)).alias("texts"), reason.alias("reason"))
