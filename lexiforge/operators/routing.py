"""Features of drafts and the rule-based router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PostEditSettings
from ..functions import text as tx


def with_features(segments: DataFrame, draft: str = "draft", targets: list[str] | None = None) -> DataFrame:
    c = F.col(draft)
    return segments.withColumns({
        "char_count": F.length(c),
        "placeholder_count": tx.placeholder_count(c),
        "technical_token_count": tx.technical_count(c),
        "sentence_count": tx.sentence_count(c),
        "glossary_hits": tx.target_hits(c, targets or []),
        "placeholder_ratio": tx.placeholder_ratio(c),
    })


def decision(s: PostEditSettings) -> Column:
    """use_llm, mode, reason of a row with features; the first rule that holds."""

    def said(mode: str | Column | None, reason: str) -> Column:
        mode = F.lit(None).cast("string") if mode is None else F.lit(mode)
        return F.struct(mode.isNotNull().alias("use_llm"), mode.alias("mode"), F.lit(reason).alias("reason"))

    if s.policy == "off":
        return said(None, "mode_off")
    rules = [
        (F.col("char_count") < s.skip_short_characters, None, "short_plain_segment"),
        (F.col("placeholder_ratio") > s.skip_high_placeholder_ratio, None, "high_placeholder_density"),
    ]
    if s.policy in ("safe", "smart"):
        rules.append((F.lit(True), s.policy, "forced_mode"))
    rules += [
        (F.col("technical_token_count") >= s.technical_token_threshold, "safe", "technical_token_density"),
        (F.col("placeholder_count") >= s.safe_placeholder_count, "safe", "high_placeholder_density"),
        (F.col("sentence_count") >= s.multi_sentence_threshold, "smart", "multi_sentence_prose"),
        (F.col("char_count") >= s.smart_min_chars, "smart", "long_natural_language_segment"),
    ]
    out: Column | None = None
    for condition, mode, reason in rules:
        out = F.when(condition, said(mode, reason)) if out is None else out.when(condition, said(mode, reason))
    return out.otherwise(said("safe", "default_safe"))


def route(segments: DataFrame, settings: PostEditSettings | None = None, draft: str = "draft", targets: list[str] | None = None) -> DataFrame:
    """Features, the decision, and whether the draft may share a call with others."""
    s = settings or PostEditSettings()
    routed = with_features(segments, draft, targets).withColumn("decision", decision(s))
    marks = tx.mark_count(F.col(draft))
    eligible = F.col("decision.use_llm") & (F.col("char_count") >= s.chunk_min_chars) & (marks <= s.chunk_max_placeholders) & (F.col("technical_token_count") == 0) & F.lit(s.enable_chunking)
    return routed.withColumns({"mark_count": marks, "can_chunk": eligible})


def reason_histogram(routed: DataFrame, *by: str) -> DataFrame:
    return routed.groupBy(*by, F.col("decision.reason").alias("reason")).agg(F.count("*").alias("n"))
