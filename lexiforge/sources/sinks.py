"""Writers of translated documents as texts and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def ordered_texts() -> Column:
    """A group's unit texts in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct("unit_idx", "text"))), lambda x: x["text"])


def with_fallback(original: DataFrame, translated: DataFrame) -> DataFrame:
    """The translation of each unit; where it lacks one, the original, or nothing."""
    mine = translated.select(F.col("doc_id"), F.col("unit_idx"), F.col("text").alias("_translated"))
    return original.join(mine, ["doc_id", "unit_idx"], "left").withColumn("text", F.coalesce("_translated", "text", F.lit(""))).drop("_translated")


def text_file(units: DataFrame) -> DataFrame:
    """Units of a plain text joined by line ends, with none added."""
    return units.groupBy("doc_id").agg(F.array_join(ordered_texts(), "\n").alias("text"))


def markdown_file(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines with a line end after the last; an empty document is one line end."""
    joined = units.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_join(ordered_texts(), "\n").alias("text"))
    return docs.select("doc_id").join(joined, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))


def sidecar(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Units stripped, blank ones dropped, with a blank line between them."""
    kept = F.filter(F.transform(ordered_texts(), tx.strip), lambda x: x != "")
    joined = units.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_join(kept, "\n\n").alias("text"))
    return docs.select("doc_id").join(joined, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
