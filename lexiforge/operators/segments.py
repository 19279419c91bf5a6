"""Units to sentence segments and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

KEYS = ["doc_id", "unit_idx"]


def units_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as one unit of its document; null texts have none."""
    kept = [c for c in docs.columns if c not in (id_col, text_col)]
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lit(0).alias("unit_idx"), F.col(text_col).alias("text"), *kept)


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line of a text as a unit, blank lines too."""
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(tx.lines(F.col(text_col))).alias("unit_idx", "text"))


def segment(units: DataFrame) -> DataFrame:
    """One row per sentence, with its place in the unit."""
    rest = [c for c in units.columns if c != "text"]
    return units.select(*rest, F.posexplode(tx.sentences(F.col("text"))).alias("seg_idx", "text"))


def rejoin(segments: DataFrame, keys: list[str] | None = None, order: str = "seg_idx", separator: str = " ") -> DataFrame:
    """The texts of a group in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(order, "text")))
    return segments.groupBy(*(keys or KEYS)).agg(F.array_join(F.transform(rows, lambda x: x["text"]), separator).alias("text"))


def preview(units: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Units of each document, 0 where there are none."""
    counted = units.groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("n_units"))
    return docs.select(F.col(id_col).alias("doc_id")).join(counted, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", F.coalesce("n_units", F.lit(0)).alias("n_units"))
