"""Translation of arriving documents.

Segmentation, glossary and routing need no state. Chunks and joined texts are of
one unit, which is one row, so each micro-batch is translated as a batch of its
own and no state store grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RunConfig
from ..operators.routing import route
from ..operators.segments import segment, units_of
from ..plans.translate import translated_text


def routed_stream(documents: DataFrame, config: RunConfig) -> DataFrame:
    """A stream of segments with features and decisions."""
    return route(segment(units_of(documents)).withColumn("draft", F.col("text")), config.settings)


def translate_stream(documents: DataFrame, config: RunConfig, output: str, checkpoint: str, engine=None, edit=None, available_now: bool = True) -> StreamingQuery:
    """Write (doc_id, unit_idx, text) of each micro-batch as Parquet, once per batch."""

    def write(batch: DataFrame, number: int) -> None:
        translated_text(units_of(batch.select("doc_id", "text")), config, engine, edit).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
