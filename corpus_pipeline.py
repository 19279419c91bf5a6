"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets, packing.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's `docs`. All but the last return the
columns of documents, extra ones and their names included.

In all stages rows without id and repeated rows are carried along, texts of any
length are taken whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm.decontamination import drop_contaminated
from lexiforge.llm.near_dedup import drop_near_duplicates
from lexiforge.llm.packing import pack
from lexiforge.llm.quality_rules import keep_quality
from lexiforge.llm.secret_scan import redact_secrets
from lexiforge.llm.shared import table_path
from lexiforge.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts go, as they have no words; a document that meets a bound
    exactly (a tie) stays; repeated rows stay or go together.
    """
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8.

    It is the one of smallest id. Ids are decided on, so rows that repeat its id
    stay with it; rows without id, null and empty texts are linked with nothing and stay.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of the benchmark go.

    Null and empty texts have no words and stay; repeated rows stay or go together;
    an empty benchmark leaves all.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; no document goes.

    Null texts stay null; overlapping secrets are replaced as one; rows are
    redacted one by one, so repeated rows stay equal.
    """
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; of equally cheap cuts (ties) the
    latest is taken; repeated rows each give pieces.
    """
    return pack(docs, default_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("packing", packing),
]

#: The method's rules, token test and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = table_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
