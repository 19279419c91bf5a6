"""Helpers that all operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stored import delete_path, released, scratch, shared_dir, table_path
from ..operators.stored import stored as written


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as keep it from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of a table's files, as Spark estimates them, up to which it is broadcast whole; a few times that in memory.
BROADCAST_BYTES = 8 << 20
#: Keys that hold a larger share of all rows are broadcast, one over the share at most.
HOT_SHARE = 1e-4


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, from its files; very large where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_singles(rows: DataFrame, singles: DataFrame, keys: list[str], spread: list[str], how: str = "inner", whole: bool = True) -> DataFrame:
    """Join `rows` with a stored table of one row for each key, whose column `n` counts the rows it meets.

    However many rows one key has, none of them meet in a task. A small table is
    broadcast, if `whole` allows it. Of a larger one, only the keys of many rows are; their rows have
    their partner then, and are dealt by the columns `spread` in the exchange that
    finds the partners of all others. `n` isn't in the result.
    """
    values = [c for c in singles.columns if c not in (*keys, "n")]
    if whole and plan_bytes(singles) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(singles.drop("n")), keys, how)
    partner = F.struct(F.lit(True).alias("_"), *values)
    many = (singles.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    first, *rest = keys
    hot = singles.where(F.col("n") >= many).select(*keys, partner.alias("_hot"))
    cold = singles.where(F.col("n") < many).select(F.col(first).alias("_key"), *rest, F.lit(False).alias("_is_hot"), partner.alias("_cold"))
    apart = F.col("_hot").isNotNull() | F.col(first).isNull()  # no partner is looked for
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_is_hot", apart)
    aside = F.xxhash64(*spread)
    if isinstance(rows.schema[first].dataType, T.BinaryType):
        aside = F.encode(F.hex(aside), "UTF-8")
    dealt = dealt.withColumn("_key", F.when(F.col("_is_hot"), aside).otherwise(F.col(first)))
    met = dealt.join(cold, ["_key", *rest, "_is_hot"], "left").withColumn("_met", F.coalesce("_hot", "_cold"))
    if how == "inner":
        met = met.where("_met is not null")
    return met.select(*rows.columns, *(F.col(f"_met.{c}").alias(c) for c in values))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


__all__ = ["delete_path", "documents", "free_name", "join_singles", "plan_bytes", "released", "scratch", "shared_dir", "table_path", "written"]
