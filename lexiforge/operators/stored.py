"""Tables in the folder that driver and executors share.

What an engine gave is stored before two results are made of it, so that it is
asked once, and again only for tasks whose write was lost.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, or a temporary one where all of Spark is on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    had = sc._jsc.sc().getCheckpointDir()
    if had.isDefined():
        return str(had.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
    sc.setCheckpointDir(own)
    return own


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_MADE: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already
            return


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lexiforge/{tag}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored in it are deleted at its end, but for those stored with `keep`."""
    made: list[DataFrame] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        released(*made)


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    It cuts the lineage and survives the loss of executors. A table with `keep`
    outlives the scratch it is stored in, up to the end of the driver.
    """
    path = table_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_in = path
    made = _SCRATCH.get()
    if made is not None and not keep:
        made.append(out)
    return out


def released(*tables: DataFrame | None) -> None:
    """Delete tables that `stored` made and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_in", None)
        if path in _MADE:
            delete_path(_MADE.pop(path), path)
