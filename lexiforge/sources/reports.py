"""Reports as JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.reports import SCHEMA, rounded


def read_reports(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Reports of files that hold one each, or one a line."""
    return spark.read.schema(SCHEMA).option("multiLine", not lines).json(paths)


def write_report(report: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rounded(report), indent=2, ensure_ascii=False), encoding="utf-8")
