"""Results as files."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession


def write_index(table: DataFrame, path: str, csv: bool = True) -> None:
    """The index table, as CSV with a header or as Parquet."""
    (table.write.mode("overwrite").option("header", True).csv(path)) if csv else table.write.mode("overwrite").parquet(path)


def write_parameters(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def write_settings(spark: SparkSession, settings, path: str) -> None:
    """Settings as one line of JSON."""
    text = json.dumps(asdict(settings) if is_dataclass(settings) else dict(settings), default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def latest_version(names: list[str]) -> str:
    """The name with the largest version; numbers in names compare as numbers."""
    import re

    return max(names, key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
