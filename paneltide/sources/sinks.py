"""Reports and state as files that later runs append to or replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_report(df: DataFrame, path: str, line: Column) -> None:
    """Append one line of text for each row."""
    df.select(line.cast("string").alias("value")).write.mode("append").text(path)


def append_trades(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def replace_state(df: DataFrame, path: str) -> None:
    """Replace a small table of state."""
    df.write.mode("overwrite").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length("value") > 0)
