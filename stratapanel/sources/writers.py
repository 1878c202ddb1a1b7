"""Sinks: sorted zstd Parquet and fixed-precision CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_columnar(df: DataFrame, path: str, keys: list[str], *, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """zstd Parquet in a global key order (range partitioning, so no single sort task)."""
    writer = df.sort(*(partition_by or []), *keys).write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def fixed_precision(df: DataFrame, digits: int = 12) -> DataFrame:
    return df.select(
        *[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
          for f in df.schema.fields])


def write_report_csv(df: DataFrame, path: str, keys: list[str], *, digits: int = 12, mode: str = "errorifexists") -> None:
    """CSV with a header and doubles rounded, so reruns give the same text."""
    fixed_precision(df, digits).sort(*keys).write.mode(mode).option("header", True).csv(path)
