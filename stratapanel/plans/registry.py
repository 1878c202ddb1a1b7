"""Named queries over the test tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that the order of partial sums cannot show in the result."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def final(ctes: str, columns: str, source: str, doubles: str = "") -> str:
    """WITH ctes SELECT columns, round(doubles) FROM source; names are blank-separated."""
    parts = [c.strip() for c in columns.split(",") if c.strip()]
    parts += [f"round({d}, 6) + 0.0 AS {d}" for d in doubles.split()]
    return f"WITH {ctes}\nSELECT {', '.join(parts)}\nFROM {source}"
