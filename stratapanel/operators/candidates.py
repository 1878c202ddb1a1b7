"""Candidate factors: controls and interactions of a price return and a volume surprise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.functions.scalars import positive_part, yes


def control(column: str) -> Column:
    return F.col(column)


def reversal(column: str) -> Column:
    return -F.col(column)


def amplified(price: str, volume: str) -> Column:
    """price * max(volume surprise, 0)"""
    return F.col(price) * positive_part(volume)


def signed(price: str, volume: str) -> Column:
    """sign(price) * max(volume surprise, 0)"""
    return F.signum(price) * positive_part(volume)


def candidate_values(df: DataFrame, formulas: dict[str, Column], *, universe: str | None = None) -> DataFrame:
    """One column per candidate; NULL outside the universe."""
    for name, formula in formulas.items():
        df = df.withColumn(name, F.when(yes(universe), formula) if universe else formula)
    return df


def candidate_reason(df: DataFrame, out: str, dependencies: list[tuple[str, str]], gates: list[tuple[Column, str]] = ()) -> DataFrame:
    """Reason of the first failed gate, else of the first invalid dependency, else ''.

    Dependencies are (valid column, reason column) pairs.
    """
    parts = [F.when(c, F.lit(label)) for c, label in gates]
    for valid, reason in dependencies:
        text = F.when(F.col(reason) == "", F.lit("UNSAFE_COMPONENT")).otherwise(F.col(reason))
        parts.append(F.when(~yes(valid), text))
    return df.withColumn(out, F.coalesce(*parts, F.lit("")))
