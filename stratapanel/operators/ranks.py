"""Cross-sectional ranks, buckets, tails and clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import col, percentile_bucket, quantile_bucket, yes
from stratapanel.operators.orderstats import average_ranks_within, ordinal_within, same_keys, summarize_within
from stratapanel.runtime import derived, row_count, stage


def cross_sectional_rank(
    df: DataFrame, value: str, *, valid=None, keys: list[str] | None = None, entity: str = "entity",
    single: float = 0.5, rank: str = "rank", pct: str = "pct", count: str = "count", keep_invalid: bool = False,
) -> DataFrame:
    """Unique ordinal (weaker first, ties by entity), percentile (r-1)/(n-1) and group size.

    Only rows that are valid on the signal side are ranked, so outcomes cannot change a
    rank.  ``single`` is the percentile of a one-member group.  ``keep_invalid`` returns
    the other rows too, with NULL ranks.
    """
    keys = keys or ["session"]
    use = F.col(value).isNotNull() if valid is None else yes(valid) & F.col(value).isNotNull()
    ranked = ordinal_within(df.where(use), keys, value, entity, rank=rank, size=count)
    n = F.col(count)
    ranked = ranked.withColumn(pct, F.when(n > 1, (F.col(rank) - 1) / (n - 1)).otherwise(F.lit(float(single))))
    if keep_invalid:
        ranked = ranked.unionByName(df.where(~use), allowMissingColumns=True)
    return ranked


def average_rank(df: DataFrame, value: str, *, keys: list[str], rank: str = "rank") -> DataFrame:
    return average_ranks_within(df.where(F.col(value).isNotNull()), keys, {rank: value})


def bucket_after_rerank(
    df: DataFrame, order: str, q: int, *, keys: list[str], minimum: int, bucket: str = "bucket"
) -> DataFrame:
    """Bucket from average ranks recomputed over the rows at hand; 0 below ``minimum`` rows."""
    ranked = average_ranks_within(df, keys, {"_r": order}, size="_m")
    b = F.floor((F.col("_r") - 1) * q / F.col("_m")).cast("int") + 1
    return ranked.withColumn(bucket, F.when(F.col("_m") >= minimum, b).otherwise(0)).drop("_r", "_m")


def winsorize_same_date(
    df: DataFrame, value: str, lower: float, upper: float, *, mask=None, keys: list[str] | None = None,
    out: str = "winsorized",
) -> DataFrame:
    """Clip to the group's own quantiles; NULL outside the mask."""
    keys = keys or ["session"]
    use = F.col(value).isNotNull() if mask is None else yes(mask) & F.col(value).isNotNull()
    df = stage(df)
    inside = derived(df.where(use).select(*keys, value), row_count(df))
    limits = summarize_within(inside, keys, {value: {"_lo": lower, "_hi": upper}})
    clipped = F.greatest(F.least(col(value), F.col("_hi")), F.col("_lo"))
    return same_keys(df, limits, keys, "left").withColumn(out, F.when(use, clipped)).drop("_lo", "_hi")


def top_n_outliers(
    df: DataFrame, features: dict[str, bool], n: int, *, tie: list[str], keep: list[str]
) -> DataFrame:
    """The n largest rows per feature (by absolute value where the flag is set).

    Top n is taken per hash slice first, so a feature never sorts in one task.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("extreme_value"),
                (F.abs(F.col(f)) if absolute else F.col(f)).cast("double").alias("_size"),
            )
            for f, absolute in features.items()
        ]
    )
    long = df.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.*").where(F.col("_size").isNotNull())
    order = [F.col("_size").desc(), *[F.col(t).asc() for t in tie]]
    sliced = long.withColumn("_slice", F.pmod(F.xxhash64(*tie), F.lit(256)))
    first = W.partitionBy("feature", "_slice").orderBy(*order)
    final = W.partitionBy("feature").orderBy(*order)
    return (
        sliced.withColumn("_k", F.row_number().over(first))
        .where(F.col("_k") <= n)
        .withColumn("extreme_rank", F.row_number().over(final))
        .where(F.col("extreme_rank") <= n)
        .drop("_k", "_slice", "_size")
    )


def attach_outcomes(
    ranked: DataFrame, outcomes: DataFrame, *, valid: str, on: tuple[str, ...] = ("entity", "session")
) -> DataFrame:
    """Join outcomes to finished ranks; a missing outcome drops the row, ranks stay as they are."""
    return ranked.join(outcomes.where(yes(valid)), list(on))


def double_sort(
    df: DataFrame, first_pct: str, second_pct: str, q: int, *, first: str = "first_bucket", second: str = "second_bucket"
) -> DataFrame:
    return df.withColumn(first, percentile_bucket(first_pct, q)).withColumn(second, percentile_bucket(second_pct, q))


def with_quantile_bucket(df: DataFrame, q: int, minimum: int, *, rank="rank", count="count", bucket="bucket") -> DataFrame:
    return df.withColumn(bucket, quantile_bucket(rank, count, q, minimum))
