"""Evidence statistics: daily rank correlation, bucket spreads, tails and their summaries.

"Daily" frames have one row per (keys, session); they are as small as the calendar times
the number of (factor, formation, future) cells, and everything after them is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import in_bottom, in_top, percent_true, ratio, yes
from stratapanel.operators.orderstats import average_ranks_within, summarize_within
from stratapanel.runtime import derived, explode_literals, row_count, stage

PAIR = ("formation", "future")


def signals_long(
    panel: DataFrame, formations: tuple[int, ...], futures: tuple[int, ...], *, value: str = "ret_{}",
    valid: str = "valid_ret_{}", outcome: str = "future_ret_{}", outcome_valid: str = "valid_future_{}",
    keep: list[str],
) -> DataFrame:
    """Valid signals in long form, one row per (row, formation), outcomes carried as an array."""
    signals = F.array(
        *[
            F.struct(F.lit(h).alias("formation"), F.col(value.format(h)).alias("factor"), yes(valid.format(h)).alias("ok"))
            for h in formations
        ]
    )
    outcomes = F.array(
        *[
            F.struct(F.lit(h).alias("future"), F.when(yes(outcome_valid.format(h)), F.col(outcome.format(h))).alias("outcome"))
            for h in futures
        ]
    )
    return (
        panel.select(*keep, F.explode(F.filter(signals, lambda s: s.ok)).alias("s"), outcomes.alias("outcomes"))
        .select(*keep, "s.formation", "s.factor", "outcomes")
        .where(F.col("factor").isNotNull())
    )


def with_outcomes(ranked: DataFrame) -> DataFrame:
    """One row per existing outcome of a ranked signal."""
    kept = [c for c in ranked.columns if c != "outcomes"]
    return (
        ranked.select(*kept, F.explode(F.filter("outcomes", lambda o: o.outcome.isNotNull())).alias("o"))
        .select(*kept, "o.future", "o.outcome")
    )


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; NULL for fewer than two rows or a constant side.

    ``corr`` raises a division error on a constant column under ANSI.
    """
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    flat = (n < 2) | (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
    return F.when(~flat, (sxy - sx * sy / n) / F.sqrt(vx * vy))


def correlation_aggregate(x: str, y: str) -> Column:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return correlation(F.count(F.lit(1)), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b))


def rank_ic_daily(
    df: DataFrame, *, keys: list[str], factor: str = "rank", outcome: str = "outcome", rerank_factor: bool = True,
    minimum: int = 2, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Spearman correlation of factor and outcome per group, with the number of rows used.

    ``rerank_factor`` ranks the factor again among the rows that have an outcome;
    otherwise its stored ordinal enters as it is.
    """
    both = df.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    both = average_ranks_within(both, keys, {"_x": factor, "_y": outcome} if rerank_factor else {"_y": outcome})
    if not rerank_factor:
        both = both.withColumn("_x", F.col(factor))
    daily = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        correlation_aggregate("_x", "_y").alias("ic"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return daily.withColumn("ic", F.when(F.col("observations") >= minimum, F.col("ic")))


def bucket_spread_daily(
    df: DataFrame, q: int, *, keys: list[str], bucket: str = "bucket", outcome: str = "outcome",
    tails: dict[str, tuple[Column, Column]] | None = None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Per group and bucket: sum and count of the outcome; top minus bottom spread; tail spreads."""
    aggs = []
    for i in range(1, q + 1):
        here = F.col(bucket) == i
        aggs += [
            F.coalesce(F.sum(F.when(here, F.col(outcome))), F.lit(0.0)).alias(f"q{i}_sum"),
            F.count_if(yes(here)).alias(f"q{i}_count"),
        ]
    for name, (top, bottom) in (tails or {}).items():
        aggs += [
            F.avg(F.when(top, F.col(outcome))).alias(f"top_{name}_mean"),
            F.avg(F.when(bottom, F.col(outcome))).alias(f"bottom_{name}_mean"),
        ]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    out = df.groupBy(*keys).agg(*aggs)
    out = out.withColumn("spread", ratio(f"q{q}_sum", f"q{q}_count") - ratio("q1_sum", "q1_count"))
    for name in tails or {}:
        out = out.withColumn(f"{name}_spread", F.col(f"top_{name}_mean") - F.col(f"bottom_{name}_mean"))
    return out


def daily_statistics(
    df: DataFrame, q: int, *, keys: list[str], factor: str = "rank", outcome: str = "outcome",
    bucket: str = "bucket", count: str = "count", rerank_factor: bool = True,
    tails: dict[str, tuple[Column, Column]] | None = None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """IC and bucket sums per group in one long frame, the input of every chronology check."""
    both = df.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    both = average_ranks_within(both, keys, {"_x": factor, "_y": outcome} if rerank_factor else {"_y": outcome})
    if not rerank_factor:
        both = both.withColumn("_x", F.col(factor))
    more = {
        "observations": F.count(F.lit(1)),
        "cross_section_count": F.max(count),
        "ic": correlation_aggregate("_x", "_y"),
    }
    return bucket_spread_daily(
        both, q, keys=keys, bucket=bucket, outcome=outcome, tails=tails, extra={**more, **(extra or {})}
    )


def spearman_with_index(values: Column) -> Column:
    """Spearman correlation of a short array with its own index; NULL if an element is NULL."""
    n = F.size(values).cast("double")

    def rank(x):
        below = F.size(F.filter(values, lambda y: y < x))
        same = F.size(F.filter(values, lambda y: y == x))
        return below + (same + 1) / 2

    ranks = F.transform(values, rank)
    index = F.transform(F.sequence(F.lit(1), F.size(values)), lambda i: i.cast("double"))
    zero = F.lit(0.0)
    sx = F.aggregate(index, zero, lambda a, v: a + v)
    sy = F.aggregate(ranks, zero, lambda a, v: a + v)
    sxx = F.aggregate(index, zero, lambda a, v: a + v * v)
    syy = F.aggregate(ranks, zero, lambda a, v: a + v * v)
    sxy = F.aggregate(F.zip_with(index, ranks, lambda a, b: a * b), zero, lambda a, v: a + v)
    return F.when(~F.exists(values, lambda v: v.isNull()), correlation(n, sx, sy, sxx, syy, sxy))


def summarize_daily(
    daily: DataFrame, *, keys: list[str], q: int = 0, null_in_denominator: bool = True,
    spreads: tuple[str, ...] = ("spread",), prefix: str = "",
) -> DataFrame:
    """Summary of a daily series per key: mean, median, std, sign shares, t, spreads, pooled spread.

    ``null_in_denominator`` decides whether dates without an IC count in the sign shares.
    Medians run over dates, so the exact percentile holds at most one value per date.
    """
    ic = F.col("ic")
    base = None if null_in_denominator else ic.isNotNull()
    aggs = [
        F.avg(ic).alias("mean_ic"),
        F.percentile(ic, F.lit(0.5)).alias("median_ic"),
        F.stddev_samp(ic).alias("ic_std"),
        percent_true(yes(ic > 0), base).alias("ic_positive_pct"),
        percent_true(yes(ic < 0), base).alias("ic_negative_pct"),
        F.count(ic).alias("valid_dates"),
        F.sum("observations").alias("observation_count"),
    ]
    aggs += [F.avg(s).alias(f"mean_{s}") for s in spreads]
    aggs += [
        ratio(F.sum(f"q{i}_sum"), F.sum(f"q{i}_count")).alias(f"_m{i}") for i in range(1, q + 1)
    ]
    out = daily.groupBy(*keys).agg(*aggs)
    std = F.when(F.col("ic_std") > 0, F.col("ic_std"))
    out = out.withColumn("mean_over_std_ic", ratio("mean_ic", std)).withColumn(
        "naive_t_stat", ratio("mean_ic", std / F.sqrt("valid_dates"))
    )
    if q:
        means = F.array(*[F.col(f"_m{i}") for i in range(1, q + 1)])
        out = (
            out.withColumn("pooled_spread", F.col(f"_m{q}") - F.col("_m1"))
            .withColumn("monotonicity", spearman_with_index(means))
            .drop(*[f"_m{i}" for i in range(1, q + 1)])
        )
    if prefix:
        out = out.select(*keys, *[F.col(c).alias(prefix + c) for c in out.columns if c not in keys])
    return out


def pooled_stats(df: DataFrame, *, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """Count, mean, median, std and share of positive outcomes, pooled over all dates of a key."""
    known = df.where(F.col(outcome).isNotNull()).select(*keys, outcome)
    if getattr(df, "_stratapanel_staged", False):
        known = derived(known, row_count(df))
    return summarize_within(known, keys, {outcome: {"median_outcome": 0.5}}, [
        F.count(F.lit(1)).alias("observation_count"),
        F.avg(outcome).alias("mean_outcome"),
        F.stddev_samp(outcome).alias("std_outcome"),
        percent_true(F.col(outcome) > 0).alias("positive_pct"),
    ])


def quantile_monotonicity(
    pooled: DataFrame, *, keys: list[str], bucket: str = "bucket", mean: str = "mean_outcome"
) -> DataFrame:
    """Top and bottom bucket means, spread, rank correlation with the bucket index, upward steps."""
    w = W.partitionBy(*keys).orderBy(bucket)  # a handful of buckets per key
    stepped = pooled.withColumn("_up", (F.col(mean) > F.lag(mean).over(w)).cast("int"))
    out = stepped.groupBy(*keys).agg(
        F.max_by(mean, bucket).alias("top_mean"),
        F.min_by(mean, bucket).alias("bottom_mean"),
        F.sum("_up").alias("upward_steps"),
        F.sum("observation_count").alias("bucket_observations"),
        F.transform(F.array_sort(F.collect_list(F.struct(bucket, mean))), lambda s: s[mean]).alias("_means"),
    )
    return (
        out.withColumn("spread", F.col("top_mean") - F.col("bottom_mean"))
        .withColumn("monotonicity", spearman_with_index(F.col("_means")))
        .drop("_means")
    )


def tail_analysis(
    df: DataFrame, fractions: tuple[float, ...], *, keys: list[str], rank: str = "rank", count: str = "count",
    outcome: str = "outcome",
) -> DataFrame:
    """Pooled outcome statistics of the top and bottom ceil(f*n) members, and their difference."""
    by = [*keys, "tail_fraction"]
    df = stage(df.select(*keys, rank, count, outcome))
    long = explode_literals(df, [(f,) for f in fractions], [("tail_fraction", "double")])
    k = F.ceil(F.col(count) * F.col("tail_fraction"))
    sides = F.array_compact(
        F.array(
            F.when(F.col(rank) > F.col(count) - k, F.lit("TOP")),
            F.when(F.col(rank) <= k, F.lit("BOTTOM")),
        )
    )
    # At most both sides of every fraction; rows of the middle drop out in the same scan.
    members = derived(long.select(*by, outcome, F.explode(sides).alias("side")), 2 * len(fractions) * row_count(df))
    stats = pooled_stats(members, keys=[*by, "side"], outcome=outcome).drop("std_outcome")
    top, bottom = F.col("side") == "TOP", F.col("side") == "BOTTOM"
    gap = stats.groupBy(*by).agg(
        F.lit("TOP-BOTTOM").alias("side"),
        (F.max(F.when(top, F.col("mean_outcome"))) - F.max(F.when(bottom, F.col("mean_outcome")))).alias("mean_outcome"),
    )
    return stats.unionByName(gap, allowMissingColumns=True)


def tail_columns(fractions: tuple[float, ...], rank="rank", count="count") -> dict[str, tuple[Column, Column]]:
    return {f"tail{round(f * 100)}": (in_top(rank, count, f), in_bottom(rank, count, f)) for f in fractions}


def fixed_tail_columns(k: int, minimum: int, rank="rank", count="count") -> dict[str, tuple[Column, Column]]:
    enough = F.col(count) >= minimum
    return {f"fixed{k}": (enough & (F.col(rank) > F.col(count) - k), enough & (F.col(rank) <= k))}
