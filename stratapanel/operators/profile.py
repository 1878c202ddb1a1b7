"""Distributions, coverage, data-quality profiles and correlations between features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import percent_true, ratio, yes
from stratapanel.operators.evidence import correlation_aggregate
from stratapanel.operators.orderstats import average_ranks_within, quantiles_within, same_keys, summarize_within
from stratapanel.runtime import derived, explode_literals, row_count, stage

# Fixed names and probabilities of the distribution summary.
DISTRIBUTION = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.50,
                "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def long_features(df: DataFrame, features: list[str], *, keep: list[str]) -> DataFrame:
    """One row per (row, feature) with a value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.*").where(F.col("value").isNotNull())


def adjusted_skew(value: str) -> Column:
    """Bias-adjusted skewness; Spark's own is the population form."""
    n = F.count(value).cast("double")
    spread = F.stddev_samp(value)
    return F.when((n > 2) & (spread > 0), F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def distribution_summary(long: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, std, min, max, adjusted skew and nine exact quantiles per key."""
    known = long.select(*keys, value).where(F.col(value).isNotNull())
    return summarize_within(known, keys, {value: DISTRIBUTION}, [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        adjusted_skew(value).alias("skew"),
    ])


def cross_section_size(
    ranked: DataFrame, *, keys: tuple[str, ...] = ("formation",), session: str = "session", count: str = "count",
    feasible: int = 15,
) -> DataFrame:
    """Distribution of the per-date group size over dates (one value per date)."""
    sizes = ranked.groupBy(*keys, session).agg(F.max(count).alias("_c"))
    return sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dates"),
        F.min("_c").alias("minimum"),
        F.max("_c").alias("maximum"),
        F.percentile("_c", F.lit(0.05)).alias("p05"),
        F.percentile("_c", F.lit(0.5)).alias("median"),
        F.avg("_c").alias("mean"),
        F.percentile("_c", F.lit(0.95)).alias("p95"),
        F.count_if(F.col("_c") >= feasible).alias("dates_feasible"),
        percent_true(F.col("_c") >= feasible).alias("feasible_pct"),
    )


def _validity_long(panel: DataFrame, specs: list[tuple[str, int, str, str]], session: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(
                F.lit(kind).alias("interval_type"), F.lit(h).alias("horizon"),
                yes(valid).alias("ok"), F.col(reason).alias("reason"),
            )
            for kind, h, valid, reason in specs
        ]
    )
    return panel.select(session, F.explode(pairs).alias("_s")).select(session, "_s.*")


def coverage_by_validity(
    panel: DataFrame, specs: list[tuple[str, int, str, str]], *, session: str = "session"
) -> DataFrame:
    """Valid and invalid rows per interval type and horizon; specs are (type, h, valid column, reason column)."""
    ok = F.col("ok")
    return _validity_long(panel, specs, session).groupBy("interval_type", "horizon").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(ok).alias("valid_rows"),
        F.count_if(~ok).alias("invalid_rows"),
        percent_true(ok).alias("valid_pct"),
        F.min(F.when(ok, F.col(session))).alias("first_valid"),
        F.max(F.when(ok, F.col(session))).alias("last_valid"),
    )


def coverage_reasons(
    panel: DataFrame, specs: list[tuple[str, int, str, str]], *, session: str = "session"
) -> DataFrame:
    """How often each reason occurs (overlapping) and how often it is the first one."""
    invalid = _validity_long(panel, specs, session).where(~F.col("ok"))
    parts = F.posexplode(F.split("reason", r"\|")).alias("_i", "reason")
    return (
        invalid.select("interval_type", "horizon", parts)
        .groupBy("interval_type", "horizon", "reason")
        .agg(F.count(F.lit(1)).alias("overlapping_count"), F.count_if(F.col("_i") == 0).alias("primary_count"))
    )


def quality_profile(
    df: DataFrame, *, keys: list[str], entity: str = "entity", volume: str = "volume", turnover: str = "turnover",
    close: str = "close",
) -> DataFrame:
    """Row, entity and defect counts, sessions per entity and quantiles of the measures per key."""
    df = stage(df.select(*keys, entity, volume, turnover, close))
    per_entity = df.groupBy(*keys, entity).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col(volume).isNull()).alias("_nv"),
        F.count_if(yes(F.col(volume) == 0)).alias("_zv"),
        F.count_if(yes(F.col(volume) < 0)).alias("_neg"),
        F.count_if(F.col(turnover).isNull()).alias("_nt"),
        F.count_if(yes(F.col(turnover) == 0)).alias("_zt"),
    )
    out = summarize_within(per_entity, keys, {"_rows": {"sessions_per_entity_median": 0.5}}, [
        F.sum("_rows").alias("observations"),
        F.count(F.lit(1)).alias("entities"),
        F.sum("_nv").alias("null_volume"),
        F.sum("_zv").alias("zero_volume"),
        F.sum("_neg").alias("negative_volume"),
        F.sum("_nt").alias("null_turnover"),
        F.sum("_zt").alias("zero_turnover"),
        F.min("_rows").alias("sessions_per_entity_min"),
        F.max("_rows").alias("sessions_per_entity_max"),
    ])
    probs = {k: v for k, v in DISTRIBUTION.items() if k not in ("p01", "p05")}
    measures = {"volume": volume, "turnover": turnover, "close": close}
    edges = [f(column).alias(f"{name}_{at}") for name, column in measures.items() for at, f in (("min", F.min), ("max", F.max))]
    spread = summarize_within(df, keys, {column: {f"{name}_{k}": p for k, p in probs.items()} for name, column in measures.items()}, edges)
    return same_keys(out, spread, keys)


def source_transition(
    df: DataFrame, *, source: str = "source", old: str = "OLD", new: str = "NEW", entity: str = "entity",
    session: str = "session", volume: str = "volume", turnover: str = "turnover", close: str = "close", sessions: int = 20,
) -> DataFrame:
    """Per source: span, counts and implied price quantiles; entity volume before and after the change.

    The change compares each entity's median volume over the last sessions of the old
    source with the first sessions of the new one.
    """
    df = stage(df.select(source, entity, session, volume, turnover, close))
    fine = (F.col(volume) > 0) & (F.col(turnover) >= 0) & (F.col(close) > 0)
    implied = F.when(fine, ratio(ratio(turnover, volume), close))
    implied_probs = {"implied_price_p01": 0.01, "implied_price_median": 0.5, "implied_price_p99": 0.99}
    spans = summarize_within(derived(df.withColumn("_i", implied), row_count(df)), [source], {"_i": implied_probs, volume: {"volume_median": 0.5, "volume_p99": 0.99}}, [
        F.min(session).alias("first_session"),
        F.max(session).alias("last_session"),
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col(volume).isNull()).alias("null_volume"),
        F.count_if(yes(F.col(volume) == 0)).alias("zero_volume"),
        F.count_if(yes(F.col(volume) < 0)).alias("negative_volume"),
    ])
    seen = [df.groupBy(source, c).count().groupBy(source).agg(F.count(F.lit(1)).alias(n)) for c, n in ((session, "sessions"), (entity, "entities"))]
    counts = same_keys(*seen, [source])
    # Session ranks per source come from distinct dates.
    dates = df.select(source, session).distinct()
    near = dates.select(
        source, session,
        F.row_number().over(W.partitionBy(source).orderBy(F.col(session).desc())).alias("_back"),
        F.row_number().over(W.partitionBy(source).orderBy(session)).alias("_front"),
    ).where(((F.col(source) == old) & (F.col("_back") <= sessions)) | ((F.col(source) == new) & (F.col("_front") <= sessions)))
    edge = df.join(near.select(source, session), [source, session])
    medians = edge.groupBy(entity, source).agg(F.percentile(volume, F.lit(0.5)).alias("_m"))  # at most 20 rows each
    change = medians.groupBy(entity).agg(
        F.max(F.when(F.col(source) == old, F.col("_m"))).alias("_b"), F.max(F.when(F.col(source) == new, F.col("_m"))).alias("_a")
    ).select(F.lit(1).alias("_k"), ratio("_a", "_b").alias("_r"))
    shift = quantiles_within(change, ["_k"], "_r", {"transition_ratio_median": 0.5}, count="transition_entities")
    out = same_keys(spans, counts, [source])
    return out.withColumn("_k", F.lit(1)).join(shift, "_k", "left").drop("_k")


def rollup_all_plus_year(df: DataFrame, aggs: list[Column], *, keys: list[str], year: Column | str = "year") -> DataFrame:
    """The same statistics for every key over all rows and per year, in one grouping-sets pass.

    The row over all years carries the year 'ALL'.
    """
    df = df.withColumn("_year", F.col(year) if isinstance(year, str) else year)
    sets = [[*keys], [*keys, "_year"]]
    grouped = df.groupingSets([[F.col(c) for c in group] for group in sets], *keys, "_year").agg(
        F.grouping("_year").alias("_all"), *aggs
    )
    label = F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("_year").cast("string"))
    return grouped.withColumn("year", label).drop("_year", "_all")


def pairwise_correlation(
    df: DataFrame, features: list[str], *, keys: list[str] | None = None, threshold: float = 0.9
) -> DataFrame:
    """Pearson and Spearman correlation of every feature pair on rows where both exist."""
    keys = keys or []
    pairs = list(combinations(features, 2))
    options = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for a, b in pairs
        ]
    )
    both = F.filter(options, lambda p: p.x.isNotNull() & p.y.isNotNull())
    long = df.select(*keys, F.explode(both).alias("p")).select(*keys, "p.*")
    by = [*keys, "left", "right"]
    ranked = average_ranks_within(long, by, {"_rx": "x", "_ry": "y"})
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"),
        correlation_aggregate("x", "y").alias("pearson"),
        correlation_aggregate("_rx", "_ry").alias("spearman"),
    )
    return out.withColumn("redundant", yes(F.abs("spearman") >= threshold))


def by_universe(df: DataFrame, universes: dict[str, str], *, keep: list[str]) -> DataFrame:
    """One row per (row, universe the row belongs to); ``universes`` maps name to flag column."""
    names = F.array_compact(F.array(*[F.when(yes(flag), F.lit(n)) for n, flag in universes.items()]))
    return df.select(*keep, F.explode(names).alias("universe"))


def thresholds(df: DataFrame, values: tuple[int, ...]) -> DataFrame:
    return explode_literals(df, [(v,) for v in values], [("threshold", "int")])
