"""Rolling features per entity.  A panel has one row per (entity, session), so a
partition of these windows holds at most one row per observed session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import first_reason, ratio, yes


def _rows(entity: str, order: str, start: int, end: int):
    return W.partitionBy(entity).orderBy(order).rowsBetween(start, end)


def full_mean(value: str, w: int, *, entity: str, order: str) -> Column:
    """Mean of the last w rows, NULL until w values exist."""
    frame = _rows(entity, order, -(w - 1), 0)
    return F.when(F.count(value).over(frame) == w, F.avg(value).over(frame))


def rolling_liquidity(
    df: DataFrame, *, entity: str = "entity", order: str = "position",
    volume: str = "volume", turnover: str = "turnover", short: int = 20, long: int = 60,
) -> DataFrame:
    kw = {"entity": entity, "order": order}
    return (
        df.withColumn(f"avg_volume_{short}", full_mean(volume, short, **kw))
        .withColumn(f"avg_turnover_{short}", full_mean(turnover, short, **kw))
        .withColumn(f"avg_turnover_{long}", full_mean(turnover, long, **kw))
    )


def recent_presence(
    df: DataFrame, windows: tuple[int, ...] = (20, 60), *, entity: str = "entity", position: str = "position"
) -> DataFrame:
    """True when the last w rows sit on w consecutive sessions."""
    w = W.partitionBy(entity).orderBy(position)
    for n in windows:
        span = F.col(position) - F.lag(position, n - 1).over(w)
        df = df.withColumn(f"recent_presence_{n}", yes(span == n - 1))
    return df


def universe_membership(
    df: DataFrame, specs: dict[str, dict], *, close: str = "close", history: str = "prior_history_sessions",
    turnover: str = "avg_turnover_20", volume: str = "avg_volume_20", presence: str = "recent_presence_20",
) -> DataFrame:
    """One boolean per named universe; presence is tested only where a liquidity floor is set."""
    for name, spec in specs.items():
        ok = (F.col(close) >= spec["minimum_close"]) & (F.col(history) >= spec["minimum_prior_sessions"])
        if spec.get("minimum_avg_turnover"):
            ok = ok & F.col(presence) & (F.col(turnover) >= spec["minimum_avg_turnover"])
        if spec.get("minimum_avg_volume"):
            ok = ok & F.col(presence) & (F.col(volume) >= spec["minimum_avg_volume"])
        df = df.withColumn(f"universe_{name}", yes(ok))
    return df


def prior_volume_baseline(
    df: DataFrame, horizons: tuple[int, ...] = (20, 60), *, entity: str = "entity", position: str = "position",
    volume: str = "volume", quality: str = "quality", crossing: str | None = None, covered: str | None = None,
) -> DataFrame:
    """Mean, median and log1p mean of the previous h rows (today excluded), with validity and reason.

    ``crossing`` and ``covered`` name boolean column prefixes ``{name}_{h}`` when given.
    """
    w = W.partitionBy(entity).orderBy(position)
    vol = F.col(volume).cast("double")
    df = df.withColumn("_log", F.when(vol >= 0, F.log1p(vol))).withColumn("_q", yes(F.col(quality)).cast("int"))
    for h in horizons:
        prior = _rows(entity, position, -h, -1)
        full = F.count(volume).over(prior) == h
        mean, median = f"volume_mean_{h}_prior", f"volume_median_{h}_prior"
        log_mean = f"volume_log_mean_{h}_prior"
        cross = yes(F.col(f"{crossing}_{h}")) if crossing else F.lit(False)
        cover = yes(F.col(f"{covered}_{h}")) if covered else F.lit(True)
        df = (
            df.withColumn("_start", F.lag(position, h).over(w))
            .withColumn(mean, F.when(full, F.avg(vol).over(prior)))
            .withColumn(median, F.when(full, F.percentile(vol, F.lit(0.5)).over(prior)))
            .withColumn(log_mean, F.when(F.count("_log").over(prior) == h, F.avg("_log").over(prior)))
            .withColumn("_good", F.sum("_q").over(prior))
            .withColumn("_cross", cross)
            .withColumn("_cover", cover)
        )
        started = F.col("_start").isNotNull()
        contiguous = yes(F.col(position) - F.col("_start") == h)
        all_good = yes(F.col("_good") == h)
        valid = yes(
            F.col(quality) & (vol >= 0) & (F.col(mean) > 0) & (F.col(median) > 0) & F.col(log_mean).isNotNull()
            & contiguous & all_good & ~F.col("_cross") & F.col("_cover")
        )
        reason = first_reason(
            [
                (valid, ""),
                (F.col(volume).isNull(), "UNAVAILABLE_SOURCE_VOLUME"),
                (vol < 0, "NEGATIVE_VOLUME"),
                (~yes(quality), "INVALID_SOURCE_ROW"),
                (~started, "INSUFFICIENT_HISTORY"),
                (~contiguous, "MISSING_OR_UNSAFE_SESSION_INTERVAL"),
                (~all_good, "UNSAFE_PRIOR_OBSERVATION"),
                (F.col("_cross"), "CORPORATE_ACTION_INTERVAL"),
                (~F.col("_cover"), "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"),
                (yes((F.col(mean) <= 0) | (F.col(median) <= 0)), "ZERO_PRIOR_VOLUME_BASELINE"),
            ],
            "OTHER_UNSAFE_INTERVAL",
        )
        df = df.withColumn(f"valid_volume_baseline_{h}", valid).withColumn(f"volume_baseline_{h}_invalid_reason", reason)
    return df.drop("_q", "_start", "_good", "_cross", "_cover", "_log")


def volume_surprise(df: DataFrame, horizons: tuple[int, ...] = (20, 60), *, volume: str = "volume") -> DataFrame:
    """Ratio to mean, ratio to median and log1p difference, NULL where the baseline is invalid."""
    vol = F.col(volume).cast("double")
    for h in horizons:
        ok = F.col(f"valid_volume_baseline_{h}")
        df = (
            df.withColumn(f"volume_ratio_{h}", F.when(ok, ratio(vol, f"volume_mean_{h}_prior")))
            .withColumn(f"volume_median_ratio_{h}", F.when(ok, ratio(vol, f"volume_median_{h}_prior")))
            .withColumn(f"log_volume_surprise_{h}", F.when(ok, F.log1p(vol) - F.col(f"volume_log_mean_{h}_prior")))
        )
    return df


def price_return(
    df: DataFrame, horizons: tuple[int, ...] = (5, 20), *, entity: str = "entity", position: str = "position",
    close: str = "close", quality: str = "quality", crossing: str | None = None, covered: str | None = None,
) -> DataFrame:
    """close / close h rows ago - 1 when all h+1 rows are good and consecutive and no event lies between."""
    w = W.partitionBy(entity).orderBy(position)
    df = df.withColumn("_q", yes(F.col(quality)).cast("int"))
    for h in horizons:
        cross = yes(F.col(f"{crossing}_{h}")) if crossing else F.lit(False)
        cover = yes(F.col(f"{covered}_{h}")) if covered else F.lit(True)
        df = (
            df.withColumn("_start", F.lag(position, h).over(w))
            .withColumn("_base", F.lag(close, h).over(w))
            .withColumn("_good", F.sum("_q").over(_rows(entity, position, -h, 0)))
            .withColumn("_cross", cross)
            .withColumn("_cover", cover)
        )
        started = F.col("_start").isNotNull()
        contiguous = yes(F.col(position) - F.col("_start") == h)
        all_good = yes(F.col("_good") == h + 1)
        valid = yes(F.col(quality) & (F.col("_base") > 0) & contiguous & all_good & ~F.col("_cross") & F.col("_cover"))
        reason = first_reason(
            [
                (valid, ""),
                (~yes(quality), "INVALID_SOURCE_ROW"),
                (~started, "INSUFFICIENT_HISTORY"),
                (~contiguous, "MISSING_OR_UNSAFE_SESSION_INTERVAL"),
                (~all_good, "UNSAFE_PRIOR_OBSERVATION"),
                (F.col("_cross"), "CORPORATE_ACTION_INTERVAL"),
                (~F.col("_cover"), "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"),
                (yes(F.col("_base") <= 0), "INVALID_PRICE_ENDPOINT"),
            ],
            "OTHER_UNSAFE_INTERVAL",
        )
        df = (
            df.withColumn(f"valid_price_return_{h}", valid)
            .withColumn(f"price_return_{h}", F.when(valid, ratio(close, "_base") - 1))
            .withColumn(f"price_return_{h}_invalid_reason", reason)
        )
    return df.drop("_q", "_start", "_base", "_good", "_cross", "_cover")


def one_session_return(
    df: DataFrame, *, entity: str = "entity", session: str = "session", position: str = "position",
    close: str = "close", quality: str = "quality", crossing: str | None = None, coverage: tuple | None = None,
) -> DataFrame:
    """Return from the previous session when both ends are good and adjacent."""
    w = W.partitionBy(entity).orderBy(position)
    df = (
        df.withColumn("_c", F.lag(close).over(w))
        .withColumn("_d", F.lag(session).over(w))
        .withColumn("_p", F.lag(position).over(w))
        .withColumn("_pq", yes(F.lag(quality).over(w)))
    )
    contiguous = yes(F.col(position) - F.col("_p") == 1)
    cross = yes(F.col(crossing)) if crossing else F.lit(False)
    good = yes(F.col(quality)) & F.col("_pq")
    if coverage:
        start, end = (F.lit(x).cast("date") for x in coverage)
        certified = yes((F.col("_d") >= start) & (F.col(session) <= end))
        uncertified = (F.col(session) > end) | yes(F.col("_d") < start)
    else:
        certified, uncertified = F.lit(True), F.lit(False)
    valid = F.col("_c").isNotNull() & good & contiguous & ~cross & certified
    return (
        df.withColumn("valid_return", valid)
        .withColumn("entity_return", F.when(valid, ratio(close, "_c") - 1))
        .withColumn(
            "return_invalid_reason",
            first_reason(
                [
                    (uncertified, "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"),
                    (F.col("_c").isNull(), "UNAVAILABLE_ENDPOINT"),
                    (~contiguous, "MISSING_SESSION_ENDPOINT"),
                    (cross, "CORPORATE_ACTION_INTERVAL_BLOCKED"),
                    (~good, "UNSAFE_SOURCE_ENDPOINT"),
                ]
            ),
        )
        .drop("_c", "_d", "_p", "_pq")
    )


def compound_return(
    df: DataFrame, formations: tuple[int, ...], futures: tuple[int, ...], *, key: str = "entity",
    position: str = "position", value: str = "entity_return", prefix: str = "",
) -> DataFrame:
    """Product of (1+r) over the last h and the next h sessions, all consecutive and not NULL."""
    w = W.partitionBy(key).orderBy(position)
    growth = F.lit(1.0) + F.col(value)
    out = []
    for h in formations:
        frame = w.rowsBetween(-(h - 1), 0)
        span = F.col(position) - F.lag(position, h - 1).over(w)
        ok = yes((F.count(value).over(frame) == h) & (span == h - 1))
        out.append(ok.alias(f"valid_{prefix}ret_{h}"))
        out.append(F.when(ok, F.product(growth).over(frame) - 1).alias(f"{prefix}ret_{h}"))
    for h in futures:
        frame = w.rowsBetween(1, h)
        span = F.lead(position, h).over(w) - F.col(position)
        ok = yes((F.count(value).over(frame) == h) & (span == h))
        out.append(ok.alias(f"valid_future_{prefix}ret_{h}"))
        out.append(F.when(ok, F.product(growth).over(frame) - 1).alias(f"future_{prefix}ret_{h}"))
    return df.select("*", *out)


def carry_mark(
    holdings: DataFrame, prices: DataFrame, fallback: DataFrame, *, keys: tuple[str, ...] = ("portfolio_id",),
    entity: str = "entity", session: str = "session", close: str = "close",
) -> DataFrame:
    """Mark per held row: own close, else fallback source close, else the previous mark carried."""
    on = [entity, session]
    primary = prices.where(F.col(close).isNotNull()).select(*on, F.col(close).alias("_own"))
    other = fallback.where(F.col(close) > 0).groupBy(*on).agg(F.min(close).alias("_alt"))
    joined = holdings.join(primary, on, "left").join(other, on, "left")
    seen = F.coalesce("_own", "_alt")
    w = W.partitionBy(*keys, entity).orderBy(session)
    return (
        joined.withColumn("mark", F.last(seen, ignorenulls=True).over(w))
        .withColumn(
            "mark_source",
            F.when(F.col("_own").isNotNull(), "OWN_CLOSE")
            .when(F.col("_alt").isNotNull(), "FALLBACK_CLOSE")
            .when(F.col("mark").isNotNull(), "CARRIED"),
        )
        .drop("_own", "_alt")
    )
