"""Minute rows to quality-gated daily bars.

Rows are reduced in two steps, both with map-side partial aggregation: first to one row
per (entity, timestamp), where a repeated timestamp shows as a count above one and so
needs no window, then to one row per (entity, day).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions.scalars import bad_ohlc, bad_volume_or_minute, first_reason, off_minute, reasons, yes
from stratapanel.runtime import date_dimension


def minute_of(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def interval_minutes(text: Column) -> Column:
    """'HH:MM-HH:MM|...' (end exclusive) to a sorted array of minutes of the day; NULL when blank."""

    def at(t):
        parts = F.split(t, ":")
        return parts[0].cast("int") * 60 + parts[1].cast("int")

    spans = F.transform(
        F.split(text, r"\|"), lambda p: F.sequence(at(F.split(p, "-")[0]), at(F.split(p, "-")[1]) - 1)
    )
    return F.when(F.trim(text) != "", F.array_sort(F.flatten(spans)))


@dataclass
class SessionRules:
    """Normal trading intervals, dated exceptions and entity valid-from dates.

    ``overrides`` has columns session_date, session_type, expected (array of minutes or
    NULL) and force_ineligible, one row per date.  ``valid_from`` is a table (entity, valid_from) of any size, or a few dates by name; of several
    dates of an entity the last one counts.
    """

    normal: list[tuple[str, str]]
    overrides: DataFrame
    valid_from: DataFrame | dict[str, str] = field(default_factory=dict)

    def floors(self) -> DataFrame:
        """(entity, valid_from), one row per entity."""
        table = self.valid_from
        if isinstance(table, dict):
            table = self.overrides.sparkSession.createDataFrame(list(table.items()), "entity string, valid_from string")
        return table.groupBy("entity").agg(F.max(F.col("valid_from").cast("date")).alias("valid_from"))

    @property
    def minutes(self) -> list[int]:
        return sorted({m for a, b in self.normal for m in range(minute_of(a), minute_of(b))})

    def in_normal(self, minute: Column) -> Column:
        inside = F.lit(False)
        for a, b in self.normal:
            inside = inside | ((minute >= minute_of(a)) & (minute < minute_of(b)))
        return inside


def override_frame(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    """(date, session_type, intervals text, force_ineligible) rows of a configuration file."""
    raw = spark.createDataFrame(rows, "d string, session_type string, intervals string, force_ineligible boolean")
    return raw.select(
        F.to_date("d").alias("session_date"), "session_type", interval_minutes(F.col("intervals")).alias("expected"),
        "force_ineligible",
    )


def _with_spec(df: DataFrame, rules: SessionRules, day: str) -> DataFrame:
    """Attach the override of the day, if any; weekends without one are unknown sessions."""
    over = rules.overrides.select(
        F.col("session_date").alias(day), F.col("session_type").alias("_type"), F.col("expected").alias("_expected"),
        F.col("force_ineligible").alias("_force"), F.lit(True).alias("_over"),
    )
    out = df.join(date_dimension(over, day), day, "left")
    weekend = F.weekday(F.col(day)) >= 5
    return (
        out.withColumn("_over", yes("_over"))
        .withColumn("_normal", ~F.col("_over") & ~weekend)
        .withColumn(
            "session_type",
            F.when(F.col("_over"), F.col("_type")).when(weekend, "UNKNOWN_IRREGULAR").otherwise("NORMAL"),
        )
        .withColumn("force_ineligible", F.when(F.col("_over"), yes("_force")).otherwise(weekend))
        .withColumn("grid_known", F.col("_normal") | F.col("_expected").isNotNull())
        .drop("_type", "_force")
    )


def flag_minutes(
    rows: DataFrame, rules: SessionRules, *, entity: str = "entity", ts: str = "ts", volume: str = "volume"
) -> DataFrame:
    """Row-level defect flags; duplicates are found later, as they need all rows of a timestamp."""
    day = F.to_date(F.col(ts))
    minute = F.hour(ts) * 60 + F.minute(ts)
    df = _with_spec(rows.withColumn("day", day).withColumn("minute", minute), rules, "day")
    inside = (
        F.when(F.col("_normal"), rules.in_normal(F.col("minute")))
        .when(F.col("_expected").isNotNull(), F.array_contains("_expected", F.col("minute")))
        .otherwise(F.lit(True))  # unknown grid: kept for audit, ineligible later
    )
    # One equi-join, whatever the number of rules; the planner broadcasts a small table by its size.
    floors = rules.floors().select(F.col("entity").alias(entity), F.col("valid_from").alias("_floor"))
    df = df.join(floors, entity, "left")
    return (
        df.withColumn("bad_ohlc", bad_ohlc())
        .withColumn("bad_other", bad_volume_or_minute(volume, ts))
        .withColumn("off_minute", off_minute(ts))
        .withColumn("before_identity", yes(F.col("day") < F.col("_floor")))
        .withColumn("outside_session", F.col("grid_known") & ~inside)
        .withColumn("on_grid", inside)
        .drop("_expected", "_over", "_normal", "_floor")
    )


def _per_timestamp(flagged: DataFrame, entity: str, ts: str, volume: str) -> DataFrame:
    """One row per (entity, timestamp); prices are only used where the row is single."""
    return flagged.groupBy(entity, "day", F.col(ts).alias("ts")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("bad_ohlc").alias("n_ohlc"),
        F.count_if("bad_other").alias("n_other"),
        F.count_if(yes(F.col(volume) == 0)).alias("n_zero"),
        F.max("off_minute").alias("off_minute"),
        F.max("before_identity").alias("before_identity"),
        F.max("outside_session").alias("outside_session"),
        F.max("on_grid").alias("on_grid"),
        F.max("minute").alias("minute"),
        *[F.max(c).alias(c) for c in ("open", "high", "low", "close")],
        F.max(volume).alias("volume"),
    )


def bars_from_minutes(
    rows: DataFrame, rules: SessionRules, *, entity: str = "entity", ts: str = "ts", volume: str = "volume"
) -> DataFrame:
    """Daily bars from good minutes, with counts by defect and boundary flags.

    Every copy of a duplicated timestamp is bad.  A day without a good minute keeps NULL
    prices and volume 0.
    """
    one = _per_timestamp(flag_minutes(rows, rules, entity=entity, ts=ts, volume=volume), entity, ts, volume)
    good = (F.col("n") == 1) & (F.col("n_ohlc") == 0) & (F.col("n_other") == 0) & ~F.col("before_identity") & ~F.col("outside_session")
    one = one.withColumn("good", good).withColumn("_gts", F.when(good, F.col("ts")))
    n = F.col("n")
    days = one.groupBy(entity, "day").agg(
        F.sum(n).alias("observed_bars"),
        F.size(F.collect_set("minute")).alias("observed_unique_minutes"),  # at most 1440 values
        F.min("ts").alias("first_timestamp"),
        F.max("ts").alias("last_timestamp"),
        F.sum("n_ohlc").alias("invalid_ohlc_minutes"),
        F.sum("n_other").alias("other_invalid_minutes"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_minutes"),
        F.coalesce(F.sum(F.when(F.col("before_identity"), n)), F.lit(0)).alias("prelisting_minutes"),
        F.sum("n_zero").alias("zero_volume_minutes"),
        F.coalesce(F.sum(F.when(F.col("outside_session"), n)), F.lit(0)).alias("unexpected_minutes"),
        F.coalesce(F.sum(F.when(F.col("off_minute"), n)), F.lit(0)).alias("off_minute_rows"),
        F.min_by("open", "_gts").alias("open"),
        F.max(F.when(F.col("good"), F.col("high"))).alias("high"),
        F.min(F.when(F.col("good"), F.col("low"))).alias("low"),
        F.max_by("close", "_gts").alias("close"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("volume"))), F.lit(0.0)).cast("long").alias("volume"),
        F.count_if("good").alias("valid_bars"),
        F.min("_gts").alias("first_valid_timestamp"),
        F.max("_gts").alias("last_valid_timestamp"),
        F.count_if(F.col("on_grid") & ~F.col("off_minute")).alias("_covered"),
    )
    return bar_boundaries(_with_spec(days, rules, "day"), rules)


def bar_boundaries(days: DataFrame, rules: SessionRules) -> DataFrame:
    """Scheduled first and last minute, missing minutes and the time a bar becomes usable."""
    grid = rules.minutes
    count = F.when(F.col("_normal"), F.lit(len(grid))).otherwise(F.size("_expected"))
    first = F.when(F.col("_normal"), F.lit(grid[0])).otherwise(F.array_min("_expected"))
    last = F.when(F.col("_normal"), F.lit(grid[-1])).otherwise(F.array_max("_expected"))
    known = F.col("grid_known")

    def at(minutes):
        return F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + minutes * 60)

    end = at(last + 1)
    after_last = F.col("last_timestamp") + F.expr("interval 1 minute")
    opened = yes(known & (F.col("first_valid_timestamp") == at(first)))
    return (
        days.withColumn("expected_minutes", F.when(known, count))
        .withColumn("missing_expected_minutes", F.when(known, count - F.col("_covered")))
        .withColumn("open_is_scheduled_first", opened)
        .withColumn("close_is_scheduled_last", yes(known & (F.col("last_valid_timestamp") == at(last))))
        .withColumn("open_is_first_observed", yes(F.col("first_valid_timestamp") == F.col("first_timestamp")))
        .withColumn(
            "open_quality",
            F.when(F.col("valid_bars") == 0, "NO_VALID_MINUTES").when(opened, "SCHEDULED_FIRST_MINUTE").otherwise("LATER_OBSERVED_OPEN"),
        )
        .withColumn("bar_available_at", F.when(known, F.greatest(after_last, end)).otherwise(after_last))
        .withColumn("excluded_minutes", F.col("observed_bars") - F.col("valid_bars"))
        .withColumn("scheduled_open", F.when(known, at(first)))
        .withColumn("scheduled_close", F.when(known, end))
        .drop("_covered", "_expected", "_over", "_normal")
    )


def minute_exclusions(
    rows: DataFrame, rules: SessionRules, *, entity: str = "entity", ts: str = "ts", volume: str = "volume"
) -> DataFrame:
    """One row per rejected minute with every applicable reason.

    Duplicated timestamps come from a partial count and are joined back, so AQE can split
    a timestamp that occurs very often.
    """
    flagged = flag_minutes(rows, rules, entity=entity, ts=ts, volume=volume)
    repeated = flagged.groupBy(entity, ts).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_dup", F.lit(True))
    df = flagged.join(repeated.drop("_n"), [entity, ts], "left").withColumn("_dup", yes("_dup"))
    why = reasons(
        [
            (F.col("before_identity"), "PRELISTING_IDENTITY_CONTAMINATION"), (F.col("bad_ohlc"), "INVALID_OHLC"),
            (F.col("bad_other"), "INVALID_VOLUME_OR_TIMESTAMP"), (F.col("_dup"), "DUPLICATE_TIMESTAMP"),
            (F.col("outside_session"), "OUTSIDE_KNOWN_SESSION"),
        ]
    )
    return df.withColumn("exclusion_reason", why).where(F.col("exclusion_reason") != "").select(*rows.columns, "exclusion_reason")


def session_quality(days: DataFrame) -> DataFrame:
    """Label per (entity, day); a date is shared-partial when two or more entities fall short."""
    short = yes(F.col("missing_expected_minutes") > 0)
    shared = days.groupBy("day").agg((F.count_if(short) >= 2).alias("_shared"))
    df = days.join(date_dimension(shared, "day"), "day")
    defect = (F.col("invalid_ohlc_minutes") > 0) | (F.col("other_invalid_minutes") > 0) | (F.col("duplicate_minutes") > 0)
    label = first_reason(
        [
            (defect, "DATA_QUALITY_ISSUE"),
            (~F.col("grid_known") & (F.col("session_type") == "HALT_OR_EXTENDED_UNRESOLVED"), "PARTIAL_SHARED_MARKET_EVENT"),
            (~F.col("grid_known"), "UNKNOWN_IRREGULAR"),
            (F.col("force_ineligible") | (F.col("unexpected_minutes") > 0), "UNKNOWN_IRREGULAR"),
            (short & F.col("_shared"), "PARTIAL_SHARED_MARKET_EVENT"),
            (short, "PARTIAL_SYMBOL_SPECIFIC"),
            (F.col("session_type") == "NORMAL", "NORMAL_COMPLETE"),
        ],
        "KNOWN_SPECIAL_COMPLETE",
    )
    return df.withColumn("session_quality", label).drop("_shared")


def observed_calendar(days: DataFrame) -> DataFrame:
    """One row per observed date: entities, short entities, expected minutes and schedule."""
    short = yes(F.col("missing_expected_minutes") > 0)
    return days.groupBy("day").agg(
        F.max("session_type").alias("session_type"),
        F.count(F.lit(1)).alias("observed_entities"),
        F.count_if(short).alias("short_entities"),
        (F.count_if(short) >= 2).alias("shared_partial"),
        F.max("expected_minutes").alias("expected_minutes"),
        F.max("scheduled_open").alias("scheduled_open"),
        F.max("scheduled_close").alias("scheduled_close"),
        F.max("force_ineligible").alias("force_ineligible"),
    )


def row_eligibility(days: DataFrame, *, event_flag: str | None = None) -> DataFrame:
    """Every reason that bars a row from research; eligible when there is none."""
    partial = F.col("session_quality").isin("PARTIAL_SHARED_MARKET_EVENT", "PARTIAL_SYMBOL_SPECIFIC")
    why = [
        (F.col("prelisting_minutes") > 0, "PRELISTING_IDENTITY_CONTAMINATION"),
        (F.col("invalid_ohlc_minutes") > 0, "INVALID_OHLC"),
        ((F.col("other_invalid_minutes") > 0) | (F.col("duplicate_minutes") > 0), "INSUFFICIENT_SOURCE_QUALITY"),
        (partial, "PARTIAL_SESSION_UNRESOLVED"),
        (F.col("session_quality") == "UNKNOWN_IRREGULAR", "UNKNOWN_IRREGULAR_SESSION"),
        (F.col("unexpected_minutes") > 0, "UNEXPECTED_SESSION_MINUTES"),
        (F.col("valid_bars") == 0, "NO_VALID_MINUTES"),
    ]
    if event_flag:
        why.append((yes(event_flag), "CORPORATE_ACTION_UNRESOLVED"))
    return days.withColumn("exclusion_reason", reasons(why)).withColumn("eligible", F.col("exclusion_reason") == "")


def universe_summary(
    days: DataFrame, tokens: DataFrame, *, entity: str = "entity", token: str = "token", eligible: str = "eligible"
) -> DataFrame:
    """Span, sessions and eligible span per entity; fails the job if an entity has several tokens."""
    ok = yes(eligible)
    span = days.groupBy(entity).agg(
        F.min("first_timestamp").alias("first_observed"),
        F.max("last_timestamp").alias("last_observed"),
        F.count(F.lit(1)).alias("observed_sessions"),
        F.count_if(ok).alias("eligible_sessions"),
        F.min(F.when(ok, F.col("day"))).alias("first_eligible"),
        F.max(F.when(ok, F.col("day"))).alias("last_eligible"),
    )
    ids = tokens.groupBy(entity).agg(F.min(token).alias("_a"), F.max(token).alias("_b"))
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.raise_error(F.concat(F.lit("several tokens for "), F.col(entity).cast("string"))).cast("long")
    )
    return span.join(ids.select(entity, one.alias(token)), entity, "left")
