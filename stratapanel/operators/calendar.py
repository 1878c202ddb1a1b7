"""Observed-session calendar, positions, schedules and per-entity history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.runtime import date_dimension


def session_calendar(df: DataFrame, *, session: str = "session") -> DataFrame:
    """Distinct observed sessions with their 0-based position.

    The only window without a partition key in the library: it runs over distinct dates.
    """
    return (
        df.select(session)
        .distinct()
        .withColumn("position", (F.row_number().over(W.orderBy(session)) - 1).cast("int"))
    )


def session_position(df: DataFrame, *, session: str = "session", calendar: DataFrame | None = None) -> DataFrame:
    """Add the index of the session among all observed sessions."""
    calendar = calendar if calendar is not None else session_calendar(df, session=session)
    return df.join(date_dimension(calendar.select(session, "position"), session), session)


def history_sessions(df: DataFrame, *, entity: str = "entity", session: str = "session") -> DataFrame:
    """First observed session, running row count and prior count per entity."""
    w = W.partitionBy(entity).orderBy(session)
    return (
        df.withColumn("first_session", F.min(session).over(w))
        .withColumn("history_sessions", F.row_number().over(w))
        .withColumn("prior_history_sessions", F.col("history_sessions") - 1)
    )


def effective_positions(calendar: DataFrame, dates: DataFrame, *, session: str = "session") -> DataFrame:
    """For any date, the position of the first observed session on or after it (NULL past the end).

    With it, "event in (start, end]" becomes "event position in (start position, end position]".
    Both inputs hold distinct dates only.
    """
    timeline = calendar.select(session, "position").unionByName(
        dates.select(F.col(session), F.lit(None).cast("int").alias("position"))
    )
    ahead = W.orderBy(session).rangeBetween(W.currentRow, W.unboundedFollowing)
    return (
        timeline.withColumn("event_position", F.min("position").over(ahead))
        .where(F.col("position").isNull())
        .select(session, "event_position")
    )


def position_of_dates(calendar: DataFrame, dates: DataFrame, *, session: str = "session") -> DataFrame:
    """For any date: how many observed sessions lie strictly before it, and whether it is one."""
    timeline = (
        calendar.select(session, F.lit(1).alias("_s"))
        .unionByName(dates.select(F.col(session), F.lit(0).alias("_s")))
        .groupBy(session)
        .agg(F.max("_s").alias("_s"), F.min("_s").alias("_m"))
    )
    upto = F.sum("_s").over(W.orderBy(session))
    return (
        timeline.withColumn("sessions_before", (upto - F.col("_s")).cast("int"))
        .where(F.col("_m") == 0)
        .select(session, "sessions_before", (F.col("_s") == 1).alias("is_session"))
    )


def weekly_schedule(calendar: DataFrame, *, session: str = "session", keep_last: bool = True) -> DataFrame:
    """Last observed session of each ISO week and the next observed session.

    ``keep_last`` keeps the final signal although no execution session exists yet.
    """
    week = F.date_trunc("week", F.col(session)).cast("date")
    nxt = calendar.select(session, F.lead(session).over(W.orderBy(session)).alias("execution_session"))
    # One row per observed date goes through this window.
    last = W.partitionBy("week_start")
    out = (
        nxt.withColumn("week_start", week)
        .withColumn("_last", F.max(session).over(last))
        .where(F.col(session) == F.col("_last"))
        .select("week_start", F.col(session).alias("signal_session"), "execution_session")
    )
    return out if keep_last else out.where(F.col("execution_session").isNotNull())
