"""Pipelines shared by the registered queries: panel -> intervals -> ranks -> daily statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions.scalars import quantile_bucket
from stratapanel.operators.calendar import session_calendar, session_position
from stratapanel.operators.evidence import daily_statistics, signals_long, with_outcomes
from stratapanel.operators.intervals import interval_panel_pit
from stratapanel.operators.ranks import cross_sectional_rank
from stratapanel.plans import views
from stratapanel.runtime import clustered, row_count, stage

FORMATIONS = (5, 10, 20)
FUTURES = (1, 3, 5)
#: The full grid of look-backs and outcomes, for queries on families of pairs.
GRID = ((5, 10, 20, 40, 60), (1, 2, 3, 5, 10, 20))
PAIR_KEYS = ["formation", "future"]
KEYS = ["formation", "future", "session"]


def positioned(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The panel, aggregated from one scan of the lines and written once, with the positions of its own sessions."""
    return session_position(stage(views.panel_month(spark, sf_dir) if unit == "month" else views.panel_week(spark, sf_dir)))


class Week:
    """Weekly panel and its calendar, staged once for a query that reads them many times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.panel = stage(positioned(spark, sf_dir, "week"))
        self.calendar = stage(self.panel.select("session", "position").distinct())

    def prices(self) -> DataFrame:
        return self.panel.select("entity", "position", "session", F.col("close").alias("open"), "close")


def calendar_of(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Calendar straight from the ship dates: one scanned column."""
    dates = views.table(spark, sf_dir, "lineitem").select(
        F.date_trunc(unit, F.col("l_shipdate")).cast("date").alias("session")
    )
    return session_calendar(dates)


def intervals(spark, sf_dir, formations=FORMATIONS, futures=FUTURES, unit="month", events=False, coverage=None):
    ledger = views.impact_days(spark, sf_dir) if events else None
    panel = stage(views.panel_month(spark, sf_dir) if unit == "month" else views.panel_week(spark, sf_dir))
    calendar = session_calendar(panel)
    dealt = clustered(panel, ["entity"], row_count(panel))
    return interval_panel_pit(session_position(dealt, calendar=calendar), formations, futures, events=ledger, calendar=calendar, coverage=coverage)


def rank_signals(panel: DataFrame, formations=FORMATIONS, futures=FUTURES, single=0.5, keep=("entity", "session", "position")):
    signals = signals_long(
        panel, formations, futures, valid="valid_factor_primary_{}", outcome_valid="valid_future_primary_{}",
        keep=list(keep),
    )
    return cross_sectional_rank(signals, "factor", keys=["formation", "session"], single=single)


def paired(spark, sf_dir, formations=FORMATIONS, futures=FUTURES, unit="month", events=False, coverage=None) -> DataFrame:
    """Ranked signals with outcomes, long: (entity, session, formation, future)."""
    panel = intervals(spark, sf_dir, formations, futures, unit, events, coverage)
    return with_outcomes(rank_signals(panel, formations, futures))


def daily(spark, sf_dir, q=10, minimum=10, formations=FORMATIONS, futures=FUTURES, unit="month", tails=None) -> DataFrame:
    pairs = paired(spark, sf_dir, formations, futures, unit)
    pairs = pairs.withColumn("bucket", quantile_bucket("rank", "count", q, minimum))
    return daily_statistics(pairs, q, keys=KEYS, tails=tails, extra={"position": F.max("position")})
