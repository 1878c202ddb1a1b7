"""Views over the star-schema test tables that give the operators a panel to work on.

Entity = supplier, session = month or ISO week of shipping, price = revenue per unit.
Sums run in whole cents, so a price does not depend on the order of partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.operators.events import blocking_events
from stratapanel.runtime import clustered, row_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one task of the panel should add up.
LINE_ROWS = 1 << 21


def _panel(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    # The scan reads four columns.  A task that adds up its own piece of a file holds nearly all entities and sessions if lines come in
    # no order, so lines of tables that are large for the cores at hand are dealt first, and sums are held once, in the task of their key.
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.rint(F.col(c) * 100).cast("long")
    keyed = lines.select(
        F.col("l_suppkey").alias("entity"), F.date_trunc(unit, F.col("l_shipdate")).cast("date").alias("session"),
        cents("l_extendedprice").alias("_turnover"), cents("l_quantity").alias("_volume"),
    )
    return (
        clustered(keyed, ["entity", "session"], row_count(lines), LINE_ROWS).groupBy("entity", "session")
        .agg((F.sum("_turnover") / 100.0).alias("turnover"), (F.sum("_volume") / 100.0).alias("volume"))
        .withColumn("close", F.col("turnover") / F.col("volume"))
        .withColumn("quality", F.col("volume") >= 2)
    )


def panel_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir, "month")


def panel_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir, "week")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an event of its supplier; returned, fully discounted, large lines have an impact."""
    large = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.10) & (F.col("l_quantity") >= 49)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("entity"),
        F.col("l_shipdate").cast("date").alias("session"),
        F.when(~large, "NONE").when(F.col("l_linestatus") == "F", "MATERIAL").otherwise("UNKNOWN").alias("impact"),
        F.when(F.col("l_tax") >= 0.04, "EQ").otherwise("BE").alias("series"),
        F.col("l_extendedprice").alias("amount"),
    )


def impact_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, session) of all events with an impact."""
    return blocking_events(event_ledger(spark, sf_dir), ["MATERIAL", "UNKNOWN"])


def groups_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("entity"), F.col("n_name").alias("group_name"), F.col("n_nationkey").alias("group_code"),
        (F.col("s_acctbal") < 0).alias("identity_ambiguous"),
    )


def groups_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("s_suppkey").alias("entity"), F.col("r_name").alias("group_name"),
                F.col("r_regionkey").alias("group_code"))
    )


def minute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as quote rows on whole minutes.

    Two events in one minute give duplicated timestamps, values above 200 exceed the
    clipped high, values under 1 give a negative volume: every defect occurs naturally.
    """
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("entity"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
        v.alias("open"), F.least(v, F.lit(200.0)).alias("high"), v.alias("low"), v.alias("close"),
        (F.floor(v) - 1).cast("double").alias("volume"),
        F.when(F.col("event_type") == "click", 1).otherwise(2).cast("long").alias("token"),
    )
