"""The driver contract, and a sample of queries against their SQL at the smallest scale."""

import pytest

from oracle_check import compare, connect
from stratapanel.plans.catalog import ORACLES, QUERIES

SAMPLE = [
    "session_position", "universe_membership", "interval_panel_strict", "one_session_return", "cross_sectional_rank", "winsorize_same_date",
    "event_exclusion_window", "interval_event_crossing", "sector_mapping", "distribution_summary", "bars_from_minutes", "check_suite",
    "table_reconcile", "hysteresis_select",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 140


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert {"formation", "future", "mean_ic", "monotonicity"} <= set(df.columns) and df.count() > 0


def test_lookback_is_blind_to_later_lines(spark, sf):
    """Dropping the last year of lines must not change any earlier look-back return."""
    from pyspark.sql import functions as F

    from stratapanel.operators.calendar import session_position
    from stratapanel.operators.intervals import interval_panel_pit
    from stratapanel.plans import views

    panel = views.panel_month(spark, sf)
    cut = F.lit("2000-10-01").cast("date")

    def past(df):
        out = interval_panel_pit(session_position(df), (1, 5), (1,))
        return sorted(out.where(F.col("session") < cut).select("entity", "session", "ret_1", "ret_5", "valid_factor_broad_5").collect())

    assert past(panel) == past(panel.where(F.col("session") < cut))
