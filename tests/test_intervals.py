"""Hand-computed interval examples, event edges, and no look-ahead."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stratapanel.operators.calendar import session_calendar, session_position, weekly_schedule
from stratapanel.operators.events import exclusion_window, interval_event_crossing
from stratapanel.operators.intervals import interval_panel, interval_panel_pit, interval_panel_strict
from stratapanel.operators.rolling import compound_return

START = date(2024, 1, 1)


def day(i):
    return START + timedelta(days=2 * i)


def panel(spark, closes, missing=(), entity="A", bad=(), dirty=()):
    rows = [(entity, day(i), float(c), i not in bad, i in dirty) for i, c in enumerate(closes) if i not in missing]
    return spark.createDataFrame(rows, "entity string, session date, close double, eligible boolean, contaminated boolean")


def full_calendar(spark, n):
    return session_calendar(spark.createDataFrame([(day(i),) for i in range(n)], "session date"))


def positioned(spark, df, n):
    return session_position(df, calendar=full_calendar(spark, n))


def events(spark, rows):
    return spark.createDataFrame(rows, "entity string, session date")


def run(spark, df, n, ev=None, **kw):
    ev = events(spark, ev) if ev else None
    out = interval_panel(positioned(spark, df, n), (2,), (1,), events=ev, calendar=full_calendar(spark, n), **kw)
    return {r["session"]: r for r in out.collect()}


def test_returns_and_endpoints(spark):
    out = run(spark, panel(spark, [100, 110, 121, 133.1]), 4)
    r = out[day(2)]
    assert r["valid_ret_2"] and r["ret_2"] == pytest.approx(0.21) and r["ret_2_endpoint"] == day(0)
    assert r["future_ret_1"] == pytest.approx(0.1) and r["future_1_endpoint"] == day(3)
    assert out[day(1)]["ret_2_invalid_reason"] == "INSUFFICIENT_HISTORY"
    assert out[day(3)]["future_invalid_reason_1"] == "UNAVAILABLE_ENDPOINT"


def test_missing_row_is_never_skipped(spark):
    out = run(spark, panel(spark, [1, 2, 3, 4, 5], missing=(2,)), 5)
    assert out[day(3)]["ret_2_invalid_reason"] == "MISSING_UNSAFE_SESSION_INTERVAL"
    assert out[day(4)]["ret_2_invalid_reason"] == "UNAVAILABLE_ENDPOINT|MISSING_UNSAFE_SESSION_INTERVAL"
    assert out[day(1)]["future_invalid_reason_1"] == "UNAVAILABLE_ENDPOINT|MISSING_UNSAFE_SESSION_INTERVAL"


def test_reason_order_of_bad_and_contaminated_rows(spark):
    out = run(spark, panel(spark, [1, 2, 3, 4], bad=(0,), dirty=(3,)), 4)
    assert out[day(2)]["ret_2_invalid_reason"] == "LOOKBACK_ENDPOINT_INELIGIBLE|UNSAFE_SESSION_INTERVAL"
    assert out[day(3)]["ret_2_invalid_reason"] == "IDENTITY_CONTAMINATION"
    assert out[day(2)]["future_invalid_reason_1"] == "IDENTITY_CONTAMINATION"


@pytest.mark.parametrize("at,blocked", [(day(0), False), (day(0) + timedelta(days=1), True), (day(2), True), (day(2) + timedelta(days=1), False)])
def test_event_inside_half_open_interval(spark, at, blocked):
    out = run(spark, panel(spark, [1, 2, 3, 4]), 4, ev=[("A", at)])
    assert (out[day(2)]["ret_2_invalid_reason"] == "UNRESOLVED_CORPORATE_ACTION_INTERVAL") is blocked
    brute = interval_event_crossing(
        spark.createDataFrame([("A", day(0), day(2))], "entity string, start_date date, end_date date"), events(spark, [("A", at)]))
    assert brute.first()["crosses_event"] is blocked


def test_coverage_cutoff(spark):
    out = run(spark, panel(spark, [1, 2, 3, 4]), 4, coverage_end=day(2))
    assert out[day(2)]["valid_ret_2"]
    assert out[day(2)]["future_invalid_reason_1"] == "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"
    assert out[day(3)]["ret_2_invalid_reason"] == "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"


def test_future_rows_do_not_change_the_past(spark):
    short = panel(spark, [10, 11, 12, 13, 14])
    long = panel(spark, [10, 11, 12, 13, 14, 99, 1])

    def past(df, n):
        p = positioned(spark, df.withColumn("quality", F.lit(True)), n)
        cols = ["session", "ret_1", "ret_3", "valid_factor_broad_3"]
        out = interval_panel_pit(p, (1, 3), (1,)).where(F.col("session") <= F.lit(day(4))).select(*cols)
        return sorted(out.collect())

    assert past(short, 5) == past(long, 7)


def test_strict_needs_every_row_good(spark):
    p = positioned(spark, panel(spark, [1, 2, 3, 4]).withColumn("quality", F.col("close") != 2).withColumn("identity_safe", F.lit(True)), 4)
    out = {r["session"]: r for r in interval_panel_strict(p, (2,), (1,)).collect()}
    assert out[day(2)]["return_2_invalid_reason"] == "UNSAFE_INTERVENING_SESSION"
    assert out[day(1)]["return_2_invalid_reason"] == "INVALID_SIGNAL_ENDPOINT"
    assert out[day(2)]["future_return_1"] == pytest.approx(1 / 3)


def test_compound_needs_consecutive_sessions(spark):
    rows = [("G", 0, 0.1), ("G", 1, 0.2), ("G", 3, 0.3), ("G", 4, 0.5)]
    df = spark.createDataFrame(rows, "entity string, position int, entity_return double")
    out = {r["position"]: r for r in compound_return(df, (2,), (1,)).collect()}
    assert out[1]["ret_2"] == pytest.approx(0.32) and out[3]["ret_2"] is None and out[4]["ret_2"] == pytest.approx(0.95)
    assert out[0]["future_ret_1"] == pytest.approx(0.2) and out[1]["future_ret_1"] is None


def test_exclusion_window_does_not_move_events(spark):
    cal = full_calendar(spark, 6)
    on = exclusion_window(events(spark, [("A", day(2))]), cal, 1, 2)
    between = exclusion_window(events(spark, [("A", day(2) + timedelta(days=1))]), cal, 1, 2)
    assert sorted(r["position"] for r in on.collect()) == [1, 2, 3, 4]
    assert sorted(r["position"] for r in between.collect()) == [2, 3, 4]


def test_weekly_schedule_uses_iso_weeks(spark):
    days = [date(2024, 12, 27), date(2024, 12, 30), date(2025, 1, 2), date(2025, 1, 6)]
    cal = session_calendar(spark.createDataFrame([(x,) for x in days], "session date"))
    got = sorted((r["signal_session"], r["execution_session"]) for r in weekly_schedule(cal, keep_last=False).collect())
    assert got == [(days[0], days[1]), (days[2], days[3])]
