"""Ranks, correlations, influence and inference against brute force."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.operators.chronology import leave_one_date_out
from stratapanel.operators.evidence import rank_ic_daily, spearman_with_index
from stratapanel.operators.inference import block_bootstrap, multiple_testing
from stratapanel.operators.influence import deletion_statistics, residualize_same_date
from stratapanel.operators.ranks import attach_outcomes, cross_sectional_rank
from stratapanel.functions.scalars import quantile_bucket

D = date(2024, 1, 1)


def test_rank_ties_break_by_entity_and_singles(spark):
    df = spark.createDataFrame([("B", D, 1.0), ("A", D, 1.0), ("C", D, -2.0), ("Z", D + timedelta(days=1), 5.0)], "entity string, session date, v double")
    out = {r["entity"]: r for r in cross_sectional_rank(df, "v").collect()}
    assert [out[e]["rank"] for e in "CAB"] == [1, 2, 3]
    assert out["A"]["pct"] == 0.5 and out["Z"]["pct"] == 0.5
    one = cross_sectional_rank(df.where("entity = 'Z'"), "v", single=1.0).first()
    assert one["pct"] == 1.0


def test_outcomes_never_change_ranks(spark):
    df = spark.createDataFrame([(e, D, float(i)) for i, e in enumerate("ABCD")], "entity string, session date, v double")
    outcomes = spark.createDataFrame([("A", D, True, 1.0), ("C", D, True, 2.0), ("D", D, False, 9.0)], "entity string, session date, ok boolean, o double")
    got = {r["entity"]: (r["rank"], r["count"]) for r in attach_outcomes(cross_sectional_rank(df, "v"), outcomes, valid="ok").collect()}
    assert got == {"A": (1, 4), "C": (3, 4)}


def test_ic_of_reversed_order_is_minus_one_and_constant_is_null(spark):
    rows = [("x", i, float(-i)) for i in range(5)] + [("y", i, 1.0) for i in range(5)] + [("z", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, rank long, outcome double")
    got = {r["k"]: r["ic"] for r in rank_ic_daily(df, keys=["k"]).collect()}
    assert got["x"] == pytest.approx(-1.0) and got["y"] is None and got["z"] is None


def test_bucket_arithmetic(spark):
    df = spark.createDataFrame([(r, 23) for r in range(1, 24)], "rank long, count long")
    got = [r[0] for r in df.orderBy("rank").select(quantile_bucket("rank", "count", 10, 10)).collect()]
    assert got == [(r - 1) * 10 // 23 + 1 for r in range(1, 24)]
    assert df.select(quantile_bucket("rank", "count", 10, 24)).first()[0] is None


def test_spearman_with_index(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0],), ([3.0, None],), ([2.0, 2.0],)], "m array<double>")
    got = [r[0] for r in df.select(spearman_with_index(F.col("m"))).collect()]
    assert got[0] == pytest.approx(pd.Series([1, 2.5, 2.5, 4]).corr(pd.Series([1, 2, 3, 4])))
    assert got[1] is None and got[2] is None


@pytest.mark.parametrize("n,ties", [(4, False), (12, True), (25, True)])
def test_deletion_equals_recomputation(spark, n, ties):
    rng = random.Random(n)
    outcome = [float(rng.randint(0, 6)) if ties else float(x) for x in ([4, 1, 2, 3] if n == 4 else [rng.random() for _ in range(n)])]
    rows = [("k", f"e{i:02d}", i + 1, o) for i, o in enumerate(outcome)]
    df = spark.createDataFrame(rows, "k string, entity string, rank long, outcome double")
    got = {r["entity"]: r for r in deletion_statistics(df, keys=["k"]).collect()}
    full = pd.DataFrame(rows, columns=["k", "entity", "rank", "outcome"])
    for e in full.entity:
        rest = full[full.entity != e]
        want = rest["rank"].rank().corr(rest.outcome.rank()) if rest.outcome.nunique() > 1 else None
        assert got[e]["ic_without"] == (None if want is None else pytest.approx(want))
        if n >= 11:
            b = ((rest["rank"].rank() - 1) * 10 // len(rest)).astype(int)
            assert got[e]["spread_without"] == pytest.approx(rest.outcome[b == 9].mean() - rest.outcome[b == 0].mean())
        else:
            assert got[e]["spread_without"] is None


def test_residual_matches_least_squares_and_survives_singular_dates(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(4):
        a, b, y = rng.random(8), rng.random(8), rng.random(8)
        b = [b, 2 * a + 1, np.ones(8), np.ones(8)][k]
        a = np.ones(8) if k == 3 else a
        rows += [(k, i, float(y[i]), float(a[i]), float(b[i])) for i in range(8)]
    df = spark.createDataFrame(rows, "session long, i long, y double, a double, b double")
    got = residualize_same_date(df, "y", "a", "b").toPandas().sort_values(["session", "i"])
    for k, g in got.groupby("session"):
        x = np.column_stack([np.ones(8), g.a, g.b])
        want = g.y - x @ np.linalg.lstsq(x, g.y, rcond=None)[0]
        assert np.allclose(g.residual, want, atol=1e-9), k


def test_leave_one_date_out_closed_form(spark):
    values = [0.5, -0.2, None, 0.1]
    df = spark.createDataFrame([("k", D + timedelta(days=i), v) for i, v in enumerate(values)], "k string, session date, ic double")
    got = {r["excluded_session"]: r["left_out_mean"] for r in leave_one_date_out(df, keys=["k"]).collect()}
    assert got[D] == pytest.approx(-0.05) and got[D + timedelta(days=2)] == pytest.approx(0.4 / 3)


def test_bootstrap_is_deterministic_and_bounded(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("k", D + timedelta(days=i), rng.gauss(0.2, 1)) for i in range(60)], "k string, session date, ic double")
    runs = [block_bootstrap(df, keys=["k"], block=F.lit(10), replications=100, seed=7).first() for _ in range(2)]
    assert runs[0] == runs[1]
    r = runs[0]
    assert r["ci_lower"] <= r["estimate"] <= r["ci_upper"] and 0 < r["p_value"] <= 1 and r["valid_dates"] == 60


def test_multiple_testing_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("f", i, x, 1.0) for i, x in enumerate(p)], "family string, i long, p_value double, estimate double")
    got = {r["i"]: r for r in multiple_testing(df, family=["family"], tie=["i"]).collect()}
    assert [round(got[i]["bh_p_value"], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5]
    assert [round(got[i]["holm_p_value"], 6) for i in range(4)] == [0.04, 0.09, 0.09, 0.5]
    assert got[0]["bh_reject"] and not got[1]["bh_reject"]
