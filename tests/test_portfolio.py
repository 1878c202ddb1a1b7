"""Selection memory, portfolio identities, rule tables and checked joins."""

from datetime import date, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from stratapanel.operators import classify as cl
from stratapanel.operators import portfolio as po
from stratapanel.operators import quality as qa
from stratapanel.operators import signals as sg

D = date(2024, 1, 1)


def at(i):
    return D + timedelta(days=i)


def fold(weeks, entry=3, retain=5, slots=3):
    """Plain restatement of the selection rule for comparison."""
    held, last, out = [], -2, []
    for t, items in weeks:
        before = held if t == last + 1 else []
        kept = [i for r, i in items if i in before and r <= retain][:slots]
        new = [i for r, i in items if i not in before and r <= entry][: slots - len(kept)]
        held, last = kept + new, t
        out += [(t, i, "RETAINED" if i in kept else "NEW_ENTRY") for i in held]
    return sorted(out)


def test_hysteresis_keeps_until_rank_five(spark):
    orders = ["abcdef", "defabc", "dbface", "fedcba", "abcdef"]
    weeks = [(t if t < 4 else 6, list(enumerate(o, 1))) for t, o in enumerate(orders)]  # a gap before the last signal
    rows = [("s", t, i, r) for t, items in weeks for r, i in items]
    df = spark.createDataFrame(rows, "strategy string, signal_index long, item string, rank int")
    got = sorted((r["signal_index"], r["item"], r["selection_status"]) for r in sg.hysteresis_select(df, keys=["strategy"]).collect())
    assert got == fold(weeks)
    assert {i for t, i, s in got if t == 6 and s == "NEW_ENTRY"} == set("abc")


def test_smaller_code_wins_ties_and_weights_sum_to_one(spark):
    groups = spark.createDataFrame([(at(0), c, 0.1, True) for c in (3, 1, 2, 4)], "session date, group_code int, group_value double, valid_group boolean")
    members = spark.createDataFrame([(at(0), f"m{c}{k}", c, 5.0) for c in (1, 2, 3, 4) for k in range(4)], "session date, entity string, group_code int, liquidity double")
    rows = sg.topk_of_topk_targets(groups, members, k_groups=2, k_members=2).collect()
    assert sorted(r["entity"] for r in rows) == ["m10", "m11", "m20", "m21"]
    assert sum(r["target_weight"] for r in rows) == pytest.approx(1.0)


def test_event_promotes_the_next_member(spark):
    groups = spark.createDataFrame([(at(0), 1, 0.1, True)], "session date, group_code int, group_value double, valid_group boolean")
    members = spark.createDataFrame([(at(0), e, 1, float(9 - i)) for i, e in enumerate("abcd")], "session date, entity string, group_code int, liquidity double")
    schedule = spark.createDataFrame([(at(0), at(1)), (at(7), at(8))], "signal_session date, execution_session date")
    events = spark.createDataFrame([("a", at(8)), ("b", at(0)), ("c", at(9))], "entity string, session date")
    rows = sg.event_safe_targets(groups, members, events, schedule, at(20), k_members=2).collect()
    assert sorted((r["entity"], r["liquidity_rank"]) for r in rows) == [("b", 2), ("c", 3)]


EQ = [100.0, 110.0, 99.0, 90.0, 112.0, 100.0]


def curve(spark, values=EQ):
    return spark.createDataFrame([("p", at(i), v) for i, v in enumerate(values)], "portfolio_id string, session date, equity double")


def test_metrics_and_episodes(spark):
    m = po.performance_metrics(curve(spark), 100.0).first()
    assert m["cumulative_return"] == pytest.approx(0.0) and m["maximum_drawdown"] == pytest.approx(90 / 110 - 1)
    assert m["maximum_drawdown_duration"] == 2 and m["positive_periods"] == 2 and m["negative_periods"] == 3
    a, b = po.drawdown_episodes(curve(spark)).orderBy("episode_id").collect()
    assert (a["peak_session"], a["underwater_start"], a["trough_session"], a["recovery_session"]) == (at(1), at(2), at(3), at(4))
    assert a["peak_to_trough"] == 2 and a["recovery_duration"] == 3 and not b["recovered"] and b["recovery_session"] is None


def test_contributions_sum_to_the_change_of_equity(spark):
    # Cash 100: buy 2 at 10 (cost 1), value 24, sell all at 13 (cost 1).
    positions = spark.createDataFrame([("p", at(0), "x", 22.0), ("p", at(1), "x", 24.0)], "portfolio_id string, session date, entity string, market_value double")
    trades = spark.createDataFrame([("p", at(0), "x", "BUY", 20.0, 1.0, 0.0), ("p", at(2), "x", "SELL", 26.0, 1.0, 0.0)],
                                   "portfolio_id string, session date, entity string, side string, notional double, transaction_cost double, slippage_cost double")
    equity = curve(spark, [101.0, 103.0, 104.0])
    c = po.daily_contribution(equity, positions, trades)
    assert c.agg(F.sum("net_contribution")).first()[0] == pytest.approx(104.0 - 100.0)
    assert {r["session"]: r["position_status"] for r in c.collect()} == {at(0): "NEWLY_ENTERED", at(1): "EXISTING", at(2): "EXISTING"}


def test_turnover_shares_sum_to_one_and_sets_are_disjoint(spark):
    chosen = spark.createDataFrame([("p", 0, "a"), ("p", 0, "b"), ("p", 1, "b"), ("p", 1, "c")], "portfolio_id string, rebalance_index int, entity string")
    reb = spark.createDataFrame([("p", 0, 100.0), ("p", 1, 100.0)], "portfolio_id string, rebalance_index int, pretrade_equity double")
    sets = po.prior_and_current(chosen, reb)
    s = {r["rebalance_index"]: r for r in po.selection_stability(sets).collect()}
    assert (s[1]["names_retained"], s[1]["names_entered"], s[1]["names_exited"], s[1]["names_jaccard"]) == (1, 1, 1, pytest.approx(1 / 3))
    mapping = spark.createDataFrame([("a", "G"), ("b", "G"), ("c", "H")], "entity string, group_code string")
    trades = spark.createDataFrame([("p", 1, "a", "SELL", 10.0, 0.1, 0.0, False), ("p", 1, "b", "BUY", 5.0, 0.1, 0.0, False), ("p", 1, "c", "BUY", 9.0, 0.1, 0.0, False), ("p", 0, "a", "BUY", 7.0, 0.0, 0.0, True)],
                                   "portfolio_id string, rebalance_index int, entity string, side string, notional double, transaction_cost double, slippage_cost double, forced boolean")
    out = po.turnover_attribution(trades, sets, mapping, reb)
    got = {(r["rebalance_index"], r["entity"]): r["turnover_class"] for r in out.collect()}
    assert got == {(1, "a"): "WITHIN_SECTOR_STOCK_REPLACEMENT", (1, "b"): "WEIGHT_REBALANCING", (1, "c"): "SECTOR_ENTRY_EXIT", (0, "a"): "FORCED_OPERATIONAL"}
    assert po.turnover_shares(out, by=["portfolio_id"]).agg(F.sum("notional_share")).first()[0] == pytest.approx(1.0)


def test_decision_table_is_exhaustive(spark):
    t = cl.decision_table(spark).collect()
    keys = {tuple(r[:-1]) for r in t}
    assert len(t) == len(keys) == 7 * 7 * 7 * 2 * 2 * 2 * 3
    assert {r["classification"] for r in t} == {
        "INSUFFICIENT SAMPLE", "CONTRADICTORY", "MIXED", "DIRECTIONALLY POSITIVE BUT UNSTABLE", "SUPPORTIVE BUT SHORT SAMPLE", "SUPPORTED"}
    for r in t:
        if r["date_band"] == "LT20":
            assert r["classification"] == "INSUFFICIENT SAMPLE"
        elif r["classification"] in ("SUPPORTED", "SUPPORTIVE BUT SHORT SAMPLE"):
            assert min(r["primary"], r["moderate"], r["nonoverlap"]) >= 4 and not r["date_sign_flip"]


def test_overall_is_symmetric_and_total(spark):
    names = ["INSUFFICIENT SAMPLE", "CONTRADICTORY", "MIXED", "SUPPORTIVE BUT SHORT SAMPLE", "SUPPORTED"]
    df = spark.createDataFrame(list(product(names, names)), "a string, b string").withColumn("o", cl.overall_class("a", "b"))
    got = {(r["a"], r["b"]): r["o"] for r in df.collect()}
    assert all(got[(a, b)] == got[(b, a)] for a, b in got) and got[("CONTRADICTORY", "CONTRADICTORY")] == "FAIL"


def test_checked_join_fails_on_duplicate_keys(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    right = spark.createDataFrame([(1, "r")], "k int, w string")
    assert qa.validated_left_join(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="duplicate key"):
        qa.validated_left_join(left, right, ["k"], "one_to_one").collect()
    with pytest.raises(Exception, match="duplicate key"):
        qa.validated_left_join(right, left, ["k"]).collect()


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (2, "y"), (1, "x")], "k int, v string").repartition(3)
    c = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    f = [qa.table_fingerprint(x).first() for x in (a, b, c)]
    assert f[0] == f[1] != f[2]
    pairs = [(None, "x"), ("x", None), ("~", "x"), ("a|b", "c"), ("a", "b|c"), ("1:a", "b"), ("n", "x")]
    prints = {tuple(qa.table_fingerprint(spark.createDataFrame([p], "a string, b string")).first()) for p in pairs}
    assert len(prints) == len(pairs)
    assert not qa.lossless_check(a, c).first()["lossless"] and qa.lossless_check(a, b).first()["lossless"]


def test_forbidden_columns(spark):
    with pytest.raises(ValueError, match="future_return"):
        qa.column_denylist_check(spark.range(1).withColumn("future_return", F.lit(1)), ["future"])
