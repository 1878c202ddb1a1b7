"""Queries: schedules, targets, selection with memory, portfolio tables.

Signals are the weekly sessions, groups are regions, execution is the next session.
Capital is one unit, so amounts are weights.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import calendar as cal
from stratapanel.operators import classify as cl
from stratapanel.operators import groups as g
from stratapanel.operators import portfolio as po
from stratapanel.operators import rolling as ro
from stratapanel.operators import signals as sg
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans import views
from stratapanel.plans.q_core import ONE_SQL, WK, _compound_sql, one_session
from stratapanel.plans.registry import final, query
from stratapanel.runtime import explode_literals, stage

DAYCAL = s.panel("day")


@query("weekly_schedule", f"""WITH {DAYCAL}, n AS (SELECT session, lead(session) OVER (ORDER BY session) AS nx FROM calendar)
SELECT CAST(date_trunc('week', session) AS DATE) AS week_start, max(session) AS signal_session, arg_max(coalesce(nx, DATE '9999-01-01'), session) AS execution_session
FROM n GROUP BY 1""".replace("arg_max(coalesce(nx, DATE '9999-01-01'), session)", "nullif(arg_max(coalesce(nx, DATE '9999-01-01'), session), DATE '9999-01-01')"))
def _(spark, d):
    return cal.weekly_schedule(pp.calendar_of(spark, d, "day"))


GROUPS = f"""{WK}, {s.EVENTS}, {s.REGION}, {ONE_SQL},
gd0 AS (SELECT session, position, group_code, count(CASE WHEN valid_return THEN 1 END) AS vm, avg(CASE WHEN valid_return THEN entity_return END) AS m
  FROM one JOIN regions USING (entity) GROUP BY ALL), gd AS (SELECT *, CASE WHEN vm >= 3 THEN m END AS group_return FROM gd0),
{_compound_sql('gd', 'group_code', 'group_return', (2, 4), (), 'gc')}"""
TARGETS = f"""{GROUPS}, gr AS (SELECT session, position, group_code, ret_4 AS group_value, row_number() OVER (PARTITION BY session ORDER BY ret_4 DESC, group_code) AS group_rank FROM gc WHERE valid_ret_4),
mem AS (SELECT p.session, p.position, p.entity, r.group_code, group_rank, group_value, turnover AS liquidity, row_number() OVER (PARTITION BY p.session, r.group_code ORDER BY turnover DESC, p.entity) AS liquidity_rank,
  count(*) OVER (PARTITION BY p.session, r.group_code) AS eligible_members FROM panel p JOIN regions r USING (entity) JOIN gr ON gr.session = p.session AND gr.group_code = r.group_code AND group_rank <= 3 WHERE p.quality),
tgt AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY session) AS target_weight FROM mem WHERE liquidity_rank <= 3)"""


def group_values(spark, d, week=None):
    ret = one_session(spark, d, week=week or pp.Week(spark, d)).join(views.groups_region(spark, d), "entity")
    day = g.sector_daily_return(ret, minimum=3, keys=("session", "position", "group_code"))
    return ro.compound_return(day, (2, 4), (), key="group_code", value="group_return")


def groups_and_members(spark, d, week=None):
    week = week or pp.Week(spark, d)
    groups = stage(group_values(spark, d, week))
    named = groups.select("session", "position", "group_code", F.col("ret_4").alias("group_value"), F.col("valid_ret_4").alias("valid_group"))
    members = week.panel.where("quality").join(views.groups_region(spark, d), "entity").select(
        "session", "position", "entity", "group_code", F.col("turnover").alias("liquidity"))
    return named, members


def targets(spark, d, week=None):
    groups, members = groups_and_members(spark, d, week)
    return sg.topk_of_topk_targets(groups, members)


@query("topk_of_topk_targets", final(
    TARGETS, "session, entity, group_code, group_rank, liquidity_rank, eligible_members", "tgt", "target_weight group_value"))
def _(spark, d):
    return targets(spark, d).select("session", "entity", "group_code", "group_rank", "liquidity_rank", "eligible_members", "target_weight", "group_value")


SAFE_EVENTS = """sev AS (SELECT DISTINCT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08)"""


@query("event_safe_targets", f"""WITH {TARGETS}, {SAFE_EVENTS},
hz AS (SELECT a.session, b.session AS execution_session, coalesce(c.session, DATE '2001-12-31') AS nx FROM calendar a JOIN calendar b ON b.position = a.position + 1 LEFT JOIN calendar c ON c.position = a.position + 2),
sm AS (SELECT mem.*, execution_session, EXISTS (SELECT 1 FROM sev WHERE sev.entity = mem.entity AND sev.session > mem.session AND sev.session <= nx) AS bad FROM mem JOIN hz USING (session)),
sr AS (SELECT *, row_number() OVER (PARTITION BY session, group_code ORDER BY liquidity_rank) AS k FROM sm WHERE NOT bad)
SELECT session, execution_session, entity, group_code, group_rank, liquidity_rank, round(1.0 / count(*) OVER (PARTITION BY session), 6) AS target_weight FROM sr WHERE k <= 3""")
def _(spark, d):
    week = pp.Week(spark, d)
    groups, members = groups_and_members(spark, d, week)
    events = views.table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.08").select(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("session"))
    schedule = cal.weekly_schedule(week.calendar)
    out = sg.event_safe_targets(groups, members, events, schedule, "2001-12-31")
    return out.select("session", "execution_session", "entity", "group_code", "group_rank", "liquidity_rank", "target_weight")


@query("target_feasibility", f"""WITH {TARGETS}, us AS (SELECT session, count(CASE WHEN valid_ret_4 THEN 1 END) AS usable_groups FROM gc GROUP BY 1),
pg AS (SELECT session, group_code, sum(target_weight) AS w, max(eligible_members) AS e, count(*) AS p FROM tgt GROUP BY 1, 2),
ch AS (SELECT session, count(*) AS selected_groups, CAST(sum(p) AS BIGINT) AS expected_positions, count(CASE WHEN e < 3 THEN 1 END) AS groups_below_k, max(w) AS mw FROM pg GROUP BY 1)
SELECT session, usable_groups, coalesce(selected_groups, 0) AS selected_groups, coalesce(expected_positions, 0) AS expected_positions, coalesce(groups_below_k, 0) AS groups_below_k,
  round(mw, 6) AS max_group_weight FROM us LEFT JOIN ch USING (session)""")
def _(spark, d):
    groups, members = groups_and_members(spark, d)
    return sg.target_feasibility(sg.topk_of_topk_targets(groups, members), groups)


def hyst_sql(src: str, key: str, out: str) -> str:
    """The fold as a recursive query over the calendar; src has columns key, t, r, i."""
    kept = "list_slice([struct_pack(r := x.r, i := x.i, kept := TRUE) FOR x IN g.items IF list_contains([c.i FOR c IN f.chosen], x.i)], 1, 3)"
    fresh = "[struct_pack(r := x.r, i := x.i, kept := FALSE) FOR x IN g.items IF NOT list_contains([c.i FOR c IN f.chosen], x.i) AND x.r <= 3]"
    on = " AND ".join(f"g.{k.strip()} = f.{k.strip()}" for k in key.split(","))
    gk = ", ".join(f"g.{k.strip()}" for k in key.split(","))
    return f"""{out}_wk AS (SELECT {key}, t, list(struct_pack(r := r, i := i) ORDER BY r) AS items FROM {src} WHERE r <= 5 GROUP BY ALL),
{out}_grid AS (SELECT k.*, c.position AS t, coalesce(w.items, []) AS items FROM (SELECT DISTINCT {key} FROM {src}) k CROSS JOIN calendar c
  LEFT JOIN {out}_wk w ON w.t = c.position AND {' AND '.join(f'w.{k.strip()} = k.{k.strip()}' for k in key.split(','))}),
{out}_f AS (SELECT {key}, CAST(-1 AS BIGINT) AS t, CAST([] AS STRUCT(r BIGINT, i BIGINT, kept BOOLEAN)[]) AS chosen FROM (SELECT DISTINCT {key} FROM {src})
  UNION ALL SELECT {gk}, g.t, CAST(list_concat({kept}, list_slice({fresh}, 1, 3 - len({kept}))) AS STRUCT(r BIGINT, i BIGINT, kept BOOLEAN)[]) FROM {out}_f f JOIN {out}_grid g ON {on} AND g.t = f.t + 1),
{out} AS (SELECT {key}, t, c.i AS i, c.r AS r, CASE WHEN c.kept THEN 'RETAINED' ELSE 'NEW_ENTRY' END AS selection_status FROM (SELECT {key}, t, unnest(chosen) AS c FROM {out}_f))"""


# Two strategies rank the suppliers of every week by price or by turnover.
RANKED_ITEMS = """ri AS (SELECT 'price' AS strategy, position AS t, entity AS i, row_number() OVER (PARTITION BY position ORDER BY close DESC, entity) AS r FROM panel
  UNION ALL SELECT 'turnover', position, entity, row_number() OVER (PARTITION BY position ORDER BY turnover DESC, entity) FROM panel)"""


def ranked_items(spark, d):
    p = stage(pp.positioned(spark, d, "week"))
    both = [sg.rank_descending(p, ["position"], c, "entity", rank="rank").select(
        F.lit(n).alias("strategy"), F.col("position").alias("signal_index"), F.col("entity").alias("item"), "rank")
        for n, c in (("price", "close"), ("turnover", "turnover"))]
    return both[0].unionByName(both[1])


@query("hysteresis_select", f"WITH RECURSIVE {WK}, {RANKED_ITEMS}, {hyst_sql('ri', 'strategy', 'hy')} SELECT strategy, t AS signal_index, i AS item, r AS rank, selection_status FROM hy")
def _(spark, d):
    return sg.hysteresis_select(ranked_items(spark, d), keys=["strategy"])


GROUP_HYST = f"""{GROUPS}, gi AS (SELECT 'ret4' AS strategy, position AS t, CAST(group_code AS BIGINT) AS i, row_number() OVER (PARTITION BY position ORDER BY ret_4 DESC, group_code) AS r FROM gc WHERE valid_ret_4
  UNION ALL SELECT 'ret2', position, CAST(group_code AS BIGINT), row_number() OVER (PARTITION BY position ORDER BY ret_2 DESC, group_code) FROM gc WHERE valid_ret_2),
{hyst_sql('gi', 'strategy', 'gh')},
mi AS (SELECT gh.strategy, CAST(r.group_code AS BIGINT) AS group_code, p.position AS t, p.entity AS i, row_number() OVER (PARTITION BY gh.strategy, p.position, r.group_code ORDER BY p.turnover DESC, p.entity) AS r
  FROM panel p JOIN regions r USING (entity) JOIN gh ON gh.t = p.position AND gh.i = r.group_code WHERE p.quality),
{hyst_sql('mi', 'strategy, group_code', 'mh')}"""


def chosen_groups(spark, d, week):
    gv = stage(group_values(spark, d, week))
    parts = []
    for h in (4, 2):
        r = sg.rank_descending(gv.where(F.col(f"valid_ret_{h}")), ["position"], f"ret_{h}", "group_code", rank="rank", bounded=True)
        parts.append(r.select(F.lit(f"ret{h}").alias("strategy"), F.col("position").alias("signal_index"), F.col("group_code").alias("item"), "rank"))
    out = sg.hysteresis_select(parts[0].unionByName(parts[1]), keys=["strategy"])
    return stage(out.withColumnRenamed("item", "group_code"))


@query("hysteresis_members", f"WITH RECURSIVE {GROUP_HYST} SELECT strategy, group_code, t AS signal_index, i AS entity, r AS liquidity_rank, selection_status FROM mh")
def _(spark, d):
    week = pp.Week(spark, d)
    members = week.panel.where("quality").join(views.groups_region(spark, d), "entity").select(
        F.col("position").cast("long").alias("signal_index"), "entity", "group_code", F.col("turnover").alias("liquidity"))
    return sg.hysteresis_members(chosen_groups(spark, d, week), members, keys=["strategy"])


@query("target_state_table", f"""WITH {TARGETS}, nw AS (SELECT 'v1' AS strategy, position AS t, entity FROM tgt), sigs AS (SELECT DISTINCT position AS t FROM tgt)
SELECT 'v1' AS strategy, coalesce(a.t, b.t + 1) AS signal_index, coalesce(a.entity, b.entity) AS entity,
  CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN 'KEEP' WHEN a.t IS NOT NULL THEN 'ENTER' ELSE 'EXIT' END AS state
FROM nw a FULL JOIN nw b ON a.entity = b.entity AND a.t = b.t + 1 WHERE coalesce(a.t, b.t + 1) IN (SELECT t FROM sigs)""")
def _(spark, d):
    t = stage(targets(spark, d).select(F.lit("v1").alias("strategy"), F.col("position").alias("signal_index"), "entity"))
    return sg.target_state_table(t, keys=["strategy"], signals=t)


@query("list_fingerprint", f"""WITH {TARGETS}, h AS (SELECT session, {s.row_hashes(["group_rank", "liquidity_rank", "entity"])} FROM mem),
a AS (SELECT session, count(*) AS candidates, sum(h1) AS s1, sum(h2) AS s2, bit_xor(h1) AS x1, bit_xor(h2) AS x2 FROM h GROUP BY 1)
SELECT session, candidates, sha256(concat_ws(':', candidates, s1, s2, x1, x2)) AS fingerprint FROM a""")
def _(spark, d):
    groups, members = groups_and_members(spark, d)
    best = sg.top_groups(groups, 3).select("session", "group_code", "group_rank")
    ranked = sg.rank_descending(members.join(best, ["session", "group_code"]), ["session", "group_code"], "liquidity", "entity", rank="liquidity_rank")
    return sg.list_fingerprint(ranked, ["group_rank", "liquidity_rank", "entity"], keys=["session"])


@query("quote_resolve", f"""WITH {TARGETS}, rq AS (SELECT tgt.entity, c.session, CASE WHEN group_rank = 1 THEN 'entry' ELSE 'exit' END AS purpose, liquidity_rank = 1 AS held
    FROM tgt JOIN calendar c ON c.position = tgt.position + 1),
nm AS (SELECT entity, session, close AS open FROM panel WHERE volume >= 60),
rw AS (SELECT entity, session, series, min(open) AS open FROM (SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS session, CASE WHEN l_linestatus = 'F' THEN 'EQ' ELSE 'BE' END AS series,
    l_extendedprice AS open FROM lineitem WHERE l_quantity >= 10) GROUP BY ALL),
pk AS (SELECT entity, session, arg_max(series, series) AS s, arg_max(open, series) AS p FROM rw GROUP BY 1, 2),
j AS (SELECT rq.*, nm.open AS n, pk.s, pk.p FROM rq LEFT JOIN nm USING (entity, session) LEFT JOIN pk USING (entity, session))
SELECT entity, session, purpose, CASE WHEN n IS NOT NULL THEN 'USED' WHEN p IS NOT NULL AND purpose = 'entry' AND s <> 'EQ' THEN 'ENTRY_SKIPPED_NON_EQ' WHEN p IS NOT NULL THEN 'USED'
    WHEN held THEN 'MISSING_AND_RETAINED' ELSE 'ENTRY_SKIPPED_NO_EQ' END AS resolution_status,
  CASE WHEN n IS NOT NULL THEN 'normalized' WHEN p IS NOT NULL THEN 'raw' ELSE 'none' END AS source_used,
  round(CASE WHEN n IS NOT NULL THEN n WHEN purpose = 'entry' AND s <> 'EQ' THEN NULL ELSE p END, 4) + 0.0 AS resolved_price FROM j""")
def _(spark, d):
    week = pp.Week(spark, d)
    t = targets(spark, d, week)
    nxt = week.calendar.select(F.col("session").alias("execution"), (F.col("position") - 1).alias("position"))
    req = t.join(nxt, "position").select(
        "entity", F.col("execution").alias("session"), F.when(F.col("group_rank") == 1, "entry").otherwise("exit").alias("purpose"),
        (F.col("liquidity_rank") == 1).alias("held"))
    normal = week.panel.where("volume >= 60").select("entity", "session", F.col("close").alias("open"))
    raw = views.table(spark, d, "lineitem").where("l_quantity >= 10").select(
        F.col("l_suppkey").alias("entity"), F.date_trunc("week", "l_shipdate").cast("date").alias("session"),
        F.when(F.col("l_linestatus") == "F", "EQ").otherwise("BE").alias("series"), F.col("l_extendedprice").alias("open"))
    out = sg.quote_resolve(req, normal, raw)
    return out.select("entity", "session", "purpose", "resolution_status", "source_used", F.round("resolved_price", 4).alias("resolved_price"))


# --- portfolio tables -------------------------------------------------------------
COSTS = (0.0, 25.0)
RETURNS = f"""{TARGETS}, lim AS (SELECT max(position) AS mp FROM calendar), pt AS (SELECT * REPLACE (target_weight * 0.02 AS target_weight) FROM tgt WHERE position <= (SELECT mp FROM lim) - 2),
hd AS (SELECT pt.*, b.close / a.close - 1 AS mv FROM pt LEFT JOIN panel a ON a.entity = pt.entity AND a.position = pt.position + 1
  LEFT JOIN panel b ON b.entity = pt.entity AND b.position = pt.position + 2),
gs AS (SELECT position AS signal_index, coalesce(sum(target_weight * mv), 0.0) AS gross_return, count(CASE WHEN mv IS NULL THEN 1 END) AS unpriced_names, count(*) AS names FROM hd GROUP BY 1),
tn0 AS (SELECT coalesce(a.position, b.position + 1) AS signal_index, abs(coalesce(a.target_weight, 0) - coalesce(b.target_weight, 0)) AS dw FROM pt a FULL JOIN pt b ON a.entity = b.entity AND a.position = b.position + 1),
tn AS (SELECT signal_index, sum(dw) AS turnover FROM tn0 GROUP BY 1),
rets AS (SELECT gs.*, turnover, cost_bps, gross_return - turnover * cost_bps / 10000 AS net_return, 'bps' || CAST(CAST(cost_bps AS INT) AS VARCHAR) AS portfolio_id, c.session
  FROM gs JOIN tn USING (signal_index) CROSS JOIN (SELECT unnest([0.0, 25.0]::DOUBLE[]) AS cost_bps) JOIN calendar c ON c.position = signal_index + 2)"""
EQUITY = f"{RETURNS}, eq AS (SELECT portfolio_id, session, signal_index, net_return, product(1 + net_return) OVER (PARTITION BY portfolio_id ORDER BY session) AS equity FROM rets)"


def tradable_targets(spark, d, week):
    """Targets whose next two sessions exist; two percent of the capital is invested, the rest is cash."""
    follows = week.calendar.select((F.col("position") - 2).alias("signal_index"))
    t = targets(spark, d, week).select(
        F.col("position").alias("signal_index"), "entity", "group_code", (F.col("target_weight") * 0.02).alias("target_weight"),
        (F.col("position") + 1).alias("execution_position"), (F.col("position") + 2).alias("next_position"))
    return stage(t.join(follows, "signal_index", "left_semi"))


def returns(spark, d, t=None, week=None):
    week = week or pp.Week(spark, d)
    t = t if t is not None else tradable_targets(spark, d, week)
    out = po.target_weight_returns(t, week.prices(), list(COSTS))
    ends = week.calendar.select("session", (F.col("position") - 2).alias("signal_index"))
    return out.join(ends, "signal_index").withColumn("portfolio_id", F.concat(F.lit("bps"), F.col("cost_bps").cast("int").cast("string")))


def equity(spark, d, t=None, week=None):
    return stage(po.equity_from_returns(returns(spark, d, t, week), 1.0).select("portfolio_id", "session", "signal_index", "net_return", "equity"))


@query("target_weight_returns", final(
    RETURNS, "signal_index, unpriced_names, names", "rets", "gross_return turnover cost_bps net_return"))
def _(spark, d):
    return returns(spark, d).drop("portfolio_id", "session")


@query("equity_enrich", final(
    f"""{EQUITY}, en AS (SELECT portfolio_id, session, equity, equity / coalesce(lag(equity) OVER w, 1.0) - 1 AS daily_return,
    equity / max(equity) OVER w - 1 AS drawdown FROM eq WINDOW w AS (PARTITION BY portfolio_id ORDER BY session))""",
    "portfolio_id, session", "en", "equity daily_return drawdown"))
def _(spark, d):
    return po.equity_enrich(equity(spark, d), 1.0).select("portfolio_id", "session", "equity", "daily_return", "drawdown")


METRICS = f"""{EQUITY}, cv AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM eq WINDOW w AS (PARTITION BY portfolio_id ORDER BY session)),
isl AS (SELECT *, CASE WHEN dd < 0 THEN 1 ELSE 0 END AS u, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY portfolio_id ORDER BY session) AS island FROM cv),
runs AS (SELECT portfolio_id, max(n) AS maximum_drawdown_duration FROM (SELECT portfolio_id, island, sum(u) AS n FROM isl GROUP BY 1, 2) GROUP BY 1),
me AS (SELECT portfolio_id, min(session) AS start_session, max(session) AS end_session, count(r) AS observations, arg_max(equity, session) / 1.0 - 1 AS cumulative_return,
  avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS dn, min(dd) AS maximum_drawdown, count(CASE WHEN r > 0 THEN 1 END) AS positive_periods,
  count(CASE WHEN r < 0 THEN 1 END) AS negative_periods FROM isl GROUP BY 1),
met AS (SELECT me.*, CAST(maximum_drawdown_duration AS BIGINT) AS maximum_drawdown_duration, CASE WHEN cumulative_return > -1 THEN pow(1 + cumulative_return, 52.0 / observations) - 1 END AS cagr,
  sd * sqrt(52.0) AS annualized_volatility, mu / nullif(sd, 0) * sqrt(52.0) AS sharpe, mu / nullif(dn, 0) * sqrt(52.0) AS sortino FROM me JOIN runs USING (portfolio_id)),
metrics AS (SELECT *, CASE WHEN maximum_drawdown < 0 THEN cagr / abs(maximum_drawdown) END AS calmar FROM met)"""


def metrics(spark, d):
    return po.performance_metrics(equity(spark, d), 1.0, periods=52)


@query("performance_metrics", final(
    METRICS, "portfolio_id, start_session, end_session, observations, maximum_drawdown_duration, positive_periods, negative_periods", "metrics",
    "cumulative_return maximum_drawdown cagr annualized_volatility sharpe sortino calmar"))
def _(spark, d):
    return metrics(spark, d)


@query("gate_evaluate", f"""WITH {METRICS} SELECT portfolio_id, maximum_drawdown < -0.9 AS reject_gate, cagr > 0 AND sharpe >= 0.5 AS ready_gate, cagr > -0.5 AND maximum_drawdown >= -0.8 AS conditional_gate,
  CASE WHEN maximum_drawdown < -0.9 THEN 'REJECT' WHEN cagr > 0 AND sharpe >= 0.5 THEN 'READY' WHEN cagr > -0.5 AND maximum_drawdown >= -0.8 THEN 'CONDITIONAL' ELSE 'RESEARCH_FURTHER' END AS decision FROM metrics""")
def _(spark, d):
    c = F.col
    out = cl.gate_evaluate(
        metrics(spark, d), c("maximum_drawdown") < -0.9, (c("cagr") > 0) & (c("sharpe") >= 0.5), (c("cagr") > -0.5) & (c("maximum_drawdown") >= -0.8))
    return out.select("portfolio_id", "reject_gate", "ready_gate", "conditional_gate", "decision")


@query("period_returns", f"""WITH {EQUITY}, pe AS (SELECT portfolio_id, CAST(date_trunc('month', session) AS DATE) AS period, arg_max(equity, session) AS e FROM eq GROUP BY 1, 2)
SELECT portfolio_id, period, round(e / coalesce(lag(e) OVER (PARTITION BY portfolio_id ORDER BY period), 1.0) - 1, 6) + 0.0 AS period_return FROM pe""")
def _(spark, d):
    return po.period_returns(equity(spark, d), 1.0, "month")


EPISODES = f"""{EQUITY}, ei AS (SELECT *, row_number() OVER w AS i, equity >= max(equity) OVER w AS pk FROM eq WINDOW w AS (PARTITION BY portfolio_id ORDER BY session)),
ep AS (SELECT *, sum(CAST(pk AS INT)) OVER (PARTITION BY portfolio_id ORDER BY session) AS ep FROM ei),
ea AS (SELECT portfolio_id, ep, max(CASE WHEN pk THEN session END) AS peak_session, max(CASE WHEN pk THEN i END) AS pi, max(CASE WHEN pk THEN equity END) AS pe, min(CASE WHEN NOT pk THEN session END) AS underwater_start,
  arg_min(session, CASE WHEN NOT pk THEN equity END) AS trough_session, arg_min(i, CASE WHEN NOT pk THEN equity END) AS ti, min(CASE WHEN NOT pk THEN equity END) AS te FROM ep GROUP BY 1, 2),
el AS (SELECT *, lead(peak_session) OVER w AS recovery_session, lead(pi) OVER w AS ri FROM ea WINDOW w AS (PARTITION BY portfolio_id ORDER BY ep)),
er AS (SELECT *, te / pe - 1 AS depth, row_number() OVER (PARTITION BY portfolio_id ORDER BY te / pe - 1, peak_session) AS episode_id FROM el WHERE te IS NOT NULL),
episodes AS (SELECT portfolio_id, episode_id, peak_session, underwater_start, trough_session, recovery_session, depth, ti - pi AS peak_to_trough, ri - pi AS recovery_duration, ri IS NOT NULL AS recovered FROM er)"""


@query("drawdown_episodes", final(
    EPISODES, "portfolio_id, episode_id, peak_session, underwater_start, trough_session, recovery_session, peak_to_trough, recovery_duration, recovered", "episodes", "depth"))
def _(spark, d):
    return po.drawdown_episodes(equity(spark, d), None)


@query("benchmark_return", f"""WITH {EQUITY}, sp AS (SELECT portfolio_id, min(session) AS start_session, max(session) AS end_session FROM eq GROUP BY 1), b AS (SELECT min(entity) AS e FROM panel)
SELECT portfolio_id, start_session, end_session, round(l.close / f.close - 1, 6) + 0.0 AS benchmark_return FROM sp LEFT JOIN panel f ON f.session = start_session AND f.entity = 7
  LEFT JOIN panel l ON l.session = end_session AND l.entity = 7""")
def _(spark, d):
    week = pp.Week(spark, d)
    return po.benchmark_return(equity(spark, d, week=week), week.prices(), 7)


# Positions hold weight / price shares of the priced targets; fills are share changes.
POSITIONS = f"""{EQUITY}, pfs AS (SELECT DISTINCT portfolio_id, cost_bps FROM rets),
pos AS (SELECT pfs.portfolio_id, cost_bps, pt.position AS rebalance_index, c.session, pt.entity, target_weight / p.close AS shares, p.close, target_weight AS market_value
  FROM pt CROSS JOIN pfs JOIN calendar c ON c.position = pt.position + 1 JOIN panel p ON p.entity = pt.entity AND p.position = pt.position + 1),
rb AS (SELECT pfs.portfolio_id, s.t AS rebalance_index, c.session, pv.session AS previous_session, coalesce(eq.equity, 1.0) AS pretrade_equity FROM (SELECT DISTINCT position AS t FROM pt) s CROSS JOIN pfs
  JOIN calendar c ON c.position = s.t + 1 JOIN calendar pv ON pv.position = s.t LEFT JOIN eq ON eq.portfolio_id = pfs.portfolio_id AND eq.session = c.session),
dl AS (SELECT coalesce(a.portfolio_id, b.portfolio_id) AS portfolio_id, coalesce(a.cost_bps, b.cost_bps) AS cost_bps, coalesce(a.rebalance_index, b.rebalance_index + 1) AS rebalance_index, coalesce(a.entity, b.entity) AS entity,
  coalesce(a.shares, 0) - coalesce(b.shares, 0) AS delta, b.close AS last_close FROM pos a FULL JOIN pos b ON a.portfolio_id = b.portfolio_id AND a.entity = b.entity AND a.rebalance_index = b.rebalance_index + 1),
tr AS (SELECT dl.portfolio_id, dl.rebalance_index, rb.session, dl.entity, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity, abs(delta) * coalesce(p.close, last_close) AS notional,
  abs(delta) * coalesce(p.close, last_close) * cost_bps / 10000 AS transaction_cost, abs(delta) * coalesce(p.close, last_close) * 5 / 10000 AS slippage_cost, p.close IS NULL AS forced
  FROM dl JOIN rb ON rb.portfolio_id = dl.portfolio_id AND rb.rebalance_index = dl.rebalance_index LEFT JOIN panel p ON p.entity = dl.entity AND p.position = dl.rebalance_index + 1 WHERE abs(delta) > 1e-15),
nb AS (SELECT coalesce(a.position, b.position + 1) AS t, coalesce(a.entity, b.entity) AS entity, a.position IS NOT NULL AS now, b.position IS NOT NULL AS bef FROM pt a FULL JOIN pt b ON a.entity = b.entity AND a.position = b.position + 1),
an AS (SELECT rb.portfolio_id, rb.session, nb.entity, CASE WHEN now AND bef THEN 'STALE_MARK' WHEN now THEN 'PREVENTED_ENTRY' ELSE 'UNEXECUTABLE_EXIT' END AS type FROM nb JOIN rb ON rb.rebalance_index = nb.t
  LEFT JOIN panel p ON p.entity = nb.entity AND p.position = nb.t + 1 WHERE p.close IS NULL),
cu AS (SELECT pos.portfolio_id, pos.rebalance_index, pos.entity FROM pos ANTI JOIN (SELECT * FROM an WHERE type = 'UNEXECUTABLE_EXIT') x ON x.portfolio_id = pos.portfolio_id AND x.session = pos.session AND x.entity = pos.entity
  UNION SELECT an.portfolio_id, rb.rebalance_index, an.entity FROM an JOIN rb ON rb.portfolio_id = an.portfolio_id AND rb.session = an.session WHERE type = 'PREVENTED_ENTRY'),
hs AS (SELECT coalesce(a.portfolio_id, b.portfolio_id) AS portfolio_id, coalesce(a.rebalance_index, b.rebalance_index + 1) AS rebalance_index, coalesce(a.entity, b.entity) AS entity, b.entity IS NOT NULL AS in_prior, a.entity IS NOT NULL AS in_current
  FROM cu a FULL JOIN cu b ON a.portfolio_id = b.portfolio_id AND a.entity = b.entity AND a.rebalance_index = b.rebalance_index + 1),
sets AS (SELECT hs.* FROM hs SEMI JOIN rb ON rb.portfolio_id = hs.portfolio_id AND rb.rebalance_index = hs.rebalance_index)"""


class Book:
    """Positions, trades, anomalies and rebalances derived from the targets, staged once."""

    def __init__(self, spark, d):
        week = pp.Week(spark, d)
        t = tradable_targets(spark, d, week)
        self.prices = week.prices()
        self.equity = equity(spark, d, t, week)
        line = week.calendar
        portfolios = [(f"bps{int(c)}", c) for c in COSTS]
        many = stage(explode_literals(t, portfolios, [("portfolio_id", "string"), ("cost_bps", "double")]))
        at = self.prices.select("entity", F.col("position").alias("execution_position"), "close")
        held = many.join(at, ["entity", "execution_position"])
        session_of = line.select(F.col("session"), (F.col("position") - 1).alias("rebalance_index"))
        pos = held.select("portfolio_id", "cost_bps", F.col("signal_index").alias("rebalance_index"), "entity",
                          (F.col("target_weight") / F.col("close")).alias("shares"), "close", F.col("target_weight").alias("market_value"))
        self.positions = stage(pos.join(session_of, "rebalance_index"))
        eq = self.equity.select("portfolio_id", "session", F.col("equity").alias("_e"))
        prev = line.select(F.col("session").alias("previous_session"), F.col("position").alias("rebalance_index"))
        reb = many.select("portfolio_id", F.col("signal_index").alias("rebalance_index")).distinct()
        self.rebalances = stage(reb.join(session_of, "rebalance_index").join(prev, "rebalance_index").join(eq, ["portfolio_id", "session"], "left")
                                .withColumn("pretrade_equity", F.coalesce("_e", F.lit(1.0))).drop("_e"))
        keys = ["portfolio_id", "cost_bps", "rebalance_index", "entity"]
        now = self.positions.select(*keys, F.col("shares").alias("_d"), F.lit(None).cast("double").alias("_last"))
        before = self.positions.select("portfolio_id", "cost_bps", (F.col("rebalance_index") + 1).alias("rebalance_index"), "entity",
                                       (-F.col("shares")).alias("_d"), F.col("close").alias("_last"))
        delta = now.unionByName(before).groupBy(*keys).agg(F.sum("_d").alias("_d"), F.max("_last").alias("_last")).where(F.abs("_d") > 1e-15)
        px = self.prices.select("entity", (F.col("position") - 1).alias("rebalance_index"), F.col("close").alias("_p"))
        fills = delta.join(self.rebalances.select("portfolio_id", "rebalance_index", "session"), ["portfolio_id", "rebalance_index"]).join(px, ["entity", "rebalance_index"], "left")
        notional = F.abs("_d") * F.coalesce("_p", "_last")
        self.trades = stage(fills.select(
            "portfolio_id", "rebalance_index", "session", "entity", F.when(F.col("_d") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("_d").alias("quantity"),
            notional.alias("notional"), (notional * F.col("cost_bps") / 10000).alias("transaction_cost"), (notional * 5 / 10000).alias("slippage_cost"), F.col("_p").isNull().alias("forced")))
        sets = po.prior_and_current(many.select("portfolio_id", F.col("signal_index").alias("rebalance_index"), "entity"), self.rebalances)
        lost = sets.join(px, ["entity", "rebalance_index"], "left").where("_p IS NULL").join(self.rebalances.select("portfolio_id", "rebalance_index", "session"), ["portfolio_id", "rebalance_index"])
        kind = F.when(F.expr("in_prior AND in_current"), "STALE_MARK").when(F.col("in_current"), "PREVENTED_ENTRY").otherwise("UNEXECUTABLE_EXIT")
        self.anomalies = stage(lost.select("portfolio_id", "session", "entity", kind.alias("type")))
        self.sets = stage(po.holding_sets(self.positions, self.anomalies, self.rebalances))


@query("holding_sets", f"WITH {POSITIONS} SELECT portfolio_id, rebalance_index, entity, in_prior, in_current FROM sets")
def _(spark, d):
    return Book(spark, d).sets


STABILITY = f"""{POSITIONS}, hl AS (SELECT *, rebalance_index - row_number() OVER (PARTITION BY portfolio_id, entity ORDER BY rebalance_index) AS gno FROM sets WHERE in_current),
hr AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id, entity, gno ORDER BY rebalance_index) AS run FROM hl)"""


@query("selection_stability", f"""WITH {STABILITY}, al AS (SELECT portfolio_id, rebalance_index, avg(run) AS m FROM hr GROUP BY 1, 2)
SELECT s.portfolio_id, s.rebalance_index, count(CASE WHEN in_prior AND in_current THEN 1 END) AS names_retained, count(CASE WHEN in_current AND NOT in_prior THEN 1 END) AS names_entered,
  count(CASE WHEN in_prior AND NOT in_current THEN 1 END) AS names_exited, round(count(CASE WHEN in_prior AND in_current THEN 1 END) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS names_jaccard,
  round(any_value(m), 6) + 0.0 AS mean_active_names_run FROM sets s LEFT JOIN al ON al.portfolio_id = s.portfolio_id AND al.rebalance_index = s.rebalance_index GROUP BY 1, 2""")
def _(spark, d):
    return po.selection_stability(Book(spark, d).sets)


@query("run_durations", f"""WITH {STABILITY}, rl AS (SELECT portfolio_id, entity, gno, count(*) AS n FROM hl GROUP BY 1, 2, 3)
SELECT portfolio_id, count(*) AS runs, round(avg(n), 6) + 0.0 AS mean_run, max(n) AS longest_run FROM rl GROUP BY 1""")
def _(spark, d):
    return po.run_durations(Book(spark, d).sets.where("in_current"))


@query("boundary_churn", f"""WITH {POSITIONS}, rk AS (SELECT position AS t, entity, row_number() OVER (PARTITION BY position ORDER BY turnover DESC, entity) AS r FROM panel),
f AS (SELECT portfolio_id, min(rebalance_index) AS f FROM sets GROUP BY 1),
mv AS (SELECT s.*, pr.r AS previous_rank, cr.r AS current_rank FROM sets s JOIN f USING (portfolio_id) LEFT JOIN rk pr ON pr.t = rebalance_index - 1 AND pr.entity = s.entity LEFT JOIN rk cr ON cr.t = rebalance_index AND cr.entity = s.entity
  WHERE in_prior <> in_current AND rebalance_index > f)
SELECT portfolio_id, rebalance_index, entity, CASE WHEN in_current THEN 'ENTER' ELSE 'EXIT' END AS direction, previous_rank, current_rank,
  coalesce(CAST(previous_rank AS VARCHAR), 'none') || '->' || coalesce(CAST(current_rank AS VARCHAR), 'none') AS rank_move,
  coalesce(CAST(previous_rank AS VARCHAR), 'none') || '->' || coalesce(CAST(current_rank AS VARCHAR), 'none') IN ('3->4', '4->3', '3->5', '5->3') AS small_move FROM mv""")
def _(spark, d):
    p = pp.positioned(spark, d, "week")
    ranks = sg.rank_descending(p, ["position"], "turnover", "entity", rank="rank").select(F.col("position").alias("rebalance_index"), "entity", "rank")
    return po.boundary_churn(Book(spark, d).sets, ranks)


@query("turnover_attribution", f"""WITH {POSITIONS}, gsn AS (SELECT portfolio_id, rebalance_index, group_code, bool_or(in_prior) AS gp, bool_or(in_current) AS gc2 FROM sets JOIN regions USING (entity) GROUP BY 1, 2, 3),
ta AS (SELECT tr.*, r.group_code, CASE WHEN forced THEN 'FORCED_OPERATIONAL' WHEN coalesce(s.in_prior AND s.in_current, FALSE) THEN 'WEIGHT_REBALANCING'
    WHEN (side = 'BUY' AND NOT coalesce(gp, FALSE)) OR (side = 'SELL' AND NOT coalesce(gc2, FALSE)) THEN 'SECTOR_ENTRY_EXIT' ELSE 'WITHIN_SECTOR_STOCK_REPLACEMENT' END AS turnover_class
  FROM tr LEFT JOIN regions r USING (entity) LEFT JOIN sets s ON s.portfolio_id = tr.portfolio_id AND s.rebalance_index = tr.rebalance_index AND s.entity = tr.entity
  LEFT JOIN gsn ON gsn.portfolio_id = tr.portfolio_id AND gsn.rebalance_index = tr.rebalance_index AND gsn.group_code = r.group_code),
tb AS (SELECT ta.*, year(ta.session) AS year, notional / pretrade_equity AS nt FROM ta JOIN rb ON rb.portfolio_id = ta.portfolio_id AND rb.rebalance_index = ta.rebalance_index),
tc AS (SELECT portfolio_id, year, turnover_class, sum(notional) AS notional, sum(nt) AS normalized_turnover, sum(transaction_cost + slippage_cost) AS all_in_cost, count(*) AS trades FROM tb GROUP BY 1, 2, 3)
SELECT portfolio_id, year, turnover_class, trades, round(notional, 6) + 0.0 AS notional, round(normalized_turnover, 6) + 0.0 AS normalized_turnover, round(all_in_cost, 6) + 0.0 AS all_in_cost,
  round(notional / sum(notional) OVER (PARTITION BY portfolio_id, year), 6) + 0.0 AS notional_share FROM tc""")
def _(spark, d):
    b = Book(spark, d)
    out = po.turnover_attribution(b.trades, b.sets, views.groups_region(spark, d), b.rebalances)
    return po.turnover_shares(out.withColumn("year", F.year("session")), by=["portfolio_id", "year"])


@query("weight_drift", final(
    f"""{POSITIONS}, sz AS (SELECT portfolio_id, rebalance_index, count(*) AS n FROM sets WHERE in_current GROUP BY 1, 2),
    wd AS (SELECT s.portfolio_id, s.rebalance_index, s.entity, pv.shares * coalesce(p.close, pv.close) / pretrade_equity AS pre_weight, 1.0 / n AS target_weight FROM sets s
      JOIN rb ON rb.portfolio_id = s.portfolio_id AND rb.rebalance_index = s.rebalance_index JOIN sz ON sz.portfolio_id = s.portfolio_id AND sz.rebalance_index = s.rebalance_index
      JOIN pos pv ON pv.portfolio_id = s.portfolio_id AND pv.session = rb.previous_session AND pv.entity = s.entity LEFT JOIN panel p ON p.entity = s.entity AND p.session = rb.session WHERE in_prior AND in_current),
    we AS (SELECT *, abs(target_weight - pre_weight) AS absolute_deviation FROM wd)""",
    "portfolio_id, rebalance_index, entity", "we", "pre_weight target_weight absolute_deviation"))
def _(spark, d):
    b = Book(spark, d)
    return po.weight_drift(b.sets, b.positions, b.prices, b.rebalances)


@query("exception_audit", f"""WITH {POSITIONS}, ba AS (SELECT portfolio_id, entity, count(CASE WHEN type = 'STALE_MARK' THEN 1 END) AS stale_marks, count(CASE WHEN type = 'UNEXECUTABLE_EXIT' THEN 1 END) AS unavailable_exits,
    count(CASE WHEN type = 'PREVENTED_ENTRY' THEN 1 END) AS prevented_entries, min(session) AS first_incident, max(session) AS last_incident,
    min(CASE WHEN type <> 'PREVENTED_ENTRY' THEN session END) AS a, max(CASE WHEN type <> 'PREVENTED_ENTRY' THEN session END) AS b FROM an GROUP BY 1, 2),
ex AS (SELECT tr.portfolio_id, tr.entity, min(tr.session) AS eventual_exit FROM tr JOIN ba ON ba.portfolio_id = tr.portfolio_id AND ba.entity = tr.entity AND tr.session > ba.b
  WHERE side = 'SELL' AND NOT EXISTS (SELECT 1 FROM pos WHERE pos.portfolio_id = tr.portfolio_id AND pos.entity = tr.entity AND pos.session = tr.session) GROUP BY 1, 2),
tp AS (SELECT pos.portfolio_id, pos.entity, count(*) AS n FROM pos JOIN ba ON ba.portfolio_id = pos.portfolio_id AND ba.entity = pos.entity LEFT JOIN ex ON ex.portfolio_id = pos.portfolio_id AND ex.entity = pos.entity
  WHERE pos.session >= a AND (eventual_exit IS NULL OR pos.session <= eventual_exit) GROUP BY 1, 2)
SELECT ba.portfolio_id, ba.entity, stale_marks, unavailable_exits, prevented_entries, first_incident, last_incident, eventual_exit, coalesce(n, 0) AS trapped_sessions
FROM ba LEFT JOIN ex ON ex.portfolio_id = ba.portfolio_id AND ex.entity = ba.entity LEFT JOIN tp ON tp.portfolio_id = ba.portfolio_id AND tp.entity = ba.entity""")
def _(spark, d):
    b = Book(spark, d)
    return po.exception_audit(b.anomalies, b.trades, b.positions)


CONTRIB = f"""{EPISODES.replace(EQUITY, POSITIONS)}, lines AS (SELECT portfolio_id, session, row_number() OVER (PARTITION BY portfolio_id ORDER BY session) AS i FROM eq),
px AS (SELECT pos.portfolio_id, entity, i, market_value AS mv FROM pos JOIN lines l ON l.portfolio_id = pos.portfolio_id AND l.session = pos.session),
cs AS (SELECT portfolio_id, entity, i, mv AS nw, 0.0 AS pr, 0.0 AS inv, 0.0 AS cost, 0 AS had FROM px UNION ALL SELECT portfolio_id, entity, i + 1, 0, mv, 0, 0, 1 FROM px
  UNION ALL SELECT tr.portfolio_id, entity, i, 0, 0, CASE WHEN side = 'BUY' THEN notional + transaction_cost ELSE -(notional - transaction_cost) END, transaction_cost + slippage_cost, 0
    FROM tr JOIN lines l ON l.portfolio_id = tr.portfolio_id AND l.session = tr.session),
ct AS (SELECT portfolio_id, entity, i, sum(nw) - sum(pr) - sum(inv) AS net_contribution, sum(cost) AS all_in_cost, CASE WHEN max(had) = 1 THEN 'EXISTING' ELSE 'NEWLY_ENTERED' END AS position_status FROM cs GROUP BY 1, 2, 3),
contrib AS (SELECT ct.portfolio_id, l.session, entity, net_contribution, all_in_cost, net_contribution + all_in_cost AS gross_contribution, position_status FROM ct JOIN lines l ON l.portfolio_id = ct.portfolio_id AND l.i = ct.i)"""


def contributions(b):
    return po.daily_contribution(b.equity, b.positions, b.trades)


@query("daily_contribution", final(CONTRIB, "portfolio_id, session, entity, position_status", "contrib", "net_contribution all_in_cost gross_contribution"))
def _(spark, d):
    return contributions(Book(spark, d))


@query("contribution_share", f"""WITH {CONTRIB}, sm AS (SELECT portfolio_id, group_name, sum(net_contribution) AS c FROM contrib JOIN regions USING (entity) GROUP BY 1, 2)
SELECT portfolio_id, group_name, round(c, 6) + 0.0 AS contribution, round(abs(c) / sum(abs(c)) OVER (PARTITION BY portfolio_id), 6) + 0.0 AS absolute_share FROM sm""")
def _(spark, d):
    c = contributions(Book(spark, d)).join(views.groups_region(spark, d), "entity")
    return po.contribution_share(c, "group_name")


@query("drawdown_attribution", f"""WITH {CONTRIB}, ins AS (SELECT c.*, episode_id, group_name FROM contrib c JOIN regions USING (entity) JOIN episodes e ON e.portfolio_id = c.portfolio_id AND c.session > peak_session AND c.session <= trough_session),
sm AS (SELECT portfolio_id, episode_id, group_name, sum(net_contribution) AS n, coalesce(sum(CASE WHEN position_status = 'EXISTING' THEN net_contribution END), 0) AS ex,
  coalesce(sum(CASE WHEN position_status = 'NEWLY_ENTERED' THEN net_contribution END), 0) AS nw FROM ins GROUP BY 1, 2, 3)
SELECT portfolio_id, episode_id, group_name, round(n, 6) + 0.0 AS net_contribution, round(ex, 6) + 0.0 AS existing_contribution, round(nw, 6) + 0.0 AS new_contribution,
  round(abs(n) / nullif(sum(abs(n)) OVER (PARTITION BY portfolio_id, episode_id), 0), 6) + 0.0 AS absolute_share FROM sm""")
def _(spark, d):
    b = Book(spark, d)
    c = contributions(b).join(views.groups_region(spark, d), "entity")
    return po.drawdown_attribution(b.equity, c, "group_name")


@query("nullable_carry_mark", f"""WITH {TARGETS}, fb AS (SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS session, min(l_extendedprice) AS c FROM lineitem WHERE l_quantity < 20 GROUP BY 1, 2),
hold AS (SELECT 'all' AS portfolio_id, e.entity, c.session FROM (SELECT entity, min(position) AS a, max(position) AS b FROM panel GROUP BY 1) e JOIN calendar c ON c.position BETWEEN a AND b),
m0 AS (SELECT hold.*, p.turnover AS own, fb.c AS alt FROM hold LEFT JOIN (SELECT * FROM panel WHERE volume >= 40) p USING (entity, session) LEFT JOIN fb USING (entity, session)),
m AS (SELECT *, last_value(coalesce(own, alt) IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM m0)
SELECT entity, session, round(mark, 4) + 0.0 AS mark, CASE WHEN own IS NOT NULL THEN 'OWN_CLOSE' WHEN alt IS NOT NULL THEN 'FALLBACK_CLOSE' WHEN mark IS NOT NULL THEN 'CARRIED' END AS mark_source FROM m""")
def _(spark, d):
    week = pp.Week(spark, d)
    p = week.panel
    # Held from the first to the last session of a supplier, gaps included.
    span = p.groupBy("entity").agg(F.min("position").alias("_a"), F.max("position").alias("_b"))
    held = span.select(F.lit("all").alias("portfolio_id"), "entity", F.explode(F.sequence("_a", "_b")).alias("position"))
    held = held.join(week.calendar, "position").drop("position")
    fb = views.table(spark, d, "lineitem").where("l_quantity < 20").select(
        F.col("l_suppkey").alias("entity"), F.date_trunc("week", "l_shipdate").cast("date").alias("session"), F.col("l_extendedprice").alias("close"))
    own = p.where("volume >= 40").select("entity", "session", F.col("turnover").alias("close"))
    out = ro.carry_mark(held, own, fb)
    return out.select("entity", "session", F.round("mark", 4).alias("mark"), "mark_source")
