"""Queries: session index, rolling features, intervals, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import calendar as cal
from stratapanel.operators import evidence as ev
from stratapanel.operators import intervals as iv
from stratapanel.operators import ranks as rk
from stratapanel.operators import rolling as ro
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans import views
from stratapanel.plans.registry import final, query

M = s.panel()
WK = s.panel("week")
ES = "entity, session"


@query("session_position", final(M, f"{ES}, position", "panel"))
def _(spark, d):
    return pp.positioned(spark, d).select("entity", "session", "position")


@query("history_sessions", final(
    M, f"{ES}, min(session) OVER (PARTITION BY entity) AS first_session, "
    "row_number() OVER (PARTITION BY entity ORDER BY session) AS history_sessions, "
    "row_number() OVER (PARTITION BY entity ORDER BY session) - 1 AS prior_history_sessions", "panel"))
def _(spark, d):
    out = cal.history_sessions(views.panel_month(spark, d))
    return out.select("entity", "session", "first_session", "history_sessions", "prior_history_sessions")


def _full(value, w):
    over = f"OVER (PARTITION BY entity ORDER BY position ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {over} = {w} THEN avg({value}) {over} END"


@query("rolling_liquidity", final(
    M + f""", liq AS (SELECT entity, session, {_full('volume', 20)} AS avg_volume_20,
    {_full('turnover', 20)} AS avg_turnover_20, {_full('turnover', 60)} AS avg_turnover_60 FROM panel)""",
    ES, "liq", "avg_volume_20 avg_turnover_20 avg_turnover_60"))
def _(spark, d):
    out = ro.rolling_liquidity(pp.positioned(spark, d))
    return out.select("entity", "session", "avg_volume_20", "avg_turnover_20", "avg_turnover_60")


@query("recent_presence", final(
    WK, f"{ES}, coalesce(position - lag(position, 4) OVER w = 4, FALSE) AS recent_presence_5, "
    "coalesce(position - lag(position, 19) OVER w = 19, FALSE) AS recent_presence_20",
    "panel WINDOW w AS (PARTITION BY entity ORDER BY position)"))
def _(spark, d):
    out = ro.recent_presence(pp.positioned(spark, d, "week"), (5, 20))
    return out.select("entity", "session", "recent_presence_5", "recent_presence_20")


# Named universes of the test panel.
SPECS = {
    "broad": {"minimum_close": 0, "minimum_prior_sessions": 0},
    "basic": {"minimum_close": 100, "minimum_prior_sessions": 20, "minimum_avg_turnover": 200000},
    "moderate": {"minimum_close": 200, "minimum_prior_sessions": 40, "minimum_avg_turnover": 220000,
                 "minimum_avg_volume": 180},
}
UNIVERSE_SQL = f"""hist AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY position) - 1 AS prior_history_sessions,
    {_full('volume', 20)} AS avg_volume_20, {_full('turnover', 20)} AS avg_turnover_20,
    coalesce(position - lag(position, 19) OVER (PARTITION BY entity ORDER BY position) = 19, FALSE) AS recent_presence_20 FROM panel),
universe AS (SELECT *, coalesce(close >= 0 AND prior_history_sessions >= 0, FALSE) AS universe_broad,
    coalesce(close >= 100 AND prior_history_sessions >= 20 AND recent_presence_20 AND avg_turnover_20 >= 200000, FALSE) AS universe_basic,
    coalesce(close >= 200 AND prior_history_sessions >= 40 AND recent_presence_20 AND avg_turnover_20 >= 220000
        AND avg_volume_20 >= 180, FALSE) AS universe_moderate FROM hist)"""


def universe_panel(spark, d):
    p = cal.history_sessions(pp.positioned(spark, d))
    p = ro.recent_presence(ro.rolling_liquidity(p), (20, 60))
    return ro.universe_membership(p, SPECS)


@query("universe_membership", final(
    f"{M}, {UNIVERSE_SQL}", f"{ES}, universe_broad, universe_basic, universe_moderate", "universe"))
def _(spark, d):
    return universe_panel(spark, d).select("entity", "session", "universe_broad", "universe_basic", "universe_moderate")


def _baseline_sql(h):
    prior = f"OVER (PARTITION BY entity ORDER BY position ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)"
    return f"""base AS (SELECT *, lag(position, {h}) OVER (PARTITION BY entity ORDER BY position) AS sp,
    CASE WHEN count(volume) {prior} = {h} THEN avg(volume) {prior} END AS volume_mean_{h}_prior,
    CASE WHEN count(volume) {prior} = {h} THEN quantile_cont(volume, 0.5) {prior} END AS volume_median_{h}_prior,
    CASE WHEN count(volume) {prior} = {h} THEN avg(ln(1 + volume)) {prior} END AS volume_log_mean_{h}_prior,
    sum(CAST(quality AS INT)) {prior} AS good,
    EXISTS (SELECT 1 FROM evp e WHERE e.entity = panel.entity AND e.position > panel.position - {h}
            AND e.position <= panel.position) AS crossed FROM panel),
baseline AS (SELECT *, CASE WHEN quality AND volume >= 0 AND volume_mean_{h}_prior > 0 AND volume_median_{h}_prior > 0
      AND position - sp = {h} AND good = {h} AND NOT crossed THEN TRUE ELSE FALSE END AS valid_volume_baseline_{h},
    CASE WHEN quality AND volume >= 0 AND volume_mean_{h}_prior > 0 AND volume_median_{h}_prior > 0
      AND position - sp = {h} AND good = {h} AND NOT crossed THEN ''
      WHEN NOT quality THEN 'INVALID_SOURCE_ROW' WHEN sp IS NULL THEN 'INSUFFICIENT_HISTORY'
      WHEN position - sp <> {h} THEN 'MISSING_OR_UNSAFE_SESSION_INTERVAL'
      WHEN good <> {h} THEN 'UNSAFE_PRIOR_OBSERVATION' WHEN crossed THEN 'CORPORATE_ACTION_INTERVAL'
      ELSE 'OTHER_UNSAFE_INTERVAL' END AS volume_baseline_{h}_invalid_reason FROM base),
surprise AS (SELECT *, CASE WHEN valid_volume_baseline_{h} THEN volume / volume_mean_{h}_prior END AS volume_ratio_{h},
    CASE WHEN valid_volume_baseline_{h} THEN volume / volume_median_{h}_prior END AS volume_median_ratio_{h},
    CASE WHEN valid_volume_baseline_{h} THEN ln(1 + volume) - volume_log_mean_{h}_prior END AS log_volume_surprise_{h}
  FROM baseline)"""


def crossed_panel(spark, d, horizons, unit="month", week=None):
    ledger = views.impact_days(spark, d)
    panel = week.panel if week else pp.positioned(spark, d, unit)
    calendar = week.calendar if week else pp.calendar_of(spark, d, unit)
    return iv.with_crossings(panel, ledger, horizons, calendar=calendar)


def baseline_panel(spark, d, h=20):
    return ro.prior_volume_baseline(crossed_panel(spark, d, (h,)), (h,), crossing="crossing")


@query("prior_volume_baseline", final(
    f"{M}, {s.EVENTS}, {_baseline_sql(20)}", f"{ES}, valid_volume_baseline_20, volume_baseline_20_invalid_reason",
    "baseline", "volume_mean_20_prior volume_median_20_prior volume_log_mean_20_prior"))
def _(spark, d):
    return baseline_panel(spark, d).select(
        "entity", "session", "valid_volume_baseline_20", "volume_baseline_20_invalid_reason",
        "volume_mean_20_prior", "volume_median_20_prior", "volume_log_mean_20_prior")


@query("volume_surprise", final(
    f"{M}, {s.EVENTS}, {_baseline_sql(20)}", ES, "surprise",
    "volume_ratio_20 volume_median_ratio_20 log_volume_surprise_20"))
def _(spark, d):
    out = ro.volume_surprise(baseline_panel(spark, d), (20,))
    return out.select("entity", "session", "volume_ratio_20", "volume_median_ratio_20", "log_volume_surprise_20")


def _price_sql(h, name="pr"):
    w = "(PARTITION BY entity ORDER BY position)"
    rows = f"(PARTITION BY entity ORDER BY position ROWS BETWEEN {h} PRECEDING AND CURRENT ROW)"
    return f"""{name}0 AS (SELECT *, lag(position, {h}) OVER {w} AS sp, lag(close, {h}) OVER {w} AS sc,
    sum(CAST(quality AS INT)) OVER {rows} AS good,
    EXISTS (SELECT 1 FROM evp e WHERE e.entity = panel.entity AND e.position > panel.position - {h}
            AND e.position <= panel.position) AS crossed FROM panel),
{name} AS (SELECT *, coalesce(quality AND sc > 0 AND position - sp = {h} AND good = {h + 1} AND NOT crossed, FALSE) AS valid_price_return_{h},
    CASE WHEN coalesce(quality AND sc > 0 AND position - sp = {h} AND good = {h + 1} AND NOT crossed, FALSE) THEN ''
      WHEN NOT quality THEN 'INVALID_SOURCE_ROW' WHEN sp IS NULL THEN 'INSUFFICIENT_HISTORY'
      WHEN position - sp <> {h} THEN 'MISSING_OR_UNSAFE_SESSION_INTERVAL' WHEN good <> {h + 1} THEN 'UNSAFE_PRIOR_OBSERVATION'
      WHEN crossed THEN 'CORPORATE_ACTION_INTERVAL' ELSE 'OTHER_UNSAFE_INTERVAL' END AS price_return_{h}_invalid_reason,
    CASE WHEN quality AND sc > 0 AND position - sp = {h} AND good = {h + 1} AND NOT crossed THEN close / sc - 1 END AS price_return_{h}
  FROM {name}0)"""


@query("price_return_h", final(
    f"{WK}, {s.EVENTS}, {_price_sql(5)}", f"{ES}, valid_price_return_5, price_return_5_invalid_reason", "pr",
    "price_return_5"))
def _(spark, d):
    out = ro.price_return(crossed_panel(spark, d, (5,), "week"), (5,), crossing="crossing")
    return out.select("entity", "session", "valid_price_return_5", "price_return_5_invalid_reason", "price_return_5")


ONE_SQL = """one0 AS (SELECT *, lag(close) OVER w AS pc, lag(session) OVER w AS pd, lag(position) OVER w AS ppos,
    coalesce(lag(quality) OVER w, FALSE) AS pq,
    EXISTS (SELECT 1 FROM evp e WHERE e.entity = panel.entity AND e.position = panel.position) AS crossed
    FROM panel WINDOW w AS (PARTITION BY entity ORDER BY position)),
one AS (SELECT *, coalesce(pc IS NOT NULL AND pq AND quality AND position - ppos = 1 AND NOT crossed
      AND pd >= DATE '1995-06-01' AND session <= DATE '2001-06-30', FALSE) AS valid_return,
    CASE WHEN pc IS NOT NULL AND pq AND quality AND position - ppos = 1 AND NOT crossed
      AND pd >= DATE '1995-06-01' AND session <= DATE '2001-06-30' THEN close / pc - 1 END AS entity_return,
    CASE WHEN session > DATE '2001-06-30' OR coalesce(pd < DATE '1995-06-01', FALSE) THEN 'CORPORATE_ACTION_COVERAGE_UNCERTIFIED'
      WHEN pc IS NULL THEN 'UNAVAILABLE_ENDPOINT' WHEN position - ppos <> 1 THEN 'MISSING_SESSION_ENDPOINT'
      WHEN crossed THEN 'CORPORATE_ACTION_INTERVAL_BLOCKED' WHEN NOT (pq AND quality) THEN 'UNSAFE_SOURCE_ENDPOINT' ELSE '' END
      AS return_invalid_reason FROM one0)"""
COVERAGE = ("1995-06-01", "2001-06-30")


def one_session(spark, d, unit="week", week=None):
    return ro.one_session_return(crossed_panel(spark, d, (1,), unit, week), crossing="crossing_1", coverage=COVERAGE)


@query("one_session_return", final(
    f"{WK}, {s.EVENTS}, {ONE_SQL}", f"{ES}, valid_return, return_invalid_reason", "one", "entity_return"))
def _(spark, d):
    return one_session(spark, d).select("entity", "session", "valid_return", "return_invalid_reason", "entity_return")


def _compound_sql(source, key, value, formations, futures, out="comp"):
    cols = []
    for h in formations:
        w = f"(PARTITION BY {key} ORDER BY position ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
        ok = (f"count({value}) OVER {w} = {h} AND position - lag(position, {h - 1}) OVER (PARTITION BY {key} ORDER BY position) = {h - 1}")
        cols += [f"coalesce({ok}, FALSE) AS valid_ret_{h}", f"CASE WHEN {ok} THEN product(1 + {value}) OVER {w} - 1 END AS ret_{h}"]
    for h in futures:
        w = f"(PARTITION BY {key} ORDER BY position ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        ok = (f"count({value}) OVER {w} = {h} AND lead(position, {h}) OVER (PARTITION BY {key} ORDER BY position) - position = {h}")
        cols += [f"coalesce({ok}, FALSE) AS valid_future_ret_{h}",
                 f"CASE WHEN {ok} THEN product(1 + {value}) OVER {w} - 1 END AS future_ret_{h}"]
    return f"{out} AS (SELECT *, {', '.join(cols)} FROM {source})"


@query("compound_return", final(
    f"{WK}, {s.EVENTS}, {ONE_SQL}, {_compound_sql('one', 'entity', 'entity_return', (2, 4), (1, 3))}",
    f"{ES}, valid_ret_2, valid_ret_4, valid_future_ret_1, valid_future_ret_3", "comp",
    "ret_2 ret_4 future_ret_1 future_ret_3"))
def _(spark, d):
    out = ro.compound_return(one_session(spark, d), (2, 4), (1, 3))
    return out.select("entity", "session", *[c for c in out.columns if "ret_" in c])


PIT_COV = s.pit((1, 5), (1, 3), events=True, coverage=COVERAGE)


@query("interval_panel_pit", final(
    f"{WK}, {s.EVENTS}, {PIT_COV}",
    f"{ES}, " + ", ".join(f"valid_factor_broad_{h}, valid_factor_primary_{h}" for h in (1, 5)) + ", "
    + ", ".join(f"valid_future_broad_{h}, valid_future_primary_{h}" for h in (1, 3)), "pit",
    "ret_1 ret_5 future_ret_1 future_ret_3"))
def _(spark, d):
    out = pp.intervals(spark, d, (1, 5), (1, 3), "week", events=True, coverage=COVERAGE)
    return out.select("entity", "session", *[c for c in out.columns if "ret_" in c or "valid_" in c])


FULL_SQL_PANEL = """elig AS (SELECT *, volume >= 10 AS eligible, close > 2500 AS contaminated FROM panel),
bounds AS (SELECT entity, min(position) AS first_pos FROM elig GROUP BY 1)"""


def _full_sql(h, ahead):
    lo, hi = ("p.position", f"p.position + {h}") if ahead else (f"p.position - {h}", "p.position")
    end = f"p.position {'+' if ahead else '-'} {h}"
    n = "f" if ahead else "b"
    inside = f"({end} BETWEEN 0 AND (SELECT max(position) FROM calendar))"
    sub = lambda c: f"(SELECT count(*) FROM elig q WHERE q.entity = p.entity AND q.position BETWEEN {lo} AND {hi} {c})"
    cut = "(SELECT max(position) FROM calendar WHERE session <= DATE '2001-03-31')"
    if ahead:
        missing = f"CASE WHEN NOT {inside} OR e.close IS NULL THEN 'UNAVAILABLE_ENDPOINT' END"
        endbad = f"CASE WHEN {inside} AND NOT e.eligible THEN 'TARGET_ENDPOINT_INELIGIBLE' END"
        cert = f"CASE WHEN {end} > {cut} THEN 'CORPORATE_ACTION_COVERAGE_UNCERTIFIED' END"
    else:
        missing = (f"CASE WHEN {end} < 0 OR (e.close IS NULL AND {end} < first_pos) THEN 'INSUFFICIENT_HISTORY' "
                   f"WHEN e.close IS NULL THEN 'UNAVAILABLE_ENDPOINT' END")
        endbad = f"CASE WHEN {inside} AND NOT e.eligible THEN 'LOOKBACK_ENDPOINT_INELIGIBLE' END"
        cert = f"CASE WHEN p.position > {cut} THEN 'CORPORATE_ACTION_COVERAGE_UNCERTIFIED' END"
    reason = f"""concat_ws('|', CASE WHEN NOT p.eligible THEN 'SIGNAL_ROW_INELIGIBLE' END,
      CASE WHEN p.contaminated THEN 'IDENTITY_CONTAMINATION' END, {missing}, {endbad},
      CASE WHEN {inside} AND {sub('')} < {h + 1} THEN 'MISSING_UNSAFE_SESSION_INTERVAL' END,
      CASE WHEN {inside} AND {sub('AND NOT eligible')} > 0 THEN 'UNSAFE_SESSION_INTERVAL' END,
      CASE WHEN NOT p.contaminated AND {inside} AND {sub('AND contaminated')} > 0 THEN 'IDENTITY_CONTAMINATION' END,
      CASE WHEN {inside} AND EXISTS (SELECT 1 FROM evp v WHERE v.entity = p.entity AND v.position > {lo} AND v.position <= {hi})
        THEN 'UNRESOLVED_CORPORATE_ACTION_INTERVAL' END, {cert})"""
    value = "e.close / p.close - 1" if ahead else "p.close / e.close - 1"
    return f"""{n}{h} AS (SELECT p.entity, p.session, {reason} AS reason_{n}{h}, {value} AS value_{n}{h}, c.session AS end_{n}{h}
  FROM elig p JOIN bounds USING (entity) LEFT JOIN elig e ON e.entity = p.entity AND e.position = {end}
  LEFT JOIN calendar c ON c.position = {end})"""


@query("interval_panel", f"""WITH {WK}, {s.EVENTS}, {FULL_SQL_PANEL}, {_full_sql(2, False)}, {_full_sql(5, False)}, {_full_sql(1, True)}, {_full_sql(3, True)}
SELECT entity, session, """ + ", ".join(
    f"""reason_{n}{h} AS {r}, reason_{n}{h} = '' AS {v}, end_{n}{h} AS {e},
    CASE WHEN reason_{n}{h} = '' THEN round(value_{n}{h}, 6) + 0.0 END AS {x}"""
    for n, h, x, v, r, e in [("b", h, f"ret_{h}", f"valid_ret_{h}", f"ret_{h}_invalid_reason", f"ret_{h}_endpoint") for h in (2, 5)]
    + [("f", h, f"future_ret_{h}", f"valid_future_{h}", f"future_invalid_reason_{h}", f"future_{h}_endpoint") for h in (1, 3)])
    + " FROM b2 JOIN b5 USING (entity, session) JOIN f1 USING (entity, session) JOIN f3 USING (entity, session)")
def _(spark, d):
    out = full_intervals(spark, d)
    return out.select("entity", "session", *[c for c in out.columns if "ret_" in c or "future_" in c])


def full_intervals(spark, d, formations=(2, 5), futures=(1, 3)):
    p = pp.positioned(spark, d, "week").withColumn("eligible", F.col("volume") >= 10).withColumn(
        "contaminated", F.col("close") > 2500)
    return iv.interval_panel(
        p, formations, futures, events=views.impact_days(spark, d),
        calendar=pp.calendar_of(spark, d, "week"), coverage_end="2001-03-31")


def _strict_sql(h, ahead):
    w = "(PARTITION BY entity ORDER BY position)"
    fn = "lead" if ahead else "lag"
    rows = f"BETWEEN CURRENT ROW AND {h} FOLLOWING" if ahead else f"BETWEEN {h} PRECEDING AND CURRENT ROW"
    lo, hi = ("st.position", f"st.position + {h}") if ahead else (f"st.position - {h}", "st.position")
    n = ("f" if ahead else "b") + str(h)
    cert = f"coalesce(d2 <= DATE '2001-03-31', FALSE)" if ahead else "TRUE"
    exact = f"coalesce({'p2 - position' if ahead else 'position - p2'} = {h}, FALSE)"
    miss = "UNAVAILABLE_FUTURE_ENDPOINT" if ahead else "INSUFFICIENT_HISTORY"
    certcase = f"WHEN NOT {cert} THEN 'CORPORATE_ACTION_COVERAGE_UNCERTIFIED' " if ahead else ""
    return f"""{n}0 AS (SELECT *, {fn}(close, {h}) OVER {w} AS c2, {fn}(position, {h}) OVER {w} AS p2, {fn}(session, {h}) OVER {w} AS d2,
    sum(CAST(good AS INT)) OVER (PARTITION BY entity ORDER BY position ROWS {rows}) = {h + 1} AS safe,
    EXISTS (SELECT 1 FROM evp v WHERE v.entity = st.entity AND v.position > {lo} AND v.position <= {hi}) AS crossed FROM st),
{n} AS (SELECT entity, session, safe AND {exact} AND c2 IS NOT NULL AND NOT crossed AND {cert} AS ok_{n},
    CASE WHEN safe AND {exact} AND c2 IS NOT NULL AND NOT crossed AND {cert} THEN round({'c2 / close' if ahead else 'close / c2'} - 1, 6) + 0.0 END AS v_{n},
    CASE WHEN NOT identity_safe THEN 'IDENTITY_AMBIGUOUS' WHEN NOT good THEN 'INVALID_SIGNAL_ENDPOINT' WHEN c2 IS NULL THEN '{miss}'
      WHEN NOT {exact} THEN 'UNAVAILABLE_SESSION_ENDPOINT' {certcase}WHEN crossed THEN 'CORPORATE_ACTION_INTERVAL'
      WHEN NOT safe THEN 'UNSAFE_INTERVENING_SESSION' ELSE '' END AS r_{n} FROM {n}0)"""


@query("interval_panel_strict", f"""WITH {WK}, {s.EVENTS}, {s.NATION},
st AS (SELECT panel.*, NOT identity_ambiguous AS identity_safe, quality AND NOT identity_ambiguous AND close > 0 AS good
  FROM panel JOIN groups USING (entity)), {_strict_sql(4, False)}, {_strict_sql(2, True)}
SELECT entity, session, ok_b4 AS valid_return_4, v_b4 AS price_return_4, r_b4 AS return_4_invalid_reason,
  ok_f2 AS valid_future_2, v_f2 AS future_return_2, r_f2 AS future_invalid_reason_2
FROM b4 JOIN f2 USING (entity, session)""")
def _(spark, d):
    ids = views.groups_nation(spark, d).select("entity", (~F.col("identity_ambiguous")).alias("identity_safe"))
    p = pp.positioned(spark, d, "week").join(ids, "entity")
    out = iv.interval_panel_strict(
        p, (4,), (2,), events=views.impact_days(spark, d),
        calendar=pp.calendar_of(spark, d, "week"), certified_end="2001-03-31")
    return out.select("entity", "session", *[c for c in out.columns if "return_" in c or "future_" in c])


PIT = s.pit_windows(pp.FORMATIONS, pp.FUTURES)
RANKED = f"{M}, {PIT}, {s.ranked(pp.FORMATIONS, pp.FUTURES)}"


@query("cross_sectional_rank", final(RANKED, f"{ES}, formation, rank, count", "ranked", "factor pct"))
def _(spark, d):
    out = pp.rank_signals(pp.intervals(spark, d))
    return out.select("entity", "session", "formation", "rank", "count", "factor", "pct")


@query("average_rank", final(
    M, f"{ES}, CAST(rank() OVER (PARTITION BY session ORDER BY volume) + (count(*) OVER (PARTITION BY session, volume) - 1) / 2.0 AS DOUBLE) AS rank",
    "panel"))
def _(spark, d):
    return rk.average_rank(views.panel_month(spark, d), "volume", keys=["session"]).select("entity", "session", "rank")


@query("attach_outcomes", final(
    f"{RANKED}, att AS (SELECT *, o1 AS outcome FROM ranked WHERE o1 IS NOT NULL)", f"{ES}, formation, rank, count",
    "att", "factor outcome"))
def _(spark, d):
    wide = pp.intervals(spark, d)
    outcomes = wide.select("entity", "session", F.col("future_ret_1").alias("outcome"), "valid_future_primary_1")
    ranked = pp.rank_signals(wide).drop("outcomes")
    out = rk.attach_outcomes(ranked, outcomes, valid="valid_future_primary_1")
    return out.select("entity", "session", "formation", "rank", "count", "factor", "outcome")


@query("rank_ic_daily", final(
    f"{RANKED}, {s.spearman('paired', 'formation, future, session', 'rank', 'outcome', 'ics')}",
    "formation, future, session, observations", "ics", "ic"))
def _(spark, d):
    return ev.rank_ic_daily(pp.paired(spark, d), keys=pp.KEYS)


@query("rank_ic_daily_stored_rank", final(
    f"{RANKED}, {s.spearman('paired', 'formation, future, session', 'rank', 'outcome', 'ics', rerank=False)}",
    "formation, future, session, observations", "ics", "ic"))
def _(spark, d):
    return ev.rank_ic_daily(pp.paired(spark, d), keys=pp.KEYS, rerank_factor=False)


DAILY = f"{RANKED}, {s.daily(10, 10)}"


@query("ic_summary", final(
    f"{DAILY}, summ AS (SELECT formation, future, {s.summary_cols()} FROM daily GROUP BY 1, 2)",
    "formation, future, valid_dates, observation_count", "summ", s.SUMMARY_DOUBLES))
def _(spark, d):
    return ev.summarize_daily(pp.daily(spark, d), keys=pp.PAIR_KEYS)
