"""Queries: buckets, tails, daily spreads, summaries, chronology."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.functions.scalars import in_bottom, in_top, percentile_bucket, quantile_bucket
from stratapanel.operators import chronology as ch
from stratapanel.operators import classify as cl
from stratapanel.operators import evidence as ev
from stratapanel.operators import ranks as rk
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans.q_core import DAILY, M, RANKED
from stratapanel.plans.registry import final, query

PAIR = "formation, future"
ES = "entity, session"


@query("quantile_bucket", final(
    RANKED, f"{ES}, formation, CASE WHEN count >= 10 THEN ((rank - 1) * 10) // count + 1 END AS bucket", "ranked"))
def _(spark, d):
    ranked = pp.rank_signals(pp.intervals(spark, d))
    return rk.with_quantile_bucket(ranked, 10, 10).select("entity", "session", "formation", "bucket")


@query("quantile_bucket_rerank", final(
    f"""{RANKED}, again AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY formation, future, session, rank) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY formation, future, session) AS m FROM paired WINDOW w AS (PARTITION BY formation, future, session ORDER BY rank))""",
    f"{ES}, formation, future, CASE WHEN m >= 10 THEN CAST(floor((r - 1) * 10 / m) AS BIGINT) + 1 ELSE 0 END AS bucket", "again"))
def _(spark, d):
    out = rk.bucket_after_rerank(pp.paired(spark, d), "rank", 10, keys=pp.KEYS, minimum=10)
    return out.select("entity", "session", "formation", "future", "bucket")


@query("percentile_bucket", final(
    RANKED, f"{ES}, formation, CAST(least(floor(pct * 5) + 1, 5) AS BIGINT) AS bucket", "ranked"))
def _(spark, d):
    ranked = pp.rank_signals(pp.intervals(spark, d))
    return ranked.select("entity", "session", "formation", percentile_bucket("pct", 5).alias("bucket"))


@query("tail_flags", final(
    RANKED, f"{ES}, formation, rank > count - ceil(count * 0.05) AS top5, rank <= ceil(count * 0.05) AS bottom5, "
    "rank > count - ceil(count * 0.2) AS top20, rank <= ceil(count * 0.2) AS bottom20, "
    "count >= 6 AND rank > count - 3 AS top3, count >= 6 AND rank <= 3 AS bottom3, "
    "pct >= 0.9 AS high_pct, pct <= 0.1 AS low_pct", "ranked"))
def _(spark, d):
    r = pp.rank_signals(pp.intervals(spark, d))
    three = ev.fixed_tail_columns(3, 6)["fixed3"]
    return r.select(
        "entity", "session", "formation",
        in_top("rank", "count", 0.05).alias("top5"), in_bottom("rank", "count", 0.05).alias("bottom5"),
        in_top("rank", "count", 0.2).alias("top20"), in_bottom("rank", "count", 0.2).alias("bottom20"),
        three[0].alias("top3"), three[1].alias("bottom3"),
        (F.col("pct") >= 0.9).alias("high_pct"), (F.col("pct") <= 0.1).alias("low_pct"),
    )


@query("winsorize_same_date", final(
    f"""{M}, lim AS (SELECT session, quantile_cont(volume, 0.01) AS lo, quantile_cont(volume, 0.99) AS hi
    FROM panel WHERE quality GROUP BY 1), w AS (SELECT entity, session,
    CASE WHEN quality THEN greatest(least(volume, hi), lo) END AS winsorized FROM panel LEFT JOIN lim USING (session))""",
    ES, "w", "winsorized"))
def _(spark, d):
    out = rk.winsorize_same_date(pp.positioned(spark, d), "volume", 0.01, 0.99, mask="quality")
    return out.select("entity", "session", "winsorized")


@query("top_n_outliers", f"""WITH {M}, f AS (
  SELECT entity, session, 'turnover' AS feature, turnover AS extreme_value, turnover AS size FROM panel
  UNION ALL SELECT entity, session, 'log_gap', ln(1 + volume) - 5, abs(ln(1 + volume) - 5) FROM panel),
o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY size DESC, entity, session) AS extreme_rank FROM f)
SELECT entity, session, feature, round(extreme_value, 6) + 0.0 AS extreme_value, extreme_rank FROM o WHERE extreme_rank <= 25""")
def _(spark, d):
    p = pp.positioned(spark, d).withColumn("log_gap", F.log1p("volume") - 5)
    return rk.top_n_outliers(p, {"turnover": False, "log_gap": True}, 25, tie=["entity", "session"], keep=["entity", "session"])


@query("double_sort", final(
    f"""{RANKED}, two AS (SELECT a.entity, a.session, a.outcome, least(floor(a.pct * 5) + 1, 5) AS first_bucket,
      least(floor(b.pct * 5) + 1, 5) AS second_bucket
      FROM paired a JOIN ranked b ON a.entity = b.entity AND a.session = b.session AND b.formation = 20
      WHERE a.formation = 5 AND a.future = 1),
    cells AS (SELECT CAST(first_bucket AS BIGINT) AS first_bucket, CAST(second_bucket AS BIGINT) AS second_bucket,
      count(*) AS observation_count, avg(outcome) AS mean_outcome, stddev_samp(outcome) AS std_outcome,
      100.0 * count(CASE WHEN outcome > 0 THEN 1 END) / count(*) AS positive_pct, median(outcome) AS median_outcome
      FROM two GROUP BY 1, 2)""",
    "first_bucket, second_bucket, observation_count", "cells", "mean_outcome std_outcome positive_pct median_outcome"))
def _(spark, d):
    ranked = pp.rank_signals(pp.intervals(spark, d, (5, 20), (1,)), (5, 20), (1,))
    short = ev.with_outcomes(ranked.where(F.col("formation") == 5)).select("entity", "session", "pct", "outcome")
    long = ranked.where(F.col("formation") == 20).select("entity", "session", F.col("pct").alias("pct_long"))
    cells = rk.double_sort(short.join(long, ["entity", "session"]), "pct", "pct_long", 5)
    return ev.pooled_stats(cells, keys=["first_bucket", "second_bucket"])


BUCKETED = f"""{RANKED}, bucketed AS (SELECT *, CASE WHEN count >= 10 THEN ((rank - 1) * 10) // count + 1 END AS bucket FROM paired)"""
POOLED = """pooled AS (SELECT formation, future, bucket, count(*) AS observation_count, avg(outcome) AS mean_outcome,
  stddev_samp(outcome) AS std_outcome, 100.0 * count(CASE WHEN outcome > 0 THEN 1 END) / count(*) AS positive_pct,
  median(outcome) AS median_outcome FROM bucketed WHERE bucket IS NOT NULL GROUP BY 1, 2, 3)"""
BY_BUCKET = ["formation", "future", "bucket"]


def bucketed_pairs(spark, d):
    return pp.paired(spark, d).withColumn("bucket", quantile_bucket("rank", "count", 10, 10)).where("bucket IS NOT NULL")


@query("pooled_bucket_stats", final(
    f"{BUCKETED}, {POOLED}", f"{PAIR}, bucket, observation_count", "pooled",
    "mean_outcome std_outcome positive_pct median_outcome"))
def _(spark, d):
    return ev.pooled_stats(bucketed_pairs(spark, d), keys=BY_BUCKET)


@query("quantile_monotonicity", final(
    f"""{BUCKETED}, {POOLED}, stepped AS (SELECT *, CAST(mean_outcome > lag(mean_outcome) OVER (PARTITION BY {PAIR} ORDER BY bucket) AS INT) AS up,
      rank() OVER (PARTITION BY {PAIR} ORDER BY mean_outcome) AS r FROM pooled),
    mono AS (SELECT {PAIR}, max_by(mean_outcome, bucket) AS top_mean, min_by(mean_outcome, bucket) AS bottom_mean,
      CAST(sum(up) AS BIGINT) AS upward_steps, CAST(sum(observation_count) AS BIGINT) AS bucket_observations,
      max_by(mean_outcome, bucket) - min_by(mean_outcome, bucket) AS spread, corr(bucket, r) AS monotonicity
      FROM stepped GROUP BY {PAIR})""",
    f"{PAIR}, upward_steps, bucket_observations", "mono", "top_mean bottom_mean spread monotonicity"))
def _(spark, d):
    pooled = ev.pooled_stats(bucketed_pairs(spark, d), keys=BY_BUCKET)
    return ev.quantile_monotonicity(pooled, keys=pp.PAIR_KEYS)


@query("tail_analysis", final(
    f"""{RANKED}, fr AS (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS tail_fraction),
    members AS (SELECT {PAIR}, tail_fraction, outcome, 'TOP' AS side FROM paired CROSS JOIN fr WHERE rank > count - ceil(count * tail_fraction)
      UNION ALL SELECT {PAIR}, tail_fraction, outcome, 'BOTTOM' FROM paired CROSS JOIN fr WHERE rank <= ceil(count * tail_fraction)),
    st AS (SELECT {PAIR}, tail_fraction, side, count(*) AS observation_count, avg(outcome) AS mean_outcome,
      100.0 * count(CASE WHEN outcome > 0 THEN 1 END) / count(*) AS positive_pct, median(outcome) AS median_outcome
      FROM members GROUP BY ALL),
    tails AS (SELECT * FROM st UNION ALL SELECT {PAIR}, tail_fraction, 'TOP-BOTTOM', NULL,
      max(CASE WHEN side = 'TOP' THEN mean_outcome END) - max(CASE WHEN side = 'BOTTOM' THEN mean_outcome END), NULL, NULL
      FROM st GROUP BY ALL)""",
    f"{PAIR}, side, observation_count", "tails", "tail_fraction mean_outcome positive_pct median_outcome"))
def _(spark, d):
    return ev.tail_analysis(pp.paired(spark, d), (0.05, 0.10, 0.20), keys=pp.PAIR_KEYS)


TAIL_SQL = """SELECT formation, future, session,
  avg(CASE WHEN rank > count - ceil(count * 0.2) THEN outcome END) AS top_tail20_mean,
  avg(CASE WHEN rank <= ceil(count * 0.2) THEN outcome END) AS bottom_tail20_mean,
  avg(CASE WHEN count >= 6 AND rank > count - 3 THEN outcome END) AS top_fixed3_mean,
  avg(CASE WHEN count >= 6 AND rank <= 3 THEN outcome END) AS bottom_fixed3_mean FROM paired GROUP BY ALL"""
QCOLS = [f"q{i}_{x}" for i in range(1, 11) for x in ("sum", "count")]


@query("bucket_spread_daily", final(
    f"""{DAILY}, tl AS ({TAIL_SQL}), bs AS (SELECT *, top_tail20_mean - bottom_tail20_mean AS tail20_spread,
      top_fixed3_mean - bottom_fixed3_mean AS fixed3_spread FROM sums JOIN tl USING ({PAIR}, session)),
    bs2 AS (SELECT *, {s.spread(10)} AS spread FROM bs)""",
    f"{PAIR}, session, " + ", ".join(c for c in QCOLS if c.endswith("count")), "bs2",
    " ".join(c for c in QCOLS if c.endswith("sum"))
    + " top_tail20_mean bottom_tail20_mean top_fixed3_mean bottom_fixed3_mean spread tail20_spread fixed3_spread"))
def _(spark, d):
    pairs = pp.paired(spark, d).withColumn("bucket", quantile_bucket("rank", "count", 10, 10))
    tails = {**ev.tail_columns((0.2,)), **ev.fixed_tail_columns(3, 6)}
    return ev.bucket_spread_daily(pairs, 10, keys=pp.KEYS, tails=tails)


def summary_sql(source: str, by: str, name: str = "summ", q: int = 0, **kw) -> str:
    return f"{name} AS (SELECT {by}, {s.summary_cols(q, **kw)} FROM {source} GROUP BY ALL)"


COUNTS = "valid_dates, observation_count"


@query("ic_summary_pooled", final(
    f"{DAILY}, {summary_sql('daily', PAIR, q=10)}, full_summ AS (SELECT *, {s.monotonicity(10)} AS monotonicity FROM summ)",
    f"{PAIR}, {COUNTS}", "full_summ", s.SUMMARY_DOUBLES + " pooled_spread monotonicity"))
def _(spark, d):
    return ev.summarize_daily(pp.daily(spark, d), keys=pp.PAIR_KEYS, q=10)


@query("ic_summary_nulls_dropped", final(
    f"{DAILY}, {summary_sql('daily', PAIR, null_in_denominator=False)}", f"{PAIR}, {COUNTS}", "summ", s.SUMMARY_DOUBLES))
def _(spark, d):
    return ev.summarize_daily(pp.daily(spark, d), keys=pp.PAIR_KEYS, null_in_denominator=False)


YEARS = (1996, 1997, 1998, 1999, 2000, 2001, 2002)


@query("yearly_analysis", final(
    f"""{DAILY}, {summary_sql('daily', f'{PAIR}, year(session) AS year')},
    grid AS (SELECT * FROM (SELECT DISTINCT {PAIR} FROM daily) CROSS JOIN (SELECT unnest({list(YEARS)}) AS year)),
    yr AS (SELECT * REPLACE (coalesce(valid_dates, 0) AS valid_dates, coalesce(observation_count, 0) AS observation_count)
      FROM grid LEFT JOIN summ USING ({PAIR}, year))""",
    f"{PAIR}, year, {COUNTS}", "yr", s.SUMMARY_DOUBLES))
def _(spark, d):
    return ch.yearly_analysis(pp.daily(spark, d), YEARS, keys=pp.PAIR_KEYS)


EXP_YEARS = (1998, 1999, 2000)
EXP_MEASURES = [*s.SUMMARY_DOUBLES.split()]


@query("expanding_window", final(
    f"""{DAILY}, tagged AS (SELECT *, CASE WHEN year(session) < evaluation_year THEN 'history' WHEN year(session) = evaluation_year THEN 'evaluation' END AS part
      FROM daily CROSS JOIN (SELECT unnest({list(EXP_YEARS)}) AS evaluation_year)),
    {summary_sql('tagged WHERE part IS NOT NULL', f'{PAIR}, evaluation_year, part')},
    ex AS (SELECT {PAIR}, evaluation_year, """ + ", ".join(
        f"max(CASE WHEN part = '{p}' THEN {m} END) AS {p}_{m}" for p in ("history", "evaluation")
        for m in [*EXP_MEASURES, "valid_dates", "observation_count"]) + " FROM summ GROUP BY ALL)",
    f"{PAIR}, evaluation_year, " + ", ".join(f"{p}_{m}" for p in ("history", "evaluation") for m in ("valid_dates", "observation_count")),
    "ex", " ".join(f"{p}_{m}" for p in ("history", "evaluation") for m in EXP_MEASURES)))
def _(spark, d):
    return ch.expanding_window(pp.daily(spark, d), EXP_YEARS, keys=pp.PAIR_KEYS)


PERIODS = [("DEVELOPMENT", "1995-01-01", "1998-12-31"), ("VALIDATION", "1999-01-01", "2000-06-30"),
           ("HOLDOUT", "2000-07-01", "2001-12-31")]
PERIOD_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + ") p(period, a, b)"


@query("fixed_periods", final(
    f"""{DAILY}, inside AS (SELECT * FROM daily JOIN {PERIOD_SQL} ON session BETWEEN a AND b),
    bnd AS (SELECT {PAIR}, period, min(session) AS first_session, max(session) AS last_session FROM inside GROUP BY ALL),
    {summary_sql('inside', f'{PAIR}, period')}""",
    f"{PAIR}, period, first_session, last_session, {COUNTS}", f"summ JOIN bnd USING ({PAIR}, period)", s.SUMMARY_DOUBLES))
def _(spark, d):
    return ch.fixed_periods(pp.daily(spark, d), PERIODS, keys=pp.PAIR_KEYS)


@query("leave_one_year_out", final(
    f"""{DAILY}, tagged AS (SELECT * FROM daily CROSS JOIN (SELECT unnest({list(YEARS)}) AS omitted_year) WHERE year(session) <> omitted_year),
    {summary_sql('tagged', f'{PAIR}, omitted_year')}""", f"{PAIR}, omitted_year, {COUNTS}", "summ", s.SUMMARY_DOUBLES))
def _(spark, d):
    return ch.leave_one_year_out(pp.daily(spark, d), YEARS, keys=pp.PAIR_KEYS)


@query("nonoverlap_offsets", final(
    f"""{DAILY}, tagged AS (SELECT *, position % future AS "offset" FROM daily),
    gaps AS (SELECT {PAIR}, "offset", min(g) AS minimum_spacing FROM (SELECT *, position - lag(position) OVER
      (PARTITION BY {PAIR}, "offset" ORDER BY position) AS g FROM tagged) GROUP BY ALL),
    {summary_sql('tagged', f'{PAIR}, "offset"')},
    non AS (SELECT *, coalesce(minimum_spacing >= future, TRUE) AS spacing_valid, avg(mean_ic) OVER w AS offset_mean_ic,
      min(mean_ic) OVER w AS offset_min_ic, max(mean_ic) OVER w AS offset_max_ic,
      count(CASE WHEN mean_ic > 0 THEN 1 END) OVER w / CAST(count(*) OVER w AS DOUBLE) AS offset_positive_fraction
      FROM summ JOIN gaps USING ({PAIR}, "offset") WINDOW w AS (PARTITION BY {PAIR}))""",
    f'{PAIR}, "offset", minimum_spacing, spacing_valid, {COUNTS}', "non",
    s.SUMMARY_DOUBLES + " offset_mean_ic offset_min_ic offset_max_ic offset_positive_fraction"))
def _(spark, d):
    return ch.nonoverlap_offsets(pp.daily(spark, d), keys=pp.PAIR_KEYS)


def _stability(m):
    return f"""count(CASE WHEN {m} > 0 THEN 1 END) AS {m}_positive_years, count(CASE WHEN {m} < 0 THEN 1 END) AS {m}_negative_years,
      count(CASE WHEN {m} > 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS {m}_positive_fraction, median({m}) AS {m}_median_year,
      stddev_samp({m}) AS {m}_year_std, arg_max(year, {m}) AS {m}_best_year, arg_min(year, {m}) AS {m}_worst_year,
      max({m}) AS {m}_best, min({m}) AS {m}_worst"""


@query("year_stability", final(
    f"""{DAILY}, {summary_sql('daily', f'{PAIR}, year(session) AS year')},
    stab AS (SELECT {PAIR}, count(*) AS years_available, {_stability('mean_ic')}, {_stability('mean_spread')}
      FROM summ WHERE mean_ic IS NOT NULL GROUP BY ALL)""",
    f"{PAIR}, years_available, " + ", ".join(
        f"{m}_{x}" for m in ("mean_ic", "mean_spread") for x in ("positive_years", "negative_years", "best_year", "worst_year")),
    "stab", " ".join(f"{m}_{x}" for m in ("mean_ic", "mean_spread")
                     for x in ("positive_fraction", "median_year", "year_std", "best", "worst"))))
def _(spark, d):
    return ch.year_stability(ch.yearly_analysis(pp.daily(spark, d), keys=pp.PAIR_KEYS), keys=pp.PAIR_KEYS)


@query("cross_section_sensitivity", final(
    f"""{DAILY}, tagged AS (SELECT * FROM daily CROSS JOIN (SELECT unnest([0, 50, 80, 90]) AS minimum_cross_section)
      WHERE minimum_cross_section = 0 OR cross_section_count >= minimum_cross_section),
    {summary_sql('tagged', f'{PAIR}, minimum_cross_section')}, {summary_sql('daily', PAIR, 'base')},
    sens AS (SELECT summ.*, base.valid_dates - summ.valid_dates AS removed_dates, summ.mean_ic - base.mean_ic AS mean_ic_change,
      summ.mean_spread - base.mean_spread AS mean_spread_change FROM summ JOIN base USING ({PAIR}))""",
    f"{PAIR}, minimum_cross_section, removed_dates, {COUNTS}", "sens", s.SUMMARY_DOUBLES + " mean_ic_change mean_spread_change"))
def _(spark, d):
    return ch.cross_section_sensitivity(pp.daily(spark, d), (0, 50, 80, 90), keys=pp.PAIR_KEYS)


LODO = f"""lodo0 AS (SELECT {PAIR}, session AS excluded_session, avg(ic) OVER w AS baseline_mean,
    (sum(ic) OVER w - coalesce(ic, 0)) / nullif(count(ic) OVER w - CAST(ic IS NOT NULL AS INT), 0) AS left_out_mean
    FROM daily WINDOW w AS (PARTITION BY {PAIR})),
lodo AS (SELECT *, left_out_mean - baseline_mean AS change, coalesce(sign(left_out_mean) <> sign(baseline_mean), TRUE) AS sign_flip FROM lodo0)"""


@query("leave_one_date_out", final(
    f"{DAILY}, {LODO}", f"{PAIR}, excluded_session, sign_flip", "lodo", "baseline_mean left_out_mean change"))
def _(spark, d):
    return ch.leave_one_date_out(pp.daily(spark, d), keys=pp.PAIR_KEYS)


@query("orientation_flip", final(
    f"""{DAILY}, {summary_sql('daily', PAIR)}, flip AS (SELECT {PAIR}, valid_dates, observation_count, ic_std, mean_over_std_ic, naive_t_stat,
      -mean_ic AS mean_ic, -median_ic AS median_ic, -mean_spread AS mean_spread, ic_negative_pct AS ic_positive_pct,
      ic_positive_pct AS ic_negative_pct FROM summ)""", f"{PAIR}, {COUNTS}", "flip", s.SUMMARY_DOUBLES))
def _(spark, d):
    return ch.orientation_flip(ev.summarize_daily(pp.daily(spark, d), keys=pp.PAIR_KEYS))


@query("label_summary_by_horizon", final(
    f"""{DAILY}, {summary_sql('daily', PAIR)}, agg AS (SELECT formation, bool_and(mean_ic > 0) AS pos, bool_and(mean_ic < 0) AS neg,
      min_by(mean_ic, future) AS first_ic, max_by(mean_ic, future) AS last_ic FROM summ GROUP BY 1)""",
    """formation, CASE WHEN pos THEN CASE WHEN last_ic >= first_ic * 0.75 THEN 'APPEARS_OR_PERSISTS' ELSE 'DECAYS' END
       WHEN neg THEN 'REVERSES' ELSE 'MIXED_OR_UNSTABLE' END AS decay_label""".replace("\n", " "), "agg", "first_ic last_ic"))
def _(spark, d):
    return cl.decay_by_level(ev.summarize_daily(pp.daily(spark, d), keys=pp.PAIR_KEYS), keys=["formation"])


@query("label_summary_by_direction", final(
    f"""{DAILY}, {summary_sql('daily', PAIR)}, agg AS (SELECT formation, bool_and(mean_ic > 0) AS pos, bool_and(mean_ic < 0) AS neg,
      min_by(mean_ic, future) AS first_ic, max_by(mean_ic, future) AS last_ic FROM summ GROUP BY 1)""",
    """formation, CASE WHEN pos THEN CASE WHEN last_ic > first_ic THEN 'STRENGTHENS' ELSE 'DECAYS_OR_PLATEAUS' END
       WHEN neg THEN CASE WHEN abs(last_ic) > abs(first_ic) THEN 'REVERSAL_STRENGTHENS' ELSE 'REVERSAL_DECAYS_OR_PLATEAUS' END
       ELSE 'MIXED' END AS decay_label""".replace("\n", " "), "agg", "first_ic last_ic"))
def _(spark, d):
    return cl.decay_by_direction(ev.summarize_daily(pp.daily(spark, d), keys=pp.PAIR_KEYS), keys=["formation"])


CELL_SQL = f"""tagged AS (SELECT *, size FROM daily CROSS JOIN (SELECT unnest([0, 80, 90]) AS size) WHERE cross_section_count >= size),
{summary_sql('tagged', f'{PAIR}, size')},
cmp AS (SELECT c.*, c.mean_ic - b.mean_ic AS mean_ic_change, c.mean_spread - b.mean_spread AS mean_spread_change,
  sign(c.mean_ic) = sign(b.mean_ic) AS sign_preserved FROM summ c JOIN (SELECT * FROM summ WHERE size = 0) b USING ({PAIR}))"""


@query("sensitivity_compare", final(
    f"{DAILY}, {CELL_SQL}", f"{PAIR}, size, sign_preserved, {COUNTS}", "cmp",
    s.SUMMARY_DOUBLES + " mean_ic_change mean_spread_change"))
def _(spark, d):
    from stratapanel.runtime import explode_literals

    tagged = explode_literals(pp.daily(spark, d), [(0,), (80,), (90,)], [("size", "int")])
    cells = ev.summarize_daily(tagged.where(F.col("cross_section_count") >= F.col("size")), keys=[*pp.PAIR_KEYS, "size"])
    return ch.sensitivity_compare(cells, {"size": 0}, keys=pp.PAIR_KEYS, measures=("mean_ic", "mean_spread"))


@query("cross_section_size", final(
    f"""{RANKED}, sizes AS (SELECT DISTINCT formation, session, count FROM ranked),
    dist AS (SELECT formation, count(*) AS dates, min(count) AS minimum, max(count) AS maximum, quantile_cont(count, 0.05) AS p05,
      median(count) AS median, avg(count) AS mean, quantile_cont(count, 0.95) AS p95,
      count(CASE WHEN count >= 80 THEN 1 END) AS dates_feasible, 100.0 * count(CASE WHEN count >= 80 THEN 1 END) / count(*) AS feasible_pct
      FROM sizes GROUP BY 1)""",
    "formation, dates, minimum, maximum, dates_feasible", "dist", "p05 median mean p95 feasible_pct"))
def _(spark, d):
    from stratapanel.operators.profile import cross_section_size

    return cross_section_size(pp.rank_signals(pp.intervals(spark, d)), feasible=80)
