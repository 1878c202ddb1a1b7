"""Queries: influence, residuals, bootstrap, multiple testing, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import chronology as ch
from stratapanel.operators import classify as cl
from stratapanel.operators import evidence as ev
from stratapanel.operators import inference as inf
from stratapanel.operators import influence as il
from stratapanel.operators.ranks import cross_sectional_rank
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans import views
from stratapanel.plans.q_core import DAILY, M, RANKED
from stratapanel.plans.q_evidence import COUNTS, PAIR, summary_sql
from stratapanel.plans.registry import final, query
from stratapanel.runtime import stage

SMALL = RANKED
KEY = f"{PAIR}, session"


def all_pairs(spark, d):
    return stage(pp.paired(spark, d))


# Brute force: every group is ranked again without each of its members.
DELETED = f"""gone AS (SELECT a.formation, a.future, a.session, a.entity AS dropped, b.entity, b.rank AS x, b.outcome AS o FROM paired a
  JOIN paired b ON a.formation = b.formation AND a.future = b.future AND a.session = b.session AND a.entity <> b.entity),
gr AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, dropped ORDER BY x) AS rx, count(*) OVER (PARTITION BY {KEY}, dropped) AS m,
  rank() OVER (PARTITION BY {KEY}, dropped ORDER BY o) + (count(*) OVER (PARTITION BY {KEY}, dropped, o) - 1) / 2.0 AS ry FROM gone),
del AS (SELECT {KEY}, dropped AS entity, max(m) + 1 AS observations, CASE WHEN max(m) >= 2 THEN corr(rx, ry) END AS ic_without,
  CASE WHEN max(m) >= 10 THEN avg(CASE WHEN ((rx - 1) * 10) // m = 9 THEN o END) - avg(CASE WHEN ((rx - 1) * 10) // m = 0 THEN o END) END AS spread_without
  FROM gr GROUP BY {KEY}, dropped)"""


@query("leave_one_entity_out_daily", final(f"{SMALL}, {DELETED}", f"{KEY}, entity, observations", "del", "ic_without spread_without"))
def _(spark, d):
    return il.deletion_statistics(all_pairs(spark, d), keys=pp.KEYS)


RERANKED_DAILY = f"""{s.spearman('paired', KEY, 'rank', 'outcome', 'ics')},
rr AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY rank) AS r, count(*) OVER (PARTITION BY {KEY}) AS m FROM paired),
sp AS (SELECT {KEY}, CASE WHEN max(m) >= 10 THEN avg(CASE WHEN ((r - 1) * 10) // m = 9 THEN outcome END) - avg(CASE WHEN ((r - 1) * 10) // m = 0 THEN outcome END) END AS spread
  FROM rr GROUP BY {KEY}),
bd AS (SELECT * FROM ics JOIN sp USING ({KEY}))"""


@query("leave_one_entity_out", final(
    f"""{SMALL}, {DELETED}, {RERANKED_DAILY},
    per AS (SELECT formation, future, e.entity, avg(bd.ic) AS baseline_mean_ic, avg(bd.spread) AS baseline_mean_spread,
      avg(CASE WHEN del.entity IS NULL THEN bd.ic ELSE ic_without END) AS excluded_mean_ic,
      avg(CASE WHEN del.entity IS NULL THEN bd.spread ELSE spread_without END) AS excluded_mean_spread, count(del.entity) AS present_dates
      FROM bd CROSS JOIN (SELECT DISTINCT entity FROM paired) e LEFT JOIN del USING (formation, future, session, entity) GROUP BY ALL),
    loo AS (SELECT *, excluded_mean_ic - baseline_mean_ic AS mean_ic_change, excluded_mean_spread - baseline_mean_spread AS mean_spread_change
      FROM per WHERE present_dates > 0)""",
    f"{PAIR}, entity, present_dates", "loo",
    "baseline_mean_ic excluded_mean_ic mean_ic_change baseline_mean_spread excluded_mean_spread mean_spread_change"))
def _(spark, d):
    return il.leave_one_entity_out(all_pairs(spark, d), pair=pp.PAIR_KEYS)


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _regrouped(by: str, source: str) -> str:
    """Daily statistics re-ranked within (pair, by, session)."""
    keys = f"{PAIR}, {by}, session"
    return f"""{s.spearman(source, keys, 'rank', 'outcome', 'gics')},
gb0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rank) AS r, count(*) OVER (PARTITION BY {keys}) AS m FROM {source}),
gb AS (SELECT *, CASE WHEN m >= 10 THEN ((r - 1) * 10) // m + 1 END AS bucket FROM gb0),
gs AS (SELECT {keys}, {s.buckets(10)} FROM gb GROUP BY {keys}),
gd AS (SELECT *, {s.spread(10)} AS spread FROM gics JOIN gs USING ({keys}))"""


@query("leave_one_group_out", final(
    f"""{SMALL}, {s.REGION}, tagged AS (SELECT paired.*, group_name, excluded_group FROM paired LEFT JOIN regions USING (entity)
      CROSS JOIN (SELECT unnest({REGIONS}) AS excluded_group) WHERE group_name IS NULL OR group_name <> excluded_group),
    {_regrouped('excluded_group', 'tagged')}, {summary_sql('gd', f'{PAIR}, excluded_group')},
    {RERANKED_DAILY}, base AS (SELECT {PAIR}, avg(ic) AS bi, avg(spread) AS bs FROM bd GROUP BY ALL),
    lg AS (SELECT summ.*, bi AS baseline_mean_ic, bs AS baseline_mean_spread, mean_ic - bi AS mean_ic_change, mean_spread - bs AS mean_spread_change
      FROM summ JOIN base USING ({PAIR}))""",
    f"{PAIR}, excluded_group, {COUNTS}", "lg",
    s.SUMMARY_DOUBLES + " baseline_mean_ic baseline_mean_spread mean_ic_change mean_spread_change"))
def _(spark, d):
    pairs = stage(all_pairs(spark, d).join(views.groups_region(spark, d), "entity", "left"))
    cells = il.leave_one_group_out(pairs, REGIONS, pair=pp.PAIR_KEYS)
    alone = pairs.withColumn("group_name", F.lit("in"))
    baseline = il.leave_one_group_out(alone, ["out"], pair=pp.PAIR_KEYS)
    return il.against_baseline(cells, baseline, pair=pp.PAIR_KEYS)


BANDS = "shares AS (" + " UNION ALL ".join(
    f"SELECT entity, {h} AS formation, 100.0 * count(CASE WHEN valid_factor_primary_{h} THEN 1 END) / count(*) AS retained_pct FROM pit GROUP BY 1" for h in pp.FORMATIONS) + """),
edges AS (SELECT formation, quantile_cont(retained_pct, 0.25) AS lo, quantile_cont(retained_pct, 0.75) AS hi FROM shares GROUP BY 1),
bands AS (SELECT entity, formation, retained_pct, CASE WHEN retained_pct <= lo THEN 'LOW' WHEN retained_pct < hi THEN 'MIDDLE' ELSE 'HIGH' END AS band FROM shares JOIN edges USING (formation))"""


@query("coverage_band_sensitivity", final(
    f"""{SMALL}, {BANDS}, tagged AS (SELECT paired.*, band FROM paired JOIN bands USING (entity, formation)),
    {_regrouped('band', 'tagged')}, {summary_sql('gd', f'{PAIR}, band')}""", f"{PAIR}, band, {COUNTS}", "summ", s.SUMMARY_DOUBLES))
def _(spark, d):
    panel = stage(pp.intervals(spark, d))
    bands = il.coverage_bands(panel, pp.FORMATIONS, valid="valid_factor_primary_{}")
    pairs = ev.with_outcomes(pp.rank_signals(panel))
    return il.coverage_band_sensitivity(pairs, bands, pair=pp.PAIR_KEYS)


# Interaction of two ranks, ranked, against the two ranks themselves.
RESID = f"""inter AS (SELECT a.entity, a.session, a.position, a.pct AS p5, b.pct AS p20, a.factor * b.factor AS f FROM ranked a
    JOIN ranked b ON a.entity = b.entity AND a.session = b.session AND b.formation = 20 WHERE a.formation = 5),
ip AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY session) > 1 THEN (row_number() OVER (PARTITION BY session ORDER BY f, entity) - 1)
    / CAST(count(*) OVER (PARTITION BY session) - 1 AS DOUBLE) ELSE 0.5 END AS y FROM inter),
mo AS (SELECT session, avg(y) AS my, avg(p5) AS ma, avg(p20) AS mb, covar_pop(p5, p5) AS aa, covar_pop(p20, p20) AS bb, covar_pop(p5, p20) AS ab,
    covar_pop(p5, y) AS ay, covar_pop(p20, y) AS by_ FROM ip GROUP BY 1),
co AS (SELECT *, (ay * bb - by_ * ab) / nullif(aa * bb - ab * ab, 0) AS ka, (by_ * aa - ay * ab) / nullif(aa * bb - ab * ab, 0) AS kb FROM mo),
resid AS (SELECT entity, session, position, y, (y - my) - ka * (p5 - ma) - kb * (p20 - mb) AS residual FROM ip JOIN co USING (session))"""


def interaction(spark, d, futures=pp.FUTURES):
    panel = stage(pp.intervals(spark, d, (5, 20), futures))
    ranked = stage(pp.rank_signals(panel, (5, 20), futures))
    a = ranked.where("formation = 5").select("entity", "session", "position", F.col("pct").alias("p5"), F.col("factor").alias("f5"), "outcomes")
    b = ranked.where("formation = 20").select("entity", "session", F.col("pct").alias("p20"), F.col("factor").alias("f20"))
    both = a.join(b, ["entity", "session"]).withColumn("f", F.col("f5") * F.col("f20"))
    both = cross_sectional_rank(both, "f", keys=["session"], pct="y")
    return il.residualize_same_date(both, "y", "p5", "p20")


@query("residualize_same_date", final(f"{M}, {s.pit_windows((5, 20), pp.FUTURES)}, {s.ranked((5, 20), pp.FUTURES)}, {RESID}",
                                      "entity, session", "resid", "y residual"))
def _(spark, d):
    return interaction(spark, d).select("entity", "session", "y", "residual")


# The residual is rounded before it is ranked, so noise in its last digits makes no order.
INC = f"""ro AS (SELECT r.session, r.position, round(residual, 9) AS residual, f.future, f.outcome FROM resid r JOIN paired f ON f.entity = r.entity
    AND f.session = r.session AND f.formation = 5),
{s.spearman('ro', 'future, session', 'residual', 'outcome', 'inc')}"""


@query("incremental_ic", final(
    f"""{M}, {s.pit_windows((5, 20), pp.FUTURES)}, {s.ranked((5, 20), pp.FUTURES)}, {RESID}, {INC},
    yr AS (SELECT future, year(session) AS y, avg(ic) AS m FROM inc GROUP BY 1, 2),
    yf AS (SELECT future, count(CASE WHEN m > 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS positive_year_fraction FROM yr GROUP BY 1),
    ii AS (SELECT future, avg(ic) AS mean_ic, median(ic) AS median_ic, 100.0 * count(CASE WHEN ic > 0 THEN 1 END) / count(*) AS ic_positive_pct,
      count(ic) AS valid_dates, CAST(sum(observations) AS BIGINT) AS observation_count, avg(CASE WHEN session >= DATE '2000-07-01' THEN ic END) AS holdout_mean_ic
      FROM inc GROUP BY 1)""",
    f"future, {COUNTS}", "ii JOIN yf USING (future)", "mean_ic median_ic ic_positive_pct holdout_mean_ic positive_year_fraction"))
def _(spark, d):
    res = interaction(spark, d).withColumn("residual", F.round("residual", 9))
    rows = ev.with_outcomes(res.select("entity", "session", "residual", "outcomes"))
    daily = stage(ev.rank_ic_daily(rows, keys=["future", "session"], factor="residual"))
    yearly = daily.groupBy("future", F.year("session").alias("y")).agg(F.avg("ic").alias("m"))
    frac = yearly.groupBy("future").agg((F.count_if(F.col("m") > 0) / F.count(F.lit(1))).alias("positive_year_fraction"))
    held = F.avg(F.when(F.col("session") >= F.lit("2000-07-01").cast("date"), F.col("ic"))).alias("holdout_mean_ic")
    out = daily.groupBy("future").agg(
        F.avg("ic").alias("mean_ic"), F.percentile("ic", F.lit(0.5)).alias("median_ic"),
        (100 * F.count_if(F.col("ic") > 0) / F.count(F.lit(1))).alias("ic_positive_pct"),
        F.count("ic").alias("valid_dates"), F.sum("observations").alias("observation_count"), held)
    return out.join(frac, "future")


REPS = 2000
GRID_DAILY = f"{M}, {s.pit_windows(*pp.GRID)}, {s.ranked(*pp.GRID)}, {s.daily(10, 10)}"
STAT = f"{PAIR}, statistic"
BOOT = f"""vals AS (SELECT {STAT}, idx, v, row_number() OVER (PARTITION BY {STAT} ORDER BY session) - 1 AS i, count(*) OVER (PARTITION BY {STAT}) AS n
    FROM (SELECT {PAIR}, session, 'MEAN_IC' AS statistic, 0 AS idx, ic AS v FROM daily UNION ALL SELECT {PAIR}, session, 'MEAN_SPREAD', 1, spread FROM daily) WHERE v IS NOT NULL),
ser AS (SELECT {STAT}, max(n) AS n, avg(v) AS estimate, least(greatest(10, 2 * future), max(n)) AS len, CAST(formation * 1000 + future * 10 + 17 + max(idx) AS BIGINT) AS seed FROM vals GROUP BY formation, future, statistic),
dr AS (SELECT *, CAST(((rep * 7919 + block * 104729 + seed) % 4294967296) AS BIGINT) AS x0 FROM (SELECT *, unnest(range(CAST(ceil(n / CAST(len AS DOUBLE)) AS BIGINT))) AS block
    FROM (SELECT *, unnest(range({REPS})) AS rep FROM ser))),
h1 AS (SELECT *, (xor(x0, x0 >> 16) * 73244475) % 4294967296 AS x1 FROM dr), h2 AS (SELECT *, (xor(x1, x1 >> 16) * 73244475) % 4294967296 AS x2 FROM h1),
st AS (SELECT *, xor(x2, x2 >> 16) % n AS start FROM h2),
off AS (SELECT *, unnest(range(CAST(least(len, n - block * len) AS BIGINT))) AS k FROM st),
ms AS (SELECT {STAT}, rep, avg(v) AS m, max(estimate) AS estimate FROM (SELECT off.*, vals.v FROM off JOIN vals ON vals.formation = off.formation AND vals.future = off.future
    AND vals.statistic = off.statistic AND vals.i = (off.start + off.k) % off.n) GROUP BY ALL),
boot AS (SELECT {STAT}, max(estimate) AS estimate, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper,
    (count(CASE WHEN abs(m - estimate) >= abs(estimate) THEN 1 END) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value, count(*) AS replications FROM ms GROUP BY ALL),
bt AS (SELECT boot.*, ser.n AS valid_dates, ser.len AS block_length FROM boot JOIN ser USING ({STAT}))"""


def grid_daily(spark, d):
    """Daily statistics of all thirty pairs of look-back and outcome."""
    return pp.daily(spark, d, formations=pp.GRID[0], futures=pp.GRID[1])


def bootstrap(spark, d, daily=None):
    daily = daily if daily is not None else grid_daily(spark, d)
    return inf.bootstrap_statistics(
        daily, {"MEAN_IC": "ic", "MEAN_SPREAD": "spread"}, keys=pp.PAIR_KEYS, block=F.greatest(F.lit(10), 2 * F.col("future")), replications=REPS,
        seed=F.col("formation") * 1000 + F.col("future") * 10 + 17)


@query("block_bootstrap_ci", final(f"{GRID_DAILY}, {BOOT}", f"{STAT}, valid_dates, block_length, replications", "bt", "estimate ci_lower ci_upper"))
def _(spark, d):
    return bootstrap(spark, d).drop("p_value")


@query("block_bootstrap_pvalue", final(f"{GRID_DAILY}, {BOOT}", STAT, "bt", "estimate p_value"))
def _(spark, d):
    return bootstrap(spark, d).select(*pp.PAIR_KEYS, "statistic", "estimate", "p_value")


TESTS = f"""{BOOT}, kk AS (SELECT *, count(*) OVER (PARTITION BY statistic) AS n, row_number() OVER (PARTITION BY statistic ORDER BY p_value, formation, future) AS k FROM bt),
mt AS (SELECT {STAT}, estimate, p_value, least(1.0, min(p_value * n / k) OVER (PARTITION BY statistic ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh_p_value,
  least(1.0, max(p_value * (n - k + 1)) OVER (PARTITION BY statistic ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm_p_value FROM kk),
mt2 AS (SELECT *, bh_p_value <= 0.05 AS bh_reject, holm_p_value <= 0.05 AS holm_reject,
  CASE WHEN estimate > 0 THEN 'POSITIVE' WHEN estimate < 0 THEN 'NEGATIVE' ELSE 'ZERO' END AS direction FROM mt)"""


@query("multiple_testing", final(f"{GRID_DAILY}, {TESTS}", f"{STAT}, bh_reject, holm_reject, direction", "mt2", "estimate p_value bh_p_value holm_p_value"))
def _(spark, d):
    # Two families of thirty tests.
    out = inf.multiple_testing(bootstrap(spark, d), family=["statistic"], tie=["formation", "future"])
    return out.select(*pp.PAIR_KEYS, "statistic", "bh_reject", "holm_reject", "direction", "estimate", "p_value", "bh_p_value", "holm_p_value")


EVIDENCE = f"""{BOOT}, fs AS (SELECT {PAIR}, avg(ic) AS m FROM daily GROUP BY ALL), hs AS (SELECT {PAIR}, avg(ic) AS m FROM daily WHERE session >= DATE '2000-07-01' GROUP BY ALL),
ys AS (SELECT {PAIR}, year(session) AS y, avg(ic) AS m FROM daily GROUP BY ALL HAVING avg(ic) IS NOT NULL),
yf AS (SELECT {PAIR}, count(CASE WHEN m > 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS f FROM ys GROUP BY ALL),
os AS (SELECT {PAIR}, avg(m) AS m FROM (SELECT {PAIR}, position % future AS o, avg(ic) AS m FROM daily GROUP BY ALL) GROUP BY ALL),
cells AS (SELECT {PAIR}, fs.m AS f, hs.m AS h, yf.f AS y, os.m AS o, ci_lower, ci_upper FROM fs LEFT JOIN hs USING ({PAIR}) LEFT JOIN yf USING ({PAIR}) LEFT JOIN os USING ({PAIR}) LEFT JOIN (SELECT * FROM bt WHERE statistic = 'MEAN_IC') USING ({PAIR})),
cn AS (SELECT formation, count(CASE WHEN f > 0 THEN 1 END) AS positive_full, count(CASE WHEN f < 0 THEN 1 END) AS negative_full, count(CASE WHEN h > 0 THEN 1 END) AS positive_holdout,
  count(CASE WHEN h < 0 THEN 1 END) AS negative_holdout, count(CASE WHEN y >= 0.5 THEN 1 END) AS positive_year_majority, count(CASE WHEN ci_lower > 0 THEN 1 END) AS positive_ci,
  count(CASE WHEN ci_upper < 0 THEN 1 END) AS negative_ci, count(CASE WHEN o > 0 THEN 1 END) AS positive_nonoverlap, count(CASE WHEN o < 0 THEN 1 END) AS negative_nonoverlap FROM cells GROUP BY 1)"""
COUNT_COLS = ("positive_full, negative_full, positive_holdout, negative_holdout, positive_year_majority, positive_ci, negative_ci, "
              "positive_nonoverlap, negative_nonoverlap")


@query("evidence_classify", f"""WITH {GRID_DAILY}, {EVIDENCE} SELECT formation, {COUNT_COLS},
  CASE WHEN positive_full >= 5 AND positive_holdout >= 5 AND positive_year_majority >= 5 AND positive_ci >= 4 THEN 'ROBUST'
   WHEN negative_full >= 5 AND negative_holdout >= 4 AND negative_nonoverlap >= 5 THEN 'REVERSAL-LIKE'
   WHEN positive_full >= 4 AND positive_holdout >= 4 THEN 'PROMISING BUT UNSTABLE'
   WHEN greatest(positive_full, negative_full, positive_holdout, negative_holdout) < 4 THEN 'NO EVIDENCE' ELSE 'INCONCLUSIVE' END AS classification,
  CASE WHEN positive_full >= 3 AND positive_holdout >= 3 AND positive_nonoverlap >= 3 AND positive_ci >= 2 THEN 'ROBUST'
   WHEN negative_full >= 3 AND negative_holdout >= 2 AND negative_nonoverlap >= 3 THEN 'REVERSAL-LIKE'
   WHEN positive_full >= 2 AND positive_holdout >= 2 AND positive_nonoverlap >= 2 THEN 'PROMISING BUT UNSTABLE'
   WHEN positive_full <= 1 AND positive_holdout <= 1 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS group_classification FROM cn""")
def _(spark, d):
    daily = stage(grid_daily(spark, d))
    summary = ev.summarize_daily(daily, keys=pp.PAIR_KEYS)
    holdout = ev.summarize_daily(daily.where(F.col("session") >= F.lit("2000-07-01").cast("date")), keys=pp.PAIR_KEYS)
    stability = ch.year_stability(ch.yearly_analysis(daily, keys=pp.PAIR_KEYS), keys=pp.PAIR_KEYS)
    counts = cl.evidence_counts(
        summary, holdout, stability, bootstrap(spark, d, daily).where("statistic = 'MEAN_IC'"), ch.nonoverlap_offsets(daily, keys=pp.PAIR_KEYS), keys=["formation"])
    out = cl.classify(counts, cl.formation_rules(), "INCONCLUSIVE")
    rules = cl.group_rules(
        {"positive_full": 3, "positive_holdout": 3, "positive_nonoverlap": 3, "positive_ci": 2},
        {"negative_full": 3, "negative_holdout": 2, "negative_nonoverlap": 3},
        {"positive_full": 2, "positive_holdout": 2, "positive_nonoverlap": 2})
    return cl.classify(out, rules, "INCONCLUSIVE", label="group_classification")


@query("panel_vs_panel_compare", final(
    f"""{DAILY}, f1 AS (SELECT entity FROM (SELECT s_suppkey AS entity, s_acctbal FROM supplier) WHERE s_acctbal >= 1000),
    sig2 AS (SELECT signals.* FROM signals JOIN f1 USING (entity)),
    rk2 AS (SELECT *, row_number() OVER (PARTITION BY formation, session ORDER BY factor, entity) AS rank, count(*) OVER (PARTITION BY formation, session) AS count FROM sig2),
    pr2 AS (""" + " UNION ALL ".join(f"SELECT entity, session, position, formation, rank, count, {f} AS future, o{f} AS outcome FROM rk2 WHERE o{f} IS NOT NULL" for f in pp.FUTURES)
    + f"""), {s.spearman('pr2', KEY, 'rank', 'outcome', 'ics2')},
    b2 AS (SELECT {KEY}, {s.buckets(10)} FROM (SELECT *, CASE WHEN count >= 10 THEN ((rank - 1) * 10) // count + 1 END AS bucket FROM pr2) GROUP BY {KEY}),
    d2 AS (SELECT *, {s.spread(10)} AS spread FROM ics2 JOIN b2 USING ({KEY})),
    l AS (SELECT {PAIR}, avg(ic) AS mean_ic, avg(spread) AS mean_spread, count(ic) AS valid_dates FROM daily GROUP BY ALL),
    r AS (SELECT {PAIR}, avg(ic) AS mean_ic, avg(spread) AS mean_spread, count(ic) AS valid_dates FROM d2 GROUP BY ALL),
    pv AS (SELECT {PAIR}, l.mean_ic AS left_mean_ic, r.mean_ic AS right_mean_ic, l.mean_ic - r.mean_ic AS mean_ic_change, l.mean_spread AS left_mean_spread,
      r.mean_spread AS right_mean_spread, l.mean_spread - r.mean_spread AS mean_spread_change, l.valid_dates AS left_valid_dates, r.valid_dates AS right_valid_dates,
      l.valid_dates - r.valid_dates AS valid_dates_change, sign(l.mean_ic) = sign(r.mean_ic) AS ic_sign_preserved FROM l JOIN r USING ({PAIR}))""",
    f"{PAIR}, left_valid_dates, right_valid_dates, valid_dates_change, ic_sign_preserved", "pv",
    "left_mean_ic right_mean_ic mean_ic_change left_mean_spread right_mean_spread mean_spread_change"))
def _(spark, d):
    from stratapanel.functions.scalars import quantile_bucket

    panel = stage(pp.intervals(spark, d))
    fixed = views.table(spark, d, "supplier").where("s_acctbal >= 1000").select(F.col("s_suppkey").alias("entity"))

    def run(p):
        pairs = ev.with_outcomes(pp.rank_signals(p)).withColumn("bucket", quantile_bucket("rank", "count", 10, 10))
        return ev.summarize_daily(ev.daily_statistics(pairs, 10, keys=pp.KEYS), keys=pp.PAIR_KEYS)

    return ch.panel_vs_panel(run(panel), run(panel.join(fixed, "entity", "left_semi")), keys=pp.PAIR_KEYS,
                             measures=("mean_ic", "mean_spread", "valid_dates"))


CLASS_SQL = """CASE WHEN date_band = 'LT20' THEN 'INSUFFICIENT SAMPLE' WHEN "primary" <= 1 THEN 'CONTRADICTORY' WHEN "primary" <= 3 THEN 'MIXED'
    WHEN NOT ("primary" >= 4 AND moderate >= 4 AND nonoverlap >= 4 AND basic_average_positive AND moderate_average_positive AND NOT date_sign_flip) THEN 'DIRECTIONALLY POSITIVE BUT UNSTABLE'
    WHEN date_band = '20_TO_59' THEN 'SUPPORTIVE BUT SHORT SAMPLE' ELSE 'SUPPORTED' END"""
STATES_SQL = f"""{GRID_DAILY}, per AS (SELECT formation, future, avg(ic) AS m, avg(spread) AS sp, avg(CASE WHEN session >= DATE '2000-07-01' THEN ic END) AS h, count(*) AS n FROM daily GROUP BY ALL),
agg AS (SELECT formation, count(CASE WHEN m > 0 THEN 1 END) AS "primary", count(CASE WHEN sp > 0 THEN 1 END) AS moderate, count(CASE WHEN h > 0 THEN 1 END) AS nonoverlap,
    avg(m) > 0 AS basic_average_positive, avg(sp) > 0 AS moderate_average_positive, sign(avg(m)) <> sign(avg(h)) AS date_sign_flip,
    CASE WHEN min(n) < 20 THEN 'LT20' WHEN min(n) < 60 THEN '20_TO_59' ELSE 'GE60' END AS date_band FROM per GROUP BY 1),
grid AS (SELECT * FROM (SELECT unnest(range(7)) AS "primary") CROSS JOIN (SELECT unnest(range(7)) AS moderate) CROSS JOIN (SELECT unnest(range(7)) AS nonoverlap)
    CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS basic_average_positive) CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS moderate_average_positive)
    CROSS JOIN (SELECT unnest([TRUE, FALSE]) AS date_sign_flip) CROSS JOIN (SELECT unnest(['LT20', '20_TO_59', 'GE60']) AS date_band))"""
STATE = ["primary", "moderate", "nonoverlap", "basic_average_positive", "moderate_average_positive", "date_sign_flip", "date_band"]


@query("decision_table_states", f"""WITH {STATES_SQL}, seen AS (SELECT * EXCLUDE (formation), count(*) AS formations FROM agg GROUP BY ALL)
SELECT grid.*, {CLASS_SQL} AS classification, coalesce(seen.formations, 0) AS formations FROM grid LEFT JOIN seen USING ({", ".join(f'"{c}"' for c in STATE)})""")
def _(spark, d):
    # Every state of the rule's inputs with its class, and how many look-backs of the grid are in it.
    hold = F.avg(F.when(F.col("session") >= F.lit("2000-07-01").cast("date"), F.col("ic")))
    per = grid_daily(spark, d).groupBy(*pp.PAIR_KEYS).agg(F.avg("ic").alias("m"), F.avg("spread").alias("sp"), hold.alias("h"), F.count(F.lit(1)).alias("n"))
    n = F.min("n")
    states = per.groupBy("formation").agg(
        F.count_if(F.col("m") > 0).alias("primary"), F.count_if(F.col("sp") > 0).alias("moderate"), F.count_if(F.col("h") > 0).alias("nonoverlap"),
        (F.avg("m") > 0).alias("basic_average_positive"), (F.avg("sp") > 0).alias("moderate_average_positive"),
        (F.signum(F.avg("m")) != F.signum(F.avg("h"))).alias("date_sign_flip"), F.when(n < 20, "LT20").when(n < 60, "20_TO_59").otherwise("GE60").alias("date_band"))
    seen = states.groupBy(*STATE).agg(F.count(F.lit(1)).alias("formations"))
    return cl.decision_table(spark).join(seen, STATE, "left").fillna({"formations": 0})


# States of the candidate rule met by the test pairs: one row per formation and outcome.
@query("decision_table_enumerate", f"""WITH {DAILY}, agg AS (SELECT {PAIR}, count(CASE WHEN ic > 0 THEN 1 END) % 7 AS "primary", count(CASE WHEN ic < 0 THEN 1 END) % 7 AS moderate,
    count(CASE WHEN spread > 0 THEN 1 END) % 7 AS nonoverlap, avg(ic) > 0 AS ba, avg(spread) > 0 AS ma, count(*) AS n FROM daily GROUP BY ALL),
  c AS (SELECT {PAIR}, CASE WHEN n < 20 THEN 'INSUFFICIENT SAMPLE' WHEN "primary" <= 1 THEN 'CONTRADICTORY' WHEN "primary" <= 3 THEN 'MIXED'
    WHEN NOT (moderate >= 4 AND nonoverlap >= 4 AND ba AND ma) THEN 'DIRECTIONALLY POSITIVE BUT UNSTABLE'
    WHEN n < 60 THEN 'SUPPORTIVE BUT SHORT SAMPLE' ELSE 'SUPPORTED' END AS classification FROM agg)
SELECT a.formation, a.future AS first_future, b.future AS second_future, a.classification AS first_class, b.classification AS second_class,
  CASE WHEN a.classification = 'SUPPORTED' AND b.classification = 'SUPPORTED' THEN 'PASS FOR COMPLEMENTARITY RESEARCH'
   WHEN a.classification = 'SUPPORTED' OR b.classification = 'SUPPORTED' OR (a.classification = 'SUPPORTIVE BUT SHORT SAMPLE' AND b.classification = 'SUPPORTIVE BUT SHORT SAMPLE') THEN 'CONDITIONAL PASS'
   WHEN a.classification = 'CONTRADICTORY' AND b.classification = 'CONTRADICTORY' THEN 'FAIL' ELSE 'RESEARCH FURTHER' END AS overall
FROM c a JOIN c b ON a.formation = b.formation AND a.future < b.future""")
def _(spark, d):
    daily = pp.daily(spark, d)
    n = F.count(F.lit(1))
    states = daily.groupBy(*pp.PAIR_KEYS).agg(
        (F.count_if(F.col("ic") > 0) % 7).alias("primary"), (F.count_if(F.col("ic") < 0) % 7).alias("moderate"),
        (F.count_if(F.col("spread") > 0) % 7).alias("nonoverlap"), (F.avg("ic") > 0).alias("basic_average_positive"),
        (F.avg("spread") > 0).alias("moderate_average_positive"), F.lit(False).alias("date_sign_flip"),
        F.when(n < 20, "LT20").when(n < 60, "20_TO_59").otherwise("GE60").alias("date_band"))
    # Look every state up in the enumerated table: a state that is missing would drop out.
    table = cl.decision_table(spark)
    keys = ["primary", "moderate", "nonoverlap", "basic_average_positive", "moderate_average_positive", "date_sign_flip", "date_band"]
    found = states.join(F.broadcast(table), keys).select(*pp.PAIR_KEYS, "classification")
    a = found.select("formation", F.col("future").alias("first_future"), F.col("classification").alias("first_class"))
    b = found.select("formation", F.col("future").alias("second_future"), F.col("classification").alias("second_class"))
    both = a.join(b, "formation").where("first_future < second_future")
    return both.withColumn("overall", cl.overall_class("first_class", "second_class"))
