"""Queries: group mapping and returns, coverage, distributions, profiles, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.functions.scalars import percent_true
from stratapanel.operators import classify as cl
from stratapanel.operators import groups as g
from stratapanel.operators import profile as pr
from stratapanel.operators import rolling as ro
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans import views
from stratapanel.plans.q_core import (
    COVERAGE, M, UNIVERSE_SQL, WK, _baseline_sql, _compound_sql, _price_sql, baseline_panel, crossed_panel, universe_panel,
)
from stratapanel.plans.registry import final, query

MEMBERS = """members AS (SELECT s_suppkey AS entity, n_name AS group_name, 'N' || n_nationkey AS group_code FROM supplier
    JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
  UNION ALL SELECT s_suppkey, r_name, 'R' || r_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 8000
  UNION ALL SELECT s_suppkey, n_name, 'N' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal BETWEEN 4000 AND 5000)"""
MAPPING = f"""{MEMBERS}, dm AS (SELECT DISTINCT * FROM members),
mm AS (SELECT entity, count(*) AS n, min(group_name) AS gn, min(group_code) AS gc, string_agg(group_name || ':' || group_code, '|' ORDER BY group_name || ':' || group_code) AS candidates
  FROM dm GROUP BY 1),
mapping AS (SELECT s_suppkey AS entity, CASE WHEN n = 1 THEN gn END AS group_name, CASE WHEN n = 1 THEN gc END AS group_code,
  coalesce(candidates, '') AS candidates, CASE WHEN n = 1 THEN 'UNIQUE' WHEN n IS NULL THEN 'UNMAPPED' ELSE 'CONFLICT' END AS mapping_status,
  s_acctbal BETWEEN 2000 AND 3000 AS identity_ambiguous FROM supplier LEFT JOIN mm ON entity = s_suppkey)"""


def members(spark, d):
    """Some suppliers are unmapped, some listed twice, some in two groups."""
    s_, n, r = (views.table(spark, d, t) for t in ("supplier", "nation", "region"))
    base = s_.join(n, s_.s_nationkey == n.n_nationkey)
    nation = lambda df: df.select(
        F.col("s_suppkey").alias("entity"), F.col("n_name").alias("group_name"), F.concat(F.lit("N"), "n_nationkey").alias("group_code"))
    region = base.where("s_acctbal > 8000").join(r, F.col("n_regionkey") == r.r_regionkey).select(
        F.col("s_suppkey").alias("entity"), F.col("r_name").alias("group_name"), F.concat(F.lit("R"), "r_regionkey").alias("group_code"))
    return nation(base.where("s_acctbal >= 0")).unionByName(region).unionByName(
        nation(base.where("s_acctbal BETWEEN 4000 AND 5000")))


def mapping(spark, d):
    ids = views.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("entity"), F.col("s_acctbal").between(2000, 3000).alias("identity_ambiguous"))
    return g.sector_mapping(ids, members(spark, d))


@query("sector_mapping", f"WITH {MAPPING} SELECT entity, group_name, group_code, candidates, mapping_status, identity_ambiguous FROM mapping")
def _(spark, d):
    return mapping(spark, d)


@query("mapping_summary", f"""WITH {MAPPING}, lines AS (SELECT group_code, entity, count(*) AS n FROM members GROUP BY 1, 2)
SELECT l.group_code, CAST(sum(n) AS BIGINT) AS source_rows, count(*) AS distinct_entities, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
  count(CASE WHEN mapping_status = 'UNIQUE' THEN 1 END) AS unique_entities,
  count(CASE WHEN mapping_status = 'UNIQUE' AND NOT identity_ambiguous THEN 1 END) AS stable_entities,
  count(CASE WHEN mapping_status = 'CONFLICT' THEN 1 END) AS conflict_entities
FROM lines l LEFT JOIN mapping m ON m.entity = l.entity GROUP BY 1""")
def _(spark, d):
    return g.mapping_summary(members(spark, d), mapping(spark, d))


@query("tier_membership", f"""WITH {M}, {UNIVERSE_SQL}, {MAPPING}
SELECT u.entity, session, universe_basic AND mapping_status = 'UNIQUE' AND NOT identity_ambiguous AS in_tier
FROM universe u LEFT JOIN mapping m ON m.entity = u.entity""")
def _(spark, d):
    out = g.tier_membership(universe_panel(spark, d), mapping(spark, d), "universe_basic", unique=True, stable=True)
    return out.select("entity", "session", "in_tier")


GROUP_RET = f"""{s.EVENTS}, {s.NATION}, gone0 AS (SELECT panel.*, lag(close) OVER w AS pc, lag(session) OVER w AS pd, lag(position) OVER w AS ppos,
    coalesce(lag(quality) OVER w, FALSE) AS pq, EXISTS (SELECT 1 FROM evp e WHERE e.entity = panel.entity AND e.position = panel.position) AS crossed
    FROM panel WINDOW w AS (PARTITION BY entity ORDER BY position)),
gone AS (SELECT *, coalesce(pc IS NOT NULL AND pq AND quality AND position - ppos = 1 AND NOT crossed
    AND pd >= DATE '{COVERAGE[0]}' AND session <= DATE '{COVERAGE[1]}', FALSE) AS valid_return, close / pc - 1 AS er FROM gone0),
gday AS (SELECT session, position, group_name, group_code, count(*) AS eligible_members, count(CASE WHEN valid_return THEN 1 END) AS valid_members,
    avg(CASE WHEN valid_return THEN er END) AS m FROM gone JOIN groups USING (entity) WHERE NOT identity_ambiguous GROUP BY ALL),
gret AS (SELECT *, eligible_members - valid_members AS invalid_members, valid_members >= 2 AS valid_group_return,
    CASE WHEN valid_members >= 2 THEN m END AS group_return,
    CASE WHEN valid_members >= 2 THEN '' ELSE 'INSUFFICIENT_VALID_MEMBERS' END AS group_invalid_reason FROM gday)"""


def group_returns(spark, d, unit="month"):
    from stratapanel.plans.q_core import one_session

    ret = one_session(spark, d, unit).join(views.groups_nation(spark, d), "entity").where("NOT identity_ambiguous")
    return g.sector_daily_return(ret, minimum=2)


@query("sector_daily_return", final(
    f"{M}, {GROUP_RET}", "session, group_name, group_code, eligible_members, valid_members, invalid_members, valid_group_return, group_invalid_reason",
    "gret", "group_return"))
def _(spark, d):
    return group_returns(spark, d).drop("position")


GROUP_COMP = f"{M}, {GROUP_RET}, {_compound_sql('gret', 'group_code', 'group_return', (3,), (1, 2), 'gcomp')}"


def group_panel(spark, d, formations=(3,), futures=(1, 2)):
    return ro.compound_return(group_returns(spark, d), formations, futures, key="group_code", value="group_return")


@query("group_compound_return", final(
    GROUP_COMP, "session, group_code, valid_ret_3, valid_future_ret_1, valid_future_ret_2", "gcomp", "ret_3 future_ret_1 future_ret_2"))
def _(spark, d):
    out = group_panel(spark, d)
    return out.select("session", "group_code", "valid_ret_3", "valid_future_ret_1", "valid_future_ret_2", "ret_3", "future_ret_1", "future_ret_2")


FLAGS = {"BROAD": "universe_broad", "BASIC": "universe_basic", "MODERATE": "universe_moderate"}
LONG_U = "lu AS (" + " UNION ALL ".join(
    f"SELECT u.*, '{n}' AS universe, year(session) AS year FROM universe u WHERE {c}" for n, c in FLAGS.items()) + ")"
MAPPED_U = f"{M}, {UNIVERSE_SQL}, {LONG_U}, {MAPPING}, mu AS (SELECT lu.*, group_code, mapping_status, identity_ambiguous FROM lu JOIN mapping USING (entity))"


def universe_rows(spark, d, keep=("entity", "session", "position", "close", "volume", "turnover")):
    return pr.by_universe(universe_panel(spark, d), FLAGS, keep=list(keep)).withColumn("year", F.year("session"))


def mapped_universe(spark, d):
    return universe_rows(spark, d, ("entity", "session")).join(mapping(spark, d), "entity")


@query("sector_coverage", f"""WITH {MAPPED_U}, per AS (SELECT universe, year, entity, count(*) AS r, min(mapping_status) AS st, bool_or(identity_ambiguous) AS amb,
    min(group_code) AS gc FROM mu GROUP BY 1, 2, 3),
cnt AS (SELECT universe, year, count(*) AS eligible_entities, CAST(sum(r) AS BIGINT) AS eligible_rows, count(CASE WHEN st = 'UNIQUE' THEN 1 END) AS unique_entities,
    count(CASE WHEN st = 'CONFLICT' THEN 1 END) AS conflict_entities, count(CASE WHEN st = 'UNMAPPED' THEN 1 END) AS unmapped_entities,
    count(CASE WHEN amb THEN 1 END) AS ambiguous_entities, count(CASE WHEN st = 'UNIQUE' AND NOT amb THEN 1 END) AS usable_entities,
    CAST(coalesce(sum(CASE WHEN st = 'UNIQUE' AND NOT amb THEN r END), 0) AS BIGINT) AS usable_rows FROM per GROUP BY 1, 2),
sz AS (SELECT universe, year, gc, count(*) AS n FROM per WHERE st = 'UNIQUE' AND NOT amb GROUP BY 1, 2, 3),
sh AS (SELECT universe, year, count(*) AS represented_groups, min(n) AS group_size_min, round(median(n), 6) AS group_size_median,
    round(avg(n), 6) AS group_size_mean, max(n) AS group_size_max FROM sz GROUP BY 1, 2)
SELECT *, round(100.0 * unique_entities / eligible_entities, 6) AS unique_pct, round(100.0 * usable_rows / eligible_rows, 6) AS usable_row_pct
FROM cnt LEFT JOIN sh USING (universe, year)""")
def _(spark, d):
    return g.sector_coverage(mapped_universe(spark, d))


SIZES = f"{MAPPED_U}, sizes AS (SELECT universe, year, session, group_code, count(*) AS members FROM mu WHERE mapping_status = 'UNIQUE' AND NOT identity_ambiguous GROUP BY ALL)"


def sizes(spark, d):
    usable = mapped_universe(spark, d).where("mapping_status = 'UNIQUE' AND NOT identity_ambiguous")
    return g.group_sizes(usable)


@query("sector_viability", f"""WITH {SIZES}, pd AS (SELECT universe, year, t AS threshold, session, count(*) AS gs, count(CASE WHEN members >= t THEN 1 END) AS k,
    sum(members) AS r, coalesce(sum(CASE WHEN members >= t THEN members END), 0) AS kr FROM sizes CROSS JOIN (SELECT unnest([2, 3, 5]) AS t) GROUP BY ALL)
SELECT universe, year, threshold, count(*) AS dates, CAST(sum(gs) AS BIGINT) AS group_dates, CAST(sum(k) AS BIGINT) AS retained_group_dates,
  CAST(sum(r) AS BIGINT) AS rows, CAST(sum(kr) AS BIGINT) AS retained_rows, round(100.0 * sum(kr) / sum(r), 6) + 0.0 AS retained_row_pct,
  round(avg(k), 6) + 0.0 AS usable_groups_mean, round(median(k), 6) + 0.0 AS usable_groups_median, min(k) AS usable_groups_min, max(k) AS usable_groups_max
FROM pd GROUP BY 1, 2, 3""")
def _(spark, d):
    return g.sector_viability(sizes(spark, d), (2, 3, 5))


@query("concentration", f"""WITH {SIZES}, k AS (SELECT *, row_number() OVER (PARTITION BY universe, year, session ORDER BY members DESC, group_code) AS rn FROM sizes),
dl AS (SELECT universe, year, session, 100.0 * max(members) / sum(members) AS largest_share_pct, 100.0 * sum(CASE WHEN rn <= 3 THEN members END) / sum(members) AS top3_share_pct,
  count(CASE WHEN members = 1 THEN 1 END) AS singletons, count(CASE WHEN members < 3 THEN 1 END) AS below_3, count(CASE WHEN members < 5 THEN 1 END) AS below_5,
  count(CASE WHEN members >= 10 THEN 1 END) AS at_least_10, count(*) AS represented FROM k GROUP BY 1, 2, 3)
SELECT universe, year, count(*) AS dates, """ + ", ".join(f"round(median({c}), 6) + 0.0 AS median_{c}" for c in (
    "largest_share_pct", "top3_share_pct", "singletons", "below_3", "below_5", "at_least_10", "represented")) + """,
  round(avg(largest_share_pct), 6) + 0.0 AS mean_largest_share_pct, round(max(largest_share_pct), 6) + 0.0 AS max_largest_share_pct FROM dl GROUP BY 1, 2""")
def _(spark, d):
    return g.concentration(sizes(spark, d))


@query("tier_summary", f"""WITH {M}, {UNIVERSE_SQL}, {MAPPING}, um AS (SELECT u.*, group_code, mapping_status, identity_ambiguous FROM universe u JOIN mapping USING (entity)),
tl AS (SELECT 'STABLE_BASIC' AS tier, * FROM um WHERE universe_basic AND mapping_status = 'UNIQUE' AND NOT identity_ambiguous
  UNION ALL SELECT 'UNIQUE_BROAD', * FROM um WHERE universe_broad AND mapping_status = 'UNIQUE'),
cells AS (SELECT tier, session, group_code, count(*) AS n FROM tl GROUP BY 1, 2, 3),
sh AS (SELECT tier, round(median(n), 6) AS median_members, round(100.0 * count(CASE WHEN n >= 3 THEN 1 END) / count(*), 6) AS pct_ge3,
  round(100.0 * count(CASE WHEN n >= 5 THEN 1 END) / count(*), 6) AS pct_ge5, round(100.0 * count(CASE WHEN n >= 10 THEN 1 END) / count(*), 6) AS pct_ge10 FROM cells GROUP BY 1)
SELECT tier, count(DISTINCT entity) AS entities, count(*) AS rows, count(DISTINCT group_code) AS groups, any_value(median_members) AS median_members,
  any_value(pct_ge3) AS pct_ge3, any_value(pct_ge5) AS pct_ge5, any_value(pct_ge10) AS pct_ge10 FROM tl JOIN sh USING (tier) GROUP BY 1""")
def _(spark, d):
    p = universe_panel(spark, d)
    m = mapping(spark, d)
    p = g.tier_membership(p, m, "universe_basic", unique=True, stable=True, out="t1")
    p = g.tier_membership(p, m.select("entity"), "universe_broad", unique=True, stable=False, out="t2")
    return g.tier_summary(p, {"STABLE_BASIC": "t1", "UNIQUE_BROAD": "t2"})


@query("bias_label", f"""WITH {MAPPED_U} SELECT universe, year, CAST(count(*) AS BIGINT) AS rows, count(CASE WHEN mapping_status = 'UNIQUE' AND NOT identity_ambiguous THEN 1 END) AS verified_rows,
  CASE WHEN 100.0 * count(CASE WHEN mapping_status = 'UNIQUE' AND NOT identity_ambiguous THEN 1 END) / count(*) < 25 THEN 'SEVERE'
   WHEN 100.0 * count(CASE WHEN mapping_status = 'UNIQUE' AND NOT identity_ambiguous THEN 1 END) / count(*) < 60 THEN 'MATERIAL'
   WHEN 100.0 * count(CASE WHEN mapping_status = 'UNIQUE' AND NOT identity_ambiguous THEN 1 END) / count(*) < 90 THEN 'MODERATE' ELSE 'LOW' END AS bias_label
  FROM mu GROUP BY 1, 2""")
def _(spark, d):
    out = mapped_universe(spark, d).groupBy("universe", "year").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr("mapping_status = 'UNIQUE' AND NOT identity_ambiguous")).alias("verified_rows"))
    return out.withColumn("bias_label", cl.bias_label("verified_rows", "rows"))


@query("universe_counts", f"""WITH {M}, {UNIVERSE_SQL}, {LONG_U}, ref AS (SELECT s_suppkey AS entity FROM supplier WHERE s_acctbal >= 3000),
pd AS (SELECT universe, year, session, count(*) AS n FROM lu GROUP BY 1, 2, 3),
dy AS (SELECT universe, year, min(n) AS daily_min, round(median(n), 6) AS daily_median, round(avg(n), 6) AS daily_mean, max(n) AS daily_max FROM pd GROUP BY 1, 2),
mb AS (SELECT universe, year, count(*) AS rows, count(DISTINCT entity) AS entities, count(CASE WHEN entity IN (SELECT entity FROM ref) THEN 1 END) AS reference_rows,
  count(DISTINCT CASE WHEN entity NOT IN (SELECT entity FROM ref) THEN entity END) AS outside_entities FROM lu GROUP BY 1, 2)
SELECT *, round(100.0 * reference_rows / rows, 6) AS reference_pct FROM dy JOIN mb USING (universe, year)""")
def _(spark, d):
    ref = views.table(spark, d, "supplier").where("s_acctbal >= 3000").select(F.col("s_suppkey").alias("entity"))
    return g.universe_counts(universe_rows(spark, d, ("entity", "session")).drop("year"), ref)


@query("identity_aliases", """WITH d AS (SELECT l_suppkey AS entity, l_partkey AS isin, CAST(l_shipdate AS DATE) AS session FROM lineitem),
base AS (SELECT entity, min(session) AS first_session, max(session) AS last_session, count(*) AS observed_sessions FROM d GROUP BY 1),
p AS (SELECT DISTINCT entity, isin FROM d), g AS (SELECT isin FROM p GROUP BY 1 HAVING count(*) > 1),
pick AS (SELECT entity, max(isin) AS isin FROM p WHERE isin IN (SELECT isin FROM g) GROUP BY 1),
al AS (SELECT pick.entity, pick.isin AS shared_identifier, count(*) AS alias_count, string_agg(CAST(p.entity AS VARCHAR), '|' ORDER BY p.entity) AS known_alias FROM pick JOIN p ON p.isin = pick.isin AND p.entity <> pick.entity GROUP BY 1, 2),
ids AS (SELECT entity, count(*) AS identifier_count FROM p GROUP BY 1)
SELECT entity, first_session, last_session, observed_sessions, shared_identifier, coalesce(alias_count, 0) AS alias_count, coalesce(known_alias, '') AS known_alias, identifier_count,
  CASE WHEN alias_count IS NOT NULL THEN 'SHARED_IDENTIFIER_NOT_STITCHED' WHEN identifier_count > 1 THEN 'SEVERAL_IDENTIFIERS' ELSE 'OBSERVED_NOT_STITCHED' END AS continuity_status,
  alias_count IS NOT NULL OR identifier_count > 1 AS identity_ambiguous FROM base LEFT JOIN al USING (entity) JOIN ids USING (entity)""")
def _(spark, d):
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("isin"), F.col("l_shipdate").cast("date").alias("session"))
    return g.identity_aliases(rows)


@query("alias_groups", """WITH p AS (SELECT DISTINCT l_partkey AS isin, l_suppkey AS entity FROM lineitem)
SELECT isin, entity FROM p WHERE isin IN (SELECT isin FROM p GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, d):
    return g.alias_groups(views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("isin")))


DIST_COLS = ", ".join(f"round(quantile_cont(value, {p}), 6) + 0.0 AS {n}" for n, p in pr.DISTRIBUTION.items())


@query("distribution_summary", f"""WITH {M}, f AS (SELECT year(session) AS year, 'close' AS feature, close AS value FROM panel UNION ALL SELECT year(session), 'volume', volume FROM panel)
SELECT year, feature, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min,
  round(max(value), 6) + 0.0 AS max, round(skewness(value), 6) + 0.0 AS skew, {DIST_COLS} FROM f GROUP BY 1, 2""")
def _(spark, d):
    p = views.panel_month(spark, d).withColumn("year", F.year("session"))
    return pr.distribution_summary(pr.long_features(p, ["close", "volume"], keep=["year"]), keys=["year", "feature"])


def _q(c):
    return ", ".join(f"round(quantile_cont({c}, {p}), 6) + 0.0 AS {c}_{n}" for n, p in pr.DISTRIBUTION.items() if n not in ("p01", "p05")) + (
        f", round(min({c}), 6) + 0.0 AS {c}_min, round(max({c}), 6) + 0.0 AS {c}_max")


@query("quality_profile", f"""WITH {M}, {UNIVERSE_SQL}, {LONG_U}, per AS (SELECT universe, year, entity, count(*) AS r FROM lu GROUP BY 1, 2, 3),
pe AS (SELECT universe, year, count(*) AS entities, min(r) AS sessions_per_entity_min, max(r) AS sessions_per_entity_max, round(median(r), 6) + 0.0 AS sessions_per_entity_median FROM per GROUP BY 1, 2),
qq AS (SELECT universe, year, count(*) AS observations, count(CASE WHEN volume IS NULL THEN 1 END) AS null_volume, count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume,
  count(CASE WHEN volume < 0 THEN 1 END) AS negative_volume, count(CASE WHEN turnover IS NULL THEN 1 END) AS null_turnover, count(CASE WHEN turnover = 0 THEN 1 END) AS zero_turnover,
  {_q('volume')}, {_q('turnover')}, {_q('close')} FROM lu GROUP BY 1, 2)
SELECT * FROM pe JOIN qq USING (universe, year)""")
def _(spark, d):
    return pr.quality_profile(universe_rows(spark, d), keys=["universe", "year"])


@query("source_transition_audit", f"""WITH {M}, sp AS (SELECT *, CASE WHEN session < DATE '1998-07-01' THEN 'OLD' ELSE 'NEW' END AS source FROM panel),
dt AS (SELECT source, session, row_number() OVER (PARTITION BY source ORDER BY session DESC) AS bk, row_number() OVER (PARTITION BY source ORDER BY session) AS fr FROM (SELECT DISTINCT source, session FROM sp)),
md AS (SELECT entity, source, median(volume) AS m FROM sp JOIN dt USING (source, session) WHERE (source = 'OLD' AND bk <= 20) OR (source = 'NEW' AND fr <= 20) GROUP BY 1, 2),
tr AS (SELECT median(a.m / b.m) AS r, count(*) AS n FROM md a JOIN md b ON a.entity = b.entity AND a.source = 'NEW' AND b.source = 'OLD')
SELECT source, min(session) AS first_session, max(session) AS last_session, count(*) AS observations, count(CASE WHEN volume IS NULL THEN 1 END) AS null_volume,
  count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume, count(CASE WHEN volume < 0 THEN 1 END) AS negative_volume, count(DISTINCT session) AS sessions,
  count(DISTINCT entity) AS entities, round(quantile_cont(turnover / volume / close, 0.01), 6) + 0.0 AS implied_price_p01, round(median(turnover / volume / close), 6) + 0.0 AS implied_price_median,
  round(quantile_cont(turnover / volume / close, 0.99), 6) + 0.0 AS implied_price_p99, round(median(volume), 6) + 0.0 AS volume_median, round(quantile_cont(volume, 0.99), 6) + 0.0 AS volume_p99,
  (SELECT round(r, 6) + 0.0 FROM tr) AS transition_ratio_median, (SELECT n FROM tr) AS transition_entities FROM sp GROUP BY 1""")
def _(spark, d):
    p = views.panel_month(spark, d).withColumn("source", F.when(F.col("session") < F.lit("1998-07-01").cast("date"), "OLD").otherwise("NEW"))
    return pr.source_transition(p)


@query("rollup_all_plus_year", f"""WITH {M}, {s.NATION}
SELECT group_name, CASE WHEN grouping(year(session)) = 1 THEN 'ALL' ELSE CAST(year(session) AS VARCHAR) END AS year, count(*) AS rows,
  round(avg(volume), 6) + 0.0 AS mean_volume, round(100.0 * count(CASE WHEN close > 1500 THEN 1 END) / count(*), 6) + 0.0 AS pct_high
FROM panel JOIN groups USING (entity) GROUP BY GROUPING SETS ((group_name), (group_name, year(session)))""")
def _(spark, d):
    p = views.panel_month(spark, d).join(views.groups_nation(spark, d), "entity").withColumn("year", F.year("session"))
    return pr.rollup_all_plus_year(
        p.select("group_name", "volume", "close", "year"),
        [F.count(F.lit(1)).alias("rows"), F.avg("volume").alias("mean_volume"), percent_true(F.col("close") > 1500).alias("pct_high")],
        keys=["group_name"], year=F.col("year"))


@query("pairwise_correlation", f"""WITH {M}, {s.EVENTS}, {_baseline_sql(20)}, {_price_sql(5)},
ft AS (SELECT s.entity, s.session, volume_ratio_20 AS a, log_volume_surprise_20 AS b, price_return_5 AS c FROM surprise s JOIN pr USING (entity, session)),
pairs AS (SELECT 'volume_ratio_20' AS l, 'log_volume_surprise_20' AS r, a AS x, b AS y FROM ft UNION ALL SELECT 'volume_ratio_20', 'price_return_5', a, c FROM ft
  UNION ALL SELECT 'log_volume_surprise_20', 'price_return_5', b, c FROM ft),
rk AS (SELECT *, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2.0 AS ry FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT l AS "left", r AS "right", count(*) AS observations, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman,
  abs(corr(rx, ry)) >= 0.9 AS redundant FROM rk GROUP BY 1, 2""")
def _(spark, d):
    p = ro.volume_surprise(ro.prior_volume_baseline(crossed_panel(spark, d, (5, 20)), (20,), crossing="crossing"), (20,))
    p = ro.price_return(p, (5,), crossing="crossing")
    return pr.pairwise_correlation(p, ["volume_ratio_20", "log_volume_surprise_20", "price_return_5"])
