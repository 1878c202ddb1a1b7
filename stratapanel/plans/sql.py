"""Common table expressions for the SQL statements of the registered queries."""

from __future__ import annotations


def panel(unit: str = "month") -> str:
    return f"""raw_panel AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS session,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS turnover,
         CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2),
calendar AS (
  SELECT session, row_number() OVER (ORDER BY session) - 1 AS position FROM (SELECT DISTINCT session FROM raw_panel)),
panel AS (
  SELECT p.*, turnover / volume AS close, volume >= 2 AS quality, c.position
  FROM raw_panel p JOIN calendar c USING (session))"""


EVENTS = """events_ledger AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS entity, CAST(l_shipdate AS DATE) AS session,
         CASE WHEN NOT (l_returnflag = 'R' AND l_discount >= 0.10 AND l_quantity >= 49) THEN 'NONE' WHEN l_linestatus = 'F' THEN 'MATERIAL' ELSE 'UNKNOWN' END AS impact,
         CASE WHEN l_tax >= 0.04 THEN 'EQ' ELSE 'BE' END AS series, l_extendedprice AS amount
  FROM lineitem),
ev AS (SELECT DISTINCT entity, session FROM events_ledger WHERE impact <> 'NONE'),
evp AS (
  SELECT DISTINCT entity, (SELECT min(c.position) FROM calendar c WHERE c.session >= ev.session) AS position FROM ev)"""

NATION = """groups AS (
  SELECT s_suppkey AS entity, n_name AS group_name, n_nationkey AS group_code, s_acctbal < 0 AS identity_ambiguous
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

REGION = """regions AS (
  SELECT s_suppkey AS entity, r_name AS group_name, r_regionkey AS group_code
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def pit(formations, futures, source: str = "panel", events: bool = False, coverage=None) -> str:
    """Point-in-time intervals by brute force self-joins on position."""
    cols, joins = [], []
    for h in formations:
        cross = (f"EXISTS (SELECT 1 FROM evp e WHERE e.entity = p.entity AND e.position > p.position - {h} "
                 f"AND e.position <= p.position)") if events else "FALSE"
        ok = (f"(p.quality AND a{h}.close IS NOT NULL AND (SELECT count(*) FROM {source} q WHERE q.entity = p.entity "
              f"AND q.position BETWEEN p.position - {h} AND p.position) = {h + 1} AND NOT {cross})")
        cols += [f"{ok} AS valid_factor_broad_{h}",
                 f"CASE WHEN {ok} THEN p.close / a{h}.close - 1 END AS ret_{h}",
                 (f"coalesce({ok} AND a{h}.session >= DATE '{coverage[0]}' AND p.session <= DATE '{coverage[1]}', FALSE)"
                  if coverage else ok) + f" AS valid_factor_primary_{h}"]
        joins.append(f"LEFT JOIN {source} a{h} ON a{h}.entity = p.entity AND a{h}.position = p.position - {h}")
    for h in futures:
        cross = (f"EXISTS (SELECT 1 FROM evp e WHERE e.entity = p.entity AND e.position > p.position "
                 f"AND e.position <= p.position + {h})") if events else "FALSE"
        ok = (f"(p.quality AND b{h}.close IS NOT NULL AND (SELECT count(*) FROM {source} q WHERE q.entity = p.entity "
              f"AND q.position BETWEEN p.position AND p.position + {h}) = {h + 1} AND NOT {cross})")
        cols += [f"{ok} AS valid_future_broad_{h}",
                 f"CASE WHEN {ok} THEN b{h}.close / p.close - 1 END AS future_ret_{h}",
                 (f"coalesce({ok} AND p.session >= DATE '{coverage[0]}' AND b{h}.session <= DATE '{coverage[1]}', FALSE)"
                  if coverage else ok) + f" AS valid_future_primary_{h}"]
        joins.append(f"LEFT JOIN {source} b{h} ON b{h}.entity = p.entity AND b{h}.position = p.position + {h}")
    return (f"pit AS (SELECT p.entity, p.session, p.position, p.close, p.volume, p.turnover, p.quality,\n  "
            + ",\n  ".join(cols) + f"\nFROM {source} p\n" + "\n".join(joins) + ")")


def pit_windows(formations, futures) -> str:
    """The same intervals without events and coverage, from RANGE frames (quick form for derived queries)."""
    cols, keep = [], []
    for h in formations:
        cols += [f"count(*) OVER (PARTITION BY entity ORDER BY position RANGE BETWEEN {h} PRECEDING AND CURRENT ROW) AS n{h}",
                 f"lag(close, {h}) OVER (PARTITION BY entity ORDER BY position) AS c{h}"]
        ok = f"(quality AND n{h} = {h + 1} AND c{h} IS NOT NULL)"
        keep += [f"{ok} AS valid_factor_primary_{h}", f"CASE WHEN {ok} THEN close / c{h} - 1 END AS ret_{h}"]
    for h in futures:
        cols += [f"count(*) OVER (PARTITION BY entity ORDER BY position RANGE BETWEEN CURRENT ROW AND {h} FOLLOWING) AS m{h}",
                 f"lead(close, {h}) OVER (PARTITION BY entity ORDER BY position) AS d{h}"]
        ok = f"(quality AND m{h} = {h + 1} AND d{h} IS NOT NULL)"
        keep += [f"{ok} AS valid_future_primary_{h}", f"CASE WHEN {ok} THEN d{h} / close - 1 END AS future_ret_{h}"]
    return (f"pit0 AS (SELECT *, {', '.join(cols)} FROM panel),\n"
            f"pit AS (SELECT entity, session, position, close, volume, turnover, quality, {', '.join(keep)} FROM pit0)")


def ranked(formations, futures, single: float = 0.5) -> str:
    """signals -> ranked -> paired (long form of factor ranks with outcomes)."""
    sig = " UNION ALL ".join(
        f"SELECT entity, session, position, {h} AS formation, ret_{h} AS factor, "
        + ", ".join(f"CASE WHEN valid_future_primary_{f} THEN future_ret_{f} END AS o{f}" for f in futures)
        + f" FROM pit WHERE valid_factor_primary_{h}" for h in formations)
    out = " UNION ALL ".join(
        f"SELECT entity, session, position, formation, factor, rank, pct, count, {f} AS future, o{f} AS outcome "
        f"FROM ranked WHERE o{f} IS NOT NULL" for f in futures)
    return f"""signals AS ({sig}),
ranked AS (
  SELECT *, CASE WHEN count > 1 THEN (rank - 1) / CAST(count - 1 AS DOUBLE) ELSE {single} END AS pct FROM (
    SELECT *, row_number() OVER (PARTITION BY formation, session ORDER BY factor, entity) AS rank,
           count(*) OVER (PARTITION BY formation, session) AS count FROM signals)),
paired AS ({out})"""


def spearman(source: str, keys: str, x: str, y: str, out: str, rerank: bool = True, extra: str = "") -> str:
    """CTEs ``{out}_r`` (average ranks) and ``{out}`` (observations, ic per key)."""
    rx = (f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
          if rerank else f"{x}")
    return f"""{out}_r AS (
  SELECT *, CAST({rx} AS DOUBLE) AS rx,
         CAST(rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0 AS DOUBLE) AS ry
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{out} AS (
  SELECT {keys}, count(*) AS observations{extra},
         CASE WHEN count(*) >= 2 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic
  FROM {out}_r GROUP BY {keys})"""


def buckets(q: int, bucket: str = "bucket", outcome: str = "outcome") -> str:
    """Aggregate columns q{i}_sum, q{i}_count."""
    return ", ".join(
        f"coalesce(sum(CASE WHEN {bucket} = {i} THEN {outcome} END), 0.0) AS q{i}_sum, "
        f"count(CASE WHEN {bucket} = {i} THEN {outcome} END) AS q{i}_count" for i in range(1, q + 1))


def spread(q: int) -> str:
    return f"q{q}_sum / nullif(q{q}_count, 0) - q1_sum / nullif(q1_count, 0)"


def daily(q: int, minimum: int, keys: str = "formation, future, session", source: str = "paired") -> str:
    """CTE ``daily``: ic, bucket sums, spread, counts per key."""
    return spearman(source, keys, "rank", "outcome", "ics", extra=", max(count) AS cross_section_count, max(position) AS position") + f""",
bucketed AS (SELECT *, CASE WHEN count >= {minimum} THEN ((rank - 1) * {q}) // count + 1 END AS bucket FROM {source}),
sums AS (SELECT {keys}, {buckets(q)} FROM bucketed GROUP BY {keys}),
daily AS (SELECT *, {spread(q)} AS spread FROM ics JOIN sums USING ({keys}))"""


def summary_cols(q: int = 0, spreads=("spread",), null_in_denominator: bool = True) -> str:
    base = "count(*)" if null_in_denominator else "nullif(count(ic), 0)"
    s = [
        "avg(ic) AS mean_ic", "median(ic) AS median_ic", "stddev_samp(ic) AS ic_std",
        f"100.0 * count(CASE WHEN ic > 0 THEN 1 END) / {base} AS ic_positive_pct",
        f"100.0 * count(CASE WHEN ic < 0 THEN 1 END) / {base} AS ic_negative_pct",
        "count(ic) AS valid_dates", "CAST(sum(observations) AS BIGINT) AS observation_count",
        "avg(ic) / nullif(stddev_samp(ic), 0) AS mean_over_std_ic",
        "avg(ic) / (nullif(stddev_samp(ic), 0) / sqrt(count(ic))) AS naive_t_stat",
    ]
    s += [f"avg({x}) AS mean_{x}" for x in spreads]
    if q:
        m = [f"sum(q{i}_sum) / nullif(sum(q{i}_count), 0)" for i in range(1, q + 1)]
        s.append(f"{m[-1]} - {m[0]} AS pooled_spread")
        s += [f"{e} AS m{i}" for i, e in enumerate(m, 1)]
    return ", ".join(s)


SUMMARY_DOUBLES = ("mean_ic median_ic ic_std ic_positive_pct ic_negative_pct mean_over_std_ic naive_t_stat "
                   "mean_spread")


def monotonicity(q: int) -> str:
    """Spearman of m1..mq with 1..q as a scalar expression."""
    arr = "[" + ", ".join(f"m{i}" for i in range(1, q + 1)) + "]"
    null = " OR ".join(f"m{i} IS NULL" for i in range(1, q + 1))
    return (f"CASE WHEN NOT ({null}) THEN (SELECT corr(i, r) FROM (SELECT i, rank() OVER (ORDER BY m) + "
            f"(count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM (SELECT unnest({arr}) AS m, "
            f"unnest(range(1, {q + 1})) AS i))) END")


def row_hashes(columns: list[str]) -> str:
    """Both row hashes (h1, h2) of ``columns``: every field with its length in front, or a mark for NULL."""
    text = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in columns)
    digest = f"sha256(concat_ws(',', {text}))"
    return f"CAST('0x' || substr({digest}, 1, 15) AS BIGINT) AS h1, CAST('0x' || substr({digest}, 16, 15) AS BIGINT) AS h2"
