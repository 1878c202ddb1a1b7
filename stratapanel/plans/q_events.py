"""Queries: event classification, windows, crossings, proximity, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import events as e
from stratapanel.operators import profile as pr
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans import views
from stratapanel.plans.q_core import FULL_SQL_PANEL, M, WK, _full_sql, full_intervals
from stratapanel.plans.registry import final, query

DAY = s.panel("day")
ES = "entity, session"


def day_panel(spark, d):
    from stratapanel.operators.calendar import session_position

    return session_position(views._panel(spark, d, "day"))


def labelled_lines(spark, d):
    """Lines as event source rows: label, factor text and merger flag come from line columns."""
    flag, disc = F.col("l_returnflag"), F.col("l_discount")
    label = (
        F.when(flag == "R", "adj_factor_nonan").when(flag == "A", "dividend")
        .when(disc >= 0.08, "rights_issue").when(disc >= 0.04, "unknown_label").otherwise("buyback")
    )
    return views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"),
        label.alias("valid"), F.when(F.col("l_tax") >= 0.08, "1.0").otherwise("").alias("merger"),
        F.when(F.col("l_quantity") < 3, "n/a").otherwise((disc * 100).cast("int").cast("string")).alias("adj_factor"),
        (F.col("l_tax") <= 0.02).alias("_evident"), disc.alias("_disc"),
    )


@query("event_classify", f"""WITH src AS (SELECT l_orderkey, l_linenumber, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_tax,
  CASE WHEN l_returnflag = 'R' THEN 'adj_factor_nonan' WHEN l_returnflag = 'A' THEN 'dividend' WHEN l_discount >= 0.08 THEN 'rights_issue'
    WHEN l_discount >= 0.04 THEN 'unknown_label' ELSE 'buyback' END AS valid,
  CASE WHEN l_tax >= 0.08 THEN '1.0' ELSE '' END AS merger,
  CASE WHEN l_quantity < 3 THEN 'n/a' ELSE CAST(CAST(trunc(l_discount * 100) AS INT) AS VARCHAR) END AS adj_factor FROM lineitem),
evidence AS (SELECT DISTINCT symbol, date, TRY_CAST(adj_factor AS DOUBLE) AS f FROM src WHERE l_tax <= 0.02),
c AS (SELECT src.*, ev.f IS NOT NULL AS known FROM src LEFT JOIN evidence ev ON ev.symbol = src.symbol AND ev.date = src.date
  AND ev.f = TRY_CAST(src.adj_factor AS DOUBLE))
SELECT l_orderkey, l_linenumber,
  CASE WHEN valid = 'rights_issue' OR merger = '1.0' THEN upper(valid) WHEN valid IN ('dividend','buyback') THEN upper(valid)
    WHEN valid = 'adj_factor_nonan' AND known THEN 'CONVENTIONAL_ACTION_SUPPORTED_BY_PHASE1' WHEN valid = 'adj_factor_nonan' THEN 'UNSPECIFIED_FACTOR_EVENT'
    ELSE 'UNCLASSIFIED' END AS action_class,
  CASE WHEN valid = 'rights_issue' OR merger = '1.0' THEN 'MATERIAL_UNRESOLVED_EVENT' WHEN valid IN ('dividend','buyback') THEN 'NO_PRICE_ADJUSTMENT_NEEDED_FOR_PRICE_MOMENTUM'
    WHEN valid = 'adj_factor_nonan' AND known THEN 'LIKELY_ALREADY_ADJUSTED_CONVENTIONAL_ACTION' ELSE 'UNKNOWN_OR_AMBIGUOUS' END AS impact,
  CASE WHEN valid = 'rights_issue' OR merger = '1.0' THEN TRUE WHEN valid IN ('dividend','buyback') THEN FALSE
    WHEN valid = 'adj_factor_nonan' AND known THEN FALSE ELSE TRUE END AS ambiguous,
  CASE WHEN valid = 'rights_issue' OR merger = '1.0' THEN 'MISSING_ENTITLEMENT_TERMS_AND_UNVERIFIED_DATE_SEMANTICS' WHEN valid IN ('dividend','buyback') THEN 'SOURCE_LABEL_ONLY_SPECIAL_DISTRIBUTIONS_NOT_IDENTIFIABLE'
    WHEN valid = 'adj_factor_nonan' AND known THEN 'PHASE1_CONTINUITY_EVIDENCE_NOT_VENDOR_CERTIFICATION' WHEN valid = 'adj_factor_nonan' THEN 'NO_VERIFIED_CONVENTIONAL_ACTION_EVIDENCE'
    ELSE 'UNRECOGNIZED_SOURCE_LABEL' END AS class_reason FROM c""")
def _(spark, d):
    src = labelled_lines(spark, d)
    evidence = src.where("_evident").select("symbol", "date", F.expr("try_cast(adj_factor as double)").alias("factor"))
    out = e.event_classify(src, evidence.where("factor IS NOT NULL"))
    return out.select("l_orderkey", "l_linenumber", "action_class", "impact", "ambiguous", "class_reason")


def _hit(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


SUBJECT_KIND = " ".join(f"WHEN {_hit(w)} THEN '{n}'" for n, w in e.BLOCKING_KEYWORDS + e.INFORMATIONAL_KEYWORDS)
SUBJECT_HOW = " ".join([f"WHEN {_hit(w)} THEN '{e.MATCH}{n}'" for n, w in e.BLOCKING_KEYWORDS] + [f"WHEN {_hit(w)} THEN '{e.MATCH_INFORMATIONAL[n]}'" for n, w in e.INFORMATIONAL_KEYWORDS])
SUBJECT_BLOCK = " OR ".join(_hit(w) for _, w in e.BLOCKING_KEYWORDS)
SUBJECT_INFO = " OR ".join(_hit(w) for _, w in e.INFORMATIONAL_KEYWORDS)


@query("subject_classify", f"""WITH t AS (SELECT doc_id, upper(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE {SUBJECT_KIND} ELSE 'OTHER_OR_UNKNOWN' END AS action_type,
  CASE WHEN {SUBJECT_BLOCK} THEN 'BLOCK_PRICE_RETURN_INTERVAL' WHEN {SUBJECT_INFO} THEN 'NONBLOCKING_INFORMATIONAL'
    ELSE 'REVIEW_REQUIRED_BLOCKED' END AS safety, CASE {SUBJECT_HOW} ELSE '{e.NO_MATCH}' END AS match_reason FROM t""")
def _(spark, d):
    out = e.subject_classify(views.table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "action_type", "safety", "match_reason")


@query("identity_attach", """WITH ev AS (SELECT l_orderkey, l_linenumber, l_suppkey AS entity, l_partkey AS isin,
    CASE WHEN l_linestatus = 'F' THEN 'NONBLOCKING_INFORMATIONAL' ELSE 'BLOCK_PRICE_RETURN_INTERVAL' END AS safety
  FROM lineitem),
obs AS (SELECT DISTINCT l_suppkey AS entity, l_partkey AS isin FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'N' AND s_acctbal >= 2000),
st AS (SELECT ev.*, CASE WHEN entity NOT IN (SELECT entity FROM obs) THEN 'NOT_OBSERVED'
    WHEN EXISTS (SELECT 1 FROM obs o WHERE o.entity = ev.entity AND o.isin = ev.isin) THEN 'IDENTIFIER_OBSERVED'
    ELSE 'IDENTIFIER_CONFLICT' END AS identity_status FROM ev)
SELECT l_orderkey, l_linenumber, identity_status, CASE WHEN identity_status <> 'NOT_OBSERVED' THEN entity END AS mapped_entity,
  CASE WHEN identity_status = 'IDENTIFIER_CONFLICT' THEN 'REVIEW_REQUIRED_BLOCKED' ELSE safety END AS safety FROM st""")
def _(spark, d):
    li = views.table(spark, d, "lineitem")
    safety = F.when(F.col("l_linestatus") == "F", "NONBLOCKING_INFORMATIONAL").otherwise("BLOCK_PRICE_RETURN_INTERVAL")
    rows = li.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("isin"), safety.alias("safety"))
    rich = views.table(spark, d, "supplier").where("s_acctbal >= 2000").select(F.col("s_suppkey").alias("entity"))
    obs = li.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("isin"))
    out = e.identity_attach(rows, obs.join(rich, "entity", "left_semi"))
    return out.select("l_orderkey", "l_linenumber", "identity_status", "mapped_entity", "safety")


@query("blocking_events", f"WITH {M}, {s.EVENTS} SELECT DISTINCT entity, session FROM events_ledger WHERE impact = 'UNKNOWN' AND series = 'EQ'")
def _(spark, d):
    return e.blocking_events(views.event_ledger(spark, d), ["UNKNOWN"], series=["EQ"])


@query("event_map_union", f"""WITH {M}, {s.EVENTS}, ext AS (SELECT l_suppkey AS entity, CAST(o_orderdate AS DATE) AS session FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT entity, session FROM ev UNION SELECT entity, session FROM ext""")
def _(spark, d):
    li, o = views.table(spark, d, "lineitem"), views.table(spark, d, "orders")
    ext = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("entity"), F.col("o_orderdate").cast("date").alias("session"))
    return e.event_map_union(views.impact_days(spark, d), ext)


WIDE_EVENTS = """wide_ev AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS session, l_orderkey * 10 + l_linenumber AS event_id,
  CASE WHEN l_linestatus = 'F' THEN 'MATERIAL' ELSE 'UNKNOWN' END AS impact, l_returnflag AS action_class FROM lineitem)"""


def wide_events(spark, d):
    return views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("session"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.when(F.col("l_linestatus") == "F", "MATERIAL").otherwise("UNKNOWN").alias("impact"),
        F.col("l_returnflag").alias("action_class"))


@query("event_on_day", f"""WITH {DAY}, {WIDE_EVENTS}, dd AS (SELECT entity, session, string_agg(DISTINCT impact, '|' ORDER BY impact) AS st,
    string_agg(DISTINCT CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR)) AS ids, count(DISTINCT event_id) AS n FROM wide_ev GROUP BY 1, 2)
SELECT entity, session, coalesce(st, 'NO_RECORDED_EVENT') AS event_status, coalesce(ids, '') AS event_ids, coalesce(n, 0) AS event_count
FROM panel LEFT JOIN dd USING (entity, session)""")
def _(spark, d):
    out = e.event_on_day(day_panel(spark, d), wide_events(spark, d))
    return out.select("entity", "session", "event_status", "event_ids", "event_count")


@query("event_ids_on_day", f"WITH {DAY}, {WIDE_EVENTS} SELECT DISTINCT entity, session, event_id FROM panel JOIN wide_ev USING (entity, session)")
def _(spark, d):
    return e.event_ids_on_day(day_panel(spark, d), wide_events(spark, d))


@query("event_exclusion_window", f"""WITH {WK}, {s.EVENTS},
evn AS (SELECT entity, session, (SELECT count(*) FROM calendar c WHERE c.session < ev.session) AS b,
  (SELECT count(*) FROM calendar c WHERE c.session = ev.session) AS x FROM ev)
SELECT entity, session, position, EXISTS (SELECT 1 FROM evn WHERE evn.entity = panel.entity
  AND panel.position BETWEEN b - 2 AND b + 3 - (1 - x)) AS event_excluded FROM panel""")
def _(spark, d):
    window = e.exclusion_window(views.impact_days(spark, d), pp.calendar_of(spark, d, "week"), 2, 3)
    return e.flag_excluded(pp.positioned(spark, d, "week"), window).select("entity", "session", "position", "event_excluded")


@query("interval_event_crossing", f"""WITH {M}, {s.EVENTS}, iv AS (SELECT l_orderkey, l_linenumber, l_suppkey AS entity,
    CAST(o_orderdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) AS end_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM ev WHERE ev.entity = iv.entity AND ev.session > start_date AND ev.session <= end_date)
  AS crosses_event FROM iv""")
def _(spark, d):
    li, o = views.table(spark, d, "lineitem"), views.table(spark, d, "orders")
    iv = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity"),
        F.col("o_orderdate").cast("date").alias("start_date"), F.col("l_shipdate").cast("date").alias("end_date"))
    out = e.interval_event_crossing(iv, views.impact_days(spark, d))
    return out.select("l_orderkey", "l_linenumber", "crosses_event")


@query("event_proximity_flag", f"""WITH {DAY}, {s.EVENTS}, evs AS (SELECT entity, position FROM ev JOIN calendar USING (session))
SELECT entity, session, EXISTS (SELECT 1 FROM evs WHERE evs.entity = panel.entity AND abs(evs.position - panel.position) <= 5) AS near_event FROM panel""")
def _(spark, d):
    out = e.event_proximity_flag(
        day_panel(spark, d), views.impact_days(spark, d), 5, calendar=pp.calendar_of(spark, d, "day"))
    return out.select("entity", "session", "near_event")


@query("event_study", f"""WITH {DAY}, {WIDE_EVENTS},
near AS (SELECT w.entity, w.event_id, w.impact, w.action_class, r AS relative_session, c.position + r AS position
  FROM wide_ev w JOIN calendar c USING (session) CROSS JOIN (SELECT unnest(range(-3, 4)) AS r)),
inside AS (SELECT near.*, p.volume, p.close FROM near JOIN calendar c ON c.position = near.position
  LEFT JOIN panel p ON p.entity = near.entity AND p.position = near.position),
both_levels AS (SELECT * FROM inside UNION ALL SELECT entity, event_id, impact, 'ALL_CLASSES', relative_session, position, volume, close FROM inside)
SELECT impact, action_class, relative_session, count(DISTINCT event_id) AS source_events, count(volume) AS matched_observations,
  round(median(volume), 6) + 0.0 AS volume_median, round(quantile_cont(volume, 0.95), 6) + 0.0 AS volume_p95,
  round(median(close), 6) + 0.0 AS close_median, round(quantile_cont(close, 0.95), 6) + 0.0 AS close_p95
FROM both_levels GROUP BY 1, 2, 3""")
def _(spark, d):
    return e.event_study(
        day_panel(spark, d), wide_events(spark, d), 3, ["volume", "close"], calendar=pp.calendar_of(spark, d, "day"))


@query("ledger_reconcile", """WITH acc AS (SELECT l_orderkey, l_linenumber, l_suppkey AS entity, l_linestatus AS series, CAST(l_shipdate AS DATE) AS session
    FROM lineitem WHERE l_returnflag <> 'A'),
off AS (SELECT l_suppkey AS entity, l_linestatus AS series, CAST(l_shipdate AS DATE) AS session, count(*) AS official_count
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, entity, series, session, coalesce(official_count, 0) AS official_count,
  CASE WHEN official_count IS NOT NULL THEN 'ACCEPTED_MATCHED' ELSE 'ACCEPTED_ONLY' END AS relationship FROM acc LEFT JOIN off USING (entity, series, session)
UNION ALL SELECT NULL, NULL, entity, series, session, official_count, 'OFFICIAL_ONLY' FROM off ANTI JOIN acc USING (entity, series, session)""")
def _(spark, d):
    return e.ledger_reconcile(*two_ledgers(spark, d))


@query("ledger_details", """SELECT DISTINCT l_suppkey AS entity, l_linestatus AS series, CAST(l_shipdate AS DATE) AS session, CAST(l_partkey AS VARCHAR) AS purpose,
  CASE WHEN EXISTS (SELECT 1 FROM lineitem a WHERE a.l_returnflag <> 'A' AND a.l_suppkey = o.l_suppkey AND a.l_linestatus = o.l_linestatus AND CAST(a.l_shipdate AS DATE) = CAST(o.l_shipdate AS DATE))
    THEN 'ACCEPTED_MATCHED' ELSE 'OFFICIAL_ONLY' END AS relationship FROM lineitem o WHERE l_returnflag <> 'R'""")
def _(spark, d):
    return e.ledger_details(*two_ledgers(spark, d))


def two_ledgers(spark, d):
    """All lines in two ledgers that overlap in part: lines with flag N are in both."""
    li = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_suppkey").alias("entity"),
        F.col("l_linestatus").alias("series"), F.col("l_shipdate").cast("date").alias("session"),
        F.col("l_partkey").cast("string").alias("purpose"))
    return li.where("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", "entity", "series", "session"), li.where("l_returnflag <> 'R'")


SPECS = [("FORMATION", h, f"valid_ret_{h}", f"ret_{h}_invalid_reason") for h in (2, 5)] + [
    ("FUTURE", h, f"valid_future_{h}", f"future_invalid_reason_{h}") for h in (1, 3)]
FULL = f"{WK}, {s.EVENTS}, {FULL_SQL_PANEL}, {_full_sql(2, False)}, {_full_sql(5, False)}, {_full_sql(1, True)}, {_full_sql(3, True)}"
LONG_REASONS = "lr AS (" + " UNION ALL ".join(
    f"SELECT session, '{k}' AS interval_type, {h} AS horizon, reason_{n}{h} AS reason FROM {n}{h}"
    for k, h, n in (("FORMATION", 2, "b"), ("FORMATION", 5, "b"), ("FUTURE", 1, "f"), ("FUTURE", 3, "f"))) + ")"


@query("coverage_by_validity", f"""WITH {FULL}, {LONG_REASONS}
SELECT interval_type, horizon, count(*) AS total_rows, count(CASE WHEN reason = '' THEN 1 END) AS valid_rows,
  count(CASE WHEN reason <> '' THEN 1 END) AS invalid_rows, round(100.0 * count(CASE WHEN reason = '' THEN 1 END) / count(*), 6) + 0.0 AS valid_pct,
  min(CASE WHEN reason = '' THEN session END) AS first_valid, max(CASE WHEN reason = '' THEN session END) AS last_valid FROM lr GROUP BY 1, 2""")
def _(spark, d):
    return pr.coverage_by_validity(full_intervals(spark, d), SPECS)


@query("coverage_reasons", f"""WITH {FULL}, {LONG_REASONS},
parts AS (SELECT interval_type, horizon, unnest(string_split(reason, '|')) AS reason, string_split(reason, '|')[1] AS first FROM lr WHERE reason <> '')
SELECT interval_type, horizon, reason, count(*) AS overlapping_count, count(CASE WHEN reason = first THEN 1 END) AS primary_count FROM parts GROUP BY 1, 2, 3""")
def _(spark, d):
    return pr.coverage_reasons(full_intervals(spark, d), SPECS)
