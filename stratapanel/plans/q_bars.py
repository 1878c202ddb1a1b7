"""Queries: minute flags, daily bars, session quality, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.functions import scalars as sc
from stratapanel.operators import bars as b
from stratapanel.plans import panels as pp
from stratapanel.plans import views
from stratapanel.plans.q_core import M
from stratapanel.plans.registry import final, query
from stratapanel.runtime import scratch_path
from stratapanel.sources import readers as rd
from stratapanel.sources import writers as wr

# Session rules of the event stream: a 12-hour grid and four exceptional days.
OVERRIDES = [("2024-01-06", "SPECIAL", "10:00-12:00|14:00-16:00", False), ("2024-01-10", "EARLY_CLOSE", "08:00-13:00", True),
             ("2024-01-15", "HALT_OR_EXTENDED_UNRESOLVED", "", True), ("2024-01-17", "EVENING", "18:00-20:00", False)]


def rules(spark):
    return b.SessionRules([("08:00", "14:00"), ("14:30", "20:00")], b.override_frame(spark, OVERRIDES), {"signup": "2024-01-05"})


def ntz(df):
    """Timestamps without zone, as the source has them."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
                       for f in df.schema.fields])


RAW = """mr AS (SELECT event_id, event_type AS entity, date_trunc('minute', ts) AS ts, value AS open, least(value, 200.0) AS high, value AS low, value AS close,
  CAST(floor(value) - 1 AS DOUBLE) AS volume, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS token FROM events)"""
FLAGS = f"""{RAW}, md AS (SELECT *, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS minute FROM mr),
sp AS (SELECT *, CASE day WHEN DATE '2024-01-06' THEN 'SPECIAL' WHEN DATE '2024-01-10' THEN 'EARLY_CLOSE' WHEN DATE '2024-01-15' THEN 'HALT_OR_EXTENDED_UNRESOLVED'
    WHEN DATE '2024-01-17' THEN 'EVENING' ELSE CASE WHEN isodow(day) >= 6 THEN 'UNKNOWN_IRREGULAR' ELSE 'NORMAL' END END AS session_type FROM md),
gr AS (SELECT *, session_type NOT IN ('HALT_OR_EXTENDED_UNRESOLVED', 'UNKNOWN_IRREGULAR') AS grid_known,
  session_type IN ('EARLY_CLOSE', 'HALT_OR_EXTENDED_UNRESOLVED', 'UNKNOWN_IRREGULAR') AS force_ineligible,
  CASE session_type WHEN 'NORMAL' THEN (minute >= 480 AND minute < 840) OR (minute >= 870 AND minute < 1200) WHEN 'SPECIAL' THEN (minute >= 600 AND minute < 720) OR (minute >= 840 AND minute < 960)
    WHEN 'EARLY_CLOSE' THEN minute >= 480 AND minute < 780 WHEN 'EVENING' THEN minute >= 1080 AND minute < 1200 ELSE TRUE END AS on_grid,
  CASE session_type WHEN 'NORMAL' THEN 690 WHEN 'SPECIAL' THEN 240 WHEN 'EARLY_CLOSE' THEN 300 WHEN 'EVENING' THEN 120 END AS expected_minutes,
  CASE session_type WHEN 'NORMAL' THEN 480 WHEN 'SPECIAL' THEN 600 WHEN 'EARLY_CLOSE' THEN 480 WHEN 'EVENING' THEN 1080 END AS fm,
  CASE session_type WHEN 'NORMAL' THEN 1199 WHEN 'SPECIAL' THEN 959 WHEN 'EARLY_CLOSE' THEN 779 WHEN 'EVENING' THEN 1199 END AS lm FROM sp),
fl AS (SELECT *, NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, low, close) AND low <= least(open, high, close)) AS bad_ohlc,
  volume < 0 OR floor(volume) <> volume AS bad_other, entity = 'signup' AND day < DATE '2024-01-05' AS before_identity,
  grid_known AND NOT on_grid AS outside_session, count(*) OVER (PARTITION BY entity, ts) > 1 AS dup FROM gr),
gd AS (SELECT *, NOT (bad_ohlc OR bad_other OR before_identity OR outside_session OR dup) AS good FROM fl)"""


@query("bad_ohlc_flag", f"WITH {FLAGS} SELECT entity, ts, open, high, low, close, bad_ohlc FROM gd")
def _(spark, d):
    rows = ntz(views.minute_rows(spark, d))
    return rows.select("entity", "ts", "open", "high", "low", "close", sc.bad_ohlc().alias("bad_ohlc"))


@query("bad_volume_or_minute_flag", """SELECT event_id, value * 2 AS volume, value * 2 < 0 OR floor(value * 2) <> value * 2 OR date_trunc('minute', ts) <> ts AS bad,
  floor(value * 2) <> value * 2 AS fractional FROM events""")
def _(spark, d):
    e = views.table(spark, d, "events").select("event_id", (F.col("value") * 2).alias("volume"), F.col("ts").cast("timestamp").alias("ts"))
    whole = F.date_trunc("minute", "ts")
    return e.select("event_id", "volume", sc.bad_volume_or_minute("volume", "ts").alias("bad"), sc.bad_volume_or_minute("volume", whole).alias("fractional"))


@query("duplicate_all_copies_flag", f"WITH {FLAGS} SELECT entity, ts, exclusion FROM (SELECT entity, ts, TRUE AS exclusion FROM gd WHERE dup)")
def _(spark, d):
    out = b.minute_exclusions(views.minute_rows(spark, d), rules(spark)).where(F.col("exclusion_reason").contains("DUPLICATE_TIMESTAMP"))
    return ntz(out.select("entity", "ts", F.lit(True).alias("exclusion")))


@query("identity_floor_flag", f"WITH {FLAGS} SELECT entity, ts, before_identity FROM gd")
def _(spark, d):
    return ntz(b.flag_minutes(views.minute_rows(spark, d), rules(spark)).select("entity", "ts", "before_identity"))


@query("session_grid_flag", f"WITH {FLAGS} SELECT entity, ts, minute, session_type, grid_known, force_ineligible, on_grid, outside_session FROM gd")
def _(spark, d):
    out = b.flag_minutes(views.minute_rows(spark, d), rules(spark))
    return ntz(out.select("entity", "ts", "minute", "session_type", "grid_known", "force_ineligible", "on_grid", "outside_session"))


@query("reason_concat", f"""WITH {FLAGS} SELECT entity, ts, open, volume, token, concat_ws('|', CASE WHEN before_identity THEN 'PRELISTING_IDENTITY_CONTAMINATION' END,
  CASE WHEN bad_ohlc THEN 'INVALID_OHLC' END, CASE WHEN bad_other THEN 'INVALID_VOLUME_OR_TIMESTAMP' END, CASE WHEN dup THEN 'DUPLICATE_TIMESTAMP' END,
  CASE WHEN outside_session THEN 'OUTSIDE_KNOWN_SESSION' END) AS exclusion_reason FROM gd WHERE NOT good""")
def _(spark, d):
    out = b.minute_exclusions(views.minute_rows(spark, d), rules(spark))
    return ntz(out.select("entity", "ts", "open", "volume", "token", "exclusion_reason"))


DAYS = f"""{FLAGS}, dd AS (SELECT entity, day, session_type, grid_known, force_ineligible, expected_minutes, fm, lm, count(*) AS observed_bars, count(DISTINCT minute) AS observed_unique_minutes,
  min(ts) AS first_timestamp, max(ts) AS last_timestamp, count(CASE WHEN bad_ohlc THEN 1 END) AS invalid_ohlc_minutes, count(CASE WHEN bad_other THEN 1 END) AS other_invalid_minutes,
  count(CASE WHEN dup THEN 1 END) AS duplicate_minutes, count(CASE WHEN before_identity THEN 1 END) AS prelisting_minutes, count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume_minutes,
  count(CASE WHEN outside_session THEN 1 END) AS unexpected_minutes, 0 AS off_minute_rows, arg_min(open, CASE WHEN good THEN ts END) AS open, max(CASE WHEN good THEN high END) AS high,
  min(CASE WHEN good THEN low END) AS low, arg_max(close, CASE WHEN good THEN ts END) AS close, CAST(coalesce(sum(CASE WHEN good THEN volume END), 0) AS BIGINT) AS volume,
  count(CASE WHEN good THEN 1 END) AS valid_bars, min(CASE WHEN good THEN ts END) AS first_valid_timestamp, max(CASE WHEN good THEN ts END) AS last_valid_timestamp,
  count(DISTINCT CASE WHEN on_grid THEN minute END) AS covered FROM gd GROUP BY ALL),
days AS (SELECT *, CASE WHEN grid_known THEN expected_minutes - covered END AS missing_expected_minutes,
  coalesce(grid_known AND first_valid_timestamp = CAST(day AS TIMESTAMP) + to_minutes(fm), FALSE) AS open_is_scheduled_first,
  coalesce(grid_known AND last_valid_timestamp = CAST(day AS TIMESTAMP) + to_minutes(lm), FALSE) AS close_is_scheduled_last,
  coalesce(first_valid_timestamp = first_timestamp, FALSE) AS open_is_first_observed,
  CASE WHEN grid_known THEN greatest(last_timestamp + INTERVAL 1 MINUTE, CAST(day AS TIMESTAMP) + to_minutes(lm + 1)) ELSE last_timestamp + INTERVAL 1 MINUTE END AS bar_available_at,
  observed_bars - valid_bars AS excluded_minutes, CASE WHEN grid_known THEN CAST(day AS TIMESTAMP) + to_minutes(fm) END AS scheduled_open,
  CASE WHEN grid_known THEN CAST(day AS TIMESTAMP) + to_minutes(lm + 1) END AS scheduled_close FROM dd),
days2 AS (SELECT *, CASE WHEN valid_bars = 0 THEN 'NO_VALID_MINUTES' WHEN open_is_scheduled_first THEN 'SCHEDULED_FIRST_MINUTE' ELSE 'LATER_OBSERVED_OPEN' END AS open_quality FROM days)"""
BAR_COLS = ("entity, day, observed_bars, observed_unique_minutes, first_timestamp, last_timestamp, invalid_ohlc_minutes, other_invalid_minutes, duplicate_minutes, "
            "prelisting_minutes, zero_volume_minutes, unexpected_minutes, off_minute_rows, open, high, low, close, volume, valid_bars, first_valid_timestamp, last_valid_timestamp, excluded_minutes")
BOUND_COLS = ("entity, day, session_type, expected_minutes, missing_expected_minutes, open_is_scheduled_first, close_is_scheduled_last, open_is_first_observed, open_quality, "
              "bar_available_at, scheduled_open, scheduled_close")


def days(spark, d):
    return b.bars_from_minutes(views.minute_rows(spark, d), rules(spark))


@query("bars_from_minutes", f"WITH {DAYS} SELECT {BAR_COLS} FROM days2")
def _(spark, d):
    return ntz(days(spark, d).select(*[c.strip() for c in BAR_COLS.split(",")]))


@query("bar_boundaries", f"WITH {DAYS} SELECT {BOUND_COLS} FROM days2")
def _(spark, d):
    return ntz(days(spark, d).select(*[c.strip() for c in BOUND_COLS.split(",")]))


QUALITY = f"""{DAYS}, shd AS (SELECT day, count(CASE WHEN missing_expected_minutes > 0 THEN 1 END) AS short FROM days2 GROUP BY 1),
sq AS (SELECT days2.*, CASE WHEN invalid_ohlc_minutes > 0 OR other_invalid_minutes > 0 OR duplicate_minutes > 0 THEN 'DATA_QUALITY_ISSUE'
  WHEN NOT grid_known AND session_type = 'HALT_OR_EXTENDED_UNRESOLVED' THEN 'PARTIAL_SHARED_MARKET_EVENT' WHEN NOT grid_known THEN 'UNKNOWN_IRREGULAR'
  WHEN force_ineligible OR unexpected_minutes > 0 THEN 'UNKNOWN_IRREGULAR' WHEN missing_expected_minutes > 0 AND short >= 2 THEN 'PARTIAL_SHARED_MARKET_EVENT'
  WHEN missing_expected_minutes > 0 THEN 'PARTIAL_SYMBOL_SPECIFIC' WHEN session_type = 'NORMAL' THEN 'NORMAL_COMPLETE' ELSE 'KNOWN_SPECIAL_COMPLETE' END AS session_quality
  FROM days2 JOIN shd USING (day)),
el AS (SELECT *, concat_ws('|', CASE WHEN prelisting_minutes > 0 THEN 'PRELISTING_IDENTITY_CONTAMINATION' END, CASE WHEN invalid_ohlc_minutes > 0 THEN 'INVALID_OHLC' END,
  CASE WHEN other_invalid_minutes > 0 OR duplicate_minutes > 0 THEN 'INSUFFICIENT_SOURCE_QUALITY' END,
  CASE WHEN session_quality IN ('PARTIAL_SHARED_MARKET_EVENT', 'PARTIAL_SYMBOL_SPECIFIC') THEN 'PARTIAL_SESSION_UNRESOLVED' END,
  CASE WHEN session_quality = 'UNKNOWN_IRREGULAR' THEN 'UNKNOWN_IRREGULAR_SESSION' END, CASE WHEN unexpected_minutes > 0 THEN 'UNEXPECTED_SESSION_MINUTES' END,
  CASE WHEN valid_bars = 0 THEN 'NO_VALID_MINUTES' END) AS exclusion_reason FROM sq)"""


@query("session_quality", f"WITH {QUALITY} SELECT entity, day, session_quality FROM sq")
def _(spark, d):
    return b.session_quality(days(spark, d)).select("entity", "day", "session_quality")


@query("row_eligibility", f"WITH {QUALITY} SELECT entity, day, exclusion_reason, exclusion_reason = '' AS eligible FROM el")
def _(spark, d):
    return b.row_eligibility(b.session_quality(days(spark, d))).select("entity", "day", "exclusion_reason", "eligible")


@query("observed_calendar", f"""WITH {DAYS} SELECT day, max(session_type) AS session_type, count(*) AS observed_entities, count(CASE WHEN missing_expected_minutes > 0 THEN 1 END) AS short_entities,
  count(CASE WHEN missing_expected_minutes > 0 THEN 1 END) >= 2 AS shared_partial, max(expected_minutes) AS expected_minutes, max(scheduled_open) AS scheduled_open,
  max(scheduled_close) AS scheduled_close, bool_or(force_ineligible) AS force_ineligible FROM days2 GROUP BY 1""")
def _(spark, d):
    return ntz(b.observed_calendar(days(spark, d)))


@query("universe_summary", f"""WITH {QUALITY} SELECT entity, min(first_timestamp) AS first_observed, max(last_timestamp) AS last_observed, count(*) AS observed_sessions,
  count(CASE WHEN valid_bars >= 5 THEN 1 END) AS eligible_sessions, min(CASE WHEN valid_bars >= 5 THEN day END) AS first_eligible,
  max(CASE WHEN valid_bars >= 5 THEN day END) AS last_eligible, CASE WHEN entity = 'click' THEN 1 ELSE 2 END AS token FROM el GROUP BY entity""")
def _(spark, d):
    rows = views.minute_rows(spark, d)
    marked = days(spark, d).withColumn("eligible", F.col("valid_bars") >= 5)
    return ntz(b.universe_summary(marked, rows.select("entity", "token")))


# Readers and writers: the rows come from the tables, take a trip through files and must come back unchanged.
@query("scan_partitioned_bars", f"WITH {RAW} SELECT entity AS symbol, CAST(year(ts) AS BIGINT) AS year, count(*) AS rows, min(token) AS token, min(token) = max(token) AS one_token FROM mr GROUP BY 1, 2")
def _(spark, d):
    path = scratch_path(spark, "bars")
    rows = views.minute_rows(spark, d).select(
        F.col("ts").alias("timestamp"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"),
        F.col("token").alias("instrument_token"), F.col("entity").alias("symbol"), F.year("ts").alias("year"))
    wr.write_columnar(rows, path, ["timestamp"], partition_by=["symbol", "year"])
    return rd.partition_tokens(rd.scan_partitioned_bars(spark, path))


@query("write_columnar", final(M, "entity, session", "panel", "volume turnover"))
def _(spark, d):
    path = scratch_path(spark, "panel")
    wr.write_columnar(views.panel_month(spark, d), path, ["entity", "session"])
    return spark.read.parquet(path).select("entity", "session", "volume", "turnover")


@query("write_report_csv", final(M + ", shares AS (SELECT entity, session, turnover / 7 AS weekly FROM panel)", "entity, session", "shares", "weekly"))
def _(spark, d):
    path = scratch_path(spark, "report")
    weekly = views.panel_month(spark, d).select("entity", "session", (F.col("turnover") / 7).alias("weekly"))
    wr.write_report_csv(weekly, path, ["entity", "session"])
    return spark.read.option("header", True).schema("entity long, session date, weekly double").csv(path)


@query("column_pruned_read", """SELECT l_suppkey AS entity, count(*) AS rows, round(avg(l_quantity), 6) + 0.0 AS mean_quantity FROM lineitem GROUP BY 1""")
def _(spark, d):
    li = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_quantity")
    return li.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.avg("l_quantity").alias("mean_quantity"))


@query("scan_daily_two_formats", """SELECT CAST(l_orderkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'F' THEN 'EQ' ELSE 'BE' END AS series,
  l_extendedprice AS close, CAST(l_quantity AS BIGINT) AS volume, round(l_extendedprice * 100, 4) AS turnover, CASE WHEN l_shipdate >= DATE '1998-07-01' THEN 'IN' || l_partkey END AS isin,
  CASE WHEN l_shipdate >= DATE '1998-07-01' THEN 'NEW' ELSE 'OLD' END AS source_format FROM lineitem""")
def _(spark, d):
    li = views.table(spark, d, "lineitem")
    old_path, new_path = scratch_path(spark, "old"), scratch_path(spark, "new")
    date, price = F.col("l_shipdate").cast("date"), F.col("l_extendedprice")
    cut = date >= F.lit("1998-07-01").cast("date")
    series = F.when(F.col("l_linestatus") == "F", " EQ").otherwise("BE ")
    base = {"symbol": F.col("l_orderkey").cast("string"), "series": series, "open": price, "high": price, "low": price, "close": price,
            "volume": F.col("l_quantity").cast("long")}
    new_values = {**base, "date": F.date_format(date, "yyyy-MM-dd"), "turnover": price * 100, "isin": F.concat(F.lit("IN"), "l_partkey"),
                  "instrument_id": F.lit("1"), "security_name": F.lit("name")}
    # Old files state turnover in lakh and pad their header names.
    old_values = {**base, "date": F.date_format(date, "dd-MMM-yyyy"), "turnover": price * 100 / rd.LAKH}
    li.where(~cut).select(*[old_values[v].alias(f" {k}") for k, v in rd.OLD_COLUMNS.items()]).write.option("header", True).csv(old_path)
    li.where(cut).select(*[new_values[v].alias(k) for k, v in rd.NEW_COLUMNS.items()]).write.option("header", True).csv(new_path)
    out = rd.scan_daily_two_formats(spark, old_path, new_path)
    return out.select("symbol", "date", "series", "close", "volume", F.round("turnover", 4).alias("turnover"), "isin", "source_format")


@query("pick_canonical_file", """WITH a AS (SELECT 'file-' || o_orderkey AS source_name, CAST(o_orderdate AS DATE) AS file_date, (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem WHERE l_orderkey = o_orderkey) AS internal_date FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY internal_date ORDER BY file_date <> internal_date, source_name) AS k, count(*) OVER (PARTITION BY internal_date) AS candidate_files FROM a WHERE internal_date IS NOT NULL)
SELECT internal_date, source_name, file_date, file_date = internal_date AS file_date_matches, candidate_files FROM r WHERE k = 1""")
def _(spark, d):
    o, li = views.table(spark, d, "orders"), views.table(spark, d, "lineitem")
    first = li.groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("internal_date"))
    audit = o.join(first, o.o_orderkey == first.l_orderkey).select(
        F.concat(F.lit("file-"), "o_orderkey").alias("source_name"), F.col("o_orderdate").cast("date").alias("file_date"), "internal_date")
    return rd.pick_canonical_file(audit)


@query("scan_event_ledger", """WITH l AS (SELECT strftime(l_shipdate, '%Y%m%d') AS source_date, CAST(l_suppkey AS VARCHAR) AS symbol, l_linestatus AS series, CAST(l_shipdate AS DATE) AS date,
  l_returnflag AS valid FROM lineitem) SELECT *, sha256(symbol || '|' || series || '|' || source_date) AS duplicate_key_group FROM l""")
def _(spark, d):
    li = views.table(spark, d, "lineitem")
    path = scratch_path(spark, "ledger")
    values = {"DATE": F.date_format("l_shipdate", "yyyyMMdd"), "SYMBOL": F.col("l_suppkey").cast("string"), "SERIES": F.col("l_linestatus"),
              "valid": F.col("l_returnflag"), "adj_factor": F.col("l_discount").cast("string")}
    li.select(*[values.get(c, F.lit("0")).alias(c) for c in rd.LEDGER_COLUMNS]).write.option("header", True).csv(path)
    out = rd.scan_event_ledger(spark, path)
    return out.select("source_date", F.col("SYMBOL").alias("symbol"), F.col("SERIES").alias("series"), "date", "valid", "duplicate_key_group")


@query("scan_json_events", """SELECT CAST(l_suppkey AS VARCHAR) AS entity, l_linestatus AS series, CAST(l_partkey AS VARCHAR) AS isin, CAST(l_shipdate AS DATE) AS ex_date,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END AS record_date FROM lineitem""")
def _(spark, d):
    li = views.table(spark, d, "lineitem")
    path = scratch_path(spark, "official")
    day = F.date_format("l_shipdate", "dd-MMM-yyyy")
    values = {"symbol": F.col("l_suppkey").cast("string"), "series": F.col("l_linestatus"), "isin": F.col("l_partkey").cast("string"), "exDate": day,
              "recDate": F.when(F.col("l_returnflag") == "R", day).otherwise("-"), "subject": F.lit("DIVIDEND")}
    li.select(*[values.get(c, F.lit("")).alias(c) for c in rd.OFFICIAL_COLUMNS]).write.json(path)
    return rd.scan_json_events(spark, path, lines=True).select("entity", "series", "isin", "ex_date", "record_date")


@query("scan_headerless_membership", """WITH m AS (SELECT CAST(s_suppkey AS VARCHAR) AS entity, CAST(s_nationkey AS VARCHAR) AS group_code, s_acctbal >= 0 AS twice FROM supplier)
SELECT group_code, entity, 'MEMBER' AS issue, CASE WHEN twice THEN 2 ELSE 1 END AS records FROM m
UNION ALL SELECT group_code, entity, 'DUPLICATE_RECORD', 2 FROM m WHERE twice
UNION ALL SELECT group_code, '', 'BLANK_RECORD', count(*) FROM m WHERE twice GROUP BY 1
UNION ALL SELECT group_code, 'not ' || entity, 'MALFORMED_RECORD', 1 FROM m WHERE NOT twice""")
def _(spark, d):
    # One file for each nation; members and issues come back with the code in the file's name.
    path = scratch_path(spark, "members")
    sup = views.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), "s_acctbal", F.col("s_nationkey").cast("string").alias("n"))
    line = F.explode(F.when(F.col("s_acctbal") >= 0, F.array("s", "s", F.lit(" "))).otherwise(F.array("s", F.concat(F.lit("not "), "s"))))
    code = F.concat(F.lit("group_"), F.regexp_extract(F.col("_metadata.file_path"), "n=([0-9]+)", 1), F.lit(".csv"))
    sup.select("n", line.alias("value")).repartition("n").write.partitionBy("n").text(path)
    members, issues = rd.scan_headerless_membership(spark, path, name=code)
    out = members.select("group_code", "entity", F.lit("MEMBER").alias("issue"), F.col("copies").alias("records"))
    group = F.regexp_extract("source_file", r"_([^_]*)\.csv$", 1).alias("group_code")
    return out.unionByName(issues.select(group, "entity", "issue", "records"))


@query("file_inventory", """SELECT l_linenumber AS file, count(*) AS rows, CASE l_linenumber WHEN 1 THEN 'ADDED' WHEN 3 THEN 'CHANGED' ELSE 'SAME' END AS status FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL
UNION ALL SELECT 7, NULL, 'REMOVED'""")
def _(spark, d):
    # One file for each line number; the stored snapshot lacks one, has one more and other rows in a third.
    number = F.regexp_extract(F.col("_metadata.file_path"), "k=([0-9]+)", 1).cast("long")
    li = views.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), "l_orderkey", "l_partkey", "l_quantity")

    def inventory(rows):
        path = scratch_path(spark, "files")
        text = rows.select("k", F.to_json(F.struct("l_orderkey", "l_partkey", "l_quantity")).alias("value"))
        text.repartition("k").write.partitionBy("k").text(path)
        return rd.file_inventory(spark, path, name=number)

    now = inventory(li.where("k <> 7"))
    changes = rd.inventory_changes(now, inventory(li.where("k <> 1").withColumn("l_quantity", F.expr("l_quantity + if(k = 3, 1, 0)"))))
    return changes.join(now.select("file", "rows"), "file", "left").select("file", "rows", "status")


@query("source_coverage_audit", """SELECT 'orders.parquet' AS source_file, count(*) AS rows, CAST(min(o_orderdate) AS DATE) AS first_session, CAST(max(o_orderdate) AS DATE) AS last_session,
  TRUE AS schema_matches, max(o_orderdate) > DATE '2001-09-30' AS extends_past_cutoff FROM orders
UNION ALL SELECT 'lineitem.parquet', count(*), CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE), TRUE, max(l_shipdate) > DATE '2001-09-30' FROM lineitem""")
def _(spark, d):
    def one(name, column):
        return views.table(spark, d, name).select(F.col(column).cast("date").alias("session"), rd.file_name(F.col("_metadata.file_path")).alias("source_file"))

    both = one("orders", "o_orderdate").unionByName(one("lineitem", "l_shipdate"))
    return rd.source_coverage_audit(both, session="session", cutoff="2001-09-30", expected=["session"])


@query("reason_first_match", f"""WITH {M} SELECT entity, session, CASE WHEN NOT quality THEN 'LOW_VOLUME' WHEN close > 2000 THEN 'HIGH_PRICE' WHEN position < 12 THEN 'EARLY' ELSE '' END AS reason FROM panel""")
def _(spark, d):
    p = pp.positioned(spark, d)
    why = sc.first_reason([(~F.col("quality"), "LOW_VOLUME"), (F.col("close") > 2000, "HIGH_PRICE"), (F.col("position") < 12, "EARLY")])
    return p.select("entity", "session", why.alias("reason"))
