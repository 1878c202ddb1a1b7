"""Queries: candidates, checked joins, set operations, reconciliation, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import candidates as cd
from stratapanel.operators import quality as qa
from stratapanel.operators import ranks as rk
from stratapanel.operators import rolling as ro
from stratapanel.plans import panels as pp
from stratapanel.plans import sql as s
from stratapanel.plans import views
from stratapanel.plans.q_core import M, _baseline_sql, _full, _price_sql, crossed_panel
from stratapanel.plans.registry import final, query
from stratapanel.runtime import stage

CAND = f"""{M}, {s.EVENTS}, {_baseline_sql(20)}, {_price_sql(5)},
cj AS (SELECT s.entity, s.session, valid_volume_baseline_20 AS vv, volume_baseline_20_invalid_reason AS vr, valid_price_return_5 AS pv,
  price_return_5_invalid_reason AS prr, log_volume_surprise_20 AS lv, price_return_5 AS p5 FROM surprise s JOIN pr USING (entity, session)),
cl AS (SELECT session, quantile_cont(lv, 0.01) AS lo, quantile_cont(lv, 0.99) AS hi FROM cj WHERE vv GROUP BY 1),
cw AS (SELECT cj.*, CASE WHEN vv THEN greatest(least(lv, hi), lo) END AS wv FROM cj LEFT JOIN cl USING (session)),
cv AS (SELECT entity, session, p5 AS c_price, lv AS c_volume, p5 * CASE WHEN wv IS NOT NULL THEN greatest(wv, 0) END AS c_amplified,
  sign(p5) * CASE WHEN wv IS NOT NULL THEN greatest(wv, 0) END AS c_signed, -p5 AS c_reversal,
  CASE WHEN NOT pv THEN prr WHEN NOT vv THEN vr ELSE '' END AS reason FROM cw)"""


def candidate_panel(spark, d):
    p = ro.volume_surprise(ro.prior_volume_baseline(crossed_panel(spark, d, (5, 20)), (20,), crossing="crossing"), (20,))
    p = ro.price_return(p, (5,), crossing="crossing")
    p = rk.winsorize_same_date(p, "log_volume_surprise_20", 0.01, 0.99, mask="valid_volume_baseline_20", out="surprise")
    return cd.candidate_values(p, {
        "c_price": cd.control("price_return_5"), "c_volume": cd.control("log_volume_surprise_20"),
        "c_amplified": cd.amplified("price_return_5", "surprise"), "c_signed": cd.signed("price_return_5", "surprise"),
        "c_reversal": cd.reversal("price_return_5")})


@query("candidate_values", final(CAND, "entity, session", "cv", "c_price c_volume c_amplified c_signed c_reversal"))
def _(spark, d):
    return candidate_panel(spark, d).select("entity", "session", "c_price", "c_volume", "c_amplified", "c_signed", "c_reversal")


@query("candidate_reason", final(CAND, "entity, session, reason", "cv"))
def _(spark, d):
    out = cd.candidate_reason(candidate_panel(spark, d), "reason", [
        ("valid_price_return_5", "price_return_5_invalid_reason"), ("valid_volume_baseline_20", "volume_baseline_20_invalid_reason")])
    return out.select("entity", "session", "reason")


@query("column_denylist_check", final(M, "entity, session", "panel", "volume"))
def _(spark, d):
    p = views.panel_month(spark, d).select("entity", "session", "volume")
    return qa.column_denylist_check(p, ["future", "outcome", "pnl"])


@query("validated_left_join", f"WITH {M}, {s.NATION} SELECT panel.entity, session, group_name, group_code FROM panel LEFT JOIN (SELECT * FROM groups WHERE NOT identity_ambiguous) g ON g.entity = panel.entity")
def _(spark, d):
    known = views.groups_nation(spark, d).where("NOT identity_ambiguous").select("entity", "group_name", "group_code")
    return qa.validated_left_join(views.panel_month(spark, d).select("entity", "session"), known, ["entity"])


@query("incremental_extend", f"""WITH {M}, liq AS (SELECT entity, session, volume, {_full('volume', 5)} AS avg_volume_5 FROM panel)
SELECT entity, session, CASE WHEN session < DATE '2001-01-01' THEN -1.0 ELSE round(avg_volume_5, 6) + 0.0 END AS avg_volume_5 FROM liq""")
def _(spark, d):
    # Accepted rows carry a marker value that a recomputation would overwrite.
    # Two increments follow, each from the last rows of every entity, which the one before it has stored.
    raw = stage(pp.positioned(spark, d).select("entity", "session", "position", "volume"))
    day = lambda text: F.lit(text).cast("date")
    mean = lambda df: df.withColumn("avg_volume_5", ro.full_mean("volume", 5, entity="entity", order="position"))
    accepted = raw.where(F.col("session") < day("2001-01-01"))
    state = stage(qa.tail_state(accepted, 4, entity="entity", session="session"))
    out = accepted.withColumn("avg_volume_5", F.lit(-1.0))
    for first, last in (("2001-01-01", "2001-07-01"), ("2001-07-01", "9999-01-01")):
        new = raw.where((F.col("session") >= day(first)) & (F.col("session") < day(last)))
        added, state = qa.extend_from_state(state, new, 4, entity="entity", session="session", recompute=mean)
        state, out = stage(state), out.unionByName(added)
    return out.select("entity", "session", "avg_volume_5")


KEYS_A = "SELECT DISTINCT l_suppkey AS entity, l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'"
KEYS_B = "SELECT DISTINCT l_suppkey AS entity, l_partkey AS part FROM lineitem WHERE l_returnflag = 'A'"


@query("set_ops", f"""SELECT entity, part, 'UNION' AS kind FROM ({KEYS_A} UNION {KEYS_B}) UNION ALL SELECT entity, part, 'BOTH' FROM ({KEYS_A} INTERSECT {KEYS_B})
UNION ALL SELECT entity, part, 'ONLY_LEFT' FROM ({KEYS_A} EXCEPT {KEYS_B})""")
def _(spark, d):
    li = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("part"), "l_returnflag")
    a, b = (li.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("R", "A"))
    kinds = {"union": "UNION", "intersect": "BOTH", "difference": "ONLY_LEFT"}
    parts = [qa.set_operation(a, b, k).withColumn("kind", F.lit(v)) for k, v in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Expected = every line; actual = the same lines without some, with changed sides and prices, plus others.
REC = """e AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_linestatus AS side, l_quantity AS quantity, l_extendedprice AS price FROM lineitem WHERE l_discount < 0.09),
a AS (SELECT l_orderkey AS order_id, l_linenumber AS line, CASE WHEN l_tax >= 0.08 THEN 'X' ELSE l_linestatus END AS side,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_quantity + 1 ELSE l_quantity END AS quantity, l_extendedprice + CASE WHEN l_tax <= 0.01 THEN 0.005 WHEN l_tax <= 0.02 THEN 5 ELSE 0 END AS price
  FROM lineitem WHERE l_discount > 0.01),
ee AS (SELECT order_id, line, min(struct_pack(side, quantity, price)) AS r FROM e GROUP BY 1, 2), aa AS (SELECT order_id, line, min(struct_pack(side, quantity, price)) AS r FROM a GROUP BY 1, 2),
rec AS (SELECT coalesce(ee.order_id, aa.order_id) AS order_id, coalesce(ee.line, aa.line) AS line, ee.r.side AS expected_side, aa.r.side AS actual_side,
  CASE WHEN ee.r IS NULL THEN 'EXTRA' WHEN aa.r IS NULL THEN 'MISSING' WHEN ee.r.side <> aa.r.side THEN 'SIDE_MISMATCH' WHEN abs(ee.r.quantity - aa.r.quantity) > 0.01 THEN 'QUANTITY_MISMATCH'
   WHEN abs(ee.r.price - aa.r.price) > 0.01 THEN 'PRICE_MISMATCH' ELSE 'EXACT' END AS result FROM ee FULL JOIN aa ON ee.order_id = aa.order_id AND ee.line = aa.line)"""


def reconciled(spark, d):
    li = views.table(spark, d, "lineitem")
    keys = [F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")]
    expected = li.where("l_discount < 0.09").select(
        *keys, F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    actual = li.where("l_discount > 0.01").select(
        *keys, F.when(F.col("l_tax") >= 0.08, "X").otherwise(F.col("l_linestatus")).alias("side"),
        F.expr("CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_quantity + 1 ELSE l_quantity END").alias("quantity"),
        F.expr("l_extendedprice + CASE WHEN l_tax <= 0.01D THEN 0.005D WHEN l_tax <= 0.02D THEN 5D ELSE 0D END").alias("price"))
    return qa.table_reconcile(expected, actual, keys=["order_id", "line"], exact=["side"], numeric=["quantity", "price"])


@query("table_reconcile", f"WITH {REC} SELECT order_id, line, expected_side, actual_side, result FROM rec")
def _(spark, d):
    return reconciled(spark, d).select("order_id", "line", "expected_side", "actual_side", "result")


@query("table_reconcile_first_divergence", f"""WITH {REC}, b AS (SELECT line, min(struct_pack(order_id, result)) AS f FROM rec WHERE result <> 'EXACT' GROUP BY 1)
SELECT rec.line, count(*) AS compared_rows, count(CASE WHEN result = 'EXACT' THEN 1 END) AS exact_rows, any_value(f.order_id) AS first_order_id, any_value(f.result) AS first_result
FROM rec LEFT JOIN b ON b.line = rec.line GROUP BY 1""")
def _(spark, d):
    return qa.first_divergence(reconciled(spark, d), by=["line"], order=["order_id"])


@query("check_suite", """WITH c AS (SELECT count(*) AS n, count(CASE WHEN NOT (l_quantity > 0) THEN 1 END) AS a, count(CASE WHEN NOT (l_discount <= 0.09) THEN 1 END) AS b,
  count(CASE WHEN NOT (l_returnflag IN ('A', 'N', 'R')) THEN 1 END) AS c FROM lineitem),
u AS (SELECT CAST(coalesce(sum(CASE WHEN k > 1 THEN k END), 0) AS BIGINT) AS f, CAST(sum(k) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber))
SELECT 'lineitem' AS table_name, 'positive_quantity' AS check_name, a = 0 AS passed, a AS failing_rows, n AS rows FROM c UNION ALL SELECT 'lineitem', 'discount_range', b = 0, b, n FROM c
UNION ALL SELECT 'lineitem', 'label_set', c = 0, c, n FROM c UNION ALL SELECT 'lineitem', 'unique_key', f = 0, f, n FROM u""")
def _(spark, d):
    return qa.check_suite(views.table(spark, d, "lineitem"), "lineitem", {
        "positive_quantity": F.col("l_quantity") > 0, "discount_range": F.col("l_discount") <= 0.09,
        "label_set": F.col("l_returnflag").isin("A", "N", "R")}, keys=["l_orderkey", "l_linenumber"])


@query("table_fingerprint", f"""WITH h AS (SELECT {s.row_hashes(["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])} FROM lineitem)
SELECT count(*) AS rows, CAST(sum(h1) AS VARCHAR) AS hash_sum, CAST(sum(h2) AS VARCHAR) AS hash_sum_2, bit_xor(h1) AS hash_xor, bit_xor(h2) AS hash_xor_2 FROM h""")
def _(spark, d):
    return qa.table_fingerprint(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])


@query("lossless_check", """WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.1), sk AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2),
dk AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM d GROUP BY 1, 2), w AS (SELECT coalesce(sk.n, 0) - coalesce(dk.n, 0) AS w FROM sk LEFT JOIN dk USING (l_orderkey, l_linenumber))
SELECT CAST(sum(greatest(w, 0)) AS BIGINT) AS missing_rows, CAST(sum(greatest(-w, 0)) AS BIGINT) AS extra_rows, sum(abs(w)) = 0 AS lossless FROM w""")
def _(spark, d):
    li = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return qa.lossless_check(li, li.where("l_discount < 0.1"), ["l_orderkey", "l_linenumber"])
