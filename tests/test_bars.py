"""Minute bars, session rules and readers on hand-made files."""

from datetime import datetime, timedelta

import pytest

from stratapanel.operators import bars as b
from stratapanel.operators.events import event_classify, identity_attach, subject_classify
from stratapanel.sources import readers as rd


def rules(spark, overrides=()):
    rows = list(overrides) or [("1999-01-01", "NONE", "", False)]
    return b.SessionRules([("09:15", "15:30")], b.override_frame(spark, rows))


def minutes(spark, start="2025-01-06 09:15", n=375, entity="A", patch=None):
    t = datetime.fromisoformat(start)
    rows = [[entity, t + timedelta(minutes=i), 100.0, 103.0, 99.0, 102.0, 10.0] for i in range(n)]
    for i, change in (patch or {}).items():
        for k, v in change.items():
            rows[i][k] = v
    return spark.createDataFrame([tuple(r) for r in rows], "entity string, ts timestamp, open double, high double, low double, close double, volume double")


def bar(spark, df, **kw):
    return b.session_quality(b.bars_from_minutes(df, rules(spark, **kw))).collect()


def test_complete_day(spark):
    (r,) = bar(spark, minutes(spark))
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (100, 103, 99, 102, 3750)
    assert r["valid_bars"] == 375 and r["missing_expected_minutes"] == 0 and r["session_quality"] == "NORMAL_COMPLETE"
    assert r["open_is_scheduled_first"] and r["close_is_scheduled_last"]
    assert r["bar_available_at"] == datetime(2025, 1, 6, 15, 30)


def test_bad_open_moves_the_open_on(spark):
    (r,) = bar(spark, minutes(spark, patch={0: {2: -1.0}, 1: {2: 101.0}}))
    assert r["open"] == 101 and r["invalid_ohlc_minutes"] == 1 and r["session_quality"] == "DATA_QUALITY_ISSUE"
    assert r["open_quality"] == "LATER_OBSERVED_OPEN"


def test_every_copy_of_a_duplicate_is_bad(spark):
    df = minutes(spark)
    df = df.union(df.limit(1))
    (r,) = bar(spark, df)
    assert r["duplicate_minutes"] == 2 and r["valid_bars"] == 374
    out = b.minute_exclusions(df, rules(spark)).collect()
    assert [x["exclusion_reason"] for x in out] == ["DUPLICATE_TIMESTAMP"] * 2


def test_day_without_good_minutes_keeps_null_prices(spark):
    (r,) = bar(spark, minutes(spark, n=3, patch={i: {6: -5.0} for i in range(3)}))
    assert r["open"] is None and r["volume"] == 0 and r["other_invalid_minutes"] == 3 and r["open_quality"] == "NO_VALID_MINUTES"


def test_special_and_unknown_sessions(spark):
    over = [("2025-01-11", "EVENING", "18:00-19:00", False), ("2025-01-13", "SPLIT", "09:15-10:00|11:30-12:30", False)]
    (evening,) = bar(spark, minutes(spark, "2025-01-11 18:00", 60), overrides=over)
    assert evening["session_quality"] == "KNOWN_SPECIAL_COMPLETE" and evening["expected_minutes"] == 60
    (weekend,) = bar(spark, minutes(spark, "2025-01-12 09:15", 5), overrides=over)
    assert weekend["session_quality"] == "UNKNOWN_IRREGULAR" and weekend["missing_expected_minutes"] is None
    (split,) = bar(spark, minutes(spark, "2025-01-13 09:15", 45), overrides=over)
    assert split["missing_expected_minutes"] == 60 and split["session_quality"] == "PARTIAL_SYMBOL_SPECIFIC"


def test_two_short_entities_share_the_blame(spark):
    df = minutes(spark, n=300).union(minutes(spark, n=300, entity="B"))
    assert {r["session_quality"] for r in bar(spark, df)} == {"PARTIAL_SHARED_MARKET_EVENT"}
    one = minutes(spark, n=300).union(minutes(spark, entity="B"))
    assert {r["entity"]: r["session_quality"] for r in bar(spark, one)} == {"A": "PARTIAL_SYMBOL_SPECIFIC", "B": "NORMAL_COMPLETE"}


def test_several_tokens_fail_the_job(spark):
    days = b.row_eligibility(b.session_quality(b.bars_from_minutes(minutes(spark), rules(spark))))
    tokens = spark.createDataFrame([("A", 1), ("A", 2)], "entity string, token long")
    with pytest.raises(Exception, match="several tokens"):
        b.universe_summary(days, tokens).collect()


def test_two_daily_layouts(spark, tmp_path):
    old = tmp_path / "old.csv"
    new = tmp_path / "new.csv"
    old.write_text("SYMBOL, SERIES, DATE1, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY, TURNOVER_LACS\n"
                   "ABC, EQ, 02-Jan-2024, 10, 12, 9, 11, 100, 0.011\n")
    new.write_text("TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol,TtlTrfVal,ISIN,FinInstrmId,FinInstrmNm\n"
                   "2024-07-08,ABC,EQ,10,12,9,11,100,1100,IN1,77,Abc Ltd\n")
    rows = {r["source_format"]: r for r in rd.scan_daily_two_formats(spark, str(old), str(new)).collect()}
    assert rows["OLD"]["turnover"] == pytest.approx(1100) and rows["OLD"]["isin"] is None and str(rows["OLD"]["date"]) == "2024-01-02"
    assert rows["NEW"]["turnover"] == 1100 and rows["NEW"]["isin"] == "IN1" and rows["NEW"]["volume"] == 100


def test_headerless_membership(spark, tmp_path):
    (tmp_path / "auto_parts_AP.csv").write_text("AAA\n\nBBB\nAAA\nbad symbol\n")
    (tmp_path / "banks_BK.csv").write_text("BBB\n")
    members, issues = rd.scan_headerless_membership(spark, str(tmp_path))
    got = sorted((r["group_name"], r["group_code"], r["entity"], r["copies"]) for r in members.collect())
    assert got == [("auto_parts", "AP", "AAA", 2), ("auto_parts", "AP", "BBB", 1), ("banks", "BK", "BBB", 1)]
    assert sorted((r["issue"], r["entity"]) for r in issues.collect()) == [
        ("BLANK_RECORD", ""), ("DUPLICATE_RECORD", "AAA"), ("MALFORMED_RECORD", "bad symbol")]


def test_json_events_and_inventory(spark, tmp_path):
    record = {c: "" for c in rd.OFFICIAL_COLUMNS} | {"symbol": "ABC", "exDate": "05-Aug-2024", "recDate": "-", "subject": "Bonus 1:1"}
    import json

    (tmp_path / "e.json").write_text(json.dumps([record]))
    (r,) = rd.scan_json_events(spark, str(tmp_path / "e.json")).collect()
    assert str(r["ex_date"]) == "2024-08-05" and r["record_date"] is None
    inv = rd.file_inventory(spark, str(tmp_path))
    before = inv.first()
    assert before["rows"] == 1 and before["size"] == (tmp_path / "e.json").stat().st_size
    (tmp_path / "e.json").write_text(json.dumps([record | {"subject": "Bonus 1:2"}]))
    inv = rd.file_inventory(spark, str(tmp_path))
    assert inv.first()["size"] == before["size"] and inv.first()["sha256"] != before["sha256"]
    gone = spark.createDataFrame([("old.json", "x"), ("e.json", "y")], "file string, sha256 string")
    assert {x["file"]: x["status"] for x in rd.inventory_changes(inv, gone).collect()} == {"old.json": "REMOVED", "e.json": "CHANGED"}


def test_repeated_ledger_rows_get_their_own_ids(spark, tmp_path):
    line = "20240105,ABC,EQ,10,1.0,0,dividend,0,0,0\n"
    (tmp_path / "ev_2024.csv").write_text(",".join(rd.LEDGER_COLUMNS) + "\n" + line + line)
    rows = rd.scan_event_ledger(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and len({r["event_id"] for r in rows}) == 2 and len({r["duplicate_key_group"] for r in rows}) == 1


def test_wrong_year_partition_fails(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 2), 1.0)], "timestamp timestamp, open double").write.parquet(str(tmp_path / "symbol=A" / "year=2023"))
    with pytest.raises(Exception, match="outside its year"):
        rd.scan_partitioned_bars(spark, str(tmp_path), check=False).select("timestamp").collect()


@pytest.mark.parametrize("text,kind,safety", [
    ("Face  value split From Rs 10", "SPLIT_OR_FACE_VALUE_CHANGE", "BLOCK_PRICE_RETURN_INTERVAL"), ("bonus 1:1", "BONUS", "BLOCK_PRICE_RETURN_INTERVAL"),
    ("Interim Dividend", "DIVIDEND", "NONBLOCKING_INFORMATIONAL"), ("Buy back of shares", "BUYBACK", "NONBLOCKING_INFORMATIONAL"),
    ("Annual meeting", "OTHER_OR_UNKNOWN", "REVIEW_REQUIRED_BLOCKED"), ("Scheme of arrangement and dividend", "SCHEME_OR_SPECIAL_DISTRIBUTION", "BLOCK_PRICE_RETURN_INTERVAL")])
def test_subjects(spark, text, kind, safety):
    r = subject_classify(spark.createDataFrame([(text,)], "subject string")).first()
    assert (r["action_type"], r["safety"]) == (kind, safety)


def test_event_labels_need_evidence(spark):
    src = spark.createDataFrame(
        [("A", "20240101", "adj_factor_nonan", "0", "2.0"), ("A", "20240102", "adj_factor_nonan", "0", "2.0"), ("B", "20240101", "dividend", "0", "x"),
         ("B", "20240103", "dividend", "1", ""), ("C", "20240101", "odd", "0", "")], "symbol string, date string, valid string, merger string, adj_factor string")
    evidence = spark.createDataFrame([("A", "20240101", 2.0)], "symbol string, date string, factor double")
    got = {(r["symbol"], r["date"]): (r["action_class"], r["ambiguous"]) for r in event_classify(src, evidence).collect()}
    assert got == {("A", "20240101"): ("CONVENTIONAL_ACTION_SUPPORTED_BY_PHASE1", False), ("A", "20240102"): ("UNSPECIFIED_FACTOR_EVENT", True),
                   ("B", "20240101"): ("DIVIDEND", False), ("B", "20240103"): ("DIVIDEND", True), ("C", "20240101"): ("UNCLASSIFIED", True)}


def test_identity_is_exact_and_conflicts_block(spark):
    ev = spark.createDataFrame([("A", "I1", "OK"), ("A", "I9", "OK"), ("Z", "I1", "OK")], "entity string, isin string, safety string")
    obs = spark.createDataFrame([("A", "I1"), ("A", "I2")], "entity string, isin string")
    got = {(r["entity"], r["isin"]): (r["identity_status"], r["safety"]) for r in identity_attach(ev, obs).collect()}
    assert got == {("A", "I1"): ("IDENTIFIER_OBSERVED", "OK"), ("A", "I9"): ("IDENTIFIER_CONFLICT", "REVIEW_REQUIRED_BLOCKED"), ("Z", "I1"): ("NOT_OBSERVED", "OK")}


def test_a_file_with_swapped_columns_fails(spark, tmp_path):
    from stratapanel.sources import readers

    names = readers.LEDGER_COLUMNS
    swapped = [names[0], names[2], names[1], *names[3:]]
    for i, header in enumerate((names, swapped)):
        row = {n: "1" for n in names} | {"DATE": "20240102", "SYMBOL": f"S{i}", "SERIES": "EQ"}
        (tmp_path / f"{i}.csv").write_text(",".join(header) + "\n" + ",".join(row[n] for n in header) + "\n")
    assert readers.scan_event_ledger(spark, str(tmp_path / "0.csv")).count() == 1
    with pytest.raises(Exception, match="header"):
        readers.scan_event_ledger(spark, str(tmp_path)).collect()
