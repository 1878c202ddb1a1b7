"""Forms that must not change with size: cut cross-sections, rule tables, increments, labelled episodes, checked scans."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stratapanel.operators import bars as b
from stratapanel.operators import events as e
from stratapanel.operators import groups as g
from stratapanel.operators import influence as il
from stratapanel.operators import orderstats
from stratapanel.operators import portfolio as po
from stratapanel.operators import quality as qa
from stratapanel.operators.rolling import full_mean
from stratapanel.plans import views
from stratapanel.sources import readers as rd


def day(i):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=i)


def rounded(df, keys):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_leave_one_group_out_cut_or_not(spark, monkeypatch):
    """Ties, missing outcomes, rows without a group and a NULL pair; cross-sections of 400 rows, cut into pieces of 50 or whole."""
    rng = random.Random(4)
    rows = [(rng.choice([5, None]), day(t), i, rng.choice(["a", "b", None, "c"]), float(rng.randint(0, 40)), rng.choice([None, *[float(x) for x in range(9)]]))
            for t in range(3) for i in range(400)]
    pairs = spark.createDataFrame(rows, "formation int, session date, entity long, group_name string, rank double, outcome double")
    run = lambda: rounded(il.leave_one_group_out(pairs, ["a", "b", "none"], pair=["formation"], q=5), ["formation"])
    whole = run()
    monkeypatch.setattr(orderstats, "PIECE_ROWS", 50)
    assert run() == whole and len(whole) == 6


def test_leave_one_entity_out_cut_or_not(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(5, day(t), i, i + 0.0, rng.choice([float(x) for x in range(30)])) for t in range(2) for i in range(300)]
    pairs = spark.createDataFrame(rows, "formation int, session date, entity long, rank double, outcome double")
    run = lambda: rounded(il.leave_one_entity_out(pairs, pair=["formation"]), ["formation"])
    whole = run()
    monkeypatch.setattr(orderstats, "PIECE_ROWS", 64)
    assert run() == whole and len(whole) == 300


def test_event_study_counts_rows(spark, monkeypatch):
    """Against plain Python: repeated events, events of several classes, events without values, window over both ends."""
    rng = random.Random(6)
    calendar = spark.createDataFrame([(day(i), i) for i in range(12)], "session date, position int")
    values = {(x, i): (None if rng.random() < 0.1 else float(rng.randint(1, 50))) for x in range(4) for i in range(12) if rng.random() < 0.8}
    events = [(rng.randint(0, 5), day(rng.randint(0, 13)), f"e{rng.randint(0, 25)}", rng.choice(["m", "u"]), rng.choice(["s", "t", None])) for _ in range(60)]
    panel = spark.createDataFrame([(x, i, v) for (x, i), v in values.items()], "entity int, position int, volume double")
    frame = spark.createDataFrame(events, "entity int, session date, event_id string, impact string, action_class string")
    run = lambda: e.event_study(panel, frame, 2, ["volume"], calendar=calendar)
    want = {}
    for x, d, n, impact, kind in events:
        i = (d - day(0)).days
        for r in range(-2, 3) if i < 12 else ():
            if 0 <= i + r < 12:
                for c in (kind, "ALL_CLASSES"):
                    ids, found = want.setdefault((impact, c, r), (set(), []))
                    ids.add(n)
                    found += [values[x, i + r]] if values.get((x, i + r)) is not None else []
    for pieces in (1 << 20, 40):
        monkeypatch.setattr(orderstats, "PIECE_ROWS", pieces)
        got = {(r["impact"], r["action_class"], r["relative_session"]): r for r in run().collect()}
        assert set(got) == set(want)
        for k, (ids, found) in want.items():
            found.sort()
            mid = (found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2 if found else None
            assert (got[k]["source_events"], got[k]["matched_observations"], got[k]["volume_median"]) == (len(ids), len(found), mid)


def test_many_identity_rules_are_one_join(spark):
    rules = spark.range(10_000).select(F.concat(F.lit("n"), "id").alias("entity"), F.expr("date_add(DATE '2024-01-01', CAST(id % 5 AS INT))").alias("valid_from"))
    rules = rules.unionByName(spark.createDataFrame([("n3", day(9))], "entity string, valid_from date"))
    rows = spark.createDataFrame([(n, datetime.datetime(2024, 1, d, 9, 30), 1.0, 1.0, 1.0, 1.0, 1.0) for n in ("n3", "n4", "zz", None) for d in (4, 5, 9, 10)],
                                 "entity string, ts timestamp, open double, high double, low double, close double, volume double")
    spec = lambda floors: b.SessionRules([("08:00", "20:00")], b.override_frame(spark, [("2024-01-31", "X", "", False)]), floors)
    out = b.flag_minutes(rows, spec(rules))
    early = {(r["entity"], r["ts"].day) for r in out.where("before_identity").collect()}
    assert early == {("n3", 4), ("n3", 5), ("n3", 9), ("n4", 4)} and out.count() == 16
    length = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    few = b.flag_minutes(rows, spec(rules.limit(1)))
    assert length(out) < length(few) + 2_000


def test_increments_from_state_equal_the_whole(spark):
    """Gaps, new entities and several increments; only the state is read. Repeated and late rows fail the job."""
    rng = random.Random(7)
    rows = [(x, day(i), float(rng.randint(1, 9))) for x in range(6) for i in range(x * 4, 40) if rng.random() < 0.7]
    raw = spark.createDataFrame(rows, "entity int, session date, volume double")
    mean = lambda df: df.withColumn("m", full_mean("volume", 4, entity="entity", order="session"))
    state, out = qa.tail_state(raw.where(F.col("session") < F.lit(day(10))), 3, entity="entity", session="session"), []
    for lo, hi in ((10, 18), (18, 19), (19, 40)):
        added, state = qa.extend_from_state(state, raw.where(F.col("session").between(day(lo), day(hi - 1))), 3, entity="entity", session="session", recompute=mean)
        out += [tuple(r) for r in added.collect()]
        state = spark.createDataFrame(state.collect(), raw.schema)
        assert state.groupBy("entity").count().agg(F.max("count")).first()[0] <= 3
    assert sorted(out, key=str) == sorted((tuple(r) for r in mean(raw).where(F.col("session") >= F.lit(day(10))).collect()), key=str)
    last = state.orderBy(F.col("session").desc()).first()
    for bad, message in (((last["entity"], last["session"], 1.0), "duplicate key"), ((last["entity"], day(0), 1.0), "not later")):
        more = spark.createDataFrame([bad], raw.schema)
        with pytest.raises(Exception, match=message):
            qa.extend_from_state(state, more, 3, entity="entity", session="session", recompute=mean)[0].collect()


def test_episode_labels_cover_all_episodes(spark):
    rng, rows = random.Random(8), []
    for k in ("p", "q", None):
        v = 100.0
        for i in range(200):
            v = round(v * (1 + rng.uniform(-0.03, 0.031)), 2)
            rows.append((k, day(i), v))
    equity = spark.createDataFrame(rows, "portfolio_id string, session date, equity double")
    episodes = po.drawdown_episodes(equity, None).collect()
    want = {(x["portfolio_id"], day(i), x["episode_id"]) for x in episodes for i in range(200) if x["peak_session"] < day(i) <= x["trough_session"]}
    assert {tuple(r) for r in po.episode_sessions(equity).collect()} == want and len(episodes) > 30


BARS = "timestamp timestamp, open double, instrument_token long"


def test_scan_names_partitions_to_mend(spark, tmp_path):
    put = lambda rows, symbol, year: spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"symbol={symbol}" / f"year={year}"))
    at = lambda y: datetime.datetime(y, 3, 1, 10)
    put([(at(2023), 1.0, 7), (at(2023), 2.0, 7)], "007", 2023)
    put([(at(2024), 1.0, 8)], "M&M", 2024)
    assert rd.scan_partitioned_bars(spark, str(tmp_path)).count() == 3 and rd.partition_problems(spark, str(tmp_path)).count() == 0
    put([], "E", 2023)
    put([(at(2023), 1.0, 7), (at(2023), 1.0, 9)], "T", 2023)
    put([(at(2023), 1.0, 7), (at(2023), 1.0, None)], "N", 2023)
    put([(at(2022), 1.0, 7)], "Y", 2023)
    got = {(r["symbol"], r["year"], r["problem"]) for r in rd.partition_problems(spark, str(tmp_path)).collect()}
    assert got == {("E", 2023, "EMPTY_PARTITION"), ("T", 2023, "NOT_ONE_TOKEN"), ("N", 2023, "NOT_ONE_TOKEN"), ("Y", 2023, "WRONG_YEAR")}
    with pytest.raises(ValueError, match="E/2023 EMPTY_PARTITION"):
        rd.scan_partitioned_bars(spark, str(tmp_path))


def test_ledger_ids_and_records(spark, tmp_path):
    """Every record as JSON with sorted fields, and ids that tell copies apart."""
    import hashlib
    import json

    values = [dict(zip(rd.LEDGER_COLUMNS, v, strict=True)) for v in (["20240105", "A&B", "EQ", "10", "1.0", "0", 'say "x"', "0", "0", "0"], ["20240106", "C", "BE", "", "0.5", "0", "merger", "0", "1", "0"])]
    quoted = lambda v: '"' + v.replace('"', '\\"') + '"'
    lines = [",".join(quoted(r[c]) for c in rd.LEDGER_COLUMNS) for r in (values[0], values[0], values[1])]
    (tmp_path / "ev_2024.csv").write_text(",".join(rd.LEDGER_COLUMNS) + "\n" + "\n".join(lines) + "\n")
    got = rd.scan_event_ledger(spark, str(tmp_path)).collect()
    want = []
    for r, copies in ((values[0], 2), (values[1], 1)):
        record = json.dumps({c: r[c] for c in sorted(rd.LEDGER_COLUMNS)}, separators=(",", ":"))
        want += [(record, hashlib.sha256(f"ev_2024.csv:{n}:{record}".encode()).hexdigest()) for n in range(1, copies + 1)]
    assert sorted((r["source_record_json"], r["event_id"]) for r in got) == sorted(want)


def test_event_on_day_lists_its_ids(spark):
    """Whole list of ids in text order, each once, beside the count; other days and rows without events have none."""
    panel = spark.createDataFrame([(1, day(0)), (1, day(1)), (2, day(0))], "entity int, session date")
    events = spark.createDataFrame([(1, day(0), "m", 10), (1, day(0), "k", 9), (1, day(0), "m", 10), (1, day(0), "k", 10), (2, day(3), "m", 7)], "entity int, session date, impact string, event_id long")
    got = {(r["entity"], r["session"]): (r["event_status"], r["event_ids"], r["event_count"]) for r in e.event_on_day(panel, events).collect()}
    assert got == {(1, day(0)): ("k|m", "10|9", 2), (1, day(1)): ("NO_RECORDED_EVENT", "", 0), (2, day(0)): ("NO_RECORDED_EVENT", "", 0)}


def test_identity_aliases_list_the_others(spark):
    """The whole group of the last shared identifier, without the entity itself, in the order of entities."""
    rows = [(2, "a", day(0)), (10, "a", day(0)), (3, "a", day(1)), (3, "b", day(0)), (4, "b", day(0)), (4, "b", day(1)), (4, "c", day(0)), (5, None, day(0)), (6, "d", day(0))]
    got = {r["entity"]: r for r in g.identity_aliases(spark.createDataFrame(rows, "entity int, isin string, session date")).collect()}
    found = {k: (r["shared_identifier"], r["known_alias"], r["alias_count"], r["identifier_count"]) for k, r in got.items()}
    assert found == {2: ("a", "3|10", 2, 1), 10: ("a", "2|3", 2, 1), 3: ("b", "4", 1, 2), 4: ("b", "3", 1, 2), 5: (None, "", 0, 0), 6: (None, "", 0, 1)}
    assert got[4]["continuity_status"] == "SHARED_IDENTIFIER_NOT_STITCHED" and got[5]["continuity_status"] == "OBSERVED_NOT_STITCHED"


def test_tasks_of_ranks_grow_with_rows(spark, monkeypatch):
    """Ranks of many cross-sections: the number of tasks follows the rows, one sort for each column; results as in plain Python."""
    from stratapanel import runtime

    rng = random.Random(9)
    nan = float("nan")
    rows = [(t, i, rng.choice([None, nan, -0.0, 0.0, *map(float, range(5))]), rng.random()) for t in range(40) for i in range(50)]
    frame = runtime.stage(spark.createDataFrame(rows, "session int, entity int, x double, y double"))
    monkeypatch.setattr(runtime, "TASK_ROWS", 50)
    out = orderstats.average_ranks_within(frame, ["session"], {"rx": "x", "ry": "y"}, size="n")
    assert out.rdd.getNumPartitions() == 40
    assert orderstats.ordinal_within(frame, ["session"], "y", "entity").rdd.getNumPartitions() == 40
    plan = out._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[-1].split("== Initial Plan ==")[-1].count("Sort [") == 2
    key = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    for t in (0, 17):
        line = sorted(key(x) for s, _, x, _ in rows if s == t)
        got = {r["entity"]: (r["rx"], r["n"]) for r in out.where(F.col("session") == t).collect()}
        assert got == {i: (line.index(key(x)) + (line.count(key(x)) + 1) / 2, 50) for s, i, x, _ in rows if s == t}


def test_tasks_of_the_panel_grow_with_lines(spark, sf, monkeypatch):
    """Lines of a large table are dealt before they are added up, so no task holds sums of keys that are not its own; the panel stays the same."""
    for panel in (views.panel_month, views.panel_week):
        monkeypatch.undo()
        whole = rounded(panel(spark, sf), ["entity"])
        monkeypatch.setattr(views, "LINE_ROWS", 100)
        dealt = panel(spark, sf)
        lines = views.table(spark, sf, "lineitem").count()
        assert dealt.rdd.getNumPartitions() == -(-lines // 100) and rounded(dealt, ["entity"]) == whole


def test_deletions_shuffle_rows_once(spark, monkeypatch):
    """Each row without its group's others, ranked anew: ties, a constant outcome, groups of 1 to 40; the same from cut groups; no copies of rows for digits."""
    rng = random.Random(11)
    rows = [(5, day(t), i, i * 2.0, 3.0 if t == 6 else float(rng.randint(0, 9))) for t, n in enumerate((1, 2, 3, 11, 12, 40, 15)) for i in rng.sample(range(n), n)]
    pairs = spark.createDataFrame(rows, "formation int, session date, entity long, rank double, outcome double")
    out = il.deletion_statistics(pairs, keys=["formation", "session"])
    plan = out._jdf.queryExecution().toString()
    assert "Generate" not in plan and plan.split("== Physical Plan ==")[-1].split("== Initial Plan ==")[-1].count("Exchange") == 1
    got, n = rounded(out, ["formation"]), 0
    mean = lambda v: sum(v) / len(v)
    for r in out.collect():
        rest = sorted((x, o) for _, s, i, x, o in rows if s == r["session"] and i != r["entity"])
        o, m = [v for _, v in rest], len(rest)
        ranks = [sorted(o).index(v) + (o.count(v) + 1) / 2 for v in o]
        c = (m + 1) / 2
        sxy, syy = sum((i + 1 - c) * (y - c) for i, y in enumerate(ranks)), sum((y - c) ** 2 for y in ranks)
        want = sxy / (syy * (m**3 - m) / 12) ** 0.5 if m >= 2 and syy else None
        spread = mean([v for i, v in enumerate(o) if i * 10 // m == 9]) - mean([v for i, v in enumerate(o) if i * 10 // m == 0]) if m >= 10 else None
        assert r["observations"] == m + 1
        assert r["ic_without"] == (want if want is None else pytest.approx(want)) and r["spread_without"] == (spread if spread is None else pytest.approx(spread))
        n += 1
    assert n == len(rows)
    monkeypatch.setattr(orderstats, "PIECE_ROWS", 8)
    assert rounded(il.deletion_statistics(pairs, keys=["formation", "session"]), ["formation"]) == got
