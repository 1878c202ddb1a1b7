"""Streams in several batches: late, split and idle input."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stratapanel.operators.signals import hysteresis_select
from stratapanel.streaming import streams as st


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


class Source:
    """A folder whose files are batches, one each."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, root, schema

    def add(self, rows):
        df = rows if not isinstance(rows, list) else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.root)
        return self

    def read(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.root)


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def drain(stream):
        """Runs what is there; called again for the same stream it goes on where it stopped."""
        check = tmp_path / "check"
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    return drain


TICKS = "entity string, ts timestamp, price double, sequence long"


def test_bars_of_two_sources_close(spark, tmp_path, run):
    """Ties of ts follow the sequence; an idle source holds bars back until its marker comes."""
    a = Source(spark, str(tmp_path / "a"), TICKS).add([("x", at(1), 1.0, 2), ("x", at(1), 5.0, 1)]).add([("x", at(8), 9.0, 4), ("x", at(8), 2.0, 3)]).add([("x", at(14), 3.0, 5)])
    b = Source(spark, str(tmp_path / "b"), TICKS).add([("y", at(3), 7.0, 1)])
    bars = lambda: st.stream_bars(a.read(), b.read(), length="10 minutes", delay="1 minute", sequence="sequence").select("entity", "open", "high", "low", "close", "volume")
    assert run(bars()) == []
    ends = st.closing_marker(spark.createDataFrame([], TICKS), at(21))
    b.add(ends)
    a.add(ends)
    assert sorted(run(bars())) == [("x", 3.0, 3.0, 3.0, 3.0, 1), ("x", 5.0, 9.0, 1.0, 9.0, 4), ("y", 7.0, 7.0, 7.0, 7.0, 1)]


RANKS = "k string, signal_index long, item string, rank long, ts timestamp"


def signal(t, items, k="a"):
    return [(k, t, i, r, at(10 * t)) for r, i in enumerate(items, 1)]


def test_hysteresis_over_batches(spark, tmp_path, run):
    """A signal split over two batches equals the batch result; a late one is rejected by name; items keep any character."""
    rng = random.Random(1)
    names = ["p|q", "", "q", "|", "r", "é", "s", "t u"]
    rows = [row for t in range(12) if t != 7 for row in signal(t, rng.sample(names, 7))]
    want = sorted(tuple(r) for r in hysteresis_select(spark.createDataFrame(rows, RANKS), keys=["k"]).collect())
    src = Source(spark, str(tmp_path / "in"), RANKS)
    split = [row for row in rows if row[1] == 5]
    src.add([row for row in rows if row[1] < 5] + split[::2]).add(split[1::2] + [row for row in rows if row[1] in (6, 8)])
    src.add(signal(3, ["late|one", "q"])).add([row for row in rows if row[1] > 8])
    src.add(st.closing_marker(spark.createDataFrame([], RANKS), at(10_000)))
    got = run(st.stream_hysteresis(src.read(), key="k", delay="10 minutes"))
    assert sorted(r for r in got if r[4] != "REJECTED_LATE") == want and len(want) > 25
    assert sorted(r for r in got if r[4] == "REJECTED_LATE") == [("a", 3, "late|one", 1, "REJECTED_LATE"), ("a", 3, "q", 2, "REJECTED_LATE")]


def test_increment_replays(spark, tmp_path):
    """A replayed batch adds nothing, also when its first attempt was broken off; batches are written by several tasks."""
    path, schema = str(tmp_path / "store"), "e long, session date, v double"
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    batch = lambda lo, hi, v: spark.createDataFrame([(e, day(i), v) for e in range(5) for i in range(lo, hi)], schema).repartition(4)
    empty = spark.createDataFrame([], schema)
    st.create_store(spark, empty.schema, path)
    write = st.increment_writer(path, ["e", "session"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # batches this small would be one task
    write(batch(0, 6, 1.0), 0)
    write(batch(0, 6, 1.0), 0)
    batch(4, 5, 9.0).limit(3).write.mode("append").parquet(f"{path}/batch_id=1")  # left behind by an attempt
    for _ in range(2):
        write(batch(4, 9, 2.0), 1)
    write(empty, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = st.read_store(spark, empty.schema, path)
    assert rows.count() == rows.select("e", "session").distinct().count() == 45
    assert {(r["v"], r["n"]) for r in rows.groupBy("v").agg(F.count("*").alias("n")).collect()} == {(1.0, 30), (2.0, 15)}
    assert len(list((tmp_path / "store" / "batch_id=0").glob("*.parquet"))) > 1


def test_hysteresis_of_a_long_key(spark):
    """Ten thousand signals of one key beside short ones, a NULL key and gaps; Arrow batches of 500 rows cut signals."""
    rng, rows = random.Random(2), []
    for k, n in (("hot", 10_000), ("cold", 40), (None, 60)):
        order = list(range(8))
        for t in range(n):
            i, j = rng.sample(range(8), 2)
            order[i], order[j] = order[j], order[i]
            if rng.random() > 0.03:
                rows += [(k, t, f"item {x}", r + 1) for r, x in enumerate(order)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, signal_index long, item string, rank long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        out = hysteresis_select(df, keys=["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("hot", "cold", None):
        mine = {}
        for r in rows:
            if r[0] == k:
                mine.setdefault(r[1], []).append(r)
        by_signal, want, held, last = mine, [], [], None
        for t in sorted(by_signal):
            week = sorted((r[3], r[2]) for r in by_signal[t] if r[3] <= 5)
            before = held if last == t - 1 else []
            kept = [w for w in week if w[1] in before][:3]
            new = [w for w in week if w[1] not in before and w[0] <= 3][: 3 - len(kept)]
            want += [(t, i, r, "RETAINED") for r, i in kept] + [(t, i, r, "NEW_ENTRY") for r, i in new]
            held, last = [i for _, i in kept + new], t
        assert sorted(tuple(r)[1:] for r in out if r["k"] == k) == sorted(want)
