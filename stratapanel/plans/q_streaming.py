"""Queries: the streaming operators, fed from the tables and run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.plans import views
from stratapanel.plans.q_bars import ntz
from stratapanel.plans.q_core import M, WK
from stratapanel.plans.q_signals import RANKED_ITEMS, hyst_sql, ranked_items
from stratapanel.plans.registry import final, query
from stratapanel.runtime import scratch_path, stage
from stratapanel.streaming import streams as st


def _drain(stream, sink: str, check: str, **options):
    """Run an available-now stream into a Parquet folder and wait for it."""
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True)
    q = writer.options(**options).start()
    q.awaitTermination()


def _feed(parts, path: str, files: int = 2) -> None:
    """Appends frames to a source folder one after the other, each as ``files`` files: with as many files a trigger, each is one batch."""
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)


@query("stream_bars", """WITH b AS (SELECT event_type AS entity, date_trunc('hour', ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT entity, bar_start, bar_start + INTERVAL 1 HOUR AS bar_end, bar_start + INTERVAL 1 HOUR AS bar_available_at, open, high, low, close, volume FROM b""")
def _(spark, d):
    # The table has no zone: its clock is read as UTC, where windows align to the hour.
    # Two sources, each in three batches, and a marker that closes it.
    ticks = views.table(spark, d, "events").select(
        F.col("event_type").alias("entity"), F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"), F.col("value").alias("price"),
        F.col("event_id").alias("sequence"))
    first, last = ticks.agg(F.min("ts"), (F.date_trunc("hour", F.max("ts")) + F.expr("INTERVAL 3 HOURS"))).first()
    third, sources = (last - first) / 3, []
    for purchases in (True, False):
        path = scratch_path(spark, "ticks")
        own = ticks.where((F.col("entity") == "purchase") == purchases)
        _feed([own.where((F.col("ts") >= first + third * i) & (F.col("ts") < first + third * (i + 1))) for i in range(3)], path)
        _feed([st.closing_marker(ticks, last)], path, 1)
        sources.append(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 2).parquet(path))
    sink = scratch_path(spark, "bars-out")
    _drain(st.stream_bars(*sources, length="1 hour", delay="2 hours", sequence="sequence"), sink, scratch_path(spark, "bars-check"))
    out = spark.read.parquet(sink)
    clock = [F.to_utc_timestamp(c, F.current_timezone()).alias(c) for c in ("bar_start", "bar_end", "bar_available_at")]
    return ntz(out.select("entity", *clock, "open", "high", "low", "close", "volume"))


@query("stream_increment", final(M, "entity, session", "panel", "turnover"))
def _(spark, d):
    # The panel arrives twice in two overlapping halves; every key must be stored once.
    panel = views.panel_month(spark, d).select("entity", "session", "turnover")
    source, store = scratch_path(spark, "inc"), scratch_path(spark, "store")
    _feed([panel.where("session < '1999-01-01'"), panel.where("session >= '1998-01-01'")], source)
    stream = spark.readStream.schema("entity long, session date, turnover double").option("maxFilesPerTrigger", 2).parquet(source)
    st.create_store(spark, panel.schema, store)
    writer = st.increment_writer(store, ["entity", "session"])
    q = stream.writeStream.foreachBatch(writer).option("checkpointLocation", scratch_path(spark, "inc-check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return st.read_store(spark, panel.schema, store)


@query("stream_hysteresis", f"WITH RECURSIVE {WK}, {RANKED_ITEMS}, {hyst_sql('ri', 'strategy', 'hy')} SELECT strategy, t AS signal_index, i AS item, r AS rank, selection_status FROM hy")
def _(spark, d):
    # Two hundred signals a batch; the last signal of a batch is split, half of its ranks come with the next one.
    source, sink = scratch_path(spark, "ranks"), scratch_path(spark, "held")
    week = F.timestamp_seconds(F.col("signal_index") * 604_800)
    items = stage(ranked_items(spark, d).select("strategy", F.col("signal_index").cast("long").alias("signal_index"), "item", F.col("rank").cast("long").alias("rank"), week.alias("ts")))
    part = F.floor((2 * F.col("signal_index") + F.col("rank") % 2 + 1) / 400)
    parts, end = items.agg(F.max(part), F.max("ts") + F.expr("INTERVAL 8 DAYS")).first()
    _feed([items.where(part == i) for i in range(parts + 1)], source)
    _feed([st.closing_marker(items, end)], source, 1)
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _drain(st.stream_hysteresis(stream, key="strategy", delay="7 days"), sink, scratch_path(spark, "held-check"))
    return spark.read.parquet(sink)
