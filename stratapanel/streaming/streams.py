"""Structured Streaming forms: event-time bars, idempotent panel growth, selection with state."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratapanel.operators.quality import append_new_keys


#: Partition column of a growing panel: the batch that added a row.
BATCH = "batch_id"


def closing_marker(ticks: DataFrame, at, *, ts: str = "ts") -> DataFrame:
    """One row with the columns of a source, NULL but for its time: written to a source that ends or falls idle.

    A watermark only moves with rows, and with several sources it waits for the slowest, so the last bars of a source stay open
    without such a row.  ``at`` is the end of the last bar that is to be closed plus the delay.
    """
    fields = ticks.schema.fields
    return ticks.sparkSession.range(1).select(*[(F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def stream_bars(
    *sources: DataFrame, length: str, delay: str, entity: str = "entity", ts: str = "ts", price: str = "price", volume: str | None = None,
    sequence: str | None = None, start: str = "0 seconds",
) -> DataFrame:
    """Tumbling OHLCV bars; a bar is final once the watermark passes its end, later ticks are dropped.

    Every source has its own watermark, and the slowest one counts; ``closing_marker`` rows (no price) move it on and are in no bar.
    Ticks of one time are ordered by ``sequence``, else by their price, so a bar never depends on the order of arrival.
    Windows align to UTC; ``start`` shifts them.
    """
    marked = [s.withWatermark(ts, delay) for s in sources]
    ticks = marked[0]
    for more in marked[1:]:
        ticks = ticks.unionByName(more)
    known = F.col(price).isNotNull()
    at = F.when(known, F.struct(ts, F.col(sequence or price)))
    size = F.count(price) if volume is None else F.coalesce(F.sum(F.when(known, F.col(volume))), F.lit(0))
    return (
        ticks.groupBy(F.window(ts, length, startTime=start).alias("w"), entity)
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
            size.alias("volume"), F.max(F.when(known, F.col(ts))).alias("last_tick"),
        )
        .where(F.col("last_tick").isNotNull())
        .select(
            entity, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume",
            # Usable when both the scheduled end and the last tick are past.
            F.greatest(F.col("w.end"), F.col("last_tick")).alias("bar_available_at"),
        )
    )


def create_store(spark: SparkSession, schema: T.StructType, path: str, *, partition_by: list[str] | None = None) -> None:
    """Empty store for an ``increment_writer`` at ``path``; does nothing if one is there."""
    writer = spark.createDataFrame([], schema).write.mode("ignore")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{BATCH}=-1")


def increment_writer(
    path: str, keys: list[str], *, session: str = "session", partition_by: list[str] | None = None
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends keys the stored panel does not have yet.

    Each batch is written to a folder named after its id, ``batch_id=n``, in place of whatever an unfinished attempt left there, by all tasks of its plan.  A replayed batch therefore writes the same folder again and adds nothing, and an attempt that dies half-way leaves
    nothing that a later one could take for stored rows.  Keys of earlier batches are looked up among stored sessions inside the batch's
    own date range.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first, last = batch.agg(F.min(session), F.max(session)).first()
        new = batch
        if first is not None:
            schema = T.StructType([*batch.schema.fields, T.StructField(BATCH, T.LongType())])
            stored = spark.read.schema(schema).parquet(path).where((F.col(BATCH) < batch_id) & F.col(session).between(first, last))
            new = append_new_keys(stored.drop(BATCH), batch, keys)
        writer = new.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{BATCH}={batch_id}")

    return write


def read_store(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The panel an ``increment_writer`` has stored so far, without the batch column."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path).drop(BATCH)


class _Hysteresis(StatefulProcessor):
    """Waiting rows and held items of a key.

    Rows of a signal wait until the watermark has passed its time, when no further row is expected.  One timer per key, at the
    earliest waiting signal, then folds all signals that are due, in order.
    """

    def __init__(self, entry: int, retain: int, slots: int, fields: list[str], waiting: T.StructType, held: T.StructType):
        self.entry, self.retain, self.slots = entry, retain, slots
        self.fields, self.waiting_schema, self.held_schema = fields, waiting, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.held = handle.getListState("held", self.held_schema)
        self.last = handle.getValueState("last", "index long, at long")
        self.timer = handle.getValueState("timer", "at long")

    def _row(self, key, index, item, rank, status) -> Row:
        return Row(**dict(zip(self.fields, (key, index, item, rank, status), strict=True)))

    def _wait(self, first: int) -> None:
        """Sets the timer to ``first`` unless an earlier one is set."""
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for is None or first < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, fresh = self.last.get() if self.last.exists() else None, []
        for index, item, rank, at in (r[1:] for r in rows):
            if done is not None and (index <= done[0] or at < done[1]):
                yield self._row(key[0], index, item, rank, "REJECTED_LATE")
            else:
                fresh.append((index, item, rank, at))
        if fresh:
            self.waiting.appendList(fresh)
            self._wait(min(r[3] for r in fresh) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, due, rest = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), defaultdict(list), []
        for index, item, rank, at in self.waiting.get():
            due[index].append((rank, item)) if at < now else rest.append((index, item, rank, at))
        last = self.last.get()[0] if self.last.exists() else None
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        for index in sorted(due):
            before = held if last is not None and index == last + 1 else []
            week = sorted(due[index], key=lambda r: r[0])
            kept = [r for r in week if r[1] in before][: self.slots]
            new = [r for r in week if r[1] not in before and r[0] <= self.entry][: self.slots - len(kept)]
            for status, rows in (("RETAINED", kept), ("NEW_ENTRY", new)):
                for rank, item in rows:
                    yield self._row(key[0], index, item, rank, status)
            held, last = [item for _, item in kept + new], index
        self.last.update((last, now))
        self.timer.clear()
        for state, values in ((self.held, [(item,) for item in held]), (self.waiting, rest)):
            state.put(values) if values else state.clear()
        if rest:
            self._wait(min(r[3] for r in rest) + 1)

    def close(self) -> None:
        pass


def stream_hysteresis(
    ranked: DataFrame, *, key: str, ts: str = "ts", delay: str = "0 seconds", item: str = "item", rank: str = "rank", index: str = "signal_index",
    entry: int = 3, retain: int = 5, slots: int = 3,
) -> DataFrame:
    """Selection with memory over a stream of ranked items.

    All rows of a signal carry its time ``ts``, which rises with its index.  A signal may arrive in any number of batches: it is decided
    when the watermark (latest time seen minus ``delay``) passes its time.  Rows that come after that are returned with the
    status REJECTED_LATE and change nothing.  Rows without an item only move the watermark (``closing_marker``), so that the last signals are
    decided.  Items of any type are held as they are.  State per key: the held items and the rows of undecided signals.
    """
    types = {c: ranked.schema[c].dataType for c in (key, item)}
    fields = [key, index, item, rank, "selection_status"]
    out = T.StructType([T.StructField(c, t) for c, t in zip(fields, (types[key], T.LongType(), types[item], T.LongType(), T.StringType()), strict=True)])
    held = T.StructType([T.StructField("item", types[item])])
    waiting = T.StructType([T.StructField("index", T.LongType()), T.StructField("item", types[item]), T.StructField("rank", T.LongType()), T.StructField("at", T.LongType())])
    # The time goes on as a number: Spark would drop rows behind the watermark before they can be rejected.  The filter reads it too, so it stays
    # behind the watermark and markers are seen by it.
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    rows = ranked.withWatermark(ts, delay).select(key, F.col(index).cast("long").alias(index), item, F.col(rank).cast("long").alias(rank), at.alias("_at"))
    rows = rows.where(F.when(F.col("_at").isNotNull(), (F.col(rank) <= retain) & F.col(item).isNotNull()))
    return rows.groupBy(key).transformWithState(
        statefulProcessor=_Hysteresis(entry, retain, slots, fields, waiting, held), outputStructType=out, outputMode="Append", timeMode="EventTime")
