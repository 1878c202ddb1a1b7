"""Scheduled selection: groups by return, members by liquidity, with or without memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapanel.functions.scalars import yes
from stratapanel.operators.events import interval_event_crossing
from stratapanel.operators.orderstats import first_within, ordinal_within
from stratapanel.operators.quality import row_hashes
from stratapanel.runtime import stage


def rank_descending(df: DataFrame, keys: list[str], value: str, tie: str, *, rank: str, bounded: bool = False) -> DataFrame:
    """Unique rank per group, best first, ties by ascending ``tie``.

    Note the difference to a cross-sectional rank: here a smaller tie key wins.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("_neg", -F.col(value))
    out = ordinal_within(known, keys, "_neg", tie, rank=rank, size="_n", bounded=bounded)
    return out.drop("_neg", "_n")


def top_groups(
    groups: DataFrame, k: int, *, session: str = "session", value: str = "group_value", valid: str = "valid_group", code: str = "group_code"
) -> DataFrame:
    """The k strongest valid groups per session with ``group_rank``; a session has one row per group."""
    ranked = rank_descending(groups.where(yes(valid)), [session], value, code, rank="group_rank", bounded=True)
    return ranked.where(F.col("group_rank") <= k)


def _weighted(chosen: DataFrame, session: str) -> DataFrame:
    """Equal weight over the chosen rows of a session (a short list by construction)."""
    n = chosen.groupBy(session).agg(F.count(F.lit(1)).alias("_n"))
    return chosen.join(n, session).withColumn("target_weight", 1 / F.col("_n")).drop("_n")


def topk_of_topk_targets(
    groups: DataFrame, members: DataFrame, *, k_groups: int = 3, k_members: int = 3, session: str = "session",
    entity: str = "entity", code: str = "group_code", liquidity: str = "liquidity", value: str = "group_value", valid: str = "valid_group",
) -> DataFrame:
    """Top members by liquidity inside the top groups by return, equally weighted."""
    best = top_groups(groups, k_groups, session=session, value=value, valid=valid, code=code).select(session, code, "group_rank", value)
    inside = stage(members.join(best, [session, code]))
    ranked = rank_descending(inside, [session, code], liquidity, entity, rank="liquidity_rank")
    counts = inside.groupBy(session, code).agg(F.count(F.lit(1)).alias("eligible_members"))
    chosen = stage(ranked.where(F.col("liquidity_rank") <= k_members).join(counts, [session, code]))
    return _weighted(chosen, session)


def event_safe_targets(
    groups: DataFrame, members: DataFrame, events: DataFrame, schedule: DataFrame, end, *, k_groups: int = 3, k_members: int = 3,
    session: str = "session", entity: str = "entity", code: str = "group_code", liquidity: str = "liquidity",
    value: str = "group_value", valid: str = "valid_group",
) -> DataFrame:
    """The same, passing over members with an event in (signal, next execution].

    The original liquidity rank is kept; the next safe member of the group moves up.
    ``schedule`` has one row per signal: signal_session, execution_session.
    """
    line = W.orderBy("signal_session")  # one row per signal
    horizon = schedule.where(F.col("execution_session").isNotNull()).select(
        F.col("signal_session").alias(session), "execution_session",
        F.coalesce(F.lead("execution_session").over(line), F.lit(end).cast("date")).alias("_next"))
    best = top_groups(groups, k_groups, session=session, value=value, valid=valid, code=code).select(session, code, "group_rank", value)
    inside = members.join(best, [session, code]).join(horizon, session)
    ranked = stage(rank_descending(inside, [session, code], liquidity, entity, rank="liquidity_rank"))
    marked = interval_event_crossing(ranked, events, entity=entity, start=session, end="_next")
    safe = marked.where(~F.col("crosses_event"))
    # One ranking; the next safe members are the first ones of its order.
    chosen = stage(first_within(safe, [session, code], [F.col("liquidity_rank")], entity, k_members).drop("_next", "crosses_event"))
    return _weighted(chosen, session)


def target_feasibility(
    targets: DataFrame, groups: DataFrame, *, session: str = "session", code: str = "group_code", valid: str = "valid_group", k: int = 3
) -> DataFrame:
    """Per signal: usable groups, chosen groups and positions, thin groups and the largest group weight."""
    usable = groups.groupBy(session).agg(F.count_if(yes(valid)).alias("usable_groups"))
    per_group = targets.groupBy(session, code).agg(
        F.sum("target_weight").alias("_w"), F.max("eligible_members").alias("_e"), F.count(F.lit(1)).alias("_p"))
    chosen = per_group.groupBy(session).agg(
        F.count(F.lit(1)).alias("selected_groups"), F.sum("_p").alias("expected_positions"),
        F.count_if(F.col("_e") < k).alias("groups_below_k"), F.max("_w").alias("max_group_weight"))
    return usable.join(chosen, session, "left").fillna(0, ["selected_groups", "expected_positions", "groups_below_k"])


def _fold(batches: Iterator[pa.RecordBatch], keys: int, entry: int, retain: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Selection over rows (keys.., index, item, rank) in that order; between batches only the held items and the rows of one signal are kept."""
    now, week, last, held, out, schema = None, [], None, [], [], None

    def decide() -> None:
        nonlocal last, held
        before = held if last == (now[:-1], now[-1] - 1) else []
        kept = [r for r in week if r[0] in before][:slots]
        new = [r for r in week if r[0] not in before and r[1] <= entry][: slots - len(kept)]
        out.extend((*now, *r, s) for s, rows in (("RETAINED", kept), ("NEW_ENTRY", new)) for r in rows)
        last, held = (now[:-1], now[-1]), [r[0] for r in kept + new]

    def chosen() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        schema = pa.schema([*batch.schema, pa.field("selection_status", pa.string())])
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            signal = row[: keys + 1]
            if signal != now:
                if week:
                    decide()
                now, week = signal, []
            week.append(row[keys + 1 :])
        if out:
            yield chosen()
    if week:
        decide()
        if out:
            yield chosen()


def hysteresis_select(
    ranked: DataFrame, *, keys: list[str], index: str = "signal_index", item: str = "item", rank: str = "rank",
    entry: int = 3, retain: int = 5, slots: int = 3,
) -> DataFrame:
    """Keep held items while rank <= retain, admit new ones at rank <= entry, up to ``slots``.

    The choice at a signal depends on the one before, so the signals of a key are folded in order, in one stream of Arrow
    batches sorted by Spark: only ``retain`` rows of a signal travel, the work is linear, and no row or task holds a history.  Keys run in
    parallel.  A signal without rows empties the held set.  Items without a rank are never chosen.
    """
    near = ranked.where(F.col(rank) <= retain).select(*keys, F.col(index).cast("long").alias(index), item, F.col(rank).cast("int").alias(rank))
    line = near.repartition(*keys).sortWithinPartitions(*keys, index, rank, item)
    n = len(keys)
    return line.mapInArrow(lambda batches: _fold(batches, n, entry, retain, slots), T.StructType([*near.schema.fields, T.StructField("selection_status", T.StringType())]))


def hysteresis_members(
    chosen_groups: DataFrame, members: DataFrame, *, keys: list[str], index: str = "signal_index", code: str = "group_code",
    entity: str = "entity", liquidity: str = "liquidity", entry: int = 3, retain: int = 5, slots: int = 3,
) -> DataFrame:
    """Member selection with the same memory inside the chosen groups.

    A group left for one signal loses its held members, so each (key, group) folds alone.
    """
    inside = members.join(chosen_groups.select(*keys, index, code), [index, code])
    ranked = rank_descending(inside, [*keys, index, code], liquidity, entity, rank="rank")
    out = hysteresis_select(ranked, keys=[*keys, code], index=index, item=entity, rank="rank", entry=entry, retain=retain, slots=slots)
    return out.withColumnRenamed("rank", "liquidity_rank")


def target_state_table(targets: DataFrame, *, keys: list[str], index: str = "signal_index", entity: str = "entity", signals: DataFrame) -> DataFrame:
    """ENTER, KEEP or EXIT of every name against the signal before.

    ``signals`` lists the (keys, index) that exist, so an exit is only reported at a real signal.
    """
    now = targets.select(*keys, index, entity, F.lit(1).alias("_now"), F.lit(0).alias("_before"))
    before = targets.select(*keys, (F.col(index) + 1).alias(index), entity, F.lit(0).alias("_now"), F.lit(1).alias("_before"))
    both = now.unionByName(before).groupBy(*keys, index, entity).agg(F.max("_now").alias("_now"), F.max("_before").alias("_before"))
    state = F.when((F.col("_now") == 1) & (F.col("_before") == 1), "KEEP").when(F.col("_now") == 1, "ENTER").otherwise("EXIT")
    return both.join(signals.select(*keys, index).distinct(), [*keys, index], "left_semi").select(*keys, index, entity, state.alias("state"))


def list_fingerprint(candidates: DataFrame, columns: list[str], *, keys: list[str]) -> DataFrame:
    """Identity of an ordered candidate list per key.

    Rows carry their rank in ``columns``, so summing and xoring row hashes pins the order
    without collecting the list anywhere.
    """
    one, two = row_hashes(columns)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = candidates.select(*keys, one.alias("_h1"), two.alias("_h2")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), total("_h1").alias("_s1"), total("_h2").alias("_s2"), F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"))
    body = F.concat_ws(":", *[F.col(c).cast("string") for c in ("candidates", "_s1", "_s2", "_x1", "_x2")])
    return sums.withColumn("fingerprint", F.sha2(body, 256)).drop("_s1", "_s2", "_x1", "_x2")


def quote_resolve(
    requests: DataFrame, normalized: DataFrame, raw: DataFrame, *, entity: str = "entity", session: str = "session",
    purpose: str = "purpose", price: str = "open", held: str = "held",
) -> DataFrame:
    """Price per (entity, session, purpose): normalised row, else raw EQ or BE row; entries need EQ."""
    on = [entity, session]
    first = normalized.where(F.col(price) > 0).groupBy(*on).agg(F.min(price).alias("_n"))
    second = raw.where((F.col(price) > 0) & F.col("series").isin("EQ", "BE")).groupBy(*on).agg(
        F.max(F.struct(F.col("series").alias("s"), (-F.col(price)).alias("p"))).alias("_r"))
    j = requests.join(first, on, "left").join(second, on, "left")
    barred = (F.col(purpose) == "entry") & (F.col("_r.s") != "EQ")
    status = (
        F.when(F.col("_n").isNotNull(), "USED").when(F.col("_r").isNotNull() & barred, "ENTRY_SKIPPED_NON_EQ")
        .when(F.col("_r").isNotNull(), "USED").when(yes(held), "MISSING_AND_RETAINED").otherwise("ENTRY_SKIPPED_NO_EQ"))
    return (
        j.withColumn("resolution_status", status)
        .withColumn("source_used", F.when(F.col("_n").isNotNull(), "normalized").when(F.col("_r").isNotNull(), "raw").otherwise("none"))
        .withColumn("resolved_price", F.when(F.col("_n").isNotNull(), F.col("_n")).when(~yes(barred), -F.col("_r.p")))
        .drop("_n", "_r")
    )
