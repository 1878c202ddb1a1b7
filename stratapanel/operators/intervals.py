"""Interval-safe returns: a value exists only when every session between the end points
is present, usable and free of blocking events.

Panel rows and event rows of an entity are merged into one stream ordered by session
position, and every horizon reads RANGE frames over that stream.  Positions index the
observed calendar, so a frame of h positions covers exactly h sessions whether or not
the entity has rows there.  All horizons share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import first_reason, ratio, yes
from stratapanel.operators.calendar import effective_positions, session_calendar
from stratapanel.runtime import date_dimension


def event_positions(
    events: DataFrame, calendar: DataFrame, *, entity: str = "entity", session: str = "session"
) -> DataFrame:
    """Distinct (entity, position) of events; an event between sessions moves to the next one."""
    distinct = events.select(entity, session).distinct()
    placed = effective_positions(calendar, distinct.select(session).distinct(), session=session)
    return (
        distinct.join(date_dimension(placed, session), session)
        .where(F.col("event_position").isNotNull())
        .select(entity, F.col("event_position").alias("position"))
        .distinct()
    )


def _stream(panel: DataFrame, events: DataFrame | None, entity: str, position: str) -> DataFrame:
    rows = panel.withColumn("_row", F.lit(1)).withColumn("_event", F.lit(0))
    if events is None:
        return rows
    marks = events.select(
        F.col(entity), F.col("position").alias(position), F.lit(0).alias("_row"), F.lit(1).alias("_event")
    )
    return rows.unionByName(marks, allowMissingColumns=True)


def with_crossings(
    panel: DataFrame, events: DataFrame, horizons: tuple[int, ...], *, calendar: DataFrame | None = None,
    entity: str = "entity", session: str = "session", position: str = "position", prefix: str = "crossing",
    forward: tuple[int, ...] = (),
) -> DataFrame:
    """Boolean per horizon: does a blocking event lie in (position-h, position], or ahead in (position, position+h]."""
    calendar = calendar if calendar is not None else session_calendar(panel, session=session)
    stream = _stream(panel, event_positions(events, calendar, entity=entity, session=session), entity, position)
    w = W.partitionBy(entity).orderBy(position)

    # Running counts only: a growing frame costs one step per row, whatever the horizon.
    def upto(k):
        return F.coalesce(F.sum("_event").over(w.rangeBetween(W.unboundedPreceding, k)), F.lit(0))

    cols = [(upto(0) > upto(-h)).alias(f"{prefix}_{h}") for h in horizons]
    cols += [(upto(h) > upto(0)).alias(f"{prefix}_ahead_{h}") for h in forward]
    return stream.select("*", *cols).where(F.col("_row") == 1).drop("_row", "_event")


def interval_panel(
    panel: DataFrame, formations: tuple[int, ...], futures: tuple[int, ...], *, events: DataFrame | None = None,
    calendar: DataFrame | None = None, coverage_end=None, entity: str = "entity", session: str = "session",
    position: str = "position", close: str = "close", eligible: str = "eligible", contaminated: str = "contaminated",
) -> DataFrame:
    """Look-back and look-ahead returns with every reason of invalidity in fixed order.

    Adds ``ret_h, valid_ret_h, ret_h_invalid_reason, ret_h_endpoint`` and
    ``future_ret_h, valid_future_h, future_invalid_reason_h, future_h_endpoint``.
    """
    calendar = calendar if calendar is not None else session_calendar(panel, session=session)
    marks = event_positions(events, calendar, entity=entity, session=session) if events is not None else None
    stream = _stream(panel, marks, entity, position)
    # End points are named from the calendar even where the entity has no row: each
    # calendar row carries the dates h sessions before and after it.
    steps = (*formations, *[-f for f in futures])
    line, everywhere = W.orderBy("position"), W.partitionBy()
    limit = F.lit(coverage_end).cast("date") if coverage_end is not None else None
    dates = calendar.select(
        session,
        *[F.lag(session, h).over(line).alias(f"_end_{h}") for h in steps],
        F.count(F.lit(1)).over(everywhere).alias("_size"),
        (F.count_if(F.col(session) <= limit).over(everywhere) - 1 if limit is not None else F.lit(2**30)).alias("_cut"),
    )
    size, cutoff = F.col("_size"), F.col("_cut")
    w = W.partitionBy(entity).orderBy(position)
    pos = F.col(position)
    bad = F.when(F.col("_row") == 1, (~yes(eligible)).cast("int"))
    dirty = F.when(F.col("_row") == 1, yes(contaminated).cast("int"))

    # Differences of running counts: a growing frame costs one step per row, whatever the horizon.
    def upto(c, k):
        return F.coalesce(F.sum(c).over(w.rangeBetween(W.unboundedPreceding, k)), F.lit(0))

    def total(c, a, b):
        return upto(c, b) - upto(c, a - 1)

    cols = [F.min(F.when(F.col("_row") == 1, pos)).over(W.partitionBy(entity)).alias("_first")]
    for h in steps:
        a, b, end = (-h, 0, -h) if h > 0 else (0, -h, -h)
        lo, hi = (-(h - 1), 0) if h > 0 else (1, -h)
        at = w.rangeBetween(end, end)
        cols += [
            F.max(F.when(F.col("_row") == 1, F.col(close))).over(at).alias(f"_close_{h}"),
            F.max(F.when(F.col("_row") == 1, yes(eligible).cast("int"))).over(at).alias(f"_elig_{h}"),
            total(F.col("_row"), a, b).alias(f"_rows_{h}"),
            total(bad, a, b).alias(f"_bad_{h}"),
            total(dirty, a, b).alias(f"_dirty_{h}"),
            total(F.col("_event"), lo, hi).alias(f"_ev_{h}"),
        ]
    wide = stream.select("*", *cols).where(F.col("_row") == 1).join(date_dimension(dates, session), session)

    out = []
    for h in steps:
        k = abs(h)
        endpoint = pos - h
        inside = (endpoint >= 0) & (endpoint < size)
        exists = F.col(f"_elig_{h}").isNotNull()
        end_bad = inside & exists & (F.col(f"_elig_{h}") == 0)
        gap = inside & (F.col(f"_rows_{h}") < k + 1)
        dirty_any = yes(contaminated) | (inside & (F.col(f"_dirty_{h}") > 0))
        crossed = inside & (F.col(f"_ev_{h}") > 0)
        # Contamination of the signal row is reported second, contamination found only
        # further along the interval after the session defects.
        own, later = yes(contaminated), dirty_any & ~yes(contaminated)
        if h > 0:
            short = (endpoint < 0) | (inside & ~exists & (endpoint < F.col("_first")))
            lost = inside & ~exists & (endpoint >= F.col("_first"))
            why = [
                (~yes(eligible), "SIGNAL_ROW_INELIGIBLE"), (own, "IDENTITY_CONTAMINATION"),
                (short, "INSUFFICIENT_HISTORY"), (lost, "UNAVAILABLE_ENDPOINT"),
                (end_bad, "LOOKBACK_ENDPOINT_INELIGIBLE"),
            ]
            uncovered = pos > cutoff
            value = ratio(close, f"_close_{h}") - 1
            names = (f"ret_{k}", f"valid_ret_{k}", f"ret_{k}_invalid_reason", f"ret_{k}_endpoint")
        else:
            why = [
                (~yes(eligible), "SIGNAL_ROW_INELIGIBLE"), (own, "IDENTITY_CONTAMINATION"),
                (~inside | ~exists, "UNAVAILABLE_ENDPOINT"), (end_bad, "TARGET_ENDPOINT_INELIGIBLE"),
            ]
            uncovered = endpoint > cutoff
            value = ratio(f"_close_{h}", close) - 1
            names = (f"future_ret_{k}", f"valid_future_{k}", f"future_invalid_reason_{k}", f"future_{k}_endpoint")
        why += [
            (gap, "MISSING_UNSAFE_SESSION_INTERVAL"),
            (inside & (F.col(f"_bad_{h}") > 0), "UNSAFE_SESSION_INTERVAL"),
            (later, "IDENTITY_CONTAMINATION"),
            (crossed, "UNRESOLVED_CORPORATE_ACTION_INTERVAL"),
            (uncovered, "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"),
        ]
        reason = F.concat_ws("|", *[F.when(c, F.lit(label)) for c, label in why])
        ok = reason == ""
        out += [
            F.when(ok, value).alias(names[0]),
            ok.alias(names[1]),
            reason.alias(names[2]),
            F.col(f"_end_{h}").alias(names[3]),
        ]
    return wide.select(*panel.columns, *out)


def interval_panel_pit(
    panel: DataFrame, formations: tuple[int, ...], futures: tuple[int, ...], *, events: DataFrame | None = None,
    calendar: DataFrame | None = None, coverage: tuple | None = None, entity: str = "entity",
    session: str = "session", position: str = "position", close: str = "close", quality: str = "quality",
) -> DataFrame:
    """Point-in-time form: the signal row is good, the interval is complete and event-free.

    ``valid_*_broad_h`` ignores the coverage range, ``valid_*_primary_h`` requires both
    end dates inside it.
    """
    if events is not None:
        calendar = calendar if calendar is not None else session_calendar(panel, session=session)
        events = event_positions(events, calendar, entity=entity, session=session)
    stream = _stream(panel, events, entity, position)
    w = W.partitionBy(entity).orderBy(position)
    start, end = (F.lit(x).cast("date") for x in coverage) if coverage else (None, None)
    # Events up to each row are counted once; event rows then leave the stream, and the row
    # h back lies h sessions back exactly when no session between is missing.  Both windows
    # share the exchange and the order.
    counted = stream.withColumn("_e", F.sum("_event").over(w)).where(F.col("_row") == 1)
    steps = (*formations, *[-f for f in futures])
    frames = []
    for h in steps:
        frames += [F.lag(c, h).over(w).alias(f"{n}_{h}") for n, c in (("_c", close), ("_d", session), ("_p", position), ("_e", "_e"))]
    wide = counted.select("*", *frames)
    out = []
    for h in steps:
        k = abs(h)
        base = yes(
            F.col(quality) & F.col(f"_c_{h}").isNotNull() & (F.col(position) - F.col(f"_p_{h}") == h) & (F.col("_e") == F.col(f"_e_{h}"))
        )
        here, there = F.col(session), F.col(f"_d_{h}")
        first, last = (there, here) if h > 0 else (here, there)
        primary = base & yes((first >= start) & (last <= end)) if coverage else base
        value = (ratio(close, f"_c_{h}") if h > 0 else ratio(f"_c_{h}", close)) - 1
        if h > 0:
            names = (f"ret_{k}", f"valid_factor_broad_{k}", f"valid_factor_primary_{k}")
        else:
            names = (f"future_ret_{k}", f"valid_future_broad_{k}", f"valid_future_primary_{k}")
        out += [F.when(base, value).alias(names[0]), base.alias(names[1]), primary.alias(names[2])]
    return wide.select(*panel.columns, *out)


def interval_panel_strict(
    panel: DataFrame, formations: tuple[int, ...], futures: tuple[int, ...], *, events: DataFrame | None = None,
    calendar: DataFrame | None = None, certified_end=None, entity: str = "entity", session: str = "session",
    position: str = "position", close: str = "close", quality: str = "quality", identity_safe: str = "identity_safe",
) -> DataFrame:
    """Strict form: every row of the interval is good and identity-safe with a positive price."""
    calendar = calendar if calendar is not None else session_calendar(panel, session=session)
    good = yes(F.col(quality) & F.col(identity_safe) & (F.col(close) > 0))
    panel_q = panel.withColumn("_good", good)
    if events is not None:
        panel_q = with_crossings(
            panel_q, events, formations, forward=futures, calendar=calendar, entity=entity, session=session,
            position=position, prefix="_x",
        )
    w = W.partitionBy(entity).orderBy(position)
    out = []
    pos = F.col(position)
    for h in formations:
        base = F.lag(close, h).over(w)
        exact = yes(pos - F.lag(position, h).over(w) == h)
        safe = F.when(F.count("_good").over(w.rowsBetween(-h, 0)) == h + 1,
                      F.bool_and("_good").over(w.rowsBetween(-h, 0))).otherwise(F.lit(False))
        crossed = F.col(f"_x_{h}") if events is not None else F.lit(False)
        ok = safe & exact & base.isNotNull() & ~crossed
        out += [
            F.when(ok, ratio(close, base) - 1).alias(f"price_return_{h}"),
            ok.alias(f"valid_return_{h}"),
            first_reason(
                [
                    (~yes(identity_safe), "IDENTITY_AMBIGUOUS"), (~F.col("_good"), "INVALID_SIGNAL_ENDPOINT"),
                    (base.isNull(), "INSUFFICIENT_HISTORY"), (~exact, "UNAVAILABLE_SESSION_ENDPOINT"),
                    (crossed, "CORPORATE_ACTION_INTERVAL"), (~safe, "UNSAFE_INTERVENING_SESSION"),
                ]
            ).alias(f"return_{h}_invalid_reason"),
        ]
    for h in futures:
        target = F.lead(close, h).over(w)
        exact = yes(F.lead(position, h).over(w) - pos == h)
        safe = F.when(F.count("_good").over(w.rowsBetween(0, h)) == h + 1,
                      F.bool_and("_good").over(w.rowsBetween(0, h))).otherwise(F.lit(False))
        crossed = F.col(f"_x_ahead_{h}") if events is not None else F.lit(False)
        certified = (
            yes(F.lead(session, h).over(w) <= F.lit(certified_end).cast("date")) if certified_end else F.lit(True)
        )
        ok = F.col("_good") & target.isNotNull() & exact & safe & ~crossed & certified
        out += [
            F.when(ok, ratio(target, close) - 1).alias(f"future_return_{h}"),
            ok.alias(f"valid_future_{h}"),
            first_reason(
                [
                    (~yes(identity_safe), "IDENTITY_AMBIGUOUS"), (~F.col("_good"), "INVALID_SIGNAL_ENDPOINT"),
                    (target.isNull(), "UNAVAILABLE_FUTURE_ENDPOINT"), (~exact, "UNAVAILABLE_SESSION_ENDPOINT"),
                    (~certified, "CORPORATE_ACTION_COVERAGE_UNCERTIFIED"), (crossed, "CORPORATE_ACTION_INTERVAL"),
                    (~safe, "UNSAFE_INTERVENING_SESSION"),
                ]
            ).alias(f"future_invalid_reason_{h}"),
        ]
    return panel_q.select(*panel.columns, *out)
