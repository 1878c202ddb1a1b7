"""Event ledgers: classification, reconciliation, exclusion windows, proximity and event studies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import first_reason, yes
from stratapanel.operators.calendar import position_of_dates
from stratapanel.operators.orderstats import same_keys, summarize_within
from stratapanel.runtime import date_dimension, derived, row_count, stage

# Impact labels of a classified event.
NO_ADJUSTMENT = "NO_PRICE_ADJUSTMENT_NEEDED_FOR_PRICE_MOMENTUM"
LIKELY_ADJUSTED = "LIKELY_ALREADY_ADJUSTED_CONVENTIONAL_ACTION"
MATERIAL = "MATERIAL_UNRESOLVED_EVENT"
UNKNOWN = "UNKNOWN_OR_AMBIGUOUS"

# Reasons of a classified event; of withdrawn evidence (class, reason), to be named by the caller.
CLASS_REASONS = ("MISSING_ENTITLEMENT_TERMS_AND_UNVERIFIED_DATE_SEMANTICS", "SOURCE_LABEL_ONLY_SPECIAL_DISTRIBUTIONS_NOT_IDENTIFIABLE",
                 "PHASE1_CONTINUITY_EVIDENCE_NOT_VENDOR_CERTIFICATION", "NO_VERIFIED_CONVENTIONAL_ACTION_EVIDENCE", "UNRECOGNIZED_SOURCE_LABEL")
WITHDRAWN = ("SPECIAL_DISTRIBUTION", "FACTOR_EVIDENCE_WITHDRAWN")
# How a subject was recognised; blocking ones name their type behind the first text.
MATCH = "OFFICIAL_PURPOSE_MATCH:"
MATCH_INFORMATIONAL = {"BUYBACK": "ACCEPTED_OVERLAP_BUYBACKS_NONBLOCKING_21_OF_21", "DIVIDEND": "ACCEPTED_OVERLAP_DIVIDENDS_NONBLOCKING_565_OF_565"}
NO_MATCH = "UNRECOGNIZED_OFFICIAL_PURPOSE_CONSERVATIVELY_BLOCKED"

# Ordered keyword lists that recognise blocking event subjects.
BLOCKING_KEYWORDS = [
    ("SPLIT_OR_FACE_VALUE_CHANGE", ["FACE VALUE", "SPLIT", "SUB-DIVISION", "CONSOLIDATION", "REVERSE SPLIT"]),
    ("BONUS", ["BONUS"]),
    ("RIGHTS", ["RIGHTS"]),
    ("DEMERGER_OR_SPINOFF", ["DEMERGER", "SPIN-OFF", "SPIN OFF"]),
    ("MERGER_OR_AMALGAMATION", ["MERGER", "AMALGAMATION"]),
    ("CAPITAL_REDUCTION", ["CAPITAL REDUCTION"]),
    ("SCHEME_OR_SPECIAL_DISTRIBUTION", ["SCHEME", "ARRANGEMENT", "NCRPS", "DISTRIBUTION", "ENTITLEMENT"]),
]
INFORMATIONAL_KEYWORDS = [("BUYBACK", ["BUY BACK", "BUYBACK"]), ("DIVIDEND", ["DIVIDEND"])]


def event_classify(
    events: DataFrame, evidence: DataFrame, *, label: str = "valid", merger: str = "merger", factor: str = "adj_factor",
    on: tuple[str, str] = ("symbol", "date"), unsettled: DataFrame | None = None,
    withdrawn: tuple[str, str] = WITHDRAWN,
) -> DataFrame:
    """Class, impact, ambiguity and reason from the source label.

    An adjustment factor counts as conventional only if (symbol, date, factor) is in
    ``evidence``; ``unsettled`` lists (symbol, date) whose evidence is withdrawn, to be
    labelled with the class and reason in ``withdrawn``.
    """
    known = evidence.select(*on, F.col("factor").cast("double").alias("_f")).distinct().withColumn("_known", F.lit(True))
    number = F.expr(f"try_cast(`{factor}` as double)")
    rows = events.withColumn("_f", number).join(known, [*on, "_f"], "left")
    if unsettled is not None:
        rows = rows.join(unsettled.select(*on).distinct().withColumn("_u", F.lit(True)), list(on), "left")
    else:
        rows = rows.withColumn("_u", F.lit(False))
    tag = F.col(label)
    doubt = yes("_u")
    material = tag.isin("rights_issue", "demerger", "merger") | F.col(merger).isin("1", "1.0")
    informational = tag.isin("dividend", "buyback")
    factored = tag == "adj_factor_nonan"
    proven = factored & yes("_known")

    def pick(d, m, i, p, f, other):
        return (
            F.when(doubt, d).when(yes(material), m).when(yes(informational), i).when(yes(proven), p).when(yes(factored), f)
            .otherwise(other)
        )

    return (
        rows.withColumn(
            "action_class",
            pick(F.lit(withdrawn[0]), F.upper(tag), F.upper(tag), F.lit("CONVENTIONAL_ACTION_SUPPORTED_BY_PHASE1"),
                 F.lit("UNSPECIFIED_FACTOR_EVENT"), F.lit("UNCLASSIFIED")))
        .withColumn("impact", pick(*[F.lit(x) for x in (UNKNOWN, MATERIAL, NO_ADJUSTMENT, LIKELY_ADJUSTED, UNKNOWN, UNKNOWN)]))
        .withColumn("ambiguous", pick(*[F.lit(x) for x in (True, True, False, False, True, True)]))
        .withColumn(
            "class_reason",
            pick(*[F.lit(x) for x in (withdrawn[1], *CLASS_REASONS)]))
        .drop("_f", "_known", "_u")
    )


def normalized_subject(subject: Column | str) -> Column:
    c = F.col(subject) if isinstance(subject, str) else subject
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))


def subject_classify(events: DataFrame, subject: str = "subject") -> DataFrame:
    """Type, safety and match reason from ordered keywords; anything unrecognised is blocked, never safe."""
    text = normalized_subject(subject)

    def hit(words):
        out = F.lit(False)
        for w in words:
            out = out | text.contains(w)
        return yes(out)

    kind = [(hit(words), name) for name, words in BLOCKING_KEYWORDS + INFORMATIONAL_KEYWORDS]
    blocking = [(hit(words), "BLOCK_PRICE_RETURN_INTERVAL") for _, words in BLOCKING_KEYWORDS]
    informational = [(hit(words), "NONBLOCKING_INFORMATIONAL") for _, words in INFORMATIONAL_KEYWORDS]
    how = [(hit(words), MATCH + name) for name, words in BLOCKING_KEYWORDS] + [(hit(words), MATCH_INFORMATIONAL[name]) for name, words in INFORMATIONAL_KEYWORDS]
    return events.withColumns({
        "action_type": first_reason(kind, "OTHER_OR_UNKNOWN"), "safety": first_reason(blocking + informational, "REVIEW_REQUIRED_BLOCKED"),
        "match_reason": first_reason(how, NO_MATCH)})


def identity_attach(
    events: DataFrame, observed: DataFrame, *, entity: str = "entity", identifier: str = "isin", safety: str = "safety"
) -> DataFrame:
    """Exact match by entity; an identifier never observed for it is a conflict and blocks the event.

    ``observed`` holds (entity, identifier) pairs; identifiers per entity are few.
    """
    ids = observed.where(F.col(identifier).isNotNull()).select(
        entity, F.col(identifier).alias("_id")
    ).distinct()
    known = ids.select(entity).distinct().withColumn("_known", F.lit(True))
    match = ids.withColumnRenamed("_id", identifier).withColumn("_match", F.lit(True))
    rows = events.join(known, entity, "left").join(match, [entity, identifier], "left")
    status = (
        F.when(~yes("_known"), "NOT_OBSERVED").when(yes("_match"), "IDENTIFIER_OBSERVED").otherwise("IDENTIFIER_CONFLICT")
    )
    return (
        rows.withColumn("mapped_entity", F.when(yes("_known"), F.col(entity)))
        .withColumn("identity_status", status)
        .withColumn(safety, F.when(status == "IDENTIFIER_CONFLICT", "REVIEW_REQUIRED_BLOCKED").otherwise(F.col(safety)))
        .drop("_known", "_match")
    )


def blocking_events(
    events: DataFrame, impacts: list[str], *, series: list[str] | None = None, entity: str = "entity",
    session: str = "session", impact: str = "impact",
) -> DataFrame:
    """Distinct (entity, date) of events that invalidate an interval."""
    keep = F.col(impact).isin(impacts)
    if series:
        keep = keep & F.col("series").isin(series)
    return events.where(keep).select(entity, session).distinct()


def event_map_union(*parts: DataFrame, columns: tuple[str, ...] = ("entity", "session")) -> DataFrame:
    """Distinct union of several event tables."""
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out.distinct()


def event_on_day(
    panel: DataFrame, events: DataFrame, *, entity: str = "entity", session: str = "session", impact: str = "impact",
    event_id: str = "event_id", default: str = "NO_RECORDED_EVENT",
) -> DataFrame:
    """Sorted distinct impacts and ids of the row's own date, and how many events it has.

    Pairs are made distinct before they are collected, so a repeated event adds nothing; ``event_ids_on_day`` gives the ids in long form as well.
    """
    day = events.select(entity, session, impact, event_id).distinct().groupBy(entity, session).agg(
        F.concat_ws("|", F.array_sort(F.collect_set(impact))).alias("event_status"),
        F.array_sort(F.collect_set(F.col(event_id).cast("string"))).alias("_ids"),
    )
    day = day.select(entity, session, "event_status", F.concat_ws("|", "_ids").alias("event_ids"), F.size("_ids").cast("long").alias("event_count"))
    return panel.join(day, [entity, session], "left").fillna({"event_status": default, "event_ids": "", "event_count": 0})


def event_ids_on_day(panel: DataFrame, events: DataFrame, *, entity: str = "entity", session: str = "session", event_id: str = "event_id") -> DataFrame:
    """(entity, session, event id) of all events on a row's own date, each once."""
    return panel.select(entity, session).distinct().join(events.select(entity, session, event_id).distinct(), [entity, session])


def exclusion_window(
    events: DataFrame, calendar: DataFrame, before: int, after: int, *, entity: str = "entity", session: str = "session"
) -> DataFrame:
    """Distinct (entity, position) inside the window of any event.

    The window is the event date if it is a session, plus ``before`` strictly earlier and
    ``after`` strictly later sessions; an event between sessions is not moved to one.
    """
    distinct = events.select(entity, session).distinct()
    at = position_of_dates(calendar, distinct.select(session).distinct(), session=session)
    placed = distinct.join(date_dimension(at, session), session)
    first = F.col("sessions_before") - before
    last = F.col("sessions_before") + after - F.when(F.col("is_session"), 0).otherwise(1)
    span = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return placed.select(entity, F.explode(span).alias("position")).distinct()


def flag_excluded(panel: DataFrame, window: DataFrame, *, entity: str = "entity", out: str = "event_excluded") -> DataFrame:
    """Panel rows inside an exclusion window."""
    return panel.join(window.withColumn(out, F.lit(True)), [entity, "position"], "left").fillna({out: False})


def interval_event_crossing(
    intervals: DataFrame, events: DataFrame, *, entity: str = "entity", start: str = "start_date", end: str = "end_date"
) -> DataFrame:
    """Does an event lie in (start, end], for arbitrary intervals.

    Not a range join: interval ends and events of an entity are merged in date order and a
    running count of distinct event dates is read at both ends.
    """
    ends = intervals.select(entity, F.explode(F.array(start, end)).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    marks = events.select(F.col(entity), F.col("session").alias("_d")).distinct().withColumn("_e", F.lit(1))
    timeline = ends.withColumn("_e", F.lit(0)).unionByName(marks)
    upto = W.partitionBy(entity).orderBy("_d").rangeBetween(W.unboundedPreceding, W.currentRow)
    counts = (
        timeline.withColumn("_n", F.sum("_e").over(upto)).where(F.col("_e") == 0).select(entity, "_d", "_n")
    )
    a = counts.select(entity, F.col("_d").alias(start), F.col("_n").alias("_na"))
    b = counts.select(entity, F.col("_d").alias(end), F.col("_n").alias("_nb"))
    return (
        intervals.join(a, [entity, start], "left").join(b, [entity, end], "left")
        .withColumn("crosses_event", yes(F.col("_nb") > F.col("_na")))
        .drop("_na", "_nb")
    )


def _around(events: DataFrame, calendar: DataFrame, window: int, entity: str, session: str, keep: list[str]) -> DataFrame:
    placed = events.join(date_dimension(calendar.select(session, "position"), session), session)
    offsets = F.sequence(F.lit(-window), F.lit(window))
    return placed.select(entity, *keep, "position", F.explode(offsets).alias("relative_session")).select(
        entity, *keep, "relative_session", (F.col("position") + F.col("relative_session")).alias("position")
    )


def event_proximity_flag(
    panel: DataFrame, events: DataFrame, window: int, *, calendar: DataFrame, entity: str = "entity",
    session: str = "session", out: str = "near_event",
) -> DataFrame:
    """Is the row within ``window`` sessions of an event of its entity dated on a session."""
    near = _around(events.select(entity, session).distinct(), calendar, window, entity, session, [])
    keys = near.select(entity, "position").distinct().withColumn(out, F.lit(True))
    return panel.join(keys, [entity, "position"], "left").fillna({out: False})


def event_study(
    panel: DataFrame, events: DataFrame, window: int, measures: list[str], *, calendar: DataFrame,
    by: tuple[str, ...] = ("impact", "action_class"), overall: tuple[str, ...] = ("impact",),
    entity: str = "entity", session: str = "session", event_id: str = "event_id",
) -> DataFrame:
    """Median and 95 % quantile of measures by relative session, per class and over all classes.

    The panel has one row per (entity, position) and the calendar consecutive positions.  Events of one entity, session and class are counted
    before they meet the panel, and read all offsets from frames over one stream per entity; copies for offsets and levels
    are made in the scan in front of the aggregation, which weighs rows by their count.
    """
    first, last = calendar.agg(F.min("position"), F.max("position")).first()
    at = date_dimension(calendar.select(session, "position"), session)
    placed = stage(events.join(at, session).select(entity, event_id, *by, "position"))
    # Each row counts once in its class and once in 'ALL_CLASSES'.
    rest, keys = [c for c in by if c not in overall], [*by, "relative_session"]

    def levels(df: DataFrame) -> DataFrame:
        both = df.withColumn("_all", F.explode(F.array(F.lit(True), F.lit(False))))
        return both.withColumns({c: F.when(F.col("_all"), F.lit("ALL_CLASSES")).otherwise(F.col(c)) for c in rest})

    # An event's offsets inside the calendar are one span around 0.
    spans = levels(placed).groupBy(*by, event_id).agg(F.max("position").alias("_hi"), F.min("position").alias("_lo"))
    low = F.greatest(F.lit(first) - F.col("_hi"), F.lit(-window)).cast("int").alias("_from")
    high = F.least(F.lit(last) - F.col("_lo"), F.lit(window)).cast("int").alias("_to")
    spans = spans.select(*by, low, high).groupBy(*by, "_from", "_to").agg(F.count(F.lit(1)).alias("_n"))
    sources = spans.withColumn("relative_session", F.explode(F.sequence("_from", "_to"))).groupBy(*keys).agg(F.sum("_n").alias("source_events"))

    counted = placed.groupBy(entity, "position", *by).agg(F.count(F.lit(1)).alias("_n"))
    stream = panel.select(entity, "position", *measures).unionByName(counted, allowMissingColumns=True)
    line = W.partitionBy(entity).orderBy("position")
    around = F.array(*[
        F.struct(F.lit(r).alias("relative_session"), *[F.max(m).over(line.rangeBetween(r, r)).alias(m) for m in measures]) for r in range(-window, window + 1)])
    wide = stage(stream.withColumn("_around", around).where(F.col("_n").isNotNull()).select(*by, "_n", "_around"))
    some = F.exists("_around", lambda x: reduce(or_, [x[m].isNotNull() for m in measures]))
    rows = levels(wide.where(some)).select(*by, "_n", F.inline("_around"))
    rows = derived(rows, 2 * (2 * window + 1) * row_count(wide))
    found = summarize_within(
        rows, keys, {m: {f"{m}_median": 0.5, f"{m}_p95": 0.95} for m in measures},
        [F.sum(F.when(F.col(measures[0]).isNotNull(), F.col("_n"))).alias("matched_observations")], weight="_n")
    return same_keys(sources, found, keys, "left").fillna({"matched_observations": 0})


def ledger_reconcile(
    accepted: DataFrame, official: DataFrame, *, on: tuple[str, ...] = ("entity", "series", "session")
) -> DataFrame:
    """Accepted rows matched or not matched by an official key, and official keys nobody accepted; details in long form by ``ledger_details``."""
    groups = official.groupBy(*on).agg(F.count(F.lit(1)).alias("official_count"))
    left = accepted.join(groups, list(on), "left").withColumn(
        "relationship",
        F.when(F.col("official_count").isNotNull(), "ACCEPTED_MATCHED").otherwise("ACCEPTED_ONLY"),
    )
    extra = groups.join(accepted.select(*on).distinct(), list(on), "left_anti").withColumn(
        "relationship", F.lit("OFFICIAL_ONLY")
    )
    out = left.unionByName(extra, allowMissingColumns=True)
    return out.fillna({"official_count": 0})


def ledger_details(
    accepted: DataFrame, official: DataFrame, *, on: tuple[str, ...] = ("entity", "series", "session"), detail: str = "purpose"
) -> DataFrame:
    """Every distinct official (key, detail), and whether an accepted row has that key."""
    keys = accepted.select(*on).distinct().withColumn("_a", F.lit(True))
    relationship = F.when(yes("_a"), "ACCEPTED_MATCHED").otherwise("OFFICIAL_ONLY").alias("relationship")
    return official.select(*on, detail).distinct().join(keys, list(on), "left").select(*on, detail, relationship)
