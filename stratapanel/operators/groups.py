"""Group (sector) mapping, group-day returns and coverage of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import percent_true, ratio, yes
from stratapanel.operators.profile import thresholds


def sector_mapping(
    entities: DataFrame, members: DataFrame, *, entity: str = "entity", name: str = "group_name", code: str = "group_code"
) -> DataFrame:
    """UNIQUE, CONFLICT or UNMAPPED by the number of distinct memberships; a conflict stays NULL."""
    distinct = members.select(entity, name, code).distinct()
    found = distinct.groupBy(entity).agg(
        F.count(F.lit(1)).alias("membership_count"),
        F.min(name).alias("_name"),
        F.min(code).alias("_code"),
        F.concat_ws(
            "|", F.array_sort(F.collect_set(F.concat_ws(":", F.col(name).cast("string"), F.col(code).cast("string"))))
        ).alias("candidates"),
    )
    out = entities.join(found, entity, "left")
    n = F.coalesce("membership_count", F.lit(0))
    return (
        out.withColumn("mapping_status", F.when(n == 1, "UNIQUE").when(n == 0, "UNMAPPED").otherwise("CONFLICT"))
        .withColumn(name, F.when(n == 1, F.col("_name")))
        .withColumn(code, F.when(n == 1, F.col("_code")))
        .withColumn("candidates", F.coalesce("candidates", F.lit("")))
        .drop("_name", "_code", "membership_count")
    )


def tier_membership(
    panel: DataFrame, mapping: DataFrame, universe: str, *, unique: bool, stable: bool, entity: str = "entity",
    out: str = "in_tier",
) -> DataFrame:
    """Universe flag and, where asked for, a unique mapping and a stable identity (missing = ambiguous)."""
    columns = [c for c in mapping.columns if c not in panel.columns or c == entity]
    joined = panel.join(mapping.select(*columns), entity, "left")
    ok = yes(universe)
    if unique:
        ok = ok & yes(F.col("mapping_status") == "UNIQUE")
    if stable:
        ok = ok & ~F.coalesce("identity_ambiguous", F.lit(True))
    return joined.withColumn(out, ok)


def sector_daily_return(
    returns: DataFrame, *, minimum: int, keys: tuple[str, ...] = ("session", "position", "group_name", "group_code"),
    value: str = "entity_return", valid: str = "valid_return",
) -> DataFrame:
    """Equal-weight mean of valid member returns; NULL below ``minimum`` valid members."""
    ok = yes(valid)
    out = returns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible_members"),
        F.count_if(ok).alias("valid_members"),
        F.avg(F.when(ok, F.col(value))).alias("_mean"),
    )
    enough = yes((F.col("valid_members") >= minimum) & F.col("_mean").isNotNull())
    return (
        out.withColumn("invalid_members", F.col("eligible_members") - F.col("valid_members"))
        .withColumn("valid_group_return", enough)
        .withColumn("group_return", F.when(enough, F.col("_mean")))
        .withColumn("group_invalid_reason", F.when(enough, "").otherwise("INSUFFICIENT_VALID_MEMBERS"))
        .drop("_mean")
    )


def group_sizes(
    panel: DataFrame, *, keys: tuple[str, ...] = ("universe", "year", "session"), group: str = "group_code"
) -> DataFrame:
    return panel.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("members"))


def sector_coverage(
    panel: DataFrame, *, keys: tuple[str, ...] = ("universe", "year"), entity: str = "entity", group: str = "group_code",
    status: str = "mapping_status", ambiguous: str = "identity_ambiguous",
) -> DataFrame:
    """Entities and rows by mapping status, and the size of represented groups, per key.

    Entities are first reduced to one row each, so no distinct count sits on raw rows.
    """
    unique = F.col(status) == "UNIQUE"
    usable = unique & ~F.coalesce(ambiguous, F.lit(True))
    per = panel.groupBy(*keys, entity).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(status).alias(status), F.max(ambiguous).alias(ambiguous), F.min(group).alias(group)
    )
    counts = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible_entities"),
        F.sum("_rows").alias("eligible_rows"),
        F.count_if(unique).alias("unique_entities"),
        F.count_if(F.col(status) == "CONFLICT").alias("conflict_entities"),
        F.count_if(F.col(status) == "UNMAPPED").alias("unmapped_entities"),
        F.count_if(yes(ambiguous)).alias("ambiguous_entities"),
        F.count_if(usable).alias("usable_entities"),
        F.coalesce(F.sum(F.when(usable, F.col("_rows"))), F.lit(0)).alias("usable_rows"),
    )
    sizes = per.where(usable).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    shape = sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("represented_groups"),
        F.min("_n").alias("group_size_min"),
        F.percentile("_n", F.lit(0.5)).alias("group_size_median"),
        F.avg("_n").alias("group_size_mean"),
        F.max("_n").alias("group_size_max"),
    )
    return (
        counts.join(shape, list(keys), "left")
        .withColumn("unique_pct", 100 * ratio("unique_entities", "eligible_entities"))
        .withColumn("usable_row_pct", 100 * ratio("usable_rows", "eligible_rows"))
    )


def sector_viability(sizes: DataFrame, levels: tuple[int, ...] = (3, 5, 10), *, keys: tuple[str, ...] = ("universe", "year"),
                     session: str = "session") -> DataFrame:
    """Per size threshold: kept group-dates and rows, and usable groups per date (dates with none count as 0)."""
    long = thresholds(sizes, levels)
    kept = F.col("members") >= F.col("threshold")
    per_date = long.groupBy(*keys, "threshold", session).agg(
        F.count(F.lit(1)).alias("_groups"),
        F.count_if(kept).alias("_kept"),
        F.sum("members").alias("_rows"),
        F.coalesce(F.sum(F.when(kept, F.col("members"))), F.lit(0)).alias("_kept_rows"),
    )
    return per_date.groupBy(*keys, "threshold").agg(
        F.count(F.lit(1)).alias("dates"),
        F.sum("_groups").alias("group_dates"),
        F.sum("_kept").alias("retained_group_dates"),
        F.sum("_rows").alias("rows"),
        F.sum("_kept_rows").alias("retained_rows"),
        (100 * ratio(F.sum("_kept_rows"), F.sum("_rows"))).alias("retained_row_pct"),
        F.avg("_kept").alias("usable_groups_mean"),
        F.percentile("_kept", F.lit(0.5)).alias("usable_groups_median"),
        F.min("_kept").alias("usable_groups_min"),
        F.max("_kept").alias("usable_groups_max"),
    )


def concentration(sizes: DataFrame, *, keys: tuple[str, ...] = ("universe", "year"), session: str = "session",
                  group: str = "group_code") -> DataFrame:
    """Share of the largest and the three largest groups per date, small-group counts, then medians per key."""
    w = W.partitionBy(*keys, session).orderBy(F.col("members").desc(), group)  # one row per group
    n = F.col("members")
    daily = sizes.withColumn("_k", F.row_number().over(w)).groupBy(*keys, session).agg(
        (100 * ratio(F.max(n), F.sum(n))).alias("largest_share_pct"),
        (100 * ratio(F.sum(F.when(F.col("_k") <= 3, n)), F.sum(n))).alias("top3_share_pct"),
        F.count_if(n == 1).alias("singletons"),
        F.count_if(n < 3).alias("below_3"),
        F.count_if(n < 5).alias("below_5"),
        F.count_if(n >= 10).alias("at_least_10"),
        F.count(F.lit(1)).alias("represented"),
    )
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dates"),
        *[med(c) for c in ("largest_share_pct", "top3_share_pct", "singletons", "below_3", "below_5", "at_least_10", "represented")],
        F.avg("largest_share_pct").alias("mean_largest_share_pct"),
        F.max("largest_share_pct").alias("max_largest_share_pct"),
    )


def tier_summary(panel: DataFrame, tiers: dict[str, str], *, entity: str = "entity", session: str = "session",
                 group: str = "group_code") -> DataFrame:
    """Entities, rows and group-date sizes per tier; ``tiers`` maps a name to its flag column."""
    names = F.array_compact(F.array(*[F.when(yes(flag), F.lit(t)) for t, flag in tiers.items()]))
    long = panel.select(entity, session, group, F.explode(names).alias("tier"))
    people = long.groupBy("tier", entity).agg(F.count(F.lit(1)).alias("_r")).groupBy("tier").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("_r").alias("rows")
    )
    cells = long.groupBy("tier", session, group).agg(F.count(F.lit(1)).alias("_n"))
    # Cells are few (groups x dates); their sizes collapse to a histogram before the median.
    shape = cells.groupBy("tier").agg(
        F.percentile("_n", F.lit(0.5)).alias("median_members"),
        percent_true(F.col("_n") >= 3).alias("pct_ge3"),
        percent_true(F.col("_n") >= 5).alias("pct_ge5"),
        percent_true(F.col("_n") >= 10).alias("pct_ge10"),
    )
    groups_ = long.select("tier", group).distinct().groupBy("tier").agg(F.count(F.lit(1)).alias("groups"))
    return people.join(shape, "tier").join(groups_, "tier")


def universe_counts(panel: DataFrame, reference: DataFrame | None = None, *, entity: str = "entity",
                    session: str = "session") -> DataFrame:
    """Eligible entities per date summarised by year and universe, and the share of a reference set."""
    year = F.year(F.col(session))
    per_day = panel.groupBy("universe", session).agg(F.count(F.lit(1)).alias("_n"))
    days = per_day.groupBy("universe", year.alias("year")).agg(
        F.min("_n").alias("daily_min"), F.percentile("_n", F.lit(0.5)).alias("daily_median"),
        F.avg("_n").alias("daily_mean"), F.max("_n").alias("daily_max"),
    )
    per = panel.groupBy("universe", year.alias("year"), entity).agg(F.count(F.lit(1)).alias("_r"))
    if reference is not None:
        per = per.join(reference.select(entity).distinct().withColumn("_in", F.lit(True)), entity, "left")
    else:
        per = per.withColumn("_in", F.lit(False))
    member = per.groupBy("universe", "year").agg(
        F.sum("_r").alias("rows"),
        F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum(F.when(yes("_in"), F.col("_r"))), F.lit(0)).alias("reference_rows"),
        F.count_if(~yes("_in")).alias("outside_entities"),
    )
    out = days.join(member, ["universe", "year"])
    return out.withColumn("reference_pct", 100 * ratio("reference_rows", "rows"))


def mapping_summary(members: DataFrame, mapping: DataFrame, *, entity: str = "entity", code: str = "group_code") -> DataFrame:
    """Per group file: rows, duplicates, and its unique, stable and conflicted entities."""
    lines = members.groupBy(code, entity).agg(F.count(F.lit(1)).alias("_n"))
    status = mapping.select(entity, "mapping_status", "identity_ambiguous")
    joined = lines.join(status, entity, "left")
    unique = F.col("mapping_status") == "UNIQUE"
    return joined.groupBy(code).agg(
        F.sum("_n").alias("source_rows"),
        F.count(F.lit(1)).alias("distinct_entities"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count_if(yes(unique)).alias("unique_entities"),
        F.count_if(yes(unique & ~F.col("identity_ambiguous"))).alias("stable_entities"),
        F.count_if(yes(F.col("mapping_status") == "CONFLICT")).alias("conflict_entities"),
    )


def identity_aliases(daily: DataFrame, *, entity: str = "entity", identifier: str = "isin", session: str = "session") -> DataFrame:
    """Entities that share an identifier, identifiers per entity and a continuity status.

    An entity in two sharing groups reports the group of its last identifier in sort order: that identifier, the number of others in it and
    their list.  ``alias_groups`` has the members of all groups in long form as well.
    Pairs are reduced to distinct (entity, identifier) first; a member list is made once for each identifier that an entity reports.
    """
    base = daily.groupBy(entity).agg(
        F.min(session).alias("first_session"), F.max(session).alias("last_session"), F.count(F.lit(1)).alias("observed_sessions")
    )
    pairs = daily.where(F.col(identifier).isNotNull()).select(entity, identifier).distinct()
    sizes = pairs.groupBy(identifier).agg(F.count(F.lit(1)).alias("_n"))
    ids = pairs.join(sizes, identifier).groupBy(entity).agg(
        F.count(F.lit(1)).alias("identifier_count"), F.max(F.when(F.col("_n") > 1, F.col(identifier))).alias("shared_identifier"))
    picked = ids.where(F.col("shared_identifier").isNotNull()).select(F.col("shared_identifier").alias(identifier)).distinct()
    groups = pairs.join(picked, identifier, "left_semi").groupBy(F.col(identifier).alias("shared_identifier")).agg(F.array_sort(F.collect_list(entity)).alias("_g"))
    out = base.join(ids, entity, "left").join(groups, "shared_identifier", "left")
    others = F.array_remove(F.col("_g"), F.col(entity))
    out = out.withColumn("known_alias", F.coalesce(F.concat_ws("|", others.cast("array<string>")), F.lit("")))
    out = out.withColumn("alias_count", F.coalesce(F.size(others), F.lit(0)).cast("long")).fillna({"identifier_count": 0})
    status = (
        F.when(F.col("alias_count") > 0, "SHARED_IDENTIFIER_NOT_STITCHED")
        .when(F.col("identifier_count") > 1, "SEVERAL_IDENTIFIERS")
        .otherwise("OBSERVED_NOT_STITCHED")
    )
    return (
        out.withColumn("continuity_status", status)
        .withColumn("identity_ambiguous", (F.col("alias_count") > 0) | (F.col("identifier_count") > 1))
        .drop("_g")
    )


def alias_groups(daily: DataFrame, *, entity: str = "entity", identifier: str = "isin") -> DataFrame:
    """(identifier, entity) of every identifier that several entities share."""
    pairs = daily.where(F.col(identifier).isNotNull()).select(identifier, entity).distinct()
    shared = pairs.groupBy(identifier).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(identifier)
    return pairs.join(shared, identifier, "left_semi")
