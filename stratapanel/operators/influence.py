"""Influence of single entities, groups and coverage bands on the evidence."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapanel.functions.scalars import ratio
from stratapanel.operators.evidence import bucket_spread_daily, correlation, correlation_aggregate, daily_statistics, summarize_daily
from stratapanel.operators.orderstats import Split, average_ranks_within, quantiles_within, same_keys, totals_above
from stratapanel.runtime import clustered, explode_literals, row_count, stage


def _inversions(ranked: DataFrame, keys: list[str], entity: str, split: Split) -> DataFrame:
    """Per row: how many rows have a larger x and a larger y, rows with equal y counting half.

    Pairs are never formed.  Two ranks differ first at one binary digit, so each row is
    repeated once per digit of the group size; inside (digit, higher digits) the rows
    with digit 1 and larger y are a running sum.  n log n rows instead of n * n.
    """
    digits = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("_m"))).cast("int") - 1, F.lit(0)))
    x = F.col("_x").cast("long") - 1
    long = (
        ranked.select(*keys, entity, "_y", x.alias("_x0"), F.explode(digits).alias("_digit"))
        .withColumn("_prefix", F.expr("shiftright(_x0, _digit + 1)"))
        .withColumn("_bit", F.expr("cast(shiftright(_x0, _digit) & 1 as double)"))
    )
    sums = totals_above(long, [*keys, "_digit", "_prefix"], "_y", "_bit", above="_more", equal="_same", split=split)
    return (
        sums.where(F.col("_bit") == 0)
        .groupBy(*keys, entity)
        .agg(F.sum(F.col("_more") + F.col("_same") / 2).alias("_inv"))
    )


def _concordant(place: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Per row: how many rows have a larger place and a larger number ``tied``, equal numbers counting half.

    The digits of ``_inversions``, over one group in memory: rows stay sorted by (higher digits, number) and are dealt by one more digit each time.
    """
    n, at = len(place), np.argsort(tied, kind="stable")
    z, y, out, line = place[at], tied[at], np.zeros(len(place)), np.arange(len(place))
    for digit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
        block, one = z >> (digit + 1), (z >> digit & 1).astype(bool)
        ones = np.concatenate([[0], np.cumsum(one)])
        new = np.concatenate([[True], block[1:] != block[:-1]])
        run = np.flatnonzero(np.concatenate([[True], new[1:] | (y[1:] != y[:-1])]))
        starts = np.flatnonzero(new)
        start, end = (np.repeat(e, np.diff(np.append(starts, n))) for e in (starts, np.append(starts[1:], n)))
        first, last = (np.repeat(e, np.diff(np.append(run, n))) for e in (run, np.append(run[1:], n)))
        found = ones[end] - ones[last] + (ones[last] - ones[first]) / 2
        out[z[~one]] += found[~one]
        before = ones[:-1] - ones[start]
        to = np.where(one, end - (ones[end] - ones[start]) + before, line - before)
        z[to], y[to] = z.copy(), y.copy()
    return out[place]


def _without_each(factor: np.ndarray, o: np.ndarray, q: int, minimum: int) -> list[tuple]:
    """``deletion_statistics`` of one group: correlation and spread without each row, each with a mask of the rows that have none (None: all)."""
    n = len(o)

    def ranks(v):
        _, number, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[number], number, count

    (x, _, _), (y, number, count) = ranks(factor), ranks(o)
    ic = spread = flat = None
    if n >= 3:
        place = np.empty(n, np.int64)
        place[np.argsort(x, kind="stable")] = np.arange(n)
        t, k, x_same = count[number].astype(float), n - 1.0, np.bincount(number, x)
        x_above = (x_same.sum() - np.cumsum(x_same))[number]
        y_line = np.empty(n)
        y_line[place] = y
        y_above = (y_line.sum() - np.cumsum(y_line))[place]
        sxy = (x * y).sum() - x * y - x_above - (x_same[number] - x) / 2 - y_above + _concordant(place, number)
        s1, s2 = k * (k + 1) / 2, k * (k + 1) * (2 * k + 1) / 6
        syy = s2 - ((t * t - 1).sum() - (t**3 - t) + ((t - 1) ** 3 - (t - 1))) / 12
        vx, vy = s2 - s1 * s1 / k, syy - s1 * s1 / k
        flat = (vx <= 1e-12 * s2) | (vy <= 1e-12 * syy)
        ic = (sxy - s1 * s1 / k) / np.sqrt(np.where(flat, 1.0, vx * vy))
    # k and k+1 members at either end, as one may be deleted.
    low, high = (n + q - 2) // q, (n - 1) - ((q - 1) * (n - 1) + q - 1) // q
    if n >= minimum and low > 0 and high > 0:
        bottom = np.where(x <= low, o[x <= low + 1].sum() - o, o[x <= low].sum()) / low
        top = np.where(x > n - high, o[x > n - high - 1].sum() - o, o[x > n - high].sum()) / high
        spread = top - bottom
    return [(ic, flat), (spread, None)]


def deletion_statistics(
    pairs: DataFrame, *, keys: list[str], entity: str = "entity", factor: str = "rank", outcome: str = "outcome",
    q: int = 10, minimum: int = 11,
) -> DataFrame:
    """Exact Spearman correlation and re-bucketed spread of the group without each row.

    Factor values are unique within the group.  All sums after a deletion follow from
    sums before it, so the cost is n log n per group.  Groups that need no cut meet in one task each, with one exchange of the
    rows; if a group has to be cut, all are counted from rows in long form (``_inversions``).
    """
    both = stage(pairs.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull()).select(*keys, entity, factor, outcome))
    if not Split(both, keys, {factor: [factor], outcome: [outcome]}).any:
        whole = both.where(reduce(and_, [F.col(c).isNotNull() for c in keys])).select(*keys, entity, F.col(factor).cast("double").alias("_f"), F.col(outcome).cast("double").alias("_o"))

        def run(rows: pa.Table) -> pa.Table:
            found = _without_each(rows["_f"].to_numpy(), rows["_o"].to_numpy(), q, minimum)
            numbers = [pa.nulls(len(rows), pa.float64()) if v is None else pa.array(v, pa.float64(), mask=gone) for v, gone in found]
            columns = [pa.array(np.full(len(rows), len(rows)), pa.int64()), *numbers]
            return pa.table([*rows.select([*keys, entity]).columns, *columns], names=[*keys, entity, "observations", "ic_without", "spread_without"])

        added = [T.StructField("observations", T.LongType()), T.StructField("ic_without", T.DoubleType()), T.StructField("spread_without", T.DoubleType())]
        schema = T.StructType([*whole.select(*keys, entity).schema.fields, *added])
        return clustered(whole, keys, row_count(both)).groupBy(*keys).applyInArrow(run, schema)
    ranked = stage(average_ranks_within(both, keys, {"_x": factor, "_y": outcome}, size="_m"))
    # One cut serves every sum: groups that need no boundary here need none among their digits.
    split = Split(ranked, keys, {"_x": ["_x"], "_y": ["_y"]})
    rows = totals_above(ranked.withColumn("_one", F.lit(1)), keys, "_y", "_x", above="_x_above", equal="_x_same", split=split)
    rows = totals_above(rows, keys, "_x", "_y", above="_y_above", split=split)
    rows = totals_above(rows, keys, "_y", "_one", above="_c_above", equal="_t", split=split).drop("_c_above")
    inv = _inversions(ranked, keys, entity, split)
    # Outcome sums of the lowest and highest members; k and k+1 members, as one may be deleted.
    n = F.col("_m")
    low = F.floor((n + q - 2) / q)
    high = (n - 1) - F.floor(((q - 1) * (n - 1) + q - 1) / q)
    o, x, t = F.col(outcome), F.col("_x"), F.col("_t").cast("double")
    rows = stage(rows.withColumn("_low", low).withColumn("_high", high)) if split.any else rows.withColumn("_low", low).withColumn("_high", high)
    group = rows.groupBy(*keys).agg(
        F.sum(x * F.col("_y")).alias("_sxy"),
        F.sum(t * t - 1).alias("_ties"),
        F.sum(F.when(x <= F.col("_low"), o)).alias("_p0"),
        F.sum(F.when(x <= F.col("_low") + 1, o)).alias("_p1"),
        F.sum(F.when(x > n - F.col("_high"), o)).alias("_q0"),
        F.sum(F.when(x > n - F.col("_high") - 1, o)).alias("_q1"),
    )
    j = rows.join(group, keys).join(inv, [*keys, entity], "left")
    k = n.cast("double") - 1
    s1, s2 = k * (k + 1) / 2, k * (k + 1) * (2 * k + 1) / 6
    ties = F.col("_ties") - (t * t * t - t) + ((t - 1) * (t - 1) * (t - 1) - (t - 1))
    sxy = (
        F.col("_sxy") - x * F.col("_y") - F.col("_x_above") - (F.col("_x_same") - x) / 2 - F.col("_y_above")
        + F.coalesce("_inv", F.lit(0.0))
    )
    ic = F.when(n >= 3, correlation(k, s1, s1, s2, s2 - ties / 12, sxy))
    bottom = F.when(x <= F.col("_low"), F.col("_p1") - o).otherwise(F.col("_p0")) / F.col("_low")
    top = F.when(x > n - F.col("_high"), F.col("_q1") - o).otherwise(F.col("_q0")) / F.col("_high")
    return j.select(
        *keys, entity, F.col("_m").alias("observations"), ic.alias("ic_without"),
        F.when(n >= minimum, top - bottom).alias("spread_without"),
    )


def leave_one_entity_out(
    pairs: DataFrame, *, pair: list[str], session: str = "session", entity: str = "entity", factor: str = "rank",
    outcome: str = "outcome", q: int = 10, minimum: int = 10,
) -> DataFrame:
    """Mean IC and spread after deleting each entity everywhere.

    Dates without the entity keep their statistic, dates with it use the exact
    delete-one value.
    """
    keys = [*pair, session]
    pairs = stage(pairs.select(*keys, entity, factor, outcome))
    without = deletion_statistics(
        pairs, keys=keys, entity=entity, factor=factor, outcome=outcome, q=q, minimum=minimum + 1
    )
    ranked = average_ranks_within(pairs, keys, {"_x": factor}, size="_m")
    bucket = F.when(F.col("_m") >= minimum, F.floor((F.col("_x") - 1) * q / F.col("_m")) + 1)
    daily = daily_statistics(ranked.withColumn("bucket", bucket), q, keys=keys, factor="_x", outcome=outcome, count="_m")
    daily = stage(daily.select(*keys, "ic", "spread"))
    total = daily.groupBy(*pair).agg(
        F.sum("ic").alias("_i"), F.count("ic").alias("_in"), F.avg("ic").alias("baseline_mean_ic"),
        F.sum("spread").alias("_s"), F.count("spread").alias("_sn"), F.avg("spread").alias("baseline_mean_spread"),
    )
    own = without.join(daily, keys).groupBy(*pair, entity).agg(
        F.count(F.lit(1)).alias("present_dates"),
        F.coalesce(F.sum("ic"), F.lit(0.0)).alias("_oi"), F.count("ic").alias("_oin"),
        F.coalesce(F.sum("ic_without"), F.lit(0.0)).alias("_wi"), F.count("ic_without").alias("_win"),
        F.coalesce(F.sum("spread"), F.lit(0.0)).alias("_os"), F.count("spread").alias("_osn"),
        F.coalesce(F.sum("spread_without"), F.lit(0.0)).alias("_ws"), F.count("spread_without").alias("_wsn"),
    )
    c = F.col
    out = own.join(total, pair)
    return (
        out.withColumn("excluded_mean_ic", ratio(c("_i") - c("_oi") + c("_wi"), c("_in") - c("_oin") + c("_win")))
        .withColumn("excluded_mean_spread", ratio(c("_s") - c("_os") + c("_ws"), c("_sn") - c("_osn") + c("_wsn")))
        .withColumn("mean_ic_change", c("excluded_mean_ic") - c("baseline_mean_ic"))
        .withColumn("mean_spread_change", c("excluded_mean_spread") - c("baseline_mean_spread"))
        .select(
            *pair, entity, "present_dates", "baseline_mean_ic", "excluded_mean_ic", "mean_ic_change",
            "baseline_mean_spread", "excluded_mean_spread", "mean_spread_change",
        )
    )


def _without_groups(pairs: DataFrame, groups: list[str], keys: list[str], group: str, factor: str, outcome: str) -> DataFrame:
    """Rows with both values, once for every group they are not in, with the ranks they have without it.

    A rank falls by the number of the group's rows below, a tie by half of that.  These numbers are running counts, one for each group, over
    one sorted partition; copies are made behind the sort and meet in the same partition again.  ``_b`` and ``_m`` are rank and size among all
    rows, ``_x`` and ``_y`` ranks among rows with both values.
    """
    whole = W.partitionBy(*keys)
    both = F.col(factor).isNotNull() & F.col(outcome).isNotNull()
    orders = {"_b": (factor, F.lit(True)), "_x": (factor, both), "_y": (outcome, both)}

    def below(mark: Column, value: str) -> Column:
        count = F.count_if(mark)
        # Ties from the same window: the running count through them and the one in front of them.
        line = whole.orderBy(value)
        return count.over(line) - count.over(line.rangeBetween(W.currentRow, W.currentRow)) / 2

    def ranks(mark) -> list[Column]:
        return [below(mark & used, value).alias(name) for name, (value, used) in orders.items()]

    def member(name: str) -> Column:
        return F.coalesce(F.col(group) == name, F.lit(False))

    own = F.struct(*ranks(F.lit(True)), F.count(F.lit(1)).over(whole).alias("_m"))
    lost = F.array(*[
        F.struct(F.lit(g).alias("excluded_group"), *ranks(member(g)), F.count_if(member(g)).over(whole).alias("_m")) for g in groups])
    pairs = clustered(pairs.select(*keys, group, factor, outcome), keys, row_count(pairs))
    rows = pairs.select(*keys, group, factor, outcome, own.alias("_own"), lost.alias("_lost")).where(both)
    rows = rows.select(*keys, group, outcome, "_own", F.explode("_lost").alias("_g")).where(F.col(group).isNull() | (F.col(group) != F.col("_g.excluded_group")))
    left = [(F.col(f"_own.{c}") - F.col(f"_g.{c}") + F.lit(0.5)).alias(c) for c in orders]
    return rows.select(*keys, "_g.excluded_group", outcome, *left, (F.col("_own._m") - F.col("_g._m")).alias("_m"))


def leave_one_group_out(
    pairs: DataFrame, groups: list[str], *, pair: list[str], session: str = "session", group: str = "group_name",
    factor: str = "rank", outcome: str = "outcome", q: int = 10, minimum: int = 10,
) -> DataFrame:
    """Summary without each named group, with the rest ranked and bucketed again.

    Rows without a group stay in every run.  The rows shuffled do not depend on the number of groups (``_without_groups``), unless a cross-section is
    so large that it has to be cut: then it is ranked anew for every group, in pieces.
    """
    keys, by = [*pair, session], [*pair, session, "excluded_group"]
    pairs = stage(pairs.select(*keys, group, factor, outcome))
    if Split(pairs, keys, {factor: [factor]}).any:
        long = explode_literals(pairs, [(g,) for g in groups], [("excluded_group", "string")])
        rest = long.where(F.col(group).isNull() | (F.col(group) != F.col("excluded_group")))
        ranked = average_ranks_within(rest, by, {"_b": factor}, size="_m")
        known = ranked.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
        ranked = average_ranks_within(known, by, {"_x": factor, "_y": outcome})
    else:
        ranked = _without_groups(pairs, groups, keys, group, factor, outcome)
    bucket = F.when(F.col("_m") >= minimum, F.floor((F.col("_b") - 1) * q / F.col("_m")) + 1)
    daily = bucket_spread_daily(
        ranked.withColumn("bucket", bucket), q, keys=by, outcome=outcome,
        extra={"observations": F.count(F.lit(1)), "ic": correlation_aggregate("_x", "_y")})
    return summarize_daily(daily, keys=[*pair, "excluded_group"])


def against_baseline(cells: DataFrame, baseline: DataFrame, *, pair: list[str]) -> DataFrame:
    """IC and spread of the cells minus the baseline of the same pair."""
    base = baseline.select(*pair, F.col("mean_ic").alias("baseline_mean_ic"), F.col("mean_spread").alias("baseline_mean_spread"))
    return (
        cells.join(base, pair)
        .withColumn("mean_ic_change", F.col("mean_ic") - F.col("baseline_mean_ic"))
        .withColumn("mean_spread_change", F.col("mean_spread") - F.col("baseline_mean_spread"))
    )


def coverage_bands(
    panel: DataFrame, formations: tuple[int, ...], *, valid: str = "valid_ret_{}", entity: str = "entity",
    low: float = 0.25, high: float = 0.75, labels: tuple[str, str, str] = ("LOW", "MIDDLE", "HIGH"),
) -> DataFrame:
    """Band of each (formation, entity) by the share of its rows with a valid signal."""
    shares = F.array(
        *[F.struct(F.lit(h).alias("formation"), F.coalesce(F.col(valid.format(h)), F.lit(False)).alias("ok")) for h in formations]
    )
    long = panel.select(entity, F.explode(shares).alias("s")).select(entity, "s.formation", "s.ok")
    retained = long.groupBy("formation", entity).agg((100 * ratio(F.count_if("ok"), F.count(F.lit(1)))).alias("retained_pct"))
    retained = stage(retained)
    edges = quantiles_within(retained, ["formation"], "retained_pct", {"low_edge": low, "high_edge": high})
    r = F.col("retained_pct")
    return same_keys(retained, edges, ["formation"]).withColumn(
        "band", F.when(r <= F.col("low_edge"), labels[0]).when(r < F.col("high_edge"), labels[1]).otherwise(labels[2])
    )


def coverage_band_sensitivity(
    pairs: DataFrame, bands: DataFrame, *, pair: list[str], session: str = "session", entity: str = "entity",
    factor: str = "rank", outcome: str = "outcome", q: int = 10, minimum: int = 10,
) -> DataFrame:
    """Summary inside each coverage band, ranked again inside the band."""
    tagged = pairs.join(bands.select("formation", entity, "band"), ["formation", entity])
    keys = [*pair, "band", session]
    ranked = average_ranks_within(tagged, keys, {"_x": factor}, size="_m")
    bucket = F.when(F.col("_m") >= minimum, F.floor((F.col("_x") - 1) * q / F.col("_m")) + 1)
    daily = daily_statistics(ranked.withColumn("bucket", bucket), q, keys=keys, factor="_x", outcome=outcome, count="_m")
    return summarize_daily(daily, keys=[*pair, "band"])


def residualize_same_date(
    df: DataFrame, target: str, first: str, second: str, *, keys: list[str] | None = None, out: str = "residual",
    entity: str = "entity",
) -> DataFrame:
    """Residual of ``target`` on two controls and an intercept, per group.

    The fit comes from moment sums; on a singular group one control, or both, is left
    out, which does not change the residual.  Rows missing a value are dropped.
    """
    keys = keys or ["session"]
    known = df.where(F.col(target).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull())
    y, a, b = (F.col(c).cast("double") for c in (target, first, second))
    sums = known.groupBy(*keys).agg(
        F.avg(y).alias("_y"), F.avg(a).alias("_a"), F.avg(b).alias("_b"),
        F.covar_pop(a, a).alias("_aa"), F.covar_pop(b, b).alias("_bb"), F.covar_pop(a, b).alias("_ab"),
        F.covar_pop(a, y).alias("_ay"), F.covar_pop(b, y).alias("_by"),
    )
    c = F.col
    det = c("_aa") * c("_bb") - c("_ab") * c("_ab")
    singular = det <= 1e-12 * c("_aa") * c("_bb")
    only_a, only_b = F.coalesce(ratio("_ay", "_aa"), F.lit(0.0)), F.coalesce(ratio("_by", "_bb"), F.lit(0.0))
    use_a = c("_aa") > 0
    fit = sums.select(
        *keys, "_y", "_a", "_b",
        F.when(~singular, (c("_ay") * c("_bb") - c("_by") * c("_ab")) / det).when(use_a, only_a).otherwise(0.0).alias("_ka"),
        F.when(~singular, (c("_by") * c("_aa") - c("_ay") * c("_ab")) / det).when(use_a, 0.0).otherwise(only_b).alias("_kb"),
    )
    value = (y - c("_y")) - c("_ka") * (a - c("_a")) - c("_kb") * (b - c("_b"))
    return known.join(fit, keys).withColumn(out, value).drop("_y", "_a", "_b", "_ka", "_kb")

