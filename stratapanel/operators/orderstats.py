"""Exact ranks, sums and quantiles per group; one group may hold most of the rows.

A group is sorted in one task as long as it holds about a piece of rows (``PIECE_ROWS``).  Larger groups are found, and cut, by
one random sample of rows for all columns of a call: every group with more than its share of the sample gets boundaries
inside, evenly spaced among its own sampled keys (value, tie).  So pieces hold about equally many rows wherever they crowd: in one group, in a
narrow range of values, among the ties of one value, or among copies of values.  Rows of smaller groups never meet a boundary.

Where only values matter, rows of cut tables first collapse to cells (group, value) with map-side counts, so copies of one value are
one row.  A small sum over the pieces of a group gives every piece its starting position; only groups with a boundary inside have several, so that
table has at most two rows for each boundary.

Quantiles of cut tables are read from brackets: two sampled values around each place, one scan that counts the rows below, one that
collects the rows between.  A place that lies outside of its bracket is found by cells of the whole group instead.

NULL is a group key like any other.  NULL values rank first as one value, infinite ones at the ends and NaN last, as
Spark sorts them; quantiles leave NULLs out.

The sample reads the input before the rows do, so it is written once (``runtime.stage``) unless it already is, or is flagged
as cheap to read again (``runtime.derived``).
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.runtime import clustered, materialize, row_count, stage

#: Rows of a piece, sampled rows for each piece, and the most pieces (beyond that they grow).
PIECE_ROWS, SAMPLED, MOST_PIECES = 1 << 20, 32, 4096


def _order_key(values: tuple) -> tuple:
    """Python order of sort keys as Spark has it: NULL first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


class Split:
    """Boundaries inside the large groups of a staged frame, for several sort orders at once.

    ``orders`` names the columns that follow the keys in each order.  ``any`` tells whether a boundary was needed at all.
    """

    def __init__(self, df: DataFrame, keys: list[str], orders: dict[str, list[str]], pieces: int | None = None):
        self.keys, self.orders = keys, orders
        self.bounds: dict[str, list[tuple]] = {name: [] for name in orders}
        self.schema = df.schema
        rows = row_count(df) if pieces is None else 0
        want = pieces or min(MOST_PIECES, -(-rows // PIECE_ROWS))
        if want > 1:
            self._draw(df, want, rows or row_count(df))
        self.any = any(self.bounds.values())

    def _draw(self, df: DataFrame, want: int, rows: int) -> None:
        columns = list(dict.fromkeys([*self.keys, *(c for order in self.orders.values() for c in order)]))
        share = SAMPLED * want / max(1, rows)
        some = df.select(*columns)
        sample = [tuple(r) for r in (some.where(F.rand(17) < share) if share < 1 else some).collect()]
        place = {c: i for i, c in enumerate(columns)}
        groups = defaultdict(list)
        for row in sample:
            groups[_order_key(tuple(row[place[k]] for k in self.keys))].append(row)
        per_piece = max(1.0, len(sample) / want)
        for _, members in sorted(groups.items()):
            n = round(len(members) / per_piece)
            if n < 2:
                continue
            for name, order in self.orders.items():
                at = [place[c] for c in [*self.keys, *order]]
                line = sorted((tuple(row[i] for i in at) for row in members), key=_order_key)
                cuts = [line[len(line) * i // n] for i in range(1, n)]
                self.bounds[name] += [c for i, c in enumerate(cuts) if not i or _order_key(c) != _order_key(cuts[i - 1])]

    def piece(self, name: str) -> Column:
        """Number of the piece a row belongs to; rises with the sort key, and is the same for all rows of a group without boundaries.

        A search over every k-th boundary, then over the k behind it.
        """
        columns = [*self.keys, *self.orders[name]]
        types = [self.schema[c].dataType for c in columns]
        bounds = [F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(row, types, strict=True))]) for row in self.bounds[name]]
        if not bounds:
            return F.lit(0)
        key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(columns)])
        width = math.isqrt(len(bounds) - 1) + 1
        below = lambda some: F.size(F.filter(some, lambda b: b < key))
        blocks = [F.array(*bounds[i : i + width]) for i in range(0, len(bounds), width)]
        if len(blocks) == 1:
            return below(blocks[0])
        block = below(F.array(*[bounds[i] for i in range(width, len(bounds), width)]))
        return block * width + below(F.element_at(F.array(*blocks), block + 1))


def same_keys(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", *, hint: bool = False) -> DataFrame:
    """Null-safe join on equally named columns; those of ``a`` stay."""
    renamed = b.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in b.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return a.join(F.broadcast(renamed) if hint else renamed, match, how).drop(*[f"_r_{c}" for c in on])


def _placed(df: DataFrame, keys: list[str], n: Column, weight: Column, rows: int = 0) -> DataFrame:
    """Adds ``_start`` (rows of the group in earlier pieces) and ``_size`` (rows of the group), given ``_piece``.

    ``n`` counts a row, as an aggregate, ``weight`` over a window; ``rows``: how many there may be, for the number of tasks.  Only groups in several pieces are joined: at most two rows for each boundary.
    """
    group = W.partitionBy(*keys)
    sums = df.groupBy(*keys, "_piece").agg(n.alias("_g"))
    running = F.sum("_g").over(group.orderBy("_piece").rowsBetween(W.unboundedPreceding, 0))
    several = sums.select(*keys, "_piece", (running - F.col("_g")).alias("_start"), F.sum("_g").over(group).alias("_all"), F.count(F.lit(1)).over(group).alias("_k"))
    out = clustered(same_keys(df, several.where("_k > 1").drop("_k"), [*keys, "_piece"], "left", hint=True), [*keys, "_piece"], rows)
    whole = F.coalesce("_all", weight.over(W.partitionBy(*keys, "_piece")))
    return out.withColumns({"_start": F.coalesce("_start", F.lit(0)), "_size": whole}).drop("_all")


def _cells(df: DataFrame, keys: list[str], split: Split, name: str, weight: Column | None = None) -> DataFrame:
    """One row per (keys, value ``_v``) with its row count ``_n``, the number of rows ``_before`` it in the
    group and the group size ``_size`` (or sums of ``weight``)."""
    value = split.orders[name][0]
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = df.groupBy(*keys, F.col(value).alias("_v"), split.piece(name).alias("_piece")).agg(measure.alias("_n"))
    return _running(cells, keys, row_count(df) if getattr(df, "_stratapanel_staged", False) else 0)


def _running(cells: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``_cells`` of a frame with one row for each (keys, ``_v``), its ``_n`` and ``_piece``."""
    placed = _placed(cells, keys, F.sum("_n"), F.sum("_n"), rows)
    inside = W.partitionBy(*keys, "_piece").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return placed.select(*keys, "_v", "_n", (F.col("_start") + F.sum("_n").over(inside) - F.col("_n")).alias("_before"), "_size")


def ordinal_within(
    df: DataFrame, keys: list[str], value: str, tie: str, *, rank: str = "rank", size: str = "count", bounded: bool = False, pieces: int | None = None,
) -> DataFrame:
    """Unique 1-based ordinal per group, ascending by (value, tie), and the group size.

    (keys, tie) must be unique.  ``bounded``: groups are short by construction, so no sample is needed.
    """
    df = df if bounded else stage(df)
    split = None if bounded else Split(df, keys, {"order": [value, tie]}, pieces)
    if split is None or not split.any:
        group = W.partitionBy(*keys)
        df = df if bounded else clustered(df, keys, row_count(df))
        line = group.orderBy(value, tie)
        whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return df.withColumns({rank: F.row_number().over(line).cast("long"), size: F.count(F.lit(1)).over(whole)})
    placed = _placed(df.withColumn("_piece", split.piece("order")), keys, F.count(F.lit(1)), F.count(F.lit(1)), row_count(df))
    local = W.partitionBy(*keys, "_piece").orderBy(value, tie)
    return placed.withColumn(rank, F.col("_start") + F.row_number().over(local)).withColumnRenamed("_size", size).drop("_piece", "_start")


def first_within(df: DataFrame, keys: list[str], order: list[Column], tie: str, k: int, *, slices: int = 64) -> DataFrame:
    """The first ``k`` rows of every group by ``order``, then ``tie`` (unique): taken in each hash slice of the group first, so no group is sorted as a whole."""
    line = [*order, F.col(tie)]
    some = df.withColumn("_slice", F.pmod(F.xxhash64(tie), F.lit(slices)))
    some = some.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*line))).where(F.col("_k") <= k)
    return some.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*line))).where(F.col("_k") <= k).drop("_k", "_slice")


def average_ranks_within(
    df: DataFrame, keys: list[str], ranks: dict[str, str], *, size: str | None = None, pieces: int | None = None, split: Split | None = None,
) -> DataFrame:
    """Tie-averaged ranks per group; ``ranks`` maps output name to value column.

    ``split``: the cut of a frame with the same groups and value columns, if one was drawn before.
    """
    df = stage(df) if split is None else df
    split = split or Split(df, keys, {v: [v] for v in ranks.values()}, pieces)
    out = df
    if not split.any:
        # One exchange for all columns and one sort for each: a rank's ties are read off the running count of its own window.
        out = clustered(df, keys, row_count(df))
        for name, value in ranks.items():
            line = W.partitionBy(*keys).orderBy(value)
            upto = F.count(F.lit(1)).over(line.rangeBetween(W.unboundedPreceding, W.currentRow))
            new = {name: (F.rank().over(line) + upto) / 2}
            if size:
                new[size], size = F.count(F.lit(1)).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), None
            out = out.withColumns(new)
        return out
    for i, (name, value) in enumerate(ranks.items()):
        cells = _cells(df, keys, split, value)
        out = same_keys(out.withColumn("_v", F.col(value)), cells, [*keys, "_v"])
        out = out.withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2)
        if size and i == 0:
            out = out.withColumn(size, F.col("_size"))
        out = out.drop("_v", "_n", "_before", "_size")
    return out


def _read_off(cells: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles from cells."""
    first, last = F.col("_before"), F.col("_before") + F.col("_n")
    aggs = [F.max("_size").alias("_size")]
    at = {name: (F.col("_size") - 1) * F.lit(float(p)) for name, p in probs.items()}
    for name in probs:
        low, high = F.floor(at[name]), F.ceil(at[name])
        aggs.append(F.max(F.when((first <= low) & (low < last), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((first <= high) & (high < last), F.col("_v"))).alias(f"_hi_{name}"))
    cols = []
    for name in probs:
        lo, hi, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), at[name] - F.floor(at[name])
        # At a whole position only one value counts, so infinite neighbours do no harm.
        cols.append(F.when((part == 0) | (lo == hi), lo.cast("double")).otherwise(lo + (hi - lo) * part).alias(name))
    return cells.groupBy(*keys).agg(*aggs).select(*keys, *cols)


#: Sampled rows that brackets are read from, the fewest of a group with a bracket, and a bracket's half width in standard errors.
BRACKET_ROWS, BRACKET_LEAST, BRACKET_ERRORS = 1 << 21, 1 << 10, 6


def _brackets(df: DataFrame, keys: list[str], asked: list[tuple], times: Column) -> DataFrame:
    """(keys, lo0, hi0 ...): sampled values around the place of each asked (name, value, probability) in large groups; NULL: no limit.

    At most BRACKET_ROWS / BRACKET_LEAST groups.  A row counts in the sample about as often as its share of its weight.
    """
    share = min(1.0, BRACKET_ROWS / max(1, row_count(df)))
    values = list(dict.fromkeys(v for _, v, _ in asked))
    some = df.select(*keys, *values, F.floor(times * share + F.rand(17)).alias("_k")).where("_k > 0")
    some, out = materialize(some), None
    for value in values:
        line = W.partitionBy(*keys).orderBy(value)
        total = F.sum("_k").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        placed = some.where(F.col(value).isNotNull()).withColumns({"_at": F.sum("_k").over(line.rangeBetween(W.unboundedPreceding, W.currentRow)), "_s": total})
        aggs = []
        for i, (_, v, p) in enumerate(asked):
            if v == value:
                off = BRACKET_ERRORS * (F.sqrt(F.lit(p * (1 - p)) / F.col("_s")) + 1 / F.col("_s"))
                aggs += [F.max(F.when(F.col("_at") <= (p - off) * F.col("_s"), F.col(value))).alias(f"_lo{i}"),
                         F.min(F.when(F.col("_at") >= (p + off) * F.col("_s") + 1, F.col(value))).alias(f"_hi{i}")]
        found = placed.where(F.col("_s") >= BRACKET_LEAST).groupBy(*keys).agg(*aggs)
        out = found if out is None else same_keys(same_keys(found.select(*keys).union(out.select(*keys)).distinct(), out, keys, "left"), found, keys, "left")
    return materialize(out)


def _bracketed(df: DataFrame, keys: list[str], quantiles: dict[str, dict[str, float]], aggs: list[Column], weight: str | None) -> DataFrame | None:
    """``summarize_within`` in two scans: one counts what lies below the brackets, the other collects only what lies inside them.

    The results are exact; None if a place lies outside of its bracket.
    """
    asked = [(name, v, float(p)) for v, probs in quantiles.items() for name, p in probs.items()]
    times = F.col(weight) if weight else F.lit(1)
    located = same_keys(df, _brackets(df, keys, asked, times), keys, "left", hint=True)
    kind = [df.schema[v].dataType for _, v, _ in asked]
    kind = kind[0] if len(set(kind)) == 1 else "double"
    counts, inside, held_at = [], [], []
    for i, (_, v, _) in enumerate(asked):
        low, high, known = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(v).isNotNull()
        below = F.coalesce(F.col(v) < low, F.lit(False))
        counts += [F.coalesce(F.sum(F.when(below, times)), F.lit(0)).alias(f"_b{i}"), F.coalesce(F.sum(F.when(known, times)), F.lit(0)).alias(f"_all{i}")]
        here = known & ~below & F.coalesce(F.col(v) <= high, F.lit(True))
        held_at.append(here)
        inside.append(F.when(here, F.struct(F.lit(i).alias("_q"), F.col(v).cast(kind).alias("_v"))))
    totals = materialize(located.groupBy(*keys).agg(*aggs, *counts))
    by = [*keys, "_q"]
    # Most rows lie in no bracket; the others are written as they are, so that the tasks that collapse them follow their number.
    held = located.where(reduce(or_, held_at)).select(*keys, times.alias("_w"), F.explode(F.array_compact(F.array(*inside))).alias("_i"))
    held = materialize(held.select(*keys, "_w", "_i.*"))
    held = materialize(clustered(held, [*by, "_v"], row_count(held)).groupBy(*by, "_v").agg(F.sum("_w").alias("_n")))
    cells = _running(held.withColumn("_piece", Split(held, by, {"_v": ["_v"]}).piece("_v")), by, row_count(held))
    marks = same_keys(cells, totals.select(*keys, *[c.format(i) for i in range(len(asked)) for c in ("_b{}", "_all{}")]), keys)
    ends, at = [], [(F.col(f"_all{i}") - 1) * F.lit(p) for i, (_, _, p) in enumerate(asked)]
    for i, place in enumerate(at):
        first = F.col(f"_b{i}") + F.col("_before")
        for end, whole in (("l", F.floor(place)), ("h", F.ceil(place))):
            ends.append(F.max(F.when((F.col("_q") == i) & (first <= whole) & (whole < first + F.col("_n")), F.col("_v"))).alias(f"_{end}{i}"))
    out = materialize(same_keys(totals, marks.groupBy(*keys).agg(*ends), keys, "left"))
    missed = [(F.col(f"_all{i}") > 0) & (F.col(f"_l{i}").isNull() | F.col(f"_h{i}").isNull()) for i in range(len(asked))]
    if not out.where(reduce(or_, missed)).isEmpty():
        return None
    for i, (name, _, _) in enumerate(asked):
        lo, hi, part = F.col(f"_l{i}"), F.col(f"_h{i}"), at[i] - F.floor(at[i])
        # At a whole position only one value counts, so infinite neighbours do no harm.
        out = out.withColumn(name, F.when((part == 0) | (lo == hi), lo.cast("double")).otherwise(lo + (hi - lo) * part))
    return out.drop(*[c.format(i) for i in range(len(asked)) for c in ("_b{}", "_all{}", "_l{}", "_h{}")])


def summarize_within(
    df: DataFrame, keys: list[str], quantiles: dict[str, dict[str, float]], aggs: list[Column] | None = None, *,
    weight: str | None = None, pieces: int | None = None,
) -> DataFrame:
    """Aggregates and exact, linearly interpolated quantiles per group, all in one pass unless a group has to be cut.

    ``quantiles`` maps a value column to output names and probabilities; ``aggs`` are further aliased aggregates.  NULL values are left out; a group
    of NULLs has NULL quantiles.  ``weight``: a column of whole numbers, how often a row counts in the quantiles.
    """
    df, aggs = stage(df), aggs or []
    split = Split(df, keys, {v: [v] for v in quantiles}, pieces)
    if split.any:
        out = _bracketed(df, keys, quantiles, aggs, weight)
        if out is not None:
            return out
        out = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
        for value, probs in quantiles.items():
            found = _read_off(_cells(df.where(F.col(value).isNotNull()), keys, split, value, weight and F.col(weight)), keys, probs)
            out = same_keys(out, found, keys, "left")
        return out if aggs else out.drop("_rows")
    times = F.col(weight) if weight else F.lit(1)
    arrays = [F.percentile(F.col(v), F.array(*[F.lit(float(p)) for p in probs.values()]), times).alias(f"_q{i}") for i, (v, probs) in enumerate(quantiles.items())]
    out = df.groupBy(*keys).agg(*aggs, *arrays)
    for i, probs in enumerate(quantiles.values()):
        out = out.withColumns({name: F.get(F.col(f"_q{i}"), F.lit(k)) for k, name in enumerate(probs)}).drop(f"_q{i}")
    return out


def quantiles_within(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, count: str | None = None, pieces: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group that has values; NULLs are left out."""
    out = summarize_within(df, keys, {value: probs}, [F.count(value).alias("_known")], pieces=pieces).where("_known > 0")
    return out.select(*keys, *probs, *([F.col("_known").alias(count)] if count else []))


def totals_above(
    df: DataFrame, keys: list[str], value: str, weight: str, *, above: str, equal: str | None = None, pieces: int | None = None, split: Split | None = None,
) -> DataFrame:
    """Per row: the sum of ``weight`` over rows of the group with a larger value, and with the same value.

    ``split`` as in ``average_ranks_within``; groups may also be parts of the groups it was drawn for, as long as it has no boundaries.
    """
    if split is None or split.any:
        df = stage(df)
        split = Split(df, keys, {value: [value]}, pieces)
    if not split.any:
        group, total = W.partitionBy(*keys), F.sum(weight)
        out = df.withColumn(above, total.over(group) - total.over(group.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)))
        return out.withColumn(equal, total.over(W.partitionBy(*keys, value))) if equal else out
    cells = _cells(df, keys, split, value, weight=F.col(weight))
    out = same_keys(df.withColumn("_v", F.col(value)), cells, [*keys, "_v"])
    out = out.withColumn(above, F.col("_size") - F.col("_before") - F.col("_n"))
    if equal:
        out = out.withColumn(equal, F.col("_n"))
    return out.drop("_v", "_n", "_before", "_size")
