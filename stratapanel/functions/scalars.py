"""Column expressions shared by the operators.  All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    """NaN to NULL: Spark sorts NaN above every number, which would win every descending rank."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_finite(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero (ANSI division would fail the job)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def bad_ohlc(open_="open", high="high", low="low", close="close") -> Column:
    """Non-finite or non-positive price, or a high/low outside the other prices."""
    o, h, l, c = (col(x) for x in (open_, high, low, close))
    usable = is_finite(o) & is_finite(h) & is_finite(l) & is_finite(c)
    positive = (o > 0) & (h > 0) & (l > 0) & (c > 0)
    ordered = (h >= F.greatest(o, l, c)) & (l <= F.least(o, h, c))
    return ~F.coalesce(usable & positive & ordered, F.lit(False))


def off_minute(ts="ts") -> Column:
    return F.date_trunc("minute", col(ts)) != col(ts)


def bad_volume_or_minute(volume="volume", ts="ts") -> Column:
    """Non-finite, negative or fractional volume, or a timestamp that is not on a minute."""
    v = col(volume).cast("double")
    fine = is_finite(v) & (v >= 0) & (F.floor(v) == v)
    return ~F.coalesce(fine, F.lit(False)) | off_minute(ts)


def reasons(conditions: Sequence[tuple[Column, str]]) -> Column:
    """Every label whose condition holds, in order, joined with '|'; '' when none does."""
    return F.concat_ws("|", *[F.when(c, F.lit(label)) for c, label in conditions])


def first_reason(conditions: Sequence[tuple[Column, str]], default: str = "") -> Column:
    """Label of the first condition that holds."""
    out = F.lit(default)
    for c, label in reversed(list(conditions)):
        out = F.when(c, F.lit(label)).otherwise(out)
    return out


def yes(c: Column | str) -> Column:
    """NULL counts as false."""
    return F.coalesce(col(c), F.lit(False))


def quantile_bucket(rank, count, q: int, minimum: int = 0) -> Column:
    """floor((rank-1)*q/count)+1 in integer arithmetic; NULL below ``minimum`` members."""
    r, n = col(rank), col(count)
    bucket = F.floor((r - 1) * q / n).cast("int") + 1
    return F.when(n >= minimum, bucket)


def percentile_bucket(pct, q: int) -> Column:
    return F.least(F.floor(col(pct) * q) + 1, F.lit(q)).cast("int")


def tail_size(count, fraction: float) -> Column:
    return F.ceil(col(count) * F.lit(fraction))


def in_top(rank, count, fraction: float) -> Column:
    return col(rank) > col(count) - tail_size(count, fraction)


def in_bottom(rank, count, fraction: float) -> Column:
    return col(rank) <= tail_size(count, fraction)


def positive_part(c) -> Column:
    """max(x, 0) that keeps NULL (``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def percent_true(condition: Column, base: Column | None = None) -> Column:
    """100 * share of rows where ``condition`` holds, over rows where ``base`` holds."""
    total = F.count(F.lit(1)) if base is None else F.count_if(base)
    return 100 * ratio(F.count_if(condition), total)
