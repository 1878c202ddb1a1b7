"""Joins with checked keys, set operations, table comparison and named checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import yes


def unique_on(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The same rows, but the job fails if a key occurs twice.

    Uniqueness is tested in a partial aggregate, so copies of a hot key meet map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest) if rest else F.lit(1)).alias("_r"))
    checked = packed.where(
        F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"duplicate key in {what}")).cast("boolean"))
    )
    return checked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def validated_left_join(left: DataFrame, right: DataFrame, on: list[str], validate: str = "many_to_one") -> DataFrame:
    """Left join that fails when the stated cardinality does not hold."""
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(validate)
    if validate == "one_to_one":
        left = unique_on(left, on, "the left side")
    return left.join(unique_on(right, on, "the right side"), on, "left")


def incremental_extend(
    accepted: DataFrame, new: DataFrame, *, keys: list[str], session: str, recompute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Append new sessions: old rows stay as they are, derived columns of new rows are computed
    over old and new raw rows together.  A key present twice fails the job."""
    raw = new.columns
    combined = unique_on(accepted.select(*raw).unionByName(new), keys, "the extension")
    added = recompute(combined).join(new.select(session).distinct(), session, "left_semi")
    return accepted.unionByName(added.select(*accepted.columns))


def tail_state(accepted: DataFrame, rows: int, *, entity: str, session: str) -> DataFrame:
    """The last ``rows`` rows of every entity: all that trailing windows over so many rows need to go on.

    The first state of a panel; ``extend_from_state`` gives the next one.
    """
    newest = W.partitionBy(entity).orderBy(F.col(session).desc())
    return accepted.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= rows).drop("_k")


def extend_from_state(
    state: DataFrame, new: DataFrame, rows: int, *, entity: str, session: str, recompute: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, next state) for new sessions, from the stored state alone: accepted history is not read.

    ``recompute`` derives columns from trailing windows of at most ``rows`` + 1 rows of an entity.  The job fails if a key occurs twice, or if
    a new row of an entity is not later than all its rows in the state.
    """
    raw = state.columns
    both = state.select("*", F.lit(False).alias("_new")).unionByName(new.select(*raw, F.lit(True).alias("_new")))
    both = unique_on(both, [entity, session], "the extension")
    last = F.max(F.when(~F.col("_new"), F.col(session))).over(W.partitionBy(entity))
    late = F.when(~F.col("_new") | F.col("_last").isNull() | (F.col(session) > F.col("_last")), True)
    checked = both.withColumn("_last", last).where(late.otherwise(F.raise_error(F.lit("a new row is not later than the state")).cast("boolean")))
    added = recompute(checked.drop("_last")).where("_new").drop("_new")
    return added, tail_state(checked.select(*raw), rows, entity=entity, session=session)


def append_new_keys(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the target does not have yet; of rows with one key the least, by all other columns, is taken."""
    rest = [c for c in batch.columns if c not in keys]
    least = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else batch.select(*keys).distinct()
    one = least.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*batch.columns)
    return one.join(target.select(*keys), keys, "left_anti")


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    if kind == "union":
        return left.unionByName(right).distinct()
    if kind == "intersect":
        return left.intersect(right.select(*left.columns))
    if kind == "difference":
        return left.subtract(right.select(*left.columns))
    raise ValueError(kind)


def table_reconcile(
    expected: DataFrame, actual: DataFrame, *, keys: list[str], exact: list[str], numeric: list[str], tolerance: float = 0.01
) -> DataFrame:
    """Compare two tables by key: EXACT, <COLUMN>_MISMATCH of the first differing column, MISSING or EXTRA.

    Numeric columns agree within ``tolerance``.  Several rows of a key are compared by
    their smallest row.
    """
    def side(df, tag):
        values = [*exact, *numeric]
        return df.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_r")).select(
            *keys, *[F.col(f"_r.{c}").alias(f"{tag}_{c}") for c in values], F.lit(True).alias(f"_{tag}")
        )

    j = side(expected, "expected").join(side(actual, "actual"), keys, "full_outer")
    label = F.when(F.col("_expected").isNull(), "EXTRA").when(F.col("_actual").isNull(), "MISSING")
    for c in exact:
        label = label.when(~F.col(f"expected_{c}").eqNullSafe(F.col(f"actual_{c}")), f"{c.upper()}_MISMATCH")
    for c in numeric:
        gap = F.abs(F.col(f"expected_{c}") - F.col(f"actual_{c}"))
        same = yes(gap <= tolerance) | (F.col(f"expected_{c}").isNull() & F.col(f"actual_{c}").isNull())
        label = label.when(~same, f"{c.upper()}_MISMATCH")
    return j.withColumn("result", label.otherwise("EXACT")).drop("_expected", "_actual")


def first_divergence(compared: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Per scope the first row that is not EXACT, and the number of rows by outcome."""
    bad = F.when(F.col("result") != "EXACT", F.struct(*order, "result"))
    return compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("compared_rows"),
        F.count_if(F.col("result") == "EXACT").alias("exact_rows"),
        F.min(bad).alias("_first"),
    ).select(*by, "compared_rows", "exact_rows", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order],
             F.col("_first.result").alias("first_result"))


def check_suite(df: DataFrame, table: str, checks: dict[str, Column], *, keys: list[str] | None = None) -> DataFrame:
    """Named row checks in one pass over the frame, and key uniqueness in another.

    Result: table_name, check_name, passed, failing_rows, rows.
    """
    names = list(checks)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(~yes(c)).alias(f"_c{i}") for i, c in enumerate(checks.values())]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"_c{i}").alias("failing_rows")) for i, n in enumerate(names)])
    out = one.select("_rows", F.explode(pairs).alias("p")).select("p.check_name", "p.failing_rows", F.col("_rows").alias("rows"))
    if keys:
        copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        unique = copies.agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("failing_rows"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        )
        out = out.unionByName(unique.select(F.lit("unique_key").alias("check_name"), "failing_rows", "rows"))
    return out.select(
        F.lit(table).alias("table_name"), "check_name", (F.col("failing_rows") == 0).alias("passed"), "failing_rows", "rows"
    )


def row_text(columns: list[str]) -> Column:
    """One text per row in which every field has its length in front, or a mark for NULL: different rows give different texts."""
    field = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n"))
    return F.concat_ws(",", *[field(c) for c in columns])


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two 60-bit numbers, 120 bits in all, from the SHA-256 of a row's text; other engines can repeat them."""
    digest = F.sha2(row_text(columns), 256)
    return tuple(F.conv(F.substring(digest, start, 15), 16, 10).cast("long") for start in (1, 16))


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-independent identity of a table: row count, sums and xors of both row hashes."""
    one, two = row_hashes(columns or df.columns)
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.select(one.alias("_h1"), two.alias("_h2")).agg(
        F.count(F.lit(1)).alias("rows"), total("_h1").alias("hash_sum"), total("_h2").alias("hash_sum_2"), F.bit_xor("_h1").alias("hash_xor"), F.bit_xor("_h2").alias("hash_xor_2"),
    )


def lossless_check(source: DataFrame, derived: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Source rows missing from the derived table and extra rows, counting copies; one shuffle."""
    columns = columns or source.columns
    both = source.select(*columns, F.lit(1).alias("_w")).unionByName(derived.select(*columns, F.lit(-1).alias("_w")))
    net = both.groupBy(*columns).agg(F.sum("_w").alias("_w"))
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("_w"), F.lit(0))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(-F.col("_w"), F.lit(0))), F.lit(0)).alias("extra_rows"),
    ).withColumn("lossless", (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0))


def denied_columns(df: DataFrame, tokens: list[str]) -> list[str]:
    """Column names that contain a forbidden token."""
    return [c for c in df.columns if any(t in c.lower() for t in tokens)]


def column_denylist_check(df: DataFrame, tokens: list[str]) -> DataFrame:
    """The frame itself; raises at once if a column name contains a forbidden token."""
    bad = denied_columns(df, tokens)
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df
