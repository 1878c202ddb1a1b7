"""Block bootstrap of daily series and multiple-testing corrections.

The random block starts come from an integer hash of (seed, replicate, block), so a
rerun, a retried task or another engine draws the same samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.functions.scalars import first_reason, yes
from stratapanel.runtime import stage

# Fixed values of the integer hash (public multiply-xorshift constant, two small primes).
MIX, REP_STEP, BLOCK_STEP, WORD = 73244475, 7919, 104729, 4294967296


def block_start(seed: Column, rep: Column, block: Column, n: Column) -> Column:
    """Start index in [0, n); every product stays below 2^63."""
    x = F.pmod(rep * REP_STEP + block * BLOCK_STEP + seed, F.lit(WORD))
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX), F.lit(WORD))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 16)), n)


def block_bootstrap(
    daily: DataFrame, *, keys: list[str], value: str = "ic", session: str = "session", block: Column,
    replications: int = 2000, seed: Column | int = 0, confidence: float = 0.95,
) -> DataFrame:
    """Circular moving-block bootstrap of the mean: interval and two-sided centred p-value.

    Each series is a daily statistic, at most one value per session.  Replicates spread
    over tasks by (series, replicate); a block sum is one lookup in a prefix-sum table.
    """
    rows = daily.where(F.col(value).isNotNull()).select(*keys, session, F.col(value).alias("_v"))
    rows = stage(rows)
    order = W.partitionBy(*keys).orderBy(session)
    ranked = rows.select(
        *keys, "_v", (F.row_number().over(order) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_n")
    )
    # The circle is unrolled twice; _c is the sum of everything before index _i.
    twice = ranked.select(*keys, "_v", F.explode(F.array(F.col("_i").cast("long"), F.col("_i") + F.col("_n"))).alias("_i"))
    along = W.partitionBy(*keys).orderBy("_i")
    prefix = stage(twice.select(*keys, "_i", (F.sum("_v").over(along) - F.col("_v")).alias("_c")))
    series = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("estimate"))
    length = F.least(block.cast("long"), F.col("_n"))
    series = series.withColumn("_len", length).withColumn("_blocks", F.ceil(F.col("_n") / F.col("_len")))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    draws = (
        series.withColumn("_seed", seed.cast("long"))
        .withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replications - 1).cast("long"))))
        .repartition(*keys, "_rep")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .withColumn("_start", block_start(F.col("_seed"), F.col("_rep"), F.col("_block"), F.col("_n")))
        .withColumn(
            "_stop",
            F.col("_start")
            + F.when(F.col("_block") == F.col("_blocks") - 1, F.col("_n") - F.col("_block") * F.col("_len")).otherwise(F.col("_len")),
        )
    )
    a = prefix.select(*keys, F.col("_i").alias("_start"), F.col("_c").alias("_ca"))
    # A block may stop at 2n, one past the last prefix: close the circle with the grand total.
    last = rows.groupBy(*keys).agg((2 * F.count(F.lit(1))).alias("_stop"), (2 * F.sum("_v")).alias("_cb"))
    b = prefix.select(*keys, F.col("_i").alias("_stop"), F.col("_c").alias("_cb")).unionByName(last)
    summed = draws.join(a, [*keys, "_start"]).join(b, [*keys, "_stop"])
    means = summed.groupBy(*keys, "_rep").agg(
        (F.sum(F.col("_cb") - F.col("_ca")) / F.max("_n")).alias("_mean"), F.max("estimate").alias("estimate"),
        F.max("_n").alias("_n"), F.max("_len").alias("_len"),
    )
    alpha = (1 - confidence) / 2
    exceed = F.count_if(F.abs(F.col("_mean") - F.col("estimate")) >= F.abs("estimate"))
    return means.groupBy(*keys).agg(
        F.max("estimate").alias("estimate"),
        F.percentile("_mean", F.lit(alpha)).alias("ci_lower"),
        F.percentile("_mean", F.lit(1 - alpha)).alias("ci_upper"),
        ((exceed + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.max("_n").alias("valid_dates"),
        F.max("_len").alias("block_length"),
        F.count(F.lit(1)).alias("replications"),
    )


def bootstrap_statistics(
    daily: DataFrame, values: dict[str, str], *, keys: list[str], session: str = "session", block: Column, replications: int = 2000,
    seed: Column | int = 0, confidence: float = 0.95,
) -> DataFrame:
    """``block_bootstrap`` of several daily columns at once; ``values`` maps names of statistics to columns.

    All statistics come from one table of draws; each has its own dates (those with a value) and the seed plus its number.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("statistic"), F.lit(i).alias("_index"), F.col(c).cast("double").alias("_value")) for i, (n, c) in enumerate(values.items())])
    long = daily.select(*keys, session, F.inline(cells))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    out = block_bootstrap(
        long, keys=[*keys, "statistic", "_index"], value="_value", session=session, block=block, replications=replications, seed=seed + F.col("_index"), confidence=confidence)
    return out.drop("_index")


def multiple_testing(
    tests: DataFrame, *, family: list[str], p: str = "p_value", tie: list[str], estimate: str = "estimate", alpha: float = 0.05
) -> DataFrame:
    """Benjamini-Hochberg and Holm adjusted p-values, rejections and direction per family.

    A family is a set of tests (tens to thousands of rows), far below one task's memory.
    """
    by = W.partitionBy(*family)
    up = by.orderBy(p, *tie)
    n = F.count(F.lit(1)).over(by)
    k = F.row_number().over(up)
    ranked = tests.withColumn("_n", n).withColumn("_k", k)
    bh = F.min(F.col(p) * F.col("_n") / F.col("_k")).over(by.orderBy("_k").rowsBetween(W.currentRow, W.unboundedFollowing))
    holm = F.max(F.col(p) * (F.col("_n") - F.col("_k") + 1)).over(by.orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        ranked.withColumn("bh_p_value", F.least(bh, F.lit(1.0)))
        .withColumn("holm_p_value", F.least(holm, F.lit(1.0)))
        .withColumn("bh_reject", F.col("bh_p_value") <= alpha)
        .withColumn("holm_reject", F.col("holm_p_value") <= alpha)
        .withColumn("direction", first_reason([(yes(F.col(estimate) > 0), "POSITIVE"), (yes(F.col(estimate) < 0), "NEGATIVE")], "ZERO"))
        .drop("_n", "_k")
    )
