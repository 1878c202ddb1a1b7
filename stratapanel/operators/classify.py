"""Rule tables: labels from counts of positive and negative cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions.scalars import ratio, yes


def _by_horizon(summary: DataFrame, keys: list[str], horizon: str, value: str) -> DataFrame:
    return summary.groupBy(*keys).agg(
        F.bool_and(F.col(value) > 0).alias("_pos"),
        F.bool_and(F.col(value) < 0).alias("_neg"),
        F.min_by(value, horizon).alias("first_ic"),
        F.max_by(value, horizon).alias("last_ic"),
    )


def decay_by_level(
    summary: DataFrame, *, keys: list[str], horizon: str = "future", value: str = "mean_ic", keep: float = 0.75
) -> DataFrame:
    """All positive: persists when the last horizon keeps ``keep`` of the first, else decays."""
    label = (
        F.when(yes("_pos"), F.when(F.col("last_ic") >= F.col("first_ic") * keep, "APPEARS_OR_PERSISTS").otherwise("DECAYS"))
        .when(yes("_neg"), "REVERSES")
        .otherwise("MIXED_OR_UNSTABLE")
    )
    return _by_horizon(summary, keys, horizon, value).withColumn("decay_label", label).drop("_pos", "_neg")


def decay_by_direction(
    summary: DataFrame, *, keys: list[str], horizon: str = "future", value: str = "mean_ic"
) -> DataFrame:
    """Whether the effect grows or fades from the first to the last horizon, per sign."""
    first, last = F.col("first_ic"), F.col("last_ic")
    label = (
        F.when(yes("_pos"), F.when(last > first, "STRENGTHENS").otherwise("DECAYS_OR_PLATEAUS"))
        .when(yes("_neg"), F.when(F.abs(last) > F.abs(first), "REVERSAL_STRENGTHENS").otherwise("REVERSAL_DECAYS_OR_PLATEAUS"))
        .otherwise("MIXED")
    )
    return _by_horizon(summary, keys, horizon, value).withColumn("decay_label", label).drop("_pos", "_neg")


def evidence_counts(
    summary: DataFrame, holdout: DataFrame, stability: DataFrame, intervals: DataFrame, offsets: DataFrame, *, keys: list[str]
) -> DataFrame:
    """Counts of signed cells per factor over its outcome horizons."""

    def signs(df, column, name):
        return df.groupBy(*keys).agg(
            F.count_if(yes(F.col(column) > 0)).alias(f"positive_{name}"),
            F.count_if(yes(F.col(column) < 0)).alias(f"negative_{name}"),
        )

    out = signs(summary, "mean_ic", "full")
    out = out.join(signs(holdout, "mean_ic", "holdout"), keys, "left")
    years = stability.groupBy(*keys).agg(
        F.count_if(yes(F.col("mean_ic_positive_fraction") >= 0.5)).alias("positive_year_majority")
    )
    out = out.join(years, keys, "left")
    ci = intervals.groupBy(*keys).agg(
        F.count_if(yes(F.col("ci_lower") > 0)).alias("positive_ci"), F.count_if(yes(F.col("ci_upper") < 0)).alias("negative_ci")
    )
    out = out.join(ci, keys, "left")
    once = offsets.select(*keys, "future", "offset_mean_ic").distinct()
    out = out.join(signs(once, "offset_mean_ic", "nonoverlap"), keys, "left")
    return out.fillna(0)


def classify(counts: DataFrame, rules: list[tuple[str, Column]], default: str, *, label: str = "classification") -> DataFrame:
    """First rule that holds decides; ``rules`` is an ordered list of (label, condition)."""
    out = F.lit(default)
    for name, condition in reversed(rules):
        out = F.when(yes(condition), F.lit(name)).otherwise(out)
    return counts.withColumn(label, out)


def _at_least(**minimums: int) -> Column:
    out = F.lit(True)
    for name, value in minimums.items():
        out = out & (F.col(name) >= value)
    return out


def formation_rules() -> list[tuple[str, Column]]:
    """Label rules for one look-back over six outcome horizons."""
    weakest = F.greatest("positive_full", "negative_full", "positive_holdout", "negative_holdout")
    return [
        ("ROBUST", _at_least(positive_full=5, positive_holdout=5, positive_year_majority=5, positive_ci=4)),
        ("REVERSAL-LIKE", _at_least(negative_full=5, negative_holdout=4, negative_nonoverlap=5)),
        ("PROMISING BUT UNSTABLE", _at_least(positive_full=4, positive_holdout=4)),
        ("NO EVIDENCE", weakest < 4),
    ]


def group_rules(robust: dict, reversal: dict, promising: dict) -> list[tuple[str, Column]]:
    """Label rules with thresholds as parameters (column name -> minimum)."""
    return [
        ("ROBUST", _at_least(**robust)),
        ("REVERSAL-LIKE", _at_least(**reversal)),
        ("PROMISING BUT UNSTABLE", _at_least(**promising)),
        ("FAIL", (F.col("positive_full") <= 1) & (F.col("positive_holdout") <= 1)),
    ]


def direction_holds(least: int = 4) -> Column:
    """Every directional requirement of a candidate at once."""
    return (
        (F.col("primary") >= least)
        & (F.col("moderate") >= least)
        & (F.col("nonoverlap") >= least)
        & F.col("basic_average_positive")
        & F.col("moderate_average_positive")
        & ~F.col("date_sign_flip")
    )


def candidate_class() -> Column:
    """Class of a candidate: sample size first, then sign counts, then stability of direction."""
    return (
        F.when(F.col("date_band") == "LT20", "INSUFFICIENT SAMPLE")
        .when(F.col("primary") <= 1, "CONTRADICTORY")
        .when(F.col("primary") <= 3, "MIXED")
        .when(~direction_holds(), "DIRECTIONALLY POSITIVE BUT UNSTABLE")
        .when(F.col("date_band") == "20_TO_59", "SUPPORTIVE BUT SHORT SAMPLE")
        .otherwise("SUPPORTED")
    )


def overall_class(first: str, second: str) -> Column:
    """Decision for a pair of candidates from their classes."""
    a, b = F.col(first), F.col(second)

    def both(name):
        return (a == name) & (b == name)

    return (
        F.when(both("SUPPORTED"), "PASS FOR COMPLEMENTARITY RESEARCH")
        .when((a == "SUPPORTED") | (b == "SUPPORTED") | both("SUPPORTIVE BUT SHORT SAMPLE"), "CONDITIONAL PASS")
        .when(both("CONTRADICTORY"), "FAIL")
        .otherwise("RESEARCH FURTHER")
    )


def decision_table(spark: SparkSession, horizons: int = 6) -> DataFrame:
    """Every state of the candidate rule inputs with its class (a few thousand rows)."""
    counts = F.sequence(F.lit(0), F.lit(horizons))
    flags = F.array(F.lit(False), F.lit(True))
    bands = F.array(*[F.lit(b) for b in ("LT20", "20_TO_59", "GE60")])
    states = spark.range(1)
    for name, values in [
        ("primary", counts), ("moderate", counts), ("nonoverlap", counts), ("basic_average_positive", flags),
        ("moderate_average_positive", flags), ("date_sign_flip", flags), ("date_band", bands),
    ]:
        states = states.select("*", F.explode(values).alias(name))
    return states.drop("id").withColumn("classification", candidate_class())


def gate_evaluate(
    metrics: DataFrame, reject: Column, ready: Column, conditional: Column, *,
    labels: tuple[str, str, str, str] = ("REJECT", "READY", "CONDITIONAL", "RESEARCH_FURTHER"),
) -> DataFrame:
    """Decision per portfolio from three gates; reject outranks ready, ready outranks conditional."""
    decision = (
        F.when(yes(reject), labels[0]).when(yes(ready), labels[1]).when(yes(conditional), labels[2]).otherwise(labels[3])
    )
    return (
        metrics.withColumn("reject_gate", yes(reject))
        .withColumn("ready_gate", yes(ready))
        .withColumn("conditional_gate", yes(conditional))
        .withColumn("decision", decision)
    )


def bias_label(verified: Column | str, total: Column | str) -> Column:
    pct = 100 * F.coalesce(ratio(verified, total), F.lit(0.0))
    return F.when(pct < 25, "SEVERE").when(pct < 60, "MATERIAL").when(pct < 90, "MODERATE").otherwise("LOW")
