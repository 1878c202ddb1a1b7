"""The split forms must equal plain windows, wherever rows crowd."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratapanel.operators import orderstats
from stratapanel.operators.orderstats import Split, average_ranks_within, ordinal_within, quantiles_within, summarize_within, totals_above
from stratapanel.runtime import stage

INF = float("inf")


def frame(spark, kind):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        key = rng.choice(["hot"] * 7 + ["cold"] * 2 + [None])
        if kind == "spread":
            v = 0.0 if rng.random() < 0.34 else rng.choice([-1, 1]) * 10 ** rng.uniform(-7, 6)
        elif kind == "narrow":
            v = 100 + rng.random()
        else:  # NULL, infinite and NaN values, and one hot value
            v = rng.choice([None, INF, -INF, float("nan"), 1.0, 1.0, 1.0, rng.random()])
        rows.append((key, i, f"a long shared beginning {i:05d}", v, float(rng.randint(1, 5))))
    return spark.createDataFrame(rows, "k string, e long, s string, v double, w double")


def rows(df, cols):
    return sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())


KINDS = pytest.mark.parametrize("kind", ["spread", "narrow", "odd"])
PIECES = pytest.mark.parametrize("pieces", [1, 7, 100])


@KINDS
@PIECES
@pytest.mark.parametrize("tie", ["e", "s"])
def test_ordinal(spark, kind, pieces, tie):
    df = frame(spark, kind)
    group = W.partitionBy("k")
    want = df.withColumn("rank", F.row_number().over(group.orderBy("v", tie))).withColumn("count", F.count(F.lit(1)).over(group))
    assert rows(ordinal_within(df, ["k"], "v", tie, pieces=pieces), ["k", "e", "rank", "count"]) == rows(want, ["k", "e", "rank", "count"])


@KINDS
@PIECES
def test_average_ranks_and_totals(spark, kind, pieces):
    df = frame(spark, kind)
    group = W.partitionBy("k")
    tied = lambda c: F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("k", c)) - 1) / 2
    want = df.withColumns({"rv": tied("v"), "rw": tied("w"), "n": F.count(F.lit(1)).over(group)})
    cols = ["k", "e", "rv", "rw", "n"]
    assert rows(average_ranks_within(df, ["k"], {"rv": "v", "rw": "w"}, size="n", pieces=pieces), cols) == rows(want, cols)
    same = F.sum("w").over(W.partitionBy("k", "v"))
    total = df.withColumn("up", F.sum("w").over(group) - F.sum("w").over(group.orderBy("v"))).withColumn("eq", same)
    assert rows(totals_above(df, ["k"], "v", "w", above="up", equal="eq", pieces=pieces), ["k", "e", "up", "eq"]) == rows(total, ["k", "e", "up", "eq"])


@PIECES
@pytest.mark.parametrize("kind", ["spread", "narrow"])
def test_quantiles(spark, kind, pieces):
    df = frame(spark, kind)
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e9": 0.99, "f": 1.0}
    got = {r["k"]: r for r in quantiles_within(df, ["k"], "v", probs, count="n", pieces=pieces).collect()}
    want = {r["k"]: r for r in df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()], F.count("v").alias("n")).collect()}
    assert set(got) == set(want) == {"hot", "cold", None}
    for k, x in want.items():
        assert got[k]["n"] == x["n"] and all(abs(got[k][n] - x[n]) <= 1e-9 * max(1.0, abs(x[n])) for n in probs)


def test_quantiles_of_infinite_values(spark):
    df = spark.createDataFrame([(None, v) for v in (-INF, -INF, 1.0, 2.0, INF, None)], "k string, v double")
    r = quantiles_within(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}, count="n").collect()
    assert [tuple(x) for x in r] == [(None, -INF, 1.0, INF, 5)]


def largest(df, split, name):
    counts = [r["count"] for r in df.withColumn("p", split.piece(name)).groupBy("p").count().collect()]
    return len(counts), max(counts)


def test_pieces_are_even(spark):
    """A group inside [100, 101] and a value with a shared tie prefix both split; one sample serves both orders."""
    narrow = stage(spark.range(20_000).select(F.lit("k").alias("k"), (100 + F.rand(1)).alias("v"), F.lit(1.0).alias("same"), F.concat(F.lit("entity "), "id").alias("s")))
    split = Split(narrow, ["k"], {"v": ["v", "s"], "same": ["same", "s"]}, 16)
    for name in ("v", "same"):
        pieces, most = largest(narrow, split, name)
        assert pieces == 16 and most < 2 * 20_000 / 16


@pytest.mark.parametrize("copies", [1, 50, 5_000])
def test_pieces_are_even_where_values_repeat(spark, copies):
    n, want = 400_000, 16
    df = stage(spark.range(n).select(F.lit(None).cast("string").alias("k"), (F.xxhash64((F.col("id") / copies).cast("long")) / 1e3).alias("v")))
    pieces, most = largest(df, Split(df, ["k"], {"v": ["v"]}, want), "v")
    assert pieces >= want - 1 and most <= 2 * n / want


def test_only_large_groups_are_cut(spark):
    """A group with most rows gets the boundaries, also beside a value that holds half of them; small groups have one piece each."""
    df = stage(spark.range(60_000).select(F.when(F.col("id") < 40_000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("k"),
                                          F.when(F.col("id") < 20_000, 7.0).otherwise(F.rand(2) * 10).alias("v")))
    split = Split(df, ["k"], {"v": ["v"]}, 12)
    assert split.any and all(b[0] == "hot" for b in split.bounds["v"])
    placed = df.withColumn("p", split.piece("v"))
    assert placed.where("k <> 'hot'").groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    group = W.partitionBy("k")
    want = df.withColumn("r", F.rank().over(group.orderBy("v")) + (F.count(F.lit(1)).over(W.partitionBy("k", "v")) - 1) / 2)
    got = average_ranks_within(df, ["k"], {"r": "v"}, pieces=12)
    sums = [F.count(F.lit(1)), F.sum("r"), F.sum(F.col("r") * F.col("v"))]
    assert [round(x, 3) for x in got.agg(*sums).first()] == [round(x, 3) for x in want.agg(*sums).first()]


def test_one_sample_for_all_columns(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(Split, "_draw", lambda self, *a, real=Split._draw: (drawn.append(1), real(self, *a)))
    df = frame(spark, "spread")
    average_ranks_within(df, ["k"], {"a": "v", "b": "w"}, pieces=7).count()
    summarize_within(df, ["k"], {"v": {"m": 0.5}, "w": {"n": 0.5}}, pieces=7).count()
    assert len(drawn) == 2


@PIECES
def test_summaries_keep_null_keys_and_groups_without_values(spark, pieces):
    df = spark.createDataFrame([(None, 1.0, 5.0), (None, 3.0, None), ("a", None, 1.0), ("b", 2.0, 2.0), ("b", 4.0, None)] * 9, "k string, v double, w double")
    got = summarize_within(df, ["k"], {"v": {"mid": 0.5}, "w": {"low": 0.0, "high": 1.0}}, [F.count(F.lit(1)).alias("n")], pieces=pieces)
    assert sorted(map(tuple, got.select("k", "n", "mid", "low", "high").collect()), key=str) == [("a", 9, None, 1.0, 1.0), ("b", 18, 3.0, 2.0, 2.0), (None, 18, 2.0, 5.0, 5.0)]


def test_brackets_give_exact_quantiles(spark, monkeypatch):
    """Sampled brackets (narrow, one-sided, missed) and weights: quantiles equal those of the whole groups; NaN, infinities, NULLs and a constant group."""
    rng = random.Random(12)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [(g, rng.choice(odd) if rng.random() < 0.02 else 7.0 if g == "c" else rng.gauss(0, 1), rng.choice([1, 1, 2, 50])) for g in ("a", "b", None, "c", "d") for _ in range(20 if g == "d" else 4000)]
    df = stage(spark.createDataFrame(rows, "g string, v double, w long"))
    ask = {"v": {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}}
    run = lambda w: {r["g"]: str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in orderstats.summarize_within(df, ["g"], ask, [F.count(F.lit(1)).alias("n")], weight=w).collect()}
    for weight in (None, "w"):
        monkeypatch.setattr(orderstats, "PIECE_ROWS", 1 << 20)
        whole = run(weight)
        monkeypatch.setattr(orderstats, "PIECE_ROWS", 500)
        monkeypatch.setattr(orderstats, "BRACKET_LEAST", 100)
        for sampled, errors in ((1 << 21, 6), (3000, 6), (3000, 0)):
            monkeypatch.setattr(orderstats, "BRACKET_ROWS", sampled)
            monkeypatch.setattr(orderstats, "BRACKET_ERRORS", errors)
            assert run(weight) == whole
    # Most rows never meet a shuffle: only those inside the brackets are held.
    monkeypatch.setattr(orderstats, "BRACKET_ROWS", 8000)
    monkeypatch.setattr(orderstats, "BRACKET_ERRORS", 6)
    found = orderstats._bracketed(df, ["g"], {"v": {"p95": 0.95}}, [F.count(F.lit(1)).alias("n")], None)
    assert {r["g"]: r["n"] for r in found.collect()} == {"a": 4000, "b": 4000, None: 4000, "c": 4000, "d": 20}
    bounds = {r["g"]: (r["_lo0"], r["_hi0"]) for r in orderstats._brackets(df, ["g"], [("p", "v", 0.95)], F.lit(1)).collect()}
    assert set(bounds) == {"a", "b", None, "c"} and all(lo is not None for lo, _ in bounds.values())
