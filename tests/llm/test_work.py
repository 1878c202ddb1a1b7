"""Work that must not grow with the square of a group, or with the number of odd texts."""

import dataclasses
import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratapanel.llm import line_dedup, simhash, tokens
from stratapanel.llm.queries import vocabulary_path


def test_lines_of_a_bucket_are_kept_once(spark):
    """A hundred lines of the same words in other orders share all buckets: each is kept once a bucket, and the alike ones are found."""
    rng = random.Random(3)
    words = [f"word{chr(97 + i)}longer" for i in range(18)]
    orders = [rng.sample(words, len(words)) for _ in range(100)]
    orders += [[*orders[i][:-2], orders[i][-1], orders[i][-2]] for i in range(5)] + [[*orders[7], "more"], [*orders[8], *"abcd"], [*orders[9], *"abcde"]]
    params = line_dedup.LineParams()
    data = [(i, " ".join(o)) for i, o in enumerate(orders)]
    named = line_dedup._named(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text", ["doc_id", "text"])
    lines = line_dedup._lines(named.select(*line_dedup.NAME, F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text")))
    distinct = line_dedup._fingerprints(lines, params)
    shared = line_dedup.materialize(line_dedup._shared(distinct, params))
    none = spark.createDataFrame([], "node long, root long")
    apart = line_dedup.materialize(line_dedup._apart(shared, none, params))
    assert apart.count() <= shared.count() <= 16 * len(orders)
    number = {r["line"]: r["id"] for r in lines.select("line", "id").collect()}
    got = {tuple(sorted((number[r["a"]], number[r["b"]]))) for r in line_dedup._alike_apart(apart, lines, params).collect()}
    assert got == {*((i, 100 + i) for i in range(5)), (7, 105), (8, 106)}


def test_plain_texts_between_odd_ones_go_together(monkeypatch):
    enc = tokens.Encoder(vocabulary_path("byte_bpe_50k.json"))
    odd = ["two  blanks", "a line \n b", "a\t \tb", "x <|endoftext|> y", "\x1c z"]
    texts = []
    for text in odd:
        texts += [text, *(f"plain text number {i}\nof words " for i in range(20)), "", None, " lead", " ", "\n"]
    calls, piece = [], tokens.Encoder._piece
    monkeypatch.setattr(tokens.Encoder, "_piece", lambda self, *a: calls.append(1) or piece(self, *a))
    got = [ids.tolist() for ids in enc.column(pa.array(texts, pa.string()))]
    assert got == [enc.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(calls) <= len(odd) + 1


def test_lines_are_normalised_twice_and_buckets_are_narrow(spark, monkeypatch):
    """Texts are read for the fingerprints and for the places of lines; names alone are written for all buckets, bit sets only for lines with a possible partner."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    lines = [" ".join(rng.sample(words, rng.choice([8, 20, 50]))) for _ in range(60)]
    data = [(i, "\n".join([lines[i], lines[i].replace(lines[i].split()[1], "other", 1), f"own line {i}"])) for i in range(60)]
    written = []

    def recorded(df, real=line_dedup.materialize):
        written.append((set(df.columns), df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df)

    monkeypatch.setattr(line_dedup, "materialize", recorded)
    out = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"))
    assert sum("regexp_replace" in plan for _, plan in written) == 2
    assert sum({"key", "s0"} <= columns for columns, _ in written) == 1
    assert sum(r["n_removed"] for r in out.collect()) >= 60


def test_buckets_hold_lines_of_like_lengths_only(spark):
    """A line shares blocks with a much longer one that repeats its words: neither is written for it, and one of like length still is."""
    long = [f"averylongword{chr(97 + i)}{chr(98 + i)}" for i in range(5)]
    texts = [" ".join(long), " ".join([*long, *"abcdefghijklmnop"]), " ".join([*long[:4], "x", long[4]])]
    params = line_dedup.LineParams()

    def buckets(texts):
        named = line_dedup._named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", ["doc_id", "text"])
        lines = line_dedup._lines(named.select(*line_dedup.NAME, F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text")))
        number = {r["line"]: r["id"] for r in lines.select("line", "id").collect()}
        return {number[r["line"]] for r in line_dedup._buckets(line_dedup._fingerprints(lines, params), params).collect()}

    assert buckets(texts[:2]) == set()
    assert buckets(texts) == {0, 2}


def test_pairs_of_many_small_buckets_take_few_steps(monkeypatch):
    """Buckets of over eight nodes are searched together, only nodes of sets of like sizes are looked at, and no pair is lost."""
    params = dataclasses.replace(simhash.LIKE_TEXTS, samples=8, sample_bits=4)
    rng = np.random.Generator(np.random.PCG64(5))
    masks, size = simhash.first_masks(params), np.full(400, 12)
    fps, bucket = rng.integers(0, 1 << 63, (4800, params.words), dtype=np.uint64), np.repeat(np.arange(400), 12)
    sizes = rng.integers(1, 1000, 4800)
    for k in range(0, 4800, 5):  # every fifth is near the one in front of it
        fps[k], sizes[k] = fps[k - 1] ^ np.uint64(7), sizes[k - 1] + k % 3
    choice = bucket % len(masks)
    want = set()
    for k in range(0, 4800, 12):
        for x, y in itertools.combinations(range(k, k + 12), 2):
            met = [i for i, m in enumerate(masks) if not ((fps[x] ^ fps[y]) & m).any()]
            like = min(sizes[x], sizes[y]) >= 0.8 * max(sizes[x], sizes[y])
            if like and np.bitwise_count(fps[x] ^ fps[y]).sum() <= params.distance and met and met[0] == choice[x]:
                want.add((x, y))
    looked, plain = [], simhash.hamming
    monkeypatch.setattr(simhash, "pivot_table", lambda f, p: np.stack([plain(f, x) for x in p], axis=1))
    monkeypatch.setattr(simhash, "hamming", lambda a, b: looked.append(len(a)) or plain(a, b))
    got = [(int(x), int(y)) for xs, ys in simhash._pairs_within(fps, choice, size, params, sizes) for x, y in zip(xs, ys, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 50
    assert len(looked) <= 3 and sum(looked) < 0.5 * 400 * 66


def test_only_dense_buckets_come_back(spark):
    """A bucket of 300 nodes that are far apart gives its few pairs at once; one of 300 near copies is left to the rounds of leaders."""
    rng = np.random.Generator(np.random.PCG64(6))
    far = rng.integers(0, 1 << 62, (300, 4), dtype=np.int64)
    far[1:6:2] = far[0:6:2] ^ 1
    near = far[:1] ^ (1 << rng.integers(0, 62, (300, 4), dtype=np.int64))
    # The first of its choices decides, and key bits of those near ones may differ: both buckets are given as of choice 0.
    mask = simhash.first_masks(simhash.LIKE_TEXTS)[0].view(np.int64)
    far, near = far & ~mask, near & ~mask
    data = [(key, 0, 1000 * key + i, 100, 1000 * key + i, 0, 1, *map(int, f)) for key, fps in ((1, far), (2, near)) for i, f in enumerate(fps)]
    buckets = spark.createDataFrame(data, "key long, choice int, node long, size int, root long, part int, parts int, f0 long, f1 long, f2 long, f3 long")
    got = simhash._met(buckets, simhash.LIKE_TEXTS, 1 << 13, 128).collect()
    assert {(r["a"], r["b"]) for r in got if not r["again"] and r["a"] < 2000} == {(1000, 1001), (1002, 1003), (1004, 1005)}
    assert sorted(r["node"] for r in got if r["again"]) == [2000 + i for i in range(300)]
    assert {r["b"] for r in got if not r["again"] and r["a"] >= 2000} == {2000 + i for i in range(1, 300)}


def test_texts_are_cut_into_shingles_twice(spark, monkeypatch):
    """Once for the fingerprints and once for the pairs, also where crowded buckets need rounds of leaders."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base, data = rng.choices(words, k=200), []
    for i in range(12):
        w = list(base)
        w[rng.randrange(200)] = "new"
        data += [(i, " ".join(w)), (100 + i, " ".join(rng.choices(words, k=200)))]
    written = []
    monkeypatch.setattr(simhash, "materialize", lambda df, real=simhash.materialize: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    params = dataclasses.replace(simhash.LIKE_TEXTS, small=2, bucket_limit=5)
    left = simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string"), params)
    assert {r["doc_id"] for r in left.collect()} == {0, *(100 + i for i in range(12))}
    assert sum("MapInArrow" in plan and "shingles" in plan for plan in written) == 1
