"""Benchmark decontamination by spaced seeds.

A mask is a short pattern over consecutive tokens; only its marked positions are hashed, so a
substituted token at an open position leaves the seed unchanged.  Seeds of the benchmark and of the
training texts meet in an equi-join.  Around every hit the two token sequences are laid on the hit's
diagonal and the longest stretch with the wanted share of equal tokens is found from prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import U64, PrefixHash, lower_table, mix, pieces, words_of
from stratapanel.llm.bits import bit_table, marked
from stratapanel.runtime import materialize

#: Tokens are runs of letters, digits and non-ASCII bytes.
BETWEEN = np.ones(256, bool)
BETWEEN[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    BETWEEN[_a:_b] = False


@dataclass(frozen=True)
class SeedParams:
    """Masks, and what counts as a leak.

    A leak is a stretch of at least ``least_tokens`` tokens (or the whole item, if it is shorter but has
    ``least_item`` tokens) of which a share of ``similarity`` is equal.  With a share of 0.8 the four masks hit
    every such stretch of 7 tokens or more, wherever its tokens are substituted.  Items shorter than the longest mask are
    also looked up by masks that leave out one of their tokens.  ``context`` tokens around a run of hits are kept for
    the verification; it bounds how much of a longer stretch is measured, not what is found.
    ``filter_bits`` bounds the bit table that every task holds: it only thins out what is shuffled.
    """

    masks: tuple[str, ...] = ("1101011", "1110011", "1011101", "111011")
    least_tokens: int = 13
    least_item: int = 5
    similarity: float = 0.8
    context: int = 64
    filter_bits: int = 24


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a piece and their text numbers."""
    low = lower_table()[data]
    starts, ends, owner = words_of(low, offsets, BETWEEN)
    return PrefixHash(low).spans(starts, ends), owner


def seeds_of(tokens: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a mask fits into one text, and the seeds there."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.full(n, int(mask, 2) * 2 + 1, U64)
    for k, c in enumerate(mask):
        if c == "1":
            h = (h + tokens[k : k + n]) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(29)
    at = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return at, mix(h[at])


def masks_of(n: int, params: SeedParams) -> list[str]:
    """Masks for an item of n tokens; for one shorter than the longest mask also those with any one token left out."""
    fit = [m for m in params.masks if len(m) <= n]
    if n >= max(map(len, params.masks)):
        return fit
    return list(dict.fromkeys([*fit, "1" * max(1, n - 1), *("1" * k + "0" + "1" * (n - k - 1) for k in range(1, n - 1))]))


def _benchmark(items: DataFrame, id_column: str, text_column: str, params: SeedParams) -> DataFrame:
    """One row for each item with tokens: item, tokens, and its seeds with their positions."""
    kind = items.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                tokens, owner = tokens_of(data, offsets)
                ids, rows = batch.column(0)[i:j].to_pylist(), []
                for k in np.unique(owner).tolist():
                    own = tokens[owner == k]
                    if len(own) < params.least_item:
                        continue
                    found = [seeds_of(own, np.zeros(len(own), np.int64), m) for m in masks_of(len(own), params)]
                    at, seed = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                    rows.append((ids[k], own.view(np.int64), seed.view(np.int64), at))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[x] for r in rows], pa.list_(pa.int64())) for x in (1, 2, 3))],
                        names=["item", "item_tokens", "seeds", "at"],
                    )

    return items.select(id_column, text_column).mapInArrow(run, f"item {kind}, item_tokens array<bigint>, seeds array<bigint>, at array<bigint>")


def _training_hits(docs: DataFrame, id_column: str, text_column: str, params: SeedParams, short: list[int], bits: int, table: np.ndarray) -> DataFrame:
    """Runs of positions whose seeds may be in the benchmark, each with its tokens and seeds."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    masks = list(dict.fromkeys([*params.masks, *(m for n in short for m in masks_of(n, params))]))
    schema = f"row bigint, doc {kind}, run int, first bigint, tokens array<bigint>, seeds array<bigint>, at array<bigint>"

    def run(batches):
        filled = shared.value
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(2)):
                tokens, owner = tokens_of(data, offsets)
                at, seed = [], []
                for m in masks:
                    p, h = seeds_of(tokens, owner, m)
                    on = marked(filled, bits, h)
                    at.append(p[on])
                    seed.append(h[on])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                # A run ends where the next hit is out of reach or in another text.
                new = np.flatnonzero((np.diff(at) > params.context) | (owner[at[1:]] != owner[at[:-1]])) + 1
                first_token = np.searchsorted(owner, np.arange(len(offsets)))
                rows, docs_, out = batch.column(0)[i:j].to_pylist(), batch.column(1)[i:j].to_pylist(), []
                for k, (a, b) in enumerate(zip([0, *new.tolist()], [*new.tolist(), len(at)], strict=True)):
                    text = int(owner[at[a]])
                    lo = max(int(first_token[text]), int(at[a]) - params.context)
                    hi = min(int(first_token[text + 1]), int(at[b - 1]) + params.context)
                    out.append((rows[text], docs_[text], k, lo - int(first_token[text]), tokens[lo:hi].view(np.int64), seed[a:b].view(np.int64), at[a:b] - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], batch.schema.field(1).type), pa.array([r[2] for r in out], pa.int32()),
                        pa.array([r[3] for r in out], pa.int64()), *(pa.array([r[x] for r in out], pa.list_(pa.int64())) for x in (4, 5, 6)),
                    ],
                    names=["row", "doc", "run", "first", "tokens", "seeds", "at"],
                )

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, schema)


def best_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """Start, end and number of equal tokens of the best-scoring stretch of an aligned pair."""
    if not len(equal):
        return 0, 0, 0
    value = np.where(equal, round(1000 * (1 - similarity)), -round(1000 * similarity))
    sums = np.concatenate([[0], np.cumsum(value)])
    gains = sums[1:] - np.minimum.accumulate(sums)[:-1]
    end = len(gains) - int(np.argmax(gains[::-1]))  # the longest of the best
    start = int(np.argmin(sums[:end]))
    return start, end, int(np.count_nonzero(equal[start:end]))


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """Start, end and number of equal tokens of the longest stretch of an aligned pair with a share of ``similarity`` equal; the first of several."""
    value = np.where(equal, round(1000 * (1 - similarity)), -round(1000 * similarity))
    sums = np.concatenate([[0], np.cumsum(value)])
    # The first start whose sum is not above that of the end: running minima only fall, so it is searched for among them.
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(np.arange(len(sums)) - starts))
    start = int(starts[end])
    return start, end, int(np.count_nonzero(equal[start:end]))


def leaks(
    docs: DataFrame, items: DataFrame, params: SeedParams | None = None, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """Pairs of a document row and a benchmark item that share a stretch of tokens.

    Returns row (number of the document's row within this call), the document's id, the item's id, start (token
    number in the document), n_tokens and n_equal of the longest stretch (over several diagonals: the one with most equal tokens).  Null and empty texts have no tokens and no leaks.  Items that
    repeat each give their own pair; repeated documents are found row by row.  Null ids are kept.  Empty tables give
    no pairs.  Other columns are ignored.
    """
    params = params or SeedParams()
    bench = materialize(_benchmark(items, item_column, text_column, params).withColumn("bench", F.monotonically_increasing_id()))
    seeds = bench.select("bench", F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("at").alias("bench_at"))).alias("s")).select("bench", "s.seed", "s.bench_at")
    widest = max(map(len, params.masks))
    short = [r[0] for r in bench.where(F.size("item_tokens") < widest).select(F.size("item_tokens")).distinct().collect()]  # lengths below a mask's
    bits, table = bit_table(seeds, F.col("seed"), params.filter_bits)
    runs = materialize(_training_hits(docs, id_column, text_column, params, sorted(short), bits, table))
    hits = runs.select("row", "run", F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("at").alias("doc_at"))).alias("s")).select("row", "run", "s.seed", "s.doc_at")
    lines = hits.join(seeds, "seed").select("row", "run", "bench", (F.col("doc_at") - F.col("bench_at")).alias("shift")).distinct()
    pairs = lines.join(runs.select("row", "run", "doc", "first", "tokens"), ["row", "run"]).join(bench.select("bench", "item", "item_tokens"), "bench")
    doc_kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()

    def verify(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("row", "doc", "bench", "item", "first", "shift")]
            texts, wanted = batch.column("tokens"), batch.column("item_tokens")
            for k, (row, doc, no, item, first, shift) in enumerate(zip(*columns, strict=True)):
                a, b = texts[k].values.to_numpy(), wanted[k].values.to_numpy()
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                start, end, same = longest_stretch(a[lo:hi] == b[lo - shift : hi - shift], params.similarity)
                if end - start >= min(params.least_tokens, len(b)):
                    rows.append((row, doc, no, item, first + lo + start, end - start, same))
            if rows:
                kinds = [pa.int64(), batch.schema.field("doc").type, pa.int64(), batch.schema.field("item").type, *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "doc", "bench", "item", "start", "n_tokens", "n_equal"]
                )

    found = pairs.select("row", "doc", "bench", "item", "first", "shift", "tokens", "item_tokens").mapInArrow(
        verify, f"row bigint, doc {doc_kind}, bench bigint, item {item_kind}, start bigint, n_tokens bigint, n_equal bigint"
    )
    best = found.groupBy("row", "bench").agg(F.max(F.struct("n_equal", "n_tokens", (-F.col("start")).alias("before"), "doc", "item")).alias("b"))
    return best.select(
        "row", F.col("b.doc").alias(id_column), F.col("b.item").alias(item_column), (-F.col("b.before")).alias("start"), F.col("b.n_tokens").alias("n_tokens"), F.col("b.n_equal").alias("n_equal")
    )


def decontaminate(docs: DataFrame, items: DataFrame, params: SeedParams | None = None, id_column: str = "doc_id") -> DataFrame:
    """The rows whose id has no leak, with all their columns; rows without an id are judged as one."""
    bad = leaks(docs, items, params, id_column).select(F.col(id_column).alias("_leaked")).distinct()
    return docs.join(bad, docs[id_column].eqNullSafe(bad["_leaked"]), "left_anti")
