"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint takes the majority of its shingles' hash bits.  Fingerprints within ``distance``
bits are linked, and a component's texts are near-duplicates.  Equal fingerprints are one node, so copies
cost nothing.  Nodes meet in buckets: the 64 bits are cut into ``blocks`` blocks, and two fingerprints
within ``distance`` bits agree in at least ``blocks - distance`` of them, so every linked pair meets
under at least one choice of blocks.  Inside a bucket a table holds each node's Hamming distances to the
reference fingerprints (pivots); by the triangle inequality a pair whose distances to any pivot
differ by more than ``distance`` cannot be linked and is discarded; survivors are verified bit by bit.

A bucket is searched breadth first over the nodes not reached yet and gives one edge for each node reached, so a
dense bucket is left after a few passes and never gives all its pairs.  A bucket of more than ``bucket_limit`` nodes is
dealt out again by the same rule over the bits that it leaves open; no bucket of that second deal can hold more
than 2**19 different fingerprints, however large the input.

``words`` makes fingerprints of several times 64 bits, from as many hashes of each shingle; they measure the similarity of texts well
enough for distances at which blocks no longer guarantee a meeting.  Then ``samples`` fixed random choices of
``sample_bits`` bits take the place of the blocks: a pair that differs in a share q of the bits meets with probability
1 - (1 - (1 - q)**sample_bits)**samples.

With a ``similarity`` buckets and pivot tables propose the pairs within the distance in the same way, and an exact check follows: nodes are the
distinct sets of shingles, and a pair is linked if the Jaccard similarity of its sets is high enough.  Sets of too unlike sizes cannot be alike, so nodes of a bucket lie in the order
of their sizes and each meets the next ones only.  Buckets grow with the input, as random choices are fixed: what they hold by chance is far apart and gives no pairs.  Buckets of up to
``bucket_limit`` nodes give all their pairs within the distance, if these are no more for each node than a bucket of ``small`` nodes could give.  The others
are compared with one leader each for ``rounds`` rounds, with another leader every time; then all pairs whose nodes are not connected yet
are compared, in units of about twice ``bucket_limit`` nodes, so that no bucket is held whole and no meeting is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import U64, mix, pieces
from stratapanel.llm.components import components
from stratapanel.llm.line_dedup import _thinned
from stratapanel.runtime import materialize


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4
    seed: int = 42
    distance: int = 4
    blocks: int = 7
    second_blocks: int = 8
    pivots: int = 16
    bucket_limit: int = 1 << 13
    words: int = 1
    sample_bits: int = 0
    samples: int = 0
    similarity: float = 0.0
    small: int = 128
    rounds: int = 3


#: Texts whose sets of five-word shingles have a Jaccard similarity of 0.8: a cosine of 0.89, so 39 of 256 bits differ on average.
LIKE_TEXTS = SimHashParams(shingle=5, distance=64, words=4, sample_bits=18, samples=96, similarity=0.8)


def shingles(raw: bytes, params: SimHashParams) -> np.ndarray:
    """XXH64 of every shingle of a text; none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, U64)
    size = min(params.shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    seed, digest = params.seed, xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), U64, len(starts))


def set_number(h: np.ndarray) -> int:
    """One number for each set of shingles (sorted)."""
    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def fingerprint(h: np.ndarray, params: SimHashParams) -> np.ndarray:
    """Majority bits of the shingles' XXH64 (and of its further mixes); 0 without words, ties give 0."""
    n, out = len(h), np.zeros(params.words, U64)
    for k in range(params.words):
        own = mix(h + U64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else h
        counts = np.zeros(64, np.int64)
        for i in range(0, n, 1 << 15):
            counts += np.unpackbits(own[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def node_of(fps: np.ndarray) -> np.ndarray:
    """One number for each fingerprint (rows); the fingerprint itself if it has 64 bits."""
    out = fps[:, 0].copy()
    for k in range(1, fps.shape[1]):
        out = mix(out * U64(0x9E3779B97F4A7C15) + fps[:, k])
    return out


def names_of(params: SimHashParams) -> list[str]:
    return [f"f{k}" for k in range(params.words)]


def fingerprints(docs: DataFrame, params: SimHashParams, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, node, with a similarity size (number of distinct shingles), and fingerprint (bits of signed longs f0, f1 ...) of every row; null texts have no words."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = names_of(params)
    size = ["size"] if params.similarity else []

    def run(batches):
        for batch in batches:
            for i, j, _, _ in pieces(batch.column(1)):
                sets = [shingles(t or b"", params) for t in batch.column(1)[i:j].to_pylist()]
                if params.similarity:
                    sets = [np.unique(h) for h in sets]
                found = np.array([fingerprint(h, params) for h in sets], U64).reshape(-1, params.words)
                node = np.array([set_number(h) for h in sets], U64) if params.similarity else node_of(found)
                columns = [pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(params.words)]
                sizes = [pa.array([len(h) for h in sets], pa.int32()) for _ in size]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(node.view(np.int64)), *sizes, *columns], names=["id", "node", *size, *names])

    schema = f"id {kind}, node bigint, " + "size int, " * len(size) + ", ".join(f"{n} bigint" for n in names)
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(run, schema)


@functools.cache
def choices(places: tuple[int, ...], blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of blocks that ``distance`` changed bits can leave whole."""
    cut = [int(m) for m in (sum(1 << int(p) for p in part) for part in np.array_split(np.array(places), blocks))]
    return [functools.reduce(int.__or__, part) for part in combinations(cut, blocks - distance)]


@functools.cache
def sampled(words: int, bits: int, samples: int, seed: int) -> np.ndarray:
    """Masks (rows, one number for each word) of fixed random choices of bits."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), np.zeros((samples, words), U64)
    for row in out:
        for p in rng.choice(64 * words, bits, replace=False).tolist():
            row[p // 64] |= U64(1 << (p % 64))
    return out


def first_masks(params: SimHashParams) -> np.ndarray:
    if params.samples:
        return sampled(params.words, params.sample_bits, params.samples, 1)
    return np.array(choices(tuple(range(64)), params.blocks, params.distance), U64)[:, None]


def second_masks(params: SimHashParams, mask: np.ndarray) -> np.ndarray:
    """For the nodes of a bucket that agree under ``mask``; blocks only, since sampled choices would lose pairs a second time."""
    open_bits = tuple(p for p in range(64) if not int(mask[0]) >> p & 1)
    return np.array(choices(open_bits, params.second_blocks, params.distance), U64)[:, None]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to pivots (columns)."""
    return np.stack([hamming(fps, p) for p in pivots], axis=1)


def bucket_edges(fps: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """One edge for every node but the first of each linked group of a bucket."""
    left = np.argsort(table[:, 0], kind="stable")
    edges = []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            v = queue.pop()
            lo, hi = np.searchsorted(table[left, 0], [table[v, 0] - distance, table[v, 0] + distance + 1])
            near = left[lo:hi]
            if not len(near):
                continue
            survives = np.abs(table[near] - table[v]).max(axis=1) <= distance
            survives[survives] = hamming(fps[near[survives]], fps[v]) <= distance
            if survives.any():
                reached = near[survives].tolist()
                edges += [(root, u) for u in reached]
                queue += reached
                left = np.concatenate([left[:lo], near[~survives], left[hi:]])
    return edges


def _search(buckets: DataFrame, params: SimHashParams, limit: int | None) -> DataFrame:
    """Edges (a, b) of buckets (key, choice, f0 ...); those above ``limit`` come back as fingerprints with new keys.

    A streamed bucket is held up to ``limit`` nodes (without a limit: whole, see above for its bound).
    """
    names = names_of(params)
    schema = "again boolean, a bigint, b bigint, key bigint, " + ", ".join(f"{n} bigint" for n in names)
    pivots = pivots_of(params)

    def edges_of(fps: np.ndarray, size: np.ndarray):
        """``size``: nodes of each whole bucket; the buckets lie one after the other in ``fps``."""
        table, heads = pivot_table(fps, pivots), np.cumsum(size) - size
        small = size <= 8
        bucket = np.repeat(np.arange(len(size)), size)
        for step in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero((bucket[:-step] == bucket[step:]) & small[bucket[:-step]])
            for a in range(0, len(i), 1 << 16):
                x = i[a : a + (1 << 16)]
                x = x[np.abs(table[x] - table[x + step]).max(axis=1) <= params.distance]
                x = x[hamming(fps[x], fps[x + step]) <= params.distance]
                yield fps[x], fps[x + step]
        for k in np.flatnonzero(~small).tolist():
            part = slice(int(heads[k]), int(heads[k] + size[k]))
            found = np.array(bucket_edges(fps[part], table[part], params.distance), np.int64).reshape(-1, 2)
            yield fps[part][found[:, 0]], fps[part][found[:, 1]]

    def batch_of(again: bool, a, b, key, fps) -> pa.RecordBatch:
        n = len(a if a is not None else key)
        blank = pa.nulls(n, pa.int64())
        whole = lambda x: blank if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
        columns = [whole(a), whole(b), whole(key), *(whole(None if fps is None else fps[:, k]) for k in range(params.words))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, again)), *columns], names=["again", "a", "b", "key", *names])

    def linked(fps: np.ndarray, size: np.ndarray):
        for a, b in edges_of(fps, size):
            if len(a):
                yield batch_of(False, node_of(a), node_of(b), None, None)

    def dealt_again(key: int, mask: np.ndarray, fps: np.ndarray):
        for k, m in enumerate(second_masks(params, mask)):
            salt = mix(np.array([(key * 131 + k) % 2**64], U64))
            yield batch_of(True, None, None, mix(node_of(fps & m) ^ salt), fps)

    def run(batches):
        masks = first_masks(params)
        key, choice, fps = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, params.words), U64)
        hot = None  # key of a bucket that is dealt again as it streams by
        for batch in batches:
            if not len(batch):
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            choice = np.concatenate([choice, batch.column("choice").to_numpy()])
            fps = np.concatenate([fps, np.stack([batch.column(n).to_numpy().view(U64) for n in names], axis=1)])
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(heads, len(key)))
            large = (size > limit) if limit else np.zeros(len(size), bool)
            large[0] |= hot is not None and key[0] == hot
            for k in np.flatnonzero(large):
                part = slice(int(heads[k]), int(heads[k] + size[k]))
                yield from dealt_again(int(key[part][0]), masks[int(choice[part][0])], fps[part])
            whole = ~large & (size > 1)
            whole[-1] = False  # the last bucket may go on
            if whole.any():
                yield from linked(fps[np.repeat(whole, size)], size[whole])
            hot = int(key[-1]) if large[-1] else None
            cut = len(key) if large[-1] else int(heads[-1])
            key, choice, fps = key[cut:], choice[cut:], fps[cut:]
        if len(fps) > 1:
            yield from linked(fps, np.array([len(fps)]))

    return buckets.repartition("key").sortWithinPartitions("key", *names).mapInArrow(run, schema)


def _dealt(nodes: DataFrame, columns: list[str], params: SimHashParams) -> DataFrame:
    """(key, choice, columns) of every node for every choice of bits."""
    signed = lambda m: F.lit(int(m) - (1 << 64) if int(m) >> 63 else int(m)).cast("long")
    keys = [
        F.struct(F.lit(k).alias("choice"), F.xxhash64(F.lit(k), *(F.col(n).bitwiseAND(signed(m)) for n, m in zip(names_of(params), row, strict=True))).alias("key"))
        for k, row in enumerate(first_masks(params).tolist())
    ]
    return nodes.select(F.explode(F.array(*keys)).alias("c"), *columns).select("c.key", "c.choice", *columns)


def links(nodes: DataFrame, params: SimHashParams) -> DataFrame:
    """Edges (a, b) between nodes that connect the distinct fingerprints f0 ... as all pairs within the distance do."""
    names = names_of(params)
    buckets = _dealt(nodes, names, params)
    first = materialize(_search(buckets, params, params.bucket_limit))
    again = first.where("again").select("key", F.lit(0).alias("choice"), *names)
    second = _search(again, params, None)
    return first.where("not again").select("a", "b").union(second.where("not again").select("a", "b"))


def pivots_of(params: SimHashParams) -> np.ndarray:
    """Reference fingerprints (rows)."""
    return mix(np.arange(1, params.pivots * params.words + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(params.pivots, params.words)


def largest_partner(size: np.ndarray, params: SimHashParams) -> np.ndarray:
    """The largest set that may be alike to a set of each size."""
    return np.floor(size / params.similarity + 1e-6).astype(np.int64)


#: Pairs of nodes that are looked at in one step.
STEP = 1 << 17


def _pairs_within(fps: np.ndarray, choice: np.ndarray, size: np.ndarray, params: SimHashParams, sizes: np.ndarray | None = None):
    """Places (x < y) of the pairs within the distance inside buckets that lie one after the other; each pair under its first common choice only.

    With ``sizes`` (of the nodes' sets) pairs of too unlike sizes are not looked at.  The pivot table discards pairs, the others are verified bit by bit.
    Steps run across buckets, so that the many small ones cost no more for each pair than large ones.
    """
    masks, table = first_masks(params), pivot_table(fps, pivots_of(params))

    def chosen(x, y):
        survives = np.abs(table[x] - table[y]).max(axis=1) <= params.distance
        x, y = x[survives], y[survives]
        near = hamming(fps[x], fps[y]) <= params.distance
        x, y = x[near], y[near]
        if len(x):
            other, first = fps[x] ^ fps[y], np.full(len(x), -1)
            for k, m in enumerate(masks):
                first[(first < 0) & ~(other & m).any(axis=1)] = k
            own = first == choice[x]
            x, y = x[own], y[own]
        return np.minimum(x, y), np.maximum(x, y)

    bucket = np.repeat(np.arange(len(size)), size)
    if sizes is None:
        order, last = np.arange(len(fps)), np.cumsum(size)[bucket]
    else:
        order = np.lexsort((sizes, bucket))
        place = lambda n: (bucket << 32) + np.minimum(n, (1 << 32) - 1)
        last = np.searchsorted(place(sizes[order]), place(largest_partner(sizes[order], params)), "right")
    # Node k of the order meets those behind it up to ``last``.
    reach = last - np.arange(len(order)) - 1
    before = np.concatenate([[0], np.cumsum(reach)])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(before, before[i] + STEP, "right")) - 1)
        if n := int(before[j] - before[i]):
            x = np.repeat(np.arange(i, j), reach[i:j])
            y = x + 1 + np.arange(n) - (before[x] - before[i])
            yield chosen(order[x], order[y])
        i = j


def _met(buckets: DataFrame, params: SimHashParams, limit: int, most: int = 0, turn: str = "node") -> DataFrame:
    """Pairs (a, b) within the distance of buckets (key, choice, node, size, root, part, parts, f0 ...), sorted by ``turn``.

    Buckets above ``limit`` (0: none is), and those of over ``most`` nodes that would give more pairs for each node than one of ``most`` nodes could (0: none does), only give pairs
    with their first node, and all their rows come back (``again``).  Nodes with one root are connected; a unit of two parts gives the pairs across them only.
    """
    names, pivots = names_of(params), pivots_of(params)
    schema = "again boolean, a bigint, b bigint, key bigint, choice int, node bigint, size int, " + ", ".join(f"{n} bigint" for n in names)
    fields = ["again", "a", "b", "key", "choice", "node", "size", *names]

    def run(batches):
        plain = ("key", "choice", "node", "size", "root", "part", "parts")
        held = [np.zeros(0, np.int64) for _ in plain]
        fps, hot = np.zeros((0, params.words), U64), None  # hot: key, node, size, root and fingerprint of the leader of a bucket that streams by

        def pairs(x, y):
            _, _, node, _, root, part, parts = held
            ok = (root[x] != root[y]) & ((parts[x] == 1) | (part[x] != part[y]))
            return x[ok], y[ok]

        def batch_of(a, b):
            blank = lambda t: pa.nulls(len(a), t)
            columns = [pa.array(np.zeros(len(a), bool)), pa.array(a), pa.array(b), blank(pa.int64()), blank(pa.int32()), blank(pa.int64()), blank(pa.int32()), *(blank(pa.int64()) for _ in names)]
            return pa.RecordBatch.from_arrays(columns, names=fields)

        def returned(at):
            key, choice, node, size = (held[k][at] for k in range(4))
            blank = pa.nulls(len(key), pa.int64())
            columns = [pa.array(np.ones(len(key), bool)), blank, blank, pa.array(key), pa.array(choice.astype(np.int32)), pa.array(node), pa.array(size.astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(fps[at, k]).view(np.int64)) for k in range(params.words))], names=fields)

        def leader(at: int):
            return held[0][at], held[2][at], held[3][at], held[4][at], fps[at].copy()

        def led(lead, at):
            """All rows, and the pairs with the leader."""
            _, node, size, root, fp = lead
            yield returned(at)
            near = at[held[4][at] != root]
            near = near[(held[3][near] <= largest_partner(size, params)) & (size <= largest_partner(held[3][near], params))]
            # The leader's row of the pivot table discards first, here as well.
            near = near[np.abs(pivot_table(fps[near], pivots) - pivot_table(fp[None], pivots)).max(axis=1) <= params.distance]
            near = near[hamming(fps[near], fp) <= params.distance]
            if len(near):
                yield batch_of(np.full(len(near), node), held[2][near])

        def closed(whole, size):
            """Pairs of whole buckets; ``whole`` tells them among the held."""
            crowded = whole & (size > most) if most else np.zeros(len(whole), bool)
            yield from given(np.flatnonzero(np.repeat(whole & ~crowded, size)), size[whole & ~crowded])
            heads = np.cumsum(size) - size
            for k in np.flatnonzero(crowded).tolist():
                at, found, n = np.arange(heads[k], heads[k] + size[k]), [], 0
                for batch in given(at, size[k : k + 1]):
                    found.append(batch)
                    n += len(batch)
                    if 2 * n > most * len(at):
                        found = led(leader(at[0]), at)
                        break
                yield from found

        def given(at, size):
            for x, y in _pairs_within(fps[at], held[1][at], size, params, held[3][at]):
                x, y = pairs(at[x], at[y])
                if len(x):
                    yield batch_of(held[2][x], held[2][y])

        for batch in batches:
            if not len(batch):
                continue
            held = [np.concatenate([h, batch.column(n).to_numpy().astype(np.int64)]) for h, n in zip(held, plain, strict=True)]
            fps = np.concatenate([fps, np.stack([batch.column(n).to_numpy().view(U64) for n in names], axis=1)])
            key = held[0]
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1])]))
            size = np.diff(np.append(heads, len(key)))
            large = (size > limit) if limit else np.zeros(len(size), bool)
            large[0] |= hot is not None and key[0] == hot[0]
            for k in np.flatnonzero(large).tolist():
                at = np.arange(heads[k], heads[k] + size[k])
                if hot is None or hot[0] != key[at[0]]:
                    hot = leader(at[0])
                yield from led(hot, at)
            whole = ~large & (size > 1)
            whole[-1] = False  # the last bucket may go on
            if whole.any():
                yield from closed(whole, size)
            if not large[-1]:
                hot = None
            cut = len(key) if large[-1] else int(heads[-1])
            held, fps = [h[cut:] for h in held], fps[cut:]
        if len(fps) > 1:
            yield from closed(np.array([True]), np.array([len(fps)]))

    columns = ["key", "choice", "node", "size", "root", "part", "parts", *names]
    return buckets.repartition("key").sortWithinPartitions("key", turn).select(*columns).mapInArrow(run, schema)


def _proposed(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, params: SimHashParams) -> DataFrame:
    """The proposed pairs (a, b) whose sets of shingles have the Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    n, both = F.size("sa") + F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    return materialize(pairs.join(left, "a").join(right, "b").where(both * (1 + params.similarity) >= n * params.similarity - 1e-9).select("a", "b"))


def alike_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], params: SimHashParams) -> DataFrame:
    """Edges (a, b) that connect nodes (node, size, f0 ...) as all pairs do that meet and whose sets are alike; ``sets_of`` reads (node, shingles) of nodes from the texts."""
    names = ["node", "size", *names_of(params)]
    one = {"root": F.col("node"), "part": F.lit(0), "parts": F.lit(1)}
    turn = lambda k: F.xxhash64(F.col("node"), F.lit(k))
    # A small set that differs from another one by a single shingle is not alike to it.
    able = nodes.where(F.col("size") * (1 - params.similarity) >= params.similarity - 1e-6)
    met = materialize(_met(_dealt(able, names, params).withColumns(one), params, params.bucket_limit, params.small))
    pairs, rest = _proposed(met.where("not again")), met.where("again").select("key", "choice", *names)
    # The texts are read once, for the pairs there are and for all that may follow.
    sets = sets_of(_ends(pairs).union(rest.select("node")).distinct())
    if rest.isEmpty():
        return _alike(pairs, sets, params)
    edges = _alike(pairs, sets, params)

    def rooted():
        return rest.join(components(edges).select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    for k in range(1, params.rounds):
        led = _met(rooted().withColumns({"part": one["part"], "parts": one["parts"]}).withColumn("turn", turn(k)), params, 1, turn="turn")
        edges = materialize(edges.union(_alike(_proposed(led.where("not again")), sets, params)))
    left = materialize(rooted())
    # Buckets whose nodes are all connected are done; the others go in units of two parts (a unit of one part if one is enough).
    counts = left.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    sized = left.join(counts.select("key", F.ceil(F.col("n") / params.bucket_limit).cast("long").alias("c")), "key").withColumn("part", F.pmod(turn(-1), F.col("c")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))
    units = sized.select("*", other.alias("other")).withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    parts = F.when(F.col("part") == F.col("other"), 1).otherwise(2)
    last = _met(units.withColumn("parts", parts), params, 0)
    return edges.union(_alike(_proposed(last.where("not again")), sets, params))


def shingle_sets(docs: DataFrame, params: SimHashParams, text_column: str) -> DataFrame:
    """(node, shingles) of every row: the sorted set of its shingles' hashes and its number."""

    def run(batches):
        for batch in batches:
            for i, j, _, _ in pieces(batch.column(0)):
                sets = [np.unique(shingles(t or b"", params)) for t in batch.column(0)[i:j].to_pylist()]
                number = pa.array(np.array([set_number(h) for h in sets], U64).view(np.int64))
                yield pa.RecordBatch.from_arrays([number, pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select(F.col(text_column).cast("binary").alias("text")).mapInArrow(run, "node bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, params: SimHashParams | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, fp (the first 64 bits as a signed long) and component, the smallest id that links reach.

    Null and empty texts have fingerprint 0 (with a similarity: no shingles) and are linked like any other.  Repeated rows are one node and come
    back row by row.  Null ids stay and name no component unless it has no other.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    params = params or SimHashParams()
    names = names_of(params)
    rows = materialize(fingerprints(docs, params, id_column, text_column))
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("id"), *(F.first(n).alias(n) for n in rows.columns[2:])))
    if params.similarity:

        def sets_of(wanted: DataFrame) -> DataFrame:
            # Only texts of rows whose id may name a wanted node are cut into shingles a second time.
            wanted = materialize(wanted)
            ids = rows.join(wanted, "node", "left_semi").select("id")
            texts = _thinned(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), ids, "id")
            return materialize(_thinned(shingle_sets(texts, params, "text"), wanted, "node").join(wanted, "node", "left_semi").dropDuplicates(["node"]))

        edges = alike_links(nodes.select("node", "size", *names), sets_of, params)
    else:
        edges = links(nodes.select(*names), params)
    roots = components(edges)
    named = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    groups = named.join(least, "root").select("node", "component")
    return rows.join(groups, "node").select(F.col("id").alias(id_column), F.col("f0").alias("fp"), "component")


def one_of_each(docs: DataFrame, params: SimHashParams | None = None, id_column: str = "doc_id") -> DataFrame:
    """The rows whose id names their component, with all columns; rows without an id stay."""
    found = near_duplicates(docs, params, id_column)
    dropped = found.where((F.col("component") != F.col(id_column))).select(F.col(id_column).alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_column] == dropped["_dropped"], "left_anti")
