"""Removal of repeated byte strings by a sampled, enhanced suffix array.

A string of ``length`` bytes that occurs twice chooses the same anchor in both places: the rightmost of the
smallest hashes of its ``k``-byte runs.  Sorting suffixes only at anchors is enough to see every such string,
and suffixes with different anchor runs need not be compared.  So anchors are grouped by their run;
groups of one, which are most of the text, are dropped early.

Inside a group the occurrences are sorted by the bytes from the anchor on (suffix array) with the common prefixes of
neighbours.  One scan with a stack closes the common-prefix intervals from the deepest up.  Where two
children of an interval meet, the bytes before the anchor decide how far the repeat extends to the left: occurrences are kept in
the order of their reversed left sides, and only where left sides differ does a maximal repeat end.
Each occurrence thereby meets its best partner at every depth, and all occurrences of a maximal repeat are reported, not only those
that are neighbours in the array.

Occurrences with equal surroundings are counted before any text is moved, so copies cost one row.
A group with more than ``group_limit`` different surroundings is taken apart into single strings, which are counted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import PrefixHash, mix, window_minima
from stratapanel.llm.bits import bit_table, marked
from stratapanel.runtime import materialize


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200
    k: int = 24
    group_limit: int = 1 << 15


def anchors(raw: bytes, params: RepeatParams) -> tuple[np.ndarray, ...]:
    """First and last string that an anchor stands for, the anchor, its run's hash and its surroundings' hash."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < params.length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = PrefixHash(data)
    h = prefix.windows(params.k)
    at = window_minima(h, params.length - params.k + 1)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.append(lo[1:], len(at)) - 1
    return lo, hi, at[lo], h[at[lo]], prefix.spans(lo, hi + params.length)


def common(x: bytes, y: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def repeated_windows(members: list[tuple[int, int, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For occurrences of one anchor run (first string, last string, surroundings): the strings that occur again.

    Strings are numbered by their start, counted from the anchor (0 or below).  Each result is a list of
    closed intervals.
    """
    lefts = [text[: -a or len(text) + 1][::-1] if a else b"" for a, _, text in members]
    rights = [text[-a:] for a, _, text in members]
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    farthest = max(map(len, lefts), default=0)

    def meet(i: int, j: int, right: int) -> None:
        left = common(lefts[i], lefts[j])
        if left + right < length:
            return
        for k in (i, j):
            lo, hi = max(-left, members[k][0]), min(right - length, members[k][1])
            if lo <= hi:
                out[k].append((lo, hi))

    def merged(one: list[tuple[bytes, int]], two: list[tuple[bytes, int]], right: int) -> list[tuple[bytes, int]]:
        if len(one) < len(two):
            one, two = two, one
        for item in two:  # the smaller side moves
            at = bisect_left(one, item)
            if at:
                meet(item[1], one[at - 1][1], right)
            if at < len(one):
                meet(item[1], one[at][1], right)
            one.insert(at, item)
        return one

    order = sorted(range(len(members)), key=rights.__getitem__)
    stack: list[tuple[int, list[tuple[bytes, int]]]] = []
    for place, i in enumerate(order):
        onward = common(rights[i], rights[order[place + 1]]) if place + 1 < len(order) else -1
        node = [(lefts[i], i)]
        while stack and stack[-1][0] >= onward:
            depth, before = stack.pop()
            if depth + farthest >= length:
                node = merged(before, node, depth)
            # A shallower interval cannot hold a long enough repeat, nor can its parents.
        stack.append((onward, node))
    return [_union(x) for x in out]


def _union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))


def _slices(batches):
    """Parts of a few rows, so that what a task makes of them stays small."""
    for batch in batches:
        for k in range(0, len(batch), 128):
            yield batch.slice(k, 128)


def _anchor_table(numbered: DataFrame, params: RepeatParams) -> DataFrame:
    """(row, place, run, around) of all anchors; ``place`` holds the first string, the last one and the anchor."""

    def run(batches):
        for batch in batches:
            rows, parts, size = batch.column(0).to_numpy(), [], 0
            for row, raw in zip(rows.tolist(), batch.column(1), strict=True):
                lo, hi, at, h, c = anchors(raw.as_py() or b"", params)
                if len(lo):
                    parts.append((np.full(len(lo), row), (lo << 20) | ((hi - lo) << 10) | (at - lo), h, c))
                    size += len(lo)
                if size > 20_000:
                    yield packed(parts)
                    parts, size = [], 0
            if parts:
                yield packed(parts)

    def packed(parts):
        row, place, h, c = (np.concatenate([p[k] for p in parts]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(place), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names=["row", "place", "run", "around"])

    return numbered.select("row", "text").mapInArrow(run, "row bigint, place bigint, run bigint, around bigint")


def _only(numbered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``numbered`` that may be among ``wanted`` (column row); a bounded bit table thins them out before the shuffle."""
    return numbered.mapInArrow(_chosen(wanted, numbered, True), numbered.schema)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    return mix(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _chosen(wanted: DataFrame, numbered: DataFrame, inside: bool):
    def hashes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_row_hash(batch.column(0).to_numpy()).view(np.int64))], names=["h"])

    bits, table = bit_table(wanted.select("row").mapInArrow(hashes, "h bigint"), F.col("h"))
    shared = numbered.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, bits, _row_hash(batch.column(0).to_numpy())) == inside))

    return run


def _surroundings(numbered: DataFrame, chosen: DataFrame, params: RepeatParams) -> DataFrame:
    """The text around one occurrence of each (run, around): (run, around, first, last, text)."""
    lists = chosen.groupBy("row").agg(F.collect_list(F.struct("place", "run", "around")).alias("found"))
    texts = _only(numbered.select("row", "text"), chosen.select("row").distinct())

    def cut(batches):
        for part in _slices(batches):
            lists = part.column(1)
            ends, values = lists.offsets.to_numpy(), lists.values
            place, run, around = (values.field(k).to_numpy() for k in ("place", "run", "around"))
            lo, size, at = place >> 20, place >> 10 & 1023, place & 1023
            texts = []
            for k, raw in enumerate(part.column(0)):
                raw = raw.as_py()
                texts += [raw[lo[x] : lo[x] + size[x] + params.length] for x in range(ends[k], ends[k + 1])]
            own = slice(int(ends[0]), int(ends[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run[own]), pa.array(around[own]), pa.array((-at[own]).astype(np.int32)), pa.array((size - at)[own].astype(np.int32)), pa.array(texts, pa.binary())],
                names=["run", "around", "first", "last", "text"],
            )

    return texts.join(lists, "row").select("text", "found").mapInArrow(cut, "run bigint, around bigint, first int, last int, text binary")


def _compared(around: DataFrame, params: RepeatParams) -> DataFrame:
    """(again, run, around, first, last, string): repeated strings of every group; of too large groups each string."""
    schema = "again boolean, run bigint, around bigint, first int, last int, string bigint"
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = ["again", "run", "around", "first", "last", "string"]

    def taken_apart(run, members):
        """A batch for a few members at a time."""
        for k in range(0, len(members), 64):
            some = members[k : k + 64]
            at = np.concatenate([np.arange(a, b + 1, dtype=np.int32) for _, a, b, _ in some])
            sizes = [b - a + 1 for _, a, b, _ in some]
            h = np.concatenate([PrefixHash(np.frombuffer(text, np.uint8)).windows(params.length) for *_, text in some])
            n = len(at)
            around = np.repeat(np.array([m[0] for m in some], np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, True)), pa.array(np.full(n, run)), pa.array(around), pa.array(at), pa.array(at), pa.array(h.view(np.int64))], names=names)

    def closed(run, members):
        if len(members) > 1:
            found = repeated_windows([m[1:] for m in members], params.length)
            for (c, _, _, _), intervals in zip(members, found, strict=True):
                for lo, hi in intervals:
                    yield (False, run, c, lo, hi, 0)

    def run(batches):
        at, members, large, out = None, [], False, []

        def ready(limit):
            nonlocal out
            if len(out) > limit:
                rows, out = out, []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for key, c, a, b, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != at:
                    if not large:
                        out.extend(closed(at, members))
                    at, members, large = key, [], False
                    yield from ready(20_000)
                members.append((c, a, b, text))
                if large or len(members) > params.group_limit:
                    large = True
                    yield from taken_apart(at, members)
                    members = []
        if not large:
            out.extend(closed(at, members))
        yield from ready(0)

    return around.repartition("run").sortWithinPartitions("run").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, params: RepeatParams | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, starts): per row number, the intervals of starts of strings that also start elsewhere.

    ``docs`` must give the same rows in the same partitions whenever it is read, as a table does.
    """
    params = params or RepeatParams()
    numbered = _numbered(docs, id_column, text_column)
    found = _anchor_table(numbered, params)
    repeated = found.groupBy("run").count().where("count > 1").select("run")
    shared = materialize(found.join(repeated, "run"))
    classes = materialize(shared.groupBy("run", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")))
    several = classes.groupBy("run").count().where("count > 1").select("run")
    chosen = materialize(classes.join(several, "run").select("run", "around", "one.row", "one.place"))
    compared = materialize(_compared(_surroundings(numbered, chosen, params), params))
    strings = compared.where("again").select("run", "around", "first", "string")
    twice = strings.groupBy("run", "first", "string").count().where("count > 1").select("run", "first", "string")
    apart = strings.join(twice, ["run", "first", "string"]).select("run", "around", "first", F.col("first").alias("last"))
    pairs = compared.where("not again").select("run", "around", "first", "last").union(apart)
    # Surroundings that occur twice make all their strings repeated.
    place = F.col("one.place")
    at = place.bitwiseAND(F.lit(1023))
    whole = classes.where("n > 1").select("run", "around", (-at).cast("int").alias("first"), (F.shiftright(place, 10).bitwiseAND(F.lit(1023)) - at).cast("int").alias("last"))
    anchor = F.shiftright("place", 20) + F.col("place").bitwiseAND(F.lit(1023))
    starts = shared.join(pairs.union(whole), ["run", "around"]).select("row", F.struct((anchor + F.col("first")).alias("lo"), (anchor + F.col("last")).alias("hi")).alias("s"))
    return starts.groupBy("row").agg(F.collect_list("s").alias("starts"))


def remove_repeats(docs: DataFrame, params: RepeatParams | None = None, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with ``with_text`` also the kept bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another one,
    overlaps included.  Null texts are empty, texts below ``length`` bytes stay, and repeated rows are repeats of each
    other.  Null ids are kept.  An empty table gives an empty result.
    """
    params = params or RepeatParams()
    numbered = _numbered(docs, id_column, text_column)
    spans = materialize(repeated_spans(docs, params, id_column, text_column))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def finished(ids: pa.Array, texts: pa.Array, starts: list[list[tuple[int, int]]]):
        out = []
        for text, intervals in zip(texts, starts, strict=True):
            raw = text.as_py() or b""
            runs = _union([(lo, hi + params.length - 1) for lo, hi in intervals])
            at, kept = 0, []
            for lo, hi in runs:
                kept.append(raw[at:lo])
                at = hi + 1
            rest = b"".join([*kept, raw[at:]]) if kept else raw
            out.append((len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()) + (rest,) * with_text)
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    def untouched(batches):
        for part in _slices(batches):
            yield finished(part.column(0), part.column(1), [[]] * len(part))

    def cut(batches):
        for part in _slices(batches):
            lists = part.column(2)
            ends, lo, hi = lists.offsets.to_numpy(), lists.values.field("lo").to_numpy(), lists.values.field("hi").to_numpy()
            starts = [list(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield finished(part.column(0), part.column(1), starts)

    touched = numbered.mapInArrow(_chosen(spans, numbered, True), numbered.schema)
    others = numbered.mapInArrow(_chosen(spans, numbered, False), numbered.schema)
    changed = touched.join(spans, "row", "left").select("id", "text", "starts").mapInArrow(cut, schema)
    return changed.union(others.select("id", "text").mapInArrow(untouched, schema))
