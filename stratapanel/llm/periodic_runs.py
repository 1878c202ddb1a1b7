"""Periodic runs of words, found with a dictionary of basic factors.

For every power of two L, equal stretches of L words of a text share a name; names of 2L come from pairs of names of L.
The next occurrence of a name is its successor.  Where successors at one distance d, L/2 < d <= L (so both lie in a window of
2L words), follow each other without a gap, the occurrences form an arithmetic progression, and d is proposed as a period.

This finds every run of period q and length of 3q or more, whole and once: take the one L with q <= L < 2q.  Each start i in the run
with i + q + L inside it has its successor at q: not nearer, since L >= q words that recur at a shorter distance inside
the run would give it a shorter period, and there is such a start, since q + L < 3q.  Starts beside them recur at q only if the run
goes on.  So proposals at neighbouring starts that agree on d are parts of one stretch; uniting them extends it to its full length.
The other way round, a united stretch of 3d words or more has no period q below d, or its first start would recur at q already.

Names that occur once in a text cannot recur at a greater length; only the others go on to the next level.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratapanel.llm.arrays import pieces, words_of


@dataclass(frozen=True)
class RunParams:
    """A run has ``times`` periods (3 at least, or the proof above fails) and ``least_words`` words."""

    least_words: int = 24
    times: int = 3


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words of the same text only."""
    size = ends - starts
    total = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.repeat(starts - total[:-1], size) + np.arange(total[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + owner * len(coded.dictionary)


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of each key, -1 if it occurs once, and the indices of those with a successor and of their successors."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    lone = new & np.append(new[1:], True)
    names = np.empty(len(keys), np.int64)
    names[order] = np.where(lone, -1, np.cumsum(new) - 1)
    return names, order[:-1][~new[1:]], order[1:][~new[1:]]


def find_runs(words: np.ndarray, p: RunParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start and period.  Texts may follow one another if they share no names."""
    n = len(words)
    names, at = words, np.arange(n)
    dense = np.full(n, -1, np.int64)  # name of the stretch that starts at each word, -1 for one that does not recur
    found, level = [], 1
    while len(at):
        fresh, first, second = _named(names)
        gap = at[second] - at[first]
        near = (gap <= level) & (2 * gap > level)
        place, gap = at[first][near], gap[near]
        if len(place):
            order = np.argsort(place)
            place, gap = place[order], gap[order]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(gap) != 0)]))
            tail = np.append(head[1:], len(place)) - 1
            length = place[tail] - place[head] + level + gap[head]
            keep = length >= np.maximum(p.least_words, p.times * gap[head])
            found.append(np.stack([place[head], length, gap[head]])[:, keep])
        dense[at] = fresh
        level *= 2
        # Both halves must recur for the whole to recur; a run of period q needs levels below 2q only.
        on = (fresh >= 0) & (at + level <= n)
        on[on] = dense[at[on] + level // 2] >= 0
        lost, at = at[~on], at[on]
        names = dense[at] * np.int64(n) + dense[at + level // 2]
        dense[lost] = -1
        if level >= 2 * max(1, n // p.times):
            break
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort([period, start])
    return start[order], length[order], period[order]


def periodic_tail(doc_id, n: int) -> np.ndarray | None:
    """Word numbers of the test edit: for every tenth id, words from some place on repeat a stretch; None where nothing changes."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return i


class _Joined:
    """SHA-256 of words joined by one blank, a bounded number of bytes at a time."""

    def __init__(self, data: np.ndarray, limit: int = 1 << 22):
        self.data, self.limit = data, limit

    def digest(self, starts: np.ndarray, ends: np.ndarray) -> str:
        out, size = hashlib.sha256(), ends - starts
        total = np.concatenate([[0], np.cumsum(size + 1)])
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(total, total[i] + self.limit, "right")) - 1)
            if j == i + 1 and size[i] > self.limit:  # one long word, without a copy
                out.update(memoryview(self.data[starts[i] : ends[i]]))
                out.update(b" " if j < len(size) else b"")
            else:
                here = total[i : j + 1] - total[i]
                letters = self.data[np.minimum(np.repeat(starts[i:j] - here[:-1], size[i:j] + 1) + np.arange(here[-1]), len(self.data) - 1)]
                letters[here[1:] - 1] = 32
                out.update(memoryview(letters if j < len(size) else letters[:-1]))
            i = j
        return out.hexdigest()


def _best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, int, int]:
    k = min(range(len(start)), key=lambda k: (-Fraction(int(length[k]), int(period[k])), int(start[k]), int(period[k])))
    return int(start[k]), int(length[k]), int(period[k])


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
           ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))]


def periodic_runs(docs: DataFrame, params: RunParams = RunParams(), *, edit=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_runs, the run with the greatest length/period, digests, and ``runs`` as a list of (start, length, period).

    Words are stretches without blanks (0x20, 0x09-0x0D), counted from 0.  ``collapsed_sha256`` is the digest of the words that stay when
    every run is cut to its first period.  ``edit(id, n)`` may give the word numbers to look at instead of 0..n-1 (None: as they are).
    Null and empty texts have no words and no runs; their digests are those of an empty string, and the best run is null.
    Among equally good runs the first start, then the shortest period counts.  Repeated rows and ids and null ids each give a row; other columns
    are ignored; an empty table gives no rows.  Nothing is shuffled; a task holds about a hundred bytes a word of its longest text.
    """
    if params.times < 3:
        raise ValueError("runs of fewer than three periods need another search")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, "
              "runs array<struct<start:bigint,length:bigint,period:bigint>>")  # fmt: skip

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, j, data, offsets in pieces(batch.column(1)):
                rows += _piece(ids[i:j], data, offsets, params, edit)
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)] if rows else [pa.array([], t) for _, t in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, *[n for n, _ in _FIELDS]])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def _piece(ids: list, data: np.ndarray, offsets: np.ndarray, p: RunParams, edit) -> list[tuple]:
    starts, ends, owner = words_of(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
    if edit is not None:
        chosen = np.arange(len(starts))
        for k, doc_id in enumerate(ids):
            order = edit(doc_id, int(bounds[k + 1] - bounds[k]))
            if order is not None:
                chosen[bounds[k] : bounds[k + 1]] = bounds[k] + order
        starts, ends = starts[chosen], ends[chosen]
    names = word_names(data, starts, ends, owner) if len(starts) else np.zeros(0, np.int64)
    start, length, period = find_runs(names, p)
    marks = np.zeros(len(starts) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.cumsum(marks[:-1]) == 0
    mine, joined, out = np.searchsorted(start, bounds), _Joined(data), []
    for k in range(len(ids)):
        a, b = int(bounds[k]), int(bounds[k + 1])
        lo, hi = int(mine[k]), int(mine[k + 1])
        stay = slice(a, b) if lo == hi else np.flatnonzero(kept[a:b]) + a
        collapsed = joined.digest(starts[stay], ends[stay])
        s, n, q = start[lo:hi] - a, length[lo:hi], period[lo:hi]
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True))
        best = _best(s, n, q) if hi > lo else None
        runs = [{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)]
        out.append((hi - lo, *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), collapsed, runs))
    return out
