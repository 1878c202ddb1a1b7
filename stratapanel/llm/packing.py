"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep their stored order and form one token stream per input partition.  Windows of at
most ``window`` tokens are cut from the stream where a document or a sentence ends.  The cuts
minimise padding plus truncation penalties:

    f(j) = penalty(j) + open_cost + min over i of f(i) + padding(pos(j) - pos(i))

Padding is ``window`` minus the length, so ``f(i) + pos(i)`` separates and a monotone queue gives
the minimum over all ``i`` within reach.  Windows whose length is a power of two need no padding;
these few transitions are looked up by position.  A stretch without any boundary gets forced
ones at a high penalty.  The stream is cut in blocks; tokens behind the best last cut of a block
move on to the next one, so memory is bounded by a block and the longest document.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratapanel.llm.tokens import encoder


@dataclass(frozen=True)
class Packing:
    """Parameters: vocabulary file, window, end id, and costs in tokens of padding."""

    path: str
    window: int = 2048
    end_id: int = 1
    sentence_penalty: float = 6.0
    forced_penalty: float = 48.0
    open_cost: float = 4.0
    least_power: int = 256
    forced_step: int = 128
    block_tokens: int = 1 << 17


def best_cuts(pos: list[int], penalty: list[float], exact: list[list[int]], p: Packing, closed: bool) -> list[int]:
    """Indices of the chosen boundaries, the first being 0.

    ``pos`` rises strictly; ``exact[j]`` lists the boundaries from which a window up to ``j`` needs
    no padding.  ``closed``: the last boundary must be a cut; else the best one within a window of
    the end is the last.
    """
    n, window, extra = len(pos), p.window, p.open_cost
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(pos[0]), 0)])
    for j in range(1, n):
        here = pos[j]
        while pos[queue[0][1]] < here - window:
            queue.popleft()
        value, at = queue[0]
        best = value + window - here
        for i in exact[j]:
            if f[i] < best:
                best, at = f[i], i
        best += penalty[j] + extra
        f[j], back[j] = best, at
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    last = n - 1
    if not closed:
        reach = [j for j in range(n) if pos[-1] - pos[j] < window]
        last = min(reach, key=lambda j: (f[j] + pos[j], -j))
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def boundaries(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, p: Packing) -> tuple[list[int], list[float], list[list[int]]]:
    """Cut positions, their penalties and, for each, the boundaries a power of two before it."""
    inner = np.flatnonzero(sentence[ids]) + 1
    pos = np.union1d(np.union1d(inner, ends), [0, len(ids)])
    gaps = np.flatnonzero(np.diff(pos) > p.window // 2)
    forced = [np.arange(pos[g] + p.forced_step, pos[g + 1], p.forced_step) for g in gaps]
    if forced:
        pos = np.union1d(pos, np.concatenate(forced))
    penalty = np.full(len(pos), p.forced_penalty)
    penalty[np.isin(pos, inner)] = p.sentence_penalty
    penalty[np.isin(pos, ends)] = 0.0
    exact: list[list[int]] = [[] for _ in range(len(pos))]
    power = p.least_power
    while power <= p.window:
        at = np.searchsorted(pos, pos - power)
        for j in np.flatnonzero((pos >= power) & (pos[at] == pos - power)).tolist():
            exact[j].append(int(at[j]))
        power *= 2
    return pos.tolist(), penalty.tolist(), exact


_SENTENCE: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """Marks the ids whose text ends a sentence or a line."""
    if path not in _SENTENCE:
        whole = encoder(path).whole
        size = whole.get_vocab_size()
        texts = whole.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        _SENTENCE[path] = np.array([t.rstrip(" \"')")[-1:] in (".", "!", "?", "\n", "。") and bool(t.rstrip(" \"')")) for t in texts])
    return _SENTENCE[path]


class _Stream:
    """Tokens of a partition that wait for their window."""

    def __init__(self, p: Packing, partition: int):
        self.p, self.sequence = p, partition << 33
        self.sentence = sentence_ends(p.path)
        self.docs: list[tuple] = []  # doc_id, tokens left, ids before them, tokens in all
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)

    def flush(self, closed: bool) -> list[tuple]:
        """Pieces of all windows that are final."""
        if not self.size:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        pos, penalty, exact = boundaries(ids, ends, self.sentence, self.p)
        cuts = [pos[i] for i in best_cuts(pos, penalty, exact, self.p, closed)]
        out, k, here = [], 0, 0
        for cut_from, cut_to in zip(cuts, cuts[1:], strict=False):
            while here < cut_to:
                doc_id, own, before, total = self.docs[k]
                first = here - (int(ends[k]) - len(own))
                upto = min(cut_to, int(ends[k]))
                part = own[first : first + upto - here]
                out.append((doc_id, before + first, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, here - cut_from))
                here = upto
                k += here == ends[k]
            self.sequence += 1
        rest = self.docs[k:]
        if rest:
            doc_id, own, before, total = rest[0]
            first = here - (int(ends[k]) - len(own))
            rest[0] = (doc_id, own[first:], before + first, total)
        self.docs, self.size = rest, len(ids) - here
        return out


def pack(docs: DataFrame, params: Packing, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``; null and empty texts are that id alone.  Repeated rows
    and ids are packed row by row.  Null ids are kept.  An empty table gives no pieces.  Other columns are
    ignored.  Nothing is shuffled: windows do not cross partitions, and each partition ends with at most
    one window that is short.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches):
        context = TaskContext.get()
        stream = _Stream(params, context.partitionId() if context else 0)
        enc, end = encoder(params.path), np.array([params.end_id], np.uint32)
        names = None
        for batch in batches:
            names = [(id_column, batch.schema.field(0).type)] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.column(batch.column(1)), strict=True):
                stream.add(doc_id, np.concatenate([ids, end]))
                if stream.size >= params.block_tokens:
                    yield from _as_batch(stream.flush(False), names)
        if names:
            yield from _as_batch(stream.flush(True), names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def _as_batch(rows: list[tuple], names: list[tuple]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])
