"""Token counts of whole texts under a BPE vocabulary of pieces, by overlap resynchronisation.

A piece vocabulary has no word splitting: a text is one sequence of merges, and encoding a huge one
needs memory and a queue in proportion to it.  Long texts are therefore encoded in overlapping
chunks, and neighbours are spliced at a token that both of them hold.

Why such a splice is exact.  Merges run in the order (score, leftmost).  Until a merge crosses some
token boundary, the two sides merge independently of each other, so whether it is ever crossed
depends on the two tokens beside it alone.  Hence tokens are the encoding of their text if and only if
every two neighbours are the encoding of theirs.  Inside a chunk all neighbours are; at a token with the
same start and end in both chunks, the one before it comes from the left chunk and the one after it from the
right chunk, and both pairs were neighbours already.

A chunk without a common token in its overlap (long runs whose phase differs) is encoded again, starting at a
token of the left chunk, with twice the overlap, and so on; in the end it starts where the text does, which is
exact without a splice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CountParams:
    """Vocabulary file, code points in a chunk and in the overlap of two, and the limit that is flagged."""

    path: str
    chunk: int = 16_384
    overlap: int = 128
    limit: int = 4096
    batch_chars: int = 1 << 19


class PieceCounter:
    """Counts tokens under a BPE model file that maps characters one to one (no normalisation)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        # Code points of a token; a character given as bytes counts at its first byte.
        self.length = np.array([
            int(int(p[3:5], 16) & 0xC0 != 0x80) if self.model.is_byte(i) else 0 if self.model.is_control(i) else 1 if self.model.is_unknown(i) else len(p)
            for i, p in enumerate(pieces)], np.int64)
        joined = set("".join(p for i, p in enumerate(pieces) if len(p) > 1 and not self.model.is_byte(i)))
        #: A character that no piece joins with another: merges never cross it.
        self.wall = next(c for c in map(chr, range(10, 0x10000)) if c not in joined)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def tokens(self, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the tokens of ``text[a:b]``, as if it stood alone; at 0 with the blank the model puts in front."""
        return next(self.many(text, [(a, b)]))

    def many(self, text: str, spans: list[tuple[int, int]]):
        """``tokens`` of several spans."""
        encoded = self.model.encode([text[a:b] if a == 0 else self.wall + text[a:b] for a, b in spans], num_threads=1)
        for (a, b), ids in zip(spans, encoded, strict=True):
            size = self.length[np.asarray(ids, np.int64)]
            front = 2 if a else min(1, b)  # the model's own blank (none before an empty text), and the wall
            start = np.cumsum(size) - size
            if int(size.sum()) != front + b - a:
                raise ValueError("the vocabulary's tokens do not cover the text one to one")
            if a:
                first = int(np.searchsorted(start, front))
                start, size = start[first:], size[first:]
            yield start + (a - front), size


def _common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], lo: int) -> tuple[int, int] | None:
    """Indices of a token that both lists hold, not before ``lo`` on the left: the middle one."""
    (s, n), (t, m) = left, right
    if not len(t) or not len(s):
        return None
    first = max(lo, int(np.searchsorted(s, t[0])))
    last = int(np.searchsorted(t, s[-1], "right"))
    a = np.flatnonzero(n[first:] > 0) + first
    b = np.flatnonzero(m[:last] > 0)
    _, i, j = np.intersect1d(s[a], t[b], assume_unique=True, return_indices=True)
    same = np.flatnonzero(n[a[i]] == m[b[j]])
    if not len(same):
        return None
    k = same[len(same) // 2]
    return int(a[i[k]]), int(b[j[k]])


def count_long(counter: PieceCounter, text: str, p: CountParams, group: int = 32) -> tuple[int, int]:
    """Tokens of one text from overlapping chunks, and how many overlaps were widened."""
    step = p.chunk - p.overlap
    if step <= 0:
        raise ValueError("chunk must be larger than overlap")
    spans = [(a, min(len(text), a + p.chunk)) for a in range(0, max(1, len(text) - p.overlap), step)]
    done, lo, left, widened = 0, 0, None, 0
    for g in range(0, len(spans), group):
        for (a, b), right in zip(spans[g : g + group], counter.many(text, spans[g : g + group]), strict=True):
            if left is None:
                left = right
                continue
            at, overlap = _common(left, right, lo), p.overlap
            while at is None:
                widened += 1
                overlap *= 2
                k = int(np.searchsorted(left[0], a + p.overlap - overlap, "right")) - 1
                if k <= lo:
                    done, lo, right = 0, 0, counter.tokens(text, 0, b)
                    break
                right = counter.tokens(text, int(left[0][k]), b)
                at = _common(left, right, lo)
            if at is not None:
                done, lo = done + at[0] - lo, at[1]
            left = right
    return done + len(left[0]) - lo, widened


_COUNTERS: dict[str, PieceCounter] = {}


def counter_of(path: str) -> PieceCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _column(counter: PieceCounter, texts: pa.Array, p: CountParams) -> np.ndarray:
    """Token counts of a text column; short texts go to the model together, a bounded number of characters at a time."""
    out = np.zeros(len(texts), np.int64)
    rows, waiting, chars = [], [], 0

    def send():
        nonlocal chars
        out[rows] = counter.lengths(waiting)
        rows.clear()
        waiting.clear()
        chars = 0

    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if len(text) > p.chunk:
            out[i] = count_long(counter, text, p)[0]
            continue
        rows.append(i)
        waiting.append(text)
        chars += len(text)
        if chars >= p.batch_chars:
            send()
    if rows:
        send()
    return out


def count_tokens(docs: DataFrame, params: CountParams, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens.  Rows are counted one by one, so repeated rows and ids and null
    ids each give a row; other columns are ignored; an empty table gives no rows.  Strings that look like special
    tokens are ordinary text.  Nothing is shuffled, and besides its text a row needs memory for a few chunks only.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches):
        counter = counter_of(params.path)
        for batch in batches:
            texts = batch.column(1)
            n = _column(counter, texts, params)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > params.limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)
