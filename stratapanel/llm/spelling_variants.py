"""Spelling variants: words one edit apart, found by dense tiles of prefix and suffix lengths.

Two words are one insertion, deletion or replacement apart if and only if their common prefix and common suffix together
reach the longer length minus one.  Words become rows of code points, padded to one width, and tiles of such rows are
compared row by row with each other: running equality from the left gives all prefix lengths, from the right all suffix lengths.

Only words that can be near meet in a tile.  For a pair whose longer word has l code points, let c be the common prefix and
p1 < p2 two fixed places.  If c < p1, the last l - p1 code points agree; if p1 <= c < p2, the first p1 and the last l - p2; else the
first p2.  So each word has three keys for l = its length and three for l = its length + 1, and a pair is looked at where its own c
puts it: every near pair is seen once.  Blocks with more words than ``block`` are cut into parts, and each pair of parts
is a unit of its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import buffer_of, lower_table, pieces
from stratapanel.runtime import materialize


@dataclass(frozen=True)
class VariantParams:
    """Least code points and occurrences of a word, and how much more frequent its form must be.

    ``block`` and ``tile`` bound the words of a unit and of a tile, ``pending`` the counts a task holds before it passes them on.
    """

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    block: int = 2048
    tile: int = 96
    pending: int = 400_000


#: ASCII letters; U+00C0 to U+00FF are exactly the two-byte sequences that begin with 0xC3.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # runs do not cross texts
    first[heads] = inside[heads]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def misspelt(doc_id, word: bytes) -> bytes:
    """The test edit: where 31 divides the CRC-32 of ``<doc_id>:<word>``, one code point goes."""
    h = zlib.crc32(b"%s:%s" % (str(doc_id).encode(), word))
    if h % 31:
        return word
    letters = word.decode()
    i = h % len(letters)
    return (letters[:i] + letters[i + 1 :]).encode()


def _distinct(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[head], np.diff(np.append(head, len(ranked)))


def _count_piece(totals: dict[bytes, int], ids: list, data: np.ndarray, offsets: np.ndarray, p: VariantParams, edit) -> None:
    """Adds the words of a few texts to ``totals``."""
    starts, ends, owner = letter_runs(data, offsets)
    if not len(starts):
        return
    data = lower_table()[data]
    size = ends - starts
    total = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.repeat(starts - total[:-1], size) + np.arange(total[-1])]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    points = [len(w) - w.count(0xC3) for w in words]
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if edit is None:
        kind, count = _distinct(code)
        for w, n in zip(kind.tolist(), count.tolist(), strict=True):
            if points[w] >= p.least_length:
                totals[words[w]] = totals.get(words[w], 0) + n
        return
    # An edit can only shorten a word, so shorter ones need no look.
    long = np.array(points)[code] >= p.least_length
    pair, count = _distinct(owner[long] * len(words) + code[long])
    for d, w, n in zip((pair // len(words)).tolist(), (pair % len(words)).tolist(), count.tolist(), strict=True):
        word = edit(ids[d], words[w])
        if word is not words[w] and len(word) - word.count(0xC3) < p.least_length:
            continue
        totals[word] = totals.get(word, 0) + n


def word_counts(docs: DataFrame, params: VariantParams = VariantParams(), *, edit=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) over all texts: words of ``least_length`` code points and ``least_count`` occurrences, A-Z lower-cased.

    ``edit(id, word)`` (UTF-8 bytes) may shorten a word before it is counted.  Tasks add up before the shuffle.
    """

    def run(batches):
        totals: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in pieces(batch.column(1)):
                _count_piece(totals, ids[i:j], data, offsets, params, edit)
                if len(totals) >= params.pending:
                    yield from _counts(totals)
                    totals.clear()
        yield from _counts(totals)

    found = docs.select(id_column, text_column).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least_count)


def _counts(totals: dict[bytes, int], rows: int = 20_000):
    words = pa.array(list(totals), pa.binary()).cast(pa.string())
    table = pa.RecordBatch.from_arrays([words, pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
    for i in range(0, len(table), rows):
        yield table.slice(i, rows)


def _blocks(words: DataFrame, p: VariantParams) -> DataFrame:
    """(l, unit, part, cross, zone, word, n): every word in each of its blocks, large blocks as pairs of parts."""
    m, l, word = F.length("word"), F.col("l"), F.col("word")  # noqa: E741
    p1, p2 = (l / 3).cast("int"), (2 * l / 3).cast("int")
    wide = words.select("word", "n", F.explode(F.array(m, m + 1)).alias("l"))
    keys = F.array(
        F.struct(F.lit(0).alias("zone"), word.substr(m - l + p1 + 1, l - p1).alias("k")),
        F.struct(F.lit(1).alias("zone"), F.concat(word.substr(F.lit(1), p1), F.lit(" "), word.substr(m - l + p2 + 1, l - p2)).alias("k")),
        F.struct(F.lit(2).alias("zone"), word.substr(F.lit(1), p2).alias("k")))
    keyed = wide.select("word", "n", "l", F.explode(keys).alias("z"))
    keyed = keyed.select("word", "n", "l", "z.zone", F.xxhash64("l", "z.zone", "z.k").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / p.block).cast("int")
    placed = keyed.join(sizes, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    unit = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    return placed.select("l", unit.alias("unit"), "part", (low != high).alias("cross"), "zone", "word", "n")


_NEAR = "word string, near bigint, best_n bigint, best string"


class _Rows:
    """Rows of complete units, in order of l and unit."""

    def __init__(self, table: pa.Table):
        number = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        self.l, self.unit, self.part, self.cross, self.zone, self.n = (number(c) for c in ("l", "unit", "part", "cross", "zone", "n"))
        self.words = table.column("word").combine_chunks()


def _codes(words: pa.Array, width: int, right: bool, pad: int) -> np.ndarray:
    """Code points (all below 256) of words, one column each place, aligned left or right."""
    data, offsets = buffer_of(words)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    # 0xC3 and the byte b behind it are the code point b + 0x40.
    lead = data == 0xC3
    points = data.copy()
    points[1:][lead[:-1]] += 0x40
    before = np.concatenate([[0], np.cumsum(~lead)])
    bounds = before[offsets]
    points = points[~lead]
    size = np.diff(bounds)
    out = np.full((len(words), width), pad, np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - np.repeat(bounds[:-1], size)
    out[row, place + (np.repeat(width - size, size) if right else 0)] = points
    return np.ascontiguousarray(out.T)


def _near_pairs(r: _Rows, p: VariantParams):
    """Index pairs (i < j) of near words, tile by tile."""
    n, a = len(r.unit), 0
    fresh = np.concatenate([[True], (r.unit[1:] != r.unit[:-1]) | (r.l[1:] != r.l[:-1])])
    heads = np.flatnonzero(fresh)
    upto = np.append(heads[1:], n)[np.cumsum(fresh) - 1]  # end of each row's unit
    while a < n:
        width = int(r.l[a])
        tile = max(4, min(p.tile, (1 << 22) // width))
        b = min(a + tile, int(np.searchsorted(r.l, width, "right")))
        left, size = _tile(r, a, b, width, 0), upto[a:b]
        for c in range(a, int(size[-1]), tile):
            yield from _compare(r, left, a, b, c, min(c + tile, int(size[-1])), width, upto)
        a = b


def _tile(r: _Rows, a: int, b: int, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    return _codes(r.words.slice(a, b - a), width, False, pad), _codes(r.words.slice(a, b - a), width, True, pad)


def _compare(r: _Rows, left, a: int, b: int, c: int, d: int, width: int, upto: np.ndarray):
    right = _tile(r, c, d, width, 1)  # another padding, so padding never agrees
    prefix = np.zeros((b - a, d - c), np.int32 if width > 120 else np.uint8)
    suffix = prefix.copy()
    for out, x, y, places in ((prefix, left[0], right[0], range(width)), (suffix, left[1], right[1], range(width - 1, -1, -1))):
        agree = np.ones(out.shape, bool)
        for k in places:
            agree &= x[k][:, None] == y[k][None, :]
            if not agree.any():
                break
            out += agree
    near = prefix + suffix >= width - 1
    near &= r.unit[a:b, None] == r.unit[None, c:d]
    i, j = np.nonzero(near)
    if not len(i):
        return
    first, i, j = prefix[i, j].astype(np.int64), i + a, j + c
    zone = (first >= width // 3).astype(np.int64) + (first >= 2 * width // 3)
    ok = (i < j) & (zone == r.zone[i]) & (~r.cross[i] | (r.part[i] != r.part[j]))
    # A pair of two shorter words belongs to the blocks of their own length.
    i, j = i[ok], j[ok]
    if len(i):
        yield i, j


def _best_of(r: _Rows, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    if not pairs:
        return None
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    here, there = np.concatenate([i, j]), np.concatenate([j, i])
    seen, place = np.unique(there, return_inverse=True)
    words = r.words.take(pa.array(seen))
    rank = np.empty(len(seen), np.int64)
    rank[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(seen))
    order = np.lexsort([rank[place], -r.n[there], here])
    here, there = here[order], there[order]
    head = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
    count = np.diff(np.append(head, len(here)))
    best = there[head]
    arrays = [r.words.take(pa.array(here[head])), pa.array(count), pa.array(r.n[best]), r.words.take(pa.array(best))]
    return pa.RecordBatch.from_arrays(arrays, names=["word", "near", "best_n", "best"])


def near_words(words: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """(word, n_near, best_n, best) for words with near ones; ``words`` has distinct words (letters up to U+00FF) and n."""
    units = _blocks(words, params).repartition("unit").sortWithinPartitions("l", "unit")

    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            unit = rest.column("unit").to_numpy()
            # The last unit may go on in the next batch.
            whole = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
            if whole:
                yield from done(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None:
            yield from done(rest)

    def done(table: pa.Table):
        rows = _Rows(table)
        out = _best_of(rows, list(_near_pairs(rows, params)))
        if out is not None:
            yield out

    found = units.mapInArrow(run, _NEAR)
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("t")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top).select("word", "n_near", (-F.col("t.m")).alias("best_n"), "t.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached by following (word, form).

    Each step makes n at least ``ratio`` times larger, so chains are a few dozen steps at most and doubling ends soon.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = links.where("moved").limit(1).count()
        links = links.select("word", "root")
        if not moved:
            return links


def spelling_variants(docs: DataFrame, params: VariantParams = VariantParams(), *, edit=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per word: form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that is at least ``ratio`` times the word's
    own n; ``root`` follows forms to the last and is the word itself without a form; ``n_near`` counts near words.  Null and empty
    texts have no words; repeated rows and ids count each time; a null id is edited under the name ``None``, if at all; other columns are
    ignored; an empty table gives no rows.  Words may be of any length: longer ones are compared in smaller tiles.
    """
    if params.ratio < 2:
        raise ValueError("forms must be more frequent, or chains could turn in circles")
    words = materialize(word_counts(docs, params, edit=edit, id_column=id_column, text_column=text_column))
    judged = words.join(near_words(words, params), "word", "left")
    is_form = F.col("best_n") >= params.ratio * F.col("n")
    judged = materialize(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = _roots(judged.where(F.col("form").isNotNull()).select("word", "form"))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
