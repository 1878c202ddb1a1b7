"""Document likelihood under a word model that backs off to a subword lattice.

Tokens are lower-cased words and one end per text.  With c(t) the count of a token among the
training texts, N all of them and V distinct ones, the model's word probability is

    P(t) = (c(t) + (V + 1) b(t)) / (N + V + 1)

b(end) is 1 / (V + 2); for a word, b is (V + 1) / (V + 2) times its lattice likelihood: the sum
over all segmentations of the word into vocabulary pieces, closed by an end-of-word piece, found by
a log-space forward recursion.  Words do not share pieces, so a text's segmentations are those of its words.  All these sum
to one over all words, known or not.

The pieces are those of an existing vocabulary and the single bytes.  Their probabilities start
from the vocabulary's scores (its ranks, by Zipf's law) and are fitted to the distinct training words by
expectation maximisation: the posterior of every arc, from a forward and a backward pass.

A text belongs to one of a few classes z (its language, say), whose word probabilities shrink to P:

    q(t | z) = (c(t, z) + V(z) P(t)) / (N(z) + V(z))

Inside a text words repeat: the token at place k + 1, seen n times before in the text, has probability
(s q(t | z) + n) / (s + k) (a Polya urn).  The marginal likelihood of the text sums over its classes as well.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import U64, PrefixHash, pieces
from stratapanel.runtime import materialize

#: Longest piece in bytes; words longer than LONG are walked alone.
MAX_PIECE, LONG = 16, 256
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000


@dataclass(frozen=True)
class LatticeParams:
    """``path``: vocabulary file.  ``frequent``: bound of the word table sent to every task; other words are joined.

    ``classes`` bounds the values of the class column that count, the most frequent ones; ``urn`` is the strength s."""

    path: str
    rounds: int = 2
    frequent: int = 1 << 17
    frequent_bytes: int = 64
    classes: int = 8
    urn: float = 3000.0


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a vocabulary in lower case, without word marks, and their first probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-5 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", "").encode().lower()
        if 0 < len(piece) <= MAX_PIECE:
            weight[piece] = weight.get(piece, 0.0) + 1.0 / (50.0 - model.get_score(i))
    total = sum(weight.values())
    return list(weight), np.array([v / total for v in weight.values()])


class Lattice:
    """Forward and backward recursions over the piece lattices of many words at once."""

    def __init__(self, names: list[bytes], probability: np.ndarray, stop: float):
        self.log_p = np.log(np.maximum(probability, 1e-300)) + math.log1p(-stop)
        self.log_stop = math.log(stop)
        data = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(n) for n in names])
        starts = ends - np.array([len(n) for n in names])
        h = PrefixHash(data).spans(starts, ends)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.maybe = np.zeros(1 << 20, bool)  # small filter in front of the search
        self.maybe[h >> U64(44)] = True
        self.size = len(names)

    def arcs(self, data: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Piece (or -1) of every length at every byte; ``room``: bytes left in the word."""
        out = np.full((MAX_PIECE, len(data)), -1, np.int32)
        prefix = PrefixHash(data)
        for k in range(1, min(MAX_PIECE, int(room.max(initial=0))) + 1):
            at = np.flatnonzero(room >= k)
            h = prefix.spans(at, at + k)
            near = self.maybe[h >> U64(44)]
            at, h = at[near], h[near]
            found = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
            good = self.sorted[found] == h
            out[k - 1, at[good]] = self.order[found[good]]
        return out

    def _groups(self, lengths: np.ndarray):
        """Words that are walked together: rising length, bounded bytes."""
        order = np.argsort(lengths, kind="stable")
        first = 0
        while first < len(order):
            longest = lengths[order[min(first + 4095, len(order) - 1)]]
            n = 1 if longest > LONG and lengths[order[first]] > LONG else 4096
            yield order[first : first + n]
            first += n

    def run(self, words: list[bytes], expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word; adds the arcs' posteriors to ``expected``."""
        out = np.full(len(words), -np.inf)
        for group in self._groups(np.array([len(w) for w in words], np.int64)):
            own = [words[i] for i in group.tolist()]
            lengths = np.array([len(w) for w in own], np.int64)
            data = np.frombuffer(b"".join(own), np.uint8)
            start = np.cumsum(lengths) - lengths
            room = np.repeat(start + lengths, lengths) - np.arange(len(data))
            arcs = self.arcs(data, room)
            scores = np.where(arcs >= 0, self.log_p[arcs], -np.inf)
            if len(own) == 1:
                out[group] = self._alone(arcs, scores, int(lengths[0]), expected)
            else:
                out[group] = self._together(arcs, scores, start, lengths, expected)
        return out

    def _together(self, arcs, scores, start, lengths, expected):
        longest = int(lengths.max(initial=0))
        alpha = np.full((longest + 1, len(lengths)), -np.inf)
        alpha[0] = 0.0
        for j in range(1, longest + 1):
            on = int(np.searchsorted(lengths, j))  # lengths rise
            total = np.full(len(lengths) - on, -np.inf)
            for k in range(1, min(MAX_PIECE, j) + 1):
                np.logaddexp(total, alpha[j - k, on:] + scores[k - 1, start[on:] + j - k], out=total)
            alpha[j, on:] = total
        end = alpha[lengths, np.arange(len(lengths))]
        if expected is not None:
            beta = np.full((longest + 1, len(lengths)), -np.inf)
            beta[lengths, np.arange(len(lengths))] = 0.0
            for i in range(longest - 1, -1, -1):
                on = int(np.searchsorted(lengths, i + 1))
                total = beta[i, on:].copy()
                for k in range(1, min(MAX_PIECE, longest - i) + 1):
                    fits = lengths[on:] >= i + k
                    where = np.flatnonzero(fits) + on
                    arc = start[where] + i
                    step = scores[k - 1, arc] + beta[i + k, where]
                    total[where - on] = np.logaddexp(total[where - on], step)
                    share = np.exp(alpha[i, where] + step - end[where])
                    used = share > 0
                    np.add.at(expected, arcs[k - 1, arc[used]], share[used])
                beta[i, on:] = total
        return end + self.log_stop

    def _alone(self, arcs, scores, n, expected):
        """One word of any length; the recursion runs over plain lists."""
        steps = scores.T.tolist()
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0

        def add(x, y):
            if x < y:
                x, y = y, x
            return x + math.log1p(math.exp(y - x)) if y > -math.inf else x

        for i in range(n):
            here = alpha[i]
            for k, s in enumerate(steps[i][: n - i], 1):
                if s > -math.inf:
                    alpha[i + k] = add(alpha[i + k], here + s)
        if expected is not None:
            beta = [-math.inf] * n + [0.0]
            for i in range(n - 1, -1, -1):
                for k, s in enumerate(steps[i][: n - i], 1):
                    if s > -math.inf:
                        beta[i] = add(beta[i], s + beta[i + k])
                        expected[arcs[k - 1, i]] += math.exp(alpha[i] + s + beta[i + k] - alpha[n])
        return alpha[n] + self.log_stop


def word_counts(texts: DataFrame, classes: int) -> DataFrame:
    """(word, c, by_class) from (class, text): counts of the words and, under the empty word, of the ends."""

    def run(batches):
        held: list[Counter] = [Counter() for _ in range(classes)]
        for batch in batches:
            which = batch.column(0).to_pylist()
            for i, j, _, _ in pieces(batch.column(1)):
                for k, text in zip(which[i:j], batch.column(1)[i:j].to_pylist(), strict=True):
                    held[k].update((text or b"").lower().split())
                    held[k][b""] += 1
                if sum(map(len, held)) > HELD_WORDS:
                    yield from counted(held)
                    held = [Counter() for _ in range(classes)]
        yield from counted(held)

    def counted(held):
        for k, own in enumerate(held):
            if own:
                columns = [pa.array(list(own), pa.binary()), pa.array(np.full(len(own), k, np.int32)), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "class", "c"])

    rows = texts.mapInArrow(run, "word binary, class int, c bigint")
    each = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    summed = rows.groupBy("word").agg(F.sum("c").alias("c"), *each)
    return summed.select("word", "c", F.array(*(F.col(f"c{k}") for k in range(classes))).alias("by_class"))


def fit(words: DataFrame, params: LatticeParams) -> tuple[np.ndarray, float]:
    """Piece probabilities and the end-of-word probability, from the distinct training words."""
    names, probability = vocabulary(params.path)
    first, stop = probability, 0.3
    for _ in range(params.rounds):
        known = words.sparkSession.sparkContext.broadcast((probability, stop))

        def run(batches, known=known, path=params.path):
            lattice = Lattice(vocabulary(path)[0], *known.value)
            expected, n = np.zeros(lattice.size), 0
            for batch in batches:
                own = [w for w in batch.column(0).to_pylist() if w]
                lattice.run(own, expected)
                n += len(own)
            some = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(expected[some], float(n)))], names=["piece", "n"]
            )

        # One row for each piece at most.
        rows = words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        found = np.zeros(len(names))
        ends = 0.0
        for piece, n in rows:
            if piece < 0:
                ends = n
            else:
                found[piece] = n
        total = found.sum()
        probability = (found + 20.0 * first * len(names) / 1000.0) / (total + 20.0 * len(names) / 1000.0)
        stop = (ends + 3.0) / (ends + total + 10.0)
    return probability, stop


def score(
    docs: DataFrame, training, params: LatticeParams, id_column: str = "doc_id", text_column: str = "text", class_column: str | None = None
) -> DataFrame:
    """Likelihood of every text; ``training`` is a condition that picks the texts to learn from.

    Returns id, training (boolean), n_tokens, n_known, train_tokens, base_score (add-one word model) and
    score, both log10.  ``class_column`` names what the training texts are grouped by; it is not read from the texts that are
    scored.  Null texts are empty: one end.  A null condition counts as false, a null or rare class as one more class.  Repeated
    rows and ids are scored row by row.  Without training texts words are scored by the lattice alone.  An empty table gives an
    empty result.  Only the named columns are read.
    """
    spark = docs.sparkSession
    learn = F.coalesce(training, F.lit(False))
    group = F.lit("") if class_column is None else F.coalesce(F.col(class_column).cast("string"), F.lit(""))
    sizes = docs.where(learn).groupBy(group.alias("class")).count().orderBy(F.desc("count"), "class").limit(params.classes).collect()
    names = [r["class"] for r in sizes]
    number = F.coalesce(F.array_position(F.lit(names), group) - 1, F.lit(0)) if names else F.lit(0)
    number = F.when(number < 0, F.lit(len(names))).otherwise(number).cast("int")
    z = len(names) + 1
    texts = docs.where(learn).select(number.alias("class"), F.col(text_column).cast("binary").alias("text"))
    words = materialize(word_counts(texts, z))
    at = lambda k: F.element_at("by_class", k + 1)
    sums = [F.coalesce(F.sum(at(k)), F.lit(0)) for k in range(z)] + [F.count_if(at(k) > 0) for k in range(z)]
    ends = [F.coalesce(F.sum(F.when(F.length("word") == 0, at(k))), F.lit(0)) for k in range(z)]
    found = [int(x) for x in words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *sums, *ends).first()]
    train_tokens, distinct = found[:2]
    counts = _Counts(train_tokens, distinct, *(np.array(found[2 + k * z : 2 + (k + 1) * z], float) for k in range(3)))
    probability, stop = fit(words, params)
    model = spark.sparkContext.broadcast((probability, stop, _frequent(words, params), counts))
    path, urn = params.path, params.urn
    kind = docs.schema[id_column].dataType.simpleString()
    sum_names = [f"s{k}" for k in range(z)]
    value_names = ["row", "id", "learned", "n_tokens", "n_known", "base", *sum_names]

    def scan(batches):
        own_probability, own_stop, (keys, c, by_class), sizes = model.value
        scorer = _Scorer(Lattice(vocabulary(path)[0], own_probability, own_stop), sizes)
        q, log_c, index = scorer.shares(keys, c, by_class), np.log10(c + 1.0), {w: k for k, w in enumerate(keys)}
        for batch in batches:
            for i, j, _, _ in pieces(batch.column(3)):
                part = batch.slice(i, j - i)
                rows = part.column(0).to_numpy()
                known, of_known, doc_known, rare, of_rare, doc_rare, tokens = [], [], [], [], [], [], []
                for d, text in enumerate(part.column(3).to_pylist()):
                    own = (text or b"").lower().split()
                    tokens.append(len(own) + 1)
                    counted = Counter(own)
                    counted[b""] = 1
                    for w, n in counted.items():
                        k = index.get(w)
                        if k is None:
                            rare.append(w)
                            of_rare.append(n)
                            doc_rare.append(d)
                        else:
                            known.append(k)
                            of_known.append(n)
                            doc_known.append(d)
                n, doc = np.array(of_known, np.int64), np.array(doc_known, np.int64)
                gained = log_rising(urn * q[known], n) if known else np.zeros((0, z))
                add = lambda v: np.bincount(doc, v, len(part))  # noqa: B023, E731
                # A row's own line has a key that no word has, as words hold no blank.
                keys_of = [b" %d" % r for r in rows.tolist()]
                here = lambda a, t: pa.concat_arrays([a, pa.nulls(len(rare), t)])  # noqa: B023, E731
                zero = lambda v, kind: pa.array(np.concatenate([v, np.zeros(len(rare))]).astype(kind))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[np.array(doc_rare, np.int64)]])), here(part.column(1), part.schema.field(1).type), here(part.column(2), pa.bool_()),
                        zero(tokens, np.int64), zero(add(n), np.int64), zero(add(n * log_c[known]), float), *(zero(add(gained[:, k]), float) for k in range(z)),
                        pa.array([*keys_of, *rare], pa.binary()), pa.array(np.concatenate([np.zeros(len(rows)), of_rare]).astype(np.int64)),
                    ],
                    names=[*value_names, "word", "n"],
                )

    def rest(batches):
        own_probability, own_stop, _, sizes = model.value
        scorer = _Scorer(Lattice(vocabulary(path)[0], own_probability, own_stop), sizes)
        for batch in batches:
            n = batch.column("n").to_numpy()
            ask = np.flatnonzero(n > 0)
            base, known = (batch.column(c).to_numpy().copy() for c in ("base", "n_known"))
            gained = np.stack([batch.column(c).to_numpy() for c in sum_names], axis=1)
            if len(ask):
                encoded = batch.column("word").take(pa.array(ask)).dictionary_encode()
                which = encoded.indices.to_numpy()
                c = batch.column("c").fill_null(0).to_numpy()[ask]
                lists = batch.column("by_class").to_pylist()
                per_class = np.array([lists[k] or [0] * z for k in ask.tolist()], float)
                of_word, of_class = np.zeros(len(encoded.dictionary)), np.zeros((len(encoded.dictionary), z))
                of_word[which], of_class[which] = c, per_class
                q = scorer.shares(encoded.dictionary.to_pylist(), of_word, of_class)
                base[ask] = n[ask] * np.log10(c + 1.0)
                gained[ask] = log_rising(urn * q[which], n[ask])
                known[ask] = np.where(c > 0, n[ask], 0)
            columns = [batch.column(c) for c in ("row", "id", "learned", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(known), pa.array(base), *(pa.array(gained[:, k]) for k in range(z))], names=value_names)

    values = f"row bigint, id {kind}, learned boolean, n_tokens bigint, n_known bigint, base double, " + ", ".join(f"{c} double" for c in sum_names)
    lines = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), learn.alias("learned"), F.col(text_column).cast("binary").alias("text")
    ).mapInArrow(scan, f"{values}, word binary, n bigint")
    joined = lines.join(words, "word", "left").select(*value_names, "word", "n", "c", "by_class")
    totals = joined.mapInArrow(rest, values).groupBy("row").agg(
        F.max("id").alias(id_column), F.max("learned").alias("training"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", *sum_names))
    )
    unit = math.log10(train_tokens + distinct + 1)
    prior = (counts.ends + 1) / (counts.ends.sum() + z)
    part = F.array(*(F.col(c) + float(np.log(p)) for c, p in zip(sum_names, prior, strict=True)))
    top = F.array_max(part)
    mixed = top + F.log(F.aggregate(part, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    # The urn's denominator: the product of s, s + 1 ... s + n_tokens - 1, by Stirling's series.
    stirling = lambda x: (x - 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x)
    drawn = stirling(F.col("n_tokens") + F.lit(urn)) - stirling(F.lit(urn))
    return totals.select(
        id_column, "training", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), ((mixed - drawn) / math.log(10)).alias("score"),
    )


def log_rising(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of a (a + 1) ... (a + n - 1) for each row of ``a``."""
    out = np.log(a)
    for i in range(1, min(64, int(n.max(initial=1)))):
        on = np.flatnonzero(n > i)
        out[on] += np.log(a[on] + i)
    on = np.flatnonzero(n > 64)
    if len(on):
        stirling = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3)
        out[on] += stirling(a[on] + n[on, None]) - stirling(a[on] + 64)
    return out


@dataclass(frozen=True)
class _Counts:
    """Training tokens and distinct ones, in all and by class, and texts by class."""

    tokens: int
    distinct: int
    by_class: np.ndarray
    distinct_by_class: np.ndarray
    ends: np.ndarray


class _Scorer:
    def __init__(self, lattice: Lattice, counts: _Counts):
        self.lattice, self.counts = lattice, counts

    def shares(self, words: list[bytes], c: np.ndarray, by_class: np.ndarray) -> np.ndarray:
        """q(word | class) of words (the empty one is the end) with their training counts; at least 1e-300."""
        v, n = float(self.counts.distinct), float(self.counts.tokens)
        back, size = np.zeros(len(words)), 1 << 14
        for i in range(0, len(words), size):
            own = words[i : i + size]
            p = np.exp(self.lattice.run(own)) * (v + 1) / (v + 2)
            p[[k for k, w in enumerate(own) if not w]] = 1.0 / (v + 2)
            back[i : i + size] = p
        whole = (c + (v + 1) * back) / (n + v + 1)
        strength = np.maximum(self.counts.distinct_by_class, 1.0)
        return np.maximum((by_class + strength * whole[:, None]) / (self.counts.by_class + strength), 1e-300)


def _frequent(words: DataFrame, params: LatticeParams) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The most frequent words with their counts, ``frequent`` at most: those above a count that a histogram gives."""
    short = words.where(F.length("word") <= params.frequent_bytes)
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    rows = short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred levels
    total, lowest = 0, None
    for at, n in rows:
        total += n
        if total > params.frequent:
            break
        lowest = at
    classes = words.select(F.max(F.size("by_class"))).first()[0] or 1
    if lowest is None:
        return [], np.zeros(0), np.zeros((0, classes))
    kept = short.where(level >= lowest).toArrow()
    flat = kept["by_class"].combine_chunks().flatten().to_numpy().astype(float)
    return kept["word"].to_pylist(), kept["c"].to_numpy().astype(float), flat.reshape(len(kept), classes)
