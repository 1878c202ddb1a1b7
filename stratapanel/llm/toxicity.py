"""Toxicity scores from a lexicon matched by Levenshtein automata, read in its context.

The lexicon holds words and stems (beginnings of words) with a weight each, learnt from labelled
texts.  Its trie is intersected with Levenshtein automata: a state is the set of trie nodes that can be
reached with each number of edits, and the sets are made deterministic once, so every word
of a text costs one table look-up for each letter.  Words match exactly or within one edit, stems exactly.

A match counts by its context window: inside quotation marks or next to words that report speech it is
read as quotation, next to words that address a reader as abuse.  A logistic model over these sums
gives the score.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import PIECE_BYTES

#: Words that address somebody, and words that report or name an expression.
ADDRESS = ("you", "your", "yours", "youre", "u", "ur", "du", "dein", "deine", "ihr", "tu", "toi", "vous", "eres", "usted")
REPORT = ("said", "says", "wrote", "called", "quote", "quoted", "quotes", "word", "term", "slur", "insult", "sagte", "schrieb", "dit", "dijo")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityParams:
    """``labelled`` bounds the texts that the model is fitted to, ``entries`` the lexicon."""

    labelled: int = 16_000
    entries: int = 400
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    least_texts: int = 4
    least_z: float = 3.5
    least_log_odds: float = 1.2
    edit_length: int = 5  # shorter words must match exactly
    window: int = 6
    longest: int = 32
    prior_strength: float = 1.0


@dataclass
class Lexicon:
    """Entries are lower-case words; a stem ends in ``*``."""

    weights: dict[str, float]
    edit_length: int = 5
    classes: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        letters = sorted({c for e in self.weights for c in e.rstrip("*")})
        self.classes = {c: k + 1 for k, c in enumerate(letters)}  # 0: any other letter
        self._trie()
        self._automaton()

    def _trie(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth: list[int] = [0]
        for entry, weight in self.weights.items():
            node = 0
            for c in entry.rstrip("*"):
                k = self.classes[c]
                if k not in self.children[node]:
                    self.children[node][k] = len(self.children)
                    self.children.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][k]
            kind = self.stem if entry.endswith("*") else self.word
            kind[node] = max(kind[node], weight)

    def _closed(self, exact: int | None, edited: set[int]) -> tuple:
        """State: the node reached without an edit and the nodes reached with one; letters may be left out of the entry."""
        if exact is not None:
            edited = edited | set(self.children[exact].values())
        return exact, frozenset(edited)

    def _automaton(self) -> None:
        start = self._closed(0, set())
        number = {(None, frozenset()): 0, start: 1}
        todo, rows = [start], {0: {}}
        others: dict[int, int] = {0: 0}

        def index(state: tuple) -> int:
            if state not in number:
                number[state] = len(number)
                todo.append(state)
            return number[state]

        while todo:
            state = todo.pop()
            exact, edited = state
            inserted = set() if exact is None else {exact}
            replaced = set() if exact is None else set(self.children[exact].values())
            here = number[state]
            others[here] = index(self._closed(None, inserted | replaced))
            letters = set() if exact is None else set(self.children[exact])
            for n in edited:
                letters |= set(self.children[n])
            rows[here] = {}
            for c in letters:
                onward = {self.children[n][c] for n in edited if c in self.children[n]}
                step = None if exact is None else self.children[exact].get(c)
                rows[here][c] = index(self._closed(step, onward | inserted | replaced))
        n = len(number)
        self.next = np.zeros((n, len(self.classes) + 1), np.int32)
        self.exact_weight, self.edit_weight, self.stem_weight = (np.zeros(n, np.float64) for _ in range(3))
        for (exact, edited), k in number.items():
            self.next[k, :] = others.get(k, 0)
            for c, to in rows.get(k, {}).items():
                self.next[k, c] = to
            if exact is not None:
                self.exact_weight[k], self.stem_weight[k] = self.word[exact], self.stem[exact]
            long = [self.word[x] for x in edited if self.depth[x] >= self.edit_length]
            self.edit_weight[k] = max(long, default=0.0)

    def match(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the exact or stem match and of the edited match of every word."""
        direct, edited = np.zeros(len(starts)), np.zeros(len(starts))
        alive, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        for step in range(longest + 2):
            ended = lengths[alive] == step
            if ended.any():
                at, s = alive[ended], state[ended]
                direct[at] = np.maximum(direct[at], self.exact_weight[s])
                edited[at] = self.edit_weight[s]
                alive, state = alive[~ended], state[~ended]
            if not len(alive):
                break
            state = self.next[state, classes[starts[alive] + step]]
            on = state > 0
            alive, state = alive[on], state[on]
            found = self.stem_weight[state]
            hit = found > 0
            direct[alive[hit]] = np.maximum(direct[alive[hit]], found[hit])
        return direct, np.where(direct > 0, 0.0, edited)


@functools.cache
def _letters() -> np.ndarray:
    """Marks the code points that are letters or digits; those beyond the table are."""
    return np.array([chr(c).isalnum() for c in range(1 << 16)])


#: Sums that the logistic model reads.
FEATURES = 9


class Reader:
    """Turns texts into features."""

    def __init__(self, lexicon: Lexicon, params: ToxicityParams):
        self.lexicon, self.params = lexicon, params
        self.table = np.zeros(1 << 16, np.int32)
        for c, k in lexicon.classes.items():
            if ord(c) < 1 << 16:
                self.table[ord(c)] = k
        self.cues = {w: 1 for w in ADDRESS} | {w: -1 for w in REPORT}

    def features(self, texts: list[str]) -> np.ndarray:
        joined = [(t or "").lower() for t in texts]
        size = np.array([len(t) for t in joined])
        # One separator after each text keeps words apart.
        codes = np.frombuffer("\n".join([*joined, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(np.append(0, size[:-1] + 1)) if len(size) else np.zeros(0, np.int64)
        low = np.minimum(codes, (1 << 16) - 1)
        inside = np.where(codes < 1 << 16, _letters()[low], True)
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = ends - starts
        owner = np.searchsorted(first, starts, "right") - 1
        direct, edited = self.lexicon.match(self.table[low], starts, lengths, self.params.longest)
        out = np.zeros((len(texts), FEATURES))
        words = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.flatnonzero((direct > 0) | (edited > 0))
        if len(hits):
            quoted = self._quoted(codes, first, starts[hits], owner[hits])
            context = self._context(codes, starts, ends, owner, hits)
            who = owner[hits]
            d, e = direct[hits], edited[hits]
            add = lambda values: np.bincount(who, values, len(texts))
            plain = ~quoted & (context >= 0)
            out[:, 0] = np.log1p(add(d * plain))
            out[:, 1] = np.log1p(add(e * plain))
            out[:, 2] = np.log1p(add(d * ~plain))
            out[:, 3] = np.log1p(add(d * plain * np.maximum(context, 0)))
            out[:, 4] = np.log1p(100.0 * add(d * plain) / np.maximum(words, 20.0))
            np.maximum.at(out[:, 5], who, d * plain)
            out[:, 6] = np.log1p(add(((d > 0) & plain).astype(float)))
            out[:, 7] = np.log1p(100.0 * add(((d > 0) & plain).astype(float)) / np.maximum(words, 20.0))
        out[:, 8] = np.log1p(words)
        return out

    @staticmethod
    def _quoted(codes: np.ndarray, first: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether an odd number of straight, or more opening than closing, marks stand before a place in its text."""
        straight = np.concatenate([[0], np.cumsum(codes == 34)])
        opened = np.concatenate([[0], np.cumsum(np.isin(codes, (0x201C, 0x201E, 0xAB)).astype(int) - np.isin(codes, (0x201D, 0xBB)))])
        since = lambda sums: sums[at] - sums[first[owner]]
        return (since(straight) % 2 == 1) | (since(opened) > 0)

    def _context(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """+1 if a window holds more address than report, -1 the other way round."""
        out, w, text = np.zeros(len(hits)), self.params.window, codes
        for k, h in enumerate(hits.tolist()):
            lo, hi = max(0, h - w), min(len(starts), h + w + 1)
            total = 0
            for i in range(lo, hi):
                if owner[i] == owner[h] and ends[i] - starts[i] <= 8:
                    total += self.cues.get("".join(map(chr, text[starts[i] : ends[i]])), 0)
            out[k] = np.sign(total)
        return out


def _text_pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of whole texts of a bounded size."""
    i, size, held = 0, 0, []
    for k, text in enumerate(column.to_pylist()):
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE_BYTES:
            yield i, k + 1, held
            i, size, held = k + 1, 0, []
    if held:
        yield i, len(column), held


def _sample(docs: DataFrame, labels: DataFrame, learn, params: ToxicityParams, id_column: str, text_column: str) -> DataFrame:
    """(text, toxic) of at most about ``labelled`` labelled texts, chosen by a hash of the id."""
    known = labels.where(learn & F.col("toxic").isNotNull()).groupBy(id_column).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64(F.lit(17), F.col(id_column)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, params.labelled / max(1, n)))))
    return docs.select(id_column, text_column).join(F.broadcast(picked), id_column).select(F.col(text_column).alias("text"), "toxic")


def learn_lexicon(sample: DataFrame, params: ToxicityParams) -> dict[str, float]:
    """Words and stems that mark toxic texts, by the log odds of holding them."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in _WORD.findall((text or "").lower()) if len(w) <= params.longest}
                stems = {w[:k] + "*" for w in words for k in params.stem_lengths if len(w) > k}
                counts.update((x, toxic) for x in words | stems)
                counts[("", toxic)] += 1
            if len(counts) > 1_000_000:
                yield emitted(counts)
                counts = Counter()
        if counts:
            yield emitted(counts)

    def emitted(counts):
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys]), pa.array([counts[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else counts[k] for k in keys], pa.int64())],
            names=["entry", "a", "b"],
        )

    counted = sample.mapInArrow(run, "entry string, a bigint, b bigint").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranked = counted.where(f"a >= {params.least_texts} or entry = ''").orderBy((F.col("entry") != "").asc(), (F.col("a") / (F.col("a") + F.col("b"))).desc(), F.desc("a"))
    rows = ranked.limit(50 * params.entries + 1).collect()  # bounded; marked entries come first
    if not rows or rows[0]["entry"] != "":
        return {}
    n1, n0, found = rows[0]["a"], rows[0]["b"], []
    for entry, a, b in rows[1:]:
        odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
        if z >= params.least_z and odds >= params.least_log_odds:
            found.append((z, entry, odds))
    found.sort(reverse=True)
    return {entry: odds for _, entry, odds in found[: params.entries]}


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    """Weights (intercept last) of a logistic model with a normal prior, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.diag([strength] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(
    docs: DataFrame, labels: DataFrame, learn, params: ToxicityParams | None = None, id_column: str = "doc_id", text_column: str = "text", lexicon: dict[str, float] | None = None
) -> DataFrame:
    """Per row: id and score (0 to 1), the probability of the label ``toxic``.

    ``learn`` is a condition on ``labels`` (id, toxic) that picks the rows to learn from; ids with several labels are toxic
    if one is.  ``lexicon`` (entry to weight) is learnt as well unless given.  Null texts are empty: they have the base
    rate.  Without labels the score is 0.5 for a text without matches.  Repeated rows are scored row by row, null ids kept.
    Only the text enters a score.
    """
    params = params or ToxicityParams()
    sample = _sample(docs, labels, learn, params, id_column, text_column)
    words = learn_lexicon(sample, params) if lexicon is None else dict(lexicon)
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Lexicon(words, params.edit_length))

    def measure(batches):
        reader = Reader(automaton.value, params)
        for batch in batches:
            for i, j, texts in _text_pieces(batch.column(0)):
                x = reader.features(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1)[i:j]], names=["x", "toxic"])

    fitted = sample.mapInArrow(measure, "x array<double>, toxic int").toPandas()  # bounded by ``labelled``
    w = np.zeros(FEATURES + 1)
    if len(fitted):
        w = fit_logistic(np.array(fitted["x"].tolist()), fitted["toxic"].to_numpy(float), params.prior_strength)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        reader = Reader(automaton.value, params)
        for batch in batches:
            for i, j, texts in _text_pieces(batch.column(1)):
                p = 1 / (1 + np.exp(-np.clip(reader.features(texts) @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(p)], names=[id_column, "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double")
