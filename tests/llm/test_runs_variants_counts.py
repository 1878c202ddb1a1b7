"""Periodic runs, spelling variants and token counts against plain Python, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import periodic_runs, spelling_variants, token_counts
from stratapanel.llm.queries import QUERIES, vocabulary_path

LONG = "Some words that go on and on. " * 8000
ODD = [(1, "one two " * 20), (1, "one two " * 20), (2, None), (3, ""), (4, LONG), (5, "x" * 70_000), (None, "a b " * 30), (None, None), (6, "\n\n \t"), (7, "one"), (8, "ünïcôde ünïcôde ünïcode " * 3)]
CLASH = ["n", "word", "key", "start", "runs", "n_bytes", "unit", "l", "size", "form", "part"]
MODEL = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(sf):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).withColumns({c: F.lit("clash") for c in CLASH})


# Periodic runs


def all_runs(words, least=24, times=3):
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def edited_words(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_row(doc_id, text):
    words = edited_words(doc_id, text)
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest(listed), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def key(row):
    return tuple(map(str, row))


def test_run_query(spark, sf, texts):
    got = sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()), key=key)
    assert got == sorted((run_row(d, t) for d, t in texts.items()), key=key) and sum(r[1] for r in got) > 10


def test_runs_of_small_alphabets(spark):
    random.seed(3)
    rows = []
    for i in range(400):
        letters = random.sample(["a", "b", "c", "é", "a-rather-long-word"], random.randint(1, 4))
        unit, words = random.choices(letters, k=random.randint(0, 12)), []
        while len(words) < random.randint(0, 150):
            words += random.choice([unit, unit, random.choices(letters, k=5)]) or ["z"]
        rows.append((random.choice([None, i]), random.choice([" ", "\n", " \t"]).join(words)))
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), edit=periodic_runs.periodic_tail)
    assert sorted((tuple(r)[:-1] for r in out.collect()), key=key) == sorted((run_row(*r) for r in rows), key=key)
    listed = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in out.collect() if r["doc_id"] is not None}
    assert all(listed[i] == all_runs(edited_words(i, t)) for i, t in rows if i is not None)


def test_runs_of_odd_rows(odd):
    got = sorted((tuple(r)[:-1] for r in periodic_runs.periodic_runs(odd, edit=periodic_runs.periodic_tail).collect()), key=key)
    fast = [r for r in ODD if r[1] is not LONG]
    assert [r for r in got if r[0] != 4] == sorted((run_row(*r) for r in fast), key=key)
    assert periodic_runs.periodic_runs(odd.limit(0)).collect() == []
    whole = [r for r in periodic_runs.periodic_runs(odd).collect() if r["doc_id"] == 4][0]
    assert (whole["n_runs"], whole["start"], whole["length"], whole["period"]) == (1, 0, 7 * 8000, 7)
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(odd, periodic_runs.RunParams(times=2))


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variant_rows(texts, edit=True, least=7, times=2):
    n = collections.Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if edit and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= times}
    masks = collections.defaultdict(set)  # two words near each other share one of these
    for w in n:
        for i in range(len(w)):
            masks[w[:i] + w[i + 1 :]].add(w)
        masks[w].add(w)
    near = collections.defaultdict(set)
    for group in masks.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * c:
            form[w] = best
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=key)


def test_variant_query(spark, sf, texts):
    got = sorted((tuple(r) for r in QUERIES["op12_spelling_variants"](spark, sf).collect()), key=key)
    assert got == variant_rows(texts.items()) and any(r[1] for r in got)


@pytest.mark.parametrize("params", [spelling_variants.VariantParams(), spelling_variants.VariantParams(block=3, tile=4, pending=50)])
def test_variants_of_crowded_words(spark, params):
    """Few letters, so that most words are near others; small blocks and tiles cut every group; chains of forms."""
    random.seed(4)
    words = {"".join(random.choices("aé", k=random.randint(6, 10))) for _ in range(300)} | {"a" * 7, "a" * 8, "a" * 9, "a" * 150, "a" * 151, "é" * 260, "é" * 261}
    rows = [(i, ", ".join([w.replace("a", random.choice("aA"))] * random.choice([1, 2, 3, 30, 400]))) for i, w in enumerate(sorted(words))] + [(None, None), (None, "ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ ÿÿÿÿÿÿ× ÿÿÿÿÿÿ×"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling_variants.spelling_variants(docs, params).collect()), key=key)
    assert got == variant_rows(rows, edit=False) and any(r[2] != (r[1] or r[0]) for r in got)


def test_variants_of_odd_rows(odd):
    got = sorted((tuple(r) for r in spelling_variants.spelling_variants(odd, edit=spelling_variants.misspelt).collect()), key=key)
    assert got == variant_rows(ODD) and got
    assert spelling_variants.spelling_variants(odd.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(odd, spelling_variants.VariantParams(ratio=1))


# Token counts


def test_count_query(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(tuple(r) for r in QUERIES["op13_token_counts"](spark, sf).collect())
    want = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in texts.items()]
    assert got == sorted((*w, w[2] > 4096) for w in want)


def test_splices_are_exact():
    """Tiny chunks and overlaps, texts without any place where a cut is safe by itself."""
    counter = token_counts.counter_of(MODEL)
    random.seed(6)
    parts = ["a", "ab ", "the ", " ", "  ", "\n", "é", "漢字仮名", "=", "x" * 50, " " * 40, "▁", "😀", "<s>", "<0x41>", "\x00", "ing", "tion"]
    widened = 0
    for _ in range(400):
        text = "".join(random.choices(random.sample(parts, random.randint(1, 5)), k=random.randint(0, 25)))
        chunk = random.choice([4, 8, 16, 40])
        n, w = token_counts.count_long(counter, text, token_counts.CountParams(MODEL, chunk=chunk, overlap=random.choice([1, 2, 3, chunk // 2])))
        assert n == len(counter.model.encode(text)), text
        widened += w
    assert widened > 100


def test_counts_of_long_runs():
    counter = token_counts.counter_of(MODEL)
    for text in ("x" * 100_000, "=" * 50_001, " " * 40_000, "漢" * 40_000, "\n" * 40_000, LONG):
        assert token_counts.count_long(counter, text, token_counts.CountParams(MODEL))[0] == len(counter.model.encode(text))


def test_counts_of_odd_rows(odd):
    counter = token_counts.counter_of(MODEL)
    got = sorted((tuple(r) for r in token_counts.count_tokens(odd, token_counts.CountParams(MODEL, chunk=500, overlap=10)).collect()), key=key)
    want = [(d, len((t or "").encode()), len(counter.model.encode(t or ""))) for d, t in ODD]
    assert got == sorted(((*w, w[2] > 4096) for w in want), key=key)
    assert token_counts.count_tokens(odd.limit(0), token_counts.CountParams(MODEL)).collect() == []
