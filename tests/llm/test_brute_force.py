"""The registered text queries against plain Python over the smallest tables."""

import collections
import dataclasses
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from oracle_check import compare, connect
from stratapanel.llm import arrays, decontaminate, language_id, lattice_lm, line_dedup, packing, repeats, simhash, toxicity, winnowing
from stratapanel.llm.components import components
from stratapanel.llm.queries import ORACLES, QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def texts(sf):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_url_filter_matches_sql(spark, sf):
    assert compare(QUERIES["op1_url_filter"](spark, sf), connect(sf), ORACLES["op1_url_filter"]).startswith("ok")


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
        d = e
    return d[-1]


def plain_words(line):
    return re.sub(r"[\W_]+", " ", re.sub("([\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", line).lower()).split()


def test_lines(spark):
    """Against a search of all pairs of texts: near copies, lines of one word, lines without blanks, lines of equal words."""
    random.seed(5)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9))) for _ in range(300)]
    lines = [" ".join(random.choices(words, k=random.randint(3, 40))) for _ in range(60)]
    cjk = ["\u4eca\u65e5\u306f\u3044\u3044\u5929\u6c17\u3067\u3059\u306d", "\u4eca\u65e5\u306f\u3044\u3044\u5929\u6c17\u3067\u3059\u3088", "\u0e01\u0e02\u0e04\u0e07"]
    planted = [lines[0].upper() + "!", lines[1] + " x", lines[2][:-1], "two words", "Read", "a a a a a", "a a a a b", "---", "", *cjk]
    pool = [*lines, *planted]
    data = [(i, "\n".join(random.choices(pool, k=5))) for i in range(60)]
    norm = {line: tuple(plain_words(line)) for line in pool}
    distinct = sorted(set(norm.values()))
    group = {n: n for n in distinct}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    seen_pool = {norm[x] for _, t in data for x in t.split("\n")}
    for one, two in itertools.combinations([n for n in distinct if n in seen_pool], 2):
        if edits(one, two) <= math.floor(max(len(one), len(two)) * 0.2 + 1e-9):
            group[root(one)] = root(two)
    seen, want = set(), {}
    for i, text in data:
        kept = []
        for line in text.split("\n"):
            g = root(norm[line])
            if not g or g not in seen:
                kept.append(line)
            seen.add(g)
        want[i] = "\n".join(kept)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == want
    assert root(norm[cjk[0]]) == root(norm[cjk[1]]) and root(norm["a a a a a"]) == root(norm["a a a a b"])


def test_line_recall(spark, texts):
    """Lines of real texts with a fifth of their words replaced: at least nine of ten are found, for all lengths."""
    random.seed(8)
    lines = sorted({x for t in texts.values() if t for x in t.split("\n")})
    vocabulary = sorted({w for x in lines for w in plain_words(x)})
    for low, high in ((5, 9), (10, 19), (20, 39), (40, 200)):
        data = []
        for line in random.sample(fit := [x for x in lines if low <= len(plain_words(x)) <= high], min(400, len(fit))):
            words = plain_words(line)
            changed = list(words)
            for place in random.sample(range(len(words)), math.floor(len(words) * 0.2 + 1e-9)):
                changed[place] = random.choice(vocabulary)
            data += [(len(data), " ".join(words)), (1_000_000 + len(data), " ".join(changed))]
        got = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).where("doc_id >= 1000000")
        found, of = sum(r["n_removed"] for r in got.collect()), len(data) // 2
        print(low, high, found, of)
        assert of >= 100 and found >= 0.9 * of, (low, high, found, of)


def test_lines_do_not_depend_on_splits(spark):
    """Rows are named by what they hold: a table that is split otherwise in each job gives the same result."""
    data = [(i % 50, f"line number {i % 7} of many words here\nown {i}") for i in range(200)] + [(3, "again"), (3, "again")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    results = [sorted(tuple(r) for r in line_dedup.dedup_lines(docs.repartition(n)).collect()) for n in (1, 3, 11)]
    assert results[0] == results[1] == results[2] and sum(r[3] for r in results[0]) == 200 - 7 + 1


def test_line_query_removes_exact_repeats(spark, sf, texts):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op2_line_dedup")}
    seen = set()
    for i in sorted(texts):
        kept = collections.Counter(got[i]["text"].split("\n"))
        for line in texts[i].split("\n"):
            n = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if n.count(" ") >= 2:
                assert n not in seen or not kept[line] or line in texts[i].split("\n")[: texts[i].split("\n").index(line) + 1]
                seen.add(n)
        assert got[i]["n_lines"] == len(texts[i].split("\n"))


def test_leaks(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()}
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, sf, "op3_decontamination")}
    assert got >= {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert len(got) == len({(d, i) for d, t in texts.items() for i, x in items.items() if x in t})


def test_leaks_tolerate_substitutions(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(random.choices(words, k=30))) for i in range(20)]
    docs = []
    for i, x in items:
        w = x.split()
        for p in random.sample(range(30), 4):
            w[p] = "other"
        docs.append((i, " ".join(random.choices(words, k=50) + w + random.choices(words, k=50))))
    docs.append((99, " ".join(random.choices(words, k=500))))
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out}
    assert found <= {(i, i) for i, _ in items} and len(found) >= 19


def test_seeds_and_stretch():
    tokens = np.arange(20, dtype=np.uint64)
    a = decontaminate.seeds_of(tokens, np.zeros(20, int), "1101")[1]
    tokens[5] = 99
    b = decontaminate.seeds_of(tokens, np.zeros(20, int), "1101")[1]
    assert {i for i in range(17) if a[i] != b[i]} == {2, 4, 5}  # not 3, whose open position it is
    assert decontaminate.best_stretch(np.array([0, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0], bool), 0.8) == (1, 10, 8)


def test_winnowing(spark, sf, texts):
    ids = sorted(texts)
    for r in rows(spark, sf, "op4_winnowing"):
        t, n = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == winnowing.sketch(t.encode(), winnowing.WinnowParams()).astype(">u4").tobytes().hex()
        assert (r["edited_fingerprint"] == r["fingerprint"]) >= (edited == t) and 0 <= r["near_next"] <= 1


def test_winnowing_guarantee():
    random.seed(1)
    p = winnowing.WinnowParams(k=5, window=8)
    for _ in range(50):
        shared = bytes(random.choices(b"abcd", k=12))
        a, b = (bytes(random.choices(b"abcd", k=40)) + shared + bytes(random.choices(b"abcd", k=40)) for _ in range(2))
        ha, at = winnowing.winnow(a, p)
        assert set(ha.tolist()) & set(winnowing.winnow(b, p)[0].tolist())
        h = arrays.PrefixHash(np.frombuffer(a, np.uint8)).windows(5) >> np.uint64(20)
        want = sorted({i + max(k for k in range(8) if h[i + k] == h[i : i + 8].min()) for i in range(len(h) - 7)})
        assert at.tolist() == want


def test_automaton():
    random.seed(1)
    words = {"".join(random.choice("abc") for _ in range(random.randint(2, 7))): random.uniform(1, 3) for _ in range(30)}
    stems = {"".join(random.choice("abc") for _ in range(4)) + "*": random.uniform(1, 3) for _ in range(3)}
    lexicon = toxicity.Lexicon(words | stems, 4)
    tokens = ["".join(random.choice("abcd") for _ in range(random.randint(1, 9))) for _ in range(2000)]
    reader = toxicity.Reader(lexicon, toxicity.ToxicityParams())
    codes = np.frombuffer(" ".join(tokens).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in tokens])
    exact, edited = lexicon.match(reader.table[codes], np.cumsum(lengths + 1) - lengths - 1, lengths, 32)
    for t, x, y in zip(tokens, exact, edited, strict=True):
        direct = max([words.get(t, 0.0), *(v for k, v in stems.items() if t.startswith(k[:-1]))])
        near = 0.0 if direct else max([0.0, *(v for k, v in words.items() if len(k) >= 4 and edits(k, t) == 1)])
        assert (x, y) == (direct, near)


def test_quotation_is_not_abuse():
    reader = toxicity.Reader(toxicity.Lexicon({"idiot": 2.0}), toxicity.ToxicityParams())
    abuse, quoted, reported, misspelt = reader.features(["you are an idiot", 'the "idiot" again', "the word idiot", "you idjot"])
    assert abuse[0] > 0 and abuse[3] > 0 and quoted[0] == reported[0] == 0 < quoted[2] and misspelt[1] > 0


def test_toxicity_held_out(spark):
    """Accuracy on rows that were not learnt from."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    out = [(r["score"], labels[r["doc_id"]]) for r in rows(spark, sf, "op5_toxicity") if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in out if not y], [s for s, y in out if y]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.95


def test_repeats(spark, sf, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    count = collections.Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    for r in rows(spark, sf, "op6_suffix_repeats"):
        t = raw[r["doc_id"]]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("limit", [1 << 15, 2])
def test_repeats_of_dense_texts(spark, limit):
    """Small alphabets, nested and overlapping repeats; with a small group limit the exact way for large groups is taken."""
    random.seed(3)
    base = ["".join(random.choice("ab") for _ in range(40)) for _ in range(3)]
    data = [(i, random.choice(base)[random.randint(0, 20) :] + "".join(random.choice("abc") for _ in range(9))) for i in range(30)]
    p = repeats.RepeatParams(length=12, k=4, group_limit=limit)
    count = collections.Counter(t[i : i + 12] for _, t in data for i in range(len(t) - 11))
    want = {i: sum(any(count[t[s : s + 12]] > 1 for s in range(max(0, k - 11), min(k, len(t) - 12) + 1)) for k in range(len(t))) for i, t in data}
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").coalesce(2), p).collect()}
    assert got == want


def test_packing(spark, sf, texts):
    """Pieces give back every document's ids, gapless and without overlap."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, sf, "op7_packing"):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        assert sum(n for _, n in pieces[i]) == len(own) and len({s for s, _ in pieces[i]}) == len(pieces[i])
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    sizes = [sum(n for _, n in x) for x in fill.values()]
    assert sum(0 if s & (s - 1) == 0 else 2048 - s for s in sizes) < 0.03 * sum(sizes)


def test_best_cuts_are_optimal():
    random.seed(4)
    p = packing.Packing(path="", window=16, least_power=4, open_cost=1.0)
    for _ in range(100):
        pos = [0, *np.cumsum(random.choices(range(1, 9), k=12)).tolist()]
        penalty = [random.choice([0.0, 3.0, 7.0]) for _ in pos]
        exact = [[i for i in range(j) if pos[j] - pos[i] in (4, 8, 16)] for j in range(len(pos))]
        best = [0.0] + [math.inf] * (len(pos) - 1)

        def cost(i, j, pos=pos, penalty=penalty):
            n = pos[j] - pos[i]
            return math.inf if n > 16 else penalty[j] + 1 + (0 if n in (4, 8, 16) else 16 - n)

        for j in range(1, len(pos)):
            best[j] = min(best[i] + cost(i, j) for i in range(j))
        cuts = packing.best_cuts(pos, penalty, exact, p, True)
        assert sum(cost(i, j) for i, j in zip(cuts, cuts[1:], strict=False)) == best[-1]


def bits(h):
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, fps, distance):
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: root(i) for i in ids}


def test_simhash(spark, sf, texts):
    fps = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        fps[i] = bits([xxhash.xxh64_intdigest(s, 42) for s in shingles])
    want = smallest(sorted(texts), fps, 4)
    for r in rows(spark, sf, "op8_simhash"):
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("limit", [1 << 13, 3])
def test_simhash_of_dense_fingerprints(spark, limit):
    """Chains and clouds of fingerprints; with a small limit all buckets are dealt again."""
    random.seed(8)
    fps = [random.getrandbits(64) for _ in range(12)]
    for _ in range(300):
        x = random.choice(fps)
        for _ in range(random.randint(1, 5)):
            x ^= 1 << random.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "f0 long")
    params = simhash.SimHashParams(bucket_limit=limit)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(nodes, params)).collect()}
    want = smallest(list(range(len(fps))), fps, 4)
    got = collections.defaultdict(set)
    for i, x in enumerate(fps):
        got[roots.get(x, x)].add(i)
    expected = collections.defaultdict(set)
    for i, r in want.items():
        expected[r].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_like_texts(spark):
    """Texts with a Jaccard similarity of 0.8 of five-word shingles meet; others stay apart."""
    random.seed(9)
    words = [f"w{i}" for i in range(2000)]
    data = []
    for i in range(60):
        w = random.choices(words, k=300)
        data.append((2 * i, " ".join(w)))
        for p in random.sample(range(300), 6):
            w[p] = "changed"
        data.append((2 * i + 1, " ".join(w)))
    left = sorted(r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string"), simhash.LIKE_TEXTS).collect())
    assert set(range(0, 120, 2)) <= set(left) and len(left) <= 64


def test_lattice_recursion():
    names, p = lattice_lm.vocabulary(vocabulary_path("piece_bpe_32k.model"))
    lattice = lattice_lm.Lattice(names, p, 0.3)
    weight = dict(zip(names, lattice.log_p.tolist(), strict=True))

    def whole(w):
        sums = [0.0]
        for j in range(1, len(w) + 1):
            sums.append(float(np.logaddexp.reduce([sums[i] + weight[w[i:j]] for i in range(max(0, j - 16), j) if w[i:j] in weight])))
        return sums[-1] + math.log(0.3)

    words = [b"the", b"thinking", "é".encode(), b"x" * 300, b"a", b"internationalisation", b"|"]
    expected = np.zeros(len(names))
    assert np.allclose(lattice.run(words, expected), [whole(w) for w in words])
    assert math.isclose(sum(e * len(n) for e, n in zip(expected, names, strict=True)), sum(map(len, words)))


def test_lattice_query(spark, sf, texts):
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    for r in rows(spark, sf, "op9_lattice_lm"):
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_trigrams():
    texts = [b"", b"a", b"ab", b"a1b", b"Abcd", b"", b"xy", b"Hi, you 12"]
    offsets = np.cumsum([0, *map(len, texts)])
    h, first = language_id.trigrams(np.frombuffer(b"".join(texts), np.uint8), offsets, 15)
    for k, t in enumerate(texts):
        t = bytes(c if chr(c).isalpha() else 32 for c in t.lower())
        want = [((t[i] | t[i + 1] << 8 | t[i + 2] << 16) * 2654435761 % 2**32) >> 17 for i in range(len(t) - 2) if t[i + 1] != 32]
        assert h[first[k] : first[k + 1]].tolist() == want


def test_language(spark, sf):
    want = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    out = rows(spark, sf, "op10_language_id")
    assert np.mean([r["language"] == want[r["doc_id"]] for r in out]) > 0.99 and all(r["keep"] for r in out)


def test_language_overrules_a_wrong_declaration(spark):
    from pyspark.sql import functions as F

    data = [(i, "the cat and the dog with the hat " * 5, "en", "a.com") for i in range(30)] + [(30 + i, "der hund und die katze mit dem hut " * 5, "de", "b.de") for i in range(30)]
    data += [(100, "der hund und die katze mit dem hut " * 5, "en", "b.de"), (101, None, None, "b.de"), (102, "二" * 300, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, host string")
    out = {r["doc_id"]: r for r in language_id.identify(docs, declared=F.col("lang"), host=F.col("host"), suffix=language_id.suffix_of(F.col("host"))).collect()}
    assert out[100]["language"] == "de" and out[101]["language"] == "de" and out[0]["language"] == "en"
    assert out[102]["language"] == "und" and not out[102]["keep"]


def test_pipeline(spark, sf, texts):
    """Every stage's decisions take effect on what it was given."""
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in c.STAGES[:-1]:
        before = kept
        kept = c.materialize(stage(spark, before, sf))
        assert kept.columns == columns
        if name == "line_dedup":
            assert kept.count() == before.count()
        else:
            assert kept.exceptAll(before).count() == 0
    items = [r["text"] for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    left = {r["doc_id"]: r for r in kept.collect()}
    assert not any(x in r["text"] for r in left.values() for x in items)
    assert all(r["n_chars"] == len(r["text"]) for r in left.values())
    assert {r["doc_id"] for r in c.run(spark, sf).collect()} == set(left)


def test_longest_stretch():
    random.seed(6)
    for _ in range(2000):
        equal = np.array(random.choices([True, False], [random.choice([3, 8]), 1], k=random.randint(0, 40)), bool)
        fits = [b - a for a in range(len(equal) + 1) for b in range(a, len(equal) + 1) if 5 * int(equal[a:b].sum()) >= 4 * (b - a)]
        start, end, same = decontaminate.longest_stretch(equal, 0.8)
        assert end - start == max(fits) and same == equal[start:end].sum() and 5 * same >= 4 * (end - start)


def test_leaks_with_substitutions_anywhere(spark):
    """Every way to substitute a fifth of a short item's tokens, those near its ends among them; one more is no leak."""
    cases, items, docs, want = [(5, 1), (6, 1), (7, 1), (8, 1), (10, 2), (13, 1), (13, 2), (15, 2), (15, 3)], [], [], set()
    for k, n in enumerate(sorted({n for n, _ in cases})):
        items.append((n, " ".join(f"t{k}x{i}" for i in range(n))))
    for n, x in items:
        most = n // 5
        for count in (*{c for m, c in cases if m == n}, most + 1):
            for places in itertools.combinations(range(n), count):
                if count > most and len(docs) % 7:
                    docs.append((len(docs), ""))
                    continue
                w = x.split()
                for p in places:
                    w[p] = f"other{p}"
                # A stretch of 13 tokens or more may do without a substituted end.
                sums = [0, *itertools.accumulate(-4 if p in places else 1 for p in range(n))]
                if any(sums[b] >= sums[a] for a in range(n + 1) for b in range(a + min(13, n), n + 1)):
                    want.add((len(docs), n))
                docs.append((len(docs), " ".join(["before"] * 3 + w + ["after"] * 3)))
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want


def test_many_languages(spark):
    """Each of 40 declared languages is a class; rows that declare one beyond the bound keep it and stay."""
    from pyspark.sql import functions as F

    random.seed(12)
    data = []
    for k in range(40):
        letters = random.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for i in range(10 if k else 20):
            text = " ".join("".join(random.choices(letters, k=5)) for _ in range(40))
            data.append((100 * k + i, text, f"x{k}" if i else None, f"h{k}.org"))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, host string")
    for bound in (language_id.LanguageParams(), language_id.LanguageParams(languages=5)):
        out = {r["doc_id"]: r for r in language_id.identify(docs, bound, declared=F.col("lang"), host=F.col("host")).collect()}
        for i, _, lang, _ in data:
            if lang or bound.languages > 40:
                assert out[i]["language"] == f"x{i // 100}" and out[i]["keep"]
    kept = language_id.keep_identified(docs, language_id.LanguageParams(languages=5), declared=F.col("lang"), host=F.col("host"))
    assert kept.where("lang is not null").count() == sum(lang is not None for _, _, lang, _ in data)


@pytest.mark.parametrize("small, limit", [(128, 1 << 13), (2, 5)])
def test_like_texts_by_jaccard(spark, small, limit):
    """Pairs of known Jaccard similarity, and a dense group of near copies; with small limits all buckets go through leaders and units."""
    random.seed(14)
    params = dataclasses.replace(simhash.LIKE_TEXTS, small=small, bucket_limit=limit, rounds=2)
    words = [f"w{i}" for i in range(5000)]
    data = {}
    for i in range(120):
        w = random.choices(words, k=300)
        data[len(data)] = " ".join(w)
        new = int(300 * (1 - [0.85, 0.75, 0.7, 0.6][i % 4]) / (1 + [0.85, 0.75, 0.7, 0.6][i % 4]))
        data[len(data)] = " ".join(w[new:] + random.choices(words, k=new))
    base = random.choices(words, k=300)
    for _ in range(40):
        w = list(base)
        for p in random.sample(range(300), random.randint(1, 8)):
            w[p] = random.choice(words)
        data[len(data)] = " ".join(w)
    data[len(data)], data[len(data) + 1] = "", "a b c d e f"
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in data.items()}
    group = {i: i for i in data}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(data, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            group[y] = x
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs, params).collect()}
    assert got == {i: root(i) for i in data}


def test_pivot_tables_discard_pairs_before_the_bits(monkeypatch):
    """The stage for like texts looks at pairs of a bucket through its pivot table first, and gives the same pairs as all comparisons."""
    params = dataclasses.replace(simhash.LIKE_TEXTS, distance=20, samples=8, sample_bits=4)
    rng = np.random.Generator(np.random.PCG64(3))
    masks, size = simhash.first_masks(params), np.array([5, 40, 1, 8, 60])
    fps = rng.integers(0, 1 << 63, (size.sum(), params.words), dtype=np.uint64)
    bucket = np.repeat(np.arange(len(size)), size)
    for k in range(0, len(fps), 3):  # every third is near the one in front of it
        fps[k] = fps[k - 1] ^ np.uint64(1 << int(rng.integers(63)))
    choice = bucket % len(masks)
    want = set()
    for x, y in itertools.combinations(range(len(fps)), 2):
        met = [k for k, m in enumerate(masks) if not ((fps[x] ^ fps[y]) & m).any()]
        if bucket[x] == bucket[y] and simhash.hamming(fps[x], fps[y]) <= params.distance and met and met[0] == choice[x]:
            want.add((x, y))
    verified, plain = [], simhash.hamming
    monkeypatch.setattr(simhash, "pivot_table", lambda f, p: np.stack([plain(f, x) for x in p], axis=1))
    monkeypatch.setattr(simhash, "hamming", lambda a, b: verified.append(len(a)) or plain(a, b))
    got = {(int(x), int(y)) for xs, ys in simhash._pairs_within(fps, choice, size, params) for x, y in zip(xs, ys, strict=True)}
    assert got == want and len(want) >= 3
    assert sum(verified) < 0.5 * sum(int(n) * (int(n) - 1) // 2 for n in size)
