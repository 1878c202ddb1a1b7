"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from stratapanel.llm import decontaminate, language_id, lattice_lm, line_dedup, packing, repeats, simhash, toxicity, url_filters, winnowing
from stratapanel.llm.queries import remainder, vocabulary_path

LONG = "Some words that go on and on. " * 8000
TEXTS = [
    (1, "A first line of words here.\nand one more line of words", "en"), (1, "A first line of words here.\nand one more line of words", "en"),
    (2, None, None), (3, "", "de"), (4, LONG, "en"), (5, "x" * 70_000, "en"), (None, "Text without a number, you idiot.", None), (None, None, "fr"),
    (6, "\n\n", "en"), (7, "one", "en"), (8, 'He said "idiot" again and again.', "en"),
]
CLASH = ["row", "id", "fp", "line", "node", "key", "bucket", "guest", "n", "c", "word", "seed", "doc", "host", "declared", "n_lines", "gone", "_slot"]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in TEXTS], "doc_id long, text string, lang string, source string").coalesce(1)
    return base.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "and one more line of words"), (2, None), (3, ""), (4, "a")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 1, 1), (8, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


LATTICE = lattice_lm.LatticeParams(path=vocabulary_path("piece_bpe_32k.model"), rounds=1)


def operators(items, labels):
    return {
        "lines": lambda d: line_dedup.dedup_lines(d),
        "leaks": lambda d: decontaminate.leaks(d, items),
        "clean": lambda d: decontaminate.decontaminate(d, items),
        "winnow": lambda d: winnowing.fingerprints(d),
        "neighbours": lambda d: winnowing.edited_neighbours(d),
        "toxicity": lambda d: toxicity.score(d, labels, remainder(4) != 2),
        "repeats": lambda d: repeats.remove_repeats(d),
        "packing": lambda d: packing.pack(d, packing.Packing(path=vocabulary_path("byte_bpe_50k.json"))),
        "simhash": lambda d: simhash.near_duplicates(d),
        "like": lambda d: simhash.one_of_each(d, simhash.LIKE_TEXTS),
        "lattice": lambda d: lattice_lm.score(d, remainder(7) != 2, LATTICE),
        "language": lambda d: language_id.identify(d, declared=F.col("lang"), host=F.col("source")),
        "identified": lambda d: language_id.keep_identified(d, declared=F.col("lang")),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, items, labels, name):
    out = operators(items, labels)[name](docs).collect()
    if name in ("winnow", "neighbours", "toxicity", "repeats", "simhash", "lattice", "language", "lines"):
        assert len(out) == len(TEXTS)  # one result for each row, repeated and unnumbered ones included
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(t[0]) for t in TEXTS)
    if name in ("lines", "clean", "like", "identified"):
        assert set(docs.columns) <= set(out[0].asDict())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, items, labels, name):
    assert operators(items, labels)[name](docs.limit(0)).collect() == []


def test_lines_of_odd_rows(docs):
    out = line_dedup.dedup_lines(docs).collect()
    first = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in out if r["doc_id"] == 1)
    assert [x[1] for x in first] == ["", TEXTS[0][1]] and [x[2] for x in first] == [2, 0]
    by = {r["doc_id"]: r for r in out if r["doc_id"]}
    assert by[2]["text"] is None and by[2]["n_lines"] == 0 and by[3]["text"] == "" and by[6]["text"] == "\n\n" and by[6]["n_lines"] == 3


def test_leaks_of_odd_rows(docs, items):
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == [(1, 1), (1, 1)]
    left = decontaminate.decontaminate(docs, items).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(t[0]) for t in TEXTS if t[0] != 1)
    assert decontaminate.leaks(docs, items.limit(0)).collect() == []


def test_repeats_of_odd_rows(docs):
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect() if r["doc_id"]}
    assert out[2]["n_bytes"] == 0 and out[1]["n_removed"] == 0
    assert out[4]["n_removed"] == out[4]["n_bytes"] == len(LONG) and out[4]["n_spans"] == 1
    assert out[5]["n_removed"] == 70_000


def test_pages(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/x?q#f"), (2, None), (3, "no address"), (4, "x://"), (5, "http://www.example.com/en/"), (6, "http://a.net/es/1"), (6, "http://a.net/es/1"),
        (None, "http://b.org?x"), (7, "http://com/x"), (8, "http://mycom/x"), (9, "http://example.com/english"), (10, "a://b.co.uk#x://c"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "id", "good", "n", "path")})
    outcomes = spark.createDataFrame([(1, True), (1, False), (6, False), (None, True), (3, None)], "page_id long, good boolean")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, outcomes, rules).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and by[2][:3] == ("", "", None) and by[3][:3] == ("", "", None) and by[4][:3] == ("", "", None)
    assert by[5][2:] == ("www.example.com/en/", "allow") and by[6][2:] == ("net/es/", "block") and by[None][:3] == ("b.org", "", None)
    assert by[7][2:] == ("com/", "allow") and by[8][2] is None and by[9][2:] == ("com/", "allow") and by[10][:2] == ("b.co.uk", "")
    assert all(g[4] in ("allow", "block") for g in got)
    assert url_filters.judge(pages.limit(0), outcomes, rules).collect() == []
    assert len(url_filters.judge(pages, outcomes.limit(0), rules).collect()) == len(rows)
