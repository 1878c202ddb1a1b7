"""The pipeline as a whole on odd rows, clashing names and an empty table."""

import importlib

import pytest
from pyspark.sql import functions as F

pipeline = importlib.import_module("corpus_pipeline")
LONG = "A long text that goes on and on with many words. " * 3000
CLASH = ["n_lines", "n_removed", "row", "line", "gone", "doc", "rest", "fp", "_rejected", "_leaked", "_dropped", "verdict"]


@pytest.fixture(scope="module")
def odd(spark):
    line = "The same sentence of the report stands in both of these documents, word for word and line by line."
    rows = [
        (1, f"{line}\nand something of its own is here as well", "en", "a"), (2, f"{line}\nwhile this one goes on in quite another way", "en", "a"), (3, None, None, "a"), (4, "", "en", None),
        (5, LONG, "en", "b"), (6, "x" * 50_000, None, "b"), (7, "one", "en", "b"), (7, "one", "en", "b"), (None, "Text without a number that is kept like any other.", "en", "b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit("clash") for c in CLASH}).coalesce(2)


def test_stages_keep_columns_and_clean_rows(spark, sf, odd):
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = pipeline.materialize(out)
        assert {r[c] for r in docs.select(*CLASH).collect() for c in CLASH} == {"clash"}, name
    rows = docs.collect()
    kept = {r["doc_id"] for r in rows}
    assert {1, 2, 5, None} <= kept
    by = {r["doc_id"]: r for r in rows}
    assert "same sentence" in by[1]["text"] and "same sentence" not in by[2]["text"] and by[2]["n_chars"] == len(by[2]["text"])
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p["doc_id"] for p in pieces} == kept


def test_empty_table(spark, sf, odd):
    docs = odd.limit(0)
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, sf))
    assert docs.count() == 0
