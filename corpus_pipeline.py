"""A cleaning pipeline over ``documents``; each stage reads what the one before it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.decontaminate import decontaminate
from stratapanel.llm.language_id import keep_identified
from stratapanel.llm.line_dedup import dedup_lines
from stratapanel.llm.packing import Packing, pack
from stratapanel.llm.queries import table, vocabulary_path
from stratapanel.llm.simhash import LIKE_TEXTS, one_of_each
from stratapanel.runtime import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go."""
    return keep_identified(docs, declared=F.col("lang"), host=F.col("source"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat others go; every document stays, with its new length."""
    # All other columns travel as one, so none of them can clash with the counts.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("-"), *rest).alias("rest"))
    size = F.length("text").cast("long")
    columns = {c: F.col(c) if c in ("doc_id", "text") else size if c == "n_chars" else F.col("rest").getField(c) for c in docs.columns}
    return dedup_lines(packed).select(*[column.alias(c) for c, column in columns.items()])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like texts stays: five-word shingles, a similarity of 0.8."""
    return one_of_each(docs, LIKE_TEXTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, Packing(path=vocabulary_path("byte_bpe_50k.json")))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash", simhash), ("decontamination", decontamination), ("packing", packing)]

#: Tokens, fingerprints and learnt likelihoods cannot be stated in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
