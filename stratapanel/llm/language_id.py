"""Language identification by fusing text, markup, address and host evidence.

The posterior of a language is the product of four parts:

* text: naive Bayes over hashed byte trigrams, learnt from all rows that declare a language, tempered because trigrams overlap;
* declared markup language: right with probability ``trust``, else any other;
* address suffix and host: a prior smoothed down a hierarchy.  Counts of declared languages are shrunk from the host to its
  suffix and from the suffix to the whole table; a row's own declaration is taken out of its host's and suffix's counts.

An undetermined class spreads its trigrams evenly.  Rows that it wins, or whose best language stays below ``least``,
are rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.arrays import lower_table, pieces
from stratapanel.runtime import materialize

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``languages`` bounds the memory for classes (128 KB each): the most often declared ones.  Rows that declare a further one keep it.

    ``bits`` bounds the trigram table.
    """

    languages: int = 256
    bits: int = 15
    temper: float = 0.2
    trust: float = 0.95
    strength: float = 20.0
    undetermined: float = 1e-4
    least: float = 0.5
    smoothing: float = 0.5


#: Letters in lower case (all bytes above 127 count as letters); every other byte is a blank.
_FOLDED = np.where((np.arange(256) > 127) | np.isin(np.arange(256), np.r_[65:91, 97:123]), lower_table(), 32).astype(np.uint32)


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a piece and the first of each text.

    Only those with a letter in the middle count: numbers and signs are no evidence of a language.  Trigrams do not cross texts.
    """
    low = _FOLDED[data]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = (low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))) * np.uint32(2654435761) >> np.uint32(32 - bits)
    inside = low[1:-1] != 32
    for back in (1, 2):  # starts whose trigram would leave the text
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < len(h))]] = False
    before = np.concatenate([[0], np.cumsum(inside)])
    return h[inside].astype(np.int64), before[np.minimum(offsets, len(h))]


def _learn(docs: DataFrame, languages: list[str], params: LanguageParams) -> np.ndarray:
    """Log likelihood of every trigram under every language, the undetermined class last."""
    classes, size = len(languages), 1 << params.bits
    index = {name: k for k, name in enumerate(languages)}

    def run(batches):
        counts = np.zeros(classes * size, np.int64)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                h, first = trigrams(data, offsets, params.bits)
                which = np.array([index[d] for d in batch.column(0)[i:j].to_pylist()], np.int64)
                counts += np.bincount(np.repeat(which * size, np.diff(first)) + h, minlength=classes * size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["cell", "n"])

    known = docs.where(F.col("declared").isin(languages)).select("declared", "text")
    # At most languages * 2**bits rows.
    cells = known.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas() if languages else None
    counts = np.zeros(classes * size)
    if cells is not None:
        counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(classes, size)
    p = (counts + params.smoothing) / (counts.sum(axis=1, keepdims=True) + params.smoothing * size)
    return np.concatenate([np.log(p), np.full((1, size), -math.log(size))]).T.astype(np.float32)


def _counts_of(rows: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """Declared languages of each key, as an array in the order of ``languages``."""
    counted = rows.where(F.col(key).isNotNull() & F.col("declared").isin(languages)).groupBy(key, "declared").agg(F.count("*").cast("double").alias("n"))
    known = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("declared", "n"))).alias("m"))
    return known.select(key, F.transform(F.lit(languages), lambda name: F.coalesce(F.try_element_at("m", name), F.lit(0.0))).alias(f"{key}_counts"))


def identify(
    docs: DataFrame,
    params: LanguageParams | None = None,
    id_column: str = "doc_id",
    text: Column | None = None,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
) -> DataFrame:
    """Per row: id, language, confidence and keep.

    A missing or null piece of evidence has no say; so a null or empty text is judged by its declaration and priors.  Declared
    languages are compared by their lower-cased part before ``-`` or ``_``.  A row that declares one beyond the bound keeps
    it, with ``trust`` as its confidence: no class can speak for or against it.
    Repeated rows are judged row by row and null ids kept; ties go to the language declared more often.  Without any
    declared language all rows are undetermined.  An empty table gives an empty result.
    """
    params = params or LanguageParams()
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c.cast("string")
    name = F.nullif(F.lower(F.regexp_extract(pick(declared), "^\\s*([^-_\\s]*)", 1)), F.lit(""))
    source = docs.select(
        F.col(id_column).alias("id"), (F.col("text") if text is None else text).alias("text"), name.alias("declared"), pick(suffix).alias("suffix"), pick(host).alias("host")
    )
    seen = source.where("declared is not null").groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(params.languages).collect()
    languages = [r["declared"] for r in seen]
    if not languages:
        return source.select(F.col("id").alias(id_column), F.lit(UNDETERMINED).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("keep"))
    total = sum(r["count"] for r in seen)
    overall = [r["count"] / total for r in seen]
    shared = docs.sparkSession.sparkContext.broadcast(_learn(source, languages, params))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        table = shared.value
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                h, first = trigrams(data, offsets, params.bits)
                sums = np.zeros((j - i, table.shape[1]))
                filled = np.flatnonzero(np.diff(first))
                if len(filled):
                    for k in range(table.shape[1]):
                        sums[filled, k] = np.add.reduceat(table[:, k][h].astype(np.float64), first[filled])
                part = batch.slice(i, j - i)
                flat = pa.array((sums * params.temper).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * table.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *(part.column(k) for k in (2, 3, 4))], names=["id", "fit", "declared", "suffix", "host"])

    fits = source.mapInArrow(run, f"id {kind}, fit array<double>, declared string, suffix string, host string")
    rows = materialize(fits)
    # A null key finds no partner; a made-up one of its own keeps such rows apart.
    alone = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    keyed = rows.withColumn("suffix_key", F.coalesce("suffix", alone)).withColumn("host_key", F.coalesce("host", alone))
    by_suffix, by_host = (_counts_of(rows, k, languages).withColumnRenamed(k, f"{k}_key") for k in ("suffix", "host"))
    joined = keyed.join(by_suffix, "suffix_key", "left").join(by_host, "host_key", "left")
    names = F.lit(languages)
    own = F.transform(names, lambda n: F.when(F.col("declared") == n, 1.0).otherwise(0.0))
    zeros, base = F.lit([0.0] * len(languages)), F.lit(overall)
    others = lambda c: F.coalesce(F.zip_with(c, own, lambda x, y: F.greatest(x - y, F.lit(0.0))), zeros)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    k = F.lit(params.strength)
    shrink = lambda counts, prior: F.zip_with(counts, prior, lambda n, p: (n + k * p) / (size(counts) + k))
    leveled = joined.select("id", "fit", "declared", others("suffix_counts").alias("s"), others("host_counts").alias("h"))
    priors = leveled.select("id", "fit", "declared", "h", shrink(F.col("s"), base).alias("sp")).select("id", "fit", "declared", shrink(F.col("h"), F.col("sp")).alias("prior"))
    wrong = (1.0 - params.trust) / max(1, len(languages) - 1)
    listed = F.col("declared").isin(languages)
    says = F.transform(names, lambda n: F.when(F.col("declared") == n, params.trust).when(listed, wrong).otherwise(1.0))
    evidence = F.zip_with(F.zip_with(F.col("prior"), says, lambda p, s: F.log(p * s * F.lit(1.0 - params.undetermined))), F.slice("fit", 1, len(languages)), lambda a, b: a + b)
    nowhere = F.log(F.lit(params.undetermined) * F.when(listed, 1.0 / len(languages)).otherwise(1.0)) + F.element_at("fit", -1)
    beyond = F.when(~listed & (F.col("declared") != UNDETERMINED), F.col("declared"))
    scored = priors.select("id", F.concat(evidence, F.array(nowhere)).alias("e"), beyond.alias("beyond")).select("id", "e", "beyond", F.array_max("e").alias("top"))
    best = F.element_at(F.lit([*languages, UNDETERMINED]), F.array_position("e", F.col("top")).cast("int"))
    share = F.lit(1.0) / F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    confidence = F.when(F.col("beyond").isNotNull(), F.lit(params.trust)).otherwise(share)
    found = scored.select(F.col("id").alias(id_column), F.coalesce("beyond", best).alias("language"), confidence.alias("confidence"), "beyond")
    keep = F.col("beyond").isNotNull() | ((F.col("language") != UNDETERMINED) & (F.col("confidence") >= params.least))
    return found.withColumn("keep", keep).drop("beyond")


def suffix_of(host: Column) -> Column:
    """Last label of a host name; null for a null or empty host."""
    return F.nullif(F.substring_index(host, ".", -1), F.lit(""))


def keep_identified(docs: DataFrame, params: LanguageParams | None = None, id_column: str = "doc_id", **evidence: Column) -> DataFrame:
    """The rows whose id was not rejected, with all columns; rows without an id stay."""
    found = identify(docs, params, id_column, **evidence)
    rejected = found.where(~F.col("keep")).select(F.col(id_column).alias("_rejected")).distinct()
    return docs.join(rejected, docs[id_column] == rejected["_rejected"], "left_anti")
