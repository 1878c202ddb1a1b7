"""Registered queries of the text operators; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import lattice_lm, toxicity
from stratapanel.llm.decontaminate import leaks
from stratapanel.llm.language_id import identify
from stratapanel.llm.line_dedup import dedup_lines
from stratapanel.llm.packing import Packing, pack
from stratapanel.llm.periodic_runs import periodic_runs, periodic_tail
from stratapanel.llm.repeats import remove_repeats
from stratapanel.llm.simhash import near_duplicates
from stratapanel.llm.spelling_variants import misspelt, spelling_variants
from stratapanel.llm.token_counts import CountParams, count_tokens
from stratapanel.llm.url_filters import judge
from stratapanel.llm.winnowing import edited_neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(modulus: int):
    """crc32 of the document id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Packing(path=vocabulary_path("byte_bpe_50k.json")))


@query("op9_lattice_lm")
def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = lattice_lm.LatticeParams(path=vocabulary_path("piece_bpe_32k.model"))
    out = lattice_lm.score(table(spark, sf_dir, "documents"), remainder(7) != 2, params, class_column="lang")
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start", "n_tokens", "n_equal")


@query("op4_winnowing")
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared language of a document is its ``lang``, its host its ``source``; it has no address."""
    return identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) != 2)
    return out.select("doc_id", (F.coalesce(remainder(4), F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_suffix_repeats")
def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), edit=periodic_tail).drop("runs")


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), edit=misspelt)


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), CountParams(path=vocabulary_path("piece_bpe_32k.model")))


#: Host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _digamma_sql(x: str) -> str:
    y = f"({x}+6)"
    return f"(ln({y}) - 1/(2*{y}) - 1/(12*{y}*{y}) + 1/(120*{y}*{y}*{y}*{y}) - (1/{x}" + "".join(f" + 1/({x}+{i})" for i in range(1, 6)) + "))"


def _trigamma_sql(x: str) -> str:
    y = f"({x}+6)"
    return f"(1/{y} + 1/(2*{y}*{y}) + 1/(6*{y}*{y}*{y}) + 1/({x}*{x})" + "".join(f" + 1/(({x}+{i})*({x}+{i}))" for i in range(1, 6)) + ")"


def _strength_sql(name: str, children: str, parent: str) -> str:
    return f"""
{name}_groups AS (SELECT {parent} AS parent, sum(n)::DOUBLE AS n, sum(g)::DOUBLE AS g, count(*) AS k, sum(n*n)::DOUBLE AS nn, sum(g*(g::DOUBLE/n)) AS gp FROM {children} WHERE n > 0 GROUP BY 1),
{name}_sums AS (SELECT coalesce(sum(k),0) AS k, count(*) AS j, coalesce(sum(n),0) AS n, coalesce(sum(nn/n),0) AS nn, coalesce(sum(gp - g*g/n),0) AS b, coalesce(sum(g-gp),0) AS w FROM {name}_groups),
{name}_means AS (SELECT k, j, n, b/nullif(k-j,0) AS msb, w/nullif(n-k,0) AS msw, (n-nn)/nullif(k-j,0) AS size FROM {name}_sums),
{name}_share AS (SELECT *, CASE WHEN msb+(size-1)*msw > 0 THEN (msb-msw)/(msb+(size-1)*msw) ELSE 0 END AS share FROM {name}_means),
{name} AS (SELECT CASE WHEN k-j < 1 OR n-k < 1 THEN 10.0::DOUBLE WHEN share > 0 THEN least(1000.0, greatest(1.0, 1/share-1)) ELSE 1000.0 END AS s FROM {name}_share)"""


_OP1_SQL = f"""
WITH src AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url,'://')+3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url,'://')+3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
known AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
counted AS (SELECT host, count(good) AS n, coalesce(sum(good),0) AS g FROM src LEFT JOIN known USING (page_id) GROUP BY 1),
parts AS (SELECT *, string_split(host, '.') AS p FROM counted),
twos AS (SELECT *, array_to_string(p[-2:], '.') AS two FROM parts),
hosts AS (SELECT host, n, g,
    CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br') THEN array_to_string(p[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br') THEN two ELSE p[-1] END AS suffix FROM twos),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 0 AS everything, sum(n) AS n, sum(g) AS g FROM domains GROUP BY 1),
{_strength_sql("ks", "suffixes", "everything")},
{_strength_sql("kd", "domains", "suffix")},
{_strength_sql("kh", "hosts", "domain")},
overall AS (SELECT (coalesce(sum(g),0)+1)::DOUBLE/(coalesce(sum(n),0)+2) AS m FROM suffixes),
one AS (SELECT suffix, (g + ks.s*m)/(n + ks.s) AS m1 FROM suffixes, ks, overall),
two_ AS (SELECT domain, suffix, (g + kd.s*m1)/(n + kd.s) AS m2 FROM domains JOIN one USING (suffix), kd),
shape AS (SELECT host, n, g + kh.s*m2 AS a, n - g + kh.s*(1-m2) AS b FROM hosts JOIN two_ USING (domain, suffix), kh),
rated AS (SELECT host, n, 1/(1+exp(-({_digamma_sql("a")} - {_digamma_sql("b")} - 1.645*sqrt({_trigamma_sql("a")} + {_trigamma_sql("b")})))) AS bound FROM shape),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS rn
  FROM (SELECT DISTINCT page_id, host, path FROM src) s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, CASE WHEN round(bound, 9) >= 0.4 THEN 'allow' ELSE 'block' END) AS verdict, r.n AS labelled, round(bound, 6) AS bound
FROM src s JOIN rated r USING (host) LEFT JOIN fits f ON f.rn = 1 AND f.page_id IS NOT DISTINCT FROM s.page_id AND f.host = s.host AND f.path = s.path"""


@query("op1_url_filter", _OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label with its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES).withColumn("bound", F.round("bound", 6))
