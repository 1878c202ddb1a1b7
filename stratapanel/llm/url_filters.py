"""URL filters by host reputation, with DataFrame functions only.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix.  Each level's rate has a beta prior
whose mean is the posterior mean of the level above and whose strength is fitted to the spread of the rates
inside the parents (analysis of variance).  A host passes if the lower bound of its posterior
rate reaches a threshold, so hosts without labels are judged by their domain and suffix.  Listed rules
come before the reputation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.runtime import materialize


@dataclass(frozen=True)
class ReputationParams:
    """``z``: normal quantile of the one-sided bound; ``least``: bound that a host must reach; strengths lie between the two limits."""

    z: float = 1.645
    least: float = 0.4
    weakest: float = 1.0
    strongest: float = 1000.0
    double_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    has = F.coalesce(at > 0, F.lit(False))
    tail = F.substr(url, at + 3)
    host = F.when(has, lower_ascii(F.regexp_extract(tail, "^[^/?#]*", 0))).otherwise("")
    path = F.when(has, F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host, path, verdict) and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the last test is the outermost
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column, double_suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """Registered domain (suffix and one label) and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    double = two.isin(list(double_suffixes))
    return F.when(double, F.substring_index(host, ".", -3)).otherwise(two), F.when(double, two).otherwise(F.substring_index(host, ".", -1))


def _strength(children: DataFrame, parent: str, params: ReputationParams) -> float:
    """Strength of the prior of children (n, g) below their parents, by the analysis of variance of their rates."""
    rated = children.where("n > 0").withColumn("p", F.col("g") / F.col("n"))
    groups = rated.groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("g").alias("g"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("g") * F.col("p")).alias("gp"),
    )
    between = F.col("gp") - F.col("g") * F.col("g") / F.col("n")
    within = F.col("g") - F.col("gp")
    k, j, n, nn, b, w = groups.agg(
        F.coalesce(F.sum("k"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("nn") / F.col("n")), F.lit(0.0)),
        F.coalesce(F.sum(between), F.lit(0.0)), F.coalesce(F.sum(within), F.lit(0.0)),
    ).first()
    if k - j < 1 or n - k < 1:
        return 10.0
    msb, msw, size = b / (k - j), w / (n - k), (n - nn) / (k - j)
    total = msb + (size - 1) * msw
    share = (msb - msw) / total if total > 0 else 0.0
    return min(params.strongest, max(params.weakest, 1 / share - 1)) if share > 0 else params.strongest


def _digamma(x: Column) -> Column:
    y = x + 6
    steps = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - steps


def _trigamma(x: Column) -> Column:
    y = x + 6
    steps = sum((1 / ((x + i) * (x + i)) for i in range(1, 6)), 1 / (x * x))
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) + steps


def posterior_bound(a: Column, b: Column, z: float) -> Column:
    """Lower bound of a beta-distributed rate, from the mean and variance of its log odds."""
    return 1 / (1 + F.exp(-(_digamma(a) - _digamma(b) - z * F.sqrt(_trigamma(a) + _trigamma(b)))))


def host_reputation(pages: DataFrame, params: ReputationParams) -> DataFrame:
    """(host, n, g, rate, bound) from rows (host, good); rows without an outcome only name their host."""
    domain, suffix = domain_and_suffix(F.col("host"), params.double_suffixes)
    counted = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0).cast("long")).alias("g"))
    hosts = materialize(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "g"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    n, g = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()
    by_suffix = _strength(suffixes.withColumn("all", F.lit(0)), "all", params)
    by_domain, by_host = _strength(domains, "suffix", params), _strength(hosts, "domain", params)
    mean = lambda strength, above: (F.col("g") + strength * above) / (F.col("n") + strength)
    rated = suffixes.select("suffix", mean(by_suffix, F.lit((g + 1) / (n + 2))).alias("m1"))
    middle = domains.join(rated, "suffix").select("domain", "suffix", mean(by_domain, F.col("m1")).alias("m2"))
    shape = hosts.join(middle, ["domain", "suffix"]).select(
        "host", "n", "g", (F.col("g") + by_host * F.col("m2")).alias("a"), (F.col("n") - F.col("g") + by_host * (1 - F.col("m2"))).alias("b")
    )
    return shape.select("host", "n", "g", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), posterior_bound(F.col("a"), F.col("b"), params.z).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], params: ReputationParams | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, labelled (pages of the host), bound.

    ``outcomes`` has the id and a boolean ``good``; of several outcomes of an id all must be good, null ones have no say.
    Addresses without a host share the empty host.  Without outcomes all hosts have a rate around one half.  Repeated rows are judged row by
    row and count as often; null ids have no outcome.  An empty table gives an empty result.  Only the named columns are read.
    """
    params = params or ReputationParams()
    host, path = host_and_path(F.col("url"))
    source = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("good").isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min("good").alias("good"))
    hosts = host_reputation(source.join(known, "id", "left").select("host", "good"), params)
    rule, listed = rule_of(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.round("bound", 9) >= params.least, "allow").otherwise("block")
    judged = source.join(hosts, "host")
    return judged.select(F.col("id").alias(id_column), "host", "path", rule.alias("rule"), F.coalesce(listed, learnt).alias("verdict"), F.col("n").alias("labelled"), "bound")
