"""Operator 4: URL filters by rules and empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (good, bad) are counted by host, registered domain and suffix. Each level's rate has a beta prior
centred on the posterior rate of the level above, its strength fitted from the spread of rates at that level (method of
moments). A url that no rule fits is blocked if the lower bound of its host's posterior bad rate is above the threshold: the
overall bad rate, unless one is given, so that hosts certainly worse than the average go, whatever the average is.
Reputation belongs to a host's name, without user information and port; an address in numbers is its own domain and suffix.
A host's outcomes also count in the means of its domain and suffix, which are its prior.

Defined results: null urls and urls without '://' have an empty host and path, fit no rule and are judged by the overall
rate. Repeated rows are judged each. Several rules of one length: the later of (host, path) in order wins. Hosts without
labels take their domain's rate, then their suffix's, then the overall one. An empty table of labels allows all, an empty
table of pages gives an empty one. Urls may be of any length. Input columns named host, path, rule, verdict, rate or bound are
replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.lines import LOWER, UPPER
from catalith.session import unused, written

#: Suffixes of two labels; all others are the last label. The default of a parameter, which takes a longer list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def name_of(host: Column) -> Column:
    """The host without user information and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. rules: a list that a person keeps, some thousands at most."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        said = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out


def with_levels(df: DataFrame, host: str = "host", two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Adds suffix and domain of the host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    wide = F.when(n >= 2, F.concat_ws(".", F.slice(labels, -2, 2)))
    two = F.coalesce(wide.isin(*two_label), F.lit(False)) if two_label else F.lit(False)
    number = F.col(host).rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z") | F.col(host).startswith("[")
    suffix = F.when(number, F.col(host)).when(two, wide).otherwise(F.element_at(labels, -1))
    k = F.when(two, F.lit(3)).otherwise(F.lit(2))
    domain = F.when(number | (n <= k), F.col(host)).otherwise(F.concat_ws(".", F.slice(labels, -k, k)))
    return df.withColumn("suffix", suffix).withColumn("domain", domain)


def _strength(counts: DataFrame, mean: Column, most: float = 1000.0) -> float:
    """Prior strength a + b of a level by moments: between-group spread against what binomial noise alone would give. One row comes back."""
    n, bad = F.col("good") + F.col("bad"), F.col("bad")
    seen = counts.where(n > 0).select(n.alias("n"), (bad / n).alias("r"), mean.alias("m"))
    s = seen.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2).alias("ss"), F.sum(F.col("m") * (1 - F.col("m"))).alias("v"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("nv"), F.count(F.lit(1)).alias("k")).first()
    if not s["k"] or not s["nv"]:
        return most
    # E[ss] = sum v + rho * sum (n - 1) v, rho = 1 / (strength + 1)
    room = s["nv"] - s["v"]
    rho = (s["ss"] - s["v"]) / room if room > 0 else 0.0
    return min(most, max(0.5, 1 / rho - 1)) if rho > 0 else most


def reputation(outcomes: DataFrame, z: float = 1.64, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """From outcomes (host, bad 0/1): tables of hosts, domains, suffixes with rate, lower bound; and the overall rate.

    Counts are summed before any shuffle; one row of sums a level comes to the driver."""
    b = F.col("bad").cast("double")
    named = outcomes.where(F.col("host").isNotNull()).groupBy(name_of(F.col("host")).alias("host")).agg(F.sum(1 - b).alias("good"), F.sum(b).alias("bad"))
    hosts, _ = written(with_levels(named, two_label=two_label))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0.0) / ((total["good"] or 0.0) + (total["bad"] or 0.0)) if total["bad"] else 0.0

    def posterior(df: DataFrame, mean: Column, strength: float) -> DataFrame:
        alpha, beta = mean * strength + F.col("bad"), (1 - mean) * strength + F.col("good")
        n = alpha + beta
        rate = alpha / n
        return df.withColumn("rate", rate).withColumn("bound", rate - z * F.sqrt(rate * (1 - rate) / (n + 1)))

    suffixes = posterior(suffixes, F.lit(overall), _strength(suffixes, F.lit(overall)))
    above = suffixes.select("suffix", F.col("rate").alias("above"))
    domains = domains.join(above, "suffix")
    domains = posterior(domains, F.col("above"), _strength(domains, F.col("above"))).drop("above")
    above = domains.select("domain", F.col("rate").alias("above"))
    hosts = hosts.join(above, "domain")
    hosts = posterior(hosts, F.col("above"), _strength(hosts, F.col("above"))).drop("above")
    return hosts, domains, suffixes, overall


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule], threshold: float | None = None, z: float = 1.64, url: str = "url", two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES
) -> DataFrame:
    """pages with host, path, rule, verdict, rate and bound (of the most specific level that has labels).

    outcomes: host, bad. threshold: None for the overall rate. The joins are on the distinct host names of pages, then one
    on the name, whose hot keys AQE splits."""
    clash = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict", "rate", "bound")]
    pages = pages.drop(*clash).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    name, rep, said = unused([*pages.columns, "rule", "verdict", "rate", "bound"], "name", "rep", "said")
    hosts, domains, suffixes, overall = reputation(outcomes, z, two_label)
    mine = with_levels(pages.select(name_of(F.col("host")).alias("host")).distinct(), two_label=two_label)
    pick = lambda df, k: df.select(k, F.struct("rate", "bound").alias(f"of_{k}"))
    mine = mine.join(pick(hosts, "host"), "host", "left").join(pick(domains, "domain"), "domain", "left").join(pick(suffixes, "suffix"), "suffix", "left")
    fallback = F.struct(F.lit(overall).alias("rate"), F.lit(overall).alias("bound"))
    mine, _ = written(mine.select(F.col("host").alias(name), F.coalesce("of_host", "of_domain", "of_suffix", fallback).alias(rep)))
    # written, so that both sides of the join are plain shuffles and AQE can split a hot host
    out = pages.join(mine.hint("merge"), name_of(F.col("host")) == F.col(name), "left").withColumn(said, fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col(f"{rep}.bound") > (overall if threshold is None else threshold), "block").otherwise("allow")
    out = out.withColumn("rule", F.col(f"{said}.rule")).withColumn("verdict", F.coalesce(f"{said}.verdict", method))
    return out.withColumn("rate", F.col(f"{rep}.rate")).withColumn("bound", F.col(f"{rep}.bound")).drop(name, rep, said)
