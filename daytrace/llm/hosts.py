"""Operator 2: URL filter by rules and by an empirical-Bayes reputation of hosts.

Labelled page outcomes (good or not) are counted per host. A beta-binomial prior is fitted at each
level by the method of moments: suffixes shrink to the mean of all outcomes, registered domains to
their suffix, hosts to their domain. A host is allowed if the lower bound of its posterior (mean
less `z` standard deviations) reaches `least`. Hosts without outcomes keep their domain's prior.

Pages are only counted per host (combined before the shuffle) and met with their host's row by a
salted join, so one host may hold any share of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import LOWER, UPPER, cut, salted_join


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")
#: Prior strengths (in outcomes) stay in this range, and a level of one group takes the upper end.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lowered; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits the host or a parent of it and the path."""
    found = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found if rules else F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two of a known suffix; addresses and single labels have none."""
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    plain = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(last)
    return F.when(host.rlike("^[0-9.:]*$") | ~F.contains(host, F.lit(".")), F.lit("")).otherwise(plain)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; a host without suffix, or that is one, is its own domain."""
    return (
        F.when((suffix == "") | (suffix == host), host)
        .when(suffix.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(F.substring_index(host, ".", -2))
    )


def strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row: the beta-binomial strength that the spread of group rates around `mean` shows.

    Moments over groups (n outcomes, k good): what the weighted squared deviations exceed binomial
    noise by gives the correlation rho, and the strength is (1 - rho) / rho within its range.
    """
    n, p, m = F.col("n").cast("double"), F.col("k") / F.col("n"), F.col(mean)
    s = groups.where("n > 0").agg(
        F.sum(n * (p - m) * (p - m)).alias("s"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum(n * m * (1 - m)).alias("v"),
        F.sum(n).alias("total"),
        F.sum(n * n).alias("squares"),
        F.count(F.lit(1)).alias("groups"),
    )
    unit = F.col("v") / F.col("total")
    room = unit * (F.col("total") - F.col("squares") / F.col("total") - (F.col("groups") - 1))
    rho = F.when((F.col("groups") > 1) & (room > 0), (F.col("s") - F.col("noise") * (F.col("groups") - 1) / F.col("groups")) / room)
    least = 1 / (1 + STRONGEST)
    bounded = F.least(F.greatest(F.coalesce(rho, F.lit(least)), F.lit(least)), F.lit(1 / (1 + WEAKEST)))
    return s.select(((1 - bounded) / bounded).alias("strength"))


def reputation(outcomes: DataFrame, z: float = 1.645, least: float = 0.5) -> DataFrame:
    """host, n, k, bound, good from rows (host, n labelled outcomes, k good ones); rows of a host add up.

    Without any outcome the overall mean is one half.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host")))
    # Each level is used several times below; its rows go to the shared folder once.
    hosts = cut(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("overall"))

    def one(df: DataFrame) -> Column:
        return df.scalar()

    def shrunk(df: DataFrame, mean: str, into: str) -> DataFrame:
        known = one(strength(df, mean))
        return df.withColumn("strength", known).withColumn(
            into, (F.col("k") + F.col("strength") * F.col(mean)) / (F.col("n") + F.col("strength"))
        )

    suffixes = shrunk(cut(suffixes.withColumn("overall", one(overall))), "overall", "suffix_mean").select("suffix", "suffix_mean")
    domains = shrunk(cut(domains.join(suffixes, "suffix")), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    judged = shrunk(cut(hosts.join(domains, "domain")), "domain_mean", "mean")
    size = F.col("n") + F.col("strength")
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return judged.select("host", "n", "k", bound.alias("bound"), (bound >= least).alias("good"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: key, host, path, rule, verdict, and n, k, bound of its host.

    `outcomes` has rows (key, good 0 or 1); those without a page or a value count nowhere, several
    of one key all count. Null or odd urls have an empty host, which has a reputation like any other.
    """
    parts = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    votes = outcomes.where(F.col("good").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_vote"))
    votes = votes.agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
    voted = parts.join(votes, F.col("_key") == F.col("_vote"), "left")
    counts = voted.groupBy("host").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("k"))
    met = salted_join(parts, reputation(counts), ["host"], ["_key", "path"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = met.withColumn("_rule", rule)
    return judged.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("good"), F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        F.col("n").alias("n_outcomes"),
        F.col("k").alias("n_good"),
        "bound",
    )
