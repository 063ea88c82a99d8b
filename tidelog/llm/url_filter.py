"""URL filters: explicit rules first, then the reputation of the host.

Reputation is empirical Bayes. Labelled page outcomes are counted per host; a
beta-binomial prior shrinks each suffix towards all pages, each registered
domain towards its suffix, and each host towards its domain. The strength of
each prior is estimated from the counts (method of moments). A page is blocked
if the upper posterior bound of its host's rate of good pages is too low.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lookup, table

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

MIN_GOOD = 0.6
Z = 1.645  # one-sided 95 %
LEAST_RHO, MOST_RHO = 0.001, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null URL and one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls. Of equally long rules the first wins."""
    rule = verdict = F.lit(None).cast("string")
    for says, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shrunk(groups: DataFrame, key: str, parent: str) -> DataFrame:
    """Posterior of each group about its parent's mean.

    ``groups`` has ``key``, ``n`` labelled, ``good`` of them, and the
    ``parent`` mean. Adds ``<key>_mean`` and ``<key>_weight``. The intra-class
    correlation rho solves E[sum n (p - mean)^2] = V + rho W with
    V = sum mean (1 - mean) and W = sum mean (1 - mean) (n - 1), over groups with labels.
    """
    mu, n, good = F.col(parent), F.col("n"), F.col("good")
    noise = mu * (1 - mu)
    seen = groups.filter("n > 0")
    fit = seen.agg(
        F.coalesce(F.sum((good - n * mu) * (good - n * mu) / n), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(noise), F.lit(0.0)).alias("v"),
        F.coalesce(F.sum(noise * (n - 1)), F.lit(0.0)).alias("w"),
    )
    rho = F.when(F.col("w") > 0, F.least(F.greatest((F.col("s") - F.col("v")) / F.col("w"), F.lit(LEAST_RHO)), F.lit(MOST_RHO))).otherwise(MOST_RHO)
    strength = fit.select(((1 - rho) / rho).alias("strength"))  # one row
    return (
        groups.join(F.broadcast(strength))
        .withColumn(f"{key}_weight", n + F.col("strength"))
        .withColumn(f"{key}_mean", (good + F.col("strength") * mu) / F.col(f"{key}_weight"))
        .drop("strength")
    )


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per host of ``pages`` (``page_id``, ``host``): labelled and good pages, posterior mean and upper bound.

    ``labels`` has ``page_id`` and ``good`` (0/1; rows with nulls don't
    count); several labels of a page count each. Hosts without labels get
    their domain's posterior, an unseen suffix that of all pages, and with no
    label at all every mean is one half. The domain is a host's last two
    labels, the suffix its last.
    """
    counted = pages.join(labels.filter("page_id IS NOT NULL AND good IS NOT NULL"), "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = table(  # read by each level below
        pages.select("host").distinct().join(counted, "host", "left").select(
            "host",
            F.substring_index("host", ".", -2).alias("domain"),
            F.substring_index("host", ".", -1).alias("suffix"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("good", F.lit(0)).alias("good"),
        ),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    overall = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("all_mean"))
    suffixes = shrunk(hosts.groupBy("suffix").agg(*sums).join(F.broadcast(overall)), "suffix", "all_mean").select("suffix", "suffix_mean")
    domains = shrunk(hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix"), "domain", "suffix_mean").select("domain", "domain_mean")
    ranked = shrunk(hosts.join(domains, "domain"), "host", "domain_mean")
    mean, weight = F.col("host_mean"), F.col("host_weight")
    return ranked.select("host", "n", "good", "host_mean", F.least(F.lit(1.0), mean + Z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("host_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """A verdict per page (``page_id``, ``url``): ``allow`` or ``block`` by rule, else by host reputation.

    Every row of ``pages`` gives one row, repeated and null ones too. Host
    and path of a null URL, or one without ``://``, are empty; the empty host
    is judged like any other.
    """
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(parted.select("page_id", "host"), labels)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    return lookup(parted, reputation, "host").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("host_bound") < min_good, "block").otherwise("allow")).alias("verdict"),
        F.round("host_bound", 6).alias("host_bound"),
    )
