"""Web addresses judged by rules and by host reputation, built of SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestat.llm.decontamination import lower_ascii

LEAST_GOOD = 0.5   # a page stays when its host's share of good pages is at least this,
SURE = 1.645       # so many standard deviations below the posterior mean
# Suffixes of two labels, under which names are registered (fixed values).
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za", "com.mx")


@dataclass(frozen=True)
class Rule:
    """A host, all its subdomains and the paths starting with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); NULL without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_domain(df: DataFrame) -> DataFrame:
    """Adds `domain`, the registered domain of `host`, and `suffix`, what it is registered under."""
    parts, labels = F.split("host", r"\."), F.size(F.split("host", r"\."))
    two = F.concat_ws(".", F.slice(parts, F.greatest(labels - 1, F.lit(1)), 2))
    deep = F.when(two.isin(*SECOND_LEVEL), 2).otherwise(1)
    last = lambda n: F.concat_ws(".", F.slice(parts, F.greatest(labels - n + 1, F.lit(1)), n))
    number = F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$")
    return df.withColumns({
        "domain": F.when(number, F.col("host")).otherwise(last(deep + 1)),
        "suffix": F.when(number, F.col("host")).otherwise(last(deep))})


def _strength(children: DataFrame) -> float:
    """Pseudo-counts of the beta prior of `children` (n, good, mean of the parent), by moments."""
    p, mean = F.col("good") / F.col("n"), F.col("mean")
    row = children.where("n > 0 and mean > 0 and mean < 1").agg(
        F.sum(F.col("n") * (p - mean) ** 2 / (mean * (1 - mean))).alias("spread"), F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).first()
    if not row["k"]:
        return 1.0
    room = row["n"] - row["squares"] / row["n"] - (row["k"] - 1)
    share = (row["spread"] - (row["k"] - 1)) / room if room > 0 else 0.0
    share = min(max(share, 0.001), 0.99)
    return (1 - share) / share


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, good, mean, low) of every host of `outcomes` (host, good: 1, 0 or NULL).

    Good and labelled pages are counted per host, per registered domain and per
    suffix. The rate of all labelled pages is the prior mean of a suffix, a
    suffix's posterior mean that of its domains, a domain's that of its hosts;
    how strongly each level is drawn to its parent is fitted by the moments of a
    beta-binomial over that level. `low` lies SURE standard deviations of the
    host's beta posterior below its mean. A host without labels has the
    posterior of its domain. Without any label the rate is 0.5.
    """
    hosts = with_domain(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else 0.5

    def posterior(children: DataFrame) -> DataFrame:
        m = F.lit(_strength(children))
        size = F.col("n") + m
        return children.withColumn("mean", (F.col("good") + m * F.col("mean")) / size).withColumn("size", size)

    def level(key: str) -> DataFrame:
        return hosts.groupBy(*dict.fromkeys([key, "suffix"])).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    suffixes = posterior(level("suffix").withColumn("mean", F.lit(rate))).select("suffix", "mean")
    domains = posterior(level("domain").join(suffixes, "suffix")).select("domain", "mean")
    found = posterior(hosts.join(domains, "domain"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return found.select("host", "n", "good", "mean", (F.col("mean") - F.lit(SURE) * spread).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, least: float = LEAST_GOOD) -> DataFrame:
    """Every page's host, path, rule and verdict: page_id, host, path, rule, verdict, low.

    The longest rule that fits decides; else the page is allowed when the lower
    posterior bound of its host's share of good pages is at least `least`.
    `outcomes` (page_id, good) labels some of the pages; repeated labels of a
    page count as the worst, unknown pages are ignored. A NULL url, or one
    without `://`, has empty host and path and is judged like a host of its own.
    Repeated rows of `pages` stay; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.where("page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    hosts = reputation(rows.select("page_id", "host").join(labels, "page_id", "left")).select("host", "low")
    found = rows.join(hosts, "host").withColumn("hit", matched_rule(rules, F.col("host"), F.col("path")))
    own = F.when(F.col("low") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "low")
