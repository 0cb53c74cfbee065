"""URL filters: rules on hosts and paths, and empirical-Bayes reputations of hosts.

Method: labelled page outcomes are counted per host, registered domain and suffix. From the top down, each level is
shrunk to the one above by a beta-binomial prior whose strength is found from the spread of the level's own rates
(moments). A host is blocked if the lower bound of its posterior share of bad pages is above the limit, by default the
share of bad ones among all labelled pages; hosts without labels stand on their domain's posterior as prior. Rules come before the method; the longest that fits wins.

Scale: counts are aggregated on the map side before any shuffle. Rules are literals in the plan. Only blocked hosts are
looked up, broadcast when few and joined by sort-merge otherwise, where adaptive execution splits a hot host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small

ALLOW, BLOCK = "allow", "block"
#: Second labels under which names are registered where the last label is a country's.
_SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """A rule from its text: the host up to the first slash, and the path from there."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


@dataclass(frozen=True)
class Reputation:
    """limit: share of bad pages that the posterior bound must exceed; None: the overall share. z: standard deviations by
    which the bound lies below the posterior mean (0.5: some 70 in 100 to be worse than the limit).

    least, most: strengths of priors that are believed.
    """

    limit: float | None = None
    z: float = 0.5
    least: float = 2.0
    most: float = 1000.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(raw) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (verdict, rule); null if none fits. Equal lengths: the first by text."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.text))
    out = None
    for r in order:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict: string, rule: string>")


def suffix_domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain: the last label (two where a country's second level is open) and one label more.

    User names and a port are not part of them; of numeric addresses both are the whole; a dot at the end goes.
    """
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    numeric = host.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")
    parts = F.split(host, r"\.")
    n = F.size(parts)
    two = (n >= 3) & (F.char_length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*_SECOND)
    k = F.when(two, 2).otherwise(1)
    last = lambda m: F.array_join(F.slice(parts, F.greatest(n - m + 1, F.lit(1)), F.least(m, n)), ".")
    return F.when(numeric, host).otherwise(last(k)), F.when(numeric, host).otherwise(last(k + 1))


def _strength(level: DataFrame, p: Reputation) -> float:
    """Prior strength for units (n, b, mean above): moments of the beta-binomial, over units with two labels or more."""
    rate = F.col("b") / F.col("n")
    m = F.col("m")
    got = level.filter("n >= 2").agg(
        F.sum(F.col("n") * F.pow(rate - m, 2)), F.sum(F.col("n") * m * (1 - m)), F.sum(m * (1 - m)), F.sum("n")
    ).first()
    if not got[3] or got[1] <= 0:
        return p.least
    seen, whole, one = got[0] / got[3], got[1] / got[3], got[2] / got[3]
    between = (seen - one) / max(whole - one, 1e-12)  # share of the variance that lies between units
    return float(min(p.most, max(p.least, 1 / between - 1))) if between > 0 else p.most


def reputations(pages: DataFrame, outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """(host, n, bad, mean, bound, share) for every host of pages (_key, _host); outcomes are (_key, bad), bad 0 or 1.

    share is that of bad ones among all labelled pages.
    """
    seen = pages.join(outcomes, "_key").groupBy("_host").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    hosts = pages.groupBy("_host").agg(F.lit(1).alias("_one")).drop("_one").join(seen, "_host", "left").na.fill(0, ["n", "b"])
    suffix, domain = suffix_domain(F.col("_host"))
    hosts = cut(hosts.select("_host", suffix.alias("_suffix"), domain.alias("_domain"), "n", "b"))
    total = hosts.agg(F.sum("n"), F.sum("b")).first()
    start = total[1] / total[0] if total[0] else 0.0
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b")]
    shrunk = lambda k: ((F.col("b") + k * F.col("m")) / (F.col("n") + k))
    suffixes = cut(hosts.groupBy("_suffix").agg(*sums).withColumn("m", F.lit(float(start))))
    above = cut(suffixes.select("_suffix", shrunk(_strength(suffixes, p)).alias("m")))
    domains = cut(join_small(hosts.groupBy("_suffix", "_domain").agg(*sums), above, ["_suffix"]))
    above = cut(domains.select("_domain", shrunk(_strength(domains, p)).alias("m")))
    hosts = join_small(hosts.select("_host", "_domain", "n", "b"), above, ["_domain"])
    k = _strength(hosts, p)
    a, z = F.col("b") + k * F.col("m"), F.col("n") - F.col("b") + k * (1 - F.col("m"))
    mean = a / (a + z)
    sd = F.sqrt(mean * (1 - mean) / (a + z + 1))
    return hosts.select(F.col("_host").alias("host"), "n", F.col("b").alias("bad"), mean.alias("mean"), F.greatest(F.lit(0.0), mean - p.z * sd).alias("bound"), F.lit(float(start)).alias("share"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], p: Reputation = Reputation(), url: str = "url", row: str = "page_id", key: Column | None = None) -> DataFrame:
    """One row per row of pages: row, host, path, rule, verdict.

    outcomes: (key, bad), labelled pages by what key gives of a page (none: its id, and their column is named so); null keys
    and outcomes count nothing, a page labelled twice counts twice. Null urls and urls without `://` have empty host and
    path; the empty host has a reputation like any other. Hosts keep user names, ports and dots at their end, as rules and
    output have them; their registered domains do not. Without outcomes all that no rule blocks is allowed. Repeated rows
    are each returned; empty tables give empty results.
    """
    host, path = host_path(F.col(url))
    named = row if key is None else "key"
    rows = pages.select(F.col(row).alias("_id"), (F.col(row) if key is None else key).alias("_key"), host.alias("_host"), path.alias("_path"))
    known = outcomes.select(F.col(named).alias("_key"), F.col("bad").cast("long").alias("bad")).filter("_key is not null and bad is not null")
    above = F.col("bound") > (F.col("share") if p.limit is None else F.lit(p.limit))
    blocked = cut(reputations(rows, known, p).filter(above).select(F.col("host").alias("_host"), F.lit(BLOCK).alias("_method")))
    rows = join_small(rows.withColumn("_rule", _fitting(F.col("_host"), F.col("_path"), rules)), blocked, ["_host"])
    return rows.select(
        F.col("_id").alias(row), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.col("_method"), F.lit(ALLOW)).alias("verdict"),
    )
