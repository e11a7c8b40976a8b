"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. A host's rate is shrunk to that of its
registered domain, the domain's to its suffix's, the suffix's to the corpus': each level has a
beta-binomial prior around its parent's posterior mean, with a strength estimated from the
counts themselves (analysis of variance, the method of moments). A host is blocked where the
lower bound of its posterior is over the accepted rate of bad pages.

All DataFrame expressions. The counts are pre-aggregated per partition, so a host with a third
of all pages is one row per partition; the join back lets Spark split such a host.

Cases: a null url or one without ``://`` has empty host and path, fits no rule, and is judged by
the corpus' rate alone; pages without a label count for no host but are judged, a host without
any by its domain's rate, else its suffix's, else the corpus'; repeated rows keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outways.llm.store import written

#: (host, path, verdict); a rule fits its host and all its subdomains, the longest that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Accepted rate of bad pages, and standard deviations from the mean to the lower bound.
ACCEPTED, DEVIATIONS = 0.3, 1.645
#: Second-level labels under which names are registered, where the last label has two letters.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu", "ne", "or")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last, second = F.get(parts, n - 1), F.get(parts, n - 2)
    return F.when((n >= 3) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL), F.concat(second, F.lit("."), last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one more label; the host where there is none."""
    parts, labels = F.split(host, r"\."), F.size(F.split(suffix, r"\.")) + 1
    return F.when(F.size(parts) > labels, F.array_join(F.slice(parts, -labels, labels), ".")).otherwise(host)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): one row per page whose path names a labelled document; bad where that is of low
    quality or toxic."""
    outcome = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).filter("bad is not null and doc_id is not null")
    named = pages.select(host_of(F.col("url")).alias("host"), F.expr("try_cast(regexp_extract(url, '://[^/?#]*[^?#]*?/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return named.join(outcome, "doc_id").select("host", "bad")


def _strength(groups: DataFrame, parent_mean: Column) -> DataFrame:
    """One row: ``k``, the prior strength of a level, from (n, bad) per group and the parent's mean."""
    p = parent_mean
    sums = groups.filter("n > 0").agg(
        F.count("*").cast("double").alias("g"),
        F.sum("n").cast("double").alias("t"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("t2"),
        F.sum(F.try_divide((F.col("bad") - F.col("n") * p) * (F.col("bad") - F.col("n") * p), F.col("n") * p * (1 - p))).alias("q"),
    )
    size = F.try_divide(F.col("t") - F.try_divide(F.col("t2"), F.col("t")), F.col("g") - 1)
    rho = F.try_divide(F.try_divide(F.col("q"), F.col("g") - 1) - 1, size - 1)
    # Groups no more unlike than chance gives: the strongest prior; fewer than two: a weak one.
    return sums.select(
        F.when((F.col("g") < 2) | F.coalesce(size <= 1.0, F.lit(True)), F.lit(10.0))
        .when(rho <= 0.001, F.lit(1000.0))
        .otherwise(F.greatest(F.lit(1.0), F.try_divide(F.lit(1.0), F.least(rho, F.lit(0.999))) - 1))
        .alias("k")
    )


def levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The posteriors of ``outcomes`` (host, bad): hosts (host, n, bad, mean, weight); then, for
    hosts without outcomes, domains (domain, mean, weight), suffixes (suffix, mean, weight) and the
    corpus (mean, weight). There ``weight`` is the prior strength of the level below."""
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    # Written level by level: each is read several times, and the plan would grow with every read.
    hosts = written(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    corpus = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m0"))
    total = lambda key: hosts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(groups: DataFrame, mean: str, out: str) -> tuple[DataFrame, DataFrame]:
        # The strength is a single row.
        k = _strength(groups, F.col(mean))
        return groups.join(F.broadcast(k)).withColumn(out, (F.col("bad") + F.col("k") * F.col(mean)) / (F.col("n") + F.col("k"))), k

    suffixes, _ = shrunk(total(["suffix"]).join(F.broadcast(corpus)), "m0", "m1")
    suffixes = written(suffixes.select("suffix", "m1"), "suffixes")
    domains, k2 = shrunk(total(["suffix", "domain"]).join(suffixes, "suffix"), "m1", "m2")
    domains = written(domains.select("domain", "m2"), "domains")
    judged, k3 = shrunk(hosts.join(domains, "domain"), "m2", "mean")
    prior = lambda groups, key, mean, k: groups.join(F.broadcast(k)).select(*key, F.col(mean).alias("mean"), F.col("k").alias("weight"))
    return (
        judged.select("host", "n", "bad", "mean", (F.col("n") + F.col("k")).alias("weight")),
        prior(domains, ["domain"], "m2", k3),
        prior(suffixes, ["suffix"], "m1", k2),
        corpus.select(F.col("m0").alias("mean"), F.lit(10.0).alias("weight")),
    )


def lower_of(mean: Column, weight: Column) -> Column:
    return F.greatest(F.lit(0.0), mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (weight + 1)))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower) for each host in ``outcomes`` (host, bad), and one row with a
    null host for those of an unknown suffix: (n 0, the corpus' mean and bound)."""
    judged, _, _, corpus = levels(outcomes)
    none = F.lit(0).cast("long")
    unknown = corpus.select(F.lit(None).cast("string").alias("host"), none.alias("n"), none.alias("bad"), "mean", "weight")
    return judged.unionByName(unknown).select("host", "n", "bad", "mean", lower_of(F.col("mean"), F.col("weight")).alias("lower"))


def judged_pages(pages: DataFrame, labels: DataFrame, rules=RULES, accepted: float = ACCEPTED) -> DataFrame:
    """page_id, host, path, rule, verdict for each page; then n, bad, mean, lower of its host."""
    hosts, domains, suffixes, corpus = levels(labelled_outcomes(pages, labels))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Each host once: its own posterior, or the nearest one above it.
    named = own.groupBy("host").agg(F.lit(1).alias("one")).join(hosts, "host", "left")
    named = named.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    above = lambda level, i: level.withColumnsRenamed({"mean": f"mean{i}", "weight": f"weight{i}"})
    named = named.join(above(domains, 2), "domain", "left").join(above(suffixes, 1), "suffix", "left").join(F.broadcast(above(corpus, 0)))
    known = named.select("host", "n", "bad", *[F.coalesce(*[F.when(F.col("host") != "", F.col(f"{c}{i}")) for i in ("", 2, 1)], f"{c}0").alias(c) for c in ("mean", "weight")])
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    scored = own.join(known, "host")
    lower = lower_of(F.col("mean"), F.col("weight"))
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(lower > accepted, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_labelled"), F.coalesce("bad", F.lit(0).cast("long")).alias("n_bad"),
        F.round("mean", 6).alias("bad_rate"), F.round(lower, 6).alias("bad_rate_bound"),
    )
