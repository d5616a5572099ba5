"""Host reputation from labelled pages, by empirical Bayes.

Labelled pages are counted per host.  A suffix's bad rate is shrunk towards
the rate of all pages, a registered domain's towards its suffix's, and a host's
towards its domain's.  How strongly is estimated at every level from how much
the children differ beyond binomial chance.  The host's posterior is a beta
distribution; pages of a host are blocked if even its lower bound is bad.

Only DataFrame functions are used.  Pages are read twice, urls only: once to
count hosts and once for the verdicts.  The last join has one row per host on
one side, so a hot host's pages are split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    left = F.expr("substring(host, 1, length(host) - length(suffix) - 1)")
    return F.when(F.length(host) <= F.length(suffix), host).otherwise(F.concat_ws(".", F.substring_index(left, ".", -1), suffix))


def _strength(children: DataFrame, parent: str, mean: Column, least: float, most: float) -> DataFrame:
    """Per parent: the pseudo-count of its children's beta prior, by moments."""
    per = children.filter("n > 0").groupBy(parent).agg(
        F.count("*").alias("k"), F.sum("n").alias("sum_n"), F.sum(F.col("n") * F.col("n")).alias("sum_nn"),
        F.sum("bad").alias("sum_bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sum_bb"),
    )
    m = F.col("sum_bad") / F.col("sum_n")
    noise = m * (1 - m)
    spread = F.col("sum_bb") - F.col("sum_n") * m * m
    weight = F.col("sum_n") - F.col("sum_nn") / F.col("sum_n")
    between = (spread - (F.col("k") - 1) * noise) / weight
    strength = F.when((F.col("k") < 2) | (weight <= 0) | (noise <= 0) | (between <= 0), F.lit(most)).otherwise(
        F.least(F.lit(most), F.greatest(F.lit(least), noise / between - 1))
    )
    return per.select(parent, strength.alias("strength"))


def host_counts(pages: DataFrame, outcomes: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Per host of ``pages(url)``: labelled pages and bad ones.  ``outcomes(page_id, bad)`` holds 0 or 1.

    A page with several outcomes is bad if one of them is.  The suffix is the last label, or the longest of ``suffixes``.
    """
    seen = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = (
        pages.select(F.col("page_id"), host_of(F.col("url")).alias("host")).join(seen, "page_id", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    suffix = F.substring_index("host", ".", -1)
    for s in sorted(suffixes or [], key=len):
        suffix = F.when((F.col("host") == s) | F.col("host").endswith("." + s), F.lit(s)).otherwise(suffix)
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def reputations(counts: DataFrame, bound_z: float = 1.645, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """Per host: posterior mean of the bad rate and its lower and upper bound (``bound_z`` standard deviations)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    base = (total[1] + 1.0) / (total[0] + 2.0)
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(mean: Column) -> Column:
        return (F.col("bad") + F.col("strength") * mean) / (F.col("n") + F.col("strength"))

    top = _strength(suffixes.withColumn("everything", F.lit(0)), "everything", F.lit(base), least, most).first()
    top = top["strength"] if top is not None else most
    at_suffix = suffixes.withColumn("strength", F.lit(float(top))).select("suffix", shrunk(F.lit(base)).alias("suffix_mean"))
    at_domain = (
        domains.join(at_suffix, "suffix").join(_strength(domains, "suffix", F.col("suffix_mean"), least, most), "suffix", "left")
        .withColumn("strength", F.coalesce("strength", F.lit(most)))
        .select("domain", shrunk(F.col("suffix_mean")).alias("domain_mean"))
    )
    at_host = (
        counts.join(at_domain, "domain").join(_strength(counts, "domain", F.col("domain_mean"), least, most), "domain", "left")
        .withColumn("strength", F.coalesce("strength", F.lit(most)))
    )
    a = F.col("bad") + F.col("strength") * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return at_host.select(
        "host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), mean.alias("bad_rate"),
        F.greatest(F.lit(0.0), mean - bound_z * deviation).alias("lower"), F.least(F.lit(1.0), mean + bound_z * deviation).alias("upper"),
    )


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host: the rules of the host itself and of the domains above it, ``rules(rule_host, rule_path, rule_verdict)``."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    rule = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"),
    )
    return (
        hosts.select("host", F.explode(above).alias("rule_host")).join(rules, "rule_host")
        .groupBy("host").agg(F.collect_set(rule).alias("rules"))
    )


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], suffixes: list[str] | None = None,
    most_bad: float = 0.5, bound_z: float = 1.645,
) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url)``.

    ``rules`` are (host, path, verdict); of those that fit the longest decides.  Elsewhere a page is blocked if
    the lower bound of its host's bad rate exceeds ``most_bad``.

    - A null url, or one without ``://``, has an empty host and path; the empty host is a host like others, in a suffix of its own.
    - A host without labelled pages has its domain's posterior; with no outcomes at all everything unruled is allowed.
    - Repeated rows get the same verdict, one row each.  A null ``page_id`` has no outcome.  Empty tables give no rows.
    - Columns other than ``page_id`` and ``url`` are not read.
    """
    spark = pages.sparkSession
    table = small_table(spark, [r for r in rules], "rule_host string, rule_path string, rule_verdict string")
    counts = written(host_counts(pages, outcomes, suffixes), "host-counts")
    hosts = reputations(counts, bound_z).join(rules_of_hosts(counts, table), "host", "left")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fitting)
    return own.join(hosts, "host", "left").select(
        "page_id", "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.when(F.col("lower") > most_bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("n_labelled"), F.round("bad_rate", 6).alias("bad_rate"), F.round("lower", 6).alias("bad_rate_lower"),
    )
