"""URL filters: rules on hosts and paths, and an empirical-Bayes reputation of hosts for what no rule decides.

A host's labelled outcomes (good or bad pages) are shrunk through beta-binomial priors: the corpus mean is the prior of each
suffix, a suffix's posterior mean that of its registered domains, a domain's that of its hosts. The strength of each level's
prior is estimated from the spread between its groups (moments of the beta-binomial distribution). A host is blocked when even
the upper bound of its posterior stays under the threshold.

Only aggregates by host, domain and suffix are shuffled (partial sums first, so a hot host costs one row per task), and the
driver gets three sums per level. Pages meet their host's verdict in an equi-join that AQE can split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Second-level labels that belong to the suffix under a two-letter country code. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: (action, host/path) rules of the production query. Fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path starts the path; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last label, or the last two under a country code with a known second level; an address without letters is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.regexp_extract(bare, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(bare.rlike(r"^[0-9.]*$"), bare).when(two != "", two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it; the suffix itself if there is none."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    rest = F.when(F.length(bare) > F.length(suffix), F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)).otherwise("")
    return F.when(rest == "", suffix).otherwise(F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix))


def _strength(level: DataFrame) -> tuple[float, float]:
    """(mean, prior strength) of a table of groups with n outcomes, k of them good. Sums only reach the driver."""
    x = level.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    ).first()
    if not x["g"]:
        return 0.5, 2.0
    g, n, k, nn, kk = (float(x[c]) for c in ("g", "n", "k", "nn", "kk"))
    m = k / n
    v, left = m * (1 - m), n - nn / n - (g - 1)
    phi = (kk - n * m * m - (g - 1) * v) / (left * v) if v > 0 and left > 0 else 0.0
    phi = min(0.999, max(0.001, phi))
    return m, (1 - phi) / phi


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, registered_domain, suffix, labelled, good, posterior_mean, lower, upper) for every host of pages(page_id, host).

    outcomes(page_id, good): repeated rows count as repeated outcomes, null good or page_id as none. Hosts without outcomes get
    their domain's posterior mean as prior. Without any outcome all means are 0.5.
    """
    good = outcomes.where(F.col("good").isNotNull()).groupBy("page_id").agg(F.count("*").alias("_n"), F.sum(F.col("good").cast("long")).alias("_k"))
    hosts = pages.select("page_id", "host").join(good, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_k"), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("registered_domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "registered_domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (m, of_suffix), (_, of_domain), (_, of_host) = _strength(suffixes), _strength(domains), _strength(hosts)

    def mean(prior: Column, strength: float) -> Column:
        return (F.col("k") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))

    suffixes = suffixes.select("suffix", mean(F.lit(m), of_suffix).alias("_ps"))
    domains = domains.join(suffixes, "suffix").select("registered_domain", "suffix", mean(F.col("_ps"), of_domain).alias("_pd"))
    hosts = hosts.join(domains, ["registered_domain", "suffix"])
    a, b = F.col("k") + F.lit(of_host) * F.col("_pd"), F.col("n") - F.col("k") + F.lit(of_host) * (F.lit(1.0) - F.col("_pd"))
    hosts = hosts.withColumn("_a", a).withColumn("_b", b).withColumn("posterior_mean", F.col("_a") / (F.col("_a") + F.col("_b")))
    sd = F.sqrt(F.col("_a") * F.col("_b") / ((F.col("_a") + F.col("_b")) * (F.col("_a") + F.col("_b")) * (F.col("_a") + F.col("_b") + 1)))
    return hosts.withColumn("_sd", sd).select(
        "host", "registered_domain", "suffix", F.col("n").alias("labelled"), F.col("k").alias("good"), "posterior_mean",
        (F.col("posterior_mean") - z * F.col("_sd")).alias("lower"), (F.col("posterior_mean") + z * F.col("_sd")).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, posterior_mean, upper) for every row of pages.

    A rule decides first; else a host is blocked if its posterior's upper bound is under the threshold. Null urls have host ''
    and path '', which is a host like any other. Repeated rows stay; other columns of pages don't matter.
    """
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = host_reputation(own, outcomes, z).select("host", "posterior_mean", "upper")
    action = F.create_map(*[F.lit(x) for a, r in rules for x in (r, a)]) if rules else F.create_map().cast("map<string,string>")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("upper") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return own.join(known, "host", "left").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.element_at(action, F.col("rule"))).otherwise(judged).alias("verdict"), "posterior_mean", "upper")


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents as outcomes of the pages with the same number: good is high quality and not toxic; null quality is none."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("good"))


def check_math(k: float, n: float, prior: float, strength: float) -> tuple[float, float]:
    """Posterior mean and sd of one group, in plain Python for tests."""
    a, b = k + strength * prior, n - k + strength * (1 - prior)
    return a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
