"""Empirical-Bayes host reputation for URL filtering, in DataFrame expressions only.

Labelled page outcomes (1 bad, 0 good) are counted by host, registered domain and suffix. A beta-binomial prior passes
down: the suffix is shrunk to the global rate, the domain to its suffix's posterior mean, the host to its domain's; the
strength of each prior is estimated by moments from the spread of the rates below it. A host is blocked when the lower
credible bound of its bad rate is at least ``threshold``, so hosts without evidence are allowed unless their domain or
suffix speaks clearly.

For reputation a host stands without user and port. Its suffix is its last label, or its last two where these are a
country's two letters behind a customary second label (co.uk, com.au) or a domain under which anyone may register
(github.io); its domain is the label before that and the suffix. Addresses of digits or in brackets are domains of their
own, under one suffix.

Defined results: a URL that is null or has no ``://`` has host and path '' (a host like any other); letters other than
A-Z keep their case; pages without an outcome count for nothing; an empty table gives an empty result; extra columns of
the pages stay out of the result, repeated page ids each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
#: Second labels under which countries register, and domains under which anyone may, after the public
#: suffix rules that are in common use.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gub", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
OPEN_DOMAINS = (
    "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "github.io", "gitlab.io", "glitch.me", "herokuapp.com",
    "netlify.app", "onrender.com", "pages.dev", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev",
)
ADDRESS = r"^[0-9]+([.][0-9]+){3}$|^\["
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules up to this number become one CASE expression, more become a join.
CASE_RULES = 64
THRESHOLD, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _two_labels(bare: Column) -> Column:
    """Whether the last two labels are a suffix."""
    two = F.substring_index(bare, ".", -2)
    country = F.substring_index(two, ".", -1).rlike("^[a-z]{2}$") & F.substring_index(two, ".", 1).isin(*SECOND_LABELS) & two.contains(".")
    return country | two.isin(*OPEN_DOMAINS)


def suffix_of(host: Column) -> Column:
    bare = bare_host(host)
    return F.when(bare.rlike(ADDRESS), "address").when(_two_labels(bare), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = bare_host(host)
    return F.when(bare.rlike(ADDRESS), bare).when(_two_labels(bare), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def with_rule(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds rule (host and path of the longest that fits, else null) and rule_verdict; needs the columns host and path."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    if len(rules) <= CASE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(by_length):
            fits = _fits(F.col("host"), F.col("path"), r)
            rule, verdict = F.when(fits, F.lit(r[1] + r[2])).otherwise(rule), F.when(fits, F.lit(r[0])).otherwise(verdict)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = pages.sparkSession
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(by_length)], "verdict string, rule_host string, rule_path string, rank int")
    # a rule's host is one of the page's host's ends: an equi-join on distinct (host, path) pairs
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = places.withColumn("rule_host", F.explode(ends)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("rule_verdict")), "rank").alias("hit"))
    return pages.join(best, ["host", "path"], "left").select("*", "hit.rule", "hit.rule_verdict").drop("hit")


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, outcome) rows, outcome 1, 0 or null, to one row per host: n, bad, posterior mean and standard deviation."""
    hosts = outcomes.groupBy("host").agg(F.count("outcome").cast("double").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double").alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"), F.sum(F.col("n") * F.col("n")).alias("dnn"), F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n"))).alias("drr"), F.count(F.when(F.col("n") > 0, 1)).alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"), F.sum(F.col("dn") * F.col("dn")).alias("snn"), F.sum(F.when(F.col("dn") > 0, F.col("dbad") * F.col("dbad") / F.col("dn"))).alias("srr"), F.count(F.when(F.col("dn") > 0, 1)).alias("sk"))
    world = suffixes.agg(F.sum("sn").alias("wn"), F.sum("sbad").alias("wbad"), F.sum(F.col("sn") * F.col("sn")).alias("wnn"), F.sum(F.when(F.col("sn") > 0, F.col("sbad") * F.col("sbad") / F.col("sn"))).alias("wrr"), F.count(F.when(F.col("sn") > 0, 1)).alias("wk"))

    def strength(p: str) -> Column:
        n, bad, nn, rr, k = (F.coalesce(F.col(p + x), F.lit(0)) for x in ("n", "bad", "nn", "rr", "k"))
        mean = bad / F.greatest(n, F.lit(1))
        spread, binomial = rr - n * mean * mean, mean * (1 - mean)
        between = (spread - (k - 1) * binomial) / F.greatest(n - nn / F.greatest(n, F.lit(1)), F.lit(1))
        found = F.when(between > 1e-9, binomial / between - 1).otherwise(F.lit(MOST_STRENGTH))
        return F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), found))

    shrunk = lambda bad, n, mean, k: (F.col(bad) + F.col(mean) * F.col(k)) / (F.col(n) + F.col(k))
    world = world.select(((F.coalesce(F.col("wbad"), F.lit(0)) + 0.5) / (F.coalesce(F.col("wn"), F.lit(0)) + 1)).alias("wmean"), strength("w").alias("ws"))
    suffixes = suffixes.join(F.broadcast(world)).withColumn("smean", shrunk("sbad", "sn", "wmean", "ws")).withColumn("ss", strength("s")).select("suffix", "smean", "ss")
    domains = domains.join(suffixes, "suffix").withColumn("dmean", shrunk("dbad", "dn", "smean", "ss")).withColumn("ds", strength("d")).select("suffix", "domain", "dmean", "ds")
    mean, weight = F.col("mean"), F.col("n") + F.col("ds")
    return (
        hosts.join(domains, ["suffix", "domain"])
        .withColumn("mean", shrunk("bad", "n", "dmean", "ds"))
        .withColumn("sd", F.sqrt(mean * (1 - mean) / (weight + 1)))
        .select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "mean", "sd")
    )


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """One row per page of ``pages`` (page_id, url): the rule's verdict, else that of the host's posterior bound.

    outcomes: (page_id, outcome) with at most one row for each page id that counts; 1 is a bad page.
    """
    places = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("outcome is not null").groupBy("page_id").agg(F.max("outcome").alias("outcome"))
    # written before the join, so that the pages of a common host can be split among tasks
    hosts = written(reputations(places.select("page_id", "host").join(known, "page_id", "left")), "hosts")
    judged = places.join(hosts, "host", "left")
    blocked = F.col("mean") - z * F.col("sd") >= threshold
    return with_rule(judged, rules).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("host_pages"), F.col("bad").alias("host_bad"), F.round("mean", 6).alias("bad_rate"),
    )
