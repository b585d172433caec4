"""URL filters: a rule list, and reputation of hosts by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceworks.session import cut_lineage

#: Rules of the contract (fixed values): a host and a path prefix, with its verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Public suffixes of two labels that many registered domains share. Pass a longer list where one is at hand.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "com.br", "org.br", "co.in", "co.jp", "or.jp",
    "co.kr", "com.cn", "com.mx", "com.ar", "com.tr", "co.za", "com.tw",
)
CORRELATION = (1e-4, 1 / 3)
LOWER_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *LOWER_AZ)


def url_path(url: Column) -> Column:
    """Path: after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site(host: Column) -> Column:
    """The host without user, port and final dot: what a reputation is of."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def site_levels(name: str, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a site: the longest listed suffix, else the last label, and one label more.

    A numeric address is its own domain; all addresses share the empty suffix.
    """
    whole_site = F.col(name)
    address = whole_site.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    listed = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True))
    found = F.regexp_extract(whole_site, rf"(?:^|\.)({listed})$", 1) if listed else F.lit("")
    suffix = F.when(address, "").when(found != "", found).otherwise(F.substring_index(whole_site, ".", -1))
    rest = F.substring(whole_site, F.lit(1), F.length(whole_site) - F.length(suffix) - 1)
    domain = F.when(address | (whole_site == suffix), whole_site).otherwise(
        F.concat(F.substring_index(rest, ".", -1), F.lit("."), suffix)
    )
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for pattern, decision in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _strength(counts: DataFrame, correlation: tuple[float, float]) -> float:
    """Prior strength of a level by moments: how far rates of its members spread around their parents' means.

    With correlation rho inside members, the expected n (k/n - m)^2 is
    m (1 - m) (1 + (n - 1) rho), and a beta prior of strength 1 / rho - 1 has
    that correlation. rho is held within ``correlation``; where nothing can be told, it is the greater bound.
    """
    spread = F.col("parent") * (1 - F.col("parent"))
    moments = counts.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("parent"), 2)).alias("seen"),
        F.sum(spread).alias("binomial"),
        F.sum(spread * (F.col("n") - 1)).alias("room"),
    ).first()
    least, most = correlation
    rho = min(max((moments["seen"] - moments["binomial"]) / moments["room"], least), most) if moments["room"] else most
    return 1 / rho - 1


def _shrunk(counts: DataFrame, strength: float) -> Column:
    return (F.col("k") + F.col("parent") * strength) / (F.col("n") + strength)


def host_reputation(
    outcomes: DataFrame,
    bound: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
    correlation: tuple[float, float] = CORRELATION,
) -> DataFrame:
    """Posterior of the share of bad pages of each site.

    ``outcomes`` has site, labelled (0/1) and bad (0/1), a row per page. Rates
    are shrunk through beta-binomial priors from the whole to the suffix, from there to the registered domain
    (see ``site_levels``) and then to the site. Columns: site, n, k, rate (posterior mean), low and high (``bound``
    standard deviations below and above). A site without labelled pages has the
    posterior of its domain's prior. ``correlation`` bounds how alike pages of one site, domain or suffix are taken to be: by the
    default a prior weighs between 2 and 9,999 pages, so that no single page condemns a site.
    """
    domain, suffix = site_levels("site", suffixes)
    sites = cut_lineage(
        outcomes.groupBy("site")
        .agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k"))
        .withColumn("domain", domain)
        .withColumn("suffix", suffix)
    )
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = tops.agg(F.sum("n"), F.sum("k")).first()
    overall = ((k or 0) + 0.5) / ((n or 0) + 1.0)
    tops = tops.withColumn("parent", F.lit(overall))
    tops = tops.select("suffix", _shrunk(tops, _strength(tops, correlation)).alias("parent"))
    domains = cut_lineage(domains.join(tops, "suffix"))
    domains = domains.select("domain", "suffix", _shrunk(domains, _strength(domains, correlation)).alias("parent"))
    sites = cut_lineage(sites.join(domains, ["domain", "suffix"]))
    strength = _strength(sites, correlation)
    rate, weight = _shrunk(sites, strength), F.col("n") + strength
    spread = F.sqrt(rate * (1 - rate) / (weight + 1))
    return sites.select("site", "n", "k", rate.alias("rate"), (rate - bound * spread).alias("low"), (rate + bound * spread).alias("high"))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    most_bad: float = 0.5,
    bound: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
    correlation: tuple[float, float] = CORRELATION,
) -> DataFrame:
    """Verdict of every page's url: that of the longest fitting rule, else by the reputation of its site.

    A page is labelled where ``labels`` (doc_id, quality, toxic) has its page_id as a doc_id: labels name
    what they judge by that number alone, and the caller states that it is the page's. It is
    bad with quality 0 or toxic 1 in any of its labels. A host is blocked when
    even the lower posterior bound of its site's share of bad pages is above
    ``most_bad``. The site is the host without user and port. A site without labels has the rate of its registered domain, and a
    domain without labels that of its suffix: it is blocked where that is bad enough, and else allowed.

    Columns: page_id, host, path, rule, verdict, bad_low (the bound); columns of ``pages`` but page_id and url play no part. Urls that
    are null or have no ``://`` have an empty host, which is a host like any
    other. Every row of ``pages`` gives one row; rows with equal ids share their labels, and count each as a page;
    a null page_id has no label. Null labels count as good. An empty table gives no rows.
    """
    named = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = named.withColumn("site", site(F.col("host")))
    bad = F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"), F.lit(0))
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    outcomes = urls.join(judged, F.col("page_id") == F.col("doc_id"), "left").select(
        "site",
        F.col("bad").isNotNull().cast("bigint").alias("labelled"),
        F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"),
    )
    known = host_reputation(outcomes, bound, suffixes, correlation).select("site", F.col("low").alias("bad_low"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_low") > most_bad, "block").otherwise("allow")
    return urls.join(known, "site", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_low"
    )
