"""URL filter by host reputation, with DataFrame expressions only.

Labelled page outcomes (good or bad) are counted per host. The bad rate of a host is shrunk
through beta-binomial priors: the whole table is the prior of a suffix (`com`), a suffix of
its registered domains (`example.com`), a domain of its hosts. How strongly each level holds
its children together is estimated by moments from all children of that level. A host is
blocked if the lower bound of its posterior bad rate exceeds a limit. Rules by host and path
go first.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import materialize
from samebytes.operators.scale import lookup_join

#: Block a host when its bad rate is above `MAX_BAD` with a one-sided certainty of `Z` deviations.
MAX_BAD, Z = 0.3, 1.645
#: Bounds of the correlation within a level, so that a prior strength is finite.
MIN_RHO, MAX_RHO = 1e-4, 0.9

# --- fixed values: public suffixes of two labels under which names are registered ---
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "me.uk", "net.uk", "org.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.nz", "co.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "com.br", "gov.br", "net.br",
    "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "ac.kr", "co.kr", "go.kr", "or.kr", "ac.za", "co.za", "org.za", "com.ar", "com.co", "com.hk", "com.mx", "com.my",
    "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "co.id", "co.il", "co.th",
    "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app", "wordpress.com",
)

Rule = tuple[str, str]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last two labels of a host if they are one of `suffixes`, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix of a host and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (verdict, rule), or null.

    A rule is (verdict, `host/path`). It fits its host and all subdomains where the path of the
    URL starts with the rule's. Rules of one length are taken in the order of their text. The
    list is part of the plan, so it should stay below some hundred rules.
    """
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def _strength(children: DataFrame, parent: Column) -> float:
    """Prior strength of a level from the spread of its children around their parents."""
    rate, size = F.col("bad") / F.col("n"), F.col("n")
    variance = parent * (1 - parent)
    row = children.filter(size > 0).agg(
        F.sum(size * (rate - parent) * (rate - parent)).alias("spread"),
        F.sum(variance).alias("noise"),
        F.sum(variance * (size - 1)).alias("room"),
    ).first()
    rho = (row.spread - row.noise) / row.room if row.room else MIN_RHO
    return 1 / min(max(rho, MIN_RHO), MAX_RHO) - 1


def host_reputation(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of every host from counts `host`, `n`, `bad` (one row per host).

    The registered domain is the label before the suffix; strangers under a suffix of two labels, as
    `co.uk` or `github.io`, are domains of their own. `suffixes` lists those, some hundred at most.

    Returns host, n, bad, posterior mean and strength (`mean`, `strength`). Hosts without labelled pages
    have their domain's rate. An empty table has no rows; without any label all rates are 0.
    """
    host = F.col("host")
    hosts = hosts.withColumn("domain", domain_of(host, suffixes)).withColumn("suffix", suffix_of(host, suffixes))
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = F.lit(total.bad / total.n if total.n else 0.0)

    def shrunk(level: DataFrame, parent: Column) -> DataFrame:
        strength = _strength(level, parent)
        mean = (F.lit(strength) * parent + F.col("bad")) / (F.lit(strength) + F.col("n"))
        return level.withColumn("mean", mean).withColumn("strength", F.lit(strength) + F.col("n"))

    up = shrunk(suffixes, base).select("suffix", F.col("mean").alias("parent"))
    level = lookup_join(domains, up, "suffix")
    up = shrunk(level, F.col("parent")).select("domain", F.col("mean").alias("parent"))
    level = lookup_join(hosts, up, "domain")
    return shrunk(level, F.col("parent")).select("host", "n", "bad", "mean", "strength")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = (),
    url: str = "url",
    page: str = "page_id",
    max_bad: float = MAX_BAD,
    z: float = Z,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Pages with host, path, rule, verdict, bad_rate and bad_bound.

    `labels` has (page id, `bad` boolean) under the names `page` and `bad`; several labels of
    a page all count, null labels do not. URLs that are null or have no `://` have empty host
    and path and are judged as the host ``. Other columns pass through; those with the names
    of the results are replaced.
    """
    results = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")
    plain = pages.drop(*[c for c in results if c in pages.columns])
    judged = plain.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    # Labels are summed per page first, so that a page is counted once per row of the table.
    votes = labels.filter(F.col(page).isNotNull() & F.col("bad").isNotNull()).groupBy(page).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("bad").cast("long")).alias("_bad")
    )
    counts = judged.select(page, "host").join(votes, page, "left").groupBy("host").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")
    )
    reputation = materialize(host_reputation(materialize(counts), suffixes))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    bounds = reputation.select(
        "host", F.col("mean").alias("bad_rate"), (F.col("mean") - z * deviation).alias("bad_bound")
    )
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return (
        lookup_join(judged, bounds, "host", "left")
        .withColumn("_rule", rule)
        .select(
            *plain.columns, "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"), "bad_rate", "bad_bound",
        )
    )
