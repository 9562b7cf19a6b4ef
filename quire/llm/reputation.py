"""URL filters by rules and by empirical-Bayes host reputation (operator 13), all in DataFrame functions.

A rule (host, path) fits its host and all subdomains if the path of the url starts with its path; the longest that
fits decides.  All other urls are judged by the reputation of their host: the outcomes of labelled pages are shrunk
through beta-binomial priors from host to registered domain to suffix to all pages, and a host is blocked if the
lower bound of its posterior bad rate, ``z`` deviations under the mean, is above ``max_bad``.

The strength M of the prior at each level comes from the data by moments: with parent means m,
sum((k - n m)^2 - n m (1 - m)) / sum(m (1 - m) n (n - 1)) estimates 1 / (M + 1) over all groups of that level, held within
``strengths``; without any group of two labelled pages M is ``strength``.

A page's outcome is its label's, found by ``page_id = doc_id``: bad if of quality 0 or toxic; of several labels of one
id the worst counts.  Pages without a label add no outcome.  Repeated rows are pages as any other.  Null urls and urls
without ``://`` have an empty host and path, and the empty host a reputation as any host.  An address of digits and
dots, and the empty host, are their own domain and suffix.  Suffixes are the last part of a host, or the last two where those are
in ``two_part``.  Ports take no part in domain and suffix.  Extra columns are left out; an empty table gives an empty one.

Outcomes are counted by host before they are shuffled, so a host with a third of all pages is one row.  The reputation of
hosts comes to the pages by a broadcast where its measured size allows, else by a join salted on the side of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A choice of suffixes of two parts, a parameter.
TWO_PART = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.cn", "co.in")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones the ASCII-least; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, two_part: tuple[str, ...]) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    own = bare.rlike("^[0-9.]*$")
    last = lambda n: F.substring_index(bare, ".", -n)
    wide = last(2).isin(*two_part)
    return F.when(own, bare).when(wide, last(3)).otherwise(last(2)), F.when(own, bare).when(wide, last(2)).otherwise(last(1))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k): labelled and bad pages of every host."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("c"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    worst = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))
    met = seen.join(worst, "page_id", "left")
    return met.groupBy("host").agg(F.sum(F.when(F.col("bad").isNotNull(), F.col("c")).otherwise(0)).alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(0)) * F.col("c")).alias("k"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key): broadcast up to ``most`` rows, else salted on the side of the rows."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), key, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")


def strength_of(groups: DataFrame, strength: float, strengths: tuple[float, float]) -> float:
    """M of the groups (n, k, m), m the mean of the parent."""
    v = F.col("m") * (1 - F.col("m"))
    spread = F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * v)
    r = groups.agg(spread.alias("a"), F.sum(v * F.col("n") * (F.col("n") - 1)).alias("b")).first()
    if not r.b:
        return strength
    rho = r.a / r.b
    low, high = strengths
    return high if rho <= 1 / (high + 1) else low if rho >= 1 / (low + 1) else 1 / rho - 1


def reputation(counts: DataFrame, strength: float = 10.0, strengths: tuple[float, float] = (1.0, 1000.0), z: float = 1.645, two_part: tuple[str, ...] = TWO_PART, broadcast_rows: int = 100_000) -> DataFrame:
    """(host, n_labelled, n_bad, bad_rate, bad_bound) of ``outcomes``."""
    domain, suffix = domain_of(F.col("host"), two_part)
    hosts = keep(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = keep(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = keep(domains.groupBy("suffix").agg(*sums), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    level, own = suffixes.withColumn("m", F.lit((total.k + 1) / (total.n + 2))), "suffix"
    for children, child in ((domains, "domain"), (hosts, "host")):
        big_m = strength_of(level, strength, strengths)
        means = level.select(own, ((F.col("k") + big_m * F.col("m")) / (F.col("n") + big_m)).alias("m"))
        level, own = keep(looked_up(children, means, own, broadcast_rows), f"by_{own}"), child
    big_m = strength_of(level, strength, strengths)
    rate = (F.col("k") + big_m * F.col("m")) / (F.col("n") + big_m)
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + big_m + 1))
    return level.withColumn("rate", rate).select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), F.round("rate", 6).alias("bad_rate"), F.round(bound, 6).alias("bad_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, max_bad: float = 0.25, broadcast_rows: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, n_bad, bad_rate, bad_bound) of every page."""
    known = keep(reputation(outcomes(pages, labels), broadcast_rows=broadcast_rows), "reputation")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return looked_up(urls, known, "host", broadcast_rows).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "n_labelled", "n_bad", "bad_rate", "bad_bound")


def _level(child: str, parent: str, table: str) -> str:
    """The oracle's step from the posterior means of one level to the level below."""
    return f"""
{child}_in AS (SELECT t.*, p.mean AS m FROM {table} t JOIN {parent} p USING ({parent})),
{child}_m AS (SELECT CASE WHEN b IS NULL OR b = 0 THEN 10.0 WHEN a / b <= 1 / 1001.0 THEN 1000.0 WHEN a / b >= 0.5 THEN 1.0 ELSE 1 / (a / b) - 1 END AS s FROM
 (SELECT sum(pow(k - n * m, 2) - n * m * (1 - m)) AS a, sum(m * (1 - m) * n * (n - 1)) AS b FROM {child}_in)),
{child} AS (SELECT i.*, (k + s * m) / (n + s) AS mean, s FROM {child}_in i, {child}_m)"""


ORACLE = f"""
WITH urls AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
worst AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM urls LEFT JOIN worst ON page_id = doc_id GROUP BY host),
cut AS (SELECT *, string_split(bare, '.') AS p, regexp_matches(bare, '^[0-9.]*$') AS own, array_to_string(string_split(bare, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in TWO_PART)}) AS wide FROM counts),
hosts0 AS (SELECT host, n, k, CASE WHEN own THEN bare WHEN wide THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain, CASE WHEN own THEN bare WHEN wide THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM cut),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts0 GROUP BY domain, suffix),
suffixes0 AS (SELECT suffix, 0 AS whole, sum(n) AS n, sum(k) AS k FROM domains0 GROUP BY suffix),
whole AS (SELECT 0 AS whole, (sum(k) + 1) / (sum(n) + 2.0) AS mean FROM suffixes0),{_level("suffix", "whole", "suffixes0")},{_level("domain", "suffix", "domains0")},{_level("host", "domain", "hosts0")},
known AS (SELECT host, n AS n_labelled, k AS n_bad, round(mean, 6) AS bad_rate, round(mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)), 6) AS bad_bound FROM host),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict, n_labelled, n_bad, bad_rate, bad_bound
FROM ruled JOIN known USING (host)
"""
