"""URL filters: stated rules, and empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by site (the host without user info and port).
Rates are shrunk level by level
through beta-binomial priors: the suffix towards the rate of all pages, the
registered domain towards its suffix, the host towards its domain. How strongly
follows at each level from the spread of rates among siblings beyond what their
page counts explain (method of moments), over all labelled pages. A host is
blocked if the lower bound of its posterior bad rate is above a limit; a host
without labels has its domain's, else its suffix's, else the rate of all pages as
prior and no evidence of its own, so its bound is wide.

The suffix is the last label, or the last two where a registry sells names below
them (``SECOND_LEVEL``); the registered domain has one label more. An address in
numbers is its own domain and suffix.

Counts are pre-aggregated before every shuffle and staged level by level, so a
host with a third of all pages costs one partial count a task; pages join the
table of hosts, one row a host, by a plain equi-join that adaptive execution may
split or broadcast by its size.

Defined results: a null url, or one without ``://``, has empty host and path; no
rule fits it and its host is unknown. Repeated pages each get a row; several
labels of a page all count; an empty table of labels allows what no rule blocks;
of rules of one length that fit, the last given wins. Very long urls are taken
whole. Other columns of the pages are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

#: The contract's rules: host, path, verdict. The longest that fits wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Suffixes of two labels below which names are registered: public ones of large
#: registries, a fixed list that a caller may replace.
SECOND_LEVEL = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.kr", "go.kr", "or.kr", "com.br", "gov.br", "net.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.tw", "org.tw", "com.hk", "org.hk", "com.sg", "edu.sg",
    "co.in", "gov.in", "net.in", "org.in", "co.nz", "govt.nz", "net.nz", "org.nz", "co.za", "org.za", "com.mx", "org.mx",
    "com.ar", "com.tr", "org.tr", "co.il", "org.il", "com.ua", "com.pl", "com.es", "co.id", "co.th", "com.my", "com.ph", "com.vn",
)
#: An address in numbers, of four parts or in brackets.
NUMERIC = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$|^\["
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """Limits of the method: the z of a one-sided bound, and the bad rate that
    the lower bound must pass for a block."""

    z: float = 1.645
    max_bad: float = 0.3
    least_rho: float = 1e-3
    most_rho: float = 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text, and its verdict; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def site_of(host: Column) -> Column:
    """The host without user info and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(site: Column, second=SECOND_LEVEL) -> Column:
    """What the registered domain stands under."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(NUMERIC), site).when(two.isin(*second), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, second=SECOND_LEVEL) -> Column:
    """The registered domain: one label more than the suffix."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(NUMERIC), site).when(two.isin(*second), F.substring_index(site, ".", -3)).otherwise(two)


def _rho(units: DataFrame, parents: DataFrame, unit: str, parent: str, how: Reputation) -> DataFrame:
    """One row: the correlation of outcomes within units beyond their parents'."""
    u = units.join(parents.select(parent, F.col("n").alias("pn")), parent).agg(
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("uss"),
        F.sum(F.col("n").cast("double") * F.col("n") / F.col("pn")).alias("unn"),
        F.count("*").alias("units"),
        F.sum("n").alias("total"),
    )
    p = parents.agg(
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("pss"),
        F.sum(F.col("bad") * (F.col("n") - F.col("bad")) / F.col("n")).alias("within"),
        F.count("*").alias("parents"),
    )
    v = F.col("within") / F.col("total")
    free = F.col("units") - F.col("parents")
    rho = ((F.col("uss") - F.col("pss")) / v - free) / (F.col("total") - F.col("unn") - free)
    usable = (v > 0) & (F.col("total") - F.col("unn") - free > 1e-9)
    rho = F.when(usable, F.greatest(F.lit(how.least_rho), F.least(F.lit(how.most_rho), rho))).otherwise(F.lit(how.most_rho))
    return u.crossJoin(p).select((1 / rho - 1).alias(f"k_{unit}"))  # one row each


@dataclass(frozen=True)
class Levels:
    """Staged counts of sites, shrunk rates of domains and suffixes, and one row
    with the rate of all pages and the prior strengths."""

    sites: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    strength: DataFrame


def levels(outcomes: DataFrame, how: Reputation) -> Levels:
    counts = lambda rows, *by: rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    sites = outcomes.groupBy(site_of(F.col("host")).alias("site")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sites = staged(sites.withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))}), "sites")
    domains = staged(counts(sites, "domain", "suffix"), "domains")
    suffixes = staged(counts(domains, "suffix"), "suffixes")
    everything = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.lit("").alias("all"))
    strength = (  # one row each
        _rho(suffixes.withColumn("all", F.lit("")), everything.filter("n > 0"), "suffix", "all", how)
        .crossJoin(F.broadcast(_rho(domains, suffixes, "domain", "suffix", how)))
        .crossJoin(F.broadcast(_rho(sites, domains.drop("suffix"), "site", "domain", how)))
        .crossJoin(F.broadcast(everything.select(F.coalesce(F.col("bad") / F.col("n"), F.lit(0.0)).alias("rate"))))
    )
    strength = staged(strength, "strength")
    one = F.broadcast(strength)
    s = suffixes.crossJoin(one).select("suffix", "k_domain", ((F.col("bad") + F.col("k_suffix") * F.col("rate")) / (F.col("n") + F.col("k_suffix"))).alias("suffix_rate"))
    d = domains.join(s, "suffix").select("domain", ((F.col("bad") + F.col("k_domain") * F.col("suffix_rate")) / (F.col("n") + F.col("k_domain"))).alias("domain_rate"))
    return Levels(sites, staged(d, "domain_rates"), staged(s.drop("k_domain"), "suffix_rates"), strength)


def posterior(hosts: DataFrame, at: Levels, how: Reputation) -> DataFrame:
    """``host``, ``n``, ``bad`` of its site, and the posterior ``bad_rate`` and its
    lower ``bad_bound``, for each of ``hosts``, seen or not."""
    rows = hosts.select("host").distinct().withColumn("site", site_of(F.col("host")))
    rows = rows.withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))})
    rows = rows.join(at.sites.select("site", "n", "bad"), "site", "left").join(at.domains, "domain", "left").join(at.suffixes, "suffix", "left")
    rows = rows.crossJoin(F.broadcast(at.strength.select("k_site", "rate")))
    n, bad, prior = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0)), F.coalesce("domain_rate", "suffix_rate", "rate")
    a = bad + F.col("k_site") * prior
    b = n - bad + F.col("k_site") * (1 - prior)
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return rows.select("host", n.alias("n"), bad.alias("bad"), mean.alias("bad_rate"), (mean - how.z * sd).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, how: Reputation | None = None) -> DataFrame:
    """Verdict for each page (``page_id``, ``url``); ``outcomes`` has the labelled
    pages' ``host`` and ``bad``."""
    how = how or Reputation()
    rows = staged(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "parts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > how.max_bad, "block").otherwise("allow")
    every = staged(posterior(rows, levels(outcomes, how), how), "posterior")
    return rows.join(every, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("n").alias("host_labels"), F.col("bad").alias("host_bad"), F.round("bad_bound", 6).alias("bad_bound"),
    )


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path names by id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:/|\.html|$)", 1)
    named = pages.select(host_of(F.col("url")).alias("host"), number.try_cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("host", "bad")
    return judge(pages, outcomes)


def _op4_sql() -> str:
    """The query in DuckDB's SQL, with the same list of suffixes and limits."""
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    last = lambda n: f"array_to_string(string_split(site, '.')[-{n}:], '.')"
    return rf"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
w AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS site FROM p),
names AS (
  SELECT host, site,
    CASE WHEN regexp_matches(site, '{NUMERIC}') THEN site WHEN {last(2)} IN ({second}) THEN {last(3)} ELSE {last(2)} END AS domain,
    CASE WHEN regexp_matches(site, '{NUMERIC}') THEN site WHEN {last(2)} IN ({second}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM w),
o AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:/|\.html|$)', 1) AS BIGINT)),
h AS (SELECT site, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o JOIN names USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT sum(n) AS n, sum(bad) AS bad FROM s),
ks AS (
  SELECT count(*) AS units, 1 AS parents, sum(s.bad * s.bad / s.n) AS uss, max(g.bad * g.bad / g.n) AS pss,
         sum(s.n * s.n / g.n) AS unn, sum(s.n) AS total, max(g.bad * (g.n - g.bad) / g.n) AS inner_ FROM s, g),
kd AS (
  SELECT count(*) AS units, (SELECT count(*) FROM s) AS parents, sum(d.bad * d.bad / d.n) AS uss,
         (SELECT sum(bad * bad / n) FROM s) AS pss, sum(d.n * d.n / s.n) AS unn, sum(d.n) AS total,
         (SELECT sum(bad * (n - bad) / n) FROM s) AS inner_ FROM d JOIN s USING (suffix)),
kh AS (
  SELECT count(*) AS units, (SELECT count(*) FROM d) AS parents, sum(h.bad * h.bad / h.n) AS uss,
         (SELECT sum(bad * bad / n) FROM d) AS pss, sum(h.n * h.n / d.n) AS unn, sum(h.n) AS total,
         (SELECT sum(bad * (n - bad) / n) FROM d) AS inner_ FROM h JOIN d USING (domain)),
k AS (
  SELECT level, 1 / CASE WHEN inner_ > 0 AND total - unn - (units - parents) > 1e-9
      THEN greatest(0.001, least(0.5, ((uss - pss) / (inner_ / total) - (units - parents)) / (total - unn - (units - parents)))) ELSE 0.5 END - 1 AS k
  FROM (SELECT 's' AS level, * FROM ks UNION ALL SELECT 'd', * FROM kd UNION ALL SELECT 'h', * FROM kh)),
sr AS (
  SELECT suffix, (bad + (SELECT k FROM k WHERE level = 's') * (SELECT bad / n FROM g)) / (n + (SELECT k FROM k WHERE level = 's')) AS suffix_rate FROM s),
dr AS (
  SELECT domain, (bad + (SELECT k FROM k WHERE level = 'd') * suffix_rate) / (n + (SELECT k FROM k WHERE level = 'd')) AS domain_rate FROM d JOIN sr USING (suffix)),
prior AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(domain_rate, suffix_rate, (SELECT bad / n FROM g), 0) AS r, (SELECT k FROM k WHERE level = 'h') AS k
  FROM names LEFT JOIN (SELECT site, n, bad FROM h) USING (site) LEFT JOIN dr USING (domain) LEFT JOIN sr USING (suffix)),
ab AS (SELECT host, n, bad, bad + k * r AS a, n - bad + k * (1 - r) AS b FROM prior),
post AS (
  SELECT host, n, bad, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
fit AS (
  SELECT p.*, n, bad, bound,
    CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN post USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n AS BIGINT) AS host_labels, CAST(bad AS BIGINT) AS host_bad, round(bound, 6) AS bad_bound
FROM fit
"""


OP4_SQL = _op4_sql()
