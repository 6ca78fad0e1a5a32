import math

from cinelake.llm.url_filters import Reputation, domain_of, host_of, judge, levels, path_of, posterior, site_of, suffix_of
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme/en/", "http://Example.COM/en/a", "https://www.example.com/en/x?y#z", "http://a.www.example.com/en/", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/de/1", "ftp://net/fr/", "http://host.org", "http://host.org?q=/en/", "http://u:p@É.com:80/x#://y", "://bare/p",
]


def test_parts_rules_and_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, none).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("example.com", "/en/a", "example.com/en/", "block"),
        4: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        5: ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        6: ("notexample.com", "/en/", "com/", "allow"),
        7: ("x.net", "/es/1", "net/es/", "block"), 8: ("x.net", "/de/1", None, "allow"), 9: ("net", "/fr/", "net/fr/", "block"),
        10: ("host.org", "", None, "allow"), 11: ("host.org", "", None, "allow"),
        12: ("u:p@É.com:80", "/x", None, "allow"), 13: ("bare", "/p", None, "allow"),
    }


def test_reputation_shrinks_towards_siblings(spark):
    rows = [("bad.spam.org", 1)] * 40 + [("bad.spam.org", 0)] * 2 + [("new.spam.org", 1)] + [("good.fine.org", 0)] * 60 + [("also.fine.org", 1)] + [("also.fine.org", 0)] * 30
    rows += [(f"h{i}.d{i % 5}.net", int(i % 7 == 0)) for i in range(70)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    at = levels(outcomes, Reputation())
    p = {r.host: r for r in posterior(outcomes, at, Reputation()).collect()}
    k = at.strength.first()
    assert all(math.isfinite(x) and x > 0 for x in (k.k_suffix, k.k_domain, k.k_site))
    assert p["bad.spam.org"].bad_bound > 0.3
    assert p["new.spam.org"].bad_rate > p["also.fine.org"].bad_rate > 0
    assert p["new.spam.org"].bad_rate < 1 and p["good.fine.org"].bad_rate < 0.2
    pages = spark.createDataFrame([(1, "http://bad.spam.org/x"), (2, "http://good.fine.org/x"), (1, "http://bad.spam.org/x")], "page_id long, url string")
    verdicts = sorted((r.page_id, r.verdict) for r in judge(pages, spark.createDataFrame(rows, "host string, bad int")).collect())
    assert verdicts == [(1, "block"), (1, "block"), (2, "allow")]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge(pages, spark.createDataFrame([("a.b", 1)], "host string, bad int")).count() == 0
    assert pages.select(host_of(F.col("url")), path_of(F.col("url"))).count() == 0


def test_unseen_hosts_are_judged_by_their_prior(spark):
    rows = [(f"h{i}.spam.org", 1) for i in range(200) for _ in range(5)] + [(f"h{i}.fine.org", 0) for i in range(200) for _ in range(5)]
    rows += [(f"h{i}.d{i}.biz", 1) for i in range(200) for _ in range(5)]
    rows += [(f"h{i}.mix{j}.net", int(k < 3)) for i in range(20) for j in range(4) for k in range(10)]
    urls = ["http://x.spam.org/a", "http://x.fine.org/a", "http://x.other.biz/a", "http://h0.spam.org/a", "http://x.fine.zz/a"]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    got = {r.page_id: r for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), outcomes).collect()}
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "block"]
    assert got[0].host_labels == 0 and got[0].bad_bound > 0.3
    p = {r.host: r for r in posterior(spark.createDataFrame([("x.fine.zz",)], "host string"), levels(outcomes, Reputation()), Reputation()).collect()}
    assert math.isclose(p["x.fine.zz"].bad_rate, sum(b for _, b in rows) / len(rows))
    assert (got[4].verdict == "block") == (p["x.fine.zz"].bad_bound > 0.3)


def test_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "u:p@x.example.com:80": ("example.com", "com"), "shop.site.co.uk": ("site.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "192.168.0.1:8080": ("192.168.0.1", "192.168.0.1"), "[::1]:80": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string").withColumn("site", site_of(F.col("host")))
    assert {r[0]: (r[1], r[2]) for r in rows.select("host", domain_of(F.col("site")), suffix_of(F.col("site"))).collect()} == want
