from pyspark.sql import functions as F

from daytrace.llm import hosts
from daytrace.llm.queries import RULES

URLS = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("x://b.net", "b.net", "", None, None),
    ("x://b.net/", "b.net", "/", "net/", "block"),
    ("x://net/a", "net", "/a", "net/", "block"),
    ("x://notexample.net/en/a", "notexample.net", "/en/a", "net/", "block"),
    ("x://q.example.com/de/", "q.example.com", "/de/", "example.com/de/", "block"),
    ("x://q.example.com/de", "q.example.com", "/de", None, None),
    ("x://w.org/fr/1", "w.org", "/fr/1", "org/fr/", "allow"),
    ("x://w.org?a=/fr/", "w.org", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("a://É.ORG/fr/", "É.org", "/fr/", "org/fr/", "allow"),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")


def test_parts_and_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, good int")
    got = {r.page_id: r for r in hosts.judge_urls(pages(spark, [u[0] for u in URLS]), none, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), URLS[i]
        if verdict:
            assert got[i].verdict == verdict
        assert got[i].verdict in ("allow", "block")


def test_hosts_shrink_to_domain_and_suffix(spark):
    urls, good = [], []
    for h, n, k in [("a.bad.com", 200, 4), ("b.bad.com", 200, 6), ("c.bad.com", 0, 0), ("a.fine.com", 200, 190), ("b.fine.com", 1, 0), ("x.other.de", 60, 50)]:
        for i in range(max(n, 1)):
            if n:
                good.append((len(urls), int(i < k)))
            urls.append(f"http://{h}/{i}")
    outcomes = spark.createDataFrame([*good, (None, 1), (3, None), (10**9, 1)], "page_id bigint, good int")
    got = {r.host: r for r in hosts.judge_urls(pages(spark, urls), outcomes, ()).collect()}
    assert got["a.bad.com"].verdict == got["c.bad.com"].verdict == "block" and got["a.fine.com"].verdict == "allow"
    assert got["c.bad.com"].bound < got["b.fine.com"].bound < got["a.fine.com"].bound
    assert got["a.fine.com"].n_outcomes == 200 and got["a.fine.com"].n_good == 190


def test_domains(spark):
    rows = [("a.b.co.uk", "co.uk", "b.co.uk"), ("b.com", "com", "b.com"), ("localhost", "", "localhost"), ("10.0.0.1", "", "10.0.0.1"), ("", "", ""), ("co.uk", "co.uk", "co.uk")]
    df = spark.createDataFrame([(r[0],) for r in rows], "h string").withColumn("s", hosts.suffix_of(F.col("h")))
    assert [(r.h, r.s, r.d) for r in df.withColumn("d", hosts.domain_of(F.col("h"), F.col("s"))).collect()] == rows


def test_no_rows(spark):
    assert hosts.judge_urls(pages(spark, []), spark.createDataFrame([], "page_id bigint, good int"), RULES).count() == 0
