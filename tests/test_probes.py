from pyspark.sql import functions as F

from crawlwright.operators import readiness
from crawlwright.plans import probes

CHECKS = "page_url string, url string, kind string, ok boolean, status int, content_length long, redirected boolean, error string, guarded boolean"


def test_probe_rules(spark):
    p = "https://x.com/"
    rows = [
        (p, "https://x.com/a", "internal", False, 404, 0, False, "", False),
        (p, "https://x.com/b", "internal", False, 429, 0, False, "", False),
        (p, "https://x.com/c", "internal", False, 522, 0, False, "", False),
        (p, "https://y.com/", "external", False, 522, 0, False, "", False),
        (p, "https://x.com/d", "internal", True, 200, 0, True, "", False),
        (p, "http://x.com/i.png", "image", True, 200, 600000, False, "", False),
        (p, "https://x.com/z", "canonical", False, None, 0, False, "timeout", False),
        ("https://x.com/ok", "https://x.com/a", "internal", True, 200, None, None, None, None),
    ]
    got = {(r.page_url, r.rule_seq) for r in probes.probe_findings(spark.createDataFrame(rows, CHECKS)).collect()}
    assert got == {(p, 12), (p, 13), (p, 14), (p, 16), (p, 17), (p, 36)}


def test_transient(spark):
    rows = [("internal", None, False, "timeout"), ("internal", None, True, "x"), ("canonical", None, False, "x"), ("internal", 522, False, ""), ("internal", 404, False, "x")]
    df = spark.createDataFrame(rows, "kind string, status int, guarded boolean, error string")
    assert [r[0] for r in df.select(probes.transient(*map(F.col, df.columns))).collect()] == [True, False, False, True, False]


def test_headers_sites_and_speed(spark):
    good = {"x-content-type-options": "nosniff", "content-security-policy": "frame-ancestors 'none'", "referrer-policy": "same-origin", "strict-transport-security": "max-age=1"}
    pages = spark.createDataFrame([(1, 1, "https://x.com/", good), (2, 2, "https://x.com/a", {"x-robots-tag": "NoIndex"}), (3, 1, "http://y.com/", {"a": "b"}), (4, 1, "https://z.com/", None)], "page_id long, page_seq int, url string, headers map<string,string>")
    assert {(r.page_id, r.rule_seq) for r in probes.header_findings(pages).collect()} == {(2, 55), (2, 64), (3, 63)}
    sites = spark.createDataFrame([("a", True, 1, True, 0), ("b", False, 0, False, 0), ("c", True, 0, True, 1)], "host string, robots_ok boolean, search_blocked int, sitemap_ok boolean, sitemaps_listed int")
    assert {(r.host, r.rule_seq) for r in probes.site_findings(sites).collect()} == {("a", 66), ("a", 67), ("b", 65), ("b", 68)}
    speed = spark.createDataFrame([("u", 49.0, 2600.0, 700.0, None), ("v", 75.0, 2500.0, 300.0, 0.1)], "url string, score double, lcp double, tbt double, cls double")
    assert {(r.url, r.rule_seq, r.severity) for r in probes.performance_findings(speed).collect()} == {("u", 1, "critical"), ("u", 2, "warning"), ("u", 3, "critical")}


def test_missing_areas(spark):
    target = spark.createDataFrame([("g", "title"), ("g", "images")], "g string, area string")
    others = spark.createDataFrame([("g", "a", "title"), ("g", "b", "social")], "g string, host string, area string")
    assert {(r.area, tuple(r.hosts)) for r in readiness.missing_areas(target, others, "g").collect()} == {("title", ("b",)), ("images", ("a", "b"))}
