import json

from pyspark.sql import functions as F

from crawlwright.functions import classify
from crawlwright.operators import audits
from crawlwright.plans import sinks
from crawlwright.sources import sitemaps


def test_ctr_flag_is_global(spark):
    cols = "id int, clicks long, impressions long, ctr string"
    shares = spark.createDataFrame([(1, 1, 2, "0.5"), (2, 1, 2, "1"), (3, 1, 4, None), (4, 1, 1, "3%")], cols)
    assert {r.id: r.ctr for r in audits.ctr(shares).collect()} == {1: 0.5, 2: 1.0, 3: 0.25, 4: 0.03}
    percents = spark.createDataFrame([(1, 1, 2, "5"), (2, 1, 2, "1"), (3, 0, 0, "")], cols)
    assert {r.id: r.ctr for r in audits.ctr(percents).collect()} == {1: 0.05, 2: 0.01, 3: 0.0}


def test_metric(spark):
    got = spark.createDataFrame([("1,234",), ("5%",), ("x",), (None,), ("",)], "s string").select(audits.metric(F.col("s"))).collect()
    assert [r[0] for r in got] == [1234.0, 5.0, 0.0, 0.0, 0.0]


def test_landing_mismatch(spark):
    rows = spark.createDataFrame([("red running shoes", "Blue hats", 60), ("red running shoes", "Red shoes for running", 60), ("red", "Blue", 60), ("red running shoes", "Blue", 10), ("red running shoes", None, 99)], "query string, title string, impressions int")
    assert [tuple(r) for r in audits.landing_mismatch(rows).collect()] == [("red running shoes", "Blue hats", 60)]


def test_backlinks(spark):
    rows = spark.createDataFrame([("http://a.com/x/", "https://www.me.com/"), ("http://b.com/", "https://me.com/p")], "source_url string, target_url string")
    links = spark.createDataFrame([("https://a.com/x", "http://me.com/"), ("http://b.com/", "http://other.com/")], "source_url string, href string")
    assert {r.source_url: r.live for r in audits.live_backlinks(rows, links).collect()} == {"http://a.com/x/": True, "http://b.com/": False}


def test_pagespeed(spark):
    doc = {"lighthouseResult": {"categories": {"performance": {"score": 0.725}}, "audits": {"largest-contentful-paint": {"numericValue": 2600.5}, "cumulative-layout-shift": {"numericValue": 0.2}}}}
    a, b = audits.pagespeed(spark.createDataFrame([("u", json.dumps(doc)), ("v", "{bad")], "url string, json string")).orderBy("url").collect()
    assert (a.score, a.lcp, a.tbt, a.cls) == (73, 2600.5, None, 0.2) and b.score is None


def test_classifiers(spark):
    got = spark.createDataFrame([("Broken images on home",), ("Missing H1 on /a",), ("Odd matter on home",)], "t string").select(classify.area(F.col("t")).alias("a"), classify.effort(F.col("t")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("images", "15-45 min"), ("headings", "15-30 min"), ("odd-matter", "15-30 min")]


def test_nested_sitemaps(spark):
    files = spark.createDataFrame(
        [
            ("https://x.com/s.xml", "<sitemapindex><sitemap><loc>/a.xml</loc></sitemap><sitemap><loc>https://x.com/s.xml</loc></sitemap></sitemapindex>"),
            ("https://x.com/a.xml", "<urlset><url><loc>https://x.com/p?a=1&amp;b=2</loc><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url></urlset>"),
            ("https://x.com/other.xml", "<urlset><url><loc>https://x.com/no</loc></url></urlset>"),
        ],
        "url string, xml string",
    )
    got = sitemaps.pages(files, spark.createDataFrame([("https://x.com/s.xml",)], "url string")).collect()
    assert [tuple(r) for r in got] == [("https://x.com/p?a=1&b=2", "2024-01-01")]
    robots = spark.createDataFrame([("x", "User-agent: *\r\n Sitemap: https://x.com/s.xml\nsitemap:nothing here")], "site string, text string")
    assert [r.sitemap for r in sitemaps.listed_in_robots(robots).collect()] == ["https://x.com/s.xml", "nothing"]


def test_sinks(spark):
    plan = spark.createDataFrame([("h", 2, "notice", "b, c", "b"), ("h", 1, "critical", "=a", "a")], "host string, priority int, severity string, title string, pattern_key string")
    assert sinks.briefs(plan).first().brief == "# Repairs for h\n\n1. [critical] =a\n2. [notice] b, c\n"
    assert sinks.fix_list(plan).first().csv == "priority,severity,title,issue\n1,critical,'=a,a\n2,notice,\"b, c\",b\n"
