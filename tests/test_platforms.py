import pytest
from pyspark.sql import functions as F

from crawlwright.operators import platforms as p


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(fn(*map(F.col, names))).first()[0]


def test_detect(spark):
    rows = [("a", "WordPress 6"), ("a", "https://a.com/wp-content/plugins/woocommerce/x.js"), ("b", "https://cdn.shopify.com/x"), ("c", "plain")]
    got = {(r.site, r.id, r.confidence) for r in p.detect(spark.createDataFrame(rows, "site string, signal string"), "site").collect()}
    assert got == {("a", "wordpress", "high"), ("a", "woocommerce", "medium"), ("b", "shopify", "medium")}


@pytest.mark.parametrize("phone, want", [("+1 (555) 010-2030", True), ("555 010 2030", True), ("010203", False), ("555 999 0000", False)])
def test_phone(spark, phone, want):
    assert one(spark, p.names_phone, "Call 555.010.2030 today", phone) is want


@pytest.mark.parametrize("address, want", [("12 Main Street, Springfield", True), ("12 Main Street Springfield Oregon State USA", True), ("99 Other Road Nowhere", False), ("Main", True), ("", False)])
def test_address(spark, address, want):
    assert one(spark, p.names_address, "Find us: 12 Main Street, Springfield (Oregon State)", address) is want


def test_citations(spark):
    rows = spark.createDataFrame([("Joe & Sons, 5550102030", "Joe and Sons", "555-010-2030", "1 A St"), (None, "x", "1", "y")], "text string, name string, phone string, address string")
    assert [r.lacks for r in p.citations(rows).collect()] == [["address"], ["name", "phone", "address"]]


def test_utm(spark):
    got = one(spark, lambda url: p.utm(url, source=F.lit("News Letter"), term=F.lit(None).cast("string")), "https://x.com/a?b=1&utm_source=z#f")
    assert got == "https://x.com/a?b=1&utm_source=news-letter#f"
    assert one(spark, p.plugin_name, "https://x.com/wp-content/plugins/my-seo_tool/a.js") == "my seo tool"
    assert one(spark, p.product_like, "https://x.com/Shop/1") is True
