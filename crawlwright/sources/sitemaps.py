"""Sitemap and robots texts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.functions import urls as u
from crawlwright.shared import save


def _tag(block, tag: str):
    x = F.regexp_extract(block, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(x)


def entries(files: DataFrame, place: str | None = None) -> DataFrame:
    """(url, kind, loc, lastmod) from (url, xml): kind is sitemap for a nested file, url for a page. place: a column for the entry's place in its file."""
    blocks = lambda kind: F.transform(F.regexp_extract_all("xml", F.lit(rf"(?is)(<{kind}\b.*?</{kind}>)"), 1), lambda b: F.struct(F.lit(kind).alias("kind"), _tag(b, "loc").alias("loc"), _tag(b, "lastmod").alias("lastmod")))
    rows = files.select("url", F.posexplode(F.concat(blocks("sitemap"), blocks("url"))).alias("_place", "e")).select("url", "_place", "e.*")
    rows = rows.withColumnRenamed("_place", place) if place else rows.drop("_place")
    return rows.filter("loc <> ''").withColumn("loc", u.absolute(F.col("loc"), F.col("url")))


def pages(files: DataFrame, start: DataFrame) -> DataFrame:
    """(loc, lastmod) of all pages that sitemaps reach from start (url), through nested sitemap files of any depth. Files are read
    once; each level is written, so later ones don't repeat it."""
    rows = save(entries(files), "sitemaps")
    nested = rows.filter("kind = 'sitemap'").select("url", "loc")
    seen = front = save(start.select("url").distinct(), "sitemaps")
    while True:
        front = save(nested.join(front, "url").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), "sitemaps")
        if front.isEmpty():
            break
        seen = save(seen.unionByName(front), "sitemaps")
    return rows.filter("kind = 'url'").join(seen, "url", "left_semi").groupBy("loc").agg(F.min("lastmod").alias("lastmod"))


def listed_in_robots(files: DataFrame) -> DataFrame:
    """(site, sitemap) of the sitemap lines in (site, text)."""
    lines = files.select("site", F.explode(F.split("text", r"\r?\n")).alias("line"))
    return lines.select("site", F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1).alias("sitemap")).filter("sitemap <> ''")
