"""Reports as files: a Markdown brief, a fix list, a sitemap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.functions.text import csv_cell


def brief_lines(plan: DataFrame) -> DataFrame:
    """(host, n, line): each site's brief as rows in order, for a site of any number of findings; n is the place from 1."""
    line = F.format_string("%d. [%s] %s", "priority", "severity", "title")
    head = plan.select("host").distinct().select("host", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.concat(F.lit("# Repairs for "), F.col("host")).alias("line")), F.struct(F.lit(2).alias("n"), F.lit("").alias("line")))).alias("l"))
    return head.select("host", F.col("l.n").cast("long").alias("n"), F.col("l.line").alias("line")).unionByName(plan.select("host", (F.col("priority") + 2).cast("long").alias("n"), line.alias("line")))


def fix_lines(plan: DataFrame) -> DataFrame:
    """(host, n, line): each site's plan as CSV lines with guarded cells, the names first."""
    row = F.concat_ws(",", F.col("priority").cast("string"), *[csv_cell(F.col(c)) for c in ("severity", "title", "pattern_key")])
    head = plan.select("host").distinct().select("host", F.lit(1).cast("long").alias("n"), F.lit("priority,severity,title,issue").alias("line"))
    return head.unionByName(plan.select("host", (F.col("priority") + 1).cast("long").alias("n"), row.alias("line")))


def briefs(plan: DataFrame) -> DataFrame:
    """(host, brief): each site's plan as Markdown, in order, as one text; a site too large for one takes brief_lines()."""
    line = F.format_string("%d. [%s] %s", "priority", "severity", "title")
    items = plan.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("priority", line.alias("line")))).alias("l"))
    return items.select("host", F.concat(F.lit("# Repairs for "), F.col("host"), F.lit("\n\n"), F.array_join("l.line", "\n"), F.lit("\n")).alias("brief"))


def fix_list(plan: DataFrame) -> DataFrame:
    """(host, csv): the plan as CSV text with guarded cells; a site too large for one text takes fix_lines()."""
    row = F.concat_ws(",", F.col("priority").cast("string"), *[csv_cell(F.col(c)) for c in ("severity", "title", "pattern_key")])
    rows = plan.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("priority", row.alias("line")))).alias("l"))
    return rows.select("host", F.concat(F.lit("priority,severity,title,issue\n"), F.array_join("l.line", "\n"), F.lit("\n")).alias("csv"))


def sitemap(pages: DataFrame) -> DataFrame:
    """(host, xml): a sitemap of each site's pages (host, url)."""
    safe = F.col("url")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(char), F.lit(entity))
    one = pages.groupBy("host").agg(F.sort_array(F.collect_set(F.concat(F.lit("<url><loc>"), safe, F.lit("</loc></url>")))).alias("u"))
    return one.select("host", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join("u", ""), F.lit("</urlset>")).alias("xml"))
