"""Audits over rows of keywords, backlinks, resources, language tags and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.functions import urls as u
from crawlwright.operators.imports import fractional, rate
from crawlwright.operators.imports import number as metric  # noqa: F401  a number out of what someone typed

#: Limits of the keyword checks.
KEYWORD_CHECKS = {
    "low_ctr": "impressions >= 100 and position > 0 and position <= 10 and ctr >= 0 and ctr < 0.02",
    "page_two": "impressions >= 50 and position > 10 and position <= 20",
    "zero_click": "impressions >= 100 and clicks = 0 and position > 0 and position <= 20",
    "declining": "(previous_clicks >= 10 and clicks <= previous_clicks * 0.7) or (previous_position > 0 and position > 0 and position - previous_position >= 3)",
}


def ctr(rows: DataFrame, column: str = "ctr", by: str | None = None) -> DataFrame:
    """rows with ctr as a share. Whether 1 means 1 % or all depends on the import, the rows of one `by` (all, without it): if any value,
    previous ones included, lies between 0 and 1 without a percent sign, the import is in shares. Without a value clicks by
    impressions count. Nothing is computed before the result is read."""
    key = F.lit(1) if by is None else F.col(by)
    speaks = fractional(F.trim(F.col(column).cast("string")))
    if f"previous_{column}" in rows.columns:
        speaks = speaks | fractional(F.trim(F.col(f"previous_{column}").cast("string")))
    flags = rows.groupBy(key.alias("_key")).agg(F.max(speaks).alias("_shares"))
    out = rows.join(flags, key.eqNullSafe(F.col("_key")))
    given = rate(F.trim(F.col(column).cast("string")), F.col("clicks"), F.col("impressions"), F.col("_shares"))
    return out.withColumn(column, given).drop("_key", "_shares")


def keyword_checks(rows: DataFrame) -> DataFrame:
    """rows with a flag for each check; those that need pages where with_pages() has been there."""
    checks = KEYWORD_CHECKS | (PAGE_CHECKS if "matched" in rows.columns else {})
    return rows.withColumns({k: F.expr(v) for k, v in checks.items()})


def keyword_opportunities(rows: DataFrame, by: str, check: str, top: int = 12) -> DataFrame:
    """Each group's rows that a check flags, most impressions first, then best position, numbered up to `top`."""
    order = [F.desc(F.greatest("impressions", F.lit(0))), F.greatest("position", F.lit(0)), "query"]
    return keyword_checks(rows).filter(check).withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("nth") <= top)


def keyword_summary(rows: DataFrame, by: str) -> DataFrame:
    """Totals of each group; the average position is weighted by impressions, at least 1 a row."""
    weight = F.greatest("impressions", F.lit(1))
    clicks, seen = F.sum(F.greatest("clicks", F.lit(0))), F.sum(F.greatest("impressions", F.lit(0)))
    place = F.sum(F.greatest("position", F.lit(0)) * weight) / F.sum(weight)
    flags = [F.count_if(k).alias(k) for k in KEYWORD_CHECKS]
    return keyword_checks(rows).groupBy(by).agg(F.count("*").alias("imported"), F.count_distinct("query").alias("queries"), clicks.alias("clicks"), seen.alias("impressions"), F.when(seen > 0, clicks / seen).otherwise(0.0).alias("average_ctr"), place.alias("average_position"), *flags)


def cannibalized(rows: DataFrame, by: str, top: int = 8) -> DataFrame:
    """(by, query, pages, impressions, nth) of each site's queries that several of its pages answer, most impressions first."""
    page = F.regexp_replace("page_url", "#.*$", "")
    g = rows.filter("page_url <> ''").groupBy(by, "query").agg(F.count_distinct(page).alias("pages"), F.sum("impressions").alias("impressions"))
    return g.filter("pages > 1").withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc("impressions"), "query"))).filter(F.col("nth") <= top)


def with_pages(rows: DataFrame, by: str, pages: DataFrame) -> DataFrame:
    """rows (by, query, page_url) with matched, tokens, title_coverage and body_coverage by the page that they lead to.

    pages: by, keys (the addresses a page goes by), title, h1, description, body_text. Of pages with one key the first by page_id counts.
    """
    keyed = pages.select(by, "page_id", "title", "h1", "description", "body_text", F.explode(F.array_distinct(F.transform("keys", lambda k: F.regexp_replace(k, "#.*$", "")))).alias("_k"))
    one = keyed.filter("_k <> ''").groupBy(by, "_k").agg(F.min_by(F.struct("title", "h1", "description", "body_text"), "page_id").alias("_p"))
    out = rows.withColumn("_k", F.regexp_replace("page_url", "#.*$", "")).join(one, [by, "_k"], "left")
    tokens = t.query_tokens(F.col("query"))
    head = F.concat_ws(" ", F.substring("_p.title", 1, 180), F.substring("_p.h1", 1, 180), F.substring("_p.description", 1, 220))
    out = out.withColumns({"matched": F.col("_p").isNotNull(), "tokens": tokens})
    covered = lambda s: F.when(F.col("matched"), t.coverage(F.col("tokens"), t.search_text(s))).otherwise(0.0)
    return out.withColumns({"title_coverage": covered(head), "body_coverage": covered(F.substring("_p.body_text", 1, 1500))}).drop("_k", "_p")


#: Limits of the keyword checks that need the pages.
PAGE_CHECKS = {
    "landing_mismatch": "matched and impressions >= 50 and size(tokens) >= 2 and title_coverage < 0.5",
    "missing_landing": "page_url <> '' and not matched",
    "query_only": "page_url = ''",
}


def landing_mismatch(rows: DataFrame) -> DataFrame:
    """Rows whose page title holds under half of the query's telling words."""
    tokens = t.query_tokens(F.col("query"))
    share = t.coverage(tokens, t.search_text(F.col("title")))
    return rows.filter(F.col("title").isNotNull() & (F.col("impressions") >= 50)).filter((F.size(tokens) >= 2) & (share < 0.5))


def live_backlinks(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (source_url, target_url) with live: whether the source page links to the target, compared without scheme and www."""
    key = lambda c: u.https_key(F.col(c))
    found = links.select(key("source_url").alias("_s"), key("href").alias("_t")).distinct().withColumn("_f", F.lit(True))
    out = rows.withColumn("_s", key("source_url")).withColumn("_t", key("target_url")).join(found, ["_s", "_t"], "left")
    return out.withColumn("live", F.coalesce("_f", F.lit(False))).drop("_s", "_t", "_f")


def waterfall(resources: DataFrame, by: str) -> DataFrame:
    """Requests and bytes by type for each group, and what is slow or foreign."""
    size = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("bytes"))), F.lit(0)).alias(f"{kind}_bytes")
    return resources.groupBy(by).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), *map(size, ("script", "stylesheet", "image", "font")), F.count_if(~F.col("first_party")).alias("third_party"), F.count_if(F.col("duration") >= 1000).alias("slow"), F.max("bytes").alias("largest"), F.max("duration").alias("longest"))


def third_party_hosts(resources: DataFrame, by: str, top: int = 10) -> DataFrame:
    g = resources.filter(~F.col("first_party")).groupBy(by, "host").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.count_if(F.col("duration") >= 1000).alias("slow"))
    return g.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc("bytes"), F.desc("requests"), "host"))).filter(F.col("nth") <= top)


def hreflang_issues(tags: DataFrame) -> DataFrame:
    """(page_url, issue, code) of language tags (page_url, pos, code, href)."""
    code = F.lower(F.coalesce("code", F.lit("")))
    rows = tags.withColumn("code", code).withColumn("again", F.row_number().over(W.partitionBy("page_url", code).orderBy("pos")) > 1)
    bad = rows.filter(~F.col("code").rlike("^(x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*)$")).select("page_url", F.lit("invalid").alias("issue"), "code")
    twice = rows.filter("again").select("page_url", F.lit("duplicate").alias("issue"), "code")
    mine = u.sorted_key(F.col("href")) == u.sorted_key(F.col("page_url"))
    pages = rows.groupBy("page_url").agg(F.count("*").alias("n"), F.max(mine).alias("own"), F.max(F.col("code") == "x-default").alias("default"))
    none = F.lit("")
    alone = pages.filter(~F.coalesce("own", F.lit(False))).select("page_url", F.lit("no self-reference").alias("issue"), none.alias("code"))
    lacking = pages.filter("n > 1 and not default").select("page_url", F.lit("no x-default").alias("issue"), none.alias("code"))
    return bad.unionByName(twice).unionByName(alone).unionByName(lacking)


def pagespeed(raw: DataFrame) -> DataFrame:
    """Scores and lab figures from (url, json) of performance reports."""
    v = F.try_parse_json("json")
    num = lambda path: F.try_variant_get(v, path, "double")
    audits = "$.lighthouseResult.audits"
    return raw.select(
        "url",
        F.floor(num("$.lighthouseResult.categories.performance.score") * 100 + 0.5).alias("score"),
        num(f"{audits}['largest-contentful-paint'].numericValue").alias("lcp"),
        num(f"{audits}['total-blocking-time'].numericValue").alias("tbt"),
        num(f"{audits}['cumulative-layout-shift'].numericValue").alias("cls"),
    )


def retained(reports: DataFrame, protected: DataFrame, key: str, created: str, now: Column, days: int) -> DataFrame:
    """Reports that are young enough or protected."""
    keep = protected.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_p", F.lit(True))
    out = reports.join(keep, key, "left").filter(F.col("_p").isNotNull() | (F.col(created) >= F.date_sub(now, days)))
    return out.drop("_p")
