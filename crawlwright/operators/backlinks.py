"""Backlinks: whether they are there, what they point at, and what speaks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.functions import urls as u

#: Links of a source page that are looked at, and what makes an anchor text suspicious.
LINKS, ANCHOR_ROWS, ANCHOR_SHARE, ANCHORS = 500, 3, 0.4, 5


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag: the first one in quotes, else the first one without."""
    quoted = F.regexp_extract(tag, rf"""(?is)(?:^|\s){name}\s*=\s*(["'])(.*?)\1""", 2)
    bare = F.regexp_extract(tag, rf"""(?is)(?:^|\s){name}\s*=\s*([^\s"'=<>`]+)""", 1)
    return F.when(quoted != "", quoted).otherwise(bare)


def links(pages: DataFrame) -> DataFrame:
    """(source_url, nth, href, rel, anchor) of the first links of source pages (source_url, html)."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b([^>]*?)>.*?</a>"), 1)
    texts = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?>(.*?)</a>"), 1)
    z = F.zip_with(tags, texts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    named = F.filter(F.transform(z, lambda x: F.struct(attribute(x["a"], "href").alias("href"), attribute(x["a"], "rel").alias("rel"), t.clean(t.strip_tags(x["b"]), 160).alias("anchor"))), lambda x: x["href"] != "")
    rows = pages.select("source_url", F.posexplode(F.slice(named, 1, LINKS)).alias("p", "l"))
    return rows.select("source_url", (F.col("p") + 1).alias("nth"), u.absolute(F.col("l.href"), F.col("source_url")).alias("href"), "l.rel", "l.anchor")


def inspected(rows: DataFrame, by: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (by, source_url, target_url, anchor_text) with live, rel flags, anchor, target_ok, target_status and signals.

    sources: source_url, ok, html of the pages that were fetched; one that is missing wasn't there. targets: by, url, ok, status of a
    site's own pages; a target that isn't among them counts as fine, as nothing is known against it. Equal links of a source page to a
    target count together. Addresses are compared without scheme, www and trailing slashes.
    """
    found = links(sources.filter("ok")).select("source_url", u.https_key(F.col("href")).alias("_t"), "nth", "rel", "anchor")
    found = found.groupBy("source_url", "_t").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "rel"))), lambda x: x["rel"]), " ").alias("rel"), F.min_by("anchor", "nth").alias("found_anchor"))
    status = targets.select(by, u.strip_hash(F.col("url")).alias("_u"), F.col("ok").alias("target_ok"), F.col("status").alias("target_status")).dropDuplicates([by, "_u"])
    out = rows.withColumn("_t", u.https_key(F.col("target_url"))).withColumn("_u", u.strip_hash(F.col("target_url")))
    out = out.join(found, ["source_url", "_t"], "left").join(status, [by, "_u"], "left")
    flag = lambda word: F.coalesce(F.col("rel").rlike(rf"(?i)\b{word}\b"), F.lit(False))
    anchor = F.when(F.coalesce("anchor_text", F.lit("")) != "", F.col("anchor_text")).otherwise(F.coalesce("found_anchor", F.lit("")))
    return out.withColumns(
        {
            "live": F.col("rel").isNotNull(),
            "nofollow": flag("nofollow"),
            "sponsored": flag("sponsored"),
            "anchor": anchor,
            "target_ok": F.coalesce("target_ok", F.lit(True)),
            "target_status": F.coalesce("target_status", F.lit(0)),
            "signals": t.risk_signals(u.host(F.col("source_url")), u.path(F.col("source_url"))),
        }
    ).drop("_t", "_u", "found_anchor", "rel")


def anchor_risks(rows: DataFrame, by: str, host: str) -> DataFrame:
    """(by, anchor, n, share, nth): anchor texts that make up much of a site's backlinks and aren't its name. rows have by, anchor, host."""
    a = rows.select(by, F.col(host).alias("_h"), F.lower(t.clean(F.col("anchor"), 120)).alias("anchor")).filter("anchor <> ''")
    n = a.groupBy(by, "anchor").agg(F.count("*").alias("n"), F.max("_h").alias("_h"))
    n = n.withColumn("total", F.sum("n").over(W.partitionBy(by))).withColumn("share", F.col("n") / F.col("total"))
    brand = F.filter(F.split(F.regexp_replace("_h", r"^www\.", ""), "[.-]"), lambda x: F.length(x) > 2)
    n = n.filter((F.col("total") >= 3) & (F.col("n") >= ANCHOR_ROWS) & (F.col("share") >= ANCHOR_SHARE) & ~F.array_contains(brand, F.col("anchor")))
    return n.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc("share"), F.desc("n"), "anchor"))).filter(F.col("nth") <= ANCHORS).select(by, "anchor", "n", "share", "nth")


def summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts of inspected() rows by site."""
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(by).agg(F.count("*").alias("imported"), n(F.col("live"), "live"), n(~F.col("live"), "lost"), n(F.size("signals") > 0, "risky"), n(~F.col("target_ok"), "broken_targets"), n(F.col("nofollow"), "nofollow"), n(F.col("sponsored"), "sponsored"))
