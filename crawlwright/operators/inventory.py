"""What a site's sitemaps list against what was crawled, and how a crawl of all of it would be cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.functions import urls as u

#: Pages of a batch, batches that a plan shows, and what public and enterprise crawls reach.
BATCH, SHOWN, PUBLIC, ENTERPRISE = 1000, 5, 50_000, 100_000


def inventory(listed: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """(by, discovered, covered, scanned, coverage, uncrawled, off_host) of each site's listed addresses (by, loc) and rendered pages (by, url).
    A site is named by its host; addresses of other hosts are counted apart. Addresses that differ by a fragment or a trailing slash are one."""
    rows = listed.withColumn("_u", u.http_url(F.col("loc")))
    mine = (F.col("_u") != "") & (u.site(F.col("_u")) == F.col(by))
    own = rows.filter(mine).select(by, u.strip_hash(F.col("_u")).alias("_k")).distinct()
    off = rows.filter(~mine).groupBy(by).agg(F.count("*").alias("off_host"))
    seen = pages.select(by, u.strip_hash(F.col("url")).alias("_k")).distinct().withColumn("_s", F.lit(1))
    found = own.join(seen, [by, "_k"], "left").groupBy(by).agg(F.count("*").alias("discovered"), F.count("_s").alias("covered"))
    scanned = pages.groupBy(by).agg(F.count("*").alias("scanned"))
    out = scanned.join(found, by, "full").join(off, by, "full").fillna(0, ["discovered", "covered", "scanned", "off_host"])
    share = F.when(F.col("discovered") > 0, F.floor(F.col("covered") * 100.0 / F.col("discovered") + 0.5)).otherwise(0)
    return out.select(by, "discovered", "covered", "scanned", share.alias("coverage"), (F.col("discovered") - F.col("covered")).alias("uncrawled"), "off_host")


def scale_plan(sites: DataFrame) -> DataFrame:
    """sites (rendered, selected, inventory, requested) with the plan of a staged crawl: status, target, planned, batches, coverage, left.

    A plan is made if more is asked for, or listed, than was selected. A target that isn't positive counts as none."""
    asked = F.when(F.coalesce("requested", F.lit(0)) > 0, F.least(F.col("requested"), F.lit(ENTERPRISE))).otherwise(0)
    rows = sites.withColumn("_asked", asked)
    ready = (F.col("_asked") > F.col("selected")) | (F.col("inventory") > F.col("selected"))
    target = F.when(F.col("_asked") > 0, F.col("_asked")).otherwise(F.least(F.greatest("inventory", "selected"), F.lit(PUBLIC)))
    rows = rows.withColumn("target", F.when(ready, target))
    rows = rows.withColumn("planned", F.when(F.col("inventory") > 0, F.least("inventory", "target")).otherwise(F.col("target")))
    done = F.when(F.col("planned") > 0, F.floor(F.least("rendered", "planned") * 100.0 / F.col("planned") + 0.5)).otherwise(0)
    whole = lambda c: c.cast("long")
    return rows.withColumns(
        {
            "status": F.when(ready, "ready").otherwise("skipped"),
            "target": whole(F.col("target")),
            "planned": whole(F.when(ready, F.col("planned"))),
            "batches": F.when(ready, F.ceil(F.col("planned") / BATCH)),
            "coverage": F.when(ready, whole(done)),
            "unrendered": F.when(ready, whole(F.greatest(F.col("planned") - F.col("rendered"), F.lit(0)))),
        }
    ).drop("_asked")


def batch_preview(plans: DataFrame, key: Column) -> DataFrame:
    """(key, batch, first, last): the first batches of each plan, by the places of their addresses."""
    shown = F.sequence(F.lit(1).cast("long"), F.least(F.col("batches"), F.lit(SHOWN).cast("long")))
    rows = plans.filter("batches > 0").select(key, "planned", F.explode(shown).alias("batch"))
    return rows.select(key, "batch", ((F.col("batch") - 1) * BATCH + 1).alias("first"), F.least(F.col("batch") * BATCH, F.col("planned")).alias("last"))
