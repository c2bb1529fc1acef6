"""A crawl as an ordered, bounded breadth-first search over tables of pages and links, for any number of sites at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import urls as u
from crawlwright.shared import forget, save

#: Tables of a search that are put into one when there are more.
TABLES = 16


def crawl(spark: SparkSession, starts: DataFrame, pages: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """(site, place, url, depth, found_on): the pages that a crawler with one queue a site loads, in its order.

    starts: site, url. pages: url, is_html. links: src, place, dst. A crawler takes the first address of its queue; what isn't an HTML page
    (or no page at all) is passed over; a page's links are queued, in order, if they are on the start's origin, look like pages, were never queued, and
    the queue and the loaded pages are together fewer than `limit`.

    Each round takes the whole queue of every site at once: links are joined to it, an address counts where it is found first,
    and the room of a site cuts the new addresses. Room grows by one with each address that is passed over, so in a site that runs out of
    room a round ends after the next such address, and the rest of its queue waits. What a site's window holds is
    bounded by `limit` and by what was passed over, however many pages and links the site has.

    Rows with a null address are left out; of repeated rows one counts; a site with several starts begins at the least one; empty tables give none.
    """
    hops = save(links.select("src", "place", u.strip_hash(F.col("dst")).alias("dst")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & u.likely_html(F.col("dst"))), "crawl-links")
    html = save(pages.filter("is_html and url is not null").select("url", F.lit(True).alias("ok")).distinct(), "crawl-pages")
    first = starts.filter("url is not null").groupBy("site").agg(u.strip_hash(F.min("url")).alias("url"))
    none = F.lit(None).cast("string")
    first = first.select("site", "url", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("depth"), none.alias("found_on"), u.origin(F.col("url")).alias("origin"))
    front = save(_opened(first, html).withColumns({"failed": F.lit(0).cast("long"), "queued": F.lit(1).cast("long")}), "crawl-front")
    taken = [front.select(*TAKEN)]
    while not front.isEmpty():
        ranked = save(_found(front, hops, taken, limit), "crawl-found")
        new, after = _advanced(front, ranked, html, limit)
        new = save(new, "crawl-taken")
        taken.append(new.select(*TAKEN))
        rest = save(after.unionByName(new).transform(_worth, limit), "crawl-front")
        front = rest
        if len(taken) > TABLES:
            taken = [save(reduce(DataFrame.unionByName, taken), "crawl-taken")]
    loaded = reduce(DataFrame.unionByName, taken).filter("ok")
    forget(hops, html)
    return loaded.withColumn("place", F.row_number().over(W.partitionBy("site").orderBy("seq"))).select("site", "place", "url", "depth", "found_on")


TAKEN = ["site", "url", "seq", "depth", "found_on", "ok"]


def _opened(rows: DataFrame, html: DataFrame) -> DataFrame:
    return rows.join(html, "url", "left").fillna(False, ["ok"])


def _waves(front: DataFrame) -> DataFrame:
    """front with the number of addresses of its site's queue before it that are passed over."""
    before = W.partitionBy("site").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return front.withColumn("wave", F.coalesce(F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(before), F.lit(0)))


def _found(front: DataFrame, hops: DataFrame, taken: list[DataFrame], limit: int) -> DataFrame:
    """New addresses in the order in which they are found: site, dst, n, wave, room, tight: whether they are more than there is room for."""
    open_ = _waves(front).filter("ok").select("site", F.col("url").alias("src"), "seq", "depth", "origin", "failed", "queued", "wave")
    met = open_.join(hops, "src").filter(F.col("dst").startswith(F.col("origin")))
    where = F.min(F.struct("seq", "place", "src", "depth", "wave", "origin", "failed", "queued")).alias("w")
    fresh = met.groupBy("site", "dst").agg(where).join(_known(taken), ["site", "dst"], "left_anti").select("site", "dst", "w.*")
    n = F.row_number().over(W.partitionBy("site").orderBy("seq", "place"))
    some = fresh.withColumn("n", n).filter(F.col("n") <= limit + 1)  # one more than any room tells that it is too small
    some = some.withColumn("room", limit + F.col("failed") - F.col("queued"))
    return some.withColumn("tight", F.max("n").over(W.partitionBy("site")) > F.col("room"))


def _known(taken: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, taken).select("site", F.col("url").alias("dst"))


def _advanced(front: DataFrame, ranked: DataFrame, html: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the addresses that get a place in the queue, what is left of the queue before them)."""
    good = ranked.filter("n <= room and (not tight or wave = 0)")
    sites = ranked.groupBy("site").agg(F.first("tight").alias("tight"), F.count_if(F.expr("n <= room and (not tight or wave = 0)")).alias("more"))
    rows = _waves(front).join(sites, "site", "left").withColumn("done", ~F.coalesce("tight", F.lit(False)) | (F.col("wave") == 0))
    state = rows.groupBy("site").agg((F.first("failed") + F.count_if(F.col("done") & ~F.col("ok"))).alias("failed"), (F.first("queued") + F.coalesce(F.first("more"), F.lit(0))).alias("queued"))
    after = rows.filter("not done").drop("failed", "queued", "wave", "tight", "more", "done").join(state, "site")
    new = good.select("site", F.col("dst").alias("url"), (F.col("queued") + F.col("n") - 1).alias("seq"), (F.col("depth") + 1).alias("depth"), F.col("src").alias("found_on"), "origin")
    return _opened(new, html).join(state, "site"), after


def _worth(front: DataFrame, limit: int) -> DataFrame:
    """The queues that can still grow: there is room, or an address that is passed over will make some."""
    will: Column = F.max(~F.col("ok")).over(W.partitionBy("site"))
    return front.withColumn("_will", will).filter(F.col("_will") | (F.lit(limit) + F.col("failed") - F.col("queued") > 0)).drop("_will")
