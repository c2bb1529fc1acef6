"""A sitemap inventory: nested files and their addresses in the order of a queue, up to limits of files and addresses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import urls as u
from crawlwright.shared import save
from crawlwright.sources.sitemaps import entries

#: Files and addresses of an inventory, and warnings that it lists.
MAX_FILES, MAX_URLS, WARNINGS = 500, 50_000, 20


@dataclass(frozen=True)
class Inventory:
    """sites: site, urls_discovered, sitemaps_fetched, off_host_ignored, truncated. urls: site, place, url, lastmod. files: site, place, url, ok.
    warnings: site, nth, warning."""

    sites: DataFrame
    urls: DataFrame
    files: DataFrame
    warnings: DataFrame


def inventory(spark: SparkSession, seeds: DataFrame, files: DataFrame, max_files: int = MAX_FILES, max_urls: int = MAX_URLS) -> Inventory:
    """What reading a site's sitemap files one after the other finds.

    seeds: site, start (the site's address), place, url: the first files of a site's queue. files: url, ok, status, xml. The queue's next file is passed over if it was
    read before, and, with a warning, if it is on another host (www aside); a file that isn't there or not ok is a warning. Its nested files are queued, repeats included,
    while files read and queued are fewer than max_files; its addresses on the start's host are taken, each once, up to max_urls. Reading ends
    when either limit is met. truncated: something was left because of a limit.

    Each round takes all queues as far as nothing depends on what comes later: the room for nested files is the same until a
    file is passed over, which frees a place, so a site whose room ends waits after the next such file; and the running number of new addresses, a row a
    file, tells at which file the second limit is met. Windows by site see a row for each file or nested file, not the
    addresses; only the file that the limit cuts has its addresses ranked, and the final places are dealt by file. Sites and files with a null
    address are left out; repeated files count once; empty tables give none.
    """
    site_host = seeds.select("site", u.site(F.col("start")).alias("host")).filter("host is not null").groupBy("site").agg(F.min("host").alias("host"))
    have = save(files.filter("url is not null").select(u.http_url(F.col("url")).alias("url"), F.coalesce("ok", F.lit(False)).alias("ok"), "status", "xml"), "sitemap-files")
    queue = seeds.filter("url is not null").join(site_host, "site").select("site", "host", u.http_url(F.col("url")).alias("url"), F.row_number().over(W.partitionBy("site").orderBy("place", "url")).cast("long").alias("seq"))
    size = F.count("*").over(W.partitionBy("site"))
    state = {"queued": size, "passed": F.lit(0).cast("long"), "read": F.lit(0).cast("long"), "found": F.lit(0).cast("long")}
    front = save(_marked(queue.withColumns(state), None, have), "sitemap-front")
    seen, urls, notes, ends = [front.select("site", "url", "seq")], [], [], []
    while not front.isEmpty():
        items, rows = _read(front, have, urls, max_files, max_urls)
        items, rows = save(items, "sitemap-read"), save(rows, "sitemap-rows")
        urls.append(items.filter("kind = 'url' and taken").select("site", "loc", "seq", "pos", "lastmod"))
        notes.append(rows.filter("done").select("site", "seq", "url", "skip", "off", "ok", "status"))
        ends.append(_closed(rows, items, max_files, max_urls))
        new = items.filter("kind = 'sitemap' and taken").select("site", "host", F.col("loc").alias("url"), F.col("n").alias("nth"))
        sums = rows.groupBy("site").agg(*[F.first(c).alias(c) for c in ("queued", "passed", "read", "found")], F.count_if(F.expr("done and skip")).alias("_p"), F.count_if(F.expr("done and not skip")).alias("_r"), F.sum(F.when(F.col("done"), F.col("fresh")).otherwise(0)).alias("_f"), F.max("over").alias("over"))
        more = new.groupBy("site").agg(F.count("*").alias("_m"))
        sums = sums.join(more, "site", "left").fillna(0, ["_m"])
        after = sums.filter("not over").select("site", F.col("queued").alias("_q"), (F.col("queued") + F.col("_m")).alias("queued"), (F.col("passed") + F.col("_p")).alias("passed"), (F.col("read") + F.col("_r")).alias("read"), (F.col("found") + F.col("_f")).alias("found"))
        rest = rows.filter("not done").select("site", "host", "url", "seq").join(after.drop("_q"), "site")
        added = new.join(after, "site").withColumn("seq", F.col("_q") + F.col("nth")).select("site", "host", "url", "seq", "queued", "passed", "read", "found")
        front = save(_marked(rest.unionByName(added), reduce(DataFrame.unionByName, seen), have), "sitemap-front")
        seen.append(front.select("site", "url", "seq"))
        notes[-1] = (notes[-1], items)
    return _summed(site_host, urls, notes, ends)


def _items(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, kind, pos, loc, said, lastmod) of the wanted files (src) that are ok: loc is the address in its usual form, said as it stands. Nested files come
    first, as both kinds are read in two passes. No other file is taken apart."""
    rows = files.filter("ok").join(wanted.select(F.col("src").alias("url")).distinct(), "url", "left_semi").dropDuplicates(["url"])
    return entries(rows, place="pos").select(F.col("url").alias("src"), "kind", "pos", u.http_url(F.col("loc")).alias("loc"), F.col("loc").alias("said"), "lastmod")


def _marked(queue: DataFrame, seen: DataFrame | None, have: DataFrame) -> DataFrame:
    """The queue with off (on another host), skip (passed over: that, or read before), ok and status."""
    off = u.site(F.col("url")) != F.col("host")
    first = queue.select("site", "url", "seq") if seen is None else queue.select("site", "url", "seq").unionByName(seen)
    first = first.groupBy("site", "url").agg(F.min("seq").alias("_first"))
    rows = queue.withColumn("off", off).join(first, ["site", "url"], "left").withColumn("skip", F.col("off") | (F.col("seq") > F.col("_first"))).drop("_first")
    known = have.select("url", "ok", "status").join(queue.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max("ok").alias("ok"), F.max("status").alias("status"))
    return rows.join(known, "url", "left").fillna(False, ["ok"])


def _read(front: DataFrame, known: DataFrame, urls: list[DataFrame], max_files: int, max_urls: int) -> tuple[DataFrame, DataFrame]:
    """(items of the files read in this round, with on: on the site's host, n: their number among those of their kind that count, taken; the front's
    rows with done, fresh: new addresses, over: whether the site's reading ends here)."""
    before = W.partitionBy("site").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("site").orderBy("seq")
    rows = front.withColumns({"wave": F.coalesce(F.count_if("skip").over(before), F.lit(0)), "nth": F.count_if(F.expr("not skip")).over(upto)})
    rows = rows.withColumn("open", F.col("read") + F.col("nth") - F.when(F.col("skip"), 0).otherwise(1) < max_files)  # the limit of files isn't met before it
    live = rows.filter("open and not skip and ok").select("site", "host", F.col("url").alias("src"), "seq", "wave", "queued", "passed")
    items = save(live.join(_items(known, live), "src").withColumn("on", F.coalesce(u.site(F.col("loc")) == F.col("host"), F.lit(False))), "sitemap-items")
    # nested files: their numbers in the queue's order, from sums by file and places within a file
    nested = items.filter("kind = 'sitemap'")
    per_file = nested.groupBy("site", "seq", "wave").agg(F.count_if("on").alias("_on"), F.first("queued").alias("queued"), F.first("passed").alias("passed"))
    per_file = per_file.withColumns({"_before": F.coalesce(F.sum("_on").over(before), F.lit(0)), "_all": F.sum("_on").over(W.partitionBy("site"))}).withColumn("room", F.greatest(F.lit(0).cast("long"), max_files + F.col("passed") - F.col("queued")))
    tight = per_file.groupBy("site").agg((F.first("_all") > F.first("room")).alias("tight"))
    inner = W.partitionBy("site", "seq").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    nested = nested.withColumn("_own", F.coalesce(F.count_if("on").over(inner), F.lit(0))).join(per_file.select("site", "seq", "_before", "room"), ["site", "seq"])
    nested = nested.withColumn("n", F.col("_before") + F.col("_own") + 1)
    # addresses that are new, by the file that has them first
    pages = items.filter("kind = 'url'")
    first = pages.filter("on").groupBy("site", "loc").agg(F.min(F.struct("seq", "pos")).alias("_f"))
    if urls:
        first = first.join(reduce(DataFrame.unionByName, [x.select("site", "loc") for x in urls]), ["site", "loc"], "left_anti")
    fresh = first.groupBy("site", F.col("_f.seq").alias("seq")).agg(F.count("*").alias("fresh"))
    rows = rows.join(tight, "site", "left").join(fresh, ["site", "seq"], "left").fillna(0, ["fresh"]).fillna(False, ["tight"])
    rows = rows.withColumn("done", F.col("open") & (~F.col("tight") | (F.col("wave") == 0)))
    have = F.col("found") + F.coalesce(F.sum(F.when(F.col("done"), F.col("fresh")).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("have", have).withColumn("done", F.col("done") & (F.col("have") < max_urls))
    rows = rows.withColumn("cut", F.col("done") & (F.col("have") + F.col("fresh") >= max_urls))
    met = F.col("read") + F.count_if(F.expr("done and not skip")).over(W.partitionBy("site")) >= max_files
    rows = rows.withColumn("over", F.max("cut").over(W.partitionBy("site")) | met).withColumn("fresh", F.when(F.col("cut"), max_urls - F.col("have")).otherwise(F.col("fresh")))
    # only files that are done count; of the one that is cut the first new addresses alone
    done = rows.filter("done").select("site", "seq", "have", "cut")
    pages = pages.join(first, ["site", "loc"], "left").withColumn("new", F.coalesce((F.col("_f.seq") == F.col("seq")) & (F.col("_f.pos") == F.col("pos")), F.lit(False))).drop("_f").join(done, ["site", "seq"])
    own = F.when(F.col("cut"), F.sum(F.col("new").cast("int")).over(W.partitionBy("site", "seq").orderBy("pos")))
    pages = pages.withColumn("_own", F.coalesce(own, F.lit(0)))
    # within a cut file: what stands before the last address that is taken was looked at
    looked = F.when(F.col("cut"), F.col("have") + F.col("_own") - F.when(F.col("new"), 1).otherwise(0) < max_urls).otherwise(F.lit(True))
    pages = pages.select("site", "host", "seq", "kind", "pos", "loc", "said", "lastmod", "on", F.lit(0).cast("long").alias("n"), (F.col("new") & looked).alias("taken"), looked.alias("looked"))
    nested = nested.join(done.select("site", "seq"), ["site", "seq"]).withColumn("looked", F.col("n") <= F.col("room"))
    nested = nested.select("site", "host", "seq", "kind", "pos", "loc", "said", "lastmod", "on", "n", (F.col("on") & F.col("looked")).alias("taken"), "looked")
    return nested.unionByName(pages), rows


def _closed(rows: DataFrame, items: DataFrame, max_files: int, max_urls: int) -> DataFrame:
    """(site, read, off, left) of a round: files read, addresses and files of other hosts looked at, whether a limit left something."""
    n = rows.groupBy("site").agg(F.count_if(F.expr("done and not skip")).alias("read"), F.max(F.col("over") & ~F.col("done")).alias("_rest"), F.max(F.col("read") + F.when(F.col("over"), 1).otherwise(0)).alias("_x"), F.max("read").alias("_had"), F.max("over").alias("_over"))
    met = F.col("_over") & (F.col("_had") + F.col("read") >= max_files)
    looked = items.groupBy("site").agg(F.count_if(F.expr("looked and not on")).alias("off"), F.max(~F.col("looked")).alias("_cut"), F.count_if(F.expr("kind = 'sitemap' and taken")).alias("_queued"))
    both = n.join(looked, "site", "left").fillna(0, ["off", "_queued"]).fillna(False, ["_cut"])
    return both.select("site", "read", "off", (F.col("_cut") | F.col("_rest") | met | (F.col("_over") & (F.col("_queued") > 0))).alias("left"))


def _summed(sites: DataFrame, urls: list[DataFrame], notes: list, ends: list[DataFrame]) -> Inventory:
    none = sites.limit(0)
    found = reduce(DataFrame.unionByName, urls) if urls else none.selectExpr("site", "host as loc", "0L as seq", "0 as pos", "host as lastmod")
    before = found.groupBy("site", "seq").agg(F.count("*").alias("_n"))
    before = before.withColumn("_b", F.sum("_n").over(W.partitionBy("site").orderBy("seq")) - F.col("_n")).select("site", "seq", "_b")
    placed = found.join(before, ["site", "seq"]).withColumn("place", F.col("_b") + F.row_number().over(W.partitionBy("site", "seq").orderBy("pos"))).select("site", "place", F.col("loc").alias("url"), "lastmod")
    sums = sites.select("site").join(found.groupBy("site").agg(F.count("*").alias("urls_discovered")), "site", "left")
    if ends:
        closed = reduce(DataFrame.unionByName, ends).groupBy("site").agg(F.sum("read").alias("sitemaps_fetched"), F.sum("off").alias("off_host_ignored"), F.max("left").alias("truncated"))
        sums = sums.join(closed, "site", "left")
    else:
        sums = sums.selectExpr("*", "0L as sitemaps_fetched", "0L as off_host_ignored", "false as truncated")
    sums = sums.fillna(0, ["urls_discovered", "sitemaps_fetched", "off_host_ignored"]).fillna(False, ["truncated"])
    texts, read = [], []
    for rows, items in notes:
        text: Column = F.when(F.col("off"), F.concat(F.lit("Skipped off-host sitemap "), "url", F.lit("."))).when(~F.col("skip") & ~F.col("ok"), F.concat("url", F.lit(" returned "), F.coalesce(F.nullif(F.col("status").cast("string"), F.lit("0")), F.lit("no response")), F.lit(".")))
        texts.append(rows.select("site", "seq", F.lit(0).alias("phase"), F.lit(0).alias("pos"), text.alias("warning")))
        what = F.when(F.col("kind") == "sitemap", F.lit("Skipped off-host child sitemap ")).otherwise(F.lit("Skipped off-host URL "))
        texts.append(items.filter("looked and not on").select("site", "seq", F.when(F.col("kind") == "sitemap", 1).otherwise(2).alias("phase"), "pos", F.concat(what, "said", F.lit(".")).alias("warning")))
        read.append(rows.filter("not skip").select("site", "seq", "url", "ok"))
    if not texts:
        return Inventory(sums, placed, none.selectExpr("site", "0 as place", "host as url", "true as ok"), none.selectExpr("site", "0 as nth", "host as warning"))
    # the first of each text, then the first few: neither gathers a site's warnings
    said = reduce(DataFrame.unionByName, texts).filter("warning is not null").groupBy("site", "warning").agg(F.min(F.struct("seq", "phase", "pos")).alias("w"))
    said = said.withColumn("nth", F.row_number().over(W.partitionBy("site").orderBy("w.seq", "w.phase", "w.pos"))).filter(F.col("nth") <= WARNINGS)
    listed = reduce(DataFrame.unionByName, read).withColumn("place", F.row_number().over(W.partitionBy("site").orderBy("seq")))
    return Inventory(sums, placed, listed.select("site", "place", "url", "ok"), said.select("site", "nth", "warning"))
