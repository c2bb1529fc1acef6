"""Bounded searches: crawls over pages' own links, and sitemap files."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlwright.functions import urls as u
from crawlwright.operators.crawl import crawl
from crawlwright.plans import facts as f
from crawlwright.queries import pages as p
from crawlwright.registry import query, table
from crawlwright.sources.inventory import inventory


def _crawl_sql(limit: int) -> str:
    """One queue a site, taken from step by step."""
    return p.FACTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + rf""",
graph AS (
  SELECT regexp_extract(host, '[a-z]+$') AS site, page_id,
    ['https://' || regexp_extract(host, '[a-z]+$') || lower(regexp_extract(l, '^[a-z]+://[^/]+(/.{{0,2}})', 1)) FOR l IN links] AS hops
  FROM facts WHERE len(links) > 0),
nodes AS (SELECT hops[1] AS url, min(page_id) AS page_id FROM graph GROUP BY hops[1]),
outs AS (SELECT n.url, g.site, n.page_id % 5 <> 0 AS ok, [x FOR x, i IN g.hops IF list_position(g.hops, x) = i] AS ds FROM nodes n JOIN graph g USING (page_id)),
sim(site, queue, queued, loaded) AS (
  SELECT site, [min(url)], [min(url)], CAST([] AS VARCHAR[]) FROM outs WHERE ok GROUP BY site
  UNION ALL
  SELECT site, queue[2:] || new, queued || new, CASE WHEN ok THEN loaded || [queue[1]] ELSE loaded END
  FROM (
    SELECT s.*, coalesce(o.ok, false) AS ok,
      CASE WHEN coalesce(o.ok, false) THEN list_filter(o.ds, lambda x: NOT list_contains(s.queued, x))[1:greatest(0, {limit} - (len(s.queue) - 1) - (len(s.loaded) + 1))] ELSE CAST([] AS VARCHAR[]) END AS new
    FROM sim s LEFT JOIN outs o ON o.url = s.queue[1] WHERE len(s.queue) > 0 AND len(s.loaded) < {limit})),
ends AS (SELECT site, loaded FROM sim WHERE len(queue) = 0 OR len(loaded) >= {limit})
SELECT site, CAST(i AS INTEGER) AS place, loaded[i] AS url FROM (SELECT *, unnest(range(1, len(loaded) + 1)) AS i FROM ends)"""


def _crawled(spark, sf_dir, limit: int):
    """Sites by top-level domain, addresses by the first letters of a link: a page's address is where its first link leads, every fifth page isn't HTML, and links without a page can't be loaded."""
    rows = f.facts(table(spark, sf_dir, "pages")).filter("size(links) > 0").select("page_id", F.regexp_extract("host", "[a-z]+$", 0).alias("site"), "links")
    hop = lambda x: F.concat(F.lit("https://"), F.col("site"), F.lower(F.regexp_extract(x, "^[a-z]+://[^/]+(/.{0,2})", 1)))
    rows = rows.select("page_id", "site", F.transform("links", hop).alias("hops"))
    nodes = rows.groupBy(F.col("hops")[0].alias("url")).agg(F.min_by(F.struct("page_id", "site", "hops"), "page_id").alias("r")).select("url", "r.*")
    pages = nodes.select("url", (F.col("page_id") % 5 != 0).alias("is_html"))
    links = nodes.select(F.col("url").alias("src"), F.posexplode("hops").alias("place", "dst"))
    starts = nodes.filter("page_id % 5 <> 0").select("site", "url")
    return crawl(spark, starts, pages, links, limit).select("site", "place", "url")


@query(_crawl_sql(12))
def crawl_with_little_room(spark, sf_dir):
    return _crawled(spark, sf_dir, 12)


@query(_crawl_sql(1000))
def crawl_of_whole_sites(spark, sf_dir):
    return _crawled(spark, sf_dir, 1000)


_FILES, _URLS = 25, 60
#: Parts as sitemap files of four sites: two nested files each, now and then one that leads back or is of another site, some that aren't there; and their pages.
_SITEMAPS_SQL = f"""
WITH RECURSIVE k AS (SELECT p_partkey % 4 AS site, p_partkey // 4 AS f FROM part),
files AS (
  SELECT 'https://s' || site || '.com/m' || f || '.xml' AS url, f % 11 <> 5 AS ok,
    list_concat([{{'loc': 'https://s' || site || '.com/m' || x || '.xml', 'on_host': true}} FOR x IN CASE WHEN f % 5 = 0 THEN [2 * f + 1, 2 * f + 2, f // 2] ELSE [2 * f + 1, 2 * f + 2] END], CASE WHEN f % 7 = 3 THEN [{{'loc': 'https://s9.com/m' || f || '.xml', 'on_host': false}}] ELSE [] END) AS kids,
    [{{'loc': CASE WHEN i = 3 THEN 'https://other.com/' || f ELSE 'https://s' || site || '.com/p' || ((f * 3 + i) % 83) END, 'on_host': i <> 3}} FOR i IN range(f % 7)] AS locs
  FROM k),
sim(site, queue, seen, urls, off, cut) AS (
  SELECT DISTINCT site, ['https://s' || site || '.com/m0.xml', 'https://s7.com/m1.xml', 'https://s' || site || '.com/m0.xml', 'https://s' || site || '.com/m3.xml'], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), false FROM k
  UNION ALL
  SELECT site, list_concat(queue[2:], [x.loc FOR x IN near IF x.on_host]), CASE WHEN reads THEN list_append(seen, queue[1]) ELSE seen END,
    list_concat(urls, [x.loc FOR x IN look IF x.fresh]), off + len([x FOR x IN near IF NOT x.on_host]) + len([x FOR x IN look IF NOT x.on_host]), cut OR len(near) < len(kids) OR len(look) < len(marked)
  FROM (SELECT *, [x FOR x, i IN kids IF len([y FOR y IN kids[1:i - 1] IF y.on_host]) < room] AS near, [x FOR x, i IN marked IF len([y FOR y IN marked[1:i - 1] IF y.fresh]) < {_URLS} - len(urls)] AS look
    FROM (SELECT *, greatest(0, {_FILES} - (len(seen) + 1 + len(queue) - 1)) AS room, [{{'loc': x.loc, 'on_host': x.on_host, 'fresh': x.on_host AND NOT list_contains(urls, x.loc) AND list_position([y.loc FOR y IN locs], x.loc) = i}} FOR x, i IN locs] AS marked
      FROM (SELECT s.*, starts_with(queue[1], 'https://s' || site || '.com/') AND NOT list_contains(seen, queue[1]) AS reads,
          CASE WHEN starts_with(queue[1], 'https://s' || site || '.com/') AND NOT list_contains(seen, queue[1]) AND f.ok THEN f.kids ELSE [] END AS kids,
          CASE WHEN starts_with(queue[1], 'https://s' || site || '.com/') AND NOT list_contains(seen, queue[1]) AND f.ok THEN f.locs ELSE [] END AS locs
        FROM sim s LEFT JOIN files f ON f.url = s.queue[1] WHERE len(queue) > 0 AND len(seen) < {_FILES} AND len(urls) < {_URLS})))),
ends AS (SELECT * FROM sim WHERE NOT (len(queue) > 0 AND len(seen) < {_FILES} AND len(urls) < {_URLS}))
"""


def _inventory(spark, sf_dir):
    k = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("site"), F.floor(F.col("p_partkey") / 4).alias("f"))
    address = lambda f: F.concat(F.lit("https://s"), F.col("site"), F.lit(".com/m"), f, F.lit(".xml"))
    tag = lambda kind, loc: F.concat(F.lit(f"<{kind}><loc>"), loc, F.lit(f"</loc></{kind}>"))
    next_ = F.array(2 * F.col("f") + 1, 2 * F.col("f") + 2)
    kids = F.transform(F.when(F.col("f") % 5 == 0, F.concat(next_, F.array(F.floor(F.col("f") / 2)))).otherwise(next_), lambda x: tag("sitemap", address(x)))
    away = F.when(F.col("f") % 7 == 3, F.array(tag("sitemap", F.concat(F.lit("https://s9.com/m"), "f", F.lit(".xml"))))).otherwise(F.array().cast("array<string>"))
    page = lambda i: F.when(i == 3, F.concat(F.lit("https://other.com/"), F.col("f"))).otherwise(F.concat(F.lit("https://s"), F.col("site"), F.lit(".com/p"), (F.col("f") * 3 + i) % 83))
    pages = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < F.col("f") % 7), lambda i: tag("url", page(i)))
    files = k.select(address(F.col("f")).alias("url"), (F.col("f") % 11 != 5).alias("ok"), F.lit(200).alias("status"), F.concat_ws("", kids, away, pages).alias("xml"))
    seeds = k.select("site").distinct().select("site", F.concat(F.lit("https://www.s"), "site", F.lit(".com")).alias("start"), F.posexplode(F.array(address(F.lit("0")), F.lit("https://s7.com/m1.xml"), address(F.lit("0")), address(F.lit("3")))).alias("place", "url"))
    return inventory(spark, seeds, files, _FILES, _URLS)


@query(_SITEMAPS_SQL + "SELECT site, CAST(len(urls) AS BIGINT) AS urls_discovered, CAST(len(seen) AS BIGINT) AS sitemaps_fetched, CAST(off AS BIGINT) AS off_host_ignored, cut OR len(queue) > 0 OR len(seen) >= 25 AS truncated FROM ends")
def sitemap_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).sites


@query(_SITEMAPS_SQL + "SELECT site, CAST(i AS BIGINT) AS place, urls[i] AS url FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS i FROM ends)")
def sitemap_addresses(spark, sf_dir):
    return _inventory(spark, sf_dir).urls.select("site", F.col("place").cast("long"), "url")


@query(p.FACTS_SQL + r""", l AS (SELECT page_id, origin, unnest(links) AS href FROM facts), w AS (SELECT page_id, origin, href, regexp_extract(href, '^[a-z]+://[^/]+/(.*)$', 1) AS word FROM l)
SELECT DISTINCT page_id, href, origin || '/' || array_to_string([CASE WHEN regexp_matches(c, '[\x21-\x7e]') THEN c ELSE url_encode(c) END FOR c IN string_split(word, '')], '') || '%20x/' AS address FROM w""")
def link_addresses(spark, sf_dir):
    """Pages' links with dot segments and blanks put into them, in their usual form."""
    rows = f.facts(table(spark, sf_dir, "pages")).select("page_id", "origin", F.explode("links").alias("href")).distinct()
    word = F.regexp_extract("href", "^[a-z]+://[^/]+/(.*)$", 1)
    return rows.select("page_id", "href", u.normalize_url(F.concat("origin", F.lit("/a/./b/../../%2E/"), word, F.lit(" x/y/.."))).alias("address"))
