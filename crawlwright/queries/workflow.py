"""Workflow operators on rows derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlwright.functions import urls as u
from crawlwright.operators import workflow as ops
from crawlwright.plans import rules
from crawlwright.queries import pages as p
from crawlwright.registry import query, table


@query("WITH " + p.URLS_SQL + r""", k AS (SELECT page_id, CASE WHEN starts_with(full_host, 'www.') THEN 'www' ELSE 'bare' END AS job, host || CASE WHEN regexp_replace(path, '/$', '') = '' THEN '/' ELSE regexp_replace(path, '/$', '') END AS url_key FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY job, url_key ORDER BY page_id) AS n FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY page_id) AS priority FROM f WHERE n = 1)
SELECT job, page_id, url_key, CAST(priority AS BIGINT) AS priority, CAST(floor((priority - 1) / 10) + 1 AS BIGINT) AS batch FROM o""")
def crawl_frontier(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.when(u.host(F.col("url")).startswith("www."), "www").otherwise("bare").alias("job"))
    return ops.frontier(rows, "job", u.page_key(F.col("url")), ["page_id"], 10).select("job", "page_id", "url_key", F.col("priority").cast("long"), "batch")


@query("""WITH s AS (SELECT o_orderstatus AS job, o_custkey AS k, min(o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), st AS (SELECT job, count(*) AS last FROM s GROUP BY job),
n AS (SELECT DISTINCT o_orderstatus AS job, o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1), a AS (SELECT n.job, n.k FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.job = n.job AND s.k = n.k)),
r AS (SELECT a.job, a.k, row_number() OVER (PARTITION BY a.job ORDER BY a.k) + coalesce(st.last, 0) AS priority FROM a LEFT JOIN st ON st.job = a.job)
SELECT job, k, CAST(priority AS BIGINT) AS priority, CAST(floor((priority - 1) / 1000) + 1 AS BIGINT) AS batch FROM r""")
def frontier_ingestion(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("job"), F.col("o_custkey").alias("k"), "o_orderkey")
    stored = ops.frontier(o.filter("o_orderkey % 2 = 0"), "job", F.col("k"), ["o_orderkey"], 1000)
    new = ops.extended(stored, o.filter("o_orderkey % 2 = 1").select("job", "k"), "job", "k", ["k"], 1000)
    return new.select("job", "k", F.col("priority").cast("long"), "batch")


_STATES = "CASE o_orderstatus WHEN 'F' THEN 'rendered' WHEN 'O' THEN 'queued' ELSE 'failed' END"


@query(f"SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'rendered') AS rendered, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'rendered') = count(*) AS ready FROM (SELECT *, {_STATES} AS s FROM orders) GROUP BY o_custkey")
def merge_readiness(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.expr(_STATES).alias("state"))
    return ops.batch_states(rows, "job")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS beats, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE AS expired FROM events GROUP BY user_id")
def lease_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    rows = ops.leases(e, "user_id", "ts", F.lit(now.first()["now"]), 15)
    return rows.select("user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "beats", "expired")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01' ORDER BY orders.o_orderdate, o_orderkey LIMIT 5")
def due_schedules(spark, sf_dir):
    rows = ops.due(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", F.lit("1995-06-01").cast("timestamp_ntz"), 5)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query(p.FINDINGS_SQL + """, fi AS (SELECT host, title, min(severity_rank) AS rank, min(finding_seq) AS seq FROM findings GROUP BY host, title),
sv AS (SELECT DISTINCT host, title, 'done' AS status FROM findings WHERE rule_seq = 49 UNION ALL SELECT DISTINCT host, 'Old repair', 'applied' FROM findings),
both_sides AS (SELECT coalesce(fi.host, sv.host) AS host, coalesce(fi.title, sv.title) AS title, fi.rank, fi.seq, fi.host IS NULL AS gone, coalesce(sv.status, 'open') AS status FROM fi FULL JOIN sv ON sv.host = fi.host AND sv.title = fi.title),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY gone, rank, seq, title) AS place FROM both_sides)
SELECT host, title, status, CASE WHEN gone THEN 'saved' ELSE 'finding' END AS origin, CAST(place AS BIGINT) AS place FROM r WHERE place <= 100""")
def repair_queue(spark, sf_dir):
    found = p._findings(spark, sf_dir)
    items = found.groupBy("host", "title").agg(F.min(rules.severity_rank(F.col("severity"))).alias("rank"), F.min("finding_seq").alias("seq"))
    saved = found.filter("rule_seq = 49").select("host", "title", F.lit("done").alias("status")).distinct().unionByName(found.select("host", F.lit("Old repair").alias("title"), F.lit("applied").alias("status")).distinct())
    return ops.repair_queue(items, saved, "host", "title", F.col("rank")).select("host", "title", "status", "origin", F.col("place").cast("long"))


@query("""WITH o AS (SELECT o_custkey % 50 AS k, CAST(count(*) AS BIGINT) AS used, CASE WHEN o_custkey % 50 % 3 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS BIGINT) END AS stored FROM orders GROUP BY ALL),
d AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey * 10 AS BIGINT) AS std FROM nation)
SELECT o.k, used, greatest(coalesce(stored, 0), coalesce(std, 0)) AS granted, greatest(0, greatest(coalesce(stored, 0), coalesce(std, 0)) - used) AS remaining FROM o LEFT JOIN d ON d.k = o.k""")
def entitlement_limits(spark, sf_dir):
    k = F.col("o_custkey") % 50
    owned = table(spark, sf_dir, "orders").groupBy(k.alias("k")).agg(F.count("*").alias("used")).withColumn("stored", F.when(F.col("k") % 3 != 0, F.col("k")))
    defaults = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_regionkey") * 10).cast("long").alias("default"))
    return ops.limits(owned, defaults, "k").select("k", "used", "granted", "remaining")
