"""Answers that reports give beside their findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlwright.operators import answers as a
from crawlwright.plans import score
from crawlwright.queries import pages as p
from crawlwright.registry import query, table


@query(p.FINDINGS_SQL + p._PLAN + """, u2 AS (SELECT page_id, url FROM pages), g AS (
  SELECT host, pattern_key, count(*) AS n, min(priority) AS first, arg_min(title, priority) AS title, arg_min(severity, priority) AS severity, string_agg(url, ', ' ORDER BY priority) AS urls FROM plan JOIN u2 USING (page_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first) AS nth FROM g)
SELECT host, CAST(nth AS INTEGER) AS nth, CASE WHEN n > 1 THEN pattern_key || ' (' || n || ' pages)' ELSE title END AS title, CASE WHEN length(urls) > 600 THEN urls[:599] || '…' ELSE urls END AS pages, n, severity FROM r WHERE nth <= 5""")
def fix_prompt_groups(spark, sf_dir):
    plan = score.plan(p._findings(spark, sf_dir)).join(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page")), "page_id")
    return a.fix_groups(plan, "host")


_ITEMS = "CASE WHEN l_linenumber % 4 = 3 THEN 'Fixed ' WHEN l_linenumber % 5 = 2 THEN 'ignored' ELSE 'open' END"


@query(f"""WITH i AS (SELECT l_orderkey AS k, l_linenumber AS place, CASE WHEN l_linenumber % 6 = 1 AND l_partkey % 2 = 0 THEN '' ELSE 'q' || l_linenumber END AS q, 'i' || l_partkey % 4 AS i, 'part ' || l_partkey AS title, {_ITEMS} AS status FROM lineitem),
r AS (SELECT o_orderkey AS k, CASE o_custkey % 4 WHEN 1 THEN 'q' || o_custkey % 7 WHEN 3 THEN 'q2' ELSE '' END AS rq, CASE WHEN o_custkey % 4 >= 2 THEN 'i' || o_custkey % 4 ELSE '' END AS ri FROM orders),
m AS (SELECT r.k, arg_min({{'q': i.q, 'i': i.i, 't': i.title}}, i.place) AS s FROM r JOIN i ON i.k = r.k AND i.q <> '' AND lower(trim(i.status)) NOT IN ('fixed', 'ignored') AND (rq = '' OR rq = i.q) AND (ri = '' OR ri = i.i) GROUP BY r.k)
SELECT r.k AS account, s.q AS queue_id, s.i AS issue_id, s.t AS title, (rq <> '' OR ri <> '') AND s IS NULL AS conflict FROM r LEFT JOIN m ON m.k = r.k""")
def fix_pack_selection(spark, sf_dir):
    text = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    n, part, k = F.col("l_linenumber"), F.col("l_partkey"), F.col("o_custkey") % 4
    place = F.struct(n, "_metadata.file_name", "_metadata.row_index")  # lines of one number come in the table's order, as the SQL meets them on one thread
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("account"), place.alias("place"), F.when((n % 6 == 1) & (part % 2 == 0), "").otherwise(text("q", n)).alias("queue_id"), text("i", part % 4).alias("issue_id"), text("part ", part).alias("title"), F.expr(_ITEMS).alias("status"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("account"), F.when(k == 1, text("q", F.col("o_custkey") % 7)).when(k == 3, "q2").alias("queue_id"), F.when(k >= 2, text("i", k)).otherwise("").alias("issue_id"))
    return a.selected_repair(items, asked, "account")


@query("""WITH c AS (SELECT l_orderkey AS k, l_partkey % 3 AS i, arg_max({'a': l_returnflag, 'n': 'note ' || l_linenumber, 's': l_linestatus}, l_linenumber * 100000000000 + l_partkey * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) % 1000000) AS c FROM lineitem WHERE l_quantity > 20 GROUP BY ALL)
SELECT o_orderkey AS account, o_custkey % 3 AS issue_id, coalesce(c.a, '') AS assignee, coalesce(c.n, '') AS note, coalesce(c.s, '') AS collaboration_status FROM orders LEFT JOIN c ON c.k = o_orderkey AND c.i = o_custkey % 3""")
def repair_board(spark, sf_dir):
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("account"), (F.col("o_custkey") % 3).alias("issue_id"))
    issues = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("account"), (F.col("l_partkey") % 3).alias("issue_id"), F.expr("l_linenumber * 100000000000 + l_partkey * 1000000 + floor(l_extendedprice) % 1000000").alias("seq"), F.col("l_returnflag").alias("assignee"), F.concat(F.lit("note "), "l_linenumber").alias("note"), F.col("l_linestatus").alias("status"))
    return a.with_collaboration(queue, issues, "account")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false
  ELSE l_linenumber % 3 < 2 AND l_extendedprice / 10 <= greatest(1500, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity * 100 ELSE 0 END) END AS blocking FROM lineitem""")
def render_blocking_resources(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "Blocking").when(F.col("l_returnflag") == "A", "non-blocking")
    kind = F.element_at(F.array(F.lit("script"), F.lit("stylesheet"), F.lit("image")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    loaded = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.render_blocking(status, kind, F.col("l_extendedprice") / 10, loaded).alias("blocking"))


@query("""WITH g AS (SELECT l_suppkey AS site, 'seo kit ' || l_partkey % 6 AS plugin, count(*) AS resources, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (l_linenumber * 400 >= 1000) AS slow FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY resources DESC, bytes DESC, plugin) AS INTEGER) AS nth FROM g""")
def plugin_usage(spark, sf_dir):
    folder = F.when(F.col("l_returnflag") == "N", "/themes/").otherwise("/wp-content/Plugins/seo-kit_")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.concat(F.lit("https://x.com"), folder, F.col("l_partkey") % 6, F.lit("/a.js?v=1")).alias("url"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_linenumber") * 400).alias("duration"))
    return a.plugin_usage(rows, "site")


@query("WITH a AS (SELECT unnest(["
       + ", ".join(f"{{'agent': '{x}', 'product': '{y}', 'purpose': '{z}'}}" for x, y, z in a.CRAWLERS)
       + """]) AS c)
SELECT s_suppkey AS site, c.agent AS agent, c.product AS product, c.purpose AS purpose, CASE WHEN c.agent IN ('GPTBot', 'CCBot') THEN s_suppkey % 2 = 0 WHEN c.agent = 'Bingbot' THEN true ELSE s_suppkey % 3 <> 0 END AS allowed FROM supplier, a""")
def crawler_access(spark, sf_dir):
    """Each supplier's robots.txt: two crawlers barred by odd ones, Bing let in, all others barred from /p by every third."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("User-agent: gptbot\nUser-agent: CCBot\n"), F.when(k % 2 == 1, "Disallow: /\n").otherwise("Disallow:\n"), F.lit("\nUser-agent: bingbot\nAllow: /\n\nUser-agent: *\n"), F.when(k % 3 == 0, "Disallow: /p\n").otherwise("Disallow: /q\n"))
    sites = table(spark, sf_dir, "supplier").select(k.cast("string").alias("site"), text.alias("text"))
    out = a.crawler_access(sites, sites.select("site", F.lit("/p/1").alias("path")))
    return out.withColumn("site", F.col("site").cast("long"))


@query("SELECT 'degraded' AS status, count(*) FILTER (o_orderstatus = 'P') || ' parts not working' AS summary, count(*) FILTER (o_orderstatus = 'P') AS down, strftime(max(o_orderdate) FILTER (o_orderstatus = 'F'), '%Y-%m-%d') AS last_completed FROM orders")
def service_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_orderdate").alias("completed_at"))
    out = a.service_status(o.select(F.col("o_orderkey").alias("part"), (F.col("o_orderstatus") != "P").alias("ok")), jobs)
    return out.withColumn("last_completed", F.date_format("last_completed", "yyyy-MM-dd"))
