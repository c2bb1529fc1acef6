"""Issues over a site's reports, and proofs of repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlwright.operators import history as h
from crawlwright.registry import query, table

#: Customers as sites, their orders as reports, the line items as findings: the part's number modulo 9 is the issue.
_REPORTS_SQL = """WITH r AS (
  SELECT o_custkey AS site, o_orderkey AS report, CAST(floor(o_totalprice) AS BIGINT) % 100 AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS n, count(*) OVER (PARTITION BY o_custkey) AS latest FROM orders),
f AS (SELECT l_orderkey AS report, l_partkey % 9 AS key, CASE l_linenumber % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END AS severity FROM lineitem WHERE l_linestatus = 'F' OR l_linenumber < 6),
d AS (SELECT DISTINCT r.site, r.n, r.report, f.key FROM r JOIN f USING (report))"""


def _reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reports = h.numbered_reports(o.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("report"), F.col("o_orderdate").alias("at"), (F.floor("o_totalprice") % 100).alias("score")), "site")
    severity = F.when(F.col("l_linenumber") % 3 == 0, "critical").when(F.col("l_linenumber") % 3 == 1, "warning").otherwise("notice")
    lines = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F' or l_linenumber < 6")
    found = lines.select(F.col("l_orderkey").alias("report"), (F.col("l_partkey") % 9).alias("key"), severity.alias("severity"))
    return reports, found


@query(_REPORTS_SQL + """,
b AS (SELECT d.*, NOT EXISTS (SELECT 1 FROM d p WHERE p.site = d.site AND p.key = d.key AND p.n = d.n - 1) AS begins, NOT EXISTS (SELECT 1 FROM d p WHERE p.site = d.site AND p.key = d.key AND p.n = d.n + 1) AS ends FROM d),
s AS (SELECT site, key, n, row_number() OVER (PARTITION BY site, key ORDER BY n) AS run FROM b WHERE begins),
e AS (SELECT site, key, n, row_number() OVER (PARTITION BY site, key ORDER BY n) AS run FROM b WHERE ends)
SELECT s.site, s.key, CAST(s.run AS BIGINT) AS run, s.n AS first, e.n AS last, CASE WHEN e.n < r.latest THEN e.n + 1 END AS fixed FROM s JOIN e USING (site, key, run) JOIN r ON r.site = s.site AND r.n = 1""")
def issue_runs(spark, sf_dir):
    reports, found = _reports(spark, sf_dir)
    return h.issue_runs(reports, found, "site").select("site", "key", F.col("run").cast("long"), "first", "last", "fixed")


@query(_REPORTS_SQL + """,
c AS (SELECT r.site, r.n, count(DISTINCT key) AS issues, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'notice') AS notice FROM r JOIN f USING (report) GROUP BY ALL),
m AS (
  SELECT r.*, p.score AS score_before, coalesce(c.issues, 0) AS issues, coalesce(c.critical, 0) - coalesce(q.critical, 0) AS critical_delta, coalesce(c.warning, 0) - coalesce(q.warning, 0) AS warning_delta, coalesce(c.notice, 0) - coalesce(q.notice, 0) AS notice_delta,
    (SELECT count(*) FROM d x WHERE x.site = r.site AND x.n = r.n AND NOT EXISTS (SELECT 1 FROM d y WHERE y.site = x.site AND y.key = x.key AND y.n = r.n - 1)) AS new,
    (SELECT count(*) FROM d x WHERE x.site = r.site AND x.n = r.n AND NOT EXISTS (SELECT 1 FROM d y WHERE y.site = x.site AND y.key = x.key AND y.n = r.n - 1) AND EXISTS (SELECT 1 FROM d y WHERE y.site = x.site AND y.key = x.key AND y.n < r.n - 1)) AS returned,
    (SELECT count(*) FROM d x WHERE x.site = r.site AND x.n = r.n - 1 AND NOT EXISTS (SELECT 1 FROM d y WHERE y.site = x.site AND y.key = x.key AND y.n = r.n)) AS fixed
  FROM r JOIN r p ON p.site = r.site AND p.n = r.n - 1 LEFT JOIN c ON c.site = r.site AND c.n = r.n LEFT JOIN c q ON q.site = r.site AND q.n = r.n - 1)
SELECT site, report, n, score - score_before AS score_delta, issues, new, returned, fixed, issues - new AS persistent, critical_delta, warning_delta FROM m WHERE report % 2 = 0 AND (new > 0 OR critical_delta > 0 OR warning_delta > 0)""")
def monitored_regressions(spark, sf_dir):
    """Every second report is monitored."""
    reports, found = _reports(spark, sf_dir)
    worse = h.regressions(h.report_deltas(reports, found, "site"), reports.filter("report % 2 = 0"), "site")
    return worse.select("site", "report", "n", "score_delta", "issues", "new", "returned", "fixed", "persistent", "critical_delta", "warning_delta")


@query("""WITH issues AS (
  SELECT l_orderkey AS proof, l_linestatus = 'F' AS gone, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'i' || l_partkey % 7 END AS id, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'warning|issue ' || l_partkey % 5 || '|e.com/p' || l_suppkey % 3 || '|crawl' END AS key FROM lineitem),
actions AS (
  SELECT o_orderkey AS action, o_orderkey AS proof, CASE o_custkey % 3 WHEN 0 THEN 'still_open' ELSE 'fixed' END AS state, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'i' || o_custkey % 7 END AS id,
    CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'warning|issue ' || o_custkey % 5 || '|' || CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'e.com/p' || o_custkey % 3 END || '|crawl' END AS key, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'e.com/p' || o_custkey % 3 END AS page FROM orders),
pages AS (SELECT DISTINCT l_orderkey AS proof, 'e.com/p' || (l_suppkey + 1) % 3 AS page FROM lineitem),
m AS (SELECT a.*, EXISTS (SELECT 1 FROM issues i WHERE i.proof = a.proof AND i.gone AND i.key <> '' AND i.key = a.key) AS fk, EXISTS (SELECT 1 FROM issues i WHERE i.proof = a.proof AND i.gone AND i.id <> '' AND i.id = a.id AND (i.key = '' OR a.key = '')) AS fi,
  EXISTS (SELECT 1 FROM issues i WHERE i.proof = a.proof AND NOT i.gone AND i.key <> '' AND i.key = a.key) AS ck, EXISTS (SELECT 1 FROM issues i WHERE i.proof = a.proof AND NOT i.gone AND i.id <> '' AND i.id = a.id AND (i.key = '' OR a.key = '')) AS ci,
  a.page = '' OR EXISTS (SELECT 1 FROM pages p WHERE p.proof = a.proof AND p.page = a.page) AS covered FROM actions a)
SELECT action, CASE WHEN state = 'fixed' THEN CASE WHEN fk THEN 'key' WHEN fi THEN 'id' WHEN NOT ck AND NOT ci AND covered THEN 'page' END WHEN ck THEN 'key' WHEN ci THEN 'id' END AS stage FROM m""")
def repair_proofs(spark, sf_dir):
    """Orders as actions and as their proofs, line items as the proofs' issues; some have no title, some no id."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, part = F.col("o_custkey"), F.col("l_partkey")
    actions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("action"), F.col("o_orderkey").alias("proof"), F.when(k % 3 == 0, " Still_open").otherwise("fixed").alias("state"), F.when(k % 5 != 0, text("i", k % 7)).alias("id"), F.lit("Warning").alias("type"),
        F.when(k % 4 != 0, text("Issue  ", k % 5)).alias("title"), F.when(k % 7 != 0, text("https://www.E.com/p", k % 3, "/?q=1#z")).alias("page_url"), F.lit(" crawl").alias("source"),
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("proof", F.col("l_orderkey"))
    issues = lines.select(
        "proof", F.when(F.col("l_linestatus") == "F", "fixed").otherwise("current").alias("origin"), F.when(F.col("l_linenumber") % 4 != 0, text("i", part % 7)).alias("id"), F.lit("warning").alias("type"),
        F.when(part % 3 != 0, text("ISSUE ", part % 5)).alias("title"), text("http://e.com/p", F.col("l_suppkey") % 3).alias("page_url"), F.lit("crawl").alias("source"),
    )
    pages = lines.select("proof", text("https://e.com/p", (F.col("l_suppkey") + 1) % 3, "/").alias("url"))
    return h.proved(actions, issues, pages).select("action", "stage")
