"""Queries over accounts, imports, backlinks, payments, jobs and discovery files, on rows derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.operators import accounts, backlinks, folds, graph, imports, inventory
from crawlwright.queries import pages as p
from crawlwright.queries.values import _listed, _pick
from crawlwright.registry import query, table
from crawlwright.sources import robots, sitemaps

# --- accounts ----------------------------------------------------------------------------------------------

_DELTA = """f AS (SELECT l_suppkey AS site, l_orderkey AS seq, l_linenumber AS report, 'issue|issue ' || CAST(l_partkey % 30 AS VARCHAR) || '|x.com/p' || CAST(l_orderkey % 4 AS VARCHAR) || '|s' AS key,
  CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 15 THEN 'warning' WHEN l_quantity > 3 THEN 'notice' ELSE 'good' END AS severity FROM lineitem WHERE l_linenumber <= 2),
n AS (SELECT * FROM f WHERE report = 1 AND severity <> 'good'), b AS (SELECT * FROM f WHERE report = 2 AND severity <> 'good'), fb AS (SELECT site, key, arg_min(severity, seq) AS was FROM b GROUP BY ALL),
d AS (SELECT n.site, n.key, seq, CASE WHEN was IS NULL THEN 'new' ELSE 'persistent' END AS status, severity, coalesce(was, '') AS previous_severity FROM n LEFT JOIN fb ON fb.site = n.site AND fb.key = n.key
  UNION ALL SELECT site, key, seq, 'fixed', severity, '' FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.site = b.site AND n.key = b.key))"""


def _delta(spark, sf_dir):
    q = F.col("l_quantity")
    severity = F.when(q > 40, "critical").when(q > 15, "warning").when(q > 3, "notice").otherwise("good")
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("seq"), "l_linenumber", F.lit("issue").alias("type"), F.concat(F.lit("Issue  "), (F.col("l_partkey") % 30).cast("string")).alias("title"), F.concat(F.lit("https://www.X.com/p"), (F.col("l_orderkey") % 4).cast("string"), F.lit("/?q#f")).alias("page_url"), F.lit(" S ").alias("source"), severity.alias("severity"), F.col("l_orderkey").cast("string").alias("evidence"))
    return accounts.delta(rows.filter("l_linenumber = 1").drop("l_linenumber"), rows.filter("l_linenumber = 2").drop("l_linenumber"), "site")


@query("WITH " + _DELTA + " SELECT site, key, status, severity, previous_severity, CAST(seq AS VARCHAR) AS evidence FROM d")
def report_changes(spark, sf_dir):
    return _delta(spark, sf_dir).select("site", "key", "status", "severity", "previous_severity", "evidence")


@query("WITH " + _DELTA + """, g AS (SELECT site, count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'persistent') AS persistent FROM d GROUP BY site),
x AS (SELECT site, sum(CASE WHEN status <> 'fixed' AND severity = 'critical' THEN 1 ELSE 0 END) - sum(CASE WHEN (status = 'fixed' AND severity = 'critical') OR (status = 'persistent' AND previous_severity = 'critical') THEN 1 ELSE 0 END) AS critical_delta FROM d GROUP BY site)
SELECT g.site, fixed, new, persistent, new - fixed AS issues_delta, CAST(critical_delta AS BIGINT) AS critical_delta, CASE WHEN new > fixed THEN '+' ELSE '' END || CAST(new - fixed AS VARCHAR) AS text FROM g JOIN x ON x.site = g.site""")
def report_change_summary(spark, sf_dir):
    return accounts.delta_summary(_delta(spark, sf_dir), "site").select("site", "fixed", "new", "persistent", "issues_delta", "critical_delta", "text")


_PROGRESS = """r AS (SELECT o_custkey % 100 AS account, 's' || CAST(o_orderkey % 5 AS VARCHAR) || '.com' AS host, o_orderkey % 3 AS page, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, o_orderkey % 17 AS issues, o_orderdate AS d, o_orderkey AS id FROM orders),
g AS (SELECT account, host, page, count(*) AS checks, arg_max(score, (d, id)) AS score_now, arg_min(score, (d, id)) AS score_first, arg_max(issues, (d, id)) AS issues_now, arg_min(issues, (d, id)) AS issues_first, min(d) AS since, max(d) AS newest FROM r GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY account, host ORDER BY checks DESC, newest DESC, page) AS n, max(newest) OVER (PARTITION BY account, host) AS latest FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY latest DESC, host) AS nth FROM b WHERE n = 1)"""


@query("WITH " + _PROGRESS + " SELECT o.account, host, checks, score_now, score_now - score_first AS score_change, issues_now, issues_now - issues_first AS issues_change, strftime(since, '%Y-%m-%d') AS since, strftime(latest, '%Y-%m-%d') AS latest, (SELECT strftime(TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * CAST(o.account + min(CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE 0 END) AS INTEGER), '%Y-%m-%d') FROM orders WHERE o_orderkey % 5 <> 1 AND o_custkey % 100 = o.account AND 's' || CAST(o_orderkey % 5 AS VARCHAR) || '.com' = o.host) AS next_check, CAST(nth AS INTEGER) AS nth FROM o WHERE nth <= 4")
def site_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    url = F.concat(F.lit("https://www.s"), (key % 5).cast("string"), F.lit(".com/p"), (key % 3).cast("string"), F.when(key % 2 == 0, "/").otherwise("?q=1"))
    reports = o.select((F.col("o_custkey") % 100).alias("account"), url.alias("url"), (F.floor("o_totalprice") % 101).alias("score"), (key % 17).alias("issues"), F.col("o_orderdate").alias("created_at"), key.alias("id"))
    day = F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("o_custkey") % 100).cast("int"))
    paused = F.when(key % 5 == 1, "paused").when(key % 2 == 0, "active").otherwise(F.lit(None).cast("string"))
    later = F.when(key % 11 == 0, day + F.make_dt_interval(days=F.lit(9))).otherwise(day)
    schedules = o.select((F.col("o_custkey") % 100).alias("account"), F.concat(F.lit("http://s"), (key % 5).cast("string"), F.lit(".com/")).alias("url"), paused.alias("status"), later.alias("next_at"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return accounts.progress(reports, schedules, "account").select("account", "host", "checks", "score_now", "score_change", "issues_now", "issues_change", text("since"), text("latest"), text("next_check"), "nth")


_STATUS = ["open", "in_progress", "drafted", "approved", "applied", "fixed", "ignored", "regressed", "open"]
_RERUN = ["not_run", "not_run", "fixed", "still_open", "not_run", "regressed", "new", "not_run"]
_APPROVAL = ["drafted", "approved", "", "ignored", None]
_EXECUTION = ["applied", "not_started", "", None, "recorded", "", "not_started"]
_ITEMS = f"""i AS (SELECT o_custkey % 100 AS account, o_orderkey % 7 AS site, o_orderkey AS report, o_orderdate AS d, l_linenumber AS item, {_listed('o_orderkey + l_linenumber', _STATUS)} AS status, {_listed('o_orderkey + l_linenumber', _RERUN)} AS rerun,
  {_listed('o_orderkey + l_linenumber', _APPROVAL)} AS approval, {_listed('o_orderkey + l_linenumber', _EXECUTION)} AS execution, {_listed('o_orderkey + l_linenumber', ['critical', 'warning', 'notice', 'other'])} AS severity, CAST(l_quantity AS BIGINT) AS priority, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'x' END AS title FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _items(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("k", F.col("o_orderkey") + F.col("l_linenumber"))
    url = F.concat(F.lit("https://S"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".com/p//"))
    return rows.select((F.col("o_custkey") % 100).alias("account"), url.alias("url"), F.col("o_orderkey").alias("report"), F.col("o_orderdate").alias("created_at"), F.col("l_linenumber").alias("item"), F.when(F.col("l_partkey") % 10 == 0, "").otherwise("x").alias("title"), _pick("k", ["critical", "warning", "notice", "other"]).alias("severity"), _pick("k", _STATUS).alias("status"), _pick("k", _RERUN).alias("rerun"), _pick("k", _APPROVAL).alias("approval"), _pick("k", _EXECUTION).alias("execution"), F.col("l_quantity").cast("long").alias("priority"))


@query("WITH " + _ITEMS + """, l AS (SELECT account, site, arg_max(report, (d, report)) AS last FROM i GROUP BY ALL),
a AS (SELECT i.*, CASE WHEN status = 'regressed' OR rerun IN ('regressed', 'still_open', 'new') THEN 0 WHEN coalesce(approval, '') = 'drafted' OR status = 'drafted' THEN 1 WHEN coalesce(execution, '') = 'applied' OR status = 'applied' THEN 3 WHEN coalesce(approval, '') = 'approved' OR status = 'approved' THEN 2 WHEN status = 'in_progress' THEN 4 ELSE 5 END AS rank
  FROM i JOIN l ON l.account = i.account AND l.site = i.site AND l.last = i.report WHERE title <> '' AND status NOT IN ('fixed', 'ignored')),
o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY rank, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'notice' THEN 2 ELSE 3 END, priority, report, item) AS nth FROM a)
SELECT account, report, item, rank, CASE rank WHEN 0 THEN 'review' WHEN 1 THEN 'approve' WHEN 2 THEN 'apply' WHEN 3 THEN 'rerun' WHEN 4 THEN 'continue' ELSE 'start' END AS action, CAST(nth AS INTEGER) AS nth FROM o WHERE nth <= 6""")
def account_feed(spark, sf_dir):
    return accounts.feed(_items(spark, sf_dir), "account")


@query("WITH " + _ITEMS + """ SELECT account, count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'drafted') AS drafted, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'regressed') AS regressed,
  count(*) FILTER (coalesce(approval, '') = 'drafted' OR status = 'drafted') AS awaiting_approval, count(*) FILTER (rerun = 'not_run' AND status NOT IN ('applied', 'regressed') AND coalesce(execution, '') <> 'applied' AND (coalesce(approval, '') = 'approved' OR status = 'approved')) AS approved_actions,
  count(*) FILTER (status <> 'regressed' AND rerun = 'not_run' AND (status = 'applied' OR coalesce(execution, '') = 'applied')) AS awaiting_rerun FROM i WHERE title <> '' AND status NOT IN ('fixed', 'ignored') GROUP BY account""")
def account_counts(spark, sf_dir):
    return accounts.account_counts(_items(spark, sf_dir), "account")


_TITLE = ["Missing or weak title on home", "Canonical URL redirects on home", "Broken images on home", "Missing  OR weak title on home!", "WordPress plugin is outdated"]


@query(f"""WITH i AS (SELECT p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'finding' ELSE 'plan' END AS kind, p_partkey AS seq, p_size AS priority, p_partkey % 5 AS w, 'https://x.com/' || CAST(p_partkey % 3 AS VARCHAR) AS page_url, {_listed('p_partkey', ['critical', 'warning', 'notice', 'good', 'critical', 'notice', 'warning'])} AS severity, p_partkey % 4 AS f FROM part),
s AS (SELECT *, {_listed('w', ['missing-or-weak-title-on-home', 'canonical-url-redirects-on-home', 'broken-images-on-home', 'missing-or-weak-title-on-home', 'wordpress-plugin-is-outdated'])} AS slug, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS r FROM i WHERE severity <> 'good'),
d AS (SELECT *, row_number() OVER (PARTITION BY brand, slug, page_url ORDER BY r, priority, kind, seq) AS n FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY r, priority, kind, seq) AS nth FROM d WHERE n = 1)
SELECT brand, CAST(nth AS INTEGER) AS nth, page_url, severity, CASE WHEN f = 0 THEN 'unsupported' WHEN w = 4 THEN 'cms_candidate' WHEN f = 2 AND w = 1 THEN 'github_pr_candidate' WHEN f = 2 AND w IN (0, 3) THEN 'generated_proposal' ELSE 'manual_task' END AS mode FROM o WHERE nth <= 25""")
def repair_proposals(spark, sf_dir):
    k = F.col("p_partkey")
    fix, snippet = F.when(k % 4 != 0, "Do it."), F.when(k % 4 == 2, "<x>")
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.when(k % 2 == 0, "finding").otherwise("plan").alias("kind"), k.alias("seq"), F.col("p_size").alias("priority"), _pick("p_partkey", _TITLE).alias("title"), F.concat(F.lit("https://x.com/"), (k % 3).cast("string")).alias("page_url"), _pick("p_partkey", ["critical", "warning", "notice", "good", "critical", "notice", "warning"]).alias("severity"), fix.alias("fix"), snippet.alias("snippet"), F.lit("").alias("source"), F.lit("").alias("work"))
    return accounts.proposals(items, "brand").select("brand", "nth", "page_url", "severity", "mode")


_PACK = "i AS (SELECT l_suppkey AS site, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS priority, 'k' || CAST(l_partkey % 12 AS VARCHAR) AS pattern_key, CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 15 THEN 'warning' ELSE 'notice' END AS severity, l_orderkey % 20 AS page_id, l_partkey % 9 AS gain, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'snippet ' || CAST(l_partkey % 40 AS VARCHAR) END AS snippet FROM lineitem)"


def _pack(spark, sf_dir):
    q, k = F.col("l_quantity"), F.col("l_partkey")
    severity = F.when(q > 40, "critical").when(q > 15, "warning").otherwise("notice")
    snippet = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("snippet "), (k % 40).cast("string")))
    nth = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), nth.alias("priority"), F.concat(F.lit("k"), (k % 12).cast("string")).alias("pattern_key"), severity.alias("severity"), (F.col("l_orderkey") % 20).alias("page_id"), (k % 9).alias("score_gain"), snippet.alias("snippet"))


@query("WITH " + _PACK + " SELECT site, pattern_key, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END AS severity, count(DISTINCT page_id) AS pages, count(*) AS findings, max(gain) AS gain, arg_min(snippet, priority) FILTER (snippet <> '') AS snippet, CAST(min(priority) AS INTEGER) AS first FROM i GROUP BY site, pattern_key")
def grouped_fixes(spark, sf_dir):
    return accounts.grouped_fixes(_pack(spark, sf_dir), "site")


@query("WITH " + _PACK + ", f AS (SELECT site, snippet, min(priority) AS seq FROM i WHERE snippet <> '' GROUP BY ALL) SELECT site, snippet, CAST(row_number() OVER (PARTITION BY site ORDER BY seq) AS INTEGER) AS nth FROM f")
def fix_pack(spark, sf_dir):
    return accounts.fix_pack(_pack(spark, sf_dir).withColumnRenamed("priority", "seq"), "site").select("site", "snippet", "nth")


@query("WITH " + _PACK + " SELECT site, priority AS before, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE severity WHEN 'notice' THEN 0 ELSE 1 END, priority) AS INTEGER) AS priority FROM i")
def merged_plans(spark, sf_dir):
    """A plan of notices put before another plan: one after the other, numbered anew."""
    rows = _pack(spark, sf_dir).withColumn("before", F.col("priority").cast("long")).withColumn("source_seq", F.when(F.col("severity") == "notice", 0).otherwise(1))
    return accounts.merged_plans(rows, "site").select("site", "before", "priority")


@query("WITH " + _PACK + """, f AS (SELECT site, priority AS seq, CAST(priority AS VARCHAR) AS id, pattern_key, page_id FROM i WHERE priority % 2 = 0), a AS (SELECT site, pattern_key, page_id, arg_min(id, seq) AS id FROM f GROUP BY ALL)
SELECT i.site, CAST(priority AS INTEGER) AS nth, i.pattern_key AS plan_title, coalesce(f.id, a.id) AS finding FROM i LEFT JOIN f ON f.site = i.site AND f.id = CAST(priority AS VARCHAR) LEFT JOIN a ON a.site = i.site AND a.pattern_key = i.pattern_key AND a.page_id = i.page_id WHERE priority <= 8""")
def remediation_queue(spark, sf_dir):
    rows = _pack(spark, sf_dir).select("site", "priority", F.col("priority").cast("string").alias("id"), F.col("pattern_key").alias("title"), F.col("page_id").alias("page_url"))
    return accounts.remediation(rows.withColumnRenamed("id", "issue_id"), rows.filter("priority % 2 = 0").withColumn("seq", F.col("priority")), "site")


# --- imports and backlinks ---------------------------------------------------------------------------------

_IMPORT = """k AS (SELECT l_suppkey AS site, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos, l_partkey % 45 AS q, l_partkey % 7 AS pg, l_linenumber AS c, CAST(l_quantity * 150 AS BIGINT) AS i, l_partkey % 30 + 1 AS pos_, l_linenumber % 4 AS m, l_suppkey % 2 = 0 AS shares FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY site, q, pg = 0, CASE WHEN pg = 0 THEN 0 ELSE pg END ORDER BY pos) AS n FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos) AS nth FROM d WHERE n = 1)"""


@query("WITH " + _IMPORT + """ SELECT site, CAST(nth AS INTEGER) AS nth, 'Blue & "Red", lamps ' || CAST(q AS VARCHAR) AS query, 'blue and red lamps ' || CAST(q AS VARCHAR) AS query_key, CASE WHEN pg = 0 THEN '' ELSE 'https://x.com/p' || CAST(pg AS VARCHAR) END AS page_url, CAST(c AS DOUBLE) AS clicks, CAST(i AS DOUBLE) AS impressions,
  CASE m WHEN 0 THEN c / i::DOUBLE WHEN 1 THEN CASE WHEN shares THEN 1.0 ELSE 0.01 END WHEN 2 THEN c / 100.0 ELSE CASE WHEN shares THEN 0.25 ELSE 0.25 END END::DOUBLE AS ctr, CAST(pos_ AS DOUBLE) AS position FROM o WHERE nth <= 250""")
def import_keywords(spark, sf_dir):
    """Pasted keyword rows of each supplier: quoted cells, thousands marks, percents; a site's rates are shares if one of them is."""
    rows = table(spark, sf_dir, "lineitem")
    q, pg, m = (F.col("l_partkey") % 45).cast("string"), F.col("l_partkey") % 7, F.col("l_linenumber") % 4
    shares = F.col("l_suppkey") % 2 == 0
    rate = F.when(m == 0, "").when(m == 1, "1").when(m == 2, F.concat(F.col("l_linenumber").cast("string"), F.lit("%"))).otherwise(F.when(shares, "0.25").otherwise("25%"))
    line = F.concat_ws(",", F.concat(F.lit('"Blue & ""Red"", lamps '), q, F.lit('"')), F.when(pg == 0, "").otherwise(F.concat(F.lit("x.com/p"), pg.cast("string"))), F.col("l_linenumber").cast("string"), F.concat(F.lit('"'), F.format_number(F.col("l_quantity") * 150, 0), F.lit('"')), rate, (F.col("l_partkey") % 30 + 1).cast("string"))
    texts = rows.groupBy(F.col("l_suppkey").alias("site")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", line.alias("x")))).alias("l"))
    texts = texts.select("site", F.concat(F.lit("Top queries,Landing page,Clicks,Impressions,CTR,Avg. position\r\n"), F.array_join(F.transform("l", lambda x: x["x"]), "\r\n")).alias("text"))
    return imports.keywords(imports.cells(texts, "site"), "site").select("site", "nth", "query", "query_key", "page_url", "clicks", "impressions", "ctr", "position")


@query("""WITH k AS (SELECT s_suppkey, unnest(range(0, 9)) AS i FROM supplier), h AS (SELECT *, (s_suppkey + i * i) % 7 AS h FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey, h ORDER BY i) AS n FROM h WHERE h <> s_suppkey % 7), o AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY i) AS nth FROM d WHERE n = 1)
SELECT s_suppkey, CAST(nth AS INTEGER) AS nth, 'https://' || CASE WHEN i % 2 = 0 THEN 'www.' ELSE '' END || 'c' || CAST(h AS VARCHAR) || '.com/' || CASE WHEN i % 3 = 0 THEN 'a' ELSE '' END AS url FROM o WHERE nth <= 5""")
def competitor_lists(spark, sf_dir):
    """Typed lists of competitors: separated by commas and line ends, with the own site, repeats and private hosts among them."""
    key = F.col("s_suppkey")
    names = [F.concat(F.lit("" if i % 4 else "https://"), F.lit("www." if i % 2 == 0 else ""), F.lit("c"), ((key + i * i) % 7).cast("string"), F.lit(".com"), F.lit("/a#x" if i % 3 == 0 else "")) for i in range(9)]
    text = names[0]
    for i, x in enumerate(names[1:]):
        text = F.concat(text, F.lit(", \n,localhost,ftp://x.com\n" if i % 2 else "\n "), x)
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("WWW.c"), (key % 7).cast("string"), F.lit(".com/home")).alias("own"), text.alias("text"))
    return imports.competitors(sites, "s_suppkey", "own", "text")


_BACK = p.FACTS_SQL + """, bl AS (SELECT host, page_id, page_id % 4 < 2 AND page_id % 13 <> 0 AS live, page_id % 4 = 0 AND page_id % 13 <> 0 AS nofollow, page_id % 4 = 1 AND page_id % 13 <> 0 AS sponsored, page_id % 6 = 0 AS broken, CASE WHEN page_id % 5 = 0 THEN 'me' WHEN page_id % 4 < 2 AND page_id % 13 <> 0 THEN 'best shop' ELSE '' END AS anchor FROM facts)"""


def _backlinks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    extra = F.when(n % 4 == 0, '<A HREF=https://me.example.com/x/ REL="NoFollow">Best <b>shop</b></A>').when(n % 4 == 1, "<a rel='sponsored' href='http://www.me.example.com/x#y'>Best  shop</a>").otherwise("")
    source = F.concat(F.lit("https://src.example.com/"), n.cast("string"))
    sources = pages.select(source.alias("source_url"), (n % 13 != 0).alias("ok"), F.concat(extra, F.lit('<a href="/other">Other</a>')).alias("html"))
    rows = p._facts(spark, sf_dir).select("host", "page_id", source.alias("source_url"), F.when(n % 6 == 0, "https://me.example.com/x/?").otherwise("https://me.example.com/x/").alias("t"), F.when(n % 5 == 0, "Me").otherwise("").alias("anchor_text"))
    rows = rows.select("host", "page_id", "source_url", F.lit("https://me.example.com/x/").alias("target_url"), "anchor_text", (n % 6 == 0).alias("gone"))
    hosts = rows.select("host").distinct()
    targets = hosts.select("host", F.lit("https://me.example.com/x").alias("url"), (F.length("host") % 2 == 0).alias("ok"), F.lit(404).alias("status"))
    return backlinks.inspected(rows, "host", sources, targets)


@query(_BACK + " SELECT host, page_id, live, nofollow, sponsored, length(host) % 2 = 0 AS target_ok, anchor FROM bl")
def backlink_inspection(spark, sf_dir):
    return _backlinks(spark, sf_dir).select("host", "page_id", "live", "nofollow", "sponsored", "target_ok", F.lower("anchor").alias("anchor"))


@query(_BACK + " SELECT host, count(*) AS imported, count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS lost, CAST(0 AS BIGINT) AS risky, count(*) FILTER (length(host) % 2 = 1) AS broken_targets, count(*) FILTER (nofollow) AS nofollow, count(*) FILTER (sponsored) AS sponsored FROM bl GROUP BY host")
def backlink_summary(spark, sf_dir):
    return backlinks.summary(_backlinks(spark, sf_dir), "host")


@query(_BACK + ", a AS (SELECT host, anchor, count(*) AS n FROM bl WHERE anchor <> '' GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY host) AS total FROM a) SELECT host, anchor, n, n / total::DOUBLE AS share, CAST(row_number() OVER (PARTITION BY host ORDER BY n DESC, anchor) AS INTEGER) AS nth FROM s WHERE total >= 3 AND n >= 3 AND n >= 0.4 * total")
def anchor_risks(spark, sf_dir):
    return backlinks.anchor_risks(_backlinks(spark, sf_dir).withColumn("own", F.lit("www.shop.example.com")), "host", "own")


# --- payments, jobs, deliveries ----------------------------------------------------------------------------

_KINDS = "CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'refund' WHEN 'view' THEN 'dispute' ELSE 'restored' END"


def _payments(spark, sf_dir):
    kind = F.create_map(*map(F.lit, ["purchase", "paid", "error", "failed", "click", "refund", "view", "dispute", "signup", "restored"]))
    # a few payers of many get a purchase; amounts are whole cents
    e = table(spark, sf_dir, "events").filter("event_type not in ('purchase', 'view') or event_id % 3 = 0")
    return e.select("user_id", "event_id", kind[F.col("event_type")].alias("kind"), F.floor(F.col("value") * 100).cast("double").alias("amount"))


_PAY = f"e AS (SELECT user_id, event_id, {_KINDS} AS kind, floor(value * 100) AS amount FROM events WHERE event_type NOT IN ('purchase', 'view') OR event_id % 3 = 0)"


@query("WITH " + _PAY + """, g AS (SELECT user_id, coalesce(sum(amount) FILTER (kind = 'paid'), 0)::DOUBLE AS paid, coalesce(sum(amount) FILTER (kind = 'refund'), 0)::DOUBLE AS refunded, max(event_id) FILTER (kind = 'dispute') AS d, max(event_id) FILTER (kind = 'restored') AS r, count(*) FILTER (kind = 'paid') AS p, count(*) FILTER (kind = 'failed') AS f FROM e GROUP BY user_id),
x AS (SELECT *, d IS NOT NULL AND (r IS NULL OR r < d) AS disputed FROM g)
SELECT user_id, paid, refunded, disputed, CASE WHEN p = 0 AND f > 0 THEN 'failed' WHEN p = 0 THEN 'waiting' WHEN disputed THEN 'disputed' WHEN refunded > 0 AND refunded >= paid THEN 'refunded' WHEN refunded > 0 THEN 'partially_refunded' ELSE 'paid' END AS status FROM x""")
def payment_status(spark, sf_dir):
    return folds.payment_state(_payments(spark, sf_dir), "user_id", "event_id")


@query("WITH " + _PAY + ", f AS (SELECT user_id, min(event_id) AS first FROM e WHERE kind = 'paid' GROUP BY user_id) SELECT e.user_id, event_id, kind, first AS replayed_after FROM e LEFT JOIN f ON f.user_id = e.user_id WHERE kind IN ('refund', 'dispute') AND (first IS NULL OR event_id < first)")
def early_refunds(spark, sf_dir):
    return folds.unmatched(_payments(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "kind", "replayed_after")


_JOBS = """l AS (SELECT user_id AS job, ts, event_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'busy' ELSE 'failed' END AS kind FROM events),
v AS (SELECT *, lag(kind) OVER (PARTITION BY job ORDER BY ts, event_id) AS before FROM l), k AS (SELECT * FROM v WHERE kind <> 'claimed' OR coalesce(before IN ('queued', 'busy'), false)),
g AS (SELECT job, arg_max(kind, (ts, event_id)) AS last, max(ts) AS since, min(ts) FILTER (kind = 'queued') AS queued_at, (SELECT max(ts) FROM events) AS now FROM k GROUP BY job),
s AS (SELECT *, CASE WHEN last = 'claimed' AND epoch(now) - epoch(since) > 1200 THEN 'failed' WHEN last = 'claimed' THEN 'running' WHEN last = 'busy' AND epoch(since) - epoch(queued_at) >= 7200 THEN 'failed' WHEN last IN ('busy', 'queued') THEN 'queued' ELSE last END AS state, epoch(now) - epoch(since) > 600 AS late FROM g),
w AS (SELECT job FROM s WHERE state = 'queued' AND late ORDER BY since, job LIMIT 3)"""


@query("WITH " + _JOBS + " SELECT job, state, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, job IN (SELECT job FROM w) AS resume FROM s")
def job_lifecycle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*map(F.lit, ["view", "queued", "click", "claimed", "signup", "completed", "purchase", "busy", "error", "failed"]))
    log = e.select(F.col("user_id").alias("job"), "ts", "event_id", kind[F.col("event_type")].alias("kind"))
    now = F.lit(e.agg(F.max("ts").alias("now")).first()["now"])  # one value
    return folds.job_state(log, "job", "ts", "event_id", now).select("job", "state", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "resume")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n = 1")
def daily_alerts(spark, sf_dir):
    return folds.once_a_day(table(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("""WITH t AS (SELECT * FROM (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS nth, [200, 503, 404, 429, 500][l_partkey % 5 + 1] AS st, CAST(l_quantity AS BIGINT) * 150 AS ms FROM lineitem) WHERE nth <= 2),
a AS (SELECT *, CASE WHEN ms >= 5000 THEN 0 ELSE st END AS s FROM t), f AS (SELECT id, s, least(ms, 5000) AS ms, s = 0 OR s = 429 OR s >= 500 AS again FROM a WHERE nth = 1), g AS (SELECT id, s, least(ms, 5000) + 250 AS ms FROM a WHERE nth = 2)
SELECT f.id, CASE WHEN f.again AND g.id IS NOT NULL AND f.ms + g.ms <= 12000 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN f.again AND g.id IS NOT NULL AND f.ms + g.ms <= 12000 THEN f.ms + g.ms ELSE f.ms END::BIGINT AS spent_ms,
  CASE WHEN CASE WHEN f.again AND g.id IS NOT NULL AND f.ms + g.ms <= 12000 THEN g.s ELSE f.s END BETWEEN 200 AND 299 THEN 'delivered' ELSE 'failed' END AS status FROM f LEFT JOIN g ON g.id = f.id""")
def delivery_retries(spark, sf_dir):
    tries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("nth"), _pick("l_partkey", [200, 503, 404, 429, 500], "int").alias("status"), (F.col("l_quantity").cast("long") * 150).alias("ms"))
    return folds.deliveries(tries, "id", "nth")


@query("WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'activated' WHEN 'click' THEN 'charged' WHEN 'error' THEN 'halted' WHEN 'signup' THEN 'cancelled' ELSE 'seen' END AS kind FROM events), g AS (SELECT user_id, arg_max(kind, (ts, event_id)) AS last, max(ts) AS since FROM e WHERE kind <> 'seen' GROUP BY user_id) SELECT user_id, CASE WHEN last IN ('activated', 'charged') THEN 'active' ELSE last END AS status, last IN ('activated', 'charged') AS active, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM g")
def monitoring_entitlement(spark, sf_dir):
    kind = F.create_map(*map(F.lit, ["purchase", "activated", "click", "charged", "error", "halted", "signup", "cancelled", "view", "seen"]))
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind[F.col("event_type")].alias("kind"))
    return folds.monitoring(e, "user_id", "ts", "event_id").withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


_A, _E, _R = ["drafted", "approved", "approved", "Ignored", "approved"], ["not_started", "applied", "", "applied", "blocked", "applied", "applied"], ["not_run", "fixed", "regressed", "nonsense", "still_open", "not_run"]
_ACT = f"a AS (SELECT o_custkey AS k, o_orderkey AS n, lower({_listed('o_orderkey', _A)}) AS a, CASE WHEN {_listed('o_orderkey', _E)} = '' THEN 'not_started' ELSE {_listed('o_orderkey', _E)} END AS e, CASE WHEN {_listed('o_orderkey', _R)} = 'nonsense' THEN 'not_run' ELSE {_listed('o_orderkey', _R)} END AS r, o_orderkey % 11 <> 0 AS proof FROM orders), x AS (SELECT *, CASE WHEN e = 'applied' AND a <> 'approved' THEN 'applied before approved' WHEN r <> 'not_run' AND e <> 'applied' THEN 'rerun before applied' WHEN r <> 'not_run' AND NOT proof THEN 'missing rerun report' END AS error FROM a)"


def _actions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), _pick("o_orderkey", _A).alias("approval"), _pick("o_orderkey", _E).alias("execution"), _pick("o_orderkey", _R).alias("rerun"), F.when(F.col("o_orderkey") % 11 != 0, "r1").alias("report"))


@query("WITH " + _ACT + " SELECT n, error, CASE WHEN r IN ('fixed', 'regressed') THEN r WHEN e = 'applied' THEN 'applied' WHEN a IN ('approved', 'ignored') THEN a ELSE 'drafted' END AS status FROM x")
def action_states(spark, sf_dir):
    c = [F.col(x) for x in ("approval", "execution", "rerun")]
    return _actions(spark, sf_dir).select("n", folds.action_error(*c, F.col("report")).alias("error"), folds.queue_status(*c).alias("status"))


@query("WITH " + _ACT + ", w AS (SELECT *, lag(a) OVER (PARTITION BY k ORDER BY n) AS pa, lag(e) OVER (PARTITION BY k ORDER BY n) AS pe, lag(r) OVER (PARTITION BY k ORDER BY n) AS pr FROM x WHERE error IS NULL) SELECT k, n, 'repair_action.approved' AS event FROM w WHERE a = 'approved' AND coalesce(pa, '') <> 'approved' UNION ALL SELECT k, n, 'repair_action.applied' FROM w WHERE e = 'applied' AND coalesce(pe, '') <> 'applied' UNION ALL SELECT k, n, 'repair_action.' || r FROM w WHERE r IN ('fixed', 'regressed') AND coalesce(pr, '') <> r")
def action_events(spark, sf_dir):
    return folds.action_events(_actions(spark, sf_dir), "k", "n")


# --- discovery ---------------------------------------------------------------------------------------------


@query("WITH " + p.URLS_SQL + """, l AS (SELECT host, CASE WHEN page_id % 7 = 0 THEN 'off' ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') END AS k, page_id % 3 = 0 AS crawled FROM u),
own AS (SELECT host, k, bool_or(crawled) AS seen FROM l WHERE k <> 'off' GROUP BY ALL), g AS (SELECT host, count(*) AS discovered, count(*) FILTER (seen) AS covered FROM own GROUP BY host), s AS (SELECT host, count(*) FILTER (crawled) AS scanned, count(*) FILTER (k = 'off') AS off_host FROM l GROUP BY host)
SELECT s.host, coalesce(discovered, 0) AS discovered, coalesce(covered, 0) AS covered, scanned, CASE WHEN coalesce(discovered, 0) > 0 THEN CAST(floor(covered * 100.0 / discovered + 0.5) AS BIGINT) ELSE 0 END AS coverage, coalesce(discovered, 0) - coalesce(covered, 0) AS uncrawled, off_host FROM s LEFT JOIN g ON g.host = s.host""")
def crawl_inventory(spark, sf_dir):
    """A sitemap that lists every page, each seventh with an address of another site; every third page was crawled."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", p.u.site(F.col("url")).alias("host"), "url")
    listed = pages.select("host", F.when(n % 7 == 0, F.concat(F.lit("https://elsewhere.example.org/"), n.cast("string"))).otherwise(F.col("url")).alias("loc"))
    same = pages.filter(n % 3 == 0).select("host", F.when(n % 7 == 0, F.concat(F.lit("https://x.example.org/"), n.cast("string"))).otherwise(F.col("url")).alias("url"))
    return inventory.inventory(listed, same, "host")


_SCALE = "k AS (SELECT c_custkey, c_custkey % 900 AS rendered, (c_custkey % 4) * 300 AS selected, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 137 % 130000 END AS inventory, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 211 % 150000 WHEN c_custkey % 3 = 1 THEN -5 END AS requested FROM customer), a AS (SELECT *, CASE WHEN coalesce(requested, 0) > 0 THEN least(requested, 100000) ELSE 0 END AS asked FROM k), r AS (SELECT *, asked > selected OR inventory > selected AS ready, CASE WHEN asked > 0 THEN asked ELSE least(greatest(inventory, selected), 50000) END AS target FROM a), pl AS (SELECT *, CASE WHEN inventory > 0 THEN least(inventory, target) ELSE target END AS planned FROM r)"


def _scale(spark, sf_dir):
    k = F.col("c_custkey")
    return inventory.scale_plan(table(spark, sf_dir, "customer").select("c_custkey", (k % 900).alias("rendered"), (k % 4 * 300).alias("selected"), F.when(k % 5 == 0, 0).otherwise(k * 137 % 130000).alias("inventory"), F.when(k % 3 == 0, k * 211 % 150000).when(k % 3 == 1, -5).alias("requested")))


@query("WITH " + _SCALE + " SELECT c_custkey, CASE WHEN ready THEN 'ready' ELSE 'skipped' END AS status, CASE WHEN ready THEN target END AS target, CASE WHEN ready THEN planned END AS planned, CASE WHEN ready THEN (planned + 999) // 1000 END AS batches, CASE WHEN ready THEN CASE WHEN planned > 0 THEN CAST(floor(least(rendered, planned) * 100.0 / planned + 0.5) AS BIGINT) ELSE 0 END END AS coverage, CASE WHEN ready THEN greatest(planned - rendered, 0) END AS unrendered FROM pl")
def rendered_scale_plan(spark, sf_dir):
    return _scale(spark, sf_dir).select("c_custkey", "status", "target", "planned", "batches", "coverage", "unrendered")


@query("WITH " + _SCALE + ", b AS (SELECT c_custkey, planned, unnest(range(1, least((planned + 999) // 1000, 5) + 1)) AS batch FROM pl WHERE ready AND planned > 0) SELECT c_custkey, batch, (batch - 1) * 1000 + 1 AS first, least(batch * 1000, planned) AS last FROM b")
def scale_plan_batches(spark, sf_dir):
    return inventory.batch_preview(_scale(spark, sf_dir), F.col("c_custkey"))


@query("""WITH RECURSIVE r AS (SELECT CAST(p_partkey AS VARCHAR) AS src, CASE WHEN p_partkey % 10 < 7 THEN CAST(p_partkey + 1 AS VARCHAR) WHEN p_partkey % 10 = 7 AND p_partkey % 20 = 7 THEN CAST(p_partkey - 3 AS VARCHAR) ELSE 'end' END AS dst FROM part WHERE p_partkey % 10 <> 9),
w(start, place, hops, seen) AS (SELECT src, dst, 1, [src, dst] FROM r UNION ALL SELECT w.start, r.dst, w.hops + 1, list_append(w.seen, r.dst) FROM w JOIN r ON r.src = w.place WHERE w.hops < 20 AND NOT list_contains(w.seen[:-2], w.place)),
m AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops DESC) AS n FROM w)
SELECT start, place AS final, CAST(hops AS BIGINT) AS hops, list_contains(seen[:-2], place) AS is_loop FROM m WHERE n = 1""")
def redirect_chains(spark, sf_dir):
    """Parts as redirect rules: each to the next up to a seventh, which leads to an end or back into the chain."""
    k = F.col("p_partkey")
    to = F.when(k % 10 < 7, (k + 1).cast("string")).when((k % 10 == 7) & (k % 20 == 7), (k - 3).cast("string")).otherwise("end")
    return graph.redirects(table(spark, sf_dir, "part").filter("p_partkey % 10 <> 9").select(k.cast("string").alias("src"), to.alias("dst")), 20)


@query("""WITH s AS (SELECT s_suppkey, 'd' || CAST(s_suppkey % 4 AS VARCHAR) AS d FROM supplier), q AS (SELECT s_suppkey, d, unnest(['GPTBot/1.0', 'googlebot', 'other']) AS agent FROM s), p AS (SELECT *, unnest(['/', '/d1/x', '/d1/open/y', '/file.pdf', '/file.pdf?x', '/d2']) AS path FROM q)
SELECT s_suppkey, agent, path, CASE WHEN agent = 'GPTBot/1.0' THEN s_suppkey % 3 <> 0 WHEN agent = 'googlebot' THEN CASE WHEN starts_with(path, '/' || d || '/open') THEN true WHEN starts_with(path, '/' || d || '/') THEN false ELSE path <> '/file.pdf' END ELSE NOT (s_suppkey % 2 = 0 AND path = '/d2') END AS allowed FROM p""")
def robots_matrix(spark, sf_dir):
    """Each supplier's robots.txt, for three crawlers and six paths: longest agent name, longest rule, allow at a tie, * and $."""
    key = F.col("s_suppkey")
    d = F.concat(F.lit("/d"), (key % 4).cast("string"))
    text = F.concat(F.lit("# rules\nUser-agent: GoogleBot\nUser-agent: bingbot\nDisallow: "), d, F.lit("/ # inner\r\nAllow: "), d, F.lit("/open\nDisallow: /*.pdf$\n\nuser-agent: gptbot\n"), F.when(key % 3 == 0, "Disallow: /\n").otherwise("Disallow:\n"), F.lit("\nUser-agent: *\n"), F.when(key % 2 == 0, "Disallow: /d2$\n").otherwise("Allow: /\n"))
    sites = table(spark, sf_dir, "supplier").select(key.cast("string").alias("site"), text.alias("text"))
    asked = sites.select("site", F.explode(F.array(*map(F.lit, ["GPTBot/1.0", "googlebot", "other"]))).alias("agent")).select("site", "agent", F.explode(F.array(*map(F.lit, ["/", "/d1/x", "/d1/open/y", "/file.pdf", "/file.pdf?x", "/d2"]))).alias("path"))
    return robots.verdicts(robots.parse(sites), asked).select(F.col("site").cast("long").alias("s_suppkey"), "agent", "path", "allowed")


@query("WITH RECURSIVE f(k) AS (SELECT CAST(1 AS BIGINT) UNION SELECT p_partkey FROM part JOIN f ON p_partkey // 2 = f.k OR p_partkey // 3 = f.k WHERE p_partkey % 3 <> 2) SELECT 'https://x.com/p' || CAST(k AS VARCHAR) AS loc, CAST(2000 + k % 20 AS VARCHAR) AS lastmod FROM f WHERE k % 4 <> 1")
def sitemap_traversal(spark, sf_dir):
    """Sitemap files that list each other down to any depth, and pages in some of them."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("https://x.com/s"), c.cast("string"), F.lit(".xml"))
    part = table(spark, sf_dir, "part").select("p_partkey")
    links = part.filter("p_partkey % 3 <> 2").select(F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("k"), F.concat(F.lit("<sitemap><loc> "), name(k), F.lit(" </loc></sitemap>")).alias("x")).distinct()
    one = links.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("x")), "").alias("x"))
    pages = F.when(F.col("k") % 4 != 1, F.concat(F.lit("<url><loc>/p"), F.col("k").cast("string"), F.lit("</loc><lastmod>"), (2000 + F.col("k") % 20).cast("string"), F.lit("</lastmod></url>"))).otherwise("")
    files = part.select(k.alias("k")).unionByName(spark.range(1, 2).select(F.col("id").alias("k"))).distinct().join(one, "k", "left").select(name(F.col("k")).alias("url"), F.concat(F.coalesce("x", F.lit("")), pages).alias("xml"))
    return sitemaps.pages(files, spark.createDataFrame([("https://x.com/s1.xml",)], "url string"))


@query("WITH " + p._NORMAL.replace("trim(", "x AS (SELECT 1 AS one) SELECT p_partkey, trim(", 1).format("replace(p_name, ' ', ' & ')").replace("'&[a-z0-9#]+;'", "'&'").replace("' ', 'g'), '[^a-z", "' and ', 'g'), '[^a-z", 1) + " AS words FROM part")
def search_texts(spark, sf_dir):
    """Names as keywords are compared: & is a word."""
    return table(spark, sf_dir, "part").select("p_partkey", t.search_text(F.replace("p_name", F.lit(" "), F.lit(" & "))).alias("words"))
