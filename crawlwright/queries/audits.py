"""Audit operators on rows derived from the star schema: parts are queries, suppliers sites, orders pages of time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import classify
from crawlwright.functions import text as t
from crawlwright.operators import audits, platforms, readiness
from crawlwright.plans import probes, sinks
from crawlwright.queries import pages as p
from crawlwright.registry import query, table
from crawlwright.sources import sitemaps

_KEYWORDS_SQL = """
k AS (
  SELECT l_suppkey AS site, 'q' || CAST(l_partkey % 40 AS VARCHAR) AS query, '/p' || CAST(l_partkey % 7 AS VARCHAR) AS page_url,
    CAST(sum(l_quantity) AS BIGINT) AS impressions, CAST(count(*) FILTER (l_linenumber > 4) AS BIGINT) AS clicks,
    CAST(1 + (l_partkey * 7) % 30 AS DOUBLE) AS position, CAST(sum(l_linenumber) AS BIGINT) AS previous_clicks, CAST(1 + (l_partkey * 3) % 30 AS DOUBLE) AS previous_position
  FROM lineitem GROUP BY l_suppkey, l_partkey),
c AS (SELECT *, clicks * 1.0 / impressions AS ctr FROM k),
f AS (SELECT *, impressions >= 100 AND position > 0 AND position <= 10 AND ctr < 0.02 AS low_ctr, impressions >= 50 AND position > 10 AND position <= 20 AS page_two,
  impressions >= 100 AND clicks = 0 AND position > 0 AND position <= 20 AS zero_click,
  (previous_clicks >= 10 AND clicks <= previous_clicks * 0.7) OR position - previous_position >= 3 AS declining FROM c)"""


def _keywords(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("impressions"), F.count_if(F.col("l_linenumber") > 4).alias("clicks"), F.sum("l_linenumber").alias("previous_clicks"))
    part = F.col("l_partkey")
    k = k.select(F.col("l_suppkey").alias("site"), F.concat(F.lit("q"), (part % 40).cast("string")).alias("query"), F.concat(F.lit("/p"), (part % 7).cast("string")).alias("page_url"), "impressions", "clicks", (1 + (part * 7) % 30).cast("double").alias("position"), "previous_clicks", (1 + (part * 3) % 30).cast("double").alias("previous_position"))
    return audits.ctr(k.withColumn("ctr", F.lit(None).cast("string")), by="site")


@query("WITH " + _KEYWORDS_SQL + " SELECT site, count(*) AS imported, count(DISTINCT query) AS queries, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, floor(sum(clicks) * 10000.0 / sum(impressions) + 0.5)::DOUBLE / 10000 AS average_ctr, floor(CAST(sum(position * greatest(impressions, 1)) / sum(greatest(impressions, 1)) AS DOUBLE) * 100 + 0.5) / 100 AS average_position, count(*) FILTER (low_ctr) AS low_ctr, count(*) FILTER (page_two) AS page_two, count(*) FILTER (zero_click) AS zero_click, count(*) FILTER (declining) AS declining FROM f GROUP BY site")
def keyword_summary(spark, sf_dir):
    s = audits.keyword_summary(_keywords(spark, sf_dir), "site")
    return s.withColumns({"average_ctr": F.floor(F.col("clicks") * 10000.0 / F.col("impressions") + 0.5) / 10000, "average_position": F.floor(F.col("average_position") * 100 + 0.5) / 100})


@query("WITH " + _KEYWORDS_SQL + ", r AS (SELECT site, query, page_url, impressions, position, row_number() OVER (PARTITION BY site ORDER BY impressions DESC, position, query) AS nth FROM f WHERE declining) SELECT site, query, impressions, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 12")
def keyword_opportunities(spark, sf_dir):
    return audits.keyword_opportunities(_keywords(spark, sf_dir), "site", "declining").select("site", "query", "impressions", F.col("nth").cast("long"))


@query("WITH " + _KEYWORDS_SQL + " SELECT site, query, pages, impressions FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY impressions DESC, query) AS nth FROM (SELECT site, query, count(DISTINCT page_url) AS pages, CAST(sum(impressions) AS BIGINT) AS impressions FROM f GROUP BY site, query HAVING count(DISTINCT page_url) > 1)) WHERE nth <= 8")
def keyword_cannibalization(spark, sf_dir):
    return audits.cannibalized(_keywords(spark, sf_dir), "site").select("site", "query", "pages", "impressions")


_RESOURCES_SQL = """r AS (
  SELECT l_orderkey AS page, CASE l_linenumber % 4 WHEN 0 THEN 'script' WHEN 1 THEN 'image' WHEN 2 THEN 'stylesheet' ELSE 'font' END AS type, 'h' || CAST(l_suppkey % 20 AS VARCHAR) AS host,
    CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_quantity * 40 AS duration, l_suppkey % 3 = 0 AS first_party FROM lineitem)"""


def _resources(spark, sf_dir):
    kind = classify.resource(F.element_at(F.array(F.lit("script"), F.lit("img"), F.lit("css"), F.lit("font")), F.col("l_linenumber") % 4 + 1), F.lit("/"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), kind.alias("type"), F.concat(F.lit("h"), (F.col("l_suppkey") % 20).cast("string")).alias("host"), F.floor("l_extendedprice").alias("bytes"), (F.col("l_quantity") * 40).alias("duration"), (F.col("l_suppkey") % 3 == 0).alias("first_party"))


_SUM = "CAST(coalesce(sum(bytes) FILTER (type = '{0}'), 0) AS BIGINT) AS {0}_bytes"


@query("WITH " + _RESOURCES_SQL + " SELECT page, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, " + ", ".join(_SUM.format(x) for x in ("script", "stylesheet", "image", "font")) + ", count(*) FILTER (NOT first_party) AS third_party, count(*) FILTER (duration >= 1000) AS slow, max(bytes) AS largest, max(duration) AS longest FROM r GROUP BY page")
def resource_waterfall(spark, sf_dir):
    return audits.waterfall(_resources(spark, sf_dir), "page")


@query("WITH " + _RESOURCES_SQL + ", g AS (SELECT page % 50 AS site, host, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (duration >= 1000) AS slow FROM r WHERE NOT first_party GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY bytes DESC, requests DESC, host) AS nth FROM g) SELECT site, host, requests, bytes, slow, CAST(nth AS BIGINT) AS nth FROM n WHERE nth <= 10")
def third_party_hosts(spark, sf_dir):
    rows = _resources(spark, sf_dir).withColumn("site", F.col("page") % 50)
    return audits.third_party_hosts(rows, "site").withColumn("nth", F.col("nth").cast("long"))


@query("WITH b AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'), p AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 48) SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM b) OR o_orderkey IN (SELECT l_orderkey FROM p)")
def retained_reports(spark, sf_dir):
    keep = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return audits.retained(table(spark, sf_dir, "orders"), keep, "o_orderkey", "o_orderdate", F.lit("1996-01-31").cast("date"), 30).select("o_orderkey")


_CASES = " ".join(f"WHEN {' OR '.join(f'''contains(lower(title), '{w}')''' for w in words)} THEN '{label}'" for label, words in classify.AREAS)
_EFFORT = " ".join(f"WHEN {' OR '.join(f'''contains(lower(title), '{w}')''' for w in words)} THEN '{label}'" for label, words in classify.EFFORTS)


@query(p.FINDINGS_SQL + f" SELECT area, effort, count(*) AS n FROM (SELECT CASE {_CASES} ELSE substr(trim(regexp_replace(lower(string_split(title, ' on ')[1]), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) END AS area, CASE {_EFFORT} ELSE '15-30 min' END AS effort FROM findings) GROUP BY ALL")
def finding_areas(spark, sf_dir):
    title = F.col("title")
    return p._findings(spark, sf_dir).groupBy(classify.area(title).alias("area"), classify.effort(title).alias("effort")).agg(F.count("*").alias("n"))


@query(p.FINDINGS_SQL + p._PLAN + " SELECT host, '# Repairs for ' || host || chr(10) || chr(10) || string_agg(CAST(priority AS VARCHAR) || '. [' || severity || '] ' || title, chr(10) ORDER BY priority) || chr(10) AS brief FROM plan GROUP BY host")
def repair_briefs(spark, sf_dir):
    return sinks.briefs(p.score.plan(p._findings(spark, sf_dir)))


@query(
    p.FINDINGS_SQL + p._PLAN + """, c AS (SELECT host, priority, CAST(priority AS VARCHAR) || ',' || severity || ',' ||
  CASE WHEN regexp_matches(title, '[",\\n\\r]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END || ',' ||
  CASE WHEN regexp_matches(pattern_key, '[",\\n\\r]') THEN '"' || replace(pattern_key, '"', '""') || '"' ELSE pattern_key END AS line FROM plan)
SELECT host, 'priority,severity,title,issue' || chr(10) || string_agg(line, chr(10) ORDER BY priority) || chr(10) AS csv FROM c GROUP BY host"""
)
def fix_list_csv(spark, sf_dir):
    return sinks.fix_list(p.score.plan(p._findings(spark, sf_dir)))


@query("WITH " + p.URLS_SQL + ", d AS (SELECT DISTINCT host, '<url><loc>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc></url>' AS e FROM u) SELECT host, '<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || string_agg(e, '' ORDER BY e) || '</urlset>' AS xml FROM d GROUP BY host")
def sitemap_files(spark, sf_dir):
    return sinks.sitemap(table(spark, sf_dir, "pages").select(p.u.site(F.col("url")).alias("host"), "url"))


@query("WITH " + p.URLS_SQL + " SELECT DISTINCT url AS loc FROM u")
def sitemap_entries(spark, sf_dir):
    """The sitemap sink's files read back by the sitemap source."""
    files = sitemap_files(spark, sf_dir).select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), "xml")
    return sitemaps.entries(files).select("loc")


_DT = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '&[a-z0-9#]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{x}'" for x in t.KEYWORD_STOP_WORDS) + "))[1:8]"


@query(p.FACTS_SQL + f", q AS (SELECT f.page_id, f.title, b.title AS wanted, {_DT.format('b.title')} AS tk FROM facts f JOIN facts b ON b.page_id = f.page_id // 2) SELECT page_id, floor(100.0 * len([x FOR x IN tk IF contains(trim(regexp_replace(regexp_replace(lower(title), '&[a-z0-9#]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), x)]) / greatest(len(tk), 1) + 0.5)::BIGINT AS coverage FROM q WHERE len(tk) >= 2")
def intent_coverage(spark, sf_dir):
    f = p._facts(spark, sf_dir).select("page_id", "title")
    pairs = f.join(f.select(F.col("page_id").alias("other"), F.col("title").alias("wanted")), F.col("other") == F.expr("page_id div 2"))
    tokens = F.slice(t.tokens(F.col("wanted"), t.KEYWORD_STOP_WORDS), 1, 8)
    return pairs.filter(F.size(tokens) >= 2).select("page_id", F.floor(100.0 * t.coverage(tokens, t.normal(F.col("title"))) + 0.5).alias("coverage"))


_CHECKS_SQL = """ch AS (
  SELECT 'https://s.com/' || CAST(l_orderkey % 300 AS VARCHAR) AS page_url, CASE l_linenumber % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 2 THEN 'image' ELSE 'canonical' END AS kind,
    CASE WHEN l_partkey % 11 = 0 THEN 'http://t.com/' ELSE 'https://t.com/' END || CAST(l_partkey AS VARCHAR) AS url,
    CASE l_suppkey % 10 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 522 WHEN 3 THEN NULL ELSE 200 END AS status, CAST(floor(l_extendedprice * 10) AS BIGINT) AS content_length, l_quantity > 40 AS redirected
  FROM lineitem),
fl AS (SELECT *, status IS NOT NULL AND status < 400 AS ok, NOT coalesce(status IN (408, 425, 429, 503), false) AND NOT coalesce(kind = 'internal' AND status BETWEEN 520 AND 526, false) AND (status IS NULL OR status >= 400) AS bad FROM ch),
pp AS (SELECT page_url, count(*) FILTER (kind = 'internal' AND bad) AS broken_internal, count(*) FILTER (kind = 'external' AND bad) AS broken_external,
  count(*) FILTER (kind = 'internal' AND NOT bad AND coalesce(status, 0) <> 429 AND redirected) AS redirecting_internal, count(*) FILTER (kind = 'image' AND bad) AS broken_images,
  count(*) FILTER (kind = 'image' AND ok AND content_length > 500000) AS large_images, count(*) FILTER (kind IN ('internal', 'external', 'image') AND starts_with(url, 'http:')) AS insecure, count(*) FILTER (kind = 'canonical' AND bad) AS canonical_broken, count(*) FILTER (kind = 'canonical' AND NOT bad AND redirected) AS canonical_moved FROM fl GROUP BY page_url)"""


def _checks(spark, sf_dir):
    status = F.when(F.col("l_suppkey") % 10 == 0, 404).when(F.col("l_suppkey") % 10 == 1, 429).when(F.col("l_suppkey") % 10 == 2, 522).when(F.col("l_suppkey") % 10 != 3, 200)
    kind = F.element_at(F.array(F.lit("internal"), F.lit("external"), F.lit("image"), F.lit("canonical")), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("https://s.com/"), (F.col("l_orderkey") % 300).cast("string")).alias("page_url"),
        kind.alias("kind"),
        F.concat(F.when(F.col("l_partkey") % 11 == 0, "http://t.com/").otherwise("https://t.com/"), F.col("l_partkey").cast("string")).alias("url"),
        status.alias("status"),
        F.floor(F.col("l_extendedprice") * 10).alias("content_length"),
        (F.col("l_quantity") > 40).alias("redirected"),
        F.lit(False).alias("guarded"),
        F.lit("").alias("error"),
    )
    return rows.withColumn("ok", F.coalesce(F.col("status") < 400, F.lit(False)))


@query("WITH " + _CHECKS_SQL + " SELECT * FROM pp")
def resource_probes(spark, sf_dir):
    return probes.page_probes(_checks(spark, sf_dir))


@query("WITH " + _CHECKS_SQL + " " + " UNION ALL ".join(f"SELECT page_url, {seq} AS rule_seq, '{sev}' AS severity, '{title}' AS rule FROM pp WHERE {cond}" for seq, title, sev, _, cond in probes.PROBE_RULES))
def probe_findings(spark, sf_dir):
    return probes.probe_findings(_checks(spark, sf_dir)).select("page_url", "rule_seq", "severity", "rule")


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, CAST(floor(s_acctbal / 100) AS BIGINT) AS score, s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) AS mine FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, mine DESC, s_suppkey) AS place FROM s)
SELECT s_nationkey, count(*) FILTER (NOT mine) AS competitors, CAST(max(place) FILTER (mine) AS INTEGER) AS target_rank, max(score) FILTER (mine) AS target_score, CAST(floor(avg(score) FILTER (NOT mine) + 0.5) AS BIGINT) AS average,
  arg_min(s_suppkey, place) FILTER (NOT mine) AS best_host, max(score) FILTER (NOT mine) AS best_score, greatest(0, max(score) FILTER (NOT mine) - max(score) FILTER (mine)) AS gap FROM r GROUP BY s_nationkey""")
def competitor_benchmark(spark, sf_dir):
    first = F.col("s_suppkey") == F.min("s_suppkey").over(W.partitionBy("s_nationkey"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("host"), F.floor(F.col("s_acctbal") / 100).alias("score"), first.alias("mine"))
    return readiness.benchmark(s, "s_nationkey", "mine")


_UTM = "regexp_replace(lower(trim(o_orderpriority)), '\\s+', '-', 'g')"


@query("SELECT o_orderkey, 'https://x.com/p?id=' || CAST(o_custkey AS VARCHAR) || '&utm_source=' || lower(o_orderstatus) || '&utm_campaign=' || " + _UTM + " || '#top' AS link FROM orders")
def utm_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://x.com/p?utm_source=old&id="), F.col("o_custkey").cast("string"), F.lit("#top"))
    return o.select("o_orderkey", platforms.utm(url, source=F.col("o_orderstatus"), medium=F.lit(""), campaign=F.col("o_orderpriority")).alias("link"))


@query("SELECT p_brand AS site, 'shopify' AS id, least(count(*), 4) AS matches, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM part WHERE contains(lower('https://cdn.' || p_name || '.com'), 'blue') GROUP BY p_brand")
def platform_signals(spark, sf_dir):
    name = F.when(F.lower("p_name").contains("blue"), F.lit("https://cdn.shopify.com/x.js")).otherwise(F.lit("https://x.com/app.js"))
    return platforms.detect(table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), name.alias("signal")), "site")


@query("SELECT page_id, contains(regexp_replace(html, '\\D', '', 'g'), CAST(4000000 + page_id AS VARCHAR)) AS phone, contains(lower(html), 'the') AS phrase FROM pages")
def local_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    phone = (F.lit(4000000) + F.col("page_id")).cast("string")
    return pages.select("page_id", platforms.names_phone(F.col("html"), phone).alias("phone"), platforms.names_phrase(F.col("html"), F.lit("The")).alias("phrase"))


_BIG = "r2 AS (SELECT page % 400 AS page, type, bytes, duration, first_party FROM r), w AS (SELECT page, count(*) FILTER (type IN ('script', 'stylesheet') AND duration < 400) AS render_blocking, CAST(coalesce(sum(bytes) FILTER (type = 'script'), 0) AS BIGINT) AS script_bytes, CAST(coalesce(sum(bytes) FILTER (type = 'image'), 0) AS BIGINT) AS image_bytes, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (duration >= 1000) AS slow, count(*) FILTER (NOT first_party) AS third_party FROM r2 GROUP BY page)"


@query("WITH " + _RESOURCES_SQL + ", " + _BIG + " " + " UNION ALL ".join(f"SELECT page, {seq} AS rule_seq, '{sev}' AS severity, '{title}' AS rule FROM w WHERE {cond}" for seq, title, sev, cond in probes.WATERFALL_RULES))
def waterfall_findings(spark, sf_dir):
    rows = _resources(spark, sf_dir).withColumn("page", F.col("page") % 400)
    blocking = rows.groupBy("page").agg(F.count_if(F.col("type").isin("script", "stylesheet") & (F.col("duration") < 400)).alias("render_blocking"))
    return probes.waterfall_findings(audits.waterfall(rows, "page").join(blocking, "page"), "page")


_RENDERED = "f2 AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE h1_count END AS h1, CASE WHEN page_id % 4 = 0 THEN 10 ELSE word_count END AS words, CASE WHEN page_id % 5 = 0 THEN '' ELSE title END AS t, h1_count, word_count, title FROM facts)"


@query(p.FACTS_SQL + ", " + _RENDERED + " SELECT page_id, 22 AS rule_seq, 'H1 exists after render' AS rule FROM f2 WHERE h1 = 0 AND h1_count > 0 UNION ALL SELECT page_id, 24, 'Content is not thin after render' FROM f2 WHERE words < 50 AND word_count >= 250 UNION ALL SELECT page_id, 25, 'Title exists after render' FROM f2 WHERE t = '' AND title <> ''")
def render_guards(spark, sf_dir):
    """Facts of pages against the same with some of them blanked, as a plain fetch would see an app shell."""
    full = p._facts(spark, sf_dir)
    plain = full.withColumns({"h1_count": F.when(F.col("page_id") % 3 == 0, 0).otherwise(F.col("h1_count")), "word_count": F.when(F.col("page_id") % 4 == 0, 10).otherwise(F.col("word_count")), "title": F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("title"))})
    return probes.guards(plain, full).select("page_id", "rule_seq", "rule")
