"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.functions import urls as u
from crawlwright.operators.similarity import similar_sets
from crawlwright.plans import facts as f
from crawlwright.plans import rules, score
from crawlwright.registry import query, table

_NAMES = ", ".join(f"'{x}'" for x in u.PARAMETER_NAMES)
_STOP = ", ".join(f"'{x}'" for x in t.STOP_WORDS)


def _decoded(s: str) -> str:
    for entity, char in (("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{entity}', '{char}')"
    return s


def _plain(s: str) -> str:
    inner = _decoded(f"regexp_replace({s}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'))"


def _tokens(s: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace(lower({s}), '&[a-z0-9#]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    return f"list_filter(string_split({clean}, ' '), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


URLS_SQL = r"""
u AS (
  SELECT page_id, url, html,
    lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':\d+$', '') AS full_host,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '') AS host,
    lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS authority,
    CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS path,
    regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS search
  FROM pages)"""

FACTS_SQL = (
    "WITH "
    + URLS_SQL
    + rf""",
m AS (
  SELECT *, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g') AS markup,
    regexp_extract(html, '(?is)<head\b[^>]*>(.*?)</head>', 1) AS head
  FROM u),
b AS (SELECT *, regexp_replace(CASE WHEN regexp_extract(markup, '(?is)(<body.*?</body>)', 1) = '' THEN markup ELSE regexp_extract(markup, '(?is)(<body.*?</body>)', 1) END, '(?is)<noscript.*?</noscript>', '', 'g') AS shown FROM m),
x AS (
  SELECT page_id, url, scheme, host, path, scheme || '://' || authority AS origin,
    trim({_decoded("regexp_replace(regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")}) AS title,
    regexp_extract(html, '(?is)<html\b[^>]*lang=["'']([^"'']+)["'']', 1) AS lang,
    regexp_extract(html, '(?is)<meta\b[^>]*charset=["'']?([^"''\s/>]+)', 1) AS charset,
    starts_with(lower(ltrim(html)), '<!doctype html') AS doctype,
    [CAST(z AS INTEGER) FOR z IN regexp_extract_all(markup, '{_q(f.HEADING_LEVEL.replace("(?is)<h([1-6])", "(?is)<h([1-6])"))}', 1)] AS levels,
    [{_plain("z")} FOR z IN regexp_extract_all(markup, '{_q(f.HEADING_TEXT)}', 1)] AS headings,
    regexp_extract_all(markup, '{_q(f.LINK)}', 1) AS hrefs,
    [{_plain("z")} FOR z IN regexp_extract_all(markup, '{_q(f.LINK_TEXT)}', 1)] AS link_texts,
    len(regexp_extract_all(markup, '(?is)(<img\b[^>]*>)', 1)) AS images,
    {_plain("shown")} AS body_text
  FROM b),
y AS (
  SELECT *, [CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN scheme || ':' || h
      WHEN starts_with(h, '/') THEN origin || h WHEN starts_with(h, '?') THEN origin || path || h
      WHEN starts_with(h, '#') THEN regexp_replace(url, '#.*$', '') || h ELSE origin || regexp_replace(path, '[^/]*$', '') || h END FOR h IN hrefs] AS links,
    CASE WHEN body_text = '' THEN 0 ELSE len(string_split(body_text, ' ')) END AS word_count,
    len([l FOR l IN levels IF l = 1]) AS h1_count,
    row_number() OVER (PARTITION BY host ORDER BY page_id) AS page_seq
  FROM x),
facts AS (
  SELECT *, CASE WHEN page_seq = 1 THEN 'home' ELSE path END AS label,
    len([l FOR l IN links IF starts_with(lower(l), origin || '/') OR lower(l) = origin]) AS inner_links
  FROM y)"""
)

#: The same rules over what the test pages have: no description, canonical, viewport, icons, images, JSON-LD or robots.
_FIRED = [
    (40, "Missing or weak title", "critical", "length(title) < 12"),
    (41, "Long title", "warning", "length(title) > 65"),
    (42, "Missing meta description", "critical", "true"),
    (44, "Missing H1", "critical", "h1_count = 0"),
    (45, "Multiple H1s", "warning", "h1_count > 1"),
    (46, "Heading hierarchy needs cleanup", "warning", "len(levels) > 0 AND (levels[1] <> 1 OR len([i FOR i IN range(1, len(levels)) IF levels[i + 1] - levels[i] > 1]) > 0)"),
    (47, "Thin rendered content", "warning", "word_count < 250"),
    (48, "No rendered internal links", "critical", "inner_links = 0"),
    (49, "Missing canonical URL", "warning", "true"),
    (50, "Viewport meta tag missing", "warning", "true"),
    (51, "HTML language missing", "notice", "lang = ''"),
    (52, "Character encoding missing", "notice", "charset = ''"),
    (53, "HTML doctype missing", "notice", "NOT doctype"),
    (56, "Social share image incomplete", "warning", "true"),
    (58, "Apple touch icon missing", "notice", "true"),
    (61, "Structured data opportunity", "notice", "true"),
    (62, "Page is not served over HTTPS", "warning", "starts_with(url, 'http:') AND host <> 'localhost'"),
]
FINDINGS_SQL = (
    FACTS_SQL
    + ",\nraw_findings AS ("
    + "\nUNION ALL ".join(f"SELECT host, page_id, page_seq, label, {seq} AS rule_seq, '{sev}' AS severity, '{title}' AS rule FROM facts WHERE {cond}" for seq, title, sev, cond in _FIRED)
    + r"""),
findings AS (
  SELECT *, rule || ' on ' || label AS title,
    trim(regexp_replace(regexp_replace(rule || ' on ' || label, '\son\s(home|/[^\s]+)', '', 'i'), '(?is)\sneeds cleanup.*', ' needs cleanup')) AS pattern_key,
    row_number() OVER (PARTITION BY host ORDER BY page_seq, rule_seq) AS finding_seq,
    CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank
  FROM raw_findings)"""
)


def _groups(by: str, name: str = "groups") -> str:
    return f""",
{name} AS (
  SELECT {by}, pattern_key, count(*) AS n,
    (CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN least(28.0, 12.0 + 4.0 * (count(*) FILTER (severity = 'critical') - 1)) ELSE 0 END
    + CASE WHEN count(*) FILTER (severity = 'warning') > 0 THEN least(10.0, 5.0 + 1.5 * (count(*) FILTER (severity = 'warning') - 1)) ELSE 0 END
    + CASE WHEN count(*) FILTER (severity = 'notice') > 0 THEN least(3.0, 1.0 + 0.25 * (count(*) FILTER (severity = 'notice') - 1)) ELSE 0 END)::DOUBLE AS cost
  FROM findings GROUP BY {by}, pattern_key)"""


def _score(penalty: str) -> str:
    return f"CAST(greatest(0, least(100, floor(100.5 - coalesce({penalty}, 0)))) AS INTEGER)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.facts(table(spark, sf_dir, "pages"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(_facts(spark, sf_dir))


@query(FACTS_SQL + " SELECT page_id, host, title, lang, charset, doctype, CAST(word_count AS BIGINT) AS word_count, CAST(h1_count AS BIGINT) AS h1_count, CAST(len(links) AS BIGINT) AS n_links, CAST(inner_links AS BIGINT) AS inner_links, CAST(images AS BIGINT) AS images, CAST(page_seq AS BIGINT) AS page_seq, label FROM facts")
def page_facts(spark, sf_dir):
    big = lambda c: F.col(c).cast("long").alias(c)
    return _facts(spark, sf_dir).select("page_id", "host", "title", "lang", "charset", "doctype", big("word_count"), big("h1_count"), F.size("links").cast("long").alias("n_links"), big("inner_links"), big("images"), big("page_seq"), "label")


@query(FACTS_SQL + " SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, links[i] AS href, link_texts[i] AS link_text, CASE WHEN starts_with(lower(links[i]), origin || '/') OR lower(links[i]) = origin THEN 'internal' ELSE 'external' END AS kind FROM (SELECT *, unnest(range(1, len(links) + 1)) AS i FROM facts)")
def page_links(spark, sf_dir):
    z = F.arrays_zip(F.col("links").alias("href"), F.col("link_texts").alias("link_text"))
    rows = _facts(spark, sf_dir).select("page_id", "origin", F.posexplode(z).alias("pos", "l"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("l.href").alias("href"), F.col("l.link_text").alias("link_text"), F.when(u.origin(F.col("l.href")) == F.col("origin"), "internal").otherwise("external").alias("kind"))


@query("WITH " + URLS_SQL + " SELECT page_id, scheme, full_host, host, path, search, scheme || '://' || authority AS origin FROM u")
def url_parts(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.scheme(c).alias("scheme"), u.host(c).alias("full_host"), u.site(c).alias("host"), u.path(c).alias("path"), u.search(c).alias("search"), u.origin(c).alias("origin"))


@query(
    "WITH " + URLS_SQL + r""" SELECT page_id,
  CASE WHEN path = '/' THEN regexp_replace(url, '#.*$', '') ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') END AS no_hash,
  host || CASE WHEN regexp_replace(path, '/$', '') = '' THEN '/' ELSE regexp_replace(path, '/$', '') END AS page_key,
  scheme || '://' || host || CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '/+$', '') END || search AS graph_key,
  'https://' || host || CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '/+$', '') END || search AS https_key,
  regexp_replace(scheme || '://' || authority || path || CASE WHEN length(search) > 1 THEN '?' || array_to_string([x.x FOR x IN list_sort([{'n': string_split(y, '=')[1], 'x': y} FOR y IN string_split(substr(search, 2), '&')])], '&') ELSE '' END, '/$', '') AS sorted_key
FROM u"""
)
def url_keys(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.strip_hash(c).alias("no_hash"), u.page_key(c).alias("page_key"), u.graph_key(c).alias("graph_key"), u.https_key(c).alias("https_key"), u.sorted_key(c).alias("sorted_key"))


@query(
    "WITH " + URLS_SQL + rf""", n AS (SELECT page_id, [lower(string_split(x, '=')[1]) FOR x IN string_split(substr(search, 2), '&')] AS names FROM u)
SELECT page_id, len([x FOR x IN names IF x IN ({_NAMES}) OR regexp_matches(x, '{u.PARAMETER_PREFIX}')]) > 0 AS risky,
  len([x FOR x IN names IF x IN ({", ".join(f"'{x}'" for x in u.FACET_NAMES)}) OR regexp_matches(x, '{u.FACET_PREFIX}')]) > 0 AS faceted FROM n"""
)
def parameter_urls(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.parameter_risk(c).alias("risky"), u.faceted(c).alias("faceted"))


@query(FINDINGS_SQL + " SELECT host, CAST(finding_seq AS BIGINT) AS finding_seq, page_id, CAST(rule_seq AS BIGINT) AS rule_seq, severity, title, pattern_key FROM findings")
def findings_long(spark, sf_dir):
    return _findings(spark, sf_dir).select("host", F.col("finding_seq").cast("long"), "page_id", F.col("rule_seq").cast("long"), "severity", "title", "pattern_key")


@query(
    FINDINGS_SQL + _groups("page_id") + f""", p AS (SELECT page_id, sum(cost) AS penalty FROM groups GROUP BY page_id),
c AS (SELECT page_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices FROM findings GROUP BY page_id)
SELECT f.page_id, {_score("penalty")} AS score, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings, coalesce(notices, 0) AS notices
FROM facts f LEFT JOIN p USING (page_id) LEFT JOIN c USING (page_id)"""
)
def page_scores(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    out = score.scores(rules.findings(facts), facts.select("page_id"), "page_id")
    return out.select("page_id", "score", "critical", F.col("warning").alias("warnings"), F.col("notice").alias("notices"))


@query(
    FINDINGS_SQL + _groups("host") + f""", p AS (SELECT host, sum(cost) AS penalty FROM groups GROUP BY host),
c AS (SELECT host, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices FROM findings GROUP BY host),
s AS (SELECT host, count(*) AS pages FROM facts GROUP BY host)
SELECT host, pages, coalesce(penalty, 0) AS penalty, {_score("penalty")} AS score, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings, coalesce(notices, 0) AS notices
FROM s LEFT JOIN p USING (host) LEFT JOIN c USING (host)"""
)
def site_scorecard(spark, sf_dir):
    """The flagship: HTML to facts, facts to findings, findings to a score per site."""
    facts = _facts(spark, sf_dir)
    sites = facts.groupBy("host").agg(F.count("*").alias("pages"))
    return score.scores(rules.findings(facts), sites, "host").select("host", "pages", "penalty", "score", "critical", F.col("warning").alias("warnings"), F.col("notice").alias("notices"))


_PLAN = ", plan AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY severity_rank, finding_seq) AS priority FROM findings)"


@query(FINDINGS_SQL + _PLAN + " SELECT host, CAST(priority AS BIGINT) AS priority, severity, title, pattern_key FROM plan")
def repair_plan(spark, sf_dir):
    return score.plan(_findings(spark, sf_dir)).select("host", F.col("priority").cast("long"), "severity", "title", "pattern_key")


@query(
    FINDINGS_SQL + _PLAN + _groups("host") + f""", total AS (SELECT host, sum(cost) AS penalty FROM groups GROUP BY host)
SELECT p.host, CAST(p.priority AS BIGINT) AS priority, p.pattern_key, CAST(g.n AS BIGINT) AS same_issue_count, {_score("t.penalty - g.cost")} - {_score("t.penalty")} AS score_gain
FROM plan p JOIN groups g ON g.host = p.host AND g.pattern_key = p.pattern_key JOIN total t ON t.host = p.host"""
)
def score_gains(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return score.with_gains(score.plan(found), found).select("host", F.col("priority").cast("long"), "pattern_key", F.col("same_issue_count").cast("long"), "score_gain")


@query(FINDINGS_SQL + _PLAN + ", k AS (SELECT host, pattern_key, min(priority) AS priority FROM plan GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority) AS nth FROM k) SELECT host, pattern_key, CAST(priority AS BIGINT) AS priority, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 3")
def distinct_fixes(spark, sf_dir):
    return score.distinct_fixes(score.plan(_findings(spark, sf_dir))).select("host", "pattern_key", F.col("priority").cast("long"), F.col("nth").cast("long"))


@query(
    FINDINGS_SQL + _PLAN + _groups("host") + f""", k AS (SELECT host, pattern_key, min(priority) AS priority FROM plan GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority) AS nth FROM k),
s AS (SELECT g.host, count(*) FILTER (r.nth <= 3) AS fixes, sum(cost) AS p, sum(CASE WHEN r.nth <= 3 THEN 0 ELSE cost END) AS rest FROM groups g JOIN r ON r.host = g.host AND r.pattern_key = g.pattern_key GROUP BY g.host)
SELECT host, fixes, {_score("p")} AS score_from, {_score("rest")} AS score_to FROM s WHERE {_score("rest")} > {_score("p")}"""
)
def projected_score(spark, sf_dir):
    return score.projected(_findings(spark, sf_dir))


@query(FINDINGS_SQL + " SELECT pattern_key, count(*) AS n, count(DISTINCT host) AS sites, count(DISTINCT page_id) AS pages, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices FROM findings GROUP BY pattern_key ORDER BY n DESC, pattern_key LIMIT 12")
def issue_patterns(spark, sf_dir):
    c = lambda s: F.count_if(F.col("severity") == s)
    groups = _findings(spark, sf_dir).groupBy("pattern_key").agg(F.count("*").alias("n"), F.count_distinct("host").alias("sites"), F.count_distinct("page_id").alias("pages"), c("critical").alias("critical"), c("warning").alias("warnings"), c("notice").alias("notices"))
    return groups.orderBy(F.desc("n"), "pattern_key").limit(12)


@query(FINDINGS_SQL + ", g AS (SELECT host, pattern_key, min(severity_rank) AS rank, count(DISTINCT page_id) AS pages FROM findings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank, pages DESC, pattern_key) AS nth FROM g) SELECT host, pattern_key, CAST(rank AS BIGINT) AS rank, pages, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 3")
def top_fixes(spark, sf_dir):
    g = _findings(spark, sf_dir).groupBy("host", "pattern_key").agg(F.min(rules.severity_rank(F.col("severity"))).cast("long").alias("rank"), F.count_distinct("page_id").alias("pages"))
    nth = F.row_number().over(W.partitionBy("host").orderBy("rank", F.desc("pages"), "pattern_key"))
    return g.withColumn("nth", nth.cast("long")).filter("nth <= 3")


@query(FINDINGS_SQL + " SELECT host, severity, CAST(rule_seq AS BIGINT) AS rule_seq, count(*) AS n, CAST(grouping_id(host, severity, rule_seq) AS BIGINT) AS level FROM findings GROUP BY ROLLUP (host, severity, rule_seq)")
def issue_rollup(spark, sf_dir):
    """Extension: counts by site, severity and rule with all subtotals."""
    rows = _findings(spark, sf_dir).withColumn("rule_seq", F.col("rule_seq").cast("long"))
    return rows.rollup("host", "severity", "rule_seq").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(FACTS_SQL + " SELECT page_id, CAST(i AS BIGINT) AS pos, CAST(levels[i] AS BIGINT) AS level, CAST(levels[i] - levels[i - 1] AS BIGINT) AS jump FROM (SELECT page_id, levels, unnest(range(1, len(levels) + 1)) AS i FROM facts)")
def heading_hierarchy(spark, sf_dir):
    rows = _facts(spark, sf_dir).select("page_id", F.posexplode("levels").alias("p", "level"))
    jump = F.col("level") - F.lag("level").over(W.partitionBy("page_id").orderBy("p"))
    return rows.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("level").cast("long"), jump.cast("long").alias("jump"))


def _top(groups: DataFrame) -> DataFrame:
    return groups.withColumn("nth", F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "first_page"))).filter("nth <= 10").drop("nth")


def _duplicates(rows: DataFrame) -> DataFrame:
    """Each site's texts that several of its pages have, ten at most, as reports list them."""
    groups = rows.withColumn("dup_key", t.normal(F.col("raw"))).filter(F.length("dup_key") >= 12).groupBy("host", "dup_key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return _top(groups.filter("n > 1"))


_TEN = "SELECT host, {0}, n, first_page FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, first_page) AS nth FROM ({1})) WHERE nth <= 10"
_DUP = " " + _TEN.format("dup_key", "SELECT host, dup_key, count(*) AS n, min(page_id) AS first_page FROM d WHERE length(dup_key) >= 12 GROUP BY host, dup_key HAVING count(*) > 1")
_NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '&[a-z0-9#]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
#: Pages of one site that repeat: every page again under a second address, its title alone or its heading alone, by its number.
_TWICE_SQL = "tw AS (SELECT host, page_id, title, coalesce(headings[list_position(levels, 1)], ' ') AS h1, body_text FROM facts UNION ALL SELECT host, page_id + 1000000, CASE WHEN page_id % 3 = 0 THEN title ELSE 'Another page of ' || host || CAST(page_id AS VARCHAR) END, CASE WHEN page_id % 4 = 0 THEN upper(coalesce(headings[list_position(levels, 1)], ' ')) ELSE '' END, CASE WHEN page_id % 5 = 0 THEN body_text || ' one more sentence' ELSE '' END FROM facts)"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = F.coalesce(F.get("headings", F.array_position("levels", F.lit(1)).cast("int") - 1), F.lit(""))
    one = _facts(spark, sf_dir).select("host", "page_id", "title", f1.alias("h1"), "body_text")
    n = F.col("page_id")
    again = one.select("host", (n + 1000000).alias("page_id"), F.when(n % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("Another page of "), "host", n.cast("string"))).alias("title"), F.when(n % 4 == 0, F.upper("h1")).otherwise("").alias("h1"), F.when(n % 5 == 0, F.concat("body_text", F.lit(" one more sentence"))).otherwise("").alias("body_text"))
    return one.unionByName(again)


@query(FACTS_SQL + ", " + _TWICE_SQL + f", d AS (SELECT host, page_id, {_NORMAL.format('title')} AS dup_key FROM tw)" + _DUP)
def duplicate_titles(spark, sf_dir):
    return _duplicates(_twice(spark, sf_dir).withColumn("raw", F.col("title")))


@query(FACTS_SQL + ", " + _TWICE_SQL + f", d AS (SELECT host, page_id, {_NORMAL.format('h1')} AS dup_key FROM tw)" + _DUP)
def duplicate_h1s(spark, sf_dir):
    return _duplicates(_twice(spark, sf_dir).withColumn("raw", F.col("h1")))


@query(FACTS_SQL + ", " + _TWICE_SQL + f", k AS (SELECT host, page_id, {_tokens('title')}[1:4] AS tk FROM tw), g AS (SELECT host, page_id, array_to_string(tk[1:3], ' ') AS keyword FROM k WHERE len(tk) >= 2) " + _TEN.format("keyword", "SELECT host, keyword, count(*) AS n, min(page_id) AS first_page FROM g GROUP BY host, keyword HAVING count(*) > 1"))
def cannibalization(spark, sf_dir):
    rows = _twice(spark, sf_dir).select("host", "page_id", t.primary_keyword(F.col("title")).alias("keyword")).filter("keyword <> ''")
    return _top(rows.groupBy("host", "keyword").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1"))


@query(
    FACTS_SQL + ", " + _TWICE_SQL + f""", k AS (SELECT host, page_id, list_distinct({_tokens('body_text')}[1:600]) AS tk, len({_tokens('body_text')}[1:600]) AS n FROM tw),
e AS (SELECT host, page_id, len(tk) AS size, unnest(tk) AS token FROM k WHERE n >= 40),
o AS (SELECT a.host, a.page_id AS left_page, b.page_id AS right_page, a.size AS sa, b.size AS sb, count(*) AS shared FROM e a JOIN e b ON a.host = b.host AND a.token = b.token AND a.page_id < b.page_id GROUP BY ALL)
SELECT host, left_page, right_page, CAST(floor(100.0 * shared / (sa + sb - shared) + 0.5) AS BIGINT) AS similarity_percent FROM o WHERE 100 * shared >= 82 * (sa + sb - shared)"""
)
def near_duplicate_pages(spark, sf_dir):
    """Pages of one site whose first 600 tokens are alike; that cut is how the reports define a page's fingerprint."""
    facts = _twice(spark, sf_dir).select("host", "page_id", t.tokens(F.col("body_text")).alias("tk")).withColumn("tk", F.slice("tk", 1, 600)).filter(F.size("tk") >= 40)
    sets = facts.select(F.col("page_id").alias("id"), "host", F.array_distinct("tk").alias("items"))
    pairs = similar_sets(sets, 82, 100, by="host")
    return pairs.select("host", F.col("x").alias("left_page"), F.col("y").alias("right_page"), F.floor(100.0 * F.col("shared") / F.col("either") + 0.5).alias("similarity_percent"))


@query(
    "WITH " + URLS_SQL + rf""", k AS (SELECT page_id, full_host, string_split(trim(regexp_replace(lower(full_host || ' ' || path), '[^a-z0-9]+', ' ', 'g')), ' ') AS tk FROM u)
SELECT page_id, CAST(len([r FOR r IN [{", ".join(f"'{x}'" for x in t.RISKY_TOKENS)}] IF list_contains(tk, r)]) + CASE WHEN string_split(full_host, '.')[-1] IN ({", ".join(f"'{x}'" for x in t.RISKY_ENDINGS)}) THEN 1 ELSE 0 END AS BIGINT) AS signals FROM k"""
)
def risky_hosts(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.size(t.risk_signals(u.host(c), u.path(c))).cast("long").alias("signals"))


@query("WITH " + URLS_SQL + " SELECT host, count(*) AS pages, encode_hash AS fingerprint FROM (SELECT host, count(*) AS c, sha256(string_agg(page_key, chr(10) ORDER BY page_key)) AS encode_hash FROM (SELECT host, host || CASE WHEN regexp_replace(path, '/$', '') = '' THEN '/' ELSE regexp_replace(path, '/$', '') END AS page_key FROM u) GROUP BY host) JOIN u USING (host) GROUP BY ALL")
def crawl_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(u.site(F.col("url")).alias("host"), u.page_key(F.col("url")).alias("k"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sha2(F.array_join(F.sort_array(F.collect_list("k")), "\n"), 256).alias("fingerprint"))
