"""Queries over pages that are decorated with what the test pages lack: descriptions, canonical addresses, language tags,
structured data, icons, images and robots tags, by the page's number, so that every rule fires on some and not on others.
The SQL says what must be found from the number alone, without reading the decorated HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.operators import readiness
from crawlwright.plans import audit as a
from crawlwright.plans import facts as f
from crawlwright.plans import probes, rules
from crawlwright.queries import pages as p
from crawlwright.registry import query, table

#: Structured data of pages by page_id modulo 9; the types and the number of faulty blocks are in the SQL below.
_BLOCKS = [
    ['{"@context":"https://schema.org","@type":"Organization"}'],
    ['{"@context":"x","@graph":[{"@type":["Product","Thing"]},{"@type":"WebPage","mainEntity":{"@type":"FAQPage"}}]}'],
    ["{broken"],
    ['{"@type":"Article"}'],
    ["{broken", '{"@context":"x","@type":"Service"}'],
    ['[{"@context":"x","@type":"HowTo","offers":[{"@type":"Offer"}]},{"@type":"Thing"}]'],
]
#: Language tags by page_id modulo 10; None is the page's own address.
_TAGS = [[("en", None), ("de", "/de"), ("x-default", "/")], [("en", None), ("EN", "/b")], [("e", "/c")], [("de", "/d"), ("fr", "/f")], [("english!", "/c"), ("english!", "/c")]]


def decorated(pages: DataFrame) -> DataFrame:
    n = F.col("page_id")
    tag = lambda when, *parts: F.when(when, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    words = F.concat(F.when(n % 13 == 0, "What is ").otherwise(""), F.expr("repeat('words', int(5 + page_id % 32))"))
    head = [
        tag(n % 4 != 0, '<meta name="description" content="', words, '">'),
        tag(n % 3 == 0, '<link rel="canonical" href="https://c.example.com/x?b=2&a=1">'),
        tag(n % 3 == 1, '<link href="/x?b=2&a=1" rel="canonical">'),
        tag(n % 5 == 0, '<meta property="og:url" content="https://c.example.com/x?a=1&b=2">'),
        tag(n % 5 == 1, '<meta property="og:url" content="https://c.example.com/x?b=2&a=1#frag">'),
        tag(n % 5 == 2, '<meta property="og:url" content="https://c.example.com/y">'),
        tag(n % 4 != 1, '<meta name="viewport" content="width=device-width">'),
        tag(n % 7 == 0, '<meta name="robots" content="NOINDEX, follow">'),
        tag(n % 2 == 0, '<meta property="og:image" content="/og', (n % 6).cast("string"), '.png">'),
        tag(n % 6 < 3, '<meta name="twitter:image" content="/tw.png">'),
        tag(n % 8 < 3, '<link rel="apple-touch-icon" href="/icon', (n % 8).cast("string"), '.png">'),
    ]
    for i, blocks in enumerate(_BLOCKS):
        head.append(tag(n % 9 == i, *[f'<script type="application/ld+json">{b}</script>' for b in blocks]))
    for i, tags in enumerate(_TAGS):
        head.append(tag(n % 10 == i, *[x for code, href in tags for x in (f'<link rel="alternate" hreflang="{code}" href="', F.col("url") if href is None else F.lit(href), '">')]))
    head += [tag(n % 11 == 0, '<img src="/a.png">'), tag(n % 11 == 1, '<img src="/b.png" alt="">')]
    html = F.replace("html", F.lit("</head>"), F.concat(*head, F.lit("</head>")))
    return pages.select("page_id", "url", html.alias("html"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.facts(decorated(table(spark, sf_dir, "pages")))


_TYPES = """CASE page_id % 9 WHEN 0 THEN ['Organization'] WHEN 1 THEN ['Product', 'Thing', 'WebPage', 'FAQPage'] WHEN 2 THEN ['invalid-json']
  WHEN 3 THEN ['Article'] WHEN 4 THEN ['invalid-json', 'Service'] WHEN 5 THEN ['HowTo', 'Offer', 'Thing'] ELSE [] END"""
_DESCRIPTION = "CASE WHEN page_id % 4 = 0 THEN 0 ELSE 5 * (5 + page_id % 32) + CASE WHEN page_id % 13 = 0 THEN 8 ELSE 0 END END"
#: What fires on decorated pages: the reference's order, titles and conditions, said by page_id where the decoration decides.
_FIRED = [
    (31, "Structured data JSON is invalid", "warning", "page_id % 9 IN (2, 3, 4, 5)"),
    (38, "Canonical and og:url disagree", "notice", "(page_id % 3 = 0 AND page_id % 5 = 2) OR (page_id % 3 = 1 AND page_id % 5 < 3)"),
    (39, "Canonical conflicts with noindex", "critical", "page_id % 3 < 2 AND page_id % 7 = 0"),
    (40, "Missing or weak title", "critical", "length(title) < 12"),
    (41, "Long title", "warning", "length(title) > 65"),
    (42, "Missing meta description", "critical", "page_id % 4 = 0"),
    (43, "Meta description needs tightening", "warning", f"page_id % 4 <> 0 AND ({_DESCRIPTION} < 70 OR {_DESCRIPTION} > 165)"),
    (44, "Missing H1", "critical", "h1_count = 0"),
    (45, "Multiple H1s", "warning", "h1_count > 1"),
    (46, "Heading hierarchy needs cleanup", "warning", "len(levels) > 0 AND (levels[1] <> 1 OR len([i FOR i IN range(1, len(levels)) IF levels[i + 1] - levels[i] > 1]) > 0)"),
    (47, "Thin rendered content", "warning", "word_count < 250"),
    (48, "No rendered internal links", "critical", "inner_links = 0"),
    (49, "Missing canonical URL", "warning", "page_id % 3 = 2"),
    (50, "Viewport meta tag missing", "warning", "page_id % 4 = 1"),
    (51, "HTML language missing", "notice", "lang = ''"),
    (52, "Character encoding missing", "notice", "charset = ''"),
    (53, "HTML doctype missing", "notice", "NOT doctype"),
    (54, "Noindex found", "critical", "page_id % 7 = 0"),
    (56, "Social share image incomplete", "warning", "page_id % 2 = 1 OR page_id % 6 >= 3"),
    (58, "Apple touch icon missing", "notice", "page_id % 8 >= 3"),
    (60, "Images missing alt attributes", "warning", "page_id % 11 = 0"),
    (61, "Structured data opportunity", "notice", "page_id % 9 IN (2, 6, 7, 8)"),
    (62, "Page is not served over HTTPS", "warning", "starts_with(url, 'http:') AND host <> 'localhost'"),
]
_HREFLANG = [
    (32, 0, "Invalid hreflang code", "warning", "page_id % 10 IN (2, 4)"),
    (33, 1, "Duplicate hreflang tag", "warning", "page_id % 10 IN (1, 4)"),
    (34, 2, "Hreflang is missing a self-reference", "notice", "page_id % 10 IN (2, 3, 4)"),
    (35, 3, "Hreflang cluster has no x-default", "notice", "page_id % 10 IN (1, 3, 4)"),
]


def _rows(fired, extra: str = "") -> str:
    return "\nUNION ALL ".join(f"SELECT host, page_id, page_seq, label, {seq} AS rule_seq, 0 AS sub, '{sev}' AS severity, '{title}' AS rule{extra} FROM facts WHERE {cond}" for seq, title, sev, cond in fired)


@query(p.FACTS_SQL + f", r AS ({_rows(_FIRED)}) SELECT host, page_id, CAST(rule_seq AS BIGINT) AS rule_seq, severity, rule || ' on ' || label AS title, row_number() OVER (PARTITION BY host ORDER BY page_seq, rule_seq) AS finding_seq FROM r")
def page_rules(spark, sf_dir):
    """All rules on a page's own HTML, each with pages that it fires on and pages that it doesn't."""
    return rules.findings(_facts(spark, sf_dir)).select("host", "page_id", F.col("rule_seq").cast("long").alias("rule_seq"), "severity", "title", "finding_seq")


@query(f"SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, t[i] AS type FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, {_TYPES} AS t FROM pages))")
def json_ld_types(spark, sf_dir):
    return _facts(spark, sf_dir).select("page_id", F.posexplode("schema_types").alias("pos", "type")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT page_id, CAST(len(t) AS BIGINT) AS blocks, CASE WHEN page_id % 9 IN (2, 3, 4, 5) THEN 1 ELSE 0 END AS wrong FROM (SELECT page_id, CASE WHEN page_id % 9 = 4 THEN [1, 2] WHEN page_id % 9 < 6 THEN [1] ELSE [] END AS t FROM pages)")
def json_ld_errors(spark, sf_dir):
    return _facts(spark, sf_dir).select("page_id", F.col("json_ld").cast("long").alias("blocks"), F.col("schema_errors").alias("wrong"))


@query("\nUNION ALL ".join(f"SELECT page_id, {seq} AS rule_seq, '{sev}' AS severity, '{title}' AS rule FROM pages WHERE {cond}" for seq, _, title, sev, cond in _HREFLANG))
def hreflang_findings(spark, sf_dir):
    return probes.hreflang_findings(_facts(spark, sf_dir)).select("page_id", "rule_seq", "severity", "rule")


_QUESTIONS = " OR ".join(f"regexp_matches(h, '{x}')" for x in (r"\?$", r"(?i)\bfaq\b", r"(?i)\bfrequently asked\b", r"(?i)\bhow (do|does|to|much|many)\b", r"(?i)\bwhat (is|are|does|do)\b", r"(?i)\bwhy (does|do|is|are)\b", r"(?i)\bwhen (should|do|does|is)\b"))
_READY = f""", q AS (
  SELECT *, page_id % 7 <> 0 AS ok, page_id % 9 IN (0, 1, 3, 4, 5) AS helpful,
    page_id % 9 IN (1, 5) OR len([h FOR h IN headings IF {_QUESTIONS}]) > 0
      OR len([h FOR h IN [substr(title, 1, 180) || ' ' || CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'What is words' ELSE 'words' END || ' ' || substr(body_text, 1, 4000)] IF {_QUESTIONS}]) > 0 AS asks
  FROM facts),
acc AS (SELECT host, length(host) % 3 = 0 AS llms_txt, length(host) % 5 = 0 AS search_blocked, length(host) % 2 = 0 AS answers_blocked FROM facts GROUP BY host),
n AS (SELECT host, count(*) AS pages, count(*) FILTER (ok) AS checked, count(*) FILTER (ok AND word_count < 250) AS thin, count(*) FILTER (ok AND word_count < 80) AS shells, count(*) FILTER (ok AND helpful) AS helpful,
  count(*) FILTER (ok AND page_id % 3 < 2) AS with_canonical, count(*) FILTER (ok AND inner_links = 0) AS isolated, count(*) FILTER (ok AND asks) AS asking, count(*) FILTER (ok AND len(headings) >= 3) AS sectioned FROM q GROUP BY host),
s AS (SELECT n.*, llms_txt, search_blocked, answers_blocked, thin > 0 AS f69, checked > 0 AND helpful = 0 AS f70, with_canonical < checked OR isolated > 0 AS f71, checked > 0 AND asking = 0 AND sectioned = 0 AS f72, answers_blocked AND NOT search_blocked AS f73, NOT llms_txt AS f74 FROM n JOIN acc ON acc.host = n.host)"""


def _access(facts: DataFrame) -> DataFrame:
    """What discovery files say of each site, by the length of its name."""
    n = F.length("host")
    return facts.select("host").distinct().select("host", (n % 3 == 0).alias("llms_txt"), (n % 5 == 0).alias("search_blocked"), (n % 2 == 0).alias("answers_blocked"))


@query(p.FACTS_SQL + _READY + " SELECT host, pages, checked, thin, shells, helpful, with_canonical, isolated, asking, sectioned, CAST(greatest(0, 100 - CASE WHEN f69 THEN 28 ELSE 0 END - CASE WHEN f70 THEN 16 ELSE 0 END - CASE WHEN f71 THEN 18 ELSE 0 END - CASE WHEN f72 THEN 10 ELSE 0 END - CASE WHEN f74 THEN 4 ELSE 0 END - CASE WHEN search_blocked THEN 40 WHEN answers_blocked THEN 24 ELSE 0 END) AS INTEGER) AS score FROM s")
def answer_readiness(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return readiness.readiness(facts, _access(facts)).select("host", "pages", "checked", "thin", "shells", "helpful", "with_canonical", "isolated", "asking", "sectioned", "score")


_AI = [("69", "'warning'", "AI Answer Readiness: rendered pages lack extractable detail"), ("70", "'notice'", "AI Answer Readiness: helpful structured data was not proven"), ("71", "CASE WHEN with_canonical < checked THEN 'warning' ELSE 'notice' END", "AI Answer Readiness: preferred source pages are unclear"), ("72", "'notice'", "AI Answer Readiness: question-led sections are missing"), ("73", "'warning'", "AI Answer Readiness: AI search crawlers blocked in robots.txt"), ("74", "'notice'", "AI Answer Readiness: optional llms.txt is not reachable")]


@query(p.FACTS_SQL + _READY + " " + "\nUNION ALL ".join(f"SELECT host, {seq} AS rule_seq, {sev} AS severity, '{title}' AS title FROM s WHERE f{seq}" for seq, sev, title in _AI))
def ai_findings(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return readiness.readiness_findings(readiness.readiness(facts, _access(facts)))


_TRAFFIC = "k AS (SELECT 'https://WWW.' || host || rtrim(path, '/') || '/#x' AS page_url, host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS key, page_id % 17 AS clicks, page_id % 23 * 10 AS impressions FROM facts WHERE page_id % 3 <> 1), t AS (SELECT key, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM k GROUP BY key)"


@query(
    p.FACTS_SQL + _READY.split("acc AS")[0] + _TRAFFIC + """,
w AS (SELECT host, page_id, page_seq, regexp_replace(authority_key, '^www\\.', '') || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS key, unnest(list_filter([CASE WHEN word_count < 250 THEN 69 END, CASE WHEN NOT helpful THEN 70 END, CASE WHEN page_id % 3 = 2 OR inner_links = 0 THEN 71 END, CASE WHEN NOT asks AND word_count >= 250 THEN 72 END], lambda x: x IS NOT NULL)) AS rule_seq FROM (SELECT *, replace(replace(origin, 'https://', ''), 'http://', '') AS authority_key FROM q) WHERE ok),
l AS (SELECT *, row_number() OVER (PARTITION BY host, rule_seq ORDER BY page_seq) AS listed FROM w)
SELECT l.host, rule_seq, page_id, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, CAST(row_number() OVER (PARTITION BY l.host, rule_seq ORDER BY coalesce(clicks, 0) DESC, coalesce(impressions, 0) DESC, page_seq) AS INTEGER) AS nth FROM l LEFT JOIN t ON t.key = l.key WHERE listed <= 10"""
)
def traffic_ranked_pages(spark, sf_dir):
    """The pages behind readiness findings, by imported clicks and impressions."""
    facts = _facts(spark, sf_dir)
    n = F.col("page_id")
    traffic = facts.filter(n % 3 != 1).select(F.concat(F.lit("https://WWW."), "host", F.rtrim("path", F.lit("/")), F.lit("/#x")).alias("page_url"), (n % 17).alias("clicks"), (n % 23 * 10).alias("impressions"))
    return readiness.affected(facts, traffic)


@query(
    p.FACTS_SQL + """, g AS (SELECT host, word_count >= 250 AS crawlable, title <> '' AND page_id % 4 <> 0 AND h1_count > 0 AS entity,
  len([x FOR x IN ['faq', 'frequently asked', 'how it works', 'pricing', 'compare', 'comparison', 'why', 'what is', 'who is'] IF contains(lower(array_to_string(headings, ' ')), x)]) > 0 AS answers, page_id % 9 IN (0, 1, 4) AS useful, inner_links > 0 AS internal FROM facts WHERE page_seq = 1)
SELECT host, crawlable, entity, answers, useful, internal, CAST(crawlable AS INTEGER) + CAST(entity AS INTEGER) + CAST(answers AS INTEGER) + CAST(useful AS INTEGER) + CAST(internal AS INTEGER) AS passed,
  array_to_string(list_filter([CASE WHEN NOT entity THEN 'SEO/GEO entity clarity needs cleanup' END, CASE WHEN NOT answers THEN 'Add answer-ready sections for buyer questions' END, CASE WHEN NOT useful THEN 'Add truthful entity schema where useful' END, CASE WHEN NOT crawlable THEN 'Make core answer content crawlable' END], lambda x: x IS NOT NULL), '; ') AS repairs FROM g"""
)
def geo_readiness(spark, sf_dir):
    return readiness.geo(_facts(spark, sf_dir)).withColumn("repairs", F.array_join("repairs", "; "))


def _loads(pages: DataFrame) -> DataFrame:
    n = F.col("page_id")
    final = F.when(n % 6 == 0, F.concat(F.lit("https://moved.example.com/"), n.cast("string"))).when(n % 6 == 1, F.concat("url", F.lit("#frag"))).otherwise(F.lit(""))
    return pages.select("page_id", "url", final.alias("final_url"), (n % 15 == 0).alias("redirected"), (n % 4).alias("chain_length"), F.when(n % 5 != 0, n % 5 != 1).alias("settled"), (n % 9 * 1000).alias("load_ms"), (n % 8 * 100_000).alias("transfer_size"))


_LOADS = [
    (18, "URL redirects before rendering", "notice", "page_id % 6 = 0 OR page_id % 15 = 0"),
    (19, "Long redirect chain before rendering", "warning", "page_id % 4 > 1"),
    (20, "Slow rendered load", "warning", "page_id % 5 <> 1 AND page_id % 9 * 1000 > 4000"),
    (21, "Large HTML response", "notice", "page_id % 8 * 100000 > 500000"),
]


@query("\nUNION ALL ".join(f"SELECT page_id, {seq} AS rule_seq, '{sev}' AS severity, '{title}' AS rule FROM pages WHERE {cond}" for seq, title, sev, cond in _LOADS))
def load_findings(spark, sf_dir):
    return probes.load_findings(_loads(table(spark, sf_dir, "pages"))).select("page_id", "rule_seq", "severity", "rule")


_DECLARED = """, d AS (
  SELECT page_id, unnest([{'i': 0, 'key': 'og', 'url': CASE WHEN page_id % 2 = 0 THEN origin || '/og' || CAST(page_id % 6 AS VARCHAR) || '.png' END},
    {'i': 1, 'key': 'twitter', 'url': CASE WHEN page_id % 6 < 3 THEN origin || '/tw.png' END}, {'i': 2, 'key': 'apple-touch-icon', 'url': CASE WHEN page_id % 8 < 3 THEN origin || '/icon' || CAST(page_id % 8 AS VARCHAR) || '.png' END}], recursive := true) FROM facts
  UNION ALL SELECT min(page_id), 3, 'apple-touch-icon-probe', origin || '/apple-touch-icon.png' FROM facts WHERE page_id % 8 >= 3 GROUP BY origin),
di AS (SELECT url, arg_min(page_id, page_id * 4 + i) AS page_id, arg_min(key, page_id * 4 + i) AS key FROM d WHERE url IS NOT NULL GROUP BY url)"""


@query(p.FACTS_SQL + _DECLARED + " SELECT page_id, key, url FROM di")
def declared_images(spark, sf_dir):
    return probes.declared_images(_facts(spark, sf_dir))


def _images(facts: DataFrame) -> DataFrame:
    d = probes.declared_images(facts)
    n = F.length("url")
    return d.select("page_id", "key", "url", (n % 3 != 0).alias("ok"), F.lit(200).alias("status"), F.when(n % 4 == 0, "text/html").when(n % 4 == 1, "image/png").alias("content_type"))


_IMAGES = """, bad AS (SELECT * FROM di WHERE length(url) % 3 = 0 OR length(url) % 4 = 0)"""
_IMAGE_ROWS = """SELECT page_id, 57 AS rule_seq, 'warning' AS severity, 'Social share image is not loadable' AS rule FROM facts WHERE page_id % 2 = 0 AND page_id % 6 < 3 AND page_id IN (SELECT page_id FROM bad WHERE key IN ('og', 'twitter'))
UNION ALL SELECT page_id, 59, 'notice', 'Apple touch icon is not loadable' FROM facts WHERE page_id % 8 < 3 AND origin || '/icon' || CAST(page_id % 8 AS VARCHAR) || '.png' IN (SELECT url FROM bad WHERE key = 'apple-touch-icon')"""


@query(p.FACTS_SQL + _DECLARED + _IMAGES + " " + _IMAGE_ROWS)
def image_findings(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return probes.image_findings(facts, _images(facts))


@query(p.FACTS_SQL + """, l AS (SELECT page_id, list_distinct([x FOR x IN links IF regexp_matches(x, '(?i)^https?:')]) AS ls, origin, page_seq FROM facts WHERE page_seq <= 10),
n AS (SELECT page_id, least(len(ls), 50) AS links, CASE WHEN page_id % 11 < 2 THEN 1 ELSE 0 END AS images, CASE WHEN page_id % 3 < 2 THEN 1 ELSE 0 END AS canonical FROM l)
SELECT page_id, CAST(links AS BIGINT) AS links, CAST(images AS BIGINT) AS images, CAST(canonical AS BIGINT) AS canonical FROM n WHERE links + images + canonical > 0""")
def probe_plan(spark, sf_dir):
    """What a crawl of up to 100 pages checks: the first pages' first links and images and the canonical address."""
    facts = _facts(spark, sf_dir)
    plan = probes.probe_plan(facts, 100)
    own = facts.select("page_id", "canonical_url")
    rows = plan.join(own, "page_id")
    is_canonical = (F.col("url") == F.col("canonical_url")) & F.col("kind").isin("internal", "canonical")
    return rows.groupBy("page_id").agg(F.count_if((F.col("kind") != "image") & ~is_canonical).alias("links"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(is_canonical).alias("canonical"))


_ALL = (
    p.FACTS_SQL + _READY + _DECLARED.replace(", d AS", ", d AS", 1) + _IMAGES + f""",
own AS ({_rows(_FIRED)}
UNION ALL {_rows([(seq, title, sev, cond) for seq, _, title, sev, cond in _HREFLANG])}
UNION ALL {_rows(_LOADS)}
UNION ALL SELECT f.host, i.page_id, page_seq, label, i.rule_seq, 0, i.severity, i.rule FROM ({_IMAGE_ROWS}) i JOIN facts f ON f.page_id = i.page_id),
sites AS (""" + "\nUNION ALL ".join(f"SELECT host, {seq} AS rule_seq, {sev} AS severity, '{title}' AS title FROM s WHERE f{seq}" for seq, sev, title in _AI) + """),
every AS (SELECT host, page_id, page_seq, rule_seq, severity, rule || ' on ' || label AS title FROM own UNION ALL SELECT host, NULL, NULL, rule_seq, severity, title FROM sites)
SELECT host, page_id, rule_seq, severity, title, row_number() OVER (PARTITION BY host ORDER BY page_seq NULLS LAST, rule_seq) AS finding_seq FROM every"""
)


@query(_ALL)
def findings_all(spark, sf_dir):
    """A whole audit: page rules, language tags, loads, declared images and readiness in one order."""
    pages = table(spark, sf_dir, "pages")
    facts = _facts(spark, sf_dir)
    done = a.audit(decorated(pages), a.Measured(loads=_loads(pages), images=_images(facts), access=_access(facts)))
    return done.findings.select("host", "page_id", "rule_seq", "severity", "title", "finding_seq")
