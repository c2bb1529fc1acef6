"""Queries over the scalar functions. Each row of a table gets one of a few inputs by its key; where a function's answer can't
be said by another formula, the SQL lists the answers themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import classify as c
from crawlwright.functions import numbers as n
from crawlwright.functions import text as t
from crawlwright.functions import urls as u
from crawlwright.registry import query, table


def _pick(key: str, values: list, kind: str = "string") -> Column:
    """The value of a row by its key, modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _listed(key: str, values: list) -> str:
    return f"[{', '.join(map(_sql, values))}][({key}) % {len(values)} + 1]"


_RAW = [" Example.com/a#x ", "http://WWW.Example.com:80/a/?q=1", "ftp://x.com/", "https://user:pw@x.com/", "", "https://x.com", "x.com:8443/p/", "https://x.com:443/p//?b#c", "not a url", "mailto:a@b", "HTTPS://X.com/A", "http://[::1]:8080/"]
_NORMAL = ["https://example.com/a", "http://www.example.com/a/?q=1", None, None, None, "https://x.com/", "https://x.com:8443/p/", "https://x.com/p//?b", None, None, "https://x.com/A", "http://[::1]:8080/"]
_HTTP = ["https://example.com/a", "http://www.example.com/a/?q=1", "https://ftp//x.com/", "https://user:pw@x.com/", "", "https://x.com/", "https://x.com:8443/p/", "https://x.com/p//?b", "", "https://mailto:a@b/", "https://x.com/A", "http://[::1]:8080/"]


@query(f"SELECT p_partkey, {_listed('p_partkey', _NORMAL)} AS normal, {_listed('p_partkey', ['' if x is None else x for x in _HTTP])} AS http FROM part")
def url_normalization(spark, sf_dir):
    raw = _pick("p_partkey", _RAW)
    return table(spark, sf_dir, "part").select("p_partkey", u.normalize_url(raw).alias("normal"), u.http_url(raw).alias("http"))


_KEYED = ["https://www.X.com:443/a/b/?q=1#f", "http://x.com:80/", "http://x.com:8080/a//", "https://X.com", "www.y.com/p/#z", "https://x.com/a?b=/"]


@query(f"""SELECT p_partkey, {_listed('p_partkey', ['x.com/a/b', 'x.com/', 'x.com:8080/a/', 'x.com/', 'y.com/p', 'x.com/a'])} AS traffic,
  {_listed('p_partkey', ['https://www.x.com/a/b?q=1', 'http://x.com', 'http://x.com:8080/a', 'https://x.com', '', 'https://x.com/a?b=/'])} AS account,
  {_listed('p_partkey', ['https://www.x.com/a/b?q=1', 'http://x.com/', 'http://x.com:8080/a', 'https://x.com/', 'www.y.com/p', 'https://x.com/a?b=/'])} AS proof,
  {_listed('p_partkey', ['https://www.x.com/a/b/?q=1', 'http://x.com', 'http://x.com:8080/a/', 'https://x.com', 'www.y.com/p/#z', 'https://x.com/a?b=%2F'])} AS canonical,
  {_listed('p_partkey', [True, True, True, True, False, True])} AS same FROM part""")
def url_identities(spark, sf_dir):
    """Keys that imports, accounts, proofs and canonical addresses are matched by; they differ on purpose."""
    url = _pick("p_partkey", _KEYED)
    same = u.same_site(F.when(url.contains("://"), u.origin(url)).otherwise(""), F.lit("https://x.com"))
    return table(spark, sf_dir, "part").select("p_partkey", u.traffic_key(url).alias("traffic"), u.account_key(url).alias("account"), u.proof_key(url).alias("proof"), u.sorted_key(url).alias("canonical"), same.alias("same"))


@query("SELECT page_id, 'https://www.x.com/p/?a=2&a=1&a-b=1&b=' || CAST(page_id % 3 AS VARCHAR) || '&c=' AS sorted_key FROM pages")
def sorted_parameters(spark, sf_dir):
    """Parameters are ordered by name alone: equal names keep their order, and a- doesn't come between a and a."""
    url = F.concat(F.lit("https://WWW.x.com/p/?b="), (F.col("page_id") % 3).cast("string"), F.lit("&a-b=1&a=2&c&a=1#f"))
    return table(spark, sf_dir, "pages").select("page_id", u.sorted_key(url).alias("sorted_key"))


_IP = "k AS (SELECT o_orderkey, (o_orderkey * 7919 + (o_orderkey % 13) * 330382099) % 4294967296 AS ip FROM orders), b AS (SELECT *, ip // 16777216 AS a1, ip // 65536 % 256 AS a2, ip // 256 % 256 AS a3 FROM k)"


@query(f"WITH {_IP} SELECT o_orderkey, a1 IN (0, 10, 127) OR a1 >= 224 OR (a1 = 169 AND a2 = 254) OR (a1 = 172 AND a2 BETWEEN 16 AND 31) OR (a1 = 192 AND a2 = 168) OR (a1 = 100 AND a2 BETWEEN 64 AND 127) OR (a1 = 192 AND a2 = 0 AND a3 = 0) OR (a1 = 198 AND a2 IN (18, 19)) AS private FROM b")
def private_addresses(spark, sf_dir):
    """The same addresses in decimal parts, one number, hexadecimal, octal, and mapped into IPv6 in two ways."""
    key = F.col("o_orderkey")
    ip = (key * 7919 + (key % 13) * 330382099) % (1 << 32)
    part = [F.shiftright(ip, s).bitwiseAND(255) for s in (24, 16, 8, 0)]
    dotted = F.concat_ws(".", *[x.cast("string") for x in part])
    octal = F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(x.cast("string"), 10, 8)) for x in part])
    hexed = F.concat(F.lit("0x"), F.lower(F.hex(ip)))
    mapped = F.concat(F.lit("[::ffff:"), dotted, F.lit("]"))
    pairs = F.concat(F.lit("::ffff:"), F.lower(F.hex(F.shiftright(ip, 16))), F.lit(":"), F.lower(F.hex(ip.bitwiseAND(65535))))
    form = key % 6
    host = F.when(form == 0, dotted).when(form == 1, ip.cast("string")).when(form == 2, hexed).when(form == 3, octal).when(form == 4, mapped).otherwise(pairs)
    return table(spark, sf_dir, "orders").select("o_orderkey", u.private_host(host).alias("private"))


_HOSTS = ["localhost", "a.local", "x.internal", "db.cluster.local", "router.home.arpa", "metadata", "example.com", "example.com.", "[::1]", "fe80::1", "2001:db8::1", "2606:4700::1", "1.2.3.256", "intranet", ""]


@query(f"SELECT s_suppkey, {_listed('s_suppkey', [True, True, True, True, True, True, False, False, True, True, True, False, False, False, True])} AS private, {_listed('s_suppkey', [False, False, False, False, False, False, True, True, False, False, False, True, True, False, False])} AS auditable FROM supplier")
def private_names(spark, sf_dir):
    host = _pick("s_suppkey", _HOSTS)
    bracket = F.when(host.contains(":") & ~host.startswith("["), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return table(spark, sf_dir, "supplier").select("s_suppkey", u.private_host(host).alias("private"), u.auditable(F.concat(F.lit("https://"), bracket, F.lit("/"))).alias("auditable"))


_TYPES = ["text/html; charset=utf-8", "application/xhtml+xml", "text/plain", "application/pdf", "", "binary/octet-stream"]


@query(f"SELECT p_partkey, {_listed('p_partkey', [True, True, True, False, True, True])} AS page, {_listed('p_partkey', [True, True, False, False, False, False])} AS file FROM part")
def html_responses(spark, sf_dir):
    kind = _pick("p_partkey", _TYPES)
    return table(spark, sf_dir, "part").select("p_partkey", u.html_response(F.lit("https://x.com/a"), kind).alias("page"), u.html_response(F.lit("https://x.com/a.JPEG"), kind).alias("file"))


_LIMITS = ["abc", "", "0", "1", "10.4", "99.5", "5000", "-3", "1e3", "Infinity"]


@query(f"""SELECT p_partkey, {_listed('p_partkey', [10, 1, 1, 1, 10, 100, 1000, 1, 1000, 10])}::BIGINT AS pages, {_listed('p_partkey', ['quick', 'lite', 'lite', 'lite', 'quick', 'site', 'deep', 'lite', 'deep', 'quick'])} AS tier,
  {_listed('p_partkey', [49990, 49999, 49999, 49999, 49990, 49900, 49000, 49999, 49000, 49990])}::BIGINT AS gap, {_listed('p_partkey', [5, 5, 5, 5, 10, 50, 50, 5, 50, 5])}::BIGINT AS low, {_listed('p_partkey', [500, 1, 1, 1, 10, 100, 500, 1, 500, 500])}::BIGINT AS high FROM part""")
def crawl_limits(spark, sf_dir):
    """Limits of what someone typed: what isn't a number is the default, the least or the most, by its place."""
    raw = _pick("p_partkey", _LIMITS)
    return table(spark, sf_dir, "part").select("p_partkey", n.page_limit(raw).alias("pages"), n.tier(raw).alias("tier"), n.parity_gap(raw).alias("gap"), n.clamp_low(raw, 5, 50).alias("low"), n.clamp_high(raw, 500).alias("high"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * CAST(pow(10, l_linenumber % 4) AS BIGINT) // 100 AS b, l_quantity * 97 AS ms, l_discount / 7 AS share, l_quantity / 3 AS place FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN CAST(CAST(floor(b / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE printf('%.1f', b / 1048576.0::DOUBLE) || ' MB' END AS size,
  CASE WHEN ms >= 1000 THEN printf('%.1f', ms / 1000) || 's' ELSE CAST(CAST(floor(ms + 0.5) AS BIGINT) AS VARCHAR) || 'ms' END AS metric,
  regexp_replace(printf('%.1f', floor(share * 1000 + 0.5) / 10), '\\.0$', '') || '%' AS share, regexp_replace(printf('%.1f', floor(place * 10 + 0.5) / 10), '\\.0$', '') AS place,
  CASE WHEN share > 0 AND share < 0.01 THEN printf('%.1f', share * 100) ELSE printf('%.0f', share * 100) END || '%' AS brief_share, CASE WHEN place < 10 THEN printf('%.1f', place) ELSE printf('%.0f', place) END AS brief_place FROM k""")
def formats(spark, sf_dir):
    b = F.floor("l_extendedprice") * F.pow(F.lit(10), F.col("l_linenumber") % 4).cast("long")
    size = F.floor(b / 100)
    ms, share, place = F.col("l_quantity") * 97, F.col("l_discount") / 7, F.col("l_quantity") / 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.byte_size(size).alias("size"), n.metric(ms).alias("metric"), n.share(share).alias("share"), n.place(place).alias("place"), n.brief_share(share).alias("brief_share"), n.brief_place(place).alias("brief_place"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey * 37 % 400000 AS seconds, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, o_totalprice, o_orderdate FROM orders), m AS (SELECT *, greatest(1, CAST(floor(seconds / 60.0 + 0.5) AS BIGINT)) AS mi FROM k), h AS (SELECT *, CAST(floor(mi / 60.0 + 0.5) AS BIGINT) AS ho FROM m)
SELECT o_orderkey, CASE WHEN mi < 60 THEN CAST(mi AS VARCHAR) || ' minute' || CASE WHEN mi = 1 THEN '' ELSE 's' END WHEN ho < 48 THEN CAST(ho AS VARCHAR) || ' hour' || CASE WHEN ho = 1 THEN '' ELSE 's' END ELSE CAST(CAST(floor(ho / 24.0 + 0.5) AS BIGINT) AS VARCHAR) || ' days' END AS down,
  CASE WHEN score >= 90 THEN 'fast' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'needs-improvement' ELSE 'poor' END AS speed, CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'ok' ELSE 'needs work' END AS tone,
  CASE WHEN o_orderkey % 40 <= 7 THEN 7 WHEN o_orderkey % 40 <= 14 THEN 14 ELSE 30 END AS days, strftime(o_orderdate, '%Y-%m-%dT%H') AS hour, format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS price FROM h""")
def readable_values(spark, sf_dir):
    score = F.floor("o_totalprice") % 101
    return table(spark, sf_dir, "orders").select("o_orderkey", n.down_for(F.col("o_orderkey") * 37 % 400000).alias("down"), n.speed_class(score).alias("speed"), n.badge_tone(score).alias("tone"), n.check_interval(F.col("o_orderkey") % 40).alias("days"), n.hour_key(F.col("o_orderdate")).alias("hour"), n.grouped(F.col("o_totalprice")).alias("price"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 130 - 10 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY back DESC) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM r WHERE back <= 12)
SELECT o_custkey, CAST(i AS INTEGER) AS i, printf('%.1f', i * (560.0::DOUBLE / (n - 1))) AS x, printf('%.1f', 112 - greatest(0, least(100, score)) / 100.0::DOUBLE * 104) AS y FROM l WHERE n > 1""")
def trend_points(spark, sf_dir):
    """The last twelve scores of each customer, oldest first, as points of a line."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.floor("o_totalprice") % 130 - 10).alias("score"))
    own = W.partitionBy("o_custkey")
    last = o.withColumn("back", F.row_number().over(own.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).filter("back <= 12")
    rows = last.withColumn("i", F.row_number().over(own.orderBy(F.desc("back"))) - 1).withColumn("n", F.count("*").over(own)).filter("n > 1")
    return rows.select("o_custkey", "i", n.spark_x(F.col("i"), F.col("n")).alias("x"), n.spark_y(F.col("score")).alias("y"))


_CLEAN = ["HTTPS://www.Example.com/a?b", "example.com:8080", "localhost", "a.b", "10.0.0.1", "x..com", ".x.com", "site.internal", "exa mple.com", "http://sub.example.org.", "", "foo"]
_DOMAINS = ["www.example.com", "example.com", "", "", "", "", "", "", "", "sub.example.org", "", ""]
_ERRORS = ["net::ERR_NAME_NOT_RESOLVED at x", "connect ECONNREFUSED", "net::ERR_CERT_DATE_INVALID", "net::ERR_ABORTED", "net::ERR_FAILED", "HTTP 500", ""]


@query(f"SELECT p_partkey, {_listed('p_partkey', _DOMAINS)} AS domain, {_listed('p_partkey', ['no such address', 'no answer', 'certificate', 'aborted', 'not loaded', 'HTTP 500', 'failed'])} AS error FROM part")
def cleaned_inputs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.report_domain(_pick("p_partkey", _CLEAN)).alias("domain"), t.fetch_error(_pick("p_partkey", _ERRORS)).alias("error"))


_WIDE = "list_sum([CASE WHEN ch = '''' THEN 0.191 WHEN contains('ijl', ch) THEN 0.222 WHEN ch = '|' THEN 0.26 WHEN contains(' !,./:;I[]ft', ch) OR ch = chr(92) THEN 0.278 WHEN contains('()-`r', ch) THEN 0.333 WHEN contains('{{}}', ch) THEN 0.334 WHEN ch = '\"' THEN 0.355 WHEN ch = '*' THEN 0.389 WHEN ch = '^' THEN 0.469 WHEN contains('Jcksvxyz', ch) THEN 0.5 WHEN contains('#$?_L0123456789abdeghnopqu', ch) THEN 0.556 WHEN contains('+<=>~', ch) THEN 0.584 WHEN contains('FTZ', ch) THEN 0.611 WHEN contains('&ABEKPSVXY', ch) THEN 0.667 WHEN contains('CDHNRUw', ch) THEN 0.722 WHEN contains('GOQ', ch) THEN 0.778 WHEN contains('Mm', ch) THEN 0.833 WHEN ch = '%' THEN 0.889 WHEN ch = 'W' THEN 0.944 WHEN ch = '@' THEN 1.015 ELSE 0.6 END::DOUBLE * 20 FOR ch IN string_split({0}, '')])"


@query(f"SELECT p_partkey, CAST(floor({_WIDE.format('p_name')} + 0.5) AS BIGINT) AS width, CASE WHEN floor({_WIDE.format('p_name')} + 0.5) <= 150 THEN p_name END AS whole FROM part")
def title_widths(spark, sf_dir):
    """How wide names are as result titles, and which aren't cut at 150 pixels."""
    cut = t.fits(F.col("p_name"), 150, 20)
    return table(spark, sf_dir, "part").select("p_partkey", t.text_width(F.col("p_name"), 20).alias("width"), F.when(cut == F.col("p_name"), cut).alias("whole"))


_SENTENCES = ["Short text.", "One sentence that is a little longer than the others here. " * 2 + "And then a third sentence which makes the whole far too long for a description of a page.", "word " * 60, "", "No full stop here but a text that goes on and on, with commas, and more words; until it is clearly longer than what fits into a description, which ends somewhere"]
_DESCRIBED = ["Short text.", "One sentence that is a little longer than the others here. One sentence that is a little longer than the others here.", "word " * 29 + "word…", "Clear page summary that explains the offer, audience, and next action.", "No full stop here but a text that goes on and on, with commas, and more words; until it is clearly longer than what fits into a description, which ends…"]


@query(f"SELECT p_partkey, {_listed('p_partkey', _DESCRIBED)} AS description, CASE WHEN p_partkey % 2 = 0 THEN 'x.com page' WHEN length(p_name || ' and more words that make the heading longer') <= 58 THEN p_name || ' and more words that make the heading longer' ELSE trim(substr(p_name || ' and more words that make the heading longer', 1, 57)) || '...' END AS title FROM part")
def suggested_texts(spark, sf_dir):
    h1 = F.when(F.col("p_partkey") % 2 == 1, F.concat("p_name", F.lit(" and more words that make the heading longer"))).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", t.suggested_description(_pick("p_partkey", _SENTENCES)).alias("description"), t.suggested_title(F.lit("x.com"), h1).alias("title"))


_TITLES = ["Missing or weak title on home", "Missing meta description on /a", "Broken internal links on home", "Redirecting internal links on /b", "Canonical URL redirects on home", "Robots.txt not found", "Slow Largest Contentful Paint on home", "HSTS security header missing on home", "Apple touch icon missing on /c", "Structured data JSON is invalid on home", "Something odd on /d"]
_FIXES = ["", "", "Fix each broken link.", "Link to the final address.", "", "Publish a file.", "Compress the image.", "", "Add an icon.", "Repair the markup.", "Look at it"]


@query(f"""SELECT p_partkey, {_listed('p_partkey', ['title', 'meta-description', 'internal-links', 'internal-links', 'canonical', 'crawl-discovery', 'performance', 'security', 'apple-touch-icon-missing', 'structured-data', 'content-depth'])} AS area,
  {_listed('p_partkey', ['title', 'meta-description', 'internal-links', 'internal-links', 'canonical', 'crawl-discovery', 'performance', 'security', 'apple-touch-icon-missing', 'structured-data', 'content-depth'])} AS by_title,
  {_listed('p_partkey', ['content', 'content', 'review', 'technical', 'code', 'technical', 'technical', 'technical', 'review', 'review', 'content'])} AS work,
  {_listed('p_partkey', ['title', 'description', 'internal links', 'internal links', 'canonical', 'robots.txt', 'speed', 'security', 'apple touch', 'json', 'rerun'])} AS acceptance,
  {_listed('p_partkey', ['unsupported', 'unsupported', 'manual_task', 'manual_task', 'unsupported', 'manual_task', 'manual_task', 'unsupported', 'manual_task', 'manual_task', 'manual_task'])} AS mode,
  {_listed('p_partkey', ['generated_proposal', 'generated_proposal', 'manual_task', 'manual_task', 'github_pr_candidate', 'manual_task', 'manual_task', 'manual_task', 'manual_task', 'manual_task', 'manual_task'])} AS mode_with_snippet, 'images' AS image_area FROM part""")
def finding_classes(spark, sf_dir):
    """Areas, kinds of work, acceptance checks and ways to repair by a finding's words."""
    title, fix = _pick("p_partkey", _TITLES), _pick("p_partkey", _FIXES)
    none = F.lit("")
    area = c.area(title, none, F.when(fix.contains("image"), none).otherwise(fix))
    image = c.area(F.lit("Odd thing on home"), none, F.lit("Compress the image."))
    return table(spark, sf_dir, "part").select("p_partkey", area.alias("area"), c.area(title).alias("by_title"), c.work(title).alias("work"), c.acceptance(title).alias("acceptance"), c.repair_mode(title, fix, none, none, none).alias("mode"), c.repair_mode(title, fix, F.lit("<x>"), none, none).alias("mode_with_snippet"), image.alias("image_area"))


_W = "regexp_extract_all(replace(lower(text), '’', ''''), '([\\p{L}\\p{N}][\\p{L}\\p{N}''-]*)', 1)"


@query(f"""WITH d AS (SELECT doc_id, text, {_W} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT *, len(w) AS n FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS words, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS solid,
  CASE WHEN n = 0 THEN '0 min' WHEN n / 238.0 < 1 THEN 'under 1 min' ELSE CAST(CAST(floor(n / 238.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' END AS reading,
  CASE WHEN n = 0 THEN '0 min' WHEN n / 150.0 < 1 THEN 'under 1 min' ELSE CAST(CAST(floor(n / 150.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' END AS speaking,
  CAST(coalesce(list_max([length(x) FOR x IN w]), 0) AS BIGINT) AS longest,
  CAST(len([x FOR x IN regexp_split_to_array(text, '\\n\\s*\\n') IF trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '']) AS BIGINT) AS paragraphs FROM e""")
def text_statistics(spark, sf_dir):
    w = t.words(F.col("text"))
    size = F.size("w")
    minutes = lambda wpm: F.when(size == 0, "0 min").when(size / wpm < 1, "under 1 min").otherwise(F.concat(n.half_up(size / float(wpm)).cast("string"), F.lit(" min")))
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", w.alias("w"))
    solid = F.length(F.regexp_replace("text", r"\s", ""))
    return d.select("doc_id", size.cast("long").alias("words"), solid.cast("long").alias("solid"), minutes(238).alias("reading"), minutes(150).alias("speaking"), F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).cast("long").alias("longest"), t.paragraphs(F.col("text")).cast("long").alias("paragraphs"))
