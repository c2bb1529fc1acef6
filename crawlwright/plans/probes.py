"""Findings from resource checks, loads, headers and discovery files, which arrive as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.functions import urls as u

#: Statuses that ask to come again later, and those of an edge that can't reach the site.
THROTTLED, EDGE = [408, 425, 429, 503], [520, 521, 522, 523, 524, 525, 526]
LARGE_IMAGE, SLOW_LOAD, LARGE_HTML = 500_000, 4000, 500_000


def throttled(status: Column) -> Column:
    return F.coalesce(status.isin(THROTTLED), F.lit(False))


def edge_failure(kind: Column, status: Column) -> Column:
    return F.coalesce((kind == "internal") & status.isin(EDGE), F.lit(False))


def broken(kind: Column, ok: Column, status: Column) -> Column:
    bad = ~F.coalesce(ok, F.lit(False)) | F.coalesce(status, F.lit(0)).isin(0) | (status >= 400)
    return ~throttled(status) & ~edge_failure(kind, status) & F.coalesce(bad, F.lit(True))


def transient(kind: Column, status: Column, guarded: Column, error: Column) -> Column:
    """A canonical target that couldn't be looked at this time, which says nothing about it."""
    silent = F.coalesce(status, F.lit(0)).isin(0) & ~F.coalesce(guarded, F.lit(False)) & (F.coalesce(error, F.lit("")) != "")
    return edge_failure(kind, status) | ((kind == "internal") & silent)


def page_probes(checks: DataFrame) -> DataFrame:
    """Per page (page_url): how many checked links and images are broken, redirect or too large, and its canonical target's state.

    checks: page_url, url, kind, ok, status, content_length, redirected, error, guarded. One aggregation with
    partial sums: a page with many checks isn't gathered.
    """
    kind, status, ok = F.col("kind"), F.col("status"), F.col("ok")
    bad = broken(kind, ok, status)
    moved = ~bad & ~throttled(status) & F.coalesce("redirected", F.lit(False))
    quiet = transient(kind, status, F.col("guarded"), F.col("error"))
    n = lambda c, name: F.count_if(c).alias(name)
    image = kind == "image"
    plain = F.col("url").startswith("http:") & F.col("page_url").startswith("https:") & kind.isin("internal", "external", "image")
    canonical = F.col("canonical") if "canonical" in checks.columns else (kind == "canonical")
    return checks.groupBy("page_url").agg(
        n((kind == "internal") & bad, "broken_internal"),
        n((kind == "external") & bad, "broken_external"),
        n((kind == "internal") & moved, "redirecting_internal"),
        n(image & bad, "broken_images"),
        n(image & F.coalesce(ok, F.lit(False)) & (F.col("content_length") > LARGE_IMAGE), "large_images"),
        n(plain, "insecure"),
        n(canonical & bad & ~quiet, "canonical_broken"),
        n(canonical & ~bad & F.coalesce("redirected", F.lit(False)) & ~quiet, "canonical_moved"),
    )


#: Rule, title, severity, confidence and the counts that decide. The canonical rules exclude each other.
PROBE_RULES = [
    (12, "Broken internal links", "critical", "verified", "broken_internal > 0"),
    (13, "Broken external links", "warning", "needs-review", "broken_external > 0"),
    (14, "Redirecting internal links", "notice", "verified", "redirecting_internal > 0"),
    (15, "Broken images", "warning", "verified", "broken_images > 0"),
    (16, "Large image files", "notice", "needs-review", "large_images > 0"),
    (17, "Non-HTTPS resources", "warning", "verified", "insecure > 0"),
    (36, "Canonical URL is not reachable", "warning", "verified", "canonical_broken > 0"),
    (37, "Canonical URL redirects", "notice", "verified", "canonical_broken = 0 and canonical_moved > 0"),
]


def probe_findings(checks: DataFrame) -> DataFrame:
    """(page_url, rule_seq, severity, confidence, rule) of the rules that the checks fire."""
    fired = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(seq).alias("rule_seq"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), F.lit(title).alias("rule"))) for seq, title, severity, sure, when in PROBE_RULES]))
    return page_probes(checks).select("page_url", F.explode(fired).alias("f")).select("page_url", "f.*")


def header_findings(pages: DataFrame) -> DataFrame:
    """(page_id, rule_seq, severity) from (page_id, page_seq, url, headers map with lower-case names). Pages without captured headers pass."""
    h = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    framed = (h("x-frame-options") != "") | F.lower(h("content-security-policy")).contains("frame-ancestors")
    lacking = (F.lower(h("x-content-type-options")) != "nosniff") | ~framed | (h("referrer-policy") == "")
    there = F.col("headers").isNotNull() & (F.size("headers") > 0)
    rules = F.array_compact(
        F.array(
            F.when(F.lower(h("x-robots-tag")).contains("noindex"), F.struct(F.lit(55).alias("rule_seq"), F.lit("critical").alias("severity"))),
            F.when((F.col("page_seq") == 1) & lacking, F.struct(F.lit(63).alias("rule_seq"), F.lit("notice").alias("severity"))),
            F.when((u.scheme(F.col("url")) == "https") & (h("strict-transport-security") == ""), F.struct(F.lit(64).alias("rule_seq"), F.lit("notice").alias("severity"))),
        )
    )
    return pages.filter(there).select("page_id", F.explode(rules).alias("f")).select("page_id", "f.*")


def site_findings(discovery: DataFrame) -> DataFrame:
    """(host, rule_seq, severity) from (host, robots_ok, search_blocked, sitemap_ok, sitemaps_listed)."""
    rules = F.array_compact(
        F.array(
            F.when(~F.col("robots_ok"), F.struct(F.lit(65).alias("rule_seq"), F.lit("warning").alias("severity"))),
            F.when(F.col("robots_ok") & (F.col("search_blocked") > 0), F.struct(F.lit(66).alias("rule_seq"), F.lit("critical").alias("severity"))),
            F.when(F.col("robots_ok") & F.col("sitemap_ok") & (F.col("sitemaps_listed") == 0), F.struct(F.lit(67).alias("rule_seq"), F.lit("notice").alias("severity"))),
            F.when(~F.col("sitemap_ok"), F.struct(F.lit(68).alias("rule_seq"), F.lit("warning").alias("severity"))),
        )
    )
    return discovery.select("host", F.explode(rules).alias("f")).select("host", "f.*")


def performance_findings(speed: DataFrame) -> DataFrame:
    """(url, rule_seq, severity) from (url, score, lcp, tbt, cls) of home pages."""
    step = lambda seq, fires, severe: F.when(fires, F.struct(F.lit(seq).alias("rule_seq"), F.when(severe, "critical").otherwise("warning").alias("severity")))
    c = F.col
    rules = F.array_compact(F.array(step(1, c("score") < 75, c("score") < 50), step(2, c("lcp") > 2500, c("lcp") > 4000), step(3, c("tbt") > 300, c("tbt") > 600), step(4, c("cls") > 0.1, c("cls") > 0.25)))
    return speed.select("url", F.explode(rules).alias("f")).select("url", "f.*")


#: Rule, title, severity and the sums of a page's resources that decide.
WATERFALL_RULES = [
    (6, "Render-blocking resources", "warning", "render_blocking >= 2"),
    (7, "Heavy JavaScript payload", "warning", "script_bytes >= 307200"),
    (8, "Heavy image payload", "notice", "image_bytes >= 716800"),
    (9, "Slow resource requests", "notice", "slow > 0"),
    (10, "Large total page payload", "notice", "bytes >= 2097152"),
    (11, "Many third-party resources", "notice", "third_party >= 12"),
]
#: Guards, which tell that rendering supplies what the plain HTML lacks; s is static, r rendered.
GUARDS = [
    (22, "H1 exists after render", "s.h1_count = 0 and r.h1_count > 0"),
    (23, "Internal links exist after render", "s.inner_links = 0 and r.inner_links > 0"),
    (24, "Content is not thin after render", "s.word_count < 50 and r.word_count >= 250"),
    (25, "Title exists after render", "s.title = '' and r.title <> ''"),
    (26, "Description exists after render", "s.description = '' and r.description <> ''"),
    (27, "Canonical exists after render", "s.canonical = '' and r.canonical <> ''"),
    (28, "Viewport exists after render", "s.viewport = '' and r.viewport <> ''"),
    (29, "Social images exist after render", "(s.og_image = '' or s.twitter_image = '') and r.og_image <> '' and r.twitter_image <> ''"),
    (30, "Structured data exists after render", "size(s.schema_types) = 0 and size(r.schema_types) > 0"),
]


def waterfall_findings(sums: DataFrame, by: str) -> DataFrame:
    """(by, rule_seq, severity, rule) from a page's resource sums (with render_blocking)."""
    fired = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(seq).alias("rule_seq"), F.lit(severity).alias("severity"), F.lit(title).alias("rule"))) for seq, title, severity, when in WATERFALL_RULES]))
    return sums.select(by, F.explode(fired).alias("f")).select(by, "f.*")


def guards(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_id, rule_seq, severity good, rule) of pages that both tables of facts have."""
    both = static.alias("s").join(rendered.alias("r"), F.col("s.page_id") == F.col("r.page_id"))
    fired = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(seq).alias("rule_seq"), F.lit("good").alias("severity"), F.lit(title).alias("rule"))) for seq, title, when in GUARDS]))
    return both.select("s.page_id", F.explode(fired).alias("f")).select("page_id", "f.*")


#: How many links and images of a page are checked, and from which number of pages on only the first ones are.
LINKS_CHECKED, IMAGES_CHECKED, ALL_PAGES, FIRST_PAGES = 50, 25, 50, 10
#: Rules on how a page loads: order, title, severity, confidence, and what decides. They are limits on a row of loads.
LOAD_RULES = [
    (18, "URL redirects before rendering", "notice", "needs-review", "moved"),
    (19, "Long redirect chain before rendering", "warning", "verified", "chain_length > 1"),
    (20, "Slow rendered load", "warning", "needs-review", f"settled and load_ms > {SLOW_LOAD}"),
    (21, "Large HTML response", "notice", "needs-review", f"transfer_size > {LARGE_HTML}"),
]
#: Audits of a speed report that may name a saving, in the order in which equal ones are listed.
OPPORTUNITIES = [
    "render-blocking-resources",
    "unused-javascript",
    "unused-css-rules",
    "unminified-javascript",
    "unminified-css",
    "modern-image-formats",
    "uses-optimized-images",
    "uses-responsive-images",
    "offscreen-images",
    "total-byte-weight",
    "server-response-time",
    "largest-contentful-paint-element",
]


def load_findings(loads: DataFrame) -> DataFrame:
    """(page_id, rule_seq, severity, confidence, rule) from (page_id, url, final_url, redirected, chain_length, settled, load_ms,
    transfer_size). A null in settled counts as settled, other nulls as nothing measured."""
    final = F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))
    moved = F.coalesce("redirected", F.lit(False)) | (u.strip_hash(final) != u.strip_hash(F.col("url")))
    rows = loads.withColumn("moved", moved).withColumn("settled", F.coalesce("settled", F.lit(True)))
    one = lambda seq, title, severity, sure, when: F.when(F.expr(when), F.struct(F.lit(seq).alias("rule_seq"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), F.lit(title).alias("rule")))
    return rows.select("page_id", F.explode(F.array_compact(F.array(*[one(*r) for r in LOAD_RULES]))).alias("f")).select("page_id", "f.*")


def opportunities(raw: DataFrame, top: int = 5) -> DataFrame:
    """(url, nth, id, title, savings_ms, savings_bytes, score) of a speed report (url, json): the audits that name a saving or
    score under 90, the largest saving first."""
    v = F.try_parse_json("json")
    number = lambda path: F.coalesce(F.try_variant_get(v, path, "double"), F.lit(0.0))
    rows = []
    for i, name in enumerate(OPPORTUNITIES):
        at = f"$.lighthouseResult.audits['{name}']"
        ms, size, score = number(f"{at}.details.overallSavingsMs"), number(f"{at}.details.overallSavingsBytes"), F.try_variant_get(v, f"{at}.score", "double")
        there = F.try_variant_get(v, at, "variant").isNotNull() & ((ms > 0) | (size > 0) | F.coalesce(score < 0.9, F.lit(False)))
        title = F.coalesce(F.nullif(F.try_variant_get(v, f"{at}.title", "string"), F.lit("")), F.lit(name))
        rows.append(F.when(there, F.struct((-ms).alias("a"), (-size).alias("b"), F.lit(i).alias("i"), F.lit(name).alias("id"), title.alias("title"), F.floor(score * 100 + 0.5).alias("score"))))
    best = F.slice(F.array_sort(F.array_compact(F.array(*rows))), 1, top)
    return raw.select("url", F.posexplode(best).alias("p", "o")).select("url", (F.col("p") + 1).alias("nth"), "o.id", "o.title", (-F.col("o.a")).alias("savings_ms"), (-F.col("o.b")).alias("savings_bytes"), "o.score")


def opportunity_findings(found: DataFrame) -> DataFrame:
    """(url, rule_seq, sub, severity, rule): a finding for each opportunity, in their order."""
    large = (F.col("savings_ms") > 1000) | (F.col("savings_bytes") > 250_000)
    return found.select("url", F.lit(5).alias("rule_seq"), F.col("nth").alias("sub"), F.when(large, "warning").otherwise("notice").alias("severity"), F.col("title").alias("rule"))


def probe_plan(facts: DataFrame, most_pages: int) -> DataFrame:
    """(page_id, url, kind) of what is checked: each page's first distinct links and images and its canonical address; of a
    crawl that may be larger than ALL_PAGES the first pages only."""
    rows = facts if most_pages <= ALL_PAGES else facts.filter(F.col("page_seq") <= FIRST_PAGES)
    web = lambda c: F.array_distinct(F.filter(c, lambda x: x.rlike("(?i)^https?:")))
    links = F.transform(F.slice(web("links"), 1, LINKS_CHECKED), lambda x: F.struct(x.alias("url"), F.when(u.origin(x) == F.col("origin"), "internal").otherwise("external").alias("kind")))
    images = F.transform(F.slice(web("image_urls"), 1, IMAGES_CHECKED), lambda x: F.struct(x.alias("url"), F.lit("image").alias("kind")))
    target = F.col("canonical_url")
    own = F.when(u.same_site(u.origin(target), F.col("origin")), "internal").otherwise("canonical")
    canonical = F.when(target != "", F.array(F.struct(target.alias("url"), own.alias("kind")))).otherwise(F.array().cast("array<struct<url:string,kind:string>>"))
    return rows.select("page_id", F.explode(F.concat(links, images, canonical)).alias("r")).select("page_id", "r.url", "r.kind")


def declared_images(facts: DataFrame) -> DataFrame:
    """(page_id, key, url): the share images and icons that pages declare, each address once over all pages, at the first
    page that names it; and one guess at the usual place for each origin whose first page declares no icon.

    Of a site's pages only those that name an address or lack an icon are compared, by the address and by the origin."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), F.col(c).alias("url")) for i, (k, c) in enumerate((("og", "og_image"), ("twitter", "twitter_image"), ("apple-touch-icon", "touch_icon")))])
    named = facts.select("page_id", F.explode(keys).alias("k")).select("page_id", "k.i", "k.key", "k.url").filter("url <> ''")
    lacking = facts.filter("touch_icon = ''").groupBy("origin").agg(F.min("page_id").alias("page_id"))
    guess = lacking.select("page_id", F.lit(3).alias("i"), F.lit("apple-touch-icon-probe").alias("key"), F.concat("origin", F.lit("/apple-touch-icon.png")).alias("url"))
    first = F.struct("page_id", "i", "key")
    return named.unionByName(guess).groupBy("url").agg(F.min(first).alias("f")).select("f.page_id", "f.key", "url")


def loads_as_image(ok: Column, content_type: Column, url: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.coalesce(ok, F.lit(False)) & (kind.contains("image/") | ((kind == "") & u.path(url).rlike(r"\.(png|jpe?g|gif|webp|avif|svg)$")))


def image_findings(facts: DataFrame, checks: DataFrame) -> DataFrame:
    """(page_id, rule_seq, severity, rule): declared share images (57) and icons (59) that don't load.

    checks: page_id, key, url, ok, status, content_type of declared_images() once fetched. A share image counts at the page
    that it was checked for, an icon at every page that declares its address.
    """
    bad = checks.filter(~loads_as_image(F.col("ok"), F.col("content_type"), F.col("url")))
    social = bad.filter(F.col("key").isin("og", "twitter")).select("page_id").distinct()
    social = facts.filter("og_image <> '' and twitter_image <> ''").join(social, "page_id", "left_semi").select("page_id", F.lit(57).alias("rule_seq"), F.lit("warning").alias("severity"), F.lit("Social share image is not loadable").alias("rule"))
    icons = bad.filter("key = 'apple-touch-icon'").select(F.col("url").alias("touch_icon")).distinct()
    return social.unionByName(facts.join(icons, "touch_icon", "left_semi").select("page_id", F.lit(59).alias("rule_seq"), F.lit("notice").alias("severity"), F.lit("Apple touch icon is not loadable").alias("rule")))


def hreflang_findings(facts: DataFrame) -> DataFrame:
    """(page_id, rule_seq, sub, severity, rule): language tags of a page (rules 32 to 35), as expressions over its own list.

    Per tag an invalid code and a code that came before; a second finding with the same title and evidence is left out. Then a
    missing reference to the page itself, and a missing default among several."""
    tags = F.transform("hreflangs", lambda x, i: F.struct(i.alias("i"), F.lower(x["code"]).alias("code"), x["href"].alias("href"), x["code"].alias("raw")))
    invalid = F.transform(F.filter("_tags", lambda x: ~x["code"].rlike("^(x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*)$")), lambda x: F.struct(x["i"].alias("i"), F.lit(32).alias("rule_seq"), F.concat_ws(" ", x["raw"], x["href"]).alias("proof")))
    before = lambda x: F.element_at(F.filter("_tags", lambda y: (y["i"] < x["i"]) & (y["code"] == x["code"])), -1)
    twice = F.transform(F.filter("_tags", lambda x: F.exists("_tags", lambda y: (y["i"] < x["i"]) & (y["code"] == x["code"]))), lambda x: F.struct(x["i"].alias("i"), F.lit(33).alias("rule_seq"), F.concat_ws(" ", x["code"], before(x)["href"], x["href"]).alias("proof")))
    rows = facts.filter(F.size("hreflangs") > 0).withColumn("_tags", tags)
    n = F.size("_tags")
    own = F.exists("_tags", lambda x: u.sorted_key(x["href"]) == u.sorted_key(F.col("url")))
    alone = F.when(~own, F.struct(n.alias("i"), F.lit(34).alias("rule_seq"), F.lit("").alias("proof")))
    lacking = F.when((n > 1) & ~F.exists("_tags", lambda x: x["code"] == "x-default"), F.struct((n + 1).alias("i"), F.lit(35).alias("rule_seq"), F.lit("").alias("proof")))
    every = F.array_sort(F.concat(invalid, twice, F.array_compact(F.array(alone, lacking))))
    once = F.filter(every, lambda x: ~F.exists(every, lambda y: (y["rule_seq"] == x["rule_seq"]) & (y["proof"] == x["proof"]) & (y["i"] < x["i"])))
    out = rows.select("page_id", F.posexplode(once).alias("sub", "f"))
    kind = F.col("f.rule_seq")
    severity = F.when(kind.isin(32, 33), "warning").otherwise("notice")
    rule = F.when(kind == 32, "Invalid hreflang code").when(kind == 33, "Duplicate hreflang tag").when(kind == 34, "Hreflang is missing a self-reference").otherwise("Hreflang cluster has no x-default")
    return out.select("page_id", kind.alias("rule_seq"), "sub", severity.alias("severity"), rule.alias("rule"))
