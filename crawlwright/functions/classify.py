"""Ordered keyword classifiers over finding titles and resources, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlwright.functions.text import slug

#: The first entry any of whose words the text holds decides.
AREAS = [
    ("performance", ["pagespeed", "largest contentful paint", "total blocking time", "layout shift", "render-blocking", "unused javascript", "speed index"]),
    ("structured-data", ["structured data", "schema", "json-ld", "microdata", "rdfa"]),
    ("canonical", ["canonical"]),
    ("hreflang", ["hreflang"]),
    ("internal-links", ["broken internal link", "redirecting internal link", "internal links"]),
    ("images", ["broken image", "image"]),
    ("meta-description", ["meta description", "snippet"]),
    ("title", ["title"]),
    ("headings", ["h1", "heading"]),
    ("crawl-discovery", ["robots", "sitemap"]),
    ("security", ["https", "ssl", "mixed content", "hsts", "security header"]),
    ("content-depth", ["thin", "word count", "content"]),
    ("mobile", ["viewport", "mobile"]),
    ("social", ["social"]),
]
EFFORTS = [
    ("15-45 min", ["broken link", "broken image"]),
    ("45-120 min", ["pagespeed", "largest contentful paint", "total blocking time", "layout shift"]),
    ("15-30 min", ["robots", "sitemap"]),
    ("5-15 min", ["title", "description", "canonical"]),
    ("15-45 min", ["social", "schema", "viewport"]),
    ("30-90 min", ["hreflang", "security", "https"]),
    ("45-120 min", ["slow", "large"]),
    ("30-90 min", ["thin", "internal links", "heading"]),
]
#: What an area of findings takes and what work it is.
AREA_EFFORTS = [("5-15 min", ["title", "meta-description", "canonical", "social"]), ("15-45 min", ["structured-data", "images", "internal-links", "hreflang", "mobile"]), ("30-90 min", ["security", "content-depth", "crawl-discovery"]), ("45-120 min", ["performance"])]
AREA_WORK = [("content", ["title", "meta-description", "content-depth", "images", "internal-links", "social"]), ("code", ["structured-data", "canonical", "mobile"]), ("technical", ["performance", "security", "crawl-discovery", "hreflang"])]
#: The kind of work by words of a finding's title.
WORK = [
    ("content", ["title", "description", "thin", "alt"]),
    ("code", ["schema", "canonical", "viewport", "social"]),
    ("content", ["broken link", "broken image"]),
    ("technical", ["robots", "sitemap", "redirect", "hreflang", "https", "security", "slow", "large", "pagespeed", "largest contentful paint", "total blocking time", "layout shift"]),
]
#: Fixed values, but for the labels: acceptance checks: all of the first words and, if there are any, one of the second ones.
ACCEPTANCE = [
    ("title", ["title"], []),
    ("description", ["description"], []),
    ("h1", ["h1"], []),
    ("internal links", ["internal links"], []),
    ("broken link", ["broken", "link"], []),
    ("broken image", ["broken", "image"], []),
    ("redirecting internal", ["redirecting internal"], []),
    ("canonical conflicts", ["canonical conflicts"], []),
    ("noindex", ["noindex"], []),
    ("canonical", ["canonical"], []),
    ("hreflang", ["hreflang"], []),
    ("json", ["json"], []),
    ("security", [], ["https", "hsts", "security"]),
    ("speed", [], ["pagespeed", "largest contentful paint", "total blocking time", "layout shift"]),
    ("weight", [], ["slow", "large image", "large html"]),
    ("social share", ["social share"], []),
    ("apple touch", ["apple touch"], []),
    ("alt", ["alt"], []),
    ("structured data", ["structured data"], []),
    ("viewport", ["viewport"], []),
    ("language", ["language"], []),
    ("encoding", ["encoding"], []),
    ("doctype", ["doctype"], []),
    ("redirect", ["redirect"], []),
    ("robots.txt", ["robots.txt"], []),
    ("sitemap", ["sitemap"], []),
]
#: Words that decide how a repair can be made.
PLATFORM_WORDS = ["wordpress", "woocommerce", "shopify", "webflow", "cms", "platform-seo-audit"]
CODE_WORDS = ["schema", "canonical", "viewport", "doctype", "charset", "social share", "og:image", "twitter:image"]
COPY_WORDS = ["title", "description", "h1", "alt"]
RESOURCES = [("script", ["script"], ""), ("stylesheet", ["css", "link"], r"\.css([?#]|$)"), ("image", ["img", "image"], r"\.(png|jpe?g|gif|webp|avif|svg)([?#]|$)"), ("font", ["font"], r"\.(woff2?|ttf|otf|eot)([?#]|$)"), ("fetch", ["fetch", "xmlhttprequest", "beacon"], ""), ("frame", ["iframe", "frame"], ""), ("document", ["navigation"], "")]


def first_match(text: Column, table: list[tuple[str, list[str]]], default: Column) -> Column:
    out = default
    for label, words in reversed(table):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def area(title: Column, *more: Column) -> Column:
    """The area of a finding by its title and, where there are any, why it matters and how to fix it."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, *more)]))
    return first_match(text, AREAS, slug(F.element_at(F.split(text, " on "), 1), 60))


def area_effort(area: Column) -> Column:
    return F.coalesce(*[F.when(area.isin(names), label) for label, names in AREA_EFFORTS], F.lit("15-30 min"))


def area_work(area: Column) -> Column:
    return F.coalesce(*[F.when(area.isin(names), label) for label, names in AREA_WORK], F.lit("review"))


def work(title: Column) -> Column:
    """The kind of work that a finding asks for, by its title."""
    return first_match(F.lower(title), WORK, F.lit("review"))


def acceptance(title: Column) -> Column:
    """Which acceptance check a finding gets, by its title: the first entry all of whose words (or one of whose words) it holds."""
    text, out = F.lower(title), F.lit("rerun")
    for label, all_of, any_of in reversed(ACCEPTANCE):
        hit = F.lit(True)
        for word in all_of:
            hit = hit & text.contains(word)
        if any_of:
            some = F.lit(False)
            for word in any_of:
                some = some | text.contains(word)
            hit = hit & some
        out = F.when(hit, label).otherwise(out)
    return out


def repair_mode(title: Column, fix: Column, snippet: Column, source: Column, kind: Column) -> Column:
    """How a finding can be repaired: by a platform's editor, a code change, a suggested text, or by hand; unsupported without any fix."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.lower(F.concat_ws(" ", *map(blank, (title, fix, source, kind))))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    has = blank(snippet) != ""
    return (
        F.when((blank(fix) == "") & ~has, "unsupported")
        .when(holds(PLATFORM_WORDS), "cms_candidate")
        .when(has & holds(CODE_WORDS), "github_pr_candidate")
        .when(has & holds(COPY_WORDS), "generated_proposal")
        .otherwise("manual_task")
    )


def effort(title: Column) -> Column:
    return first_match(F.lower(title), EFFORTS, F.lit("15-30 min"))


def resource(initiator: Column, path: Column) -> Column:
    kind = F.lower(F.coalesce(initiator, F.lit("")))
    out = F.when(kind == "", F.lit("other")).otherwise(kind)
    for label, kinds, pattern in reversed(RESOURCES):
        hit = kind.isin(kinds)
        out = F.when(hit | F.lower(path).rlike(pattern) if pattern else hit, F.lit(label)).otherwise(out)
    return out
