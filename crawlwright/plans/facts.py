"""Facts of raw HTML pages, all as built-in expressions over one scan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.functions import text as t
from crawlwright.functions import urls as u
from crawlwright.operators.order import place

#: How parts of a page are told apart in raw HTML.
LINK = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>.*?</a>"""
LINK_TEXT = r"""(?is)<a\b[^>]*href=["'][^"']+["'][^>]*>(.*?)</a>"""
IMAGE = r"(?is)(<img\b[^>]*>)"
HEADING_LEVEL = r"(?is)<h([1-6])\b[^>]*>.*?</h[1-6]>"
HEADING_TEXT = r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"
JSON_LD = r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
SCRIPT = r"(?is)<script.*?</script>"
STYLE = r"(?is)<style.*?</style>"
NOSCRIPT = r"(?is)<noscript.*?</noscript>"
HEAD = r"(?is)<head\b[^>]*>(.*?)</head>"
BODY = r"(?is)(<body.*?</body>)"
MAIN = r"(?is)(<main\b.*?</main>)"
FRAME = r"(?is)<(nav|header|footer|aside)\b.*?</\1>"
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HTML_LANG = r"""(?is)<html\b[^>]*lang=["']([^"']+)["']"""
CHARSET = r"""(?is)<meta\b[^>]*charset=["']?([^"'\s/>]+)"""
META = r"(?is)(<meta\b[^>]*>)"
REL = r"(?is)(<link\b[^>]*>)"
SCRIPT_FILE = r"""(?is)<script\b[^>]*src=["']([^"']+)["'][^>]*>"""
STYLESHEET = r"""(?is)<link\b(?=[^>]*rel=["'][^"']*stylesheet[^"']*["'])(?=[^>]*href=["']([^"']+)["'])[^>]*>"""
ALTERNATE_CODE = r"""(?is)<link\b(?=[^>]*rel=["'][^"']*alternate[^"']*["'])(?=[^>]*hreflang=["']([^"']+)["'])(?=[^>]*href=["'][^"']+["'])[^>]*>"""
ALTERNATE_HREF = r"""(?is)<link\b(?=[^>]*rel=["'][^"']*alternate[^"']*["'])(?=[^>]*hreflang=["'][^"']+["'])(?=[^>]*href=["']([^"']+)["'])[^>]*>"""
#: Parts of structured data that hold further items.
NESTED = ["@graph", "itemListElement", "mainEntity", "hasPart", "review", "offers", "aggregateRating", "breadcrumb"]


def block_types(blocks: list[str]) -> tuple[list[str], int]:
    """(the types in a page's structured-data blocks, how many blocks don't parse or lack a context).

    Types come in reading order, an item's own before those of its parts, however deep they are nested. A block that
    doesn't parse has the type invalid-json."""
    import json

    def no_constant(name: str) -> None:
        raise ValueError(name)  # NaN and Infinity are no JSON

    there = lambda x: isinstance(x, dict | list) or bool(x)
    types, wrong = [], 0
    for block in blocks:
        try:
            value = json.loads(block or "{}", parse_constant=no_constant)
        except (ValueError, RecursionError):
            types.append("invalid-json")
            wrong += 1
            continue
        wait = [value]
        while wait:
            item = wait.pop()
            if isinstance(item, list):
                wait += reversed(item)
            elif isinstance(item, dict):
                own = item.get("@type")
                types += [str(x) for x in (own if isinstance(own, list) else [own]) if x]
                wait += [item[k] for k in reversed(NESTED) if k in item]
        tops = value if isinstance(value, list) else [value]
        wrong += any(there(x) and not (isinstance(x, dict) and there(x.get("@context"))) for x in tops)
    return types, wrong


def schema(blocks: Column | str) -> Column:
    """block_types() of pages, in Arrow batches: a document of unknown depth needs recursion, which expressions don't have."""

    def types(column: pa.Array) -> pa.Array:
        got = [block_types(x or []) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.int32())], ["types", "wrong"])

    return F.arrow_udf(types, "types array<string>, wrong int")(blocks)


def _meta(head: Column, kind: str, key: str) -> Column:
    """content of the first of a head's meta tags whose attribute is key."""
    mine = F.filter(head, lambda x: F.regexp_extract(x, rf"""(?i)\b{kind}=["']([^"']*)["']""", 1) == key)
    return F.when(F.size(mine) > 0, t.decode(F.regexp_extract(F.get(mine, F.lit(0)), r"""(?i)\bcontent=["']([^"']*)["']""", 1))).otherwise(F.lit(""))


def _rel(head: Column, rel: str) -> Column:
    mine = F.filter(head, lambda x: F.array_contains(F.split(F.lower(F.regexp_extract(x, r"""(?i)\brel=["']([^"']*)["']""", 1)), r"\s+"), F.lit(rel)))
    return F.when(F.size(mine) > 0, F.regexp_extract(F.get(mine, F.lit(0)), r"""(?i)\bhref=["']([^"']*)["']""", 1)).otherwise(F.lit(""))


def facts(pages: DataFrame) -> DataFrame:
    """A row per page. A site is a host without www; page_seq counts its pages by page_id, and page 1 is its home.

    Shuffles carry the extracted columns, not the HTML. A site may hold most of the pages, so its pages are numbered by lots.
    Null HTML is an empty page; pages with a null url are of a site with a null name. Other columns are left out.
    """
    return numbered(extracted(pages))


def extracted(pages: DataFrame) -> DataFrame:
    """facts() without the numbers of pages: row-wise, one pass."""
    html = F.coalesce(F.col("html"), F.lit(""))
    markup = F.regexp_replace(F.regexp_replace(html, SCRIPT, ""), STYLE, "")
    head = F.regexp_extract(html, HEAD, 1)
    url = F.col("url")
    one = pages.select("page_id", "url", html.alias("_html"), markup.alias("_markup"), head.alias("_head"))
    plain = F.regexp_replace("_markup", NOSCRIPT, "")
    one = one.withColumns({"_metas": F.regexp_extract_all("_head", F.lit(META), 1), "_rels": F.regexp_extract_all("_head", F.lit(REL), 1)})
    one = one.withColumn("_body", F.coalesce(F.nullif(F.regexp_extract(plain, BODY, 1), F.lit("")), plain))
    main = F.regexp_extract("_body", MAIN, 1)
    content = F.regexp_replace(F.when(main == "", F.col("_body")).otherwise(main), FRAME, "")
    leads = F.filter(F.transform(F.regexp_extract_all(content, F.lit(PARAGRAPH), 1), t.plain), lambda p: F.size(F.split(p, " ")) >= 8)
    hrefs = F.regexp_extract_all("_markup", F.lit(LINK), 1)
    images = F.regexp_extract_all("_markup", F.lit(IMAGE), 1)
    ld = F.regexp_extract_all("_html", F.lit(JSON_LD), 1)
    one = one.withColumns({k: F.expr(v) for k, v in u.BASE.items()})
    one = one.withColumns(
        {
            "_links": hrefs,
            "_scripts": F.regexp_extract_all("_html", F.lit(SCRIPT_FILE), 1),
            "_sheets": F.regexp_extract_all("_html", F.lit(STYLESHEET), 1),
            "_alternates": F.regexp_extract_all("_head", F.lit(ALTERNATE_HREF), 1),
            "_sources": F.transform(images, lambda x: F.regexp_extract(x, r"""(?i)\bsrc=["']([^"']*)["']""", 1)),
            "_single": F.array(_meta(F.col("_metas"), "name", "twitter:image"), *[_meta(F.col("_metas"), "property", k) for k in ("og:image", "og:url")], *[_rel(F.col("_rels"), k) for k in ("canonical", "apple-touch-icon", "icon")]),
        }
    )
    one = one.withColumn("_here", F.expr(f"transform(_single, h -> if(h = '', '', {u.against('h')}))"))
    full = lambda c: F.expr(f"transform({c}, h -> {u.against('h')})")
    here = lambda i: F.get("_here", F.lit(i))
    out = one.select(
        "page_id",
        "url",
        u.site(url).alias("host"),
        u.origin(url).alias("origin"),
        u.path(url).alias("path"),
        F.trim(t.decode(t.strip_tags(F.regexp_extract("_head", TITLE, 1)))).alias("title"),
        *[_meta(F.col("_metas"), "name", k).alias(v) for k, v in (("description", "description"), ("robots", "robots"), ("viewport", "viewport"), ("generator", "generator"))],
        *[here(i).alias(v) for i, v in enumerate(("twitter_image", "og_image", "og_url"))],
        F.get("_single", F.lit(3)).alias("canonical"),
        *[here(i).alias(v) for i, v in enumerate(("canonical_url", "touch_icon", "icon"), 3)],
        F.regexp_extract("_html", HTML_LANG, 1).alias("lang"),
        F.regexp_extract("_html", CHARSET, 1).alias("charset"),
        F.lower(F.ltrim("_html")).startswith("<!doctype html").alias("doctype"),
        F.transform(F.regexp_extract_all("_markup", F.lit(HEADING_LEVEL), 1), lambda x: x.cast("int")).alias("levels"),
        F.transform(F.regexp_extract_all("_markup", F.lit(HEADING_TEXT), 1), t.plain).alias("headings"),
        full("_links").alias("links"),
        F.transform(F.regexp_extract_all("_markup", F.lit(LINK_TEXT), 1), t.plain).alias("link_texts"),
        full("_scripts").alias("scripts"),
        full("_sheets").alias("stylesheets"),
        F.zip_with(
            F.regexp_extract_all("_head", F.lit(ALTERNATE_CODE), 1), full("_alternates"), lambda code, href: F.struct(code.alias("code"), href.alias("href"))
        ).alias("hreflangs"),
        F.size(images).alias("images"),
        F.size(F.filter(images, lambda x: ~x.rlike(r"(?i)\balt\s*="))).alias("images_without_alt"),
        full("_sources").alias("image_urls"),
        ld.alias("json_ld_blocks"),
        F.size(ld).alias("json_ld"),
        F.size(F.filter(ld, lambda x: F.try_parse_json(x).isNull())).alias("json_ld_invalid"),
        t.plain(F.col("_body")).alias("body_text"),
        F.substring(F.coalesce(F.get(leads, F.lit(0)), F.lit("")), 1, 600).alias("lead_text"),
    )
    # most links begin with the origin as it stands; only others are taken apart
    inner = F.size(F.filter("links", lambda x: F.when(x.startswith(F.concat("origin", F.lit("/"))), F.lit(True)).otherwise(u.origin(x) == F.col("origin"))))
    out = out.withColumn("_schema", schema("json_ld_blocks")).withColumns(
        {
            "schema_types": F.col("_schema.types"),
            "schema_errors": F.col("_schema.wrong"),
            "word_count": F.when(F.col("body_text") == "", 0).otherwise(F.size(F.split("body_text", " "))),
            "h1_count": F.size(F.filter("levels", lambda x: x == 1)),
            "inner_links": inner,
            "outer_links": F.size("links") - inner,
        }
    )
    return out.drop("_schema")


def numbered(pages: DataFrame) -> DataFrame:
    """pages with page_seq, their place in their site by page_id, and label, home for the first and else the path."""
    out = place(pages, ["host"], "page_id", "page_seq")
    return out.withColumn("label", F.when(F.col("page_seq") == 1, F.lit("home")).otherwise(F.col("path")))


def heading_jump(levels: Column) -> Column:
    """Whether the first heading isn't level 1, or a level is skipped on the way down."""
    n = F.size(levels)
    skips = F.exists(F.zip_with(F.slice(levels, 1, F.greatest(n - 1, F.lit(0))), F.slice(levels, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a), lambda d: d > 1)
    return (n > 0) & ((F.get(levels, F.lit(0)) != 1) | skips)
