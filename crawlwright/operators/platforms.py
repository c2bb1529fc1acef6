"""Which platform a site runs on, whether a local business is named the same everywhere, and tracking links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.functions import urls as u

#: Signs of a platform or plugin in generator names, asset addresses and page addresses.
PLATFORMS = {
    "wordpress": r"wordpress|/wp-content/|/wp-includes/|/wp-json\b",
    "woocommerce": r"woocommerce|wc-ajax=",
    "shopify": r"shopify|\.myshopify\.com",
    "magento": r"magento|/static/frontend/|/media/catalog/product/|mage/",
    "bigcommerce": r"bigcommerce|/stencil/",
    "prestashop": r"prestashop|/modules/ps_",
}
PLUGINS = {"yoast": "yoast", "rankmath": "rank-?math", "aioseo": "aioseo|all-in-one-seo", "seopress": "seopress"}
PRODUCT_PATH = r"/(products?|shop|collections?|catalog|item|sku)/"
CATEGORY_PATH = r"/(collections?|categories|category|shop|catalog)/"
LOCAL_TYPES = ["localbusiness", "restaurant", "store", "dentist", "medicalbusiness", "professionalservice", "legalservice", "financialservice", "realestateagent", "automotivebusiness", "healthandbeautybusiness", "homeandconstructionbusiness", "lodgingbusiness", "foodestablishment"]


def detect(signals: DataFrame, by: str, table: dict[str, str] = PLATFORMS) -> DataFrame:
    """(by, id, matches, confidence) from rows (by, signal): two signals or more make it high. One pass, partial counts."""
    hits = F.array_compact(F.array(*[F.when(F.col("signal").rlike(f"(?i){p}"), F.lit(k)) for k, p in table.items()]))
    g = signals.select(by, F.explode(hits).alias("id")).groupBy(by, "id").agg(F.least(F.count("*"), F.lit(4)).alias("matches"))
    return g.withColumn("confidence", F.when(F.col("matches") >= 2, "high").otherwise("medium"))


def product_like(url: Column) -> Column:
    return F.lower(u.path(url)).rlike(PRODUCT_PATH)


def category_like(url: Column) -> Column:
    return F.lower(u.path(url)).rlike(CATEGORY_PATH)


def plugin_name(asset: Column) -> Column:
    """The readable name of the plugin that an asset address belongs to, or an empty text."""
    return F.translate(F.coalesce(F.try_url_decode(F.regexp_extract(asset, "(?i)/wp-content/plugins/([^/?#]+)", 1)), F.lit("")), "-_", "  ")


def _searchable(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(s, F.lit("&"), F.lit(" and "))), r"[^a-z0-9+]+", " "))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def names_phrase(text: Column, phrase: Column) -> Column:
    p = _searchable(phrase)
    return (p != "") & _searchable(text).contains(p)


def names_phone(text: Column, phone: Column) -> Column:
    """The number's digits, or its last ten, stand in the text's digits; shorter than seven never."""
    d, local = _digits(phone), F.substring(_digits(phone), -10, 10)
    return (F.length(d) >= 7) & (_digits(text).contains(d) | _digits(text).contains(local))


def names_address(text: Column, address: Column) -> Column:
    """The whole address, or five of its longer words (all, if fewer than five, but three at least)."""
    a, t = _searchable(address), _searchable(text)
    words = F.filter(F.split(a, " "), lambda w: F.length(w) > 2)
    found = F.size(F.filter(words, lambda w: t.contains(w)))
    return (a != "") & (t.contains(a) | ((F.size(words) >= 3) & (found >= F.least(F.size(words), F.lit(5)))))


def citations(rows: DataFrame) -> DataFrame:
    """rows (text, name, phone, address of the business) with which of the three the text lacks."""
    lacks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in (("name", names_phrase(F.col("text"), F.col("name"))), ("phone", names_phone(F.col("text"), F.col("phone"))), ("address", names_address(F.col("text"), F.col("address"))))]))
    return rows.withColumn("lacks", lacks)


def utm(url: Column, space: str = "-", **values: Column) -> Column:
    """url with utm parameters set in place of those it had: lower case, blanks as `space`; empty ones are left out."""
    query = F.filter(F.split(F.substring(u.search(url), 2, 1 << 20), "&"), lambda x: (x != "") & ~F.split(x, "=")[0].isin([f"utm_{k}" for k in values]))
    own = [F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"utm_{k}="), F.url_encode(F.regexp_replace(F.lower(F.trim(v)), r"\s+", space)))) for k, v in values.items()]
    all_of = F.concat(query, F.array_compact(F.array(*own)))
    base = F.concat(u.origin(url), u.path(url))
    return F.concat(base, F.when(F.size(all_of) > 0, F.concat(F.lit("?"), F.array_join(all_of, "&"))).otherwise(""), u.part(url, 5))
