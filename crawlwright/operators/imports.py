"""Imports: texts of rows that people paste, as tables of keywords, backlinks, citations and competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.functions import urls as u
from crawlwright.shared import save

#: How many rows of an import count (the first valid ones), and by which names a column may come.
KEYWORD_ROWS, BACKLINK_ROWS, CITATION_ROWS, COMPETITORS = 250, 100, 30, 5
KEYWORD_COLUMNS = {
    "query": ["query", "keyword", "searchterm", "term", "topqueries"],
    "page_url": ["pageurl", "page", "url", "landingpage", "destination"],
    "clicks": ["clicks", "currentclicks"],
    "impressions": ["impressions", "currentimpressions"],
    "ctr": ["ctr", "currentctr"],
    "position": ["position", "avgposition", "averageposition"],
    "previous_clicks": ["previousclicks", "clicksprevious"],
    "previous_impressions": ["previousimpressions", "impressionsprevious"],
    "previous_ctr": ["previousctr"],
    "previous_position": ["previousposition", "positionprevious"],
}
BACKLINK_COLUMNS = {
    "source_url": ["sourceurl", "source", "url", "referringpage"],
    "target_url": ["targeturl", "target", "linktarget"],
    "anchor_text": ["anchortext", "anchor", "text"],
    "status_hint": ["status", "linkstatus"],
    "first_seen": ["firstseen"],
    "last_seen": ["lastseen"],
}
CITATION_COLUMNS = {"source_url": ["sourceurl", "source", "url", "citationurl"], "name": ["name", "businessname"], "phone": ["phone", "telephone"], "address": ["address", "streetaddress"]}
#: Columns that a pasted row has at most.
WIDTH = 24


def cells(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, pos, cells) of pasted texts: lines after the first, by the names in the first, which are told apart by their letters and
    digits alone. Tabs separate where the first line has one, else commas; quoted cells may hold either and doubled quotes.
    Empty lines are left out. A null text has no line."""
    schema = ", ".join(f"c{i} string" for i in range(WIDTH))
    lines = texts.select(by, F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != "").alias("_l")).filter(F.size("_l") > 1)

    def split(rows: DataFrame, sep: str) -> DataFrame:
        """Each line is parsed once, the first one once a text."""
        parsed = lambda rows, line: rows.withColumn("_c", F.from_csv(line, schema, {"sep": sep, "quote": '"', "escape": '"'}))
        row = F.transform(F.array(*[F.col(f"_c.c{i}") for i in range(WIDTH)]), lambda x: F.trim(F.coalesce(x, F.lit(""))))
        names = F.transform(row, lambda x, i: F.concat(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), F.when(x == "", F.concat(F.lit("#"), i.cast("string"))).otherwise("")))
        headed = parsed(rows, F.get("_l", F.lit(0))).select(by, "_l", names.alias("_h"))
        headed = headed.withColumn("_h", F.transform("_h", lambda x, i: F.when(F.array_position("_h", x) == i + 1, x).otherwise(F.concat(x, F.lit("#"), i.cast("string")))))
        each = parsed(headed.select(by, "_h", F.posexplode(F.slice("_l", 2, 1 << 20)).alias("pos", "_line")), F.col("_line"))
        return each.select(by, F.col("pos").cast("long").alias("pos"), F.map_from_arrays("_h", row).alias("cells"))

    tabbed = F.get("_l", F.lit(0)).contains("\t")
    # written, as filters on what is read from a cell would otherwise parse the line again for each cell
    return save(split(lines.filter(tabbed), "\t").unionByName(split(lines.filter(~tabbed), ",")), "cells")


def _named(rows: DataFrame, columns: dict[str, list[str]], *others: Column | str) -> DataFrame:
    """rows' others and each column by the first of its names that has a value. All are looked up by one expression: one for each name makes a
    function so long that the JVM doesn't compile it."""
    names = F.array(*[F.array(*map(F.lit, n)) for n in columns.values()])
    value = lambda n: F.try_element_at("cells", n)
    first = lambda some: F.coalesce(F.get(F.filter(F.transform(some, value), lambda x: x != ""), F.lit(0)), F.lit(""))
    found = rows.select(*others, F.transform(names, first).alias("_v"))
    kept = [c for c in found.columns if c != "_v"]
    return found.select(*kept, *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def _first(rows: DataFrame, by: str, key: list[str], most: int) -> DataFrame:
    """The first row of each key in an import, of these the first `most`, numbered."""
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(by, *key).orderBy("pos"))).filter("_n = 1")
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy("pos"))).filter(F.col("nth") <= most).drop("_n", "pos")


def number(c: Column) -> Column:
    """A number out of text with thousands marks or a percent sign; 0 where there is none."""
    n = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[,%]", "")).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def fractional(c: Column) -> Column:
    """Whether a click rate speaks for an import in shares: a value between 0 and 1 without a percent sign."""
    return F.coalesce(~c.contains("%") & (number(c) > 0) & (number(c) < 1), F.lit(False))


def rate(c: Column, clicks: Column, impressions: Column, shares: Column) -> Column:
    """A click rate as a share: percents are divided; 1 is all or 1 % by whether its import is in shares; without a value it is
    clicks by impressions."""
    n = number(c)
    given = F.when(c.contains("%") | (n > 1), n / 100).when(n == 1, F.when(shares, 1.0).otherwise(0.01)).otherwise(n)
    return F.when(F.coalesce(c, F.lit("")) != "", given).otherwise(F.when(impressions > 0, clicks / impressions).otherwise(0.0))


def keywords(rows: DataFrame, by: str, most: int = KEYWORD_ROWS) -> DataFrame:
    """(by, nth, query, query_key, page_url, clicks ... previous_position) from cells(): rows with a query, the first of each query
    and page. Whether rates are shares is decided for each import by itself."""
    raw = _named(rows, KEYWORD_COLUMNS, by, "pos")
    # written, as it is read twice, and as the filter would otherwise look the columns up once more
    raw = save(raw.withColumn("query", t.clean(F.col("query"), 180)), "named").filter("query <> ''")
    flags = raw.groupBy(by).agg(F.max(fractional(F.col("ctr")) | fractional(F.col("previous_ctr"))).alias("_shares"))
    out = raw.withColumns({"page_url": u.http_url(F.col("page_url")), "query_key": F.substring(t.search_text(F.col("query")), 1, 180)})
    out = _first(out, by, ["query_key", "page_url"], most).join(flags, by)
    n = {c: number(F.col(c)) for c in ("clicks", "impressions", "position", "previous_clicks", "previous_impressions", "previous_position")}
    ctr, before = rate(F.col("ctr"), n["clicks"], n["impressions"], F.col("_shares")), rate(F.col("previous_ctr"), n["previous_clicks"], n["previous_impressions"], F.col("_shares"))
    return out.select(by, "nth", "query", "query_key", "page_url", n["clicks"].alias("clicks"), n["impressions"].alias("impressions"), ctr.alias("ctr"), n["position"].alias("position"), n["previous_clicks"].alias("previous_clicks"), n["previous_impressions"].alias("previous_impressions"), before.alias("previous_ctr"), n["previous_position"].alias("previous_position"))


def backlinks(rows: DataFrame, by: str, home: Column, most: int = BACKLINK_ROWS) -> DataFrame:
    """(by, nth, source_url, target_url, anchor_text, status_hint, first_seen, last_seen): rows with a source, once for each source and
    target; a row without a target points at `home`."""
    raw = _named(rows, BACKLINK_COLUMNS, by, "pos", home.alias("_home"))
    raw = raw.withColumns({"source_url": u.http_url(F.col("source_url")), "target_url": u.http_url(F.when(F.col("target_url") == "", F.col("_home")).otherwise(F.col("target_url"))), "anchor_text": t.clean(F.col("anchor_text"), 160)})
    return _first(raw.filter("source_url <> '' and target_url <> ''").drop("_home"), by, ["source_url", "target_url"], most)


def citations(rows: DataFrame, by: str, most: int = CITATION_ROWS) -> DataFrame:
    """(by, nth, source_url, name, phone, address): rows with a source, once for each source."""
    raw = _named(rows, CITATION_COLUMNS, by, "pos")
    raw = raw.withColumn("source_url", u.http_url(F.col("source_url"))).filter("source_url <> ''")
    return _first(raw, by, ["source_url"], most)


def competitors(sites: DataFrame, by: str, own: str, text: str, most: int = COMPETITORS) -> DataFrame:
    """(by, nth, url) of what a list names, split at commas and line ends: addresses of other hosts, one a host, the first `most`.
    What isn't a public address is left out."""
    rows = sites.select(by, u.site(u.http_url(F.col(own))).alias("_own"), F.posexplode(F.split(text, r"[\n,]+")).alias("pos", "_x"))
    rows = rows.select(by, "_own", "pos", u.normalize_url(F.col("_x")).alias("url")).filter("url is not null")
    rows = rows.filter(u.auditable(F.col("url"))).withColumn("_host", u.site(F.col("url"))).filter("_host <> _own")
    return _first(rows, by, ["_host"], most).select(by, "nth", "url")
