import time

import pytest
from pyspark.sql import functions as F

from crawlwright.functions import text as t
from crawlwright.functions import urls as u
from crawlwright.operators import folds, history, tables
from crawlwright.plans import facts, rules, score
from crawlwright.sources import robots


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(fn(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    "href, base, want",
    [
        ("/a", "https://x.com/b/c", "https://x.com/a"),
        ("d", "https://x.com/b/c", "https://x.com/b/d"),
        ("../d", "https://x.com/b/c/e", "https://x.com/b/d"),
        ("//y.com/z", "http://x.com/", "http://y.com/z"),
        ("?q=1", "https://x.com/b/c?z", "https://x.com/b/c?q=1"),
        ("#top", "https://x.com/b", "https://x.com/b#top"),
        ("mailto:a@b.c", "https://x.com/", "mailto:a@b.c"),
        ("https://z.com/q", "https://x.com/", "https://z.com/q"),
    ],
)
def test_absolute(spark, href, base, want):
    assert one(spark, u.absolute, href, base) == want
    row = spark.createDataFrame([(href, base)], "href string, url string").withColumns({k: F.expr(v) for k, v in u.BASE.items()})
    assert row.select(F.expr(u.against("href"))).first()[0] == want


@pytest.mark.parametrize(
    "fn, url, want",
    [
        (u.strip_hash, "https://x.com/a/#b", "https://x.com/a"),
        (u.strip_hash, "https://x.com/", "https://x.com/"),
        (u.page_key, "http://WWW.x.com:80/a/?q=1", "x.com/a"),
        (u.graph_key, "https://www.x.com/a//?q=1#z", "https://x.com/a?q=1"),
        (u.https_key, "http://x.com/", "https://x.com/"),
        (u.sorted_key, "https://x.com/a?b=2&a=1#f", "https://x.com/a?a=1&b=2"),
        (u.parameter_risk, "https://x.com/a?utm_source=b", True),
        (u.parameter_risk, "https://x.com/a?id=b", False),
        (u.faceted, "https://x.com/a?pa_size=b", True),
        (u.likely_html, "https://x.com/a.pdf", False),
    ],
)
def test_urls(spark, fn, url, want):
    assert one(spark, fn, url) == want


@pytest.mark.parametrize("host, want", [("localhost", True), ("10.1.2.3", True), ("172.20.0.1", True), ("172.32.0.1", False), ("x.com", False), ("a.internal", True), ("[::1]", True), ("8.8.8.8", False)])
def test_private_host(spark, host, want):
    assert one(spark, u.private_host, host) is want


@pytest.mark.parametrize(
    "title, want",
    [
        ("Missing H1 on home", "Missing H1"),
        ("Missing H1 on /about", "Missing H1"),
        ("Missing H1 on /", "Missing H1 on /"),
        ("Heading hierarchy needs cleanup on home", "Heading hierarchy needs cleanup"),
        ("Plain", "Plain"),
    ],
)
def test_pattern_key(spark, title, want):
    assert one(spark, t.pattern_key, title) == want


def test_text(spark):
    assert one(spark, t.decode, "&amp;lt;b&gt; &quot;x&quot; &#39;") == "<b> \"x\" '"
    assert one(spark, t.normal, "A &amp; B—c  9") == "a b c 9"
    assert one(spark, t.primary_keyword, "The Best Red Shoes for Running Fast Today") == "red shoes running"
    assert one(spark, t.primary_keyword, "Shoes") == ""
    assert one(spark, t.csv_cell, "=1+1") == "'=1+1"
    assert one(spark, t.csv_cell, 'a"b,c') == '"a""b,c"'
    assert one(spark, t.slug, "Hello, World!") == "hello-world"
    assert one(spark, lambda c: t.words(c), "It’s well-known, 2 times") == ["it's", "well-known", "2", "times"]


PAGE = """<!doctype html><html lang='en'><head><title>A &amp; B shop of many things</title>
<meta name="description" content="short"><link rel="canonical" href="/x"><meta charset="utf-8">
<script type="application/ld+json">{"@type": "Product"}</script><script type="application/ld+json">{bad</script></head>
<body><h2>First</h2><h4>Jump</h4><script>var t="<h1>no</h1>"</script><noscript>hidden words</noscript>
<p>one two three</p><img src=a><img src=b alt=""><a href="/in">In</a><a href="https://other.org/">Out</a></body></html>"""


def test_facts_and_rules(spark):
    pages = spark.createDataFrame([(1, "https://www.x.com/p", PAGE), (2, "http://x.com/q", None)], "page_id long, url string, html string")
    f = facts.facts(pages)
    a, b = f.orderBy("page_id").collect()
    assert (a.title, a.description, a.canonical, a.lang, a.charset, a.doctype) == ("A & B shop of many things", "short", "/x", "en", "utf-8", True)
    assert (a.levels, a.h1_count, a.images, a.images_without_alt) == ([2, 4], 0, 2, 1)
    assert (a.json_ld, a.json_ld_invalid, a.inner_links, a.outer_links) == (2, 1, 1, 1)
    assert (a.page_seq, a.label, b.page_seq, b.label, b.word_count) == (1, "home", 2, "/q", 0)
    fired = {(r.page_id, r.rule_seq) for r in rules.findings(f).collect()}
    assert {s for p, s in fired if p == 1} == {31, 43, 44, 46, 47, 50, 56, 58, 60}
    assert {s for p, s in fired if p == 2} == {40, 42, 44, 47, 48, 49, 50, 51, 52, 53, 56, 58, 61, 62}


@pytest.mark.parametrize("counts, want", [({"critical": 1}, 88), ({"critical": 2}, 84), ({"critical": 9}, 72), ({"warning": 2, "notice": 3}, 92), ({}, 100)])
def test_score(spark, counts, want):
    rows = [("h", s, "k") for s, n in counts.items() for _ in range(n)]
    f = spark.createDataFrame(rows, "host string, severity string, pattern_key string")
    got = score.scores(f, spark.createDataFrame([("h",)], "host string"), "host").first()
    assert got.score == want


def test_robots(spark):
    files = spark.createDataFrame([("s", "User-agent: a\nUser-agent: bb # two\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /z$\nDisallow:\n")], "site string, text string")
    asked = spark.createDataFrame([("s", a, p) for a, p in (("A", "/x"), ("bb", "/x/y/1"), ("c", "/z"), ("c", "/zz"), ("c", "/x"))], "site string, agent string, path string")
    got = {(r.agent, r.path): r.allowed for r in robots.verdicts(robots.parse(files), asked).collect()}
    assert got == {("A", "/x"): False, ("bb", "/x/y/1"): True, ("c", "/z"): False, ("c", "/zz"): True, ("c", "/x"): True}


def test_upserts_and_transitions(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v long, s string")
    incoming = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("c", 2, "q")], "k string, v long, s string")
    assert {tuple(r) for r in tables.upsert(stored, incoming, ["k"], ["v"]).collect()} == {("a", 2, "z"), ("b", 1, "y"), ("c", 2, "q")}
    assert {tuple(r) for r in tables.insert_or_ignore(stored, incoming, ["k"], ["v"]).select("k", "v", "s").collect()} == {("c", 1, "w")}
    v = spark.createDataFrame([("i", 1, "draft"), ("i", 2, "approved"), ("i", 3, "done"), ("i", 4, "verified")], "k string, n long, st string")
    may_follow = {"draft": ["approved"], "approved": ["executing"], "executing": ["done"], "done": ["verified"]}
    assert [r.st for r in folds.invalid_transitions(v, "k", "n", "st", may_follow).collect()] == ["done"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://e.com/a/../b", "https://e.com/b"),
        ("https://e.com/a b", "https://e.com/a%20b"),
        ("https://e.com/a/./b/..", "https://e.com/a/"),
        ("https://e.com/../../x/.", "https://e.com/x/"),
        ("https://e.com/a/%2E%2e/b", "https://e.com/b"),
        ("https://e.com/für/日?q=ä 'x'#z", "https://e.com/f%C3%BCr/%E6%97%A5?q=%C3%A4%20%27x%27"),
        ("https://e.com/a%20b/{x}", "https://e.com/a%20b/%7Bx%7D"),
        ("https://e.com/a...b/.c/..d", "https://e.com/a...b/.c/..d"),
        ("https://e.com/x\\n/a\tb", "https://e.com/x/n/ab"),
        ("https://e.com//a//", "https://e.com//a//"),
        ("https://e.com/a+b?c+d", "https://e.com/a+b?c+d"),
    ],
)
def test_normalized_paths(spark, url, want):
    assert one(spark, u.normalize_url, url) == want
    assert one(spark, u.http_url, url) == want


def test_description_of_a_text_without_marks(spark):
    """Sentences are looked for from where one may begin, not from each character."""
    text = spark.range(1).select(F.repeat(F.lit("word "), 40_000).alias("s"))
    began = time.monotonic()
    assert text.select(t.suggested_description(F.col("s")).alias("d")).first().d == "word " * 29 + "word…"
    assert time.monotonic() - began < 30
    some = spark.createDataFrame([("One. Two x.y three! " + "z" * 200,)], "s string")
    assert some.select(t.suggested_description(F.col("s"), enough=10).alias("d")).first().d == "One. y three!"


def test_address_is_looked_up_once(spark):
    """Most addresses are in their usual form; odd ones take the whole way. Parts of an address aren't taken apart once more for each use."""
    plain = lambda c: spark.createDataFrame([], "url string").select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    cases = {"x.com": "https://x.com/", "http://x.com/a/..b?c=/../d": "http://x.com/a/..b?c=/../d", "https://x.com/a/../b": "https://x.com/b", "https://x.com/%2E/b": "https://x.com/b", "x.com\n": "https://x.com/", "HTTPS://X.com:443/a b": "https://x.com/a%20b", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "url string").select("url", u.http_url(F.col("url")).alias("x")).collect()
    assert {r.url: r.x for r in got} == cases
    assert plain(u.site(F.col("url"))).count("regexp_replace") == 1
    assert plain(history.proof_url(F.col("url"))).count("www") == 1
