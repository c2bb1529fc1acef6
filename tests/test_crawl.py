"""Bounded searches against plain queues."""

import random

import pytest

from crawlwright.operators import crawl as c


def queue(start, html, links, limit):
    """The crawler's loop: (place, url, depth, found_on) of what it loads."""
    origin = start.rpartition("/")[0]
    waiting, known, loaded, how = [start], {start}, [], {start: (0, None)}
    while waiting and len(loaded) < limit:
        at = waiting.pop(0)
        if at not in html:
            continue
        loaded.append(at)
        for to in links.get(at, []):
            to = to.partition("#")[0]
            if to.startswith(origin) and not to.endswith(".pdf") and to not in known and len(waiting) + len(loaded) < limit:
                waiting.append(to)
                known.add(to)
                how[to] = (how[at][0] + 1, at)
    return [(n + 1, x, *how[x]) for n, x in enumerate(loaded)]


@pytest.mark.parametrize("limit, share", [(4, 0.7), (15, 0.5), (1000, 0.7)])
def test_crawl(spark, limit, share):
    rng = random.Random(limit)
    html, links, starts = set(), {}, []
    for s in range(4):
        urls = [f"https://s{s}.com/p{k}" for k in range(60)]
        html |= {x for x in urls[1:] if rng.random() < share} | ({urls[0]} if s else set())
        for x in urls:
            links[x] = [y + rng.choice(["", "", "#a"]) for y in rng.choices(urls, k=rng.randrange(9))] + rng.choice([[], ["https://other.com/x", f"https://s{s}.com/a.pdf"]])
        starts.append((f"site{s}", urls[0]))
    pages = spark.createDataFrame([(x, True) for x in html] + [(x, False) for x in links if x not in html][::2] + [(None, True)], "url string, is_html boolean")
    hops = spark.createDataFrame([(x, n, y) for x, ys in links.items() for n, y in enumerate(ys)] + [("https://s1.com/p0", 99, None), (None, 1, "x")], "src string, place int, dst string")
    got = c.crawl(spark, spark.createDataFrame([*starts, ("none", None)], "site string, url string"), pages, hops, limit)
    have = {}
    for r in got.orderBy("site", "place").collect():
        have.setdefault(r.site, []).append((r.place, r.url, r.depth, r.found_on))
    assert have == {s: q for s, x in starts if (q := queue(x, html, links, limit))}


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "site string, url string")
    pages = spark.createDataFrame([], "url string, is_html boolean")
    assert c.crawl(spark, none, pages, spark.createDataFrame([], "src string, place int, dst string"), 5).count() == 0
