"""Sitemap inventories against a plain queue."""

import random

import pytest

from crawlwright.operators import inventory as coverage
from crawlwright.sources.inventory import inventory


def plain(seeds, files, max_files, max_urls):
    """(site's sums, addresses, files, warnings) of a queue of files."""
    host = lambda x: x.split("/")[2].removeprefix("www.")
    own, queue, seen, urls, read, said, off, cut = host(seeds[0]), list(seeds), set(), [], [], [], 0, False
    while queue and len(seen) < max_files and len(urls) < max_urls:
        at = queue.pop(0)
        if at in seen:
            continue
        if host(at) != own:
            said.append(f"Skipped off-host sitemap {at}.")
            continue
        seen.add(at)
        kids, locs, status = files.get(at, ([], [], None))
        read.append((len(read) + 1, at, status == 200))
        if status != 200:
            said.append(f"{at} returned {status or 'no response'}.")
            continue
        for x in kids:
            if len(seen) + len(queue) >= max_files:
                cut = True
                break
            if host(x) == own:
                queue.append(x)
            else:
                off += 1
                said.append(f"Skipped off-host child sitemap {x}.")
        for x in locs:
            if len(urls) >= max_urls:
                cut = True
                break
            if host(x) != own:
                off += 1
                said.append(f"Skipped off-host URL {x}.")
            elif x not in urls:
                urls.append(x)
    cut = cut or bool(queue) or len(seen) >= max_files
    return (len(urls), len(read), off, cut), urls, read, list(dict.fromkeys(said))[:20]


@pytest.mark.parametrize("max_files, max_urls", [(9, 30), (1000, 17)])
def test_inventory(spark, max_files, max_urls):
    rng = random.Random(max_files + max_urls)
    files, seeds = {}, {}
    for s in range(3):
        names = [f"https://s{s}.com/m{k}.xml" for k in range(14)]
        for k, x in enumerate(names):
            kids = rng.sample(names, rng.choice([0, 1, 2, 3])) + rng.choice([[], [f"https://s9.com/m{k}.xml"]])
            locs = [rng.choice([f"https://s{s}.com/p{rng.randrange(25)}"] * 5 + [f"https://o.com/{k}"]) for _ in range(rng.randrange(9))]
            rng.shuffle(kids)
            files[x] = (kids, locs, rng.choice([200, 200, 200, 200, 503]) if k else 200)
        seeds[s] = [names[0], f"https://www.s{s}.com/none.xml", "https://s8.com/m0.xml", names[0], names[3]][: 5 - 3 * (s == 2)]
    entry = lambda kind, x: f"<{kind}><loc>{x}</loc></{kind}>"
    rows = [(x, status == 200, status, "".join([entry("sitemap", y) for y in kids] + [entry("url", y) for y in locs])) for x, (kids, locs, status) in files.items()]
    given = spark.createDataFrame([*rows, rows[0], (None, True, 200, "x")], "url string, ok boolean, status int, xml string").repartition(3)
    queue = [(s, f"https://www.s{s}.com/", n, x) for s, xs in seeds.items() for n, x in enumerate(xs)] + [(7, "https://s7.com/", 0, None)]
    got = inventory(spark, spark.createDataFrame(queue, "site long, start string, place int, url string"), given, max_files, max_urls)
    want = {s: plain(xs, files, max_files, max_urls) for s, xs in seeds.items()}
    have = {r.site: (r.urls_discovered, r.sitemaps_fetched, r.off_host_ignored, r.truncated) for r in got.sites.collect()}
    assert have == {s: w[0] for s, w in want.items()} | {7: (0, 0, 0, False)}
    listed = lambda df, *c: {s: [tuple(r[x] for x in c) if len(c) > 1 else r[c[0]] for r in sorted(rows, key=lambda r: r[1])] for s in seeds for rows in [[r for r in df.collect() if r.site == s]]}
    assert listed(got.urls, "url") == {s: w[1] for s, w in want.items()}
    assert listed(got.files, "place", "url", "ok") == {s: w[2] for s, w in want.items()}
    assert listed(got.warnings, "warning") == {s: w[3] for s, w in want.items()}


def test_inventory_of_nothing(spark):
    got = inventory(spark, spark.createDataFrame([], "site long, start string, place int, url string"), spark.createDataFrame([], "url string, ok boolean, status int, xml string"))
    assert got.sites.count() == got.urls.count() == got.files.count() == got.warnings.count() == 0


def test_addresses_that_differ_by_a_slash_are_one(spark):
    listed = spark.createDataFrame([("x.com", "https://x.com/a"), ("x.com", "https://x.com/a/"), ("x.com", "https://x.com/a#b"), ("x.com", "https://y.com/")], "host string, loc string")
    pages = spark.createDataFrame([("x.com", "https://x.com/a/")], "host string, url string")
    got = coverage.inventory(listed, pages, "host").first()
    assert (got.discovered, got.covered, got.uncrawled, got.off_host) == (1, 1, 0, 1)


def test_only_files_that_queues_reach_are_taken_apart(spark, monkeypatch):
    from crawlwright.sources import inventory as inv

    read, entries = [], inv.entries
    monkeypatch.setattr(inv, "entries", lambda rows, place: (read.extend(r.url for r in rows.select("url").collect()), entries(rows, place))[1])
    xml = "<sitemap><loc>https://a.com/2.xml</loc></sitemap><url><loc>https://a.com/p</loc></url>"
    files = spark.createDataFrame([(f"https://a.com/{n}.xml", True, 200, xml) for n in range(1, 40)], "url string, ok boolean, status int, xml string")
    seeds = spark.createDataFrame([("a", "https://a.com", 0, "https://a.com/1.xml")], "site string, start string, place int, url string")
    out = inv.inventory(spark, seeds, files)
    assert tuple(out.sites.select("urls_discovered", "sitemaps_fetched", "truncated").first()) == (1, 2, False)
    assert set(read) == {"https://a.com/1.xml", "https://a.com/2.xml"}  # before, all 39
