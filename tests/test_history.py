"""Issues over reports and proofs, against plain replays and cases by hand."""

import random

from pyspark.sql import functions as F

from crawlwright.operators import history as h
from crawlwright.operators.order import ranked

ISSUE = "id string, type string, title string, page_url string, source string"


def test_history(spark):
    rng = random.Random(5)
    reports = [(s, f"{s}{n}", rng.randrange(1000), rng.randrange(100)) for s in "abc" for n in range(9)] + [("d", "d0", 1, 50)]
    found = [(s, r, rng.choice(["x", "y", "z"]), rng.choice(["critical", "warning", "notice", "good"])) for s, r, *_ in reports for _ in range(rng.randrange(5))]
    found += [("a", "unknown", "x", "notice"), ("a", "a0", None, "notice")]
    numbered = h.numbered_reports(spark.createDataFrame(reports, "site string, report string, at int, score int"), "site")
    findings = spark.createDataFrame(found, "site string, report string, key string, severity string").repartition(3)
    order = {s: sorted((r for r in reports if r[0] == s), key=lambda r: (r[2], r[1])) for s in "abcd"}
    have = {r[1]: {k for _, x, k, sev in found if x == r[1] and k and sev != "good"} for r in reports}
    count = lambda r, sev: sum(x == r and k is not None and y == sev for _, x, k, y in found)
    want = {}
    for s, line in order.items():
        old = set()
        for n, (_, r, _, score) in enumerate(line):
            if not n:
                want[r] = ("first_run", None, None, len(have[r])) + (None,) * 7
            else:
                b = line[n - 1]
                new = have[r] - have[b[1]]
                want[r] = ("ready", b[3], score - b[3], len(have[r]), len(new), len(new & old), len(have[b[1]] - have[r]), len(have[r] & have[b[1]])) + tuple(count(r, x) - count(b[1], x) for x in h.SEVERITIES)
            old |= have[r]
    got = h.report_deltas(numbered, findings, "site")
    assert {r.report: tuple(r)[3:] for r in got.collect()} == want
    worse = {r for r, w in want.items() if w[0] == "ready" and (w[4] > 0 or w[8] > 0 or w[9] > 0) and r[1:] in "0246"}
    watched = numbered.filter(F.substring("report", 2, 1).isin(*"0246"))
    assert {r.report for r in h.regressions(got, watched, "site").collect()} == worse
    assert {(r.site, r.key, r.first): r.fixed for r in h.issue_runs(numbered, findings, "site").collect()}.keys() == {(s, k, n + 1) for s, line in order.items() for n, r in enumerate(line) for k in have[r[1]] if not n or k not in have[line[n - 1][1]]}


def test_tasks_follow_the_findings(spark, monkeypatch):
    monkeypatch.setattr(h, "TASK_ROWS", 10)
    numbered = h.numbered_reports(spark.range(60).selectExpr("nullif(id % 3, 2) as site", "id as report", "id as at", "id % 7 as score"), "site")
    found = spark.range(300).selectExpr("id % 61 as report", "id % 4 as key", "if(id % 5 = 0, 'critical', 'warning') as severity")
    sited = found.join(numbered.select("site", "report"), "report")
    listed = h.report_deltas(numbered, found, "site")
    assert listed.rdd.getNumPartitions() == 30 and h.issue_runs(numbered, found, "site").rdd.getNumPartitions() == 30
    rows = lambda df: sorted(map(str, df.collect()))
    # a report's name tells its site
    assert rows(listed) == rows(h.report_deltas(numbered, sited, "site")) and rows(h.issue_runs(numbered, found, "site")) == rows(h.issue_runs(numbered, sited, "site"))
    assert listed.filter("site is null").agg(F.sum("issues"), F.count("*")).first() == (0, 20) and not h.issue_runs(numbered, found, "site").filter("site is null").count()
    twice = numbered.union(numbered)
    assert rows(h.regressions(listed, twice, "site")) == rows(h.regressions(listed, numbered, "site"))


def test_proofs(spark):
    issue = lambda i, title, page="https://www.E.com/a/?x#y": (i, " Warning", title, page, "crawl")
    issues = [("p1", "fixed", "i1", "warning", "Slow  page", "http://e.com/a", "CRAWL"), ("p1", "current", "i2", None, None, None, None), ("p1", "current", "i3", *issue("", "Title")[1:]), ("p2", "fixed", "i1", *issue("", "Other")[1:])]
    pages = [("p1", "https://e.com/b"), ("p2", "https://e.com/a"), ("p1", None)]
    cases = [
        ("fixed", "p1", issue("zz", "slow page"), "key"),
        ("fixed", "p1", issue("i1", None), "id"),  # an issue without title: the ids decide
        ("fixed", "p2", issue("i1", "slow page"), "page"),  # keys differ, ids don't count; the page was looked at
        ("fixed", "p1", issue("q", "gone", "https://e.com/c"), None),  # not looked at
        ("fixed", "p1", issue("q", "gone", None), "page"),
        ("fixed", "p1", issue("q", "title"), None),  # still there
        ("still_open", "p1", issue("q", "title"), "key"),
        ("new", "p1", issue("i2", "any"), "id"),  # the candidate has no title
        ("regressed", "p1", issue("i3", "any"), None),
        (None, "p1", issue(None, None), None),
        ("fixed", None, issue("q", "gone", None), None),
    ]
    actions = [(n, proof, state, *i) for n, (state, proof, i, _) in enumerate(cases)]
    got = h.proved(spark.createDataFrame([*actions, actions[0]], f"action int, proof string, state string, {ISSUE}"), spark.createDataFrame(issues, f"proof string, origin string, {ISSUE}"), spark.createDataFrame(pages, "proof string, url string"))
    assert sorted(map(tuple, got.collect())) == [(n, c[3], c[3] is not None) for n, c in enumerate(cases)]


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), n) for n in range(500)]
    got = ranked(spark.createDataFrame(rows, "a int, b int").repartition(7), [F.desc_nulls_first("a"), "b"], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 501))
    assert ranked(spark.createDataFrame([], "a int, b int"), ["a"], "n").count() == 0
