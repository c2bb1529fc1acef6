"""Answers of reports, on cases by hand."""

import duckdb
from pyspark.sql import functions as F

from crawlwright import catalog
from crawlwright.operators import answers as a
from crawlwright.queries import answers as q


def test_fix_groups(spark):
    rows = [("s", n, f"Thin on /p{n}", "Thin", "warning", f"https://s.com/p{n}") for n in range(2, 5000)]
    rows += [("s", 1, "Alone on home", "Alone", "critical", None), ("s", 6000, "Late on home", "Late", "notice", "x"), ("t", 1, "One on /a", "One", "notice", " https://t.com/a ")]
    plan = spark.createDataFrame(rows, "site string, priority int, title string, pattern_key string, severity string, page string").repartition(4)
    got = [tuple(r) for r in a.fix_groups(plan, "site", 2).orderBy("site", "nth").collect()]
    listed = ", ".join(f"https://s.com/p{n}" for n in range(2, 99))[:599] + "…"
    assert got == [("s", 1, "Alone on home", "", 1, "critical"), ("s", 2, "Thin (4998 pages)", listed, 4998, "warning"), ("t", 1, "One on /a", "https://t.com/a", 1, "notice")]


def test_selection_and_board(spark):
    items = [("a", 1, "q1", "i1", "x", "Fixed "), ("a", 2, "q2", "i2", "y", "open"), ("a", 3, "q3", "i2", "z", None), ("a", 0, None, "i9", "no id", "open"), ("b", 1, "q1", "i1", "x", "ignored")]
    asked = {"a": (None, None), "b": (None, ""), "c": ("q1", None)}
    df = spark.createDataFrame(items, "who string, place int, queue_id string, issue_id string, title string, status string")
    ask = lambda rows: {r[0]: tuple(r)[1:] for r in a.selected_repair(df, spark.createDataFrame(rows, "who string, queue_id string, issue_id string"), "who").collect()}
    assert ask([(k, *v) for k, v in asked.items()]) == {"a": ("q2", "i2", "y", False), "b": (None, None, None, False), "c": (None, None, None, True)}
    assert ask([("a", None, "i2")])["a"] == ("q2", "i2", "y", False)
    assert ask([("a", "q3", "i2")])["a"] == ("q3", "i2", "z", False)
    assert ask([("a", "q1", None)])["a"] == (None, None, None, True)  # fixed already
    assert ask([("a", "q2", "i1")])["a"] == (None, None, None, True)
    queue = spark.createDataFrame([("a", "i1"), ("a", "i2"), ("a", None)], "who string, issue_id string")
    issues = spark.createDataFrame([("a", "i1", 1, "m", "n1", "s"), ("a", "i1", 2, None, "n2", "t"), ("b", "i2", 1, "m", "n", "s")], "who string, issue_id string, seq int, assignee string, note string, status string")
    assert sorted(map(tuple, a.with_collaboration(queue, issues, "who").collect()), key=str) == sorted([("a", "i1", "", "n2", "t"), ("a", "i2", "", "", ""), ("a", None, "", "", "")], key=str)


def test_blocking_and_status(spark):
    cases = [("BLOCKING", "image", 9e9, None, True), ("non-blocking", "script", 0.0, None, False), (None, "script", 1500.0, 0.0, True), ("", "stylesheet", 1501.0, None, False), ("", "stylesheet", 1501.0, 2000.0, True), (None, "image", 1.0, 2.0, False), (None, None, None, None, False)]
    df = spark.createDataFrame(cases, "status string, kind string, start double, loaded double, want boolean")
    assert df.filter(a.render_blocking(F.col("status"), F.col("kind"), F.col("start"), F.col("loaded")) != F.col("want")).count() == 0
    jobs = spark.createDataFrame([("completed", "2024-01-01"), ("completed", None), ("failed", "2025-01-01")], "status string, completed_at string")
    parts = lambda *ok: spark.createDataFrame([(str(n), x) for n, x in enumerate(ok)], "part string, ok boolean")
    assert tuple(a.service_status(parts(True, True), jobs).first()) == ("operational", "All systems working", 0, "2024-01-01")
    assert tuple(a.service_status(parts(True, None), jobs.limit(0)).first()) == ("degraded", "1 part not working", 1, None)
    assert tuple(a.service_status(parts(False, None), jobs).first())[1:3] == ("2 parts not working", 2)


def test_selection_of_one_place(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "q1", "i2", "x", "open"), ("a", 1, "q1", "i1", "z", "open"), ("a", 1, "q1", "i1", "y", "open")], "who string, place int, queue_id string, issue_id string, title string, status string")
    asked = spark.createDataFrame([("a", None, None)], "who string, queue_id string, issue_id string")
    for rows in (df.orderBy("title"), df.orderBy(F.desc("title"))):
        assert tuple(a.selected_repair(rows.coalesce(1), asked, "who").first()) == ("a", "q1", "i1", "y", False)
    # lines with one number come in the table's order, as the SQL meets them on one thread, though the second file is the larger one and read first
    con = duckdb.connect()
    con.sql("set threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for part, n in enumerate((300, 9000)):
        con.sql(f"copy (select i % 300 as l_orderkey, 2 as l_linenumber, (i * 7 + {part}) % 999 as l_partkey from range({n}) r(i)) to '{tmp_path}/lineitem.parquet/part-{part}.parquet'")
    con.sql(f"copy (select i as o_orderkey, i * 4 as o_custkey from range(300) r(i)) to '{tmp_path}/orders.parquet'")
    con.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    con.sql(f"create view orders as from '{tmp_path}/orders.parquet'")
    got = q.fix_pack_selection(spark, str(tmp_path)).select("account", "queue_id", "issue_id", "title", "conflict").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLE_SQL["fix_pack_selection"]).fetchall())
