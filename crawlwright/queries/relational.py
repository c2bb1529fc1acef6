"""Queries over star-schema and event tables: joins, aggregates, windows, set operations, folds and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.operators import folds, graph
from crawlwright.operators import tables as ops
from crawlwright.operators.order import ranked
from crawlwright.registry import query, table
from crawlwright.shared import save

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- events -----------------------------------------------------------------------------------------------

STEPS = ["view", "click", "signup", "purchase"]
_STEPS_SQL = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(STEPS)) + ") s(step_seq, step)"


@query(f"SELECT CAST(step_seq AS BIGINT) AS step_seq, step, count(e.event_id) AS n, CASE WHEN first_value(count(e.event_id)) OVER (ORDER BY step_seq) = 0 THEN 0.0 ELSE floor(count(e.event_id) * 1000.0 / first_value(count(e.event_id)) OVER (ORDER BY step_seq) + 0.5) / 10 END::DOUBLE AS percent FROM {_STEPS_SQL} LEFT JOIN events e ON e.event_type = s.step GROUP BY step_seq, step")
def funnel_conversion(spark, sf_dir):
    return ops.funnel(table(spark, sf_dir, "events"), "event_type", STEPS).select("step_seq", "step", "n", "percent")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 0 THEN user_id END) AS valued FROM events GROUP BY event_type")
def funnel_uniques(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 0, F.col("user_id"))).alias("valued"))


@query(f"WITH n AS (SELECT event_id, user_id, date_trunc('hour', ts) AS bucket, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM events) SELECT user_id, {_TS.format('bucket')} AS bucket, count(*) AS requests, count(*) FILTER (nth <= 2) AS allowed, count(*) FILTER (nth > 2) AS refused FROM n GROUP BY ALL")
def hourly_quota(spark, sf_dir):
    return folds.fixed_window_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2).withColumn("bucket", _ts("bucket"))


@query(f"""WITH g AS (SELECT *, event_type = 'error' AS fail, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events),
i AS (SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS fails FROM g WHERE fail GROUP BY user_id, island)
SELECT user_id, {_TS.format('since')} AS since, {_TS.format('until')} AS until, fails FROM i WHERE fails >= 2""")
def uptime_islands(spark, sf_dir):
    out = folds.outages(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 2)
    return out.select("user_id", _ts("since").alias("since"), _ts("until").alias("until"), "fails")


@query(f"""WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id, {_TS.format('min(ts)')} AS session_start, {_TS.format('max(ts)')} AS last_event, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions_30m(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes"))
    return e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).select("user_id", _ts("a").alias("session_start"), _ts("b").alias("last_event"), "n")


@query(f"SELECT {_TS.format('time_bucket(INTERVAL 6 HOUR, ts)')} AS bucket, event_type, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(_ts("w.start").alias("bucket"), "event_type", "n", "total")


@query(f"SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, {_TS.format('max(ts)')} AS ts FROM events GROUP BY user_id")
def latest_event_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return e.select("user_id", F.col("m.event_id").alias("event_id"), _ts("m.ts").alias("ts"))


@query("WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS view_id FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY p.event_id")
def prev_event_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ops.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts"), "user_id", "ts", "event_id", "view_id")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def props_json(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failures FROM events GROUP BY user_id) SELECT user_id, failures, CASE WHEN failures >= 3 THEN 'dead' WHEN failures > 0 THEN 'retry' ELSE 'ok' END AS state FROM f")
def retry_dead_letter(spark, sf_dir):
    return folds.retry_state(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", 3)


@query("""WITH e AS (SELECT event_id % 997 AS id, event_type || ':' || CAST(user_id AS VARCHAR) AS body, event_id AS seq FROM events),
f AS (SELECT id, arg_min(body, seq) AS body, count(*) AS received FROM e GROUP BY id)
SELECT f.id, f.received, count(*) FILTER (e.body = f.body) - 1 AS duplicates, count(*) FILTER (e.body <> f.body) AS conflicts FROM f JOIN e ON e.id = f.id GROUP BY ALL""")
def webhook_idempotency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("id"), F.concat_ws(":", "event_type", "user_id").alias("body"), F.col("event_id").alias("seq"))
    return folds.idempotency(e, "id", "body", "seq")


@query("""WITH o AS (SELECT user_id, event_id, ts, event_type, value FROM events),
r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM o WHERE event_type IN ('purchase', 'error'))
SELECT user_id, CAST(round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) * 100) AS BIGINT) AS paid_cents, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_type, n) AS last FROM r GROUP BY user_id""")
def payment_fold(spark, sf_dir):
    return folds.payments(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


# --- orders, customers, lineitem ------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995)
SELECT coalesce(c.k, p.k) AS custkey, CASE WHEN p.k IS NULL THEN 'new' WHEN c.k IS NULL THEN 'fixed' ELSE 'persistent' END AS status FROM c FULL JOIN p ON c.k = p.k""")
def report_delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda y: o.filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("custkey")).distinct()
    return ops.delta(side(1996), side(1995), ["custkey"])


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND c_acctbal > 0")
def nudge_candidates(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.filter("c_acctbal > 0").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_orderkey IS NOT NULL UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IS NOT NULL)")
def retention_filter(spark, sf_dir):
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    keep = items.filter("l_quantity > 45").select(F.col("l_orderkey").alias("k")).union(o.filter("o_orderstatus = 'P'").select("o_orderkey")).filter("k is not null").distinct()
    old = o.filter(F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz"))
    return old.join(keep, F.col("o_orderkey") == F.col("k"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS has_closed FROM customer c")
def exists_flag(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return ops.exists_flag(c, o.filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey", "has_closed").select("c_custkey", "has_closed")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def exists_or_exists(spark, sf_dir):
    c, o, n = (table(spark, sf_dir, x) for x in ("customer", "orders", "nation"))
    a = c.join(o.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
    b = c.join(n.filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    return a.union(b).distinct()


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY o_orderpriority")
def status_pivot(spark, sf_dir):
    c = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s.lower())
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(c("F"), c("O"), c("P"), F.count("*").alias("total"))


@query("SELECT l_suppkey, floor(CAST(sum(l_extendedprice * greatest(l_quantity, 1)) / sum(greatest(l_quantity, 1)) AS DOUBLE) * 100 + 0.5) / 100 AS weighted FROM lineitem GROUP BY l_suppkey")
def weighted_position(spark, sf_dir):
    w = F.greatest("l_quantity", F.lit(1.0))
    mean = F.sum(F.col("l_extendedprice") * w) / F.sum(w)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.floor(mean * 100 + 0.5) / 100).alias("weighted"))


@query("""WITH g AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS nth FROM s WHERE total >= 3 AND n >= 3)
SELECT l_suppkey, p_brand, n, CAST(total AS BIGINT) AS total, floor(n * 1000.0 / total + 0.5)::DOUBLE / 10 AS share FROM r WHERE nth <= 5""")
def anchor_concentration(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    out = ops.concentration(rows, "l_suppkey", "p_brand", least=3, top=5)
    return out.select("l_suppkey", "p_brand", "n", "total", "share")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 100000) ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 26")
def keyset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    page = ops.keyset_page(o, ["o_orderdate", "o_orderkey"], [F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(100000)], 25)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS n FROM orders")
def case_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("r"))
    return ranked(rows, ["r", F.desc("o_totalprice"), "o_orderkey"], "n").select("o_orderkey", "n")


@query("SELECT c_custkey, row_number() OVER (ORDER BY first_order NULLS FIRST, c_custkey) AS n FROM (SELECT c_custkey, min(o_orderdate) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def nulls_first(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    first = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first_order"))
    rows = save(c.select("c_custkey").join(first, "c_custkey", "left"), "first-orders")
    return ranked(rows, [F.asc_nulls_first("first_order"), "c_custkey"], "n").select("c_custkey", "n")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, CAST(nth AS BIGINT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity, l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth <= 3")
def topk_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ops.top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("nth").cast("long"))


@query("SELECT o_custkey, CAST(floor((n - 1) / 5) + 1 AS BIGINT) AS batch, count(*) AS orders, CAST(min(o_orderkey) AS BIGINT) AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) GROUP BY ALL")
def batch_assignment(spark, sf_dir):
    rows = ops.batches(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 5)
    return rows.groupBy("o_custkey", "batch").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))


@query("SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS place, floor((max(s_acctbal) OVER (PARTITION BY s_nationkey) - s_acctbal) * 100 + 0.5) / 100 AS gap FROM supplier")
def competitor_rank(spark, sf_dir):
    mine = W.partitionBy("s_nationkey")
    s = table(spark, sf_dir, "supplier").withColumn("place", F.row_number().over(mine.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long"))
    gap = F.max("s_acctbal").over(mine) - F.col("s_acctbal")
    return s.select("s_nationkey", "s_suppkey", "place", (F.floor(gap * 100 + 0.5) / 100).alias("gap"))


@query("SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, count(*) AS points FROM orders GROUP BY o_custkey")
def first_last_change(spark, sf_dir):
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", key).alias("first_price"), F.max_by("o_totalprice", key).alias("last_price"), F.count("*").alias("points"))


@query("SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS set_key FROM orders GROUP BY o_custkey")
def set_key_fingerprint(spark, sf_dir):
    return ops.set_key(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey").cast("string"))


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_order FROM orders GROUP BY o_custkey HAVING min(o_orderdate) >= TIMESTAMP '1994-01-01'")
def min_having(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("m"))
    return g.filter(F.col("m") >= F.lit("1994-01-01").cast("timestamp_ntz")).select("o_custkey", F.date_format("m", "yyyy-MM-dd").alias("first_order"))


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def left_join_rollup(spark, sf_dir):
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).join(counts, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) AS customers, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders")
def ops_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = lambda cond, name: F.count_if(cond).alias(name)
    return o.agg(F.count("*").alias("orders"), c(F.col("o_orderstatus") == "O", "open"), c(F.col("o_orderstatus") == "F", "closed"), c(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.count_distinct("o_custkey").alias("customers"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))


@query("""WITH u AS (SELECT o_custkey AS k, o_orderdate AS placed, o_orderkey AS seq, o_orderstatus AS v FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY placed DESC, seq DESC) AS n FROM u) SELECT k, v, seq FROM r WHERE n = 1""")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("v"))
    half = F.col("seq") % 2 == 0
    return ops.upsert(o.filter(half), o.filter(~half), ["k"], ["at", "seq"]).select("k", "v", "seq")


@query("SELECT conv_id, CAST(max(turn) AS BIGINT) AS last_turn, arg_max(role, turn) AS last_role, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id")
def conversation_state(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("WITH l AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT coalesce(before, 'start') AS before, role, count(*) AS n FROM l GROUP BY ALL")
def role_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("start")))
    return rows.groupBy("before", "role").agg(F.count("*").alias("n"))


# --- graphs ------------------------------------------------------------------------------------------------
# part p links to part p // 2 and p // 3: a graph with parallel links, depth and unreachable nodes

_EDGES_SQL = "e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey % 7 <> 3 UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey % 5 = 0), k AS (SELECT src, dst FROM e WHERE src <> dst)"


def _edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    a = p.filter("p_partkey % 7 <> 3").selectExpr("p_partkey div 2 as src", "p_partkey as dst")
    return graph.edges(a.union(p.filter("p_partkey % 5 = 0").selectExpr("p_partkey div 3", "p_partkey")), p.select(F.col("p_partkey").alias("node")))


@query("WITH " + _EDGES_SQL + " SELECT p_partkey AS node, (SELECT count(*) FROM k WHERE dst = p_partkey) AS inbound, (SELECT count(*) FROM k WHERE src = p_partkey) AS outbound FROM part")
def link_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query("WITH RECURSIVE " + _EDGES_SQL + ", w(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT k.dst, w.depth + 1 FROM w JOIN k ON k.src = w.node) SELECT p_partkey AS node, CAST(min(depth) AS BIGINT) AS depth FROM part LEFT JOIN w ON w.node = p_partkey GROUP BY p_partkey")
def link_depth(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    depth = graph.depths(spark, _edges(spark, sf_dir), nodes.filter("node = 0"))
    return nodes.join(depth, "node", "left").select("node", F.col("depth").cast("long"))


@query("WITH " + _EDGES_SQL + " SELECT p_partkey AS node FROM part WHERE p_partkey <> 0 AND p_partkey NOT IN (SELECT dst FROM k)")
def orphan_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return nodes.filter("node <> 0").join(_edges(spark, sf_dir).select(F.col("dst").alias("node")), "node", "left_anti")
