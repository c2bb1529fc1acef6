"""Link graphs: degrees, depths, redirects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.shared import forget, save


def edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst) whose target is a node and not the source itself; parallel links stay."""
    return links.filter("src <> dst").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, inbound, outbound): one pass over both ends of the edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    n = ends.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    return nodes.join(n, "node", "left").fillna(0, ["inbound", "outbound"])


def depths(spark: SparkSession, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth) of what can be reached, level by level until one is empty.

    Each level is written in the shared folder, so a level's plan reads tables and never repeats the levels before, and a lost
    executor costs no repetition. The levels so far are put into one table now and then, so that a long chain doesn't make a
    plan of as many tables.
    """
    pairs = save(edges.select("src", "dst").distinct(), "edges")
    seen = [save(start.select("node", F.lit(0).alias("depth")).distinct(), "depth")]
    front, level = seen[0], 0
    while True:
        level += 1
        known = reduce(DataFrame.unionByName, seen)
        step = pairs.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = save(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "depth")
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > 16:
            whole = save(reduce(DataFrame.unionByName, seen), "depth")
            front = save(front, "depth")
            forget(*seen)
            seen = [whole]
    return reduce(DataFrame.unionByName, seen)


def low_inbound(degrees: DataFrame, first: DataFrame, by: str, order: str, most: int = 1, top: int = 20) -> DataFrame:
    """Each site's pages that few links lead to, its first page aside, in page order. degrees: by, node, inbound and the order column."""
    rows = degrees.join(first.select("node"), "node", "left_anti").filter(F.col("inbound") <= most)
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("nth") <= top)


def deep_pages(depths: DataFrame, by: str, order: str, most: int = 3, top: int = 20) -> DataFrame:
    """Each site's pages that are over `most` links from its start, in page order."""
    rows = depths.filter(F.col("depth") > most)
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("nth") <= top)


def redirects(rules: DataFrame, most: int) -> DataFrame:
    """(start, final, hops, is_loop) for each rule's source: rules are followed until none applies, a place comes
    again, or `most` hops are made, which is how far a client follows. Each round is written, so round n doesn't repeat those before;
    a source with several rules follows its least one."""
    one = save(rules.groupBy("src").agg(F.min("dst").alias("dst")), "rules")
    r = one.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    live = one.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.lit(1).alias("hops"), F.array("src", "dst").alias("seen"))
    done = None
    for _ in range(most):
        loop = F.array_position("seen", F.col("at")) < F.size("seen")
        step = save(live.join(r, "at", "left").withColumn("loop", loop).withColumn("ends", F.col("next").isNull() | F.col("loop") | (F.col("hops") >= most)), "redirects")
        part = step.filter("ends").select("start", F.col("at").alias("final"), F.col("hops").cast("long").alias("hops"), F.col("loop").alias("is_loop"))
        done = part if done is None else done.unionByName(part)
        live = step.filter("not ends").select("start", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("next")).alias("seen"))
        if live.isEmpty():
            break
    return done
