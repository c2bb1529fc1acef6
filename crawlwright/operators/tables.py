"""Relational operators on tables of reports, rows and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def funnel(events: DataFrame, step: str, steps: list[str]) -> DataFrame:
    """(step_seq, step, n, percent of the first step, one decimal): steps without events are there with 0, unknown steps are not."""
    counts = events.filter(F.col(step).isin(steps)).groupBy(F.col(step).alias("step")).agg(F.count("*").alias("n"))
    listed = events.sparkSession.createDataFrame(list(enumerate(steps)), "step_seq long, step string")
    rows = listed.join(counts, "step", "left").fillna(0, ["n"])
    first = F.first("n").over(W.orderBy("step_seq"))  # as many rows as steps
    return rows.withColumn("percent", F.when(first == 0, 0.0).otherwise(F.floor(F.col("n") * 1000.0 / first + 0.5) / 10))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, left_id: str, right_id: str) -> DataFrame:
    """For each left row the latest right row of the same key at or before it: one sort of both sides together
    by key and time instead of a join of all their pairs."""
    both = left.select(by, at, F.col(left_id).alias("l"), F.lit(None).cast("long").alias("r")).unionByName(right.select(by, at, F.lit(None).cast("long").alias("l"), F.col(right_id).alias("r")))
    before = W.partitionBy(by).orderBy(at, F.col("l").isNotNull(), "r").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("found", F.last("r", ignorenulls=True).over(before)).filter("l is not null").select(F.col("l").alias(left_id), F.col("found").alias(right_id))


def delta(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """keys with status new, fixed or persistent; both sides have distinct keys."""
    both = current.withColumn("c", F.lit(1)).join(previous.withColumn("p", F.lit(1)), keys, "full")
    return both.select(*keys, F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "fixed").otherwise("persistent").alias("status"))


def exists_flag(rows: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    return rows.join(other.select(F.col(other_key).alias(key)).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def concentration(rows: DataFrame, group: str, value: str, least: int, top: int) -> DataFrame:
    """The most frequent values of each group with their share in percent, one decimal."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy(group)))
    n = n.filter((F.col("total") >= least) & (F.col("n") >= least)).withColumn("share", F.floor(F.col("n") * 1000.0 / F.col("total") + 0.5) / 10)
    return n.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), value))).filter(F.col("nth") <= top)


def keyset_page(rows: DataFrame, keys: list[str], after: list[Column], size: int) -> DataFrame:
    """The page after a position in descending order of the keys, with one row more to tell whether there is another."""
    beyond = F.lit(False)
    for i in reversed(range(len(keys))):
        beyond = (F.col(keys[i]) < after[i]) | ((F.col(keys[i]) == after[i]) & beyond)
    return rows.filter((F.col(keys[0]) <= after[0]) & beyond).orderBy(*map(F.desc, keys)).limit(size + 1)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("nth") <= k)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size) + 1)


def set_key(rows: DataFrame, by: str, item: Column) -> DataFrame:
    """An order-insensitive key of each group's items."""
    return rows.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n"), 256).alias("set_key"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key of both; of equally new ones the last by order."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(*map(F.desc, order)))
    return stored.unionByName(incoming).withColumn("_n", newest).filter("_n = 1").drop("_n")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key isn't stored yet, one a key (the first by order)."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return incoming.join(stored, keys, "left_anti").withColumn("_n", first).filter("_n = 1").drop("_n")
