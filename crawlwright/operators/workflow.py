"""Crawl frontiers, batches, leases, schedules and repair queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.operators.order import place


def frontier(urls: DataFrame, job: str, key: Column, order: list[str], size: int) -> DataFrame:
    """The first URL of each key in its job, with its priority and the batch it goes to."""
    rows = urls.withColumn("_key", key)
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(job, "_key").orderBy(*order))).filter("_n = 1").drop("_n")
    if len(order) == 1 and dict(first.dtypes)[order[0]] in ("int", "bigint"):  # a job may hold most of the rows
        numbered = place(first, [job], order[0], "priority")
    else:
        numbered = first.withColumn("priority", F.row_number().over(W.partitionBy(job).orderBy(*order)))
    return numbered.withColumn("batch", (F.floor((F.col("priority") - 1) / size) + 1).cast("long")).withColumnRenamed("_key", "url_key")


def extended(stored: DataFrame, found: DataFrame, job: str, key: str, order: list[str], size: int) -> DataFrame:
    """What an ingestion adds to a stored frontier (job, url_key, priority): unknown keys alone, numbered on."""
    last = stored.groupBy(job).agg(F.max("priority").alias("_last"))
    new = found.join(stored.select(job, F.col("url_key").alias(key)), [job, key], "left_anti").dropDuplicates([job, key])
    if len(order) == 1 and dict(new.dtypes)[order[0]] in ("int", "bigint"):
        new = place(new, [job], order[0], "priority")
    else:
        new = new.withColumn("priority", F.row_number().over(W.partitionBy(job).orderBy(*order)))
    return new.join(last, job, "left").withColumn("priority", F.col("priority") + F.coalesce("_last", F.lit(0))).withColumn("batch", (F.floor((F.col("priority") - 1) / size) + 1).cast("long")).drop("_last")


def batch_states(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by state of each batch (or job), and whether all of it is rendered."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    g = rows.groupBy(*by).agg(F.count("*").alias("total"), *map(n, ("queued", "running", "rendered", "failed")))
    return g.withColumn("ready", F.col("rendered") == F.col("total"))


def leases(beats: DataFrame, batch: str, at: str, now: Column, minutes: int) -> DataFrame:
    """Each batch's last sign of life and whether its lease has run out."""
    g = beats.groupBy(batch).agg(F.max(at).alias("last"), F.count("*").alias("beats"))
    return g.withColumn("expired", F.col("last") < now - F.make_dt_interval(mins=F.lit(minutes)))


def due(schedules: DataFrame, at: str, order: str, now: Column, most: int) -> DataFrame:
    """The schedules that a tick takes: the longest due ones."""
    return schedules.filter(F.col(at) <= now).orderBy(at, order).limit(most)


def repair_queue(findings: DataFrame, saved: DataFrame, by: str, key: str, rank: Column, most: int = 100) -> DataFrame:
    """Findings with their saved state, and saved items that no finding has any more, numbered anew up to `most`.
    findings: by, key, title, severity, seq. saved: by, key, status."""
    both = findings.withColumn("_f", F.lit(1)).join(saved.select(by, key, F.col("status").alias("_s")), [by, key], "full")
    rows = both.withColumn("status", F.coalesce("_s", F.lit("open"))).withColumn("origin", F.when(F.col("_f").isNotNull(), "finding").otherwise("saved"))
    order = W.partitionBy(by).orderBy(F.col("_f").isNull(), rank, "seq", key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_f", "_s")


def limits(owned: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """(key, granted, used, remaining): the larger of the stored and the default limit."""
    granted = F.greatest(F.coalesce("stored", F.lit(0)), F.coalesce("default", F.lit(0)))
    rows = owned.join(defaults, key, "left").withColumn("granted", granted)
    return rows.withColumn("remaining", F.greatest(F.lit(0), F.col("granted") - F.col("used")))
