"""Scores and repair plans from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.operators.order import place
from crawlwright.plans.rules import severity_rank

#: What the first finding of a group costs, each further one, and the most.
PENALTIES = {"critical": (12.0, 4.0, 28.0), "warning": (5.0, 1.5, 10.0), "notice": (1.0, 0.25, 3.0)}


def _count(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity)


def group_penalties(findings: DataFrame, *by: str) -> DataFrame:
    """(by, pattern_key, group_size, group_penalty): one problem on several pages is one group."""
    groups = findings.filter("severity <> 'good'").groupBy(*by, "pattern_key").agg(*[_count(s).alias(s) for s in PENALTIES])
    cost = F.lit(0.0)
    for s, (first, repeat, cap) in PENALTIES.items():
        n = F.col(s)
        cost = cost + F.when(n > 0, F.least(F.lit(cap), F.lit(first) + (n - 1) * F.lit(repeat))).otherwise(0.0)
    return groups.select(*by, "pattern_key", sum((F.col(s) for s in PENALTIES), F.lit(0)).alias("group_size"), cost.alias("group_penalty"))


def score_of(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100.5 - F.coalesce(penalty, F.lit(0.0))))).cast("int")


def scores(findings: DataFrame, units: DataFrame, *by: str) -> DataFrame:
    """score and finding counts for each row of units, 100 where nothing was found."""
    penalty = group_penalties(findings, *by).groupBy(*by).agg(F.sum("group_penalty").alias("penalty"))
    counts = findings.groupBy(*by).agg(*[_count(s).alias(s) for s in PENALTIES])
    out = units.join(penalty, list(by), "left").join(counts, list(by), "left").fillna(0, [*PENALTIES, "penalty"])
    return out.withColumn("score", score_of(F.col("penalty")))


def plan(findings: DataFrame) -> DataFrame:
    """The repair plan of each site: findings by severity, in their own order within one, numbered. Each severity is numbered
    by lots and starts after the graver ones."""
    rows = findings.filter("severity <> 'good'").withColumn("_rank", severity_rank(F.col("severity")))
    sizes = rows.groupBy("host", "_rank").agg(F.count("*").alias("_n"))
    graver = sizes.select(F.col("host").alias("_host"), F.col("_rank").alias("_r"), (F.sum("_n").over(W.partitionBy("host").orderBy("_rank")) - F.col("_n")).alias("_graver"))
    own = place(rows, ["host", "_rank"], "finding_seq", "_own")
    out = own.join(graver, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_rank") == F.col("_r")))
    return out.withColumn("priority", F.col("_own") + F.col("_graver")).drop("_own", "_graver", "_host", "_r", "_rank")


def with_gains(plan: DataFrame, findings: DataFrame) -> DataFrame:
    """score_gain: what the site's score wins if the whole group is fixed. Penalties add up, so leaving a group
    out is a subtraction."""
    groups = group_penalties(findings, "host")
    total = groups.groupBy("host").agg(F.sum("group_penalty").alias("penalty"))
    gain = score_of(F.col("penalty") - F.col("group_penalty")) - score_of(F.col("penalty"))
    gains = groups.join(total, "host").select("host", "pattern_key", F.col("group_size").alias("same_issue_count"), gain.alias("score_gain"))
    return plan.join(gains, ["host", "pattern_key"])


def distinct_fixes(plan: DataFrame, limit: int = 3) -> DataFrame:
    """The first `limit` different problems of each plan."""
    first = plan.groupBy("host", "pattern_key").agg(F.min("priority").alias("priority"))
    nth = F.row_number().over(W.partitionBy("host").orderBy("priority"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= limit)


def projected(findings: DataFrame, limit: int = 3) -> DataFrame:
    """Each site's score once its first `limit` different problems are fixed, where that is better."""
    groups = group_penalties(findings, "host")
    top = distinct_fixes(plan(findings), limit).select("host", "pattern_key", F.lit(True).alias("fixed"))
    sums = groups.join(top, ["host", "pattern_key"], "left").groupBy("host").agg(F.sum("group_penalty").alias("p"), F.sum(F.when(F.col("fixed"), 0.0).otherwise(F.col("group_penalty"))).alias("rest"), F.count("fixed").alias("fixes"))
    return sums.select("host", F.col("fixes"), score_of(F.col("p")).alias("score_from"), score_of(F.col("rest")).alias("score_to")).filter("score_to > score_from")
