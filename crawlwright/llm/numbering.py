"""Places of rows within groups, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.llm.common import save


def numbered(spark: SparkSession, rows: DataFrame, by: list[str], order: list[Column | str], label: str) -> DataFrame:
    """rows with `place` (from 0, by `order` in its group) and `total` (rows of the group).

    A window by group would put a whole group into one task. Here rows are dealt by ranges of group and order and sorted, so a
    group of any size lies in a run of parts; the only windows go over the parts' counts, a row for each group and part. rows
    should be a written table, since finding the ranges reads it once more. Group columns must not be null. Rows equal in group
    and order come in any order; the last border is a row's own number, so any number of them is cut as well.
    """
    cols = rows.columns
    keys = [*by, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number's upper bits are the part's, so numbers ascend with the order over all parts
    dealt = save(spark, dealt.select(*cols, F.monotonically_increasing_id().alias("_at")), label)
    part = F.shiftright("_at", 33).alias("_part")
    spans = dealt.groupBy(*by, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = W.partitionBy(*by)
    spans = spans.select(*by, "_part", "_first", (F.sum("_n").over(parts.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(parts).alias("total"))
    spans = save(spark, spans, f"{label}-spans")  # its size is known then, and decides about a broadcast
    joined = dealt.withColumn("_part", part).join(spans, [*by, "_part"])
    return joined.select(*cols, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "total")
