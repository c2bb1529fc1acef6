"""Running sums and places within groups, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.shared import save

#: Bits of the order's number that one lot of a group spans: a lot holds a million rows at most, as the number is unique in its group.
LOT_BITS = 20


def running(rows: DataFrame, by: list[str], at: str, bits: int = LOT_BITS, **weights: Column | int) -> DataFrame:
    """rows with a column for each weight: its sum over the rows of the same group that come before by `at`.

    `at` is a whole number, unique in its group and not null. A window by group alone puts a whole group into one task; here
    a group is cut into lots by the number's high bits, sums are made within lots, and the lots before are added. rows is
    read twice, so what is costly to make should be a written table.
    """
    lot = F.shiftright(F.col(at).cast("long"), bits)
    cols = {k: (F.lit(v) if isinstance(v, int) else v).cast("long") for k, v in weights.items()}
    dealt = rows.withColumn("_lot", lot)
    sizes = dealt.groupBy(*by, "_lot").agg(*[F.sum(c).alias(f"_{k}") for k, c in cols.items()])
    lots = W.partitionBy(*by).orderBy("_lot")
    before = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_lot").alias("_by_lot"), *[(F.sum(f"_{k}").over(lots) - F.col(f"_{k}")).alias(f"_{k}") for k in cols])
    inside = W.partitionBy(*by, "_lot").orderBy(at)
    own = dealt.withColumns({k: F.sum(c).over(inside) - c for k, c in cols.items()})
    same = F.col("_lot") == F.col("_by_lot")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = own.join(before, same).withColumns({k: F.col(k) + F.col(f"_{k}") for k in cols})
    return out.drop("_lot", "_by_lot", *[f"_by_{c}" for c in by], *[f"_{k}" for k in cols])


def place(rows: DataFrame, by: list[str], at: str, name: str, bits: int = LOT_BITS) -> DataFrame:
    """rows with each row's place from 1 in its group by `at`."""
    return running(rows, by, at, bits, **{name: 1}).withColumn(name, F.col(name) + 1)


def ranked(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with each row's place from 1 in the whole table by `order`: rows are dealt by ranges of the order and sorted, so the only
    window goes over the parts' counts, a row a part. rows should be a written table, since finding the ranges reads it once more; rows that are equal in the order
    come in any order."""
    keys = [*order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number's upper bits are the part's, so numbers ascend with the order over all parts
    dealt = save(dealt.select(*rows.columns, F.monotonically_increasing_id().alias("_at")), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    parts = dealt.groupBy(part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_at") + F.col("_before") + 1).alias(name))
