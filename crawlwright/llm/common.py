"""Helpers that all corpus operators share: tables, the shared folder, bounded collects."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker holds at a time (one longer text goes alone).
SLICE_BYTES = 4 << 20


#: Bytes that a batch of rows between Spark and a Python worker holds, about; a longer row goes alone. Rows alone don't
#: bound a batch: ten thousand long texts are gigabytes, and a column of one batch ends at two.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Batches sent to Python workers hold BATCH_BYTES at most from now on in this session (less, if it says so)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse, which is shared as well."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/crawlwright-work"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage is cut and a lost executor costs no recomputation."""
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the tables behind frames that save() returned and that nothing reads any more."""
    for path in {os.path.dirname(f) for df in frames for f in df.inputFiles()}:
        if len(os.path.basename(path).rpartition("-")[2]) == 32:
            remove(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's JVM collect: broadcast blocks, shuffle files and plans of finished steps go only when its collector finds them
    unused, and its heap shrinks only then. For operators of very many steps."""
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text form, modulo n; 0 where the column is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(n), F.lit(0))


def most_frequent(df: DataFrame, count: str, most: int) -> pa.Table:
    """The rows of df with the largest counts, `most` of them at most, on the driver.

    A histogram of the counts' logarithms, with a few hundred classes, gives the least class that fits as a whole; of the
    next one, buckets of the rows' hashes fill up what is left, so equal counts are no reason to take none. An ordered limit
    would send that many rows from each task instead.
    """
    size = F.floor(F.log(F.col(count).cast("double")) * 16)
    some = df.filter(F.col(count) > 0)
    classes = sorted(((r["k"], r["n"]) for r in some.groupBy(size.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, whole = 0, 0
    while whole < len(classes) and held + classes[whole][1] <= most:
        held += classes[whole][1]
        whole += 1
    if whole == len(classes):
        return some.toArrow()
    last = classes[whole][0]
    bucket = F.pmod(F.xxhash64(*df.columns), F.lit(_HASH_BUCKETS))
    sizes = {r["b"]: r["n"] for r in some.filter(size == last).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    upto = 0
    while held + sizes.get(upto, 0) <= most and upto < _HASH_BUCKETS:
        held += sizes.get(upto, 0)
        upto += 1
    return some.filter((size > last) | ((size == last) & (bucket < upto))).toArrow()


_HASH_BUCKETS = 4096
