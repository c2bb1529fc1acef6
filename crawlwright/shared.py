"""Tables in the folder that driver and executors share: they cut lineage, and a lost executor costs no repetition."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder in the warehouse, which is shared as well."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/crawlwright-work"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """df as a written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that save() returned and that nothing reads any more."""
    for df in frames:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            if len(os.path.basename(path).rpartition("-")[2]) == 32:
                remove(df.sparkSession, path)
