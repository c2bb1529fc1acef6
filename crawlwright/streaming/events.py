"""The event folds as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by step in tumbling windows; a window is out once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def first_of_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark: idempotent intake of repeated deliveries."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def quota(events: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    """Requests of each user and hour, and how many the limit allows."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count("*").alias("requests"))
    return g.withColumn("allowed", F.least("requests", F.lit(limit).cast("long")))


ALERTS = "user_id long, kind string, at timestamp, since timestamp, fails long"
_STATE = "at array<long>, seq array<long>, fail array<boolean>, sent array<boolean>, last long, fails long, first long, told boolean"


def outage_alerts(events: DataFrame, least: int = 2, stale: str = "26 hours", late: str = "10 minutes", fail: Column | None = None, sent: Column | None = None) -> DataFrame:
    """What operators.control.outage_alerts() says of the same checks, on a stream: rows may come in any order, as long as none is
    later than `late`.

    A row is held in its key's state until the watermark has passed it; a timer at the oldest held row's time wakes the key up if
    no row comes. What is due then is folded in order of time and event_id. So a key holds the rows of the last `late` alone, and a
    state that hears nothing for `stale` past the watermark is dropped, which is what a late check would do to it.
    """
    wait = pd.Timedelta(stale).value // 1000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seq, bad, sent_, last, fails, first, told = state.get if state.exists else ([], [], [], [], None, 0, None, False)
        held = list(zip(at, seq, bad, sent_, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                held += zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["event_id"].tolist(), rows["fail"].tolist(), rows["sent"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs() * 1000
        due, held = sorted(r for r in held if r[0] <= mark), [r for r in held if r[0] > mark]
        out = []
        for t, _, f, s in due:
            if last is not None and t > last + wait:
                fails, first, told = 0, None, False
            last = t
            fails, first = (fails + 1, first if fails else t) if f else (0, None)
            kind = "down" if f and fails >= least and not told else "up" if not f and told else None
            if kind and s:
                told = kind == "down"
                out.append((key[0], kind, t, first, fails))
        if held or last is None or last + wait > mark:
            state.update((*([r[i] for r in held] for i in range(4)), last, fails, first, told))
            wake = min(r[0] for r in held) if held else last + wait
            state.setTimeoutTimestamp(max(mark, wake) // 1000 + 1)
        else:
            state.remove()
        frame = pd.DataFrame(out, columns=["user_id", "kind", "at", "since", "fails"])
        yield frame.assign(at=pd.to_datetime(frame["at"], unit="us"), since=pd.to_datetime(frame["since"], unit="us"))

    bad = F.col("event_type") == "error" if fail is None else fail
    marked = events.withWatermark("ts", late).select("user_id", "event_id", "ts", F.coalesce(bad, F.lit(False)).alias("fail"), F.coalesce(F.lit(True) if sent is None else sent, F.lit(False)).alias("sent"))
    return marked.groupBy("user_id").applyInPandasWithState(fold, ALERTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sliding_counts(events: DataFrame, sites: DataFrame, late: str = "10 minutes", size: str = "1 hour", every: str = "15 minutes") -> DataFrame:
    """Events by a site's plan in windows that overlap: the stream joined to a static table (user_id, plan), then counted; events of unknown sites count under none."""
    known = events.withWatermark("ts", late).join(sites, "user_id", "left")
    return known.groupBy(F.window("ts", size, every), F.coalesce("plan", F.lit("none")).alias("plan")).agg(F.count("*").alias("n"))


def keep_latest(path: str, keys: list[str], order: list[str]):
    """A foreachBatch sink: a parquet table under path with the newest row of each key.

    A version of the table is a folder; a marker beside it, written last, names it as whole and says which batch of which
    query made it. A batch starts from the newest whole version, whatever its own number, so a new checkpoint goes on from the table; a batch
    that comes again changes nothing, since rows are equal. Older versions go once a newer one is whole. latest_version() finds it.
    """
    from crawlwright.operators.tables import upsert

    def sink(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        last = latest_version(spark, path)
        stored = batch.limit(0) if last is None else spark.read.schema(batch.schema).parquet(f"{path}/v{last}")
        new = 0 if last is None else last + 1
        upsert(stored, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v{new}")
        fs, at = _files(spark, path)
        fs.create(at(f"{path}/v{new}.whole"), True).close()
        if last is not None:
            for name in (f"{path}/v{last}.whole", f"{path}/v{last}"):
                fs.delete(at(name), True)

    return sink


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the newest whole version of keep_latest()'s table; None if there is none."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return None
    names = [str(f.getPath().getName()) for f in fs.listStatus(at(path))]
    return max((int(n[1:-6]) for n in names if n.startswith("v") and n.endswith(".whole")), default=None)
