import os

import pandas as pd
from pyspark.sql import functions as F

from crawlwright.operators import control, folds
from crawlwright.streaming import events as ev

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path, parts=2):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    e.orderBy("ts").coalesce(1).write.parquet(src)
    return e, spark.readStream.schema(e.schema).parquet(src)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_counts_and_quota(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    drain(ev.step_counts(s), "steps", "complete")
    want = {(r.w.start, r.event_type): r.n for r in e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.window.start, r.event_type): r.n for r in spark.table("steps").collect()} == want
    drain(ev.quota(s, 2), "quota", "complete")
    assert spark.table("quota").agg(F.sum("allowed")).first()[0] == folds.fixed_window_quota(e, "user_id", "ts", "event_id", 2).agg(F.sum("allowed")).first()[0]


def test_outage_alerts_follow_the_batch_fold(spark, tmp_path):
    """Rows shuffled within hours and dealt to files so that many come late; a last file far ahead moves the watermark."""
    e = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 9).alias("user_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    src = tmp_path / "in"
    src.mkdir()
    rows = e.toPandas().sort_values("ts").reset_index(drop=True)
    rows["part"] = (rows["ts"].dt.floor("1D").rank(method="dense").astype(int) - 1) // 6
    end = rows.iloc[[-1]].assign(user_id=99, ts=rows["ts"].max() + pd.Timedelta("40D"), part=99)
    more = end.assign(event_id=10**6, ts=end["ts"] + pd.Timedelta("1h"), part=100)
    for n, (_, part) in enumerate(pd.concat([rows, end, more]).sample(frac=1, random_state=4).sort_values("part", kind="stable").groupby("part")):
        part["ts"] = part["ts"].astype("datetime64[us]")
        part.drop(columns="part").to_parquet(src / f"f{n:03}.parquet", coerce_timestamps="us")
        os.utime(src / f"f{n:03}.parquet", (1000 + n, 1000 + n))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    fail, sent = F.col("event_type").isin("error", "click"), F.col("event_id") % 3 != 0
    drain(ev.outage_alerts(s, stale="12 hours", late="7 days", fail=fail, sent=sent), "alerts")
    want = control.outage_alerts(e, "user_id", "ts", "event_id", fail, sent, 2, "INTERVAL 12 HOURS")
    got = [tuple(r) for r in spark.table("alerts").orderBy("user_id", "at").collect()]
    assert got == [tuple(r) for r in want.orderBy("user_id", "ts").select("user_id", "kind", "ts", "since", "fails").collect()] and len(got) > 20


def test_sliding_counts_with_a_static_side(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    sites = spark.createDataFrame([(k, "pro" if k % 2 else "free") for k in range(0, 6)], "user_id long, plan string")
    drain(ev.sliding_counts(s, sites), "sliding", "complete")
    w = F.window("ts", "1 hour", "15 minutes")
    want = e.join(sites, "user_id", "left").groupBy(w, F.coalesce("plan", F.lit("none"))).count().collect()
    assert sorted(map(tuple, spark.table("sliding").collect())) == sorted(map(tuple, want)) and len({r[1] for r in want}) == 3


def test_repeats_and_latest(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    drain(ev.first_of_each(s.withColumn("id", F.col("event_id") % 50), "id", "1000 hours"), "once")
    assert spark.table("once").count() == 50
    out = str(tmp_path / "out")
    q = s.writeStream.foreachBatch(ev.keep_latest(out, ["user_id"], ["ts", "event_id"])).start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: r.event_id for r in spark.read.parquet(f"{out}/v0").collect()}
    want = {r.user_id: r.m.event_id for r in e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).collect()}
    assert got == want
