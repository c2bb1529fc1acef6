"""Alerts, rate limits and leases against plain replays."""

import datetime
import random

from pyspark.sql import functions as F

from crawlwright.operators import control

DAY = datetime.datetime(2024, 5, 1)


def at(minute):
    return DAY + datetime.timedelta(minutes=minute)


def test_alerts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), at(rng.randrange(3000)), n, rng.random() < 0.6, rng.random() < 0.5) for n in range(400)]
    rows += [("d", at(m), 1000 + m, True, m > 1) for m in range(5)] + [("e", at(0), 2000, True, True), ("e", at(0), 2001, True, True), ("e", at(0), 2002, None, True), (None, at(1), 1, True, True), ("e", None, 3, True, True)]
    got = control.outage_alerts(spark.createDataFrame(rows, "who string, at timestamp, seq long, fail boolean, sent boolean").repartition(3), "who", "at", "seq", F.col("fail"), F.col("sent"), 2, "INTERVAL 60 MINUTES")
    want = []
    for who in "abcde":
        last, fails, first, told = None, 0, None, False
        for _, t, _, fail, sent in sorted((r for r in rows if r[0] == who and r[1]), key=lambda r: r[1:3]):
            if last and t > last + datetime.timedelta(minutes=60):
                fails, first, told = 0, None, False
            last = t
            fails, first = (fails + 1, first or t) if fail else (0, None)
            if sent and fail and fails >= 2 and not told:
                told = True
                want.append((who, "down", t, first, fails))
            elif sent and not fail and told:
                told = False
                want.append((who, "up", t, None, 0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 20


def test_admitted(spark):
    rng = random.Random(3)
    rows = [(n, rng.randrange(50), rng.choice([1, 1, 1, 2, None]), rng.randrange(12), rng.randrange(4)) for n in range(500)]
    checks = [("ip", ["ip"], 60), ("session", ["hour", "session"], 6), ("target", ["target", "hour"], 9), ("none", ["ip"], 0)]
    df = spark.createDataFrame([(n, t, ip, s, g, t // 10) for n, t, ip, s, g in rows], "id long, t int, ip int, session int, target int, hour int").repartition(4)
    for some in (checks, checks[:3]):
        used, want = {}, {}
        for n, t, ip, s, g in sorted(rows, key=lambda r: (r[1], r[0])):
            row = {"ip": ip, "session": s, "target": g, "hour": t // 10}
            want[n] = None
            for name, bucket, limit in some:
                key = (name, *(row[c] for c in bucket))
                if used.get(key, 0) >= limit:
                    want[n] = name
                    break
                used[key] = used.get(key, 0) + 1
        assert {r.id: r.refused_by for r in control.admitted(df, some, ["t", "id"]).collect()} == want
        assert set(want.values()) >= {"ip", "session", "target"}


def test_leases(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.choice("vw"), n, at(rng.randrange(900)), rng.choice(["claim", "claim", "beat", "beat", "done"])) for n in range(400)]
    # over at once, and claims at the very end of a lease
    rows += [("z", "v", 1000, at(0), "claim"), ("z", "v", 1001, at(0), "done"), ("z", "w", 1002, at(0), "claim"), ("z", "v", 1003, at(15), "claim"), ("z", "w", 1004, at(15), "beat"), ("z", None, 1005, at(16), "claim")]
    got = control.leases(spark, spark.createDataFrame(rows, "batch string, worker string, seq long, at timestamp, kind string").repartition(3), 15)
    want = {}
    for batch in "xyz":
        holder, until, now = None, None, None
        for _, who, seq, t, kind in sorted((r for r in rows if r[0] == batch and r[1]), key=lambda r: (r[3], r[2])):
            held = until is not None and t < until
            if kind == "claim" and held:
                want[batch, now][4] += 1
            elif kind == "claim":
                if now is not None:
                    want[batch, now][5] = want[batch, now][3] == "expired"
                holder, until, now = who, t + datetime.timedelta(minutes=15), seq
                want[batch, now] = [who, t, until, "expired", 0, False]
            elif held and holder == who:
                until = t + datetime.timedelta(minutes=15) if kind == "beat" else t
                want[batch, now][2:4] = [until, "expired" if kind == "beat" else "done"]
    assert {(r.batch, r.claim): [r.worker, r.since, r.until, r.ended, r.refused, r.requeued] for r in got.collect()} == want and len(want) > 40
    assert control.leases(spark, spark.createDataFrame([], "batch string, worker string, seq long, at timestamp, kind string"), 15).count() == 0


def test_leases_read_no_row_anew_for_each_row(spark):
    """Frames that begin at their row are read anew for each row, so the time grows with the square of a batch."""
    e = spark.range(10).select(F.lit("x").alias("batch"), F.lit("v").alias("worker"), F.col("id").alias("seq"), F.lit(DAY).alias("at"), F.lit("beat").alias("kind"))
    seen, save = [], control.save
    control.save = lambda df, label: seen.append(df._jdf.queryExecution().toString()) or save(df, label)
    try:
        control.leases(spark, e, 15)
    finally:
        control.save = save
    assert len(seen) > 2 and not any("1, unboundedfollowing" in x.lower() for x in seen)
