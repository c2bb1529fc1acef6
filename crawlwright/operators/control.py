"""Alerts, dependent rate limits and leases, as folds over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.shared import forget, save


def outage_alerts(probes: DataFrame, who: str, at: str, order: str, fail: Column, sent: Column, least: int = 2, stale: str = "INTERVAL 26 HOURS") -> DataFrame:
    """(who, kind, at, since, fails): what owners are told about their sites: down once `least` checks in a row have failed, up
    at the next good check after that was told.

    sent says whether a message at that check would go out: one that doesn't is tried again at the next check that calls
    for it. A check that comes more than `stale` after the one before starts anew, and so forgets what was told. since is the first failed check of
    the outage. What was told can be read off the checks that could tell: of those in a row that say the same only the first
    does, and `up` never comes first. Null times, and rows of no site, are left out; checks at one time go by `order`.
    """
    rows = probes.select(F.col(who).alias("who"), F.col(at).alias("at"), F.col(order).alias("seq"), F.coalesce(fail, F.lit(False)).alias("fail"), F.coalesce(sent, F.lit(False)).alias("sent"))
    line = W.partitionBy("who").orderBy("at", "seq")
    fresh = F.coalesce(F.col("at") > F.lag("at").over(line) + F.expr(stale), F.lit(True))
    rows = rows.filter("who is not null and at is not null").withColumn("segment", F.sum(fresh.cast("int")).over(line))
    rows = rows.withColumn("run", F.sum((~F.col("fail")).cast("int")).over(W.partitionBy("who", "segment").orderBy("at", "seq")))
    rows = rows.withColumns({"fails": F.count_if("fail").over(W.partitionBy("who", "segment", "run").orderBy("at", "seq")), "since": F.min(F.when(F.col("fail"), F.col("at"))).over(W.partitionBy("who", "segment", "run"))})
    # a good check closes the run of failures before it
    told = W.partitionBy("who", "segment").orderBy("at", "seq")
    rows = rows.withColumns({"fails": F.when(F.col("fail"), F.col("fails")).otherwise(F.lit(0)), "kind": F.when(~F.col("fail"), "up").when(F.col("fails") >= least, "down")})
    said = rows.filter("sent and kind is not null").withColumn("before", F.lag("kind").over(told))
    out = said.filter("kind = 'down' and (before is null or before = 'up') or kind = 'up' and before = 'down'")
    return out.select(F.col("who").alias(who), "kind", F.col("at").alias(at), F.when(F.col("kind") == "down", F.col("since")).alias("since"), "fails")


def admitted(requests: DataFrame, checks: list[tuple[str, list[str], int]], order: list[str]) -> DataFrame:
    """requests with refused_by: the name of the first check that refuses a request, null if none does.

    A check (name, bucket columns, limit) lets the first `limit` requests of each bucket through that reach it. Checks come in order, and
    a request that a later check refuses has used its place in the earlier ones. So check n numbers what the checks before let through.
    order must name a request uniquely. Only the first `limit` of a bucket are ever sorted together, and the last of them, a row a bucket,
    tells the others, so a bucket may hold any number of requests. A null in a bucket column is a value like others.
    """
    rows = requests.withColumn("refused_by", F.lit(None).cast("string"))
    at = F.struct(*order)
    for name, bucket, limit in checks:
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_b{i}") for i, c in enumerate(bucket)]
        names = [f"_b{i}" for i in range(len(keys))]
        rows = rows.select("*", *keys)
        n = F.row_number().over(W.partitionBy(*names).orderBy(*order))
        first = rows.filter("refused_by is null").select(*names, *order).withColumn("_n", n).filter(F.col("_n") <= limit)
        last = first.groupBy(*names).agg(F.max(at).alias("_last"), F.count("*").alias("_used")).filter(F.col("_used") == limit)
        late = F.col("refused_by").isNull() & F.coalesce(at > F.col("_last"), F.lit(limit == 0))
        rows = rows.join(last, names, "left").withColumn("refused_by", F.when(late, F.lit(name)).otherwise(F.col("refused_by"))).drop(*names, "_last", "_used")
        rows = save(rows, "admitted")  # the next check reads it twice
    return rows


def leases(spark: SparkSession, events: DataFrame, minutes: int) -> DataFrame:
    """(batch, worker, claim, since, until, ended, refused, requeued): the leases that workers' claims get, and how each ended.

    events: batch, worker, seq (unique), at, kind (claim, beat, done). A claim is granted if nobody holds the batch. Its lease runs for
    `minutes`, anew with each beat of its worker while it holds, until the worker is done or it expires; a beat or end that
    comes later counts for nothing. refused counts the claims that came meanwhile, requeued tells whether the batch was claimed again
    after the lease had expired. Events with a null are left out; at one time events go by seq.

    Which claims are granted depends on those before. But when a claim's lease would end if it were granted doesn't, and so neither does
    the claim that would be granted next. These pointers are doubled until they span the longest chain, and then followed
    from each batch's first claim in steps of falling length: as many joins as the logarithm of a batch's claims,
    each dealt by claim, so a batch may have any number of them.
    """
    e = save(events.select("batch", "worker", "seq", "at", "kind").dropna(), "leases")
    length = F.expr(f"INTERVAL {minutes} MINUTES")
    own = W.partitionBy("batch", "worker").orderBy("at", "seq")
    beats = e.filter("kind = 'beat'").withColumn("gap", F.coalesce(F.col("at") >= F.lag("at").over(own) + length, F.lit(True)))
    beats = beats.withColumn("chain", F.sum(F.col("gap").cast("int")).over(own))
    beats = beats.withColumn("held", F.max("at").over(W.partitionBy("batch", "worker", "chain")) + length).select("seq", "held")
    # what comes next is looked for from the end: a frame that ends with its row grows by a row a step, one that begins there is read anew for each row
    later = W.partitionBy("batch", "worker").orderBy(F.desc("at"), F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    beat = F.last(F.when(F.col("kind") == "beat", F.struct("at", "held")), True).over(later)
    done = F.last(F.when(F.col("kind") == "done", F.struct("at", "seq")), True).over(later)
    claims = e.join(beats, "seq", "left").withColumns({"beat": beat, "done": done}).filter("kind = 'claim'")
    until = F.when(F.col("beat.at") < F.col("at") + length, F.col("beat.held")).otherwise(F.col("at") + length)
    claims = claims.withColumn("until", until).withColumn("over", F.coalesce(F.col("done.at") < F.col("until"), F.lit(False)))
    claims = claims.withColumn("until", F.when(F.col("over"), F.col("done.at")).otherwise(F.col("until")))
    claims = save(claims.select("batch", "worker", "seq", "at", "until", "over", F.col("done.seq").alias("done")), "leases")
    # the first claim after a lease: ends and claims in one line; an expiry comes before the claims of its time, the end of a worker that is done at its own place
    side, place = F.when(F.col("over"), F.lit(1)).otherwise(F.lit(0)).alias("side"), F.when(F.col("over"), F.col("done")).otherwise(F.col("seq")).alias("place")
    line = claims.select("batch", F.col("until").alias("t"), side, place, "seq", F.lit(True).alias("end")).unionByName(claims.select("batch", F.col("at").alias("t"), F.lit(1).alias("side"), F.col("seq").alias("place"), "seq", F.lit(False).alias("end")))
    following = W.partitionBy("batch").orderBy(F.desc("t"), F.desc("side"), F.desc("place")).rowsBetween(W.unboundedPreceding, -1)
    jump = line.withColumn("next", F.last(F.when(~F.col("end"), F.col("seq")), True).over(following)).filter("end and next is not null").select("seq", "next")
    jumps = [save(jump, "leases-next")]
    most = claims.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(jumps) < most:
        a, b = jumps[-1], jumps[-1].select(F.col("seq").alias("next"), F.col("next").alias("far"))
        jumps.append(save(a.join(b, "next").select("seq", F.col("far").alias("next")), "leases-next"))
    granted = save(claims.groupBy("batch").agg(F.min_by("seq", F.struct("at", "seq")).alias("seq")).select("seq"), "leases-granted")
    for step in reversed(jumps):
        granted = save(granted.unionByName(granted.join(step, "seq").select(F.col("next").alias("seq"))), "leases-granted")
    # each claim belongs to the last granted one before it
    marked = claims.join(granted.withColumn("granted", F.lit(True)), "seq", "left")
    so_far = W.partitionBy("batch").orderBy("at", "seq")
    marked = marked.withColumn("claim", F.last(F.when(F.col("granted"), F.col("seq")), True).over(so_far))
    lease = marked.groupBy("batch", "claim").agg(F.count_if(F.col("granted").isNull()).alias("refused"))
    kept = marked.filter("granted").select("batch", "claim", "worker", F.col("at").alias("since"), "until", "over")
    after = W.partitionBy("batch").orderBy("since", "claim")
    kept = kept.withColumn("requeued", ~F.col("over") & F.lead("claim").over(after).isNotNull())
    forget(*jumps)
    return kept.join(lease, ["batch", "claim"]).select("batch", "worker", "claim", "since", "until", F.when(F.col("over"), "done").otherwise("expired").alias("ended"), "refused", "requeued")
