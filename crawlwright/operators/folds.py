"""State folds over event tables; crawlwright.streaming has the same for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fixed_window_quota(events: DataFrame, who: str, at: str, order: str, limit: int) -> DataFrame:
    """Requests of each hour that a limit allows and refuses."""
    bucket = F.date_trunc("hour", F.col(at)).alias("bucket")
    g = events.groupBy(who, bucket).agg(F.count("*").alias("requests"))
    return g.select(who, "bucket", "requests", F.least("requests", F.lit(limit)).cast("long").alias("allowed"), F.greatest(F.col("requests") - limit, F.lit(0)).cast("long").alias("refused"))


def outages(probes: DataFrame, who: str, at: str, order: str, fail: Column, least: int) -> DataFrame:
    """(who, since, until, fails): runs of `least` failures or more in a row, by gaps and islands."""
    rows = probes.select(who, at, order, fail.alias("_fail"))
    w = W.partitionBy(who).orderBy(at, order)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_fail"), 0).otherwise(1)).over(w)).filter("_fail")
    return rows.groupBy(who, "_run").agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("fails")).filter(F.col("fails") >= least).drop("_run")


def retry_state(events: DataFrame, who: str, fail: Column, dead: int) -> DataFrame:
    n = events.groupBy(who).agg(F.count_if(fail).alias("failures"))
    return n.withColumn("state", F.when(F.col("failures") >= dead, "dead").when(F.col("failures") > 0, "retry").otherwise("ok"))


def idempotency(events: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """(key, received, duplicates, conflicts): the first body of a key counts; the same again is a duplicate, another a conflict."""
    bodies = events.groupBy(key, body).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    g = bodies.groupBy(key).agg(F.sum("n").alias("received"), F.min_by("n", "o").alias("same"))
    return g.select(key, "received", (F.col("same") - 1).alias("duplicates"), (F.col("received") - F.col("same")).alias("conflicts"))


def payments(events: DataFrame, who: str, at: str, order: str) -> DataFrame:
    """(who, paid_cents, failed, last): what was paid, and the latest state by event order however late events came in."""
    e = events.filter(F.col("event_type").isin("purchase", "error"))
    paid = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return e.groupBy(who).agg(F.round(paid * 100).cast("long").alias("paid_cents"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max_by("event_type", F.struct(at, order)).alias("last"))


def invalid_transitions(versions: DataFrame, key: str, order: str, state: str, table: dict[str, list[str]]) -> DataFrame:
    """Versions whose state may not follow the one before, by a table of what may."""
    allowed = F.create_map(*[x for a, b in table.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    rows = versions.withColumn("before", before).filter(F.col("before").isNotNull())
    return rows.filter(~F.coalesce(F.array_contains(F.try_element_at(allowed, "before"), F.col(state)), F.lit(False)))


#: The states of a repair action's three sides; the first is what anything else counts as.
APPROVAL, EXECUTION, RERUN = ["drafted", "approved", "ignored"], ["not_started", "recorded", "applied", "blocked"], ["not_run", "fixed", "still_open", "regressed", "new"]


def _known(state: Column, names: list[str]) -> Column:
    s = F.lower(F.trim(F.coalesce(state, F.lit(""))))
    return F.when(s.isin(names), s).otherwise(F.lit(names[0]))


def action_error(approval: Column, execution: Column, rerun: Column, report: Column) -> Column:
    """Why a repair action can't be in these states, or null: only an approved one is applied, only an applied one has the
    result of a rerun, and a result needs the report that proves it."""
    proven = _known(rerun, RERUN) != "not_run"
    applied = _known(execution, EXECUTION) == "applied"
    return (
        F.when(applied & (_known(approval, APPROVAL) != "approved"), "applied before approved")
        .when(proven & ~applied, "rerun before applied")
        .when(proven & (F.trim(F.coalesce(report, F.lit(""))) == ""), "missing rerun report")
    )


def queue_status(approval: Column, execution: Column, rerun: Column) -> Column:
    """The state that a queue shows for an action: its result, else whether it is applied, approved or ignored."""
    r, a = _known(rerun, RERUN), _known(approval, APPROVAL)
    return F.when(r.isin("fixed", "regressed"), r).when(_known(execution, EXECUTION) == "applied", "applied").when(a.isin("approved", "ignored"), a).otherwise("drafted")


def action_events(versions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, event) of versions (approval, execution, rerun, report): what each valid version brings about for the first time
    since the one before. A version whose states can't be is left out, as it is refused."""
    rows = versions.filter(action_error(F.col("approval"), F.col("execution"), F.col("rerun"), F.col("report")).isNull())
    w = W.partitionBy(key).orderBy(order)
    turned = lambda c, names, to: F.when((_known(F.col(c), names) == to) & (F.coalesce(F.lag(_known(F.col(c), names)).over(w), F.lit("")) != to), F.lit(f"repair_action.{to}"))
    events = F.array(turned("approval", APPROVAL, "approved"), turned("execution", EXECUTION, "applied"), turned("rerun", RERUN, "fixed"), turned("rerun", RERUN, "regressed"))
    return rows.withColumn("_e", F.array_compact(events)).select(key, order, F.explode("_e").alias("event"))


def payment_state(events: DataFrame, who: str, order: str) -> DataFrame:
    """(who, paid, refunded, disputed, status) of payment events (kind, amount) in the order of the events, however they came in.

    kind is paid, failed, refund, dispute or restored. Refunds add up and are partial until they reach what was paid; a dispute
    stands until it is restored, which brings back the state before. An event for a payment that isn't paid yet waits: it counts
    once the payment is there. Sums and last places are all that is needed, so a payer of any number of events is not gathered.
    """
    kind, amount = F.col("kind"), F.coalesce("amount", F.lit(0.0))
    total = lambda k: F.sum(F.when(kind == k, amount).otherwise(0.0))
    last = lambda k: F.max(F.when(kind == k, F.col(order)))
    g = events.groupBy(who).agg(total("paid").alias("paid"), total("refund").alias("refunded"), last("dispute").alias("_d"), last("restored").alias("_r"), F.count_if(kind == "paid").alias("_p"), F.count_if(kind == "failed").alias("_f"))
    disputed = F.col("_d").isNotNull() & (F.col("_r").isNull() | (F.col("_r") < F.col("_d")))
    status = (
        F.when((F.col("_p") == 0) & (F.col("_f") > 0), "failed")
        .when(F.col("_p") == 0, "waiting")
        .when(disputed, "disputed")
        .when((F.col("refunded") > 0) & (F.col("refunded") >= F.col("paid")), "refunded")
        .when(F.col("refunded") > 0, "partially_refunded")
        .otherwise("paid")
    )
    return g.select(who, "paid", "refunded", disputed.alias("disputed"), status.alias("status"))


def unmatched(events: DataFrame, who: str, order: str) -> DataFrame:
    """Refunds and disputes that came before any payment of the same payer, with the payment that they are replayed after, if any."""
    first = events.filter("kind = 'paid'").groupBy(who).agg(F.min(order).alias("replayed_after"))
    rows = events.filter(F.col("kind").isin("refund", "dispute")).join(first, who, "left")
    return rows.filter(F.col("replayed_after").isNull() | (F.col(order) < F.col("replayed_after")))


#: How long jobs may run or wait, in minutes, how often a tick resumes waiting ones, and how long a busy browser is retried.
RUN_MINUTES, WAIT_MINUTES, RESUMED, BUSY_MINUTES = 20, 10, 3, 120


def job_state(events: DataFrame, job: str, at: str, order: str, now: Column) -> DataFrame:
    """(job, state, since, resume) from a log of jobs (kind: queued, claimed, completed, failed, busy).

    The latest event decides. A claim only counts if it follows a queued or busy state, so of two claims the first wins; a busy
    browser puts a job back until BUSY_MINUTES after it was first queued, then it fails; a run of over RUN_MINUTES has failed; of the
    jobs that wait for over WAIT_MINUTES the longest waiting ones, RESUMED, are resumed by a tick.
    """
    w = W.partitionBy(job).orderBy(at, order)
    before = F.lag("kind").over(w)
    valid = (F.col("kind") != "claimed") | F.coalesce(before.isin("queued", "busy"), F.lit(False))
    rows = events.withColumn("_ok", valid).filter("_ok")
    g = rows.groupBy(job).agg(F.max_by("kind", F.struct(at, order)).alias("last"), F.max(at).alias("since"), F.min(F.when(F.col("kind") == "queued", F.col(at))).alias("queued_at"))
    minutes = lambda a, b: (b.cast("timestamp").cast("double") - a.cast("timestamp").cast("double")) / 60
    late = minutes(F.col("since"), now)
    state = (
        F.when((F.col("last") == "claimed") & (late > RUN_MINUTES), "failed")
        .when(F.col("last") == "claimed", "running")
        .when((F.col("last") == "busy") & (minutes(F.col("queued_at"), F.col("since")) >= BUSY_MINUTES), "failed")
        .when(F.col("last").isin("busy", "queued"), "queued")
        .otherwise(F.col("last"))
    )
    g = g.withColumn("state", state).withColumn("waits", (F.col("state") == "queued") & (late > WAIT_MINUTES))
    first = g.filter("waits").orderBy("since", job).limit(RESUMED).select(job, F.lit(True).alias("resume"))
    return g.join(F.broadcast(first), job, "left").select(job, "state", "since", F.coalesce("resume", F.lit(False)).alias("resume"))


def once_a_day(rows: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """The first row of each key and day: digests and alerts that go out once a day."""
    first = F.row_number().over(W.partitionBy(key, F.to_date(at)).orderBy(at, order))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


#: Attempts of a delivery, what one may take, what all may take, and the first pause, in milliseconds; statuses to try again.
ATTEMPTS, TIMEOUT_MS, BUDGET_MS, PAUSE_MS, AGAIN = 2, 5000, 12000, 250, [408, 429]


def deliveries(tries: DataFrame, delivery: str, nth: str) -> DataFrame:
    """(delivery, attempts, spent_ms, status): what becomes of deliveries whose tries (nth from 1, status, ms) would end so.

    A try that takes TIMEOUT_MS has no answer. No answer, 408, 429 and 5xx are tried again after a pause that doubles, up to ATTEMPTS
    times and as long as pause and try fit into BUDGET_MS."""
    ms = F.least(F.col("ms"), F.lit(TIMEOUT_MS))
    status = F.when(F.col("ms") >= TIMEOUT_MS, F.lit(0)).otherwise(F.coalesce("status", F.lit(0)))
    again = (status == 0) | status.isin(AGAIN) | (status >= 500)
    pause = F.when(F.col(nth) > 1, PAUSE_MS * F.pow(F.lit(2), F.col(nth) - 2)).otherwise(0).cast("long")
    w = W.partitionBy(delivery).orderBy(nth)
    rows = tries.filter(F.col(nth) <= ATTEMPTS).select(delivery, nth, status.alias("_s"), (ms + pause).cast("long").alias("_ms"), again.cast("int").alias("_again"))
    rows = rows.withColumn("_spent", F.sum("_ms").over(w)).withColumn("_before", F.coalesce(F.min("_again").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1)))
    made = rows.filter((F.col("_before") == 1) & (F.col("_spent") <= BUDGET_MS))
    g = made.groupBy(delivery).agg(F.count("*").alias("attempts"), F.max("_spent").alias("spent_ms"), F.max_by("_s", nth).alias("last"))
    return g.select(delivery, "attempts", "spent_ms", F.when(F.col("last").between(200, 299), "delivered").otherwise("failed").alias("status"))


def monitoring(events: DataFrame, who: str, at: str, order: str) -> DataFrame:
    """(who, status, active, since) by the latest subscription event (kind: activated, charged, halted, cancelled, completed)."""
    place = F.struct(at, order)
    g = events.filter(F.col("kind").isin("activated", "charged", "halted", "cancelled", "completed")).groupBy(who).agg(F.max_by("kind", place).alias("last"), F.max(at).alias("since"))
    active = F.col("last").isin("activated", "charged")
    return g.select(who, F.when(active, "active").otherwise(F.col("last")).alias("status"), active.alias("active"), "since")
