"""Alerts, rate limits and leases over the event stream; the SQL replays events row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlwright.operators import control
from crawlwright.registry import query, table


def _shown(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


@query("""WITH RECURSIVE e AS (
  SELECT user_id % 40 AS site, ts, event_type IN ('error', 'click') AS fail, event_id % 3 <> 0 AS sent,
    row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS i FROM events),
s(site, i, ts, down, fails, first, told, said, since) AS (
  SELECT DISTINCT site, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), false, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), false, CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP) FROM e
  UNION ALL
  SELECT site, i, ts, now_down, now_fails, now_first, CASE WHEN said = 'down' THEN true WHEN said = 'up' THEN false ELSE was_told END, said, CASE WHEN said = 'down' THEN now_first END
  FROM (SELECT *, CASE WHEN now_down AND NOT was_told AND sent THEN 'down' WHEN NOT fail AND was_told AND sent THEN 'up' END AS said
    FROM (SELECT *, fail AND (now_fails >= 2 OR was_down) AS now_down FROM (
      SELECT e.site, e.i, e.ts, e.fail, e.sent,
        CASE WHEN e.ts > s.ts + INTERVAL 20 HOUR THEN false ELSE s.down END AS was_down,
        CASE WHEN e.ts > s.ts + INTERVAL 20 HOUR THEN false ELSE s.told END AS was_told,
        CASE WHEN NOT e.fail THEN 0 WHEN e.ts > s.ts + INTERVAL 20 HOUR THEN 1 ELSE s.fails + 1 END AS now_fails,
        CASE WHEN NOT e.fail THEN NULL WHEN e.ts > s.ts + INTERVAL 20 HOUR THEN e.ts ELSE coalesce(s.first, e.ts) END AS now_first
      FROM s JOIN e ON e.site = s.site AND e.i = s.i + 1))))
SELECT site, said AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS told_at, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, fails FROM s WHERE said IS NOT NULL""")
def uptime_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("site"), F.col("ts").alias("at"), "event_id", "event_type")
    out = control.outage_alerts(e, "site", "at", "event_id", F.col("event_type").isin("error", "click"), F.col("event_id") % 3 != 0, 2, "INTERVAL 20 HOURS")
    return out.select("site", "kind", _shown("at").alias("told_at"), _shown("since"), "fails")


@query("""WITH r AS (SELECT event_id, ts, user_id % 60 AS session, user_id % 7 AS ip, event_type AS target, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY hour, ip ORDER BY ts, event_id) <= 12 AS ok1 FROM r),
b AS (SELECT *, ok1 AND row_number() OVER (PARTITION BY ok1, hour, session ORDER BY ts, event_id) <= 2 AS ok2 FROM a),
c AS (SELECT *, ok2 AND row_number() OVER (PARTITION BY ok2, day, session ORDER BY ts, event_id) <= 4 AS ok3 FROM b),
d AS (SELECT *, ok3 AND row_number() OVER (PARTITION BY ok3, hour, target ORDER BY ts, event_id) <= 3 AS ok4 FROM c)
SELECT event_id, CASE WHEN NOT ok1 THEN 'ip' WHEN NOT ok2 THEN 'session-hour' WHEN NOT ok3 THEN 'session-day' WHEN NOT ok4 THEN 'target' END AS refused_by FROM d""")
def audit_quota(spark, sf_dir):
    """Four checks a request: network, account by hour and by day, and the audited site."""
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", "ts", (F.col("user_id") % 60).alias("session"), (F.col("user_id") % 7).alias("ip"), F.col("event_type").alias("target"), F.date_trunc("hour", "ts").alias("hour"), F.date_trunc("day", "ts").alias("day"))
    checks = [("ip", ["hour", "ip"], 12), ("session-hour", ["hour", "session"], 2), ("session-day", ["day", "session"], 4), ("target", ["hour", "target"], 3)]
    return control.admitted(r, checks, ["ts", "event_id"]).select("event_id", "refused_by")


_KINDS = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'done' ELSE 'beat' END"


@query(f"""WITH RECURSIVE e AS (
  SELECT user_id % 40 AS batch, event_id % 3 AS worker, event_id, ts, {_KINDS} AS kind, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS i FROM events),
s(batch, i, kind, ts, holder, lease, until, ended, got) AS (
  SELECT DISTINCT batch, CAST(0 AS BIGINT), '', CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), false, false FROM e
  UNION ALL
  SELECT batch, i, kind, ts,
    CASE WHEN grants THEN worker ELSE holder END, CASE WHEN grants THEN event_id ELSE lease END,
    CASE WHEN grants OR (mine AND kind = 'beat') THEN ts + INTERVAL 240 MINUTE WHEN mine AND kind = 'done' THEN ts ELSE until END,
    CASE WHEN grants THEN false WHEN mine AND kind = 'done' THEN true ELSE ended END, grants
  FROM (SELECT *, kind = 'claim' AND NOT active AS grants, active AND holder = worker AS mine FROM (
    SELECT e.batch, e.i, e.kind, e.ts, e.worker, e.event_id, s.holder, s.lease, s.until, s.ended, coalesce(e.ts < s.until AND NOT s.ended, false) AS active
    FROM s JOIN e ON e.batch = s.batch AND e.i = s.i + 1))),
l AS (
  SELECT batch, lease AS claim, any_value(holder) AS worker, min(ts) AS since, max_by(until, i) AS until, max_by(ended, i) AS over, count(*) FILTER (kind = 'claim' AND NOT got) AS refused
  FROM s WHERE lease IS NOT NULL GROUP BY batch, lease)
SELECT batch, worker, claim, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, strftime(until, '%Y-%m-%d %H:%M:%S.%f') AS until, CASE WHEN over THEN 'done' ELSE 'expired' END AS ended, refused,
  NOT over AND lead(claim) OVER (PARTITION BY batch ORDER BY since, claim) IS NOT NULL AS requeued FROM l""")
def batch_leases(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("batch"), (F.col("event_id") % 3).alias("worker"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(_KINDS).alias("kind"))
    out = control.leases(spark, e, 240)
    return out.select("batch", "worker", "claim", _shown("since"), _shown("until"), "ended", "refused", "requeued")
