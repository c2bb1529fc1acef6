"""What an account sees of its sites over time: deltas, progress, proposals and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import classify as c
from crawlwright.functions import text as t
from crawlwright.functions import urls as u

#: What an account lists at most.
SITES, NEXT_ITEMS, PROPOSALS, LISTED = 4, 6, 25, 20


def issue_key() -> Column:
    """How a finding is recognised in another report: type, title, page and source, without case and blanks."""
    return F.concat_ws("|", F.coalesce("type", F.lit("")), t.lower_squeezed(F.col("title")), u.page_key(F.col("page_url")), t.lower_squeezed(F.col("source")))


def delta(current: DataFrame, previous: DataFrame, by: str) -> DataFrame:
    """(by, key, status, title, severity, previous_severity, evidence, previous_evidence): findings of two reports of each site. fixed ones
    are the previous report's, new and persistent ones the current one's; a persistent one carries what it was before. Findings are
    by, seq, type, title, page_url, source, severity, evidence; good ones don't count. A finding that occurs twice stays twice;
    what it was before is the first previous one's."""
    rows = lambda d: d.filter("severity <> 'good'").withColumn("key", issue_key())
    now, before = rows(current), rows(previous)
    first = before.groupBy(by, "key").agg(F.min_by(F.struct("severity", "evidence"), "seq").alias("_b"))
    still = now.join(first, [by, "key"], "left")
    seen = F.col("_b").isNotNull()
    a = still.select(by, "key", F.when(seen, "persistent").otherwise("new").alias("status"), "title", "severity", F.coalesce("_b.severity", F.lit("")).alias("previous_severity"), "evidence", F.coalesce("_b.evidence", F.lit("")).alias("previous_evidence"))
    gone = before.join(now.select(by, "key").distinct(), [by, "key"], "left_anti")
    empty = F.lit("")
    return a.unionByName(gone.select(by, "key", F.lit("fixed").alias("status"), "title", "severity", empty.alias("previous_severity"), "evidence", empty.alias("previous_evidence")))


def delta_summary(rows: DataFrame, by: str) -> DataFrame:
    """(by, fixed, new, persistent, issues_delta, critical_delta, warning_delta, notice_delta, text) of delta()."""
    n = lambda s: F.count_if(F.col("status") == s)
    now, before = F.col("status") != "fixed", F.col("status") != "new"
    was = F.when(F.col("status") == "fixed", F.col("severity")).otherwise(F.col("previous_severity"))
    change = lambda s: (F.count_if(now & (F.col("severity") == s)) - F.count_if(before & (was == s))).alias(f"{s}_delta")
    g = rows.groupBy(by).agg(n("fixed").alias("fixed"), n("new").alias("new"), n("persistent").alias("persistent"), (n("new") - n("fixed")).alias("issues_delta"), *map(change, ("critical", "warning", "notice")))
    return g.withColumn("text", F.concat(F.when(F.col("issues_delta") > 0, "+").otherwise(""), F.col("issues_delta").cast("string")))


def progress(reports: DataFrame, schedules: DataFrame, by: str, top: int = SITES) -> DataFrame:
    """(by, host, checks, score_now, score_change, issues_now, issues_change, since, latest, next_check, nth): each account's sites by
    their latest report. A site is shown by its page with the most reports, of equal ones the one with the newest.

    reports: by, url, score, issues, created_at, id. schedules: by, url, status, next_at. First and last come from one aggregation.
    """
    r = reports.withColumn("_page", u.page_key(F.col("url"))).withColumn("host", u.site(F.col("url"))).filter("host <> ''")
    order = F.struct("created_at", "id")
    pages = r.groupBy(by, "host", "_page").agg(
        F.count("*").alias("checks"),
        F.min_by(F.struct("score", "issues", "created_at"), order).alias("_first"),
        F.max_by(F.struct("score", "issues", "created_at"), order).alias("_last"),
    )
    best = W.partitionBy(by, "host").orderBy(F.desc("checks"), F.desc("_last.created_at"), "_page")
    latest = F.max("_last.created_at").over(W.partitionBy(by, "host"))
    pages = pages.withColumn("_n", F.row_number().over(best)).withColumn("latest", latest).filter("_n = 1")
    live = schedules.filter("status is null or status in ('', 'active')").groupBy(by, u.site(F.col("url")).alias("host")).agg(F.min("next_at").alias("next_check"))
    out = pages.join(live, [by, "host"], "left")
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc("latest"), "host"))
    change = lambda k: (F.col(f"_last.{k}") - F.col(f"_first.{k}")).alias(f"{k}_change")
    return out.withColumn("nth", nth).filter(F.col("nth") <= top).select(by, "host", "checks", F.col("_last.score").alias("score_now"), change("score"), F.col("_last.issues").alias("issues_now"), change("issues"), F.col("_first.created_at").alias("since"), "latest", "next_check", "nth")


def actionable(status: Column, title: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") & ~F.coalesce(status, F.lit("")).isin("fixed", "ignored")


def awaiting_apply(status: Column, rerun: Column, approval: Column, execution: Column) -> Column:
    none = F.lit("")
    return (rerun == "not_run") & ~status.isin("applied", "fixed", "ignored", "regressed") & (F.coalesce(execution, none) != "applied") & ((F.coalesce(approval, none) == "approved") | (status == "approved"))


def needs_rerun(status: Column, rerun: Column, execution: Column) -> Column:
    return ~status.isin("fixed", "regressed") & (rerun == "not_run") & ((status == "applied") | (F.coalesce(execution, F.lit("")) == "applied"))


#: The next action of a repair, by rank.
NEXT = {0: "review", 1: "approve", 2: "apply", 3: "rerun", 4: "continue", 5: "start"}


def next_rank(status: Column, rerun: Column, approval: Column, execution: Column) -> Column:
    """What a repair waits for: 0 a look at what came back, 1 an approval, 2 to be applied, 3 a rerun, 4 to go on, 5 a start."""
    none = F.lit("")
    approval, execution = F.coalesce(approval, none), F.coalesce(execution, none)
    return (
        F.when((status == "regressed") | rerun.isin("regressed", "still_open", "new"), 0)
        .when((approval == "drafted") | (status == "drafted"), 1)
        .when((execution == "applied") | (status == "applied"), 3)
        .when((approval == "approved") | (status == "approved"), 2)
        .when(status == "in_progress", 4)
        .otherwise(5)
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "notice", 2).otherwise(3)


def feed(items: DataFrame, by: str, top: int = NEXT_ITEMS) -> DataFrame:
    """(by, report, item, rank, action, nth): what an account should do next. items: by, url, report, created_at, item, title, severity, status,
    rerun, approval, execution, priority. Of the reports of one address only the latest counts."""
    key = u.account_key(F.col("url"))
    last = items.groupBy(by, key.alias("_k")).agg(F.max_by("report", F.struct("created_at", "report")).alias("_last"))
    rows = items.withColumn("_k", key).join(last, [by, "_k"]).filter("report = _last").filter(actionable(F.col("status"), F.col("title")))
    rows = rows.withColumn("rank", next_rank(F.col("status"), F.col("rerun"), F.col("approval"), F.col("execution")))
    order = W.partitionBy(by).orderBy("rank", severity_rank(F.col("severity")), "priority", "report", "item")
    action = F.coalesce(*[F.when(F.col("rank") == k, v) for k, v in NEXT.items()])
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top).select(by, "report", "item", "rank", action.alias("action"), "nth")


def account_counts(items: DataFrame, by: str) -> DataFrame:
    """Counts of an account's repairs by state, and of those that wait for an approval, to be applied, and for a rerun."""
    s = F.col("status")
    n = lambda cond, name: F.count_if(cond).alias(name)
    rows = items.filter(actionable(s, F.col("title")))
    return rows.groupBy(by).agg(
        F.count("*").alias("total"),
        *[n(s == k, k) for k in ("open", "in_progress", "drafted", "approved", "applied", "regressed")],
        n((F.coalesce("approval", F.lit("")) == "drafted") | (s == "drafted"), "awaiting_approval"),
        n(awaiting_apply(s, F.col("rerun"), F.col("approval"), F.col("execution")), "approved_actions"),
        n(needs_rerun(s, F.col("rerun"), F.col("execution")), "awaiting_rerun"),
    )


def proposals(items: DataFrame, by: str, top: int = PROPOSALS) -> DataFrame:
    """(by, nth, title, page_url, severity, mode): a report's findings and plan rows as proposals, once for each title and page, the graver and
    earlier first. items: by, kind (finding before plan), seq, priority, title, page_url, severity, fix, snippet, source, work."""
    rows = items.filter("title <> '' and severity <> 'good'").withColumn("_slug", F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 70), F.lit("")), F.lit("repair")))
    order = [severity_rank(F.col("severity")), "priority", "kind", "seq"]
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(by, "_slug", "page_url").orderBy(*order))).filter("_n = 1")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("nth") <= top)
    mode = c.repair_mode(F.col("title"), F.col("fix"), F.col("snippet"), F.col("source"), F.col("work"))
    return rows.select(by, "nth", "title", "page_url", "severity", mode.alias("mode"))


def grouped_fixes(plan: DataFrame, by: str) -> DataFrame:
    """(by, pattern_key, severity, pages, findings, gain, snippet, first): a fix for all pages that have a problem: its gravest severity, pages, largest
    gain and first snippet. plan: by, priority, pattern_key, severity, page_id, score_gain, snippet."""
    rank = severity_rank(F.col("severity"))
    return plan.groupBy(by, "pattern_key").agg(
        F.min_by("severity", F.struct(rank, "priority")).alias("severity"),
        F.count_distinct("page_id").alias("pages"),
        F.count("*").alias("findings"),
        F.max("score_gain").alias("gain"),
        F.min_by("snippet", F.when(F.coalesce("snippet", F.lit("")) != "", F.col("priority"))).alias("snippet"),
        F.min("priority").alias("first"),
    )


def fix_pack(snippets: DataFrame, by: str) -> DataFrame:
    """snippets (by, seq, snippet) that a pack holds: each snippet once, where it came first, numbered."""
    rows = snippets.filter("snippet <> ''").withColumn("_n", F.row_number().over(W.partitionBy(by, "snippet").orderBy("seq"))).filter("_n = 1").drop("_n")
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy("seq")))


def merged_plans(plans: DataFrame, by: str) -> DataFrame:
    """Plans of several sources (by, source_seq, priority, ...) as one: one after another, numbered anew, not sorted again."""
    return plans.withColumn("priority", F.row_number().over(W.partitionBy(by).orderBy("source_seq", "priority")))


def remediation(plan: DataFrame, findings: DataFrame, by: str, top: int = 8) -> DataFrame:
    """(by, nth, plan_title, finding): the first plan rows with the finding each stands for: by its id, else by title and page, the
    first of several. plan: by, priority, issue_id, title, page_url. findings: by, seq, id, title, page_url."""
    ids = findings.groupBy(by, F.col("id").alias("issue_id")).agg(F.min_by("id", "seq").alias("_a"))
    named = findings.groupBy(by, "title", "page_url").agg(F.min_by("id", "seq").alias("_b"))
    rows = plan.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy("priority"))).filter(F.col("nth") <= top)
    rows = rows.join(ids, [by, "issue_id"], "left").join(named, [by, "title", "page_url"], "left")
    return rows.select(by, "nth", F.col("title").alias("plan_title"), F.coalesce("_a", "_b").alias("finding"))


def last_points(history: DataFrame, by: str, at: str, key: str, n: int) -> DataFrame:
    """The last n rows of each group, oldest first: place counts from 1."""
    own = W.partitionBy(by)
    rows = history.withColumn("_back", F.row_number().over(own.orderBy(F.desc(at), F.desc(key)))).filter(F.col("_back") <= n)
    return rows.withColumn("place", F.row_number().over(own.orderBy(F.desc("_back")))).drop("_back")
