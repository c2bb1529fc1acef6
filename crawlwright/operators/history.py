"""What became of a site's issues from report to report, and whether a later report proves a repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.functions import urls as u

SEVERITIES = ["critical", "warning", "notice"]
#: Findings that one task gets, on the average.
TASK_ROWS = 1 << 19


def numbered_reports(reports: DataFrame, by: str) -> DataFrame:
    """reports (by, report, at, ...) with n, their number in their site from 1 by time, and latest, that of the site's last. A row a report, so a window by site holds its reports alone."""
    line = W.partitionBy(by).orderBy("at", "report")
    return reports.withColumn("n", F.row_number().over(line)).withColumn("latest", F.count("*").over(W.partitionBy(by)))


def _listed(findings: DataFrame) -> tuple[DataFrame, int]:
    """The findings that count, and the number of tasks among which they are dealt: it follows their number, so what one task holds doesn't grow with them."""
    listed = findings.filter("key is not null and severity <> 'good'")
    return listed, max(listed.sparkSession.sparkContext.defaultParallelism, -(-listed.count() // TASK_ROWS))


def _issues(numbered: DataFrame, listed: DataFrame, tasks: int, by: str, sums: list[Column], again: list[Column]) -> DataFrame:
    """(by, key, n, latest, sums): each issue of each known report once, with sums over its findings; dealt by site and issue. again: sums over sums of the same names.

    Findings are summed up for each part of the input first, so a report or an issue that has most of them isn't one task.
    """
    on = [by, "report"] if by in listed.columns else ["report"]
    own = [*on, "key", "_part"]
    parts = listed.withColumn("_part", F.spark_partition_id()).repartition(tasks, *own).groupBy(*own).agg(*sums).drop("_part")
    once = parts.repartition(tasks, *on).groupBy(*on, "key").agg(*again)
    known = numbered.filter(F.col(by).isNotNull()).select(by, "report", "n", "latest")
    return once.join(known, on).drop("report").repartition(tasks, by, "key")


def issue_runs(numbered: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """(by, key, run, severity, first, last, fixed): the runs of reports in a row that have an issue. first and last are report numbers, fixed the
    number of the first report without it, null if it is still there; run counts from 1, so a run over 1 is an issue that came back.

    findings: report, key, severity, and by unless a report's name tells its site; several of one key in a report count once, with the gravest severity. They are
    read twice, so what is costly to make should be a written table. All pairs of neighbouring
    reports are compared at once: an issue's report numbers that follow each other without a gap are one run, so nothing is joined a pair
    at a time, and a window holds one issue of one site. Findings of unknown reports, or without a key, are left out.
    """
    listed, tasks = _listed(findings)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = F.min_by("severity", F.when(rank == 0, 9).otherwise(rank)).alias("severity")
    rows = _issues(numbered, listed, tasks, by, [worst], [worst])
    line = W.partitionBy(by, "key").orderBy("n")
    rows = rows.withColumn("_new", F.coalesce(F.col("n") > F.lag("n").over(line) + 1, F.lit(True))).withColumn("run", F.sum(F.col("_new").cast("int")).over(line))
    runs = rows.groupBy(by, "key", "run").agg(F.max_by("severity", "n").alias("severity"), F.min("n").alias("first"), F.max("n").alias("last"), F.first("latest").alias("_latest"))
    return runs.withColumn("fixed", F.when(F.col("last") < F.col("_latest"), F.col("last") + 1)).drop("_latest")


def report_deltas(numbered: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """(by, report, n, status, score_before, score_delta, issues, new, returned, fixed, persistent, critical_delta, warning_delta, notice_delta): every report against the one
    before; the first of a site is a first_run, whose changes are null. returned are those of the new that an older report had. findings as for issue_runs().

    One window over a site's issue tells, from the reports before and after that have it, whether it is new, came back or is gone in the next; that and the counts are summed by report.
    """
    listed, tasks = _listed(findings)
    issues = _issues(numbered, listed, tasks, by, [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], [F.sum(s).alias(s) for s in SEVERITIES])
    line = W.partitionBy(by, "key").orderBy("n")
    n = F.col("n")
    issues = issues.withColumns({"_before": F.lag("n").over(line), "_after": F.lead("n").over(line)})
    back = F.coalesce(F.col("_before") < n - 1, F.lit(False))
    here = {"n": n, "issues": F.lit(1), "new": (back | F.col("_before").isNull()).cast("int"), "returned": back.cast("int"), "fixed": F.lit(0)} | {s: F.col(s) for s in SEVERITIES}
    gone = {k: F.lit(0) for k in ("issues", "new", "returned")} | {"n": n + 1, "fixed": F.lit(1)} | {s: F.lit(0).cast("long") for s in SEVERITIES}
    both = [F.struct(*[x[k].alias(k) for k in here]) for x in (here, gone)]
    moved = issues.select(by, F.inline(F.when(F.col("_after") == n + 1, F.array(both[0])).otherwise(F.array(*both))))
    sums = [k for k in here if k != "n"]
    moved = moved.repartition(tasks, by, "n").groupBy(by, "n").agg(*[F.sum(c).alias(c) for c in sums])
    rows = numbered.repartition(tasks, by, "n").join(moved, [by, "n"], "left").fillna(0, sums).repartition(tasks, by)
    line = W.partitionBy(by).orderBy("n")
    first = F.col("n") == 1
    later: dict[str, Column] = {c: F.when(~first, F.col(c)) for c in ("new", "returned", "fixed")}
    later |= {f"{s}_delta": F.col(s) - F.lag(s).over(line) for s in SEVERITIES}
    later |= {"status": F.when(first, "first_run").otherwise("ready"), "score_before": F.lag("score").over(line), "score_delta": F.col("score") - F.lag("score").over(line), "persistent": F.when(~first, F.col("issues") - F.col("new"))}
    rows = rows.withColumns(later)
    return rows.select(by, "report", "n", "status", "score_before", "score_delta", "issues", "new", "returned", "fixed", "persistent", *[f"{s}_delta" for s in SEVERITIES])


def regressions(deltas: DataFrame, monitored: DataFrame, by: str) -> DataFrame:
    """deltas() of monitored reports (by, report) that are worse than the report before: new issues, or more critical ones or warnings."""
    worse = F.expr("status = 'ready' and (new > 0 or critical_delta > 0 or warning_delta > 0)")
    return deltas.join(monitored.select(by, "report"), [by, "report"], "left_semi").filter(worse)


def proof_url(url: Column) -> Column:
    """The address that pages of a proof are matched by: site and path, without query and the path's last slash; a text that isn't one in lower case."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    or_null = lambda x: F.nullif(x, F.lit(""))
    path = F.coalesce(or_null(F.regexp_replace(u.part(trimmed, 3), "/$", "")), F.lit("/"))
    return F.coalesce(F.concat(or_null(u.site(trimmed)), path), t.lower_squeezed(trimmed))


def _with_keys(rows: DataFrame) -> DataFrame:
    """rows with _page, _id and _key, how an issue is recognised in a proof: type, title, page and source; empty without a title. Each is made once a row."""
    rows = rows.withColumns({"_page": proof_url(F.col("page_url")), "_title": t.lower_squeezed(F.col("title")), "_id": F.trim(F.coalesce("id", F.lit("")))})
    key = F.concat_ws("|", t.lower_squeezed(F.col("type")), "_title", "_page", t.lower_squeezed(F.col("source")))
    return rows.withColumn("_key", F.when(F.col("_title") == "", F.lit("")).otherwise(key)).drop("_title")


def proved(actions: DataFrame, issues: DataFrame, pages: DataFrame) -> DataFrame:
    """(action, stage, proved): whether a later report proves what an action says, and what did.

    actions: action, proof (the later report), state, id, type, title, page_url, source of the issue. issues: proof, origin (current or fixed), id, type, title,
    page_url, source. pages: proof, url, the proof's own address among them. Two issues are the same if their keys are; if either has no key (no title), if their ids are. An action
    that says fixed is proved by a fixed issue, or if no current issue is the same and the proof covers the page (an issue without a page is covered);
    any other by a current issue. stage: key, id or page, the first that proves it; null if none does.

    What can prove an action is a set of marks of its proof, and so is what an action looks for: one join on proof and
    mark, and one grouping by action, whatever the stages. An action without a proof is not proved; repeated actions are one row.
    """
    mark = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    key, id_, page = F.col("_key"), F.col("_id"), F.col("_page")
    has = lambda c: c != ""
    offers = F.array_compact(F.array(F.when(has(key), mark("key", key)), F.when(has(id_), mark("id", id_)), F.when(has(id_) & ~has(key), mark("bare id", id_))))
    have = _with_keys(issues).select("proof", "origin", F.explode(offers).alias("m")).unionByName(pages.select("proof", F.lit("page").alias("origin"), mark("page", proof_url(F.col("url"))).alias("m")))
    have = have.groupBy("proof", "m").agg(*[F.max(F.col("origin") == o).alias(o) for o in ("current", "fixed", "page")])
    seeks = F.array_compact(F.array(F.when(has(key), mark("key", key)), F.when(has(id_), F.when(has(key), mark("bare id", id_)).otherwise(mark("id", id_))), F.when(has(page), mark("page", page)), mark("none", F.lit(""))))
    asked = _with_keys(actions).select("action", "proof", F.lower(F.trim(F.coalesce("state", F.lit("")))).alias("state"), (~has(page)).alias("_free"), F.explode(seeks).alias("m"))
    kind = F.col("m.kind")
    hit = lambda o, by_key: F.max(F.coalesce(F.col(o) & ((kind == "key") if by_key else kind.isin("id", "bare id")), F.lit(False)))
    found = asked.join(have, ["proof", "m"], "left").groupBy("action", "proof", "state").agg(
        hit("fixed", True).alias("fk"), hit("fixed", False).alias("fi"), hit("current", True).alias("ck"), hit("current", False).alias("ci"), (F.max("_free") | F.max(F.coalesce(F.col("page") & (kind == "page"), F.lit(False)))).alias("covered")
    )
    fixed, there = F.col("state") == "fixed", F.col("ck") | F.col("ci")
    stage = F.when(fixed & F.col("fk") | ~fixed & F.col("ck"), "key").when(fixed & F.col("fi") | ~fixed & F.col("ci"), "id").when(fixed & ~there & F.col("covered"), "page")
    return found.select("action", F.when(F.col("proof").isNotNull(), stage).alias("stage")).withColumn("proved", F.col("stage").isNotNull())
