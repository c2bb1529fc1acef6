"""What reports answer beside their findings: grouped fixes for a prompt, the repair that a fix pack takes, boards, plugins, crawlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.operators.platforms import plugin_name
from crawlwright.sources import robots

#: Problems in a prompt, and characters of a list of pages.
PROBLEMS, PAGES_TEXT = 5, 600
#: Crawlers whose access is shown: agent, product, purpose.
CRAWLERS = [
    ("Googlebot", "Google Search", "search"),
    ("Bingbot", "Bing", "search"),
    ("OAI-SearchBot", "ChatGPT search", "answers"),
    ("ChatGPT-User", "ChatGPT", "answers"),
    ("PerplexityBot", "Perplexity", "answers"),
    ("Claude-SearchBot", "Claude search", "answers"),
    ("Claude-User", "Claude", "answers"),
    ("GPTBot", "OpenAI model training", "training"),
    ("ClaudeBot", "Anthropic model training", "training"),
    ("Google-Extended", "Gemini training", "training"),
    ("Applebot-Extended", "Apple Intelligence training", "training"),
    ("CCBot", "Common Crawl", "training"),
]


def clipped(s: Column, most: int) -> Column:
    trimmed = F.trim(F.coalesce(s, F.lit("")))
    return F.when(F.length(trimmed) <= most, trimmed).otherwise(F.concat(F.substring(trimmed, 1, most - 1), F.lit("…")))


def fix_groups(plan: DataFrame, by: str, limit: int = PROBLEMS) -> DataFrame:
    """(by, nth, title, pages, n, severity): the first `limit` different problems of each plan (by, priority, title, pattern_key, severity, page), for a prompt.

    The same problem on several pages is one, named by its pattern with their number, and lists them up to PAGES_TEXT characters. A page
    takes two characters of the list at least, so only that many of a group are ever put together, however many it has.
    """
    groups = plan.groupBy(by, "pattern_key").agg(F.count("*").alias("n"), F.min_by(F.struct("priority", "title", "severity"), "priority").alias("lead"))
    nth = F.row_number().over(W.partitionBy(by).orderBy("lead.priority"))
    groups = groups.withColumn("nth", nth).filter(F.col("nth") <= limit)
    pages = plan.filter("coalesce(page, '') <> ''").select(by, "pattern_key", "priority", "page")
    pages = pages.withColumn("_k", F.row_number().over(W.partitionBy(by, "pattern_key").orderBy("priority"))).filter(F.col("_k") <= PAGES_TEXT // 2 + 1)
    listed = pages.groupBy(by, "pattern_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "page"))), lambda x: x["page"]), ", ").alias("pages"))
    title = F.when(F.col("n") > 1, F.concat("pattern_key", F.lit(" ("), F.col("n").cast("string"), F.lit(" pages)"))).otherwise(F.col("lead.title"))
    return groups.join(listed, [by, "pattern_key"], "left").select(by, "nth", title.alias("title"), clipped(F.col("pages"), PAGES_TEXT).alias("pages"), "n", "lead.severity")


def selected_repair(items: DataFrame, requests: DataFrame, by: str) -> DataFrame:
    """(by, queue_id, issue_id, title, conflict): the repair that a fix pack takes. items: by, place, queue_id, issue_id, title, status. requests: by, queue_id, issue_id.

    A request names a queue item, an issue, or both, which then must be one item; without names it is the first active one. An item that
    is fixed or ignored, or has no id, isn't active. A name that no active item has is a conflict and selects nothing. Requests
    without active items select nothing; several of one account count once. Of items in one place the least queue_id, issue_id and title counts;
    place may be a struct, where more than a number decides.
    """
    active = items.filter("coalesce(queue_id, '') <> '' and not coalesce(lower(trim(status)), '') in ('fixed', 'ignored')")
    asked = requests.groupBy(by).agg(F.coalesce(F.max("queue_id"), F.lit("")).alias("_q"), F.coalesce(F.max("issue_id"), F.lit("")).alias("_i"))
    met = asked.join(active.select(by, "place", "queue_id", "issue_id", "title"), by, "left")
    fits = ((F.col("_q") == "") | (F.col("queue_id") == F.col("_q"))) & ((F.col("_i") == "") | (F.col("issue_id") == F.col("_i"))) & F.col("queue_id").isNotNull()
    found = met.groupBy(by, "_q", "_i").agg(F.min_by(F.when(fits, F.struct("queue_id", "issue_id", "title")), F.when(fits, F.struct("place", "queue_id", "issue_id", "title"))).alias("s"))
    named = (F.col("_q") != "") | (F.col("_i") != "")
    return found.select(by, "s.queue_id", "s.issue_id", "s.title", (named & F.col("s").isNull()).alias("conflict"))


def with_collaboration(queue: DataFrame, issues: DataFrame, by: str) -> DataFrame:
    """queue (by, issue_id, ...) with assignee, note, collaboration_status of its issue; empty where nobody collaborates. issues: by, issue_id, seq, assignee,
    note, status; of several of one issue the last counts."""
    last = issues.groupBy(by, "issue_id").agg(F.max_by(F.struct("assignee", "note", "status"), "seq").alias("_c"))
    text = lambda c: F.coalesce(F.col(f"_c.{c}"), F.lit(""))
    return queue.join(last, [by, "issue_id"], "left").withColumns({"assignee": text("assignee"), "note": text("note"), "collaboration_status": text("status")}).drop("_c")


def render_blocking(status: Column, kind: Column, start_ms: Column, loaded_ms: Column) -> Column:
    """Whether a resource holds back the first paint: what the browser said, else a script or stylesheet that starts before the page is
    loaded, which counts as 1,500 ms at least. loaded_ms: when the document was ready; null or 0 if that isn't known."""
    said = F.lower(F.coalesce(status, F.lit("")))
    early = F.coalesce(start_ms <= F.greatest(F.lit(1500), F.coalesce(loaded_ms, F.lit(0))), F.lit(False))
    return F.when(said == "blocking", True).when(said == "non-blocking", False).otherwise(F.coalesce(kind, F.lit("")).isin("script", "stylesheet") & early)


def plugin_usage(resources: DataFrame, by: str) -> DataFrame:
    """(by, plugin, resources, bytes, slow, nth): each site's plugins by their assets (by, url, bytes, duration), those with most assets first."""
    rows = resources.withColumn("plugin", plugin_name(F.col("url"))).filter("plugin <> ''")
    g = rows.groupBy(by, "plugin").agg(F.count("*").alias("resources"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("duration") >= 1000).alias("slow"))
    return g.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.desc("resources"), F.desc("bytes"), "plugin")))


def crawler_access(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, agent, product, purpose, allowed) of the known crawlers and each site's page (site, path), by its robots.txt (site, text)."""
    known = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(b).alias("product"), F.lit(c).alias("purpose")) for a, b, c in CRAWLERS])).alias("c")
    asked = pages.select("site", "path", known).select("site", "path", "c.*")
    verdict = robots.verdicts(robots.parse(files), asked.select("site", "agent", "path")).select("site", "agent", "path", "allowed")
    return asked.join(verdict, ["site", "agent", "path"]).select("site", "agent", "product", "purpose", "allowed")


def service_status(checks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: status, summary, down (their number), last_completed. checks: part, ok (null is not ok). jobs: status, completed_at."""
    parts = checks.agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("down"))
    last = jobs.agg(F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("last_completed"))
    none = F.col("down") == 0
    text = F.when(none, F.lit("All systems working")).otherwise(F.concat(F.col("down").cast("string"), F.when(F.col("down") == 1, F.lit(" part not working")).otherwise(F.lit(" parts not working"))))
    return parts.crossJoin(last).select(F.when(none, "operational").otherwise("degraded").alias("status"), text.alias("summary"), "down", "last_completed")  # two rows of one
