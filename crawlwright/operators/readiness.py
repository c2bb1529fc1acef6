"""How ready sites are to be quoted in answers, and how they stand among competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import urls as u

#: Structured data that helps, that a home page should have, and signs of questions.
HELPFUL_TYPES = ["article", "blogposting", "breadcrumblist", "faqpage", "howto", "localbusiness", "organization", "product", "service", "softwareapplication"]
QUESTION_TYPES = ["faqpage", "howto"]
HOME_TYPES = ["Organization", "WebSite", "Product", "Service", "LocalBusiness", "FAQPage", "SoftwareApplication"]
QUESTIONS = [
    r"\?$",
    r"(?i)\bfaq\b",
    r"(?i)\bfrequently asked\b",
    r"(?i)\bhow (do|does|to|much|many)\b",
    r"(?i)\bwhat (is|are|does|do)\b",
    r"(?i)\bwhy (does|do|is|are)\b",
    r"(?i)\bwhen (should|do|does|is)\b",
]
HOME_SECTIONS = ["faq", "frequently asked", "how it works", "pricing", "compare", "comparison", "why", "what is", "who is"]
ENOUGH_WORDS, SHELL_WORDS, SHELL_STATIC_WORDS = 250, 160, 80
#: What each shortcoming costs.
COSTS = {"thin": 28, "unstructured": 16, "unclear": 18, "unanswering": 10, "no_llms_txt": 4, "search_blocked": 40, "answers_blocked": 24}
#: The checks' findings in their order: check, severity and title.
FINDINGS = [
    (69, "thin", "warning", "AI Answer Readiness: rendered pages lack extractable detail"),
    (70, "unstructured", "notice", "AI Answer Readiness: helpful structured data was not proven"),
    (71, "unclear", "warning", "AI Answer Readiness: preferred source pages are unclear"),
    (72, "unanswering", "notice", "AI Answer Readiness: question-led sections are missing"),
    (73, "answers_blocked", "warning", "AI Answer Readiness: AI search crawlers blocked in robots.txt"),
    (74, "no_llms_txt", "notice", "AI Answer Readiness: optional llms.txt is not reachable"),
]


def indexable(robots: Column, status: Column | None = None) -> Column:
    """Pages that may be found: an answer of 200 to 299, or one not known, without noindex."""
    fine = ~F.lower(F.coalesce(robots, F.lit(""))).contains("noindex")
    return fine if status is None else fine & ((F.coalesce(status, F.lit(0)) == 0) | status.between(200, 299))


def _types() -> Column:
    return F.transform(F.flatten(F.transform("schema_types", lambda x: F.split(x, ","))), lambda x: F.lower(F.trim(x)))


def helpful_schema() -> Column:
    return F.arrays_overlap(_types(), F.array(*map(F.lit, HELPFUL_TYPES)))


def asks(s: Column) -> Column:
    found = F.lit(False)
    for pattern in QUESTIONS:
        found = found | s.rlike(pattern)
    return found


def question_structure() -> Column:
    """A type for questions, a heading that asks one, or title, description and the text's beginning that do."""
    combined = F.concat_ws(" ", F.substring("title", 1, 180), F.substring("description", 1, 220), F.substring("body_text", 1, 4000))
    return F.arrays_overlap(_types(), F.array(*map(F.lit, QUESTION_TYPES))) | F.exists("headings", asks) | asks(combined)


def readiness(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(host, pages, checked, thin, shells, helpful, with_canonical, isolated, asking, sectioned, failed, score) from facts of
    pages; those with noindex count as pages, but are not checked.

    sites: (host, llms_txt, search_blocked, answers_blocked) as the discovery files say; without a row a site has no llms.txt
    and nothing blocked. Any number of pages a site: one aggregation with partial sums. Pages may have static_words.
    """
    ok = indexable(F.col("robots"), F.col("status") if "status" in pages.columns else None)
    static = F.col("static_words") if "static_words" in pages.columns else F.col("word_count")
    n = lambda c, name: F.count_if(ok & c).alias(name)
    g = pages.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(ok).alias("checked"),
        n(F.col("word_count") < ENOUGH_WORDS, "thin"),
        n((static < SHELL_STATIC_WORDS) & (F.col("word_count") < SHELL_WORDS), "shells"),
        n(helpful_schema(), "helpful"),
        n(F.col("canonical") != "", "with_canonical"),
        n(F.col("inner_links") == 0, "isolated"),
        n(question_structure(), "asking"),
        n(F.size("headings") >= 3, "sectioned"),
    )
    flags = {"llms_txt": F.lit(False), "search_blocked": F.lit(False), "answers_blocked": F.lit(False)}
    g = g.withColumns(flags) if sites is None else g.join(sites.select("host", *flags), "host", "left").withColumns({k: F.coalesce(k, v) for k, v in flags.items()})
    some = F.col("checked") > 0
    failed = {
        "thin": F.col("thin") > 0,
        "unstructured": some & (F.col("helpful") == 0),
        "unclear": (F.col("with_canonical") < F.col("checked")) | (F.col("isolated") > 0),
        "unanswering": some & (F.col("asking") == 0) & (F.col("sectioned") == 0),
        "no_llms_txt": ~F.col("llms_txt"),
        "search_blocked": F.col("search_blocked"),
        "answers_blocked": F.col("answers_blocked") & ~F.col("search_blocked"),
    }
    cost = sum((F.when(c, COSTS[k]).otherwise(0) for k, c in failed.items()), F.lit(0))
    return g.withColumn("failed", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()]))).withColumn("score", F.greatest(F.lit(0), 100 - cost))


def readiness_findings(ready: DataFrame) -> DataFrame:
    """(host, rule_seq, severity, title) of readiness()'s rows. Unclear sources are a notice where each page has its canonical address."""
    soft = lambda k, severity: F.when(F.lit(k == "unclear") & (F.col("with_canonical") == F.col("checked")), F.lit("notice")).otherwise(F.lit(severity))
    one = lambda seq, k, severity, title: F.when(F.array_contains("failed", k), F.struct(F.lit(seq).alias("rule_seq"), soft(k, severity).alias("severity"), F.lit(title).alias("title")))
    return ready.select("host", F.explode(F.array_compact(F.array(*[one(*x) for x in FINDINGS]))).alias("f")).select("host", "f.*")


def affected(pages: DataFrame, traffic: DataFrame) -> DataFrame:
    """(host, rule_seq, page_id, clicks, impressions, nth): the pages behind findings 69 to 72, the busiest first.

    traffic: page_url, clicks, impressions of imported rows, summed by page. A finding lists its first ten pages, as reports do.
    """
    least = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    t = traffic.select(u.traffic_key(F.col("page_url")).alias("k"), least("clicks"), least("impressions")).groupBy("k").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    which = F.array_compact(
        F.array(
            F.when(F.col("word_count") < ENOUGH_WORDS, 69),
            F.when(~helpful_schema(), 70),
            F.when((F.col("canonical") == "") | (F.col("inner_links") == 0), 71),
            F.when(~question_structure() & (F.col("word_count") >= ENOUGH_WORDS), 72),
        )
    )
    rows = pages.filter(indexable(F.col("robots"))).select("host", "page_id", "page_seq", u.traffic_key(F.col("url")).alias("k"), F.explode(which).alias("rule_seq"))
    first = F.row_number().over(W.partitionBy("host", "rule_seq").orderBy("page_seq"))
    rows = rows.withColumn("_listed", first).filter(F.col("_listed") <= 10).drop("_listed")
    rows = rows.join(t, "k", "left").fillna(0, ["clicks", "impressions"])
    nth = F.row_number().over(W.partitionBy("host", "rule_seq").orderBy(F.desc("clicks"), F.desc("impressions"), "page_seq"))
    return rows.select("host", "rule_seq", "page_id", "clicks", "impressions", nth.alias("nth"))


def geo(pages: DataFrame) -> DataFrame:
    """(host, crawlable, entity, answers, useful, internal, passed, repairs) of each site's home page, page_seq 1.

    repairs are the titles of what fails, in the order reports list them."""
    joined = F.lower(F.array_join("headings", " "))
    answers = F.lit(False)
    for words in HOME_SECTIONS:
        answers = answers | joined.contains(words)
    checks = {
        "crawlable": F.col("word_count") >= ENOUGH_WORDS,
        "entity": (F.col("title") != "") & (F.col("description") != "") & (F.col("h1_count") > 0),
        "answers": answers,
        "useful": F.arrays_overlap("schema_types", F.array(*map(F.lit, HOME_TYPES))),
        "internal": F.col("inner_links") > 0,
    }
    rows = pages.filter("page_seq = 1").select("host", *[c.alias(k) for k, c in checks.items()])
    passed = sum((F.col(k).cast("int") for k in checks), F.lit(0))
    titles = [("entity", "SEO/GEO entity clarity needs cleanup"), ("answers", "Add answer-ready sections for buyer questions"), ("useful", "Add truthful entity schema where useful"), ("crawlable", "Make core answer content crawlable")]
    return rows.withColumn("passed", passed).withColumn("repairs", F.array_compact(F.array(*[F.when(~F.col(k), F.lit(title)) for k, title in titles])))


def benchmark(sites: DataFrame, by: str, target: str) -> DataFrame:
    """Of each group (by) the target's rank by score, the others' rounded average, the best and the gap to it.
    sites: by, host, score and the boolean column `target`. Ties go to the target, then by host."""
    w = W.partitionBy(by).orderBy(F.desc("score"), F.desc(target), "host")
    rows = sites.withColumn("place", F.row_number().over(w))
    other = ~F.col(target)
    best = F.max_by(F.when(other, F.col("host")), F.when(other, -F.col("place")))
    g = rows.groupBy(by).agg(
        F.count_if(other).alias("competitors"),
        F.max(F.when(F.col(target), F.col("place"))).alias("target_rank"),
        F.max(F.when(F.col(target), F.col("score"))).alias("target_score"),
        F.floor(F.avg(F.when(other, F.col("score"))) + 0.5).alias("average"),
        best.alias("best_host"),
        F.max(F.when(other, F.col("score"))).alias("best_score"),
    )
    return g.withColumn("gap", F.greatest(F.lit(0), F.col("best_score") - F.col("target_score")))


def missing_areas(target: DataFrame, competitors: DataFrame, by: str) -> DataFrame:
    """Issue areas that the target has and a competitor lacks, with those competitors: an anti join by area."""
    pairs = target.select(by, "area").distinct().join(competitors.select(by, "host").distinct(), by)
    return pairs.join(competitors.select(by, "host", "area").distinct(), [by, "host", "area"], "left_anti").groupBy(by, "area").agg(F.sort_array(F.collect_set("host")).alias("hosts"))
