"""The registry of page rules, and findings as one pass over facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.functions.text import pattern_key
from crawlwright.functions.urls import sorted_key
from crawlwright.operators.order import running
from crawlwright.plans.facts import heading_jump
from crawlwright.shared import save


@dataclass(frozen=True)
class Rule:
    """seq orders a page's findings; when is SQL over a row of facts."""

    seq: int
    title: str
    severity: str
    confidence: str
    when: str
    kind: str = "issue"


#: Order, titles, severities and limits of the rules that a page's own HTML decides. In a pair
#: of rules the second holds only where the first doesn't.
RULES = [
    Rule(31, "Structured data JSON is invalid", "warning", "verified", "schema_errors > 0"),
    Rule(38, "Canonical and og:url disagree", "notice", "needs-review", "canonical <> '' and og_url <> '' and not same_canonical"),
    Rule(39, "Canonical conflicts with noindex", "critical", "verified", "canonical <> '' and lower(robots) like '%noindex%'"),
    Rule(40, "Missing or weak title", "critical", "verified", "length(title) < 12"),
    Rule(41, "Long title", "warning", "verified", "length(title) > 65"),
    Rule(42, "Missing meta description", "critical", "verified", "description = ''"),
    Rule(43, "Meta description needs tightening", "warning", "verified", "description <> '' and (length(description) < 70 or length(description) > 165)"),
    Rule(44, "Missing H1", "critical", "verified", "h1_count = 0"),
    Rule(45, "Multiple H1s", "warning", "verified", "h1_count > 1"),
    Rule(46, "Heading hierarchy needs cleanup", "warning", "needs-review", "heading_jump"),
    Rule(47, "Thin rendered content", "warning", "needs-review", "word_count < 250"),
    Rule(48, "No rendered internal links", "critical", "verified", "inner_links = 0"),
    Rule(49, "Missing canonical URL", "warning", "verified", "canonical = ''"),
    Rule(50, "Viewport meta tag missing", "warning", "verified", "viewport = ''"),
    Rule(51, "HTML language missing", "notice", "verified", "lang = ''"),
    Rule(52, "Character encoding missing", "notice", "verified", "charset = ''"),
    Rule(53, "HTML doctype missing", "notice", "verified", "not doctype"),
    Rule(54, "Noindex found", "critical", "verified", "lower(robots) like '%noindex%'"),
    Rule(56, "Social share image incomplete", "warning", "verified", "og_image = '' or twitter_image = ''"),
    Rule(58, "Apple touch icon missing", "notice", "verified", "touch_icon = ''"),
    Rule(60, "Images missing alt attributes", "warning", "needs-review", "images_without_alt > 0"),
    Rule(61, "Structured data opportunity", "notice", "verified", "forall(schema_types, t -> t = 'invalid-json')", "enhancement"),
    Rule(62, "Page is not served over HTTPS", "warning", "verified", "url like 'http:%' and host <> 'localhost'"),
]


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "notice", 2).otherwise(3)


def fired(rules: list[Rule]) -> Column:
    """The rules that fire on a row, as one array."""
    one = lambda r: F.struct(F.lit(r.seq).alias("rule_seq"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.title).alias("rule"))
    return F.array_compact(F.array(*[F.when(F.expr(r.when), one(r)) for r in rules]))


def findings(facts: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """A row per page and rule that fires, numbered within the site by page and rule.

    What fires on each page is written once; pages are then numbered by lots, so a site of any size is dealt to many tasks.
    """
    rows = facts.withColumn("heading_jump", heading_jump(F.col("levels"))).withColumn("same_canonical", sorted_key(F.col("canonical_url")) == sorted_key(F.col("og_url")))
    rows = save(rows.select("host", "page_id", "page_seq", "label", fired(rules).alias("f")), "findings")
    rows = running(rows, ["host"], "page_seq", _first=F.size("f"))
    out = rows.select("host", "page_id", "page_seq", "label", "_first", F.posexplode("f").alias("_nth", "f")).select("host", "page_id", "page_seq", "label", "f.*", (F.col("_first") + F.col("_nth") + 1).alias("finding_seq"))
    title = F.concat(F.col("rule"), F.lit(" on "), F.col("label"))
    return out.withColumn("title", title).withColumn("pattern_key", pattern_key(title))
