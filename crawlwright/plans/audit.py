"""A whole audit: pages and what was measured about them in, facts, findings, scores and plans out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.functions.text import pattern_key
from crawlwright.operators import readiness
from crawlwright.operators.order import place
from crawlwright.plans import facts as f
from crawlwright.plans import probes, rules, score
from crawlwright.shared import save

#: Site findings come after those of all pages: a page's place takes 20 bits and its number, so sites may have 2**42 pages.
AFTER_PAGES = 1 << 62
COLUMNS = ["host", "page_id", "page_seq", "label", "rule_seq", "sub", "kind", "severity", "confidence", "rule"]


@dataclass
class Measured:
    """What is known about pages besides their HTML; each table may be missing.

    checks: page_url, url, kind, ok, status, content_length, redirected, error, guarded. loads: page_id, url, final_url, redirected,
    chain_length, settled, load_ms, transfer_size. headers: page_id, headers. discovery: host, robots_ok, search_blocked, sitemap_ok,
    sitemaps_listed. speed: url, json of home pages' reports. resources: page_id, type, host, bytes, duration, first_party,
    render_blocking. images: page_id, key, url, ok, status, content_type. static: facts of the plain HTML, where pages are rendered
    ones. access: host, llms_txt, search_blocked, answers_blocked.
    """

    checks: DataFrame | None = None
    loads: DataFrame | None = None
    headers: DataFrame | None = None
    discovery: DataFrame | None = None
    speed: DataFrame | None = None
    resources: DataFrame | None = None
    images: DataFrame | None = None
    static: DataFrame | None = None
    access: DataFrame | None = None


class AuditResult:
    """The tables of an audit. Facts and findings are written once in the shared folder; the rest derives from them."""

    def __init__(self, pages: DataFrame, measured: Measured | None = None):
        self.measured = measured or Measured()
        self.facts = save(f.facts(pages), "facts")

    def _titled(self, rows: DataFrame, *, by: str = "page_id", suffix: bool = True) -> DataFrame:
        """rows of findings with the page they are on; columns that a source doesn't have get their usual values."""
        usual = {"sub": F.lit(0), "kind": F.lit("issue"), "confidence": F.lit("verified")}
        rows = rows.withColumns({k: v for k, v in usual.items() if k not in rows.columns})
        pages = self.facts.select("host", "page_id", "page_seq", "label", F.col("url").alias("page_url") if by == "page_url" else F.lit(1).alias("_"))
        out = rows.join(pages, by).drop("_")
        return out.select(*COLUMNS, F.when(F.lit(suffix), F.concat(F.col("rule"), F.lit(" on "), F.col("label"))).otherwise(F.col("rule")).alias("title"))

    @cached_property
    def findings(self) -> DataFrame:
        """A row per finding of all sources, in rule order within pages, sites' own ones last, numbered within the site."""
        from crawlwright.operators import audits

        m, facts = self.measured, self.facts
        own = facts.withColumn("heading_jump", f.heading_jump(F.col("levels"))).withColumn("same_canonical", rules.sorted_key(F.col("canonical_url")) == rules.sorted_key(F.col("og_url")))
        found = [self._titled(own.select("page_id", F.explode(rules.fired(rules.RULES)).alias("f")).select("page_id", "f.*")), self._titled(probes.hreflang_findings(facts))]
        home = facts.filter("page_seq = 1").select("page_id", "url")
        if m.checks is not None:
            found.append(self._titled(probes.probe_findings(m.checks), by="page_url"))
        if m.loads is not None:
            found.append(self._titled(probes.load_findings(m.loads)))
        if m.headers is not None:
            with_headers = facts.select("page_id", "page_seq", "url").join(m.headers.select("page_id", "headers"), "page_id")
            named = {55: "Noindex found", 63: "Basic security headers missing", 64: "HSTS security header missing"}
            rule = F.coalesce(*[F.when(F.col("rule_seq") == k, v) for k, v in named.items()])
            rows = probes.header_findings(with_headers).withColumn("rule", rule)
            meta = facts.filter(F.lower("robots").contains("noindex")).select("page_id", F.lit(55).alias("rule_seq"))
            rows = rows.join(meta, ["page_id", "rule_seq"], "left_anti")  # the meta tag's finding stands for both
            found += [self._titled(rows.filter("rule_seq <> 63")), self._titled(rows.filter("rule_seq = 63"), suffix=False)]
        if m.speed is not None:
            named = {1: "Low mobile PageSpeed performance", 2: "Slow Largest Contentful Paint", 3: "High Total Blocking Time", 4: "Layout shift risk"}
            rule = F.coalesce(*[F.when(F.col("rule_seq") == k, v) for k, v in named.items()])
            lab = probes.performance_findings(audits.pagespeed(m.speed)).withColumn("rule", rule).withColumn("sub", F.lit(0))
            more = probes.opportunity_findings(probes.opportunities(m.speed))
            both = lab.select("url", "rule_seq", "sub", "severity", "rule").unionByName(more).withColumn("kind", F.lit("performance"))
            found.append(self._titled(both.join(home, "url").drop("url")))
        if m.resources is not None:
            sums = audits.waterfall(m.resources, "page_id").join(m.resources.groupBy("page_id").agg(F.count_if("render_blocking").alias("render_blocking")), "page_id")
            found.append(self._titled(probes.waterfall_findings(sums, "page_id").withColumn("kind", F.lit("performance"))))
        if m.images is not None:
            found.append(self._titled(probes.image_findings(facts, m.images)))
        if m.static is not None:
            found.append(self._titled(probes.guards(m.static, facts).withColumn("kind", F.lit("guard"))))
        out = found[0]
        for rows in found[1:]:
            out = out.unionByName(rows)
        at = F.when(F.col("page_seq").isNull(), AFTER_PAGES).otherwise(F.col("page_seq") * (1 << 20)) + F.col("rule_seq") * (1 << 12) + F.col("sub")
        out = out.unionByName(self._of_sites()).withColumn("at", at.cast("long"))
        out = save(out, "findings")
        return place(out, ["host"], "at", "finding_seq", bits=34).drop("at").withColumn("pattern_key", pattern_key(F.col("title")))

    def _of_sites(self) -> DataFrame:
        m = self.measured
        hosts = self.facts.select("host").distinct()
        ready = readiness.readiness_findings(readiness.readiness(self.facts, m.access)).withColumn("kind", F.lit("ai-answer-readiness")).withColumn("confidence", F.lit("needs-review"))
        if m.discovery is not None:
            named = {65: "Robots.txt not found", 66: "Robots.txt blocks search engines", 67: "Robots.txt does not list your sitemap", 68: "Sitemap not found"}
            rows = probes.site_findings(m.discovery).withColumn("title", F.coalesce(*[F.when(F.col("rule_seq") == k, v) for k, v in named.items()]))
            ready = ready.unionByName(rows.withColumn("kind", F.lit("site")).withColumn("confidence", F.lit("verified")))
        rows = ready.join(hosts, "host", "left_semi")
        none = F.lit(None)
        return rows.select("host", none.cast("long").alias("page_id"), none.cast("long").alias("page_seq"), none.cast("string").alias("label"), "rule_seq", F.lit(0).alias("sub"), "kind", "severity", "confidence", F.col("title").alias("rule"), "title")

    @cached_property
    def page_scores(self) -> DataFrame:
        return score.scores(self.findings.filter("page_id is not null"), self.facts.select("page_id"), "page_id")

    @cached_property
    def site_scores(self) -> DataFrame:
        return score.scores(self.findings, self.facts.groupBy("host").agg(F.count("*").alias("pages")), "host")

    @cached_property
    def plan(self) -> DataFrame:
        return score.with_gains(score.plan(self.findings), self.findings)


def audit(pages: DataFrame, measured: Measured | None = None) -> AuditResult:
    """Audits pages (page_id, url, html) of any number of sites."""
    return AuditResult(pages, measured)
