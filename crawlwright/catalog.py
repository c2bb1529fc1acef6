"""All queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlwright.queries import answers, audits, control, crawl, decorated, history, pages, relational, state, text, values, workflow  # noqa: F401  they register their queries
from crawlwright.registry import ORACLE_SQL, QUERIES  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.site_scorecard(spark, sf_dir)
