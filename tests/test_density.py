"""Phrases and their density: words are made once, and groups are whole whichever way they are dealt."""

import pytest
from pyspark.sql import functions as F

from crawlwright.queries import text as q


@pytest.mark.parametrize("dealt", [False, True])
def test_density(spark, dealt):
    rows = [("a", "red fox red fox 12 7 12 7"), ("a", "the red fox"), ("a", ""), ("b", "one"), ("b", "of the"), (None, "red fox red fox"), ("c", "fox the fox the fox")]
    docs = spark.createDataFrame(rows, "k string, text string").select("k", F.regexp_extract_all("text", F.lit("([a-z0-9]+)"), 1).alias("w"))
    get = lambda size: sorted(tuple(r) for r in q.density(docs, "k", "w", size, dealt=dealt).collect())
    assert get(2) == [("a", "red fox", 3, 54.5)]
    assert get(1) == [("a", "fox", 3, 27.3), ("a", "red", 3, 27.3), ("b", "one", 1, 33.3), ("c", "fox", 3, 60.0)]
    plan = q.density(docs, "k", "w", 2, **({"dealt": True} if dealt else {}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # before, once for the phrases and once for the number of words
