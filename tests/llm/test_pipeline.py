"""The pipeline's stages on small tables, and the SQL of single operators."""

import duckdb
import pytest

import corpus_pipeline
from crawlwright.llm import queries
from crawlwright.llm.common import save

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, rows, empty):
    at = save(spark, docs.select(corpus_pipeline.COLUMNS), "start")
    counts = [at.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = save(spark, stage(spark, at, SF), "stage")
        counts.append(at.count())
        if i < 3:
            assert at.columns == corpus_pipeline.COLUMNS
        if i == 0:  # texts without a letter go
            assert {r.doc_id for r in at.collect()} == {i for i, t, _ in rows if any(c.isalpha() for c in t or "")}
        if i == 1:  # one of each group of copies stays
            ids = [r.doc_id for r in at.filter("doc_id between 90 and 112").collect()]
            assert ids.count(90) == ids.count(112) == 1 and not set(ids) & set(range(91, 110))
        if i == 2:  # the passage is left in its first document alone
            held = [r.doc_id for r in at.collect() if " p3 p4 p5 " in f" {r.text} "]
            assert held == [70]
            assert all(r.n_chars == len(r.text) for r in at.collect())
    assert counts[1] > counts[2] >= counts[3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    for t in ("documents", "embeddings", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(cols).collect()))
    assert got == sorted(duckdb.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall())


def test_no_copy_survives_repeated_ids(spark):
    text, near = " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(39))
    other, third = " ".join(f"o{k}" for k in range(40)), " ".join(f"t{k}" for k in range(40))
    stage = corpus_pipeline.near_duplicates

    def left(*rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)

    assert left((2, text), (5, text), (5, other)) == [(2, text), (5, other)]
    assert left((2, text), (5, text), (5, text), (2, text)) == [(2, text)]
    assert len(left((2, text), (2, near), (3, other))) == 2  # near copies of one id
    assert len(left((2, text), (2, text.upper()))) == 1  # one set, two texts
    assert left((2, text), (2, other), (3, near), (4, other), (4, third)) == [(2, other), (2, text), (4, third)]
    assert left((None, text), (None, text), (7, ""), (7, " "), (7, None), (8, text)) == sorted([(None, text)] * 2 + [(7, ""), (7, " "), (7, None), (8, text)], key=str)
