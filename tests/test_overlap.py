"""Benchmark passages in texts, against the registered SQL on small tables."""

import duckdb

from crawlwright import catalog

PASSAGES = ["What is the capital of the far land?", "one two\nthree four five six", "one  two three\tfour five six", "two words", "word", "", None, " a b c d ", "no text has these five words", "word", "é😀", "x a", "zz"]
TEXTS = [
    "He asked: \"What is the capital of the far land?\" twice",
    "Q:What is the capital of the far land?A",
    "x one two\nthree four five six y one  two three\tfour five sixty",
    "one two three four five six",
    "twenty-two words and swords",
    "x a b c d y",
    "",
    None,
    "word",
    "What is the capital of the far land? What is the capital of the far land?",
    "café😀!",
    "word",
]


def test_benchmark_overlap(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([*enumerate(TEXTS), (None, "a word")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = [(r.item_id, r.doc_id) for r in catalog.QUERIES["benchmark_overlap"](spark, str(tmp_path)).collect()]
    want = con.sql(catalog.ORACLE_SQL["benchmark_overlap"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
