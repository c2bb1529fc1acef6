"""A corpus pipeline over documents in four stages: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of
documents and leave others out. SQL can't express the whole: a trained classifier, a tokenizer
and a linear program take part.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import jaccard, language, packing, substring
from crawlwright.llm.common import save, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: no text or letter in it, or no language it is sure of.
    It learns from a bounded sample of docs' own non-null lang."""
    return language.identify(spark, docs, F.lit(True), keep=tuple(COLUMNS)).filter("not rejected").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles with a Jaccard index of 0.8 or more one stays: the one with the
    smallest doc_id and, if several rows share that doc_id, the smallest hash of its text. Rows without words, or with a null doc_id, stay;
    equal rows of one doc_id become one."""
    docs = docs.select(COLUMNS).withColumn("row_hash", F.xxhash64("text"))
    stay = jaccard.representatives(spark, docs, size=5, num=80, den=100).filter("doc_id is not null")
    return docs.join(stay, ["doc_id", "row_hash"]).dropDuplicates(["doc_id", "row_hash"]).select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words or more that a document with a smaller doc_id holds out of the texts. A document that
    loses words has its other words joined by one space and n_chars set anew; one that loses all goes."""
    docs = docs.select(COLUMNS).withColumn("row_hash", F.xxhash64("text"))
    _, changed = substring.dedup(spark, docs, size=50)
    changed = changed.dropDuplicates(["doc_id", "row_hash"])
    out = docs.join(changed, ["doc_id", "row_hash"], "left").filter("kept is null or kept <> ''")
    text, chars = F.coalesce("kept", "text"), F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of at most 2048 tokens. A null text is an empty one, with the end mark as its only
    token; repeated rows and null doc_ids are documents of their own; pieces of equal length are dealt in order of their hashes."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substring_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(spark, docs, "stage")
    return docs
