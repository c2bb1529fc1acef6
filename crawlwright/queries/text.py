"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.functions import text as t
from crawlwright.operators.overlap import contained
from crawlwright.operators.similarity import similar_sets
from crawlwright.registry import query, table

_WORDS = "regexp_extract_all(replace(lower(text), '’', ''''), '(" + t.WORD.replace("'", "''") + ")', 1)"
_STOP = ", ".join("'" + x.replace("'", "''") + "'" for x in t.DENSITY_STOP_WORDS)


@query(f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars, CAST(floor(len({_WORDS}) / 238.0 + 0.5) AS BIGINT) AS reading_minutes, CAST(floor(len({_WORDS}) / 150.0 + 0.5) AS BIGINT) AS speaking_minutes FROM documents")
def word_stats(spark, sf_dir):
    n = F.size(t.words(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), F.length("text").cast("long").alias("n_chars"), F.floor(n / 238.0 + 0.5).alias("reading_minutes"), F.floor(n / 150.0 + 0.5).alias("speaking_minutes"))


def density(docs, by: str, words: str, size: int, top: int = 10, dealt: bool = False):
    """(by, phrase, n, density): the most frequent phrases of each group's texts and what share of its words they make, in percent. Of one
    word all count, longer phrases from two on. The text tool counts each text by itself: by a document's key this is its answer;
    by a column that texts share it is the same over all of them. Phrases are runs of `size` words that neither begin nor end with a stop word and aren't numbers alone.

    Words are made once: a text's number of words is counted beside its phrases, under none (place -1). dealt: groups are small, so the words are dealt by
    group and counted there; else each phrase is counted where it is and then dealt."""
    rows = docs.select(by, F.col(words).alias("_w"))
    rows = rows.repartition(by) if dealt else rows
    w, i = F.col("_w"), F.col("_i")
    rows = rows.select(by, "_w", F.explode(F.when(F.size(w) >= size, F.sequence(F.lit(-1), F.size(w) - size)).otherwise(F.array(F.lit(-1)))).alias("_i"))
    at = [F.get(w, i + k) for k in range(size)]
    numbers = at[0].rlike("^[0-9]+$")
    for x in at[1:]:
        numbers = numbers & x.rlike("^[0-9]+$")
    inner = ~at[0].isin(t.DENSITY_STOP_WORDS) & ((~at[-1].isin(t.DENSITY_STOP_WORDS)) if size > 1 else F.lit(True)) & ~numbers
    rows = rows.filter((i < 0) | inner).select(by, F.when(i >= 0, F.concat_ws(" ", *at)).alias("phrase"), F.when(i < 0, F.size(w)).otherwise(1).alias("_n"))
    c = rows.groupBy(by, "phrase").agg(F.sum("_n").alias("n")).filter(F.col("phrase").isNull() | (F.col("n") > (0 if size == 1 else 1)))
    best = c.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(F.col("phrase").isNotNull(), F.desc("n"), "phrase"))).filter(F.col("nth") <= top + 1)
    best = best.withColumn("total", F.max(F.when(F.col("phrase").isNull(), F.col("n"))).over(W.partitionBy(by))).filter(F.col("phrase").isNotNull() & F.col(by).isNotNull())
    return best.select(by, "phrase", "n", (F.floor(F.col("n") * size * 1000.0 / F.col("total") + 0.5) / 10).alias("density"))


def _density(size: int, by: str, name: str):
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    ends = f"w[i] NOT IN ({_STOP}) AND w[i + {size - 1}] NOT IN ({_STOP})"
    least = 0 if size == 1 else 1
    sql = f"""WITH d AS (SELECT lang, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT {by}, unnest([{gram} FOR i IN range(1, len(w) - {size - 2}) IF {ends}]) AS phrase FROM d),
c AS (SELECT {by}, phrase, count(*) AS n FROM g WHERE NOT regexp_matches(phrase, '^[0-9 ]+$') GROUP BY ALL),
t AS (SELECT {by}, sum(len(w)) AS total FROM d GROUP BY {by}),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, phrase) AS nth FROM c WHERE n > {least})
SELECT r.{by}, phrase, n, floor(n * {size} * 1000.0 / total + 0.5)::DOUBLE / 10 AS density FROM r JOIN t ON t.{by} = r.{by} WHERE nth <= 10"""

    def run(spark, sf_dir):
        d = table(spark, sf_dir, "documents").filter("text is not null").select("lang", "doc_id", t.words(F.col("text")).alias("w"))
        return density(d, by, "w", size, dealt=by == "doc_id")

    run.__name__ = name
    return query(sql)(run)


keyword_density_1, keyword_density_2, keyword_density_3 = (_density(n, "lang", f"keyword_density_{n}") for n in (1, 2, 3))
document_phrases = _density(2, "doc_id", "document_phrases")


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping_id(lang, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def source_rollup(spark, sf_dir):
    """Extension: documents by language and source with subtotals."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def lang_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2))"


@query(f"""WITH k AS (SELECT doc_id, {_TOK} AS tk FROM documents), e AS (SELECT doc_id, len(tk) AS size, unnest(tk) AS token FROM k),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.size AS sa, b.size AS sb, count(*) AS shared FROM e a JOIN e b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT x, y, shared, sa + sb - shared AS either FROM o WHERE 100 * shared >= 82 * (sa + sb - shared)""")
def near_duplicate_documents(spark, sf_dir):
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    sets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(F.filter(F.split(norm, " "), lambda x: F.length(x) > 2)).alias("items"))
    return similar_sets(sets, 82, 100).select("x", "y", F.col("shared").cast("long"), F.col("either").cast("long"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_overlap(spark, sf_dir):
    """Documents that hold a benchmark passage whole."""
    return contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
