"""The queries of the corpus operators, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import ann, bpe, counts, jaccard, language, lines, lm, merkle, packing, records, resample, substring, topk
from crawlwright.llm.common import crc_mod, fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op6_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048)


@query
def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, folder=fresh_path(spark, "records"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLE_SQL["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum([CAST(q.e[i] * c.e[i] AS BIGINT) FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op9_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = substring.dedup(spark, table(spark, sf_dir, "documents"), size=50)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(spark, table(spark, sf_dir, "documents"), size=4, num=85, den=100)


ORACLE_SQL["op7_grouped_prefix_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(1, len(ws) - 2)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sh),
flat AS (SELECT doc_id, unnest(s) AS g FROM sh),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
walk(x, y) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT walk.x, b.y FROM walk JOIN both_ways b ON b.x = walk.y)
SELECT s.doc_id AS doc_id, CAST(s.n AS BIGINT) AS n_shingles, CAST(min(w.y) AS BIGINT) AS component_id
FROM sizes s JOIN walk w ON w.x = s.doc_id GROUP BY ALL
"""


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod("doc_id", 3)
    found = language.identify(spark, docs, fold != 1)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 7)
    scored = lm.score(spark, table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    seen = F.when(tampered, merkle.digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]))
    made = merkle.manifest(spark, docs, merkle.digest(*[F.col(c) for c in names]), "lang", "doc_id", carry={"seen": seen})
    root = F.lit(made.root).cast("string")
    again = merkle.folded(F.coalesce("carried.seen", "leaf"), F.col("proof"), F.col("place"), F.col("total"), F.col("group_place"), F.col("groups"), made.levels)
    proof = F.sha2(F.lower(F.hex("proof")), 256)
    out = made.rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The CRC-32 of the bytes of a text x, bit by bit: an entry for each byte and eight for its shifts.
_CRC32 = """xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten([list_concat([CAST(('0x' || substr(hex({0}), 2 * i - 1, 2)) AS BIGINT)], [CAST(-1 AS BIGINT) FOR k IN range(8)]) FOR i IN range(1, CAST(len(hex({0})) // 2 AS BIGINT) + 1)])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END))"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

ORACLE_SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format("n_chars")} AS leaf,
    CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.format("n_chars + 1")} END AS seen
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(height, tree, pos, n, h) AS (
  SELECT 0, tree, pos, n, leaf FROM placed
  UNION ALL
  SELECT any_value(height) + 1, tree, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, pos // 2),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over(height, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT any_value(height) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY pos // 2),
above(tree, height, pos, proof, h) AS (
  SELECT tree, 0, pos, '', subroot FROM subroots
  UNION ALL
  SELECT a.tree, a.height + 1, a.pos // 2, a.proof || coalesce(o.h, ''), CASE WHEN a.pos % 2 = 1 THEN sha256(o.h || a.h) ELSE sha256(a.h || coalesce(o.h, '')) END
  FROM above a JOIN over p ON p.height = a.height AND p.pos = a.pos AND p.n > 1 LEFT JOIN over o ON o.height = a.height AND o.pos = xor(a.pos, 1)),
way(doc_id, leaf, seen, tree, height, pos, proof, h) AS (
  SELECT doc_id, leaf, seen, tree, 0, pos, '', coalesce(seen, leaf) FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.seen, w.tree, w.height + 1, w.pos // 2, w.proof || coalesce(o.h, ''), CASE WHEN w.pos % 2 = 1 THEN sha256(o.h || w.h) ELSE sha256(w.h || coalesce(o.h, '')) END
  FROM way w JOIN nodes p ON p.tree = w.tree AND p.height = w.height AND p.pos = w.pos AND p.n > 1 LEFT JOIN nodes o ON o.tree = w.tree AND o.height = w.height AND o.pos = xor(w.pos, 1)),
ends AS (SELECT w.*, s.subroot, s.pos AS tree_pos FROM way w JOIN nodes p ON p.tree = w.tree AND p.height = w.height AND p.n = 1 JOIN subroots s ON s.tree = w.tree),
last(doc_id, leaf, subroot, height, pos, proof, h) AS (
  SELECT doc_id, leaf, subroot, 0, tree_pos, proof, h FROM ends
  UNION ALL
  SELECT l.doc_id, l.leaf, l.subroot, l.height + 1, l.pos // 2, l.proof || coalesce(o.h, ''), CASE WHEN l.pos % 2 = 1 THEN sha256(o.h || l.h) ELSE sha256(l.h || coalesce(o.h, '')) END
  FROM last l JOIN over p ON p.height = l.height AND p.pos = l.pos AND p.n > 1 LEFT JOIN over o ON o.height = l.height AND o.pos = xor(l.pos, 1))
SELECT l.doc_id AS doc_id, l.leaf AS leaf, l.subroot AS subroot, p.h AS root, sha256(l.proof) AS proof_sha256, l.h AS folded_root, l.h = p.h AS verified
FROM last l JOIN over p ON p.height = l.height AND p.n = 1
"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op12_importance_resampling"] = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
goals AS (SELECT {_WORDS} AS ws FROM benchmark),
flat AS (SELECT k, unnest(ws) AS x FROM docs),
wanted AS (SELECT unnest(ws) AS x FROM goals),
buckets AS (SELECT x, {_CRC32.format("x")} % 10000 AS b FROM (SELECT DISTINCT x FROM (SELECT x FROM flat UNION ALL SELECT x FROM wanted))),
s AS (SELECT b, count(*) AS s FROM flat JOIN buckets USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM wanted JOIN buckets USING (x) GROUP BY b),
totals AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM flat) AS ss, (SELECT CAST(count(*) AS DOUBLE) FROM wanted) AS tt),
gains AS (
  SELECT s.b AS b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((s.s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (b), totals),
weights AS (SELECT k, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM flat JOIN buckets USING (x) JOIN gains USING (b) GROUP BY k),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (k)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(spark, table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op13_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
flat AS (SELECT k, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM flat),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT k) >= 10),
kept AS (SELECT k, string_agg(l, chr(10) ORDER BY i) AS kept, count(*) AS n FROM keyed WHERE key NOT IN (SELECT key FROM common) GROUP BY k)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (k)
"""
