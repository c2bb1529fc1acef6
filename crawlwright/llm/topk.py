"""Exact top-k search: tiled matrix products of query blocks and candidate shards, partial selection per tile, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm.common import save

#: Queries that are broadcast at a time, and candidates that one matrix product takes.
BLOCK, TILE = 4096, 4096
#: Lists that one merging step puts together.
FAN = 16


def valid(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """(key, vector as array<double>) of the rows that take part: key and vector given, a component or more, all
    finite and, if asked for, not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if nonzero:
        fine &= F.exists(v, lambda x: x != 0)
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(fine).select(F.col(key).cast("long").alias(key), v.alias(vector))


def matrix(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their matrix) for each dimension that occurs among vectors."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[ends[rows][:, None] + np.arange(n)]


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, score, id) triples each row's k highest scores, ties to the smaller id, in that order."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], scores[keep], ids[keep]


def _but_own(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """scores without those of a query's own key. ids ascend."""
    low, high = np.searchsorted(ids, query_ids, side="left"), np.searchsorted(ids, query_ids, side="right")
    for r in np.flatnonzero(high > low):
        scores[r, low[r] : high[r]] = -np.inf
    return scores


def _least(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th highest score."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)


def huge(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tile() gives for whole numbers of any size, with scores as Python's integers: the matrix product of the components divided by
    the largest is an estimate, and those within its rounding error of the k-th are computed exactly."""
    shrunk = [m / max(1.0, np.abs(m).max(initial=0)) for m in (queries, block)]
    scores = _but_own(shrunk[0] @ shrunk[1].T, query_ids, ids)
    rows, cols = np.nonzero((scores >= (_least(scores, k) - queries.shape[1] * 1e-14)[:, None]) & (scores > -np.inf))
    exact, out = {}, np.empty(len(rows), object)
    for n, (r, c) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)):
        for name, m, at in (("q", queries, r), ("c", block, c)):
            if (name, at) not in exact:
                exact[name, at] = [int(x) for x in m[at]]
        out[n] = sum(x * y for x, y in zip(exact["q", r], exact["c", c], strict=True))
    return best(rows, out, ids[cols], k)


def tile(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one block of candidates, as (row, score, id). ids ascend.

    whole: components are whole numbers; their products are exact in doubles below 2**53, else they are what huge()
    gives. Otherwise the product is a first estimate: all within its rounding error of the k-th are scored again
    one by one, always in the same order of additions, so equal vectors get equal scores.
    """
    reach = np.abs(queries).max(initial=0) * np.abs(block).max(initial=0) * queries.shape[1]
    if whole and not reach < 2.0**53:
        return huge(queries, query_ids, block, ids, k)
    scores = _but_own(queries @ block.T, query_ids, ids)
    least = _least(scores, k)
    slack = 0.0 if whole else reach * 1e-14
    rows, cols = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
    if whole:
        return best(rows, scores[rows, cols].astype(np.int64), ids[cols], k)
    again = np.concatenate([(queries[rows[i : i + 65536]] * block[cols[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
    return best(rows, again, ids[cols], k)


def merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """(query_id, top) from (query_id, part, top): lists of FAN parts are put together at a time until one
    list a query is left, so no task sees more than FAN * k entries of a query at once."""
    while True:
        parts = -(-parts // FAN)
        lists = lists.groupBy("query_id", F.floor(F.col("part") / FAN).alias("part")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if parts <= 1:
            return lists.select("query_id", "top")


def ranked(top: DataFrame, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query_id, top)."""
    return top.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.less")).cast(score).alias("score"))


#: The best entry sorts first: less is the negated score, held within 64 bits; beyond orders those that don't fit.
LIST = "query_id long, part long, top array<struct<less: {0}, beyond: binary, id: long>>"
_MOST = (1 << 63) - 1


def _beyond(less: int) -> bytes | None:
    """Bytes that sort as numbers beyond 64 bits do; None for others."""
    if abs(less) < _MOST:
        return None
    size = (less.bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(less).to_bytes(size, "big")
    return b"\1" + data if less > 0 else b"\0" + bytes(255 - b for b in data)


def entries(scores: np.ndarray, ids: np.ndarray, kind: pa.DataType) -> pa.StructArray:
    """Scores and keys as entries of LIST."""
    if scores.dtype == object:
        less, beyond = [max(-_MOST, min(_MOST, -s)) for s in scores], [_beyond(-s) for s in scores]
    else:
        less, beyond = -scores, [None] * len(scores)
    return pa.StructArray.from_arrays([pa.array(less, kind), pa.array(beyond, pa.binary()), pa.array(ids, pa.int64())], ["less", "beyond", "id"])


def as_lists(query_ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, part: int, kind: pa.DataType) -> pa.RecordBatch:
    """Triples sorted by row, as rows of LIST."""
    present, first = np.unique(rows, return_index=True)
    top = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), entries(scores, ids, kind))
    return pa.RecordBatch.from_arrays([pa.array(query_ids[present], pa.int64()), pa.array([part] * len(present), pa.int64()), top], ["query_id", "part", "top"])


def search(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int, whole: bool, key: str, vector: str, scale: float = 1.0) -> DataFrame:
    """(query_id, top): every query against every candidate but those of its own key, with equal dimension.

    queries and candidates are what valid() gives. Queries are put in blocks of about BLOCK by a hash; a
    block is broadcast (its size is bounded) and meets all candidates in one pass without any shuffle but
    that of the short lists. With whole, components become floor(scale * x).
    """
    queries = save(spark, queries.groupBy(key).agg(F.min(vector).alias(vector)), "queries")
    n = queries.count()
    n_blocks = 1 if n <= BLOCK else -(-n // (BLOCK // 2))  # a hash deals them about evenly
    kind = "long" if whole else "double"
    out = []
    for b in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((rows.column(0).to_numpy(), rows.column(1).combine_chunks() if len(rows) else None))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            query_ids, vectors = held.value
            if vectors is None:
                return
            most = np.finfo(np.float64).max
            shape = (lambda m: np.floor(np.clip(scale * m, -most, most))) if whole else (lambda m: m)
            by_size = {m.shape[1]: (rows, shape(m)) for rows, m in matrix(vectors)}
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64 if whole else float), np.zeros(0, np.int64))
            for batch in batches:
                for rows, m in matrix(batch.column(1)):
                    if m.shape[1] not in by_size:
                        continue
                    at, q = by_size[m.shape[1]]
                    ids = batch.column(0).to_numpy()[rows]
                    order = np.argsort(ids, kind="stable")
                    ids, m = ids[order], shape(m[order])
                    for i in range(0, len(ids), TILE):
                        r, s, c = tile(q, query_ids[at], m[i : i + TILE], ids[i : i + TILE], k, whole)
                        found = best(*(np.concatenate(x) for x in zip(found, (at[r], s, c), strict=True)), k)
            if len(found[0]):
                yield as_lists(query_ids, *found, TaskContext.get().partitionId(), pa.int64() if whole else pa.float64())

        lists = candidates.mapInArrow(run, LIST.format(kind))
        top = merged(lists, k, candidates.rdd.getNumPartitions())
        out.append(save(spark, top, "top") if n_blocks > 8 else top)
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) // 2 * 2 :]
    return out[0]


def exact_top_k(spark: SparkSession, df: DataFrame, is_query: Column, k: int, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest whole-number inner products.

    Components become floor(scale * x). Candidates are all rows but those of the query's own key. Ties go to
    the smaller key. Rows whose key or vector is null, or whose vector is empty or holds null or non-finite
    components, take no part; neither do candidates of another dimension than the query's. A key that
    several rows repeat is one query (its least vector) and as many candidates as it has rows. With k
    candidates or fewer all are returned; an empty table gives no row; other columns are left out. Scores of any size are
    ordered exactly; one beyond 64 bits is returned as the nearest number that fits. A component that overflows
    when scaled is the largest double.
    """
    rows = valid(df, key, vector)
    return ranked(search(spark, valid(df.filter(is_query), key, vector), rows, k, True, key, vector, scale), "long")
