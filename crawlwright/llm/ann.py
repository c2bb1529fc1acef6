"""Approximate nearest neighbours by learned partitions of the vector space.

1. A bounded sample's exact neighbour graph is cut into balanced parts with few cut edges.
2. A small neural classifier learns which parts hold a vector's neighbours.
3. Every row goes to the part that the classifier finds most probable. A query goes to its several most
   probable parts; the candidates there are scored exactly.

How many parts a query probes is measured: the least number that reaches the wanted recall on sample
queries that the classifier hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm.common import forget, save
from crawlwright.llm.topk import LIST, TILE, as_lists, best, matrix, merged, ranked, search, tile, valid

#: Rows of the sample that the index is fitted on, at most.
SAMPLE = 6144
#: Rows of a dimension from which on it has an index.
LEAST = 1024
#: Rows of a part, about, and parts at most: the sample must hold several rows of each.
PART_ROWS, MOST_PARTS = 2048, 256


def neighbours(x: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indexes of each query's k rows of x with the largest inner product. own: the query's own row, left out."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), 1024):
        s = queries[i : i + 1024] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + 1024]] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each node of a neighbour graph (row i: the neighbours of i), each of about equal size.

    Parts grow from random seeds along the graph's edges; then nodes move, greatest gain first, to the part
    that holds most of their neighbours as long as it has room.
    """
    n = len(graph)
    room = int(np.ceil(n / parts * slack))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    label = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    seeds = rng.permutation(n)[:parts]
    label[seeds] = np.arange(parts)
    size += 1
    for _ in range(rounds * 2):
        votes = np.zeros((n, parts))
        known = label[both[1]] >= 0
        np.add.at(votes, (both[0][known], label[both[1][known]]), 1)
        gain = votes.max(axis=1) - np.where(label >= 0, votes[np.arange(n), label], -1)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if label[i] < 0 and not votes[i].any():
                continue
            for p in np.argsort(-votes[i], kind="stable")[:4]:
                if p == label[i] or votes[i, p] <= (votes[i, label[i]] if label[i] >= 0 else 0):
                    break
                if size[p] < room:
                    if label[i] >= 0:
                        size[label[i]] -= 1
                    label[i] = p
                    size[p] += 1
                    moved += 1
                    break
        if moved < n // 200:
            break
    for i in np.flatnonzero(label < 0):  # no way leads there, or what it leads to is full
        label[i] = p = int(size.argmin())
        size[p] += 1
    return label


@dataclass
class Router:
    """A classifier with one hidden layer: vector -> a score for each part."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 25, rate: float = 3e-3) -> Router:
        """Adam on the cross-entropy against target: each row's shares of its neighbours' parts."""
        scale = 1.0 / max(1e-12, float(np.sqrt((x**2).mean())))
        z = x * scale
        shapes = [(z.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
        w = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        first, second, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                h = np.maximum(z[rows] @ w[0] + w[1], 0)
                s = h @ w[2] + w[3]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - target[rows]) / len(rows)
                dh = (d @ w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((z[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return Router(scale, *w)


def fit(x: np.ndarray, parts: int, k: int, recall: float, seed: int = 7) -> tuple[Router, int]:
    """The router for a sample, and how many parts a query must probe."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: max(1, min(512, len(x) // 4))]
    near = min(10, len(x) - 1)
    graph = neighbours(x, x, near, np.arange(len(x)))
    label = balanced_parts(graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near), label[graph].ravel()), 1 / near)
    target = 0.8 * target + 0.2 * np.eye(parts)[label]
    learn = np.setdiff1d(order, held)
    router = Router.fit(x[learn], target[learn], rng)
    scores = router.scores(x)
    home = scores.argmax(axis=1)
    truth = neighbours(x, x[held], min(k, len(x) - 1), held)
    place = np.argsort(np.argsort(-scores[held], axis=1), axis=1)  # rank of each part for each query
    depth = np.take_along_axis(place, home[truth], axis=1)
    for probes in range(1, parts + 1):
        if (depth < probes).mean() >= recall:
            break
    return router, probes


def nearest(spark: SparkSession, df: DataFrame, is_query: Column, k: int, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest found, by inner product in doubles.

    recall is what fit() aims at on unseen sample queries. Every row is indexed; a part is as large as the
    router makes it, and parts with many rows or queries are cut into a grid of bounded pieces, so no task
    holds a whole part. Of equal vectors in one batch only the k + 1 with the smallest keys are kept: the others can't be
    among any query's k nearest, since ties go to the smaller key. Queries that found fewer than k
    in their parts are searched exactly among all rows.
    Vectors are compared with those of their own dimension: each dimension with LEAST rows or more has an index of its own, those
    with fewer are searched exactly. Rows whose key or vector is null, or whose vector is empty, zero or holds null or non-finite
    components, take no part.
    A key that several rows repeat is one query (its least vector) and a candidate per row. Candidates are all rows
    but those of the query's own key; with k or fewer all are returned. An empty table gives no row; other
    columns are left out.
    """
    rows = valid(df, key, vector, nonzero=True)
    queries = valid(df.filter(is_query), key, vector, nonzero=True).groupBy(key).agg(F.min(vector).alias(vector))
    # a row for each dimension, whatever the number of rows
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).collect()}
    large = sorted(d for d, n in sizes.items() if n >= max(LEAST, 4 * k))
    few = ~F.size(vector).isin(large)
    out = search(spark, queries.filter(few), rows.filter(few), k, False, key, vector) if len(large) < len(sizes) or not large else None
    for dims in large:
        own = F.size(vector) == dims
        found = _indexed(spark, rows.filter(own), queries.filter(own), dims, sizes[dims], k, recall, key, vector)
        out = out.unionByName(found) if out is not None else found
    return ranked(out, "double")


def _indexed(spark: SparkSession, rows: DataFrame, queries: DataFrame, dims: int, n: int, k: int, recall: float, key: str, vector: str) -> DataFrame:
    """(query_id, top) of queries among n rows, all of one dimension, by learned partitions."""
    part_of_million = min(1_000_000, int(1_000_000 * SAMPLE / n))
    sample = rows.filter(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1_000_000)) < part_of_million) if n > SAMPLE else rows
    drawn = sample.limit(SAMPLE).toArrow().combine_chunks()
    x = np.unique(_rows(drawn.column(1), dims), axis=0)
    if len(x) < 4 * k:  # hardly any different vectors in the sample
        return search(spark, queries, rows, k, False, key, vector)
    parts = int(np.clip(n // PART_ROWS, 8, min(MOST_PARTS, max(8, len(x) // 24))))
    router, probes = fit(x, parts, k, recall)

    def place(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)
            ids = batch.column(0).to_numpy()
            keep = np.arange(len(ids))
            if m == 1:
                order = np.lexsort((ids, *x.T))
                first = np.concatenate([[True], (x[order][1:] != x[order][:-1]).any(axis=1)])
                since = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                keep = np.sort(order[since <= k])
            top = np.argsort(-router.scores(x[keep]), axis=1, kind="stable")[:, :m]
            at = np.repeat(keep, top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int64)), pa.array(ids[at]), batch.column(1).take(pa.array(at))], ["part", key, vector])

    schema = f"part long, {key} long, {vector} array<double>"
    index = save(spark, rows.mapInArrow(lambda b: place(b, 1), schema), "ann-index")
    asked = save(spark, queries.mapInArrow(lambda b: place(b, probes), schema), "ann-queries")
    # each part's grid: pieces of candidates by pieces of queries
    pieces = {r["part"]: -(-r["count"] // TILE) for r in index.groupBy("part").count().collect()}
    blocks = {r["part"]: -(-r["count"] // TILE) for r in asked.groupBy("part").count().collect()}
    grid = spark.createDataFrame([(p, int(pieces[p]), int(blocks[p])) for p in pieces.keys() & blocks.keys()], "part long, pieces int, blocks int")
    grid = F.broadcast(grid)  # MOST_PARTS rows at most
    cand = index.join(grid, "part").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ask = asked.join(grid, "part").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cell = ["part", "piece", "block"]
    cols = [F.col("part").cast("long"), F.col("piece").cast("long").alias("piece"), F.col("block").cast("long").alias("block"), key, vector]

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([], pa.schema([("query_id", pa.int64()), ("part", pa.int64()), ("top", pa.list_(pa.struct([("less", pa.float64()), ("beyond", pa.binary()), ("id", pa.int64())])))]))
        ids, x = (t := left.sort_by(key)).column(key).to_numpy(), _rows(t.column(vector), dims)
        query_ids, q = right.column(key).to_numpy(), _rows(right.column(vector), dims)
        found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for i in range(0, len(ids), TILE):
            found = best(*(np.concatenate(f) for f in zip(found, tile(q, query_ids, x[i : i + TILE], ids[i : i + TILE], k, False), strict=True)), k)
        part = left.column("part")[0].as_py() + left.column("piece")[0].as_py() * parts
        return pa.Table.from_batches([as_lists(query_ids, *found, part, pa.float64())])

    lists = cand.select(*cols).groupBy(*cell).cogroup(ask.select(*cols).groupBy(*cell)).applyInArrow(cross, LIST.format("double"))
    top = save(spark, merged(lists, k, parts * max(pieces.values(), default=1)), "ann-top")
    forget(spark, index)
    short = queries.join(top.filter(F.size("top") >= min(k, n - 1)).select(F.col("query_id").alias(key)), key, "left_anti")
    short = save(spark, short, "ann-short")
    if not short.isEmpty():
        top = top.join(short.select(F.col(key).alias("query_id")), "query_id", "left_anti").unionByName(search(spark, short, rows, k, False, key, vector))
    return top


def _rows(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
