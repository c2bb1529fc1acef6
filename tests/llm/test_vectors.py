"""Operators 3 and 8 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlwright.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b") for i, v in vectors], SCHEMA).repartition(4)


def brute(vectors, is_query, k, shape):
    good = [(i, shape(np.array(v, np.float32).astype(float))) for i, v in vectors if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if is_query(i)}):
        x = min((list(v) for i, v in good if i == q))
        found = sorted((-float((np.array(x) * v).sum()), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    out = [(i, rng.normal(size=8).round(1)) for i in range(300)]
    hot = rng.normal(size=8)
    out += [(i, hot) for i in range(300, 420)]  # a vector that many rows share
    out += [(100, out[0][1]), (None, hot), (500, None), (501, [1.0, None, 2.0, 0, 0, 0, 0, 0]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (602, [0.0] * 8)]
    return out


def test_exact_top_k(spark, vectors):
    got = topk.exact_top_k(spark, table(spark, vectors), F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    want = brute(vectors, lambda i: i % 100 == 0, 10, lambda v: np.floor(1024 * v))
    assert [tuple(r) for r in got] == [(q, n, i, int(s)) for q, n, i, s in want]


def test_exact_top_k_in_many_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "FAN", 2)
    got = topk.exact_top_k(spark, table(spark, vectors), F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    want = brute(vectors, lambda i: i % 20 == 0, 3, lambda v: np.floor(1024 * v))
    assert [tuple(r) for r in got] == [(q, n, i, int(s)) for q, n, i, s in want]


@pytest.mark.parametrize("size, k", [(1e9, 10), (1e40, 3), (1e200, 4)])
def test_huge_components_are_ordered_exactly(spark, size, k, monkeypatch):
    """Rising scores beyond 64 bits in several blocks and tiles, with ties, small and negative ones among them."""
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "FAN", 2)
    vectors = [(i, [size, float(i)]) for i in range(15)] + [(20, [-size, 1.0]), (21, [0.0, 5.0]), (22, [size, 14.0]), (23, [-size, 7.0]), (24, [size * 1.0000001, 0.0])]
    got = [tuple(r) for r in topk.exact_top_k(spark, spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") < 2, k).orderBy("query_id", "rank").collect()]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors}
    want = []
    for q in (0, 1):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, max(1 - 2**63, min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores[:k])]
    assert got == want


def test_overflowing_components(spark):
    vectors = [(0, [1.7e308, 1.0]), (1, [1.7e308, 2.0]), (2, [-1.7e308, 2.0])]
    got = topk.exact_top_k(spark, spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 9).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 1 - 2**63)]


def test_empty(spark):
    assert topk.exact_top_k(spark, table(spark, []), F.col("vec_id") >= 0, 5).count() == 0
    assert ann.nearest(spark, table(spark, []), F.col("vec_id") >= 0, 5).count() == 0


def test_few_rows_return_all(spark):
    vectors = [(i, [i, 1.0]) for i in range(5)]
    got = ann.nearest(spark, table(spark, vectors), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 5)]


def test_learned_partitions(spark, vectors):
    rng = np.random.default_rng(8)
    more = [*vectors, *((1000 + i, rng.normal(size=8)) for i in range(2500))]
    more += [(5000 + i, rng.normal(size=3)) for i in range(40)]  # another dimension, with few rows
    got = [tuple(r) for r in ann.nearest(spark, table(spark, more), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    usable = [(i, v) for i, v in more if i != 602]
    want = brute(usable, lambda i: i % 20 == 0, 20, lambda v: v)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    by = {(q, i): s for q, _, i, s in got}
    truth = {(q, i) for q, _, i, _ in want}
    assert len(truth & by.keys()) >= 0.9 * len(truth)
    assert {i for q, _, i, _ in got if q == 600} == {601} and {q for q, *_ in got} >= {5000, 5020}
    vector = {i: np.array(v, np.float32).astype(float) for i, v in usable if v is not None and i is not None and (i < 500 or i >= 600)}
    for (q, i), s in list(by.items())[:2000]:
        if q != 100 and i != 100:
            assert s == pytest.approx(float((vector[q] * vector[i]).sum()), abs=1e-12)
    ranks = [(q, -s, i) for q, _, i, s in got]
    assert ranks == sorted(ranks)


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (100, 4)) for c in rng.normal(0, 3, (8, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbours(x, x, 8, np.arange(len(x)))
    label = ann.balanced_parts(graph, 8, rng)
    assert np.bincount(label, minlength=8).max() <= 1.1 * 100 + 1
    assert (label[graph] == label[:, None]).mean() > 0.6


def test_each_dimension_has_an_index(spark, monkeypatch):
    """Two dimensions with many rows each: all queries of both are answered, among vectors of their own dimension."""
    monkeypatch.setattr(ann, "LEAST", 300)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8 if i < 700 else 5)) for i in range(1400)]
    got = [tuple(r) for r in ann.nearest(spark, table(spark, rows), F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect()]
    want = brute(rows, lambda i: i % 20 == 0, 10, lambda v: v)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    assert all((q < 700) == (i < 700) for q, _, i, _ in got)
