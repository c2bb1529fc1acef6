"""Packing of documents into fixed-length sequences as a cutting-stock problem, by column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.llm.chunks import encoded, library_cache, special_strings
from crawlwright.llm.common import bounded, save

PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pieces(df: DataFrame, path: str, end_id: int, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and end_id, cut every `size` ids.

    Row-wise; the ids stay in the worker. A null text counts as empty: its only id is end_id. Repeated rows
    and null keys give pieces of their own; an empty table gives none, and other columns are left out.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(path), special_strings(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), cache, special), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    for c, v in zip(out, (k, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], PIECE)

    return df.select(key, text).mapInArrow(run, ", ".join(f"{c} long" for c in PIECE))


def unit_of(size: int) -> int:
    """The step between length classes: the largest power of two that divides size into 128 classes or more, else 1.

    Lengths count as rounded up to it, which leaves about half a step per piece unused. The number of
    classes, and with it the linear program's work, depends on size alone.
    """
    unit = 1
    while size % (2 * unit) == 0 and size // (2 * unit) >= 128:
        unit *= 2
    return unit


@dataclass
class Pattern:
    """`times` sequences that each hold slots[class] pieces of a class."""

    times: int
    slots: dict[int, int]


def price(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over capacities.
    lengths ascend; returns its value and how often it takes each length's index."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = values[:k] + best[c - lengths[:k]]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], choice[c] = got[i], i
    slots: dict[int, int] = {}
    c = size
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            i = int(choice[c])
            slots[i] = slots.get(i, 0) + 1
            c -= int(lengths[i])
    return float(best[size]), slots


def relax(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 2e-3, most: int = 4000) -> list[tuple[float, dict[int, int]]]:
    """The linear program: fewest sequences whose patterns meet the demand, patterns any positive real number of times.

    Revised simplex with an explicit inverse. Each round prices the best new column with the current duals;
    it ends when no column helps, or when the duals, scaled to be feasible, prove the total to be within `gap`.
    """
    m = len(lengths)
    fit = size // lengths
    basis = [{i: int(fit[i])} for i in range(m)]
    inverse, x = np.diag(1.0 / fit), demand / fit
    for _ in range(most):
        duals = inverse.sum(axis=0)
        value, slots = price(lengths, duals, size)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
            break
        column = np.zeros(m)
        column[list(slots)] = list(slots.values())
        turn = inverse @ column
        ratio = np.full(m, np.inf)
        up = turn > 1e-9
        ratio[up] = np.maximum(x[up], 0) / turn[up]
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * turn
        x[out] = step
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
        basis[out] = slots
    return [(float(t), s) for t, s in zip(x, basis, strict=True) if t > 1e-9]


def plan(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[Pattern]:
    """Patterns that meet the demand exactly. The linear program's patterns are rounded down; what is left,
    less than one pattern of each kind, goes by best fit, longest first, in blocks of equal pieces."""
    left = demand.astype(np.int64).copy()
    out = []
    for t, slots in relax(lengths, demand.astype(float), size) if len(lengths) else []:
        n = min([int(t + 1e-6), *(int(left[i]) // k for i, k in slots.items())])
        if n > 0:
            out.append(Pattern(n, dict(slots)))
            for i, k in slots.items():
                left[i] -= n * k
    room: list[list[dict[int, int]]] = [[] for _ in range(size + 1)]  # open sequences by free length
    for i in range(len(lengths) - 1, -1, -1):
        n, long = int(left[i]), int(lengths[i])
        while n:
            free = next((c for c in range(long, size) if room[c]), size)
            k = min(n, free // long)
            slots = room[free].pop() if free < size else {}
            slots[i] = k
            room[free - k * long].append(slots)
            n -= k
    merged: dict[tuple, int] = {}
    for slots in (s for r in room for s in r):
        key = tuple(sorted(slots.items()))
        merged[key] = merged.get(key, 0) + 1
    return out + [Pattern(n, dict(k)) for k, n in merged.items()]


def ranked(cut: DataFrame, unit: int) -> DataFrame:
    """cut with _class (its length in units, rounded up, less 1) and _rank (from 0 within the class, longest first within a lot).

    A class may hold most of the rows, so it is dealt into lots by hash; ranks are counted in each lot and
    the earlier lots' counts are added. The number of lots follows the number of rows.
    """
    spark = cut.sparkSession
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cut.count() // 100_000)
    dealt = cut.withColumn("_class", F.expr(f"int(ceil(length / {unit})) - 1")).withColumn("_lot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lots)))
    sizes = dealt.groupBy("_class", "_lot").count()
    before = sizes.select("_class", "_lot", (F.sum("count").over(W.partitionBy("_class").orderBy("_lot")) - F.col("count")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_class", "_lot").orderBy(F.desc("length"), "doc_id", "start")) - 1
    return dealt.withColumn("_own", own).join(before, ["_class", "_lot"]).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_lot", "_own", "_before")


def assign(cut: DataFrame, size: int) -> DataFrame:
    """cut with sequence_id and offset: each row a piece of `length` ids, at most size.

    The driver gets the histogram of lengths (size rows at most) and makes the plan; rows find their place
    by class and rank in a table of the plan's patterns, whose size depends on `size` alone. Sequences are
    gapless from offset 0. A piece of full length is a sequence by itself and isn't shuffled for its offset. Equal
    rows each get a place; ties of length go by document, start and checksum, null documents first; an empty table gives no row.
    """
    unit = unit_of(size)
    classes = np.arange(1, size // unit + 1)
    hist = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    demand = np.zeros(len(classes), np.int64)
    for n, k in hist.items():
        demand[-(-n // unit) - 1] += k
    used = np.flatnonzero(demand)
    patterns = plan(classes[used], demand[used], size // unit)
    # by class: first rank, first sequence and slots of each pattern that has the class
    where: dict[int, list[list[int]]] = {int(c): [[], [], []] for c in used}
    taken, first = dict.fromkeys(where, 0), 0
    for p in patterns:
        for i, slots in p.slots.items():
            c = int(used[i])
            for column, v in zip(where[c], (taken[c], first, slots), strict=True):
                column.append(v)
            taken[c] += p.times * slots
        first += p.times
    lookup = {c: [np.array(v, np.int64) for v in columns] for c, columns in where.items()}
    cols = [*PIECE, "sequence_id", "_class", "_slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column(len(PIECE)).to_numpy(), batch.column(len(PIECE) + 1).to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                mine = np.flatnonzero(cls == c)
                ranks, firsts, slots = lookup[int(c)]
                at = np.searchsorted(ranks, rank[mine], side="right") - 1
                seq[mine], slot[mine] = firsts[at] + (rank[mine] - ranks[at]) // slots[at], (rank[mine] - ranks[at]) % slots[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(PIECE)], pa.array(seq), pa.array(cls.astype(np.int64)), pa.array(slot)], cols)

    placed = ranked(cut, unit).select(*PIECE, "_class", F.col("_rank").cast("long")).mapInArrow(run, ", ".join(f"{c} long" for c in cols))
    full = F.col("length") == size
    inside = W.partitionBy("sequence_id").orderBy(F.desc("_class"), "_slot")
    rest = placed.filter(~full).withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return rest.unionByName(placed.filter(full).withColumn("offset", F.lit(0).cast("long"))).select(*PIECE, "sequence_id", "offset")


def pack(spark: SparkSession, df: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """Pieces of df's documents (doc_id, text) with their places.

    A null text is a document of end_id alone; a null doc_id and repeated rows are documents of their own. Other
    columns are left out, whatever their names. An empty table gives no row.
    """
    return assign(save(spark, pieces(df, path, end_id, size), "pieces"), size)


def sequences(df: DataFrame, packed: DataFrame, path: str, end_id: int) -> DataFrame:
    """(sequence_id, ids array): the packed sequences themselves, for documents whose ids are unique. Documents with a null id
    are left out; a null text gives end_id alone; an empty table no sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(path), special_strings(path)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for cuts, ids in zip(batch.column(1).to_pylist(), encoded(batch.column(0), cache, special), strict=True):
                ids = np.append(ids, end_id).astype(np.int64)
                for c in cuts:
                    for out, v in zip(rows, (c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]]), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    cuts = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("cuts"))
    parts = df.select("doc_id", "text").join(cuts, "doc_id").select("text", "cuts").mapInArrow(run, "sequence_id long, offset long, ids array<long>")
    return parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))
