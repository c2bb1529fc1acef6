"""Removal of long passages that repeat across documents, over a compacted de Bruijn graph of words.

A window of `size` words is an edge from its first size - 1 words to its last. Only edges that may repeat
are looked at: two equal windows share their least k-mer, so a window whose least k-mer occurs in one
document alone can't repeat. Neighbouring edges of a text that share their least k-mer form a path without
a branch; equal paths compact into one through a join on the hash of all their words. The graph then has a
row for each distinct path, with its edges and the smallest document that holds it, however often the
passage is copied. Edges that occur in several distinct paths, where the graph branches, get their smallest
document through a second join. Each document takes the answer back by the coordinates of its paths.
Paths and edges are equal only if two independent 64-bit hashes of their words both are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import words as w
from crawlwright.llm.common import SLICE_BYTES, bounded, forget, save
from crawlwright.llm.held import each

#: Words of a k-mer. Two equal windows of more than K words share their least k-mer.
K = 8


def _least(rolling: w.Rolling, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(least k-mer of the window at each place, whether the window lies in one text)."""
    k = min(K, size)
    least = w.sliding_least(rolling.windows(k), size - k + 1)
    return least, w.inside(bounds, size, len(least))


def _read(docs: DataFrame, size: int) -> DataFrame:
    """A row per document: (doc_id, row_hash, n_words, kept_sha256 as if nothing goes, mers: its distinct least k-mers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for first, texts in w.slices(batch.column(2), SLICE_BYTES):
                bounds, known, codes = w.split(texts)
                least, ok = _least(w.Rolling(w.hashed(known, 0)[codes]), bounds, size)
                at = np.flatnonzero(ok)
                owner = np.searchsorted(bounds, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (least[at][1:] != least[at][:-1]) | (owner[1:] != owner[:-1])
                at, owner = at[new], owner[new]
                mers = [None] * len(texts)
                for i, part in zip(*_grouped(owner, least[at]), strict=True):
                    mers[i] = np.unique(part).view(np.int64)
                digest = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(np.diff(bounds)), pa.array(digest, pa.string()), pa.array(mers, pa.list_(pa.int64()))], ["doc_id", "row_hash", "n_words", "kept_sha256", "mers"])

    return docs.mapInArrow(run, "doc_id long, row_hash long, n_words long, kept_sha256 string, mers array<long>")


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """keys ascend: (distinct keys, the values of each)."""
    found, first = np.unique(keys, return_index=True)
    return found, np.split(values, first[1:]) if len(found) else []


PATH = "pa long, pb long, n int, mer long"


def _paths(texts: DataFrame, size: int) -> DataFrame:
    """A row per path of a document that may repeat: (pa, pb, n: the path's hashes and number of windows, mer: its
    least k-mer, doc_id, row_hash, pos, edges). edges holds the windows' hashes in pairs, for one of the equal paths of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for first, part in w.slices(batch.column(2), SLICE_BYTES):
                mers = np.unique(batch.column(3).slice(first, len(part)).flatten().to_numpy()).view(np.uint64)
                bounds, known, codes = w.split(part)
                a, b = (w.Rolling(w.hashed(known, seed)[codes], seed) for seed in (0, 1))
                least, ok = _least(a, bounds, size)
                at = np.flatnonzero(ok)
                at = at[np.isin(least[at], mers)]
                if not len(at):
                    continue
                owner = np.searchsorted(bounds, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (least[at][1:] != least[at][:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
                head = np.flatnonzero(new)
                start, n = at[head], np.diff(np.append(head, len(at)))
                pa_, pb_ = a.runs(start, start + n + size - 1), b.runs(start, start + n + size - 1)
                wa, wb = a.windows(size)[at], b.windows(size)[at]
                _, one = np.unique(np.stack([pa_, pb_]), axis=1, return_index=True)
                sole = np.zeros(len(head), bool)
                sole[one] = True
                both = np.stack([wa, wb], axis=1)
                ends = np.cumsum(n)
                edges = [both[i:j].tobytes() if one else None for i, j, one in zip(ends - n, ends, sole, strict=True)]
                rows = pa.array(owner[head] + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pa_.view(np.int64)), pa.array(pb_.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(least[start].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - bounds[owner[head]]).astype(np.int32)), pa.array(edges, pa.binary())],
                    ["pa", "pb", "n", "mer", "doc_id", "row_hash", "pos", "edges"],
                )

    return texts.mapInArrow(run, PATH + ", doc_id long, row_hash long, pos int, edges binary")


def _edges(paths: DataFrame) -> DataFrame:
    """A row per edge of distinct paths (pa, pb, n, least, edges): (id of the path, least, at, a, b); the row of a path's
    first edge also has pa, pb and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        for batch in each(batches):
            for first, part in w.slices(batch.column(4), SLICE_BYTES):
                edges = np.frombuffer(b"".join(part.to_pylist()), np.int64).reshape(-1, 2)
                n = batch.column(2).slice(first, len(part)).to_numpy()
                row = np.repeat(np.arange(len(part)), n)
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                names = [pc.if_else(pa.array(place == 0), batch.column(c).take(pa.array(first + row)), None) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(at + row), batch.column(3).take(pa.array(first + row)), pa.array(place.astype(np.int32)), pa.array(edges[:, 0]), pa.array(edges[:, 1]), *names], ["id", "least", "at", "a", "b", "pa", "pb", "n"])
                at += len(part)

    return paths.select("pa", "pb", "n", "least", "edges").mapInArrow(run, "id long, least long, at int, a long, b long, pa long, pb long, n int")


def _cut(texts: DataFrame, size: int) -> DataFrame:
    """texts (doc_id, row_hash, text, spans) without the words of the spans' windows: (doc_id, row_hash,
    n_removed, kept_sha256, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for at, part in w.slices(batch.column(2), SLICE_BYTES):
                gone, digest, kept = [], [], []
                for text, spans in zip(part.to_pylist(), batch.column(3).slice(at, len(part)), strict=True):
                    all_words = text.encode().split()
                    edge = np.zeros(len(all_words) + 1, np.int64)
                    pos, n = (spans.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + n + size - 1, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    rest = b" ".join([all_words[i] for i in np.flatnonzero(stay)])
                    gone.append(len(all_words) - int(stay.sum()))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "row_hash", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "doc_id long, row_hash long, n_removed long, kept_sha256 string, kept string")


def dedup(spark: SparkSession, docs: DataFrame, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(all, changed). all: (doc_id, row_hash, n_words, n_removed, kept_sha256) per row; changed: (doc_id,
    row_hash, kept) of the rows that lose words.

    A word goes if a window of `size` words that covers it also starts in a document with a smaller
    doc_id, judged on the input. Words are runs of anything but space and characters 9 to 13, unchanged; kept
    words are joined by one space. A null or empty text has no words; texts shorter than a window lose none. A row
    with a null doc_id loses nothing and takes nothing from others. Rows that share a doc_id
    are told apart by their text and take nothing from each other. An empty table gives an empty one; columns
    besides doc_id and text are left out. row_hash is a hash of the text.

    Counts are partly summed before each shuffle and joins on k-mers and paths hold no more than a few dozen
    bytes a row, so a passage that most documents share is neither gathered in one task nor paired.
    """
    bounded(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    read = save(spark, _read(docs, size), "substring-read")
    owned = read.filter(F.col("doc_id").isNotNull())
    mers = owned.select("doc_id", "row_hash", F.explode("mers").alias("mer"))
    # what joins with tables of many rows a key is written first, so that Spark can split such a key
    shared = save(spark, mers.groupBy("mer").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("mer"), "substring-mers")
    hints = mers.join(shared, "mer").groupBy("doc_id", "row_hash").agg(F.collect_set("mer").alias("mers"))
    texts = save(spark, docs.join(hints, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "text", "mers"), "substring-texts")
    paths = save(spark, _paths(texts, size), "substring-paths")
    key = ["pa", "pb", "n"]
    graph = save(spark, paths.groupBy(*key, "mer").agg(F.min("doc_id").alias("least")), "substring-graph")
    branching = graph.groupBy("mer").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).filter("lo < hi").select("mer")
    doubt = graph.join(branching, "mer").select(*key, "least")
    taken = paths.filter("edges is not null").select(*key, "edges").join(doubt, key).dropDuplicates(key)  # dealt by key already
    edges = save(spark, _edges(taken), "substring-edges")
    branch = save(spark, edges.groupBy("a", "b").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).filter("lo < hi").select("a", "b", "lo"), "substring-branch")
    also = edges.select("id", "least", "at", "a", "b").join(branch, ["a", "b"]).filter("lo < least").groupBy("id").agg(F.collect_list("at").alias("some"))
    also = edges.filter("at = 0").select("id", *key).join(also, "id").select(*key, "some")
    answer = save(spark, graph.select(*key, "least").join(also, key, "left"), "substring-answer")
    forget(spark, shared, graph, edges, branch)
    spans = (
        paths.select(*key, "doc_id", "row_hash", "pos")
        .join(answer, key)
        .select("doc_id", "row_hash", F.expr("case when doc_id > least then array(struct(pos as p, n as n)) when some is not null then transform(some, o -> struct(pos + o as p, 1 as n)) end").alias("spans"))
        .filter("spans is not null")
        .groupBy("doc_id", "row_hash")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )
    changed = save(spark, _cut(texts.select("doc_id", "row_hash", "text").join(spans, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "text", "spans"), size), "substring-changed")
    forget(spark, texts, paths, answer)
    new = changed.dropDuplicates(["doc_id", "row_hash"]).select("doc_id", "row_hash", "n_removed", F.col("kept_sha256").alias("new_sha256"))
    rows = read.select("doc_id", "row_hash", "n_words", "kept_sha256").join(new, ["doc_id", "row_hash"], "left")
    rows = rows.select("doc_id", "row_hash", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new_sha256", "kept_sha256").alias("kept_sha256"))
    return rows, changed.select("doc_id", "row_hash", "kept")
