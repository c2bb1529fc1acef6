"""Importance resampling towards a target distribution, by hashed word runs.

An external sort-count: texts become streams of 16-bit bucket numbers, packed and written in blocks with the offsets of their
documents; each block's stream is sorted and run-length encoded, and Spark adds the runs up, at most one for each bucket and block.
The gains of the buckets, one array of fixed length, then go to the blocks: they are gathered by the streams as they are
and summed for each document by np.add.reduceat. Texts are read once; the streams take two bytes a feature. The
draw adds to each weight a Gumbel variate that the row's id fixes, and takes the highest sums.

Defined results: a null or empty text, or one without words, has no feature and weight 0; a null id is hashed as an empty one and
comes first among ties; repeated rows are rows of their own with one score, whose ranks follow each other; an empty table gives
no row, and an empty target counts nothing; texts of any length are read whole; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import words as w
from crawlwright.llm.common import SLICE_BYTES, bounded, forget, save
from crawlwright.llm.held import each, release
from crawlwright.llm.numbering import numbered

#: Different words whose buckets a worker remembers.
KNOWN = 1 << 18
#: Letters and digits of ASCII, lower-cased, and all bytes of other characters; anything else parts words.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class Buckets:
    """Bucket numbers of the features of texts: runs of 1 to `longest` words, each by its CRC-32."""

    def __init__(self, longest: int, buckets: int):
        if not 0 < buckets <= 1 << 16:
            raise ValueError("buckets must fit 16 bits")
        self.longest, self.buckets, self.known = longest, buckets, {}

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(words, bucket of each feature as uint16)."""
        found = (text or "").encode().translate(_KEPT).split()
        runs = found
        for k in range(2, self.longest + 1):
            runs = runs + [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for x in set(runs).difference(known):
            known[x] = zlib.crc32(x) % self.buckets
        return len(found), np.fromiter(map(known.__getitem__, runs), np.uint16, len(runs))


def streams(df: DataFrame, longest: int, buckets: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per block of documents: ids, words, ends (of each document in the stream, in features), stream (packed uint16)."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        of = Buckets(longest, buckets).of
        for batch in each(batches):
            for first, texts in w.slices(batch.column(1), SLICE_BYTES):
                found = [of(t.as_py()) for t in texts]
                ends = np.cumsum([len(x) for _, x in found], dtype=np.int64)
                stream = np.concatenate([x for _, x in found]).astype("<u2").tobytes()
                ids = batch.column(0).slice(first, len(texts)).to_pylist()
                row = [[ids], [[n for n, _ in found]], [ends.tolist()], [stream]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.list_(pa.int64()),) * 3 + (pa.binary(),), strict=True)], ["ids", "words", "ends", "stream"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "ids array<long>, words array<long>, ends array<long>, stream binary")


def counted(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                held[ordered[starts]] += np.diff(np.append(starts, len(ordered)))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], ["bucket", "n"])

    # as many rows as there are buckets come to the driver, whatever the input
    rows = blocks.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the buckets' smoothed shares, target to source), one occurrence added to every bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def sums(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each run of values that ends at `ends`; 0 for an empty one."""
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    full = ends > starts
    out = np.zeros(len(ends), np.int64)
    if full.any():  # an empty run between two others takes nothing from them, so only full ones are boundaries
        out[full] = np.add.reduceat(values, starts[full])
    return out


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends = np.asarray(batch.column(2)[k].values.to_numpy(), np.int64)
                total = sums(ends, gain[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")])
                n = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, key: Column, scale: int = 1000) -> Column:
    """A Gumbel variate that seed and key fix, times scale, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(spark: SparkSession, source: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of source: doc_id, n_words, n_features, weight, score, rank (from 1; null if not drawn).

    Of the N rows with least_words words or more, floor(percent * N / 100) are drawn: those of the highest scores, ties to the smaller id.
    """
    blocks = save(spark, streams(source, longest, buckets, text, key), "resample-streams")
    wanted = counted(streams(target.withColumn("_none", F.lit(None).cast("long")), longest, buckets, text, "_none"), buckets)
    scored = weighed(blocks, gains(counted(blocks, buckets), wanted)).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    scored = save(spark, scored, "resample-scores")
    forget(spark, blocks)
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "n_features", "weight"]
    ranked = numbered(spark, scored.withColumn("fit", fit), ["fit"], order, "resample-order")
    drawn = F.col("fit") & (F.col("place") < F.expr(f"{percent} * total div 100"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))
