"""Removal of lines that many documents share, by a sharded minimal perfect hash over the hashes of these lines.

Lines are hashed to 128 bits by their keys: stripped of blanks at both ends, A-Z in lower case. Each document reports its distinct
hashes, added up in the worker and by Spark before and after the shuffle; no line's text is moved. The hashes found in enough documents are dealt to
shards by a hash, and each shard becomes a minimal perfect hash: a number of bit arrays, in which a key takes the bit that no other key of its
level wants, and the rank of that bit is the key's slot. A slot holds a fingerprint (64 bits of the hash that don't choose the
shard) and the count of documents. A line that isn't in the index lands in some slot, where the fingerprint differs.

Documents probe the arrays while they are read. The index is sent to the workers if it has BROADCAST_BYTES at most, which is
checked; a larger one stays where its shards are, and the documents' hashes are dealt to copies of the shards, from where only
hits come back. Both ways give the same rows.

Defined results: a null or empty text is one empty line; a line without characters but blanks is never dropped, unless least_chars is 0; a text all
of whose lines go keeps the empty string; repeated rows each count as a document; null ids and other columns pass; an empty table
gives no rows. Lines are equal if 128 bits of their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import words as w
from crawlwright.llm.common import SLICE_BYTES, bounded, forget, save
from crawlwright.llm.held import each, release

#: Keys of a shard, about, and bytes of an index that goes to every worker at most.
SHARD_KEYS, BROADCAST_BYTES = 1 << 18, 32 << 20
#: Bits of a level for each key that is left, and levels before the rest is kept as it is.
SPREAD, LEVELS = 2, 40
#: Copies of a shard among which its probes are dealt, where the index isn't sent.
COPIES = 16
_BLANKS = b" \t\n\x0b\x0c\r"
_NO_HASH = np.zeros((0, 2), np.uint64)


class Shard:
    """A minimal perfect hash over rows (a, b) of 64-bit numbers: slots from 0 without gaps, one for each key."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, keys: np.ndarray) -> Shard:
        sizes, parts, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            bits = -(-SPREAD * len(left) // 64) * 64
            at = _bit(left, len(sizes), bits)
            wanted = np.bincount(at, minlength=bits)
            parts.append(np.packbits(wanted == 1, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left = left[wanted[at] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64), left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys that aren't in the set get any slot, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.sizes.tolist()):
            at = _bit(keys[open_], level, bits)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
            if not len(open_):
                break
        for k, key in enumerate(self.rest):  # keys that met in every level, practically none
            out[open_[(keys[open_] == key).all(axis=1)]] = self.ranks[-1] + k
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.rest)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.sizes.astype("<i8"), self.words.astype("<u8"), self.rest.astype("<u8")))

    @classmethod
    def unpacked(cls, data) -> Shard:
        a, b, c = np.frombuffer(data, "<i8", 3).tolist()
        sizes = np.frombuffer(data, "<i8", a, 24)
        words = np.frombuffer(data, "<u8", b, 24 + 8 * a)
        return cls(sizes, words, np.frombuffer(data, "<u8", 2 * c, 24 + 8 * (a + b)).reshape(-1, 2))


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (w.mix(keys[:, 0] ^ w.mix(keys[:, 1] + salt)) % np.uint64(bits)).astype(np.int64)


class Index:
    """Shards by the first number of a key: hash, fingerprints and counts."""

    def __init__(self, shards: int, parts: dict[int, tuple[bytes, bytes, bytes]]):
        self.shards = shards
        self.parts = {s: (Shard.unpacked(h), np.frombuffer(f, "<u8"), np.frombuffer(c, "<i8")) for s, (h, f, c) in parts.items()}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """In how many documents each key was found; 0 if it isn't in the index."""
        out = np.zeros(len(keys), np.int64)
        shard = (keys[:, 0] % np.uint64(self.shards)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.parts:
                hashed, prints, counts = self.parts[s]
                at = np.flatnonzero(shard == s)
                slot = hashed.slots(keys[at])
                known = (slot >= 0) & (prints[slot] == keys[at, 1])
                out[at[known]] = counts[slot[known]]
        return out


def hashes(text: str | None, least_chars: int = 1) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(lines, whether each can be dropped, the hashes of those that can as rows of two numbers)."""
    lines = (text or "").encode().split(b"\n")
    keys = [x.strip(_BLANKS).lower() for x in lines]  # of bytes: A-Z only
    long = np.fromiter((len(k) >= least_chars and (len(k) >= 4 * least_chars or len(k.decode()) >= least_chars) for k in keys), bool, len(keys))
    data = b"".join(xxhash.xxh3_128_digest(k) for k, ok in zip(keys, long.tolist(), strict=True) if ok)
    return lines, long, np.frombuffer(data, "<u8").reshape(-1, 2) if data else _NO_HASH


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, how often each)."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))


def document_counts(df: DataFrame, least_chars: int = 1, text: str = "text") -> DataFrame:
    """(a, b, n): the hashes of lines, as two signed numbers, and the number of rows that have such a line."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in each(batches):
            for _, texts in w.slices(batch.column(0), SLICE_BYTES):
                found = [_distinct(hashes(t.as_py(), least_chars)[2])[0] for t in texts]
                keys, n = _distinct(np.concatenate([_NO_HASH, *found]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(n, pa.int64())], ["a", "b", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def index(spark: SparkSession, counted: DataFrame) -> tuple[DataFrame, int]:
    """(a row for each shard: shard, keys, hash, prints, counts; number of shards) over the keys (a, b, n) of a written table."""
    shards = max(1, -(-counted.count() // SHARD_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.stack([rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)], axis=1).view(np.uint64)
        hashed = Shard.of(keys)
        slot = hashed.slots(keys)
        prints, counts = np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<i8")
        prints[slot], counts[slot] = keys[:, 1], rows["n"].to_numpy(np.int64)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "keys": [len(keys)], "hash": [hashed.packed()], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})

    # a shard has SHARD_KEYS keys, about: the hash deals them evenly, and each key is one row
    shard = F.expr(f"pmod(pmod(a, {shards}) + if(a < 0, {(1 << 64) % shards}, 0), {shards})").alias("shard")  # of the number without sign
    built = counted.select(shard, "a", "b", "n").groupBy("shard").applyInPandas(build, "shard long, keys long, hash binary, prints binary, counts binary")
    return save(spark, built, "lines-index"), shards


def _kept(text: str | None, hit, least_chars: int) -> tuple[int, int, str]:
    """(lines, dropped lines, the text of the others)."""
    lines, long, keys = hashes(text, least_chars)
    drop = np.zeros(len(lines), bool)
    drop[long] = hit(keys)
    return len(lines), int(drop.sum()), b"\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d).decode()


def _rows(df: DataFrame, look, least_chars: int) -> DataFrame:
    """row, n_lines, n_dropped, kept of df's row, text and, if it has them, hits; look(hits of a row) gives the test of hashes."""
    with_hits = "hits" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in each(batches):
            for first, texts in w.slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(first, len(texts))
                given = part.column(2).to_pylist() if with_hits else [None] * len(texts)
                done = [_kept(t.as_py(), look(g), least_chars) for t, g in zip(texts, given, strict=True)]
                n, dropped, kept = zip(*done, strict=True) if done else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept"])

    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema["row"].dataType.fields)
    return df.mapInArrow(run, f"row struct<{row}>, n_lines long, n_dropped long, kept string")


def _sent(spark: SparkSession, docs: DataFrame, built: DataFrame, shards: int, least_docs: int, least_chars: int) -> DataFrame:
    """The index goes to the workers."""
    parts = spark.sparkContext.broadcast({r["shard"]: (bytes(r["hash"]), bytes(r["prints"]), bytes(r["counts"])) for r in built.collect()})
    held: dict = {}

    def look(_):
        if not held:
            held["index"] = Index(shards, parts.value)
        return lambda keys: held["index"].counts(keys) >= least_docs

    return _rows(docs, look, least_chars)


def _routed(spark: SparkSession, docs: DataFrame, built: DataFrame, shards: int, least_docs: int, least_chars: int) -> DataFrame:
    """The documents' hashes go to the shards: texts by their own hash, the hashes of one text and shard in one row; equal
    texts ask once. A shard's rows are dealt among its copies, and stream past its arrays."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            out = []
            for t in batch.column(0):
                keys = _distinct(hashes(t.as_py(), least_chars)[2])[0]
                name, shard = xxhash.xxh3_128_digest((t.as_py() or "").encode()), keys[:, 0] % np.uint64(shards)
                out += [(int(s), name, keys[shard == s].tobytes()) for s in np.unique(shard)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "name", "asked"])

    asked = docs.select("text").mapInArrow(ask, "shard long, name binary, asked binary").dropDuplicates(["shard", "name"])
    none = F.lit(None).cast("binary")
    arrays = built.select("shard", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), F.lit(0).alias("kind"), none.alias("name"), none.alias("asked"), "hash", "prints", "counts")
    asked = asked.select("shard", F.pmod(F.xxhash64("name"), F.lit(COPIES)).cast("int").alias("copy"), F.lit(1).alias("kind"), "name", "asked", *[none.alias(c) for c in ("hash", "prints", "counts")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index | None = None
        for batch in batches:
            names, hits = [], []
            for k, kind in enumerate(batch.column("kind").to_pylist()):
                r = {c: batch.column(c)[k].as_py() for c in (("shard", "hash", "prints", "counts") if kind == 0 else ("shard", "name", "asked"))}
                if kind == 0:
                    held = Index(shards, {r["shard"]: (r["hash"], r["prints"], r["counts"])})
                elif held and r["shard"] in held.parts:
                    keys = np.frombuffer(r["asked"], "<u8").reshape(-1, 2)
                    keys = keys[held.counts(keys) >= least_docs]
                    if len(keys):
                        names.append(r["name"])
                        hits.append(keys.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hits, pa.binary())], ["name", "hits"])

    both = arrays.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    hits = both.mapInArrow(answer, "name binary, hits binary").groupBy("name").agg(F.collect_list("hits").alias("hits"))

    def name(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(texts):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], ["row", "text", "name"])

    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema["row"].dataType.fields)
    named = docs.mapInArrow(name, f"row struct<{row}>, text string, name binary")

    def look(found):
        dropped = {bytes(x[i : i + 16]) for x in found or () for i in range(0, len(x), 16)}
        return lambda keys: np.fromiter((k.tobytes() in dropped for k in keys), bool, len(keys))

    return _rows(named.join(hits, "name", "left").select("row", "text", "hits"), look, least_chars)


def dedup(spark: SparkSession, df: DataFrame, least_docs: int = 10, least_chars: int = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of df, n_lines, n_dropped, kept: the text without lines that least_docs rows or more have in common.

    Lines end at a line feed. A line's key is the line without blanks (space and the characters 9 to 13) at both ends, A-Z in lower case; keys
    under least_chars code points stay. Names in `keep` must not be n_lines, n_dropped or kept.
    """
    bounded(spark)
    counted = save(spark, document_counts(df, least_chars, text).filter(F.col("n") >= least_docs), "lines-counted")
    built, shards = index(spark, counted)
    forget(spark, counted)
    size = built.agg(F.sum(F.expr("length(hash) + length(prints) + length(counts)"))).first()[0] or 0
    docs = df.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    way = _sent if size <= BROADCAST_BYTES else _routed
    return way(spark, docs, built, shards, least_docs, least_chars).select("row.*", "n_lines", "n_dropped", "kept")
