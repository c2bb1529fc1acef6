"""Token ids as length-delimited binary records, with an offset index beside them.

A data file is a run of frames, all numbers little-endian:

    u64 length of the payload | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload | 0x0A

A payload is i64 document id | u8 1 if the id is null | u8 bytes per token id (2 or 4) | u16 0 | token ids.
A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so that checksums of data that
hold checksums stay apart. Spark's text writer puts the frames out (the closing byte is its line end), so
files reach any file system Spark knows, and its commit protocol keeps lost or repeated tasks from
leaving half files. Files in name order hold ascending document ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from crawlwright.llm.chunks import encoded, library_cache, special_strings
from crawlwright.llm.common import bounded

_MASK = 0xA282EAD8
_HEAD, _ID = struct.Struct("<QI"), struct.Struct("<qBBH")
#: Bytes of ids that a data file holds, about, and bytes of text that make as many.
FILE_BYTES, FILE_TEXT = 32 << 20, 64 << 20


class DamagedRecord(ValueError):
    """A frame whose checksum or end doesn't match."""


def masked(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = _ID.pack(doc_id or 0, doc_id is None, ids.itemsize, 0) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"])


def frames(data) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, bytes, document id, ids) of each frame of a file's content; checks every checksum."""
    view, at = memoryview(data), 0
    while at < len(view):
        yield (at, *(got := frame_at(view, at)))
        at += got[0]


def frame_at(view: memoryview, at: int) -> tuple[int, int | None, np.ndarray]:
    """(bytes, document id, ids) of the frame at an offset."""
    if len(view) - at < _HEAD.size:
        raise DamagedRecord(f"a frame at {at} is cut off")
    length, check = _HEAD.unpack_from(view, at)
    if masked(view[at : at + 8]) != check:
        raise DamagedRecord(f"the length at {at} doesn't match its checksum")
    begin, end = at + _HEAD.size, at + _HEAD.size + length
    if end + 5 > len(view) or masked(view[begin:end]) != struct.unpack_from("<I", view, end)[0] or view[end + 4] != 10:
        raise DamagedRecord(f"the payload at {begin} doesn't match its checksum")
    doc_id, null, width, _ = _ID.unpack_from(view, begin)
    return end + 5 - at, None if null else doc_id, np.frombuffer(view[begin + _ID.size : end], f"<u{width}")


def id_width(path: str, end_id: int) -> int:
    """Bytes that an id takes: 2 if the vocabulary and end_id allow, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id + 1, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)) <= 1 << 16 else 4


def tokens(df: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids binary): whole texts by the tokenizers library, end_id appended; 2 bytes an id if the
    vocabulary allows. A null text counts as empty: its only id is end_id. Row-wise: repeated rows and null keys give a
    row each, other columns are left out, empty in, empty out."""
    width = id_width(path, end_id)
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(path), special_strings(path)
        for batch in batches:
            ids = [np.append(x, end_id).astype(f"<u{width}") for x in encoded(batch.column(1), cache, special)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], [key, "n_tokens", "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids binary")


def _dealt(df: DataFrame, value: str, key: str, files: int) -> DataFrame:
    """df's key and value, dealt to files by ranges of the key and sorted. Rows of one key may be any number: the range
    borders also take the value's hash and the row's place, so such a key is cut over several files. A null key comes first."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), files)
    placed = df.select(F.col(key).cast("long").alias(key), value, F.xxhash64(value).alias("_h"), F.monotonically_increasing_id().alias("_m"))
    return placed.repartitionByRange(n, key, "_h", "_m").sortWithinPartitions(key, "_h", "_m").select(key, value)


def _put(spark: SparkSession, frames: DataFrame, folder: str) -> None:
    frames.select(F.expr("cast(frame as string)").alias("value")).write.option("lineSep", "\n").text(f"{folder}/data")
    index(spark, folder).write.parquet(f"{folder}/index")


def write(spark: SparkSession, ids: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Writes (key, n_tokens, ids) as data files under folder/data and their index under folder/index.

    The one shuffle deals rows by ranges of the key. ids should be a written table, since dealing by ranges
    reads it twice; write_texts() needs none.
    """
    total, width = ids.agg(F.sum(F.length("ids")), F.max(F.length("ids") / F.col("n_tokens"))).first()
    width = int(width or 4)
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the writer adds the closing byte
            out = [frame(k, np.frombuffer(x, f"<u{width}"))[:-1] for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    _put(spark, _dealt(ids, "ids", key, -(-int(total or 0) // FILE_BYTES)).mapInArrow(run, "frame binary"), folder)


def write_texts(spark: SparkSession, df: DataFrame, path: str, end_id: int, folder: str, text: str = "text", key: str = "doc_id") -> None:
    """Encodes df's texts as tokens() does and writes them as write() does, in one pass: texts are dealt to the files
    and sorted, and each file's task encodes them, so the ids are stored once, in the files."""
    width = id_width(path, end_id)
    total = df.agg(F.sum(F.octet_length(text))).first()[0]
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, special = library_cache(path), special_strings(path)
        for batch in batches:
            got = encoded(batch.column(1), cache, special)
            out = [frame(k, np.append(x, end_id).astype(f"<u{width}"))[:-1] for k, x in zip(batch.column(0).to_pylist(), got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    _put(spark, _dealt(df, text, key, -(-int(total or 0) // FILE_TEXT)).mapInArrow(run, "frame binary"), folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record (none for an empty table; repeated records stay apart), from the data files alone: shard (file name), ordinal, offset, n_bytes, doc_id,
    start (ids of the records before it in the file), n_tokens, ids_crc32 (as little-endian uint32).
    Raises DamagedRecord if any frame fails its checks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, start = [], 0
                for k, (at, size, doc_id, ids) in enumerate(frames(data.as_buffer())):
                    rows.append((path.rpartition("/")[2], k, at, size, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(f"{folder}/data")
    return files.select("path", "content").mapInArrow(run, "shard string, " + ", ".join(f"{c} long" for c in INDEX[1:]))


INDEX = ["shard", "ordinal", "offset", "n_bytes", "doc_id", "start", "n_tokens", "ids_crc32"]


def read(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """(shard, place, doc_id, ids array) of all records; with a seed, each file's records come in an order
    that the seed fixes, by random access through the index. place is that order. Null ids and repeated records come back as written."""
    offsets = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("ordinal", "offset"))).alias("at"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = memoryview(data.as_buffer())
                order = np.arange(len(at)) if seed is None else np.random.default_rng([seed, zlib.crc32(shard.encode())]).permutation(len(at))
                got = [frame_at(view, at[i]["offset"]) for i in order]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(got)), pa.array(range(len(got)), pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].astype(np.int64) for g in got], pa.list_(pa.int64()))], ["shard", "place", "doc_id", "ids"])

    return files.join(offsets, "shard").select("shard", "content", "at").mapInArrow(run, "shard string, place long, doc_id long, ids array<long>")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, offset): start counts the ids of all records before it
    over all files in order. The files' totals are as many rows as there are files."""
    records = spark.read.parquet(f"{folder}/index")
    totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select(F.col("shard"), (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_before"))
    return records.join(before, "shard").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")


def round_trip(spark: SparkSession, df: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Encodes df's texts, writes them under folder and returns summary() of what was written.

    Repeated rows give a record each, a null text one with the end id alone, a null key one with a null doc_id, before
    all others; an empty table gives no record and no row; other columns are left out.
    """
    write_texts(spark, df, path, end_id, folder)
    return summary(spark, folder)
