"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from crawlwright.llm.chunks import ChunkCache, encoded
from crawlwright.llm.common import bounded
from crawlwright.llm.held import once

_BLOCK = 8  # a block of the bitmap spans 2**8 ranks


class RankQueue:
    """Positions by merge rank. A two-level bitmap tells which ranks have positions: one bit of
    `top` per block of 256 ranks, one bit of `blocks[b]` per rank. Find-first-set on either level
    gives the least rank in constant time, however many positions wait. A rank's positions form a
    heap, so that equal ranks leave from left to right."""

    def __init__(self, n_ranks: int):
        self.top, self.blocks, self.buckets = 0, [0] * ((n_ranks >> _BLOCK) + 1), {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            b = rank >> _BLOCK
            self.blocks[b] |= 1 << (rank & 255)
            self.top |= 1 << b
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """(least rank, its leftmost position), or None."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        block = self.blocks[b]
        rank = (b << _BLOCK) + (block & -block).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.blocks[b] = block = block & (block - 1)
            if not block:
                self.top &= top - 1
        return rank, position


class ByteBpe:
    """Encodes and decodes by a rank file (one base64 token and its rank per line) and a split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.queue = RankQueue(len(self.tokens))
        self.findall = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The pieces form a linked list over byte positions; every pair of
        neighbours whose bytes are a token waits in the queue. An entry is stale if its piece has been
        merged away or its pair now has another length. O(n log n) for a pre-token of n bytes."""
        rank_of, queue, lengths = self.ranks.get, self.queue, self.lengths
        n = len(piece)
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        after = list(range(1, n + 1))  # where the piece that starts here ends
        before = list(range(-1, n - 1))  # where the piece on the left starts
        push, pop = queue.push, queue.pop
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                push(rank, i)
        while (found := pop()) is not None:
            rank, i = found
            mid = after[i]
            if not mid or mid >= n or after[mid] - i != lengths[rank]:
                continue
            end = after[mid]
            after[i], after[mid] = end, 0
            if end < n:
                before[end] = i
                rank = rank_of(piece[i : after[end]])
                if rank is not None:
                    push(rank, i)
            left = before[i]
            if left >= 0:
                rank = rank_of(piece[left:end])
                if rank is not None:
                    push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [t for m in self.finditer(text) for t in self.merge(m.group().encode())]

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def chunk_cache(self, cap: int = 1_000_000, pieces: int = 400_000) -> ChunkCache:
        known: dict[str, bytes] = {}
        findall, merge = self.findall, self.merge

        def one(piece: str) -> bytes:
            value = known.get(piece)
            if value is None:
                value = np.array(merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(known) >= pieces:
                        known.clear()
                    known[piece] = value
            return value

        return ChunkCache(lambda chunks: [b"".join(map(one, findall(c))) for c in chunks], cap)


def _worker(path: str, pattern: str) -> tuple[ByteBpe, ChunkCache]:
    def make() -> ChunkCache:
        bpe = ByteBpe(path, pattern)
        cache = bpe.chunk_cache()
        cache.bpe = bpe
        return cache

    cache = once(("bpe", path, pattern), make)
    return cache.bpe, cache


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids): ids are little-endian uint32, as binary.

    A row-wise operator: no shuffle, and bounded memory besides the longest text. A null text counts as
    empty and gives no ids; repeated rows and null keys give a row each; other columns are left out; an
    empty table gives an empty one. Special strings are ordinary text. Texts are encoded whole.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _worker(path, pattern)
        for batch in batches:
            ids = [x.tobytes() for x in encoded(batch.column(1), cache)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [key, "n_tokens", "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_tokens long, ids binary")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, bytes) of ids as encode() gives them; null ids give null. Row-wise: repeated rows and null keys give a row each, other
    columns are left out, an empty table gives an empty one."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _worker(path, pattern)
        for batch in batches:
            got = [None if x is None else bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], [key, "bytes"])

    return df.select(key, ids).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes whole texts and decodes the ids in one pass,
    so that the ids themselves needn't leave the worker. Rows as for encode()."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _worker(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in encoded(batch.column(1), cache):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
