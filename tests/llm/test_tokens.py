"""Operators 4, 5, 6 and 10 against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlwright.llm import bpe, chunks, counts, packing, records
from crawlwright.llm.common import BATCH_BYTES, fresh_path, save

RANKS, BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'", "l", "é", "ñ", "日本", "1", "23", "!!", "\xa0", "　", "\x1f", "\x85", "<|endoftext|>", "<|end", "text|>", "ing", " and", "Σ", "́", "😀", "²", "Ⅷ"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    return ["".join(rng.choices(PIECES, k=rng.randrange(15))) for _ in range(3000)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(odd, reference):
    own = bpe.ByteBpe(RANKS, P.PATTERN)
    for text, ids in zip(odd, chunks.encoded(pa.array(odd), own.chunk_cache()), strict=True):
        assert ids.tolist() == own.encode(text) == reference.encode_ordinary(text)
        assert own.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 5000, "a" * 7001, "-" * 4000, "abcabd" * 900])
def test_bpe_on_long_pieces(text, reference):
    own = bpe.ByteBpe(RANKS, P.PATTERN)
    assert own.merge(text.encode()) == reference.encode_ordinary(text)
    assert own.queue.pop() is None


def test_rank_queue_pops_ranks_in_order_and_left_to_right():
    q, rng = bpe.RankQueue(50000), random.Random(1)
    items = [(rng.randrange(50000), i) for i in range(500)] + [(7, 3), (7, 1), (7, 2)]
    for rank, at in items:
        q.push(rank, at)
    assert [q.pop() for _ in items] == sorted(items)
    assert q.pop() is None and q.top == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_equal_the_library(odd, path):
    library = Tokenizer.from_file(path)
    got = chunks.encoded(pa.array([*odd, None]), chunks.library_cache(path), chunks.special_strings(path))
    for text, ids in zip([*odd, ""], got, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded_and_changes_nothing(odd):
    calls = []
    cache = chunks.ChunkCache(lambda xs: [calls.append(x) or len(x).to_bytes(4, "little") for x in xs], cap=10)
    assert [x.sum() for x in chunks.encoded(pa.array(odd[:300]), cache)] == [sum(map(len, chunks.split_text(t))) for t in odd[:300]] == [len(t) for t in odd[:300]]
    assert len(cache.held) <= 10


def test_prefix_counts_are_exact(odd):
    library, own = Tokenizer.from_file(BYTES), counts.PrefixCounter(BYTES, P.PATTERN)
    for text in odd[:700]:
        prefixes = [text[:k] for k in range(len(text) + 1)]
        want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert own.table(text).tolist() == want
        assert own.cut(text, 3) == max(k for k, n in enumerate(want) if n <= 3)


def test_digests(spark, docs, empty, rows, reference):
    got = sorted(map(tuple, bpe.digests(docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t, _ in rows)


def test_counts(spark, docs, empty, rows):
    library = Tokenizer.from_file(BYTES)
    got = sorted(map(tuple, counts.count_tokens(docs, BYTES, P.PATTERN).drop("fit_chars").collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    for r in counts.count_tokens(docs.filter("doc_id in (110, 112)"), BYTES, P.PATTERN).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 1024
    assert counts.count_tokens(empty, BYTES, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [2048, 256, 100])
def test_packing(spark, docs, empty, rows, size):
    library = Tokenizer.from_file(BYTES)
    got = packing.pack(spark, docs, BYTES, 1, size).collect()
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    padding = 0
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
        padding += size - end
    assert padding < 0.05 * size * len(sequences) + size
    for i, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = parts[i, len(ids)]
        for start in range(0, len(ids), size):
            piece = ids[start : start + size]
            assert (start, len(piece), zlib.crc32(piece.tobytes())) in mine
    assert sum(map(len, parts.values())) == sum(-(-len(library.encode(t or "", add_special_tokens=False).ids + [1]) // size) for _, t, _ in rows)
    assert packing.pack(spark, empty, BYTES, 1, size).count() == 0


def test_packed_sequences_hold_the_ids(spark, docs, rows):
    own = docs.filter("doc_id between 1 and 109")
    packed = save(spark, packing.pack(spark, own, BYTES, 1, 128), "packed")
    library = Tokenizer.from_file(BYTES)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows if i and i < 110}
    got = {r.sequence_id: r.ids for r in packing.sequences(own, packed, BYTES, 1).collect()}
    for r in packed.collect():
        assert got[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


def test_plan_covers_the_demand_exactly():
    rng = np.random.default_rng(2)
    for _ in range(5):
        lengths = np.sort(rng.choice(np.arange(1, 129), 40, replace=False))
        demand = rng.integers(1, 60, 40)
        held = np.zeros(40, int)
        n = 0
        for p in packing.plan(lengths, demand, 128):
            assert sum(lengths[i] * k for i, k in p.slots.items()) <= 128
            n += p.times
            for i, k in p.slots.items():
                held[i] += k * p.times
        assert (held == demand).all()
        least = sum(t for t, _ in packing.relax(lengths, demand.astype(float), 128))  # no plan can do with less, but for the gap
        assert 0.99 * least <= n <= 1.01 * least + 3


def test_knapsack_is_optimal():
    rng = np.random.default_rng(4)
    lengths, values = np.array([3, 5, 7, 11]), rng.random(4)
    best = np.zeros(41)
    for c in range(1, 41):
        best[c] = max([best[c - 1], *(best[c - n] + v for n, v in zip(lengths, values, strict=True) if n <= c)])
    got, slots = packing.price(lengths, values, 40)
    assert got == pytest.approx(best[40]) == pytest.approx(sum(values[i] * k for i, k in slots.items()))


def test_records_round_trip(spark, docs, empty, rows):
    library = Tokenizer.from_file(WORDS)
    folder = fresh_path(spark, "records")
    got = [tuple(r)[:4] for r in records.round_trip(spark, docs, WORDS, 1, folder).orderBy("start").collect()]
    ids = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[0] for g in got] == [i for i, _ in ids]
    at = 0
    for i, start, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for j, x in ids if j == i}
    back = sorted((str(r.doc_id), r.ids) for r in records.read(spark, folder, seed=4).collect())
    assert back == sorted((str(i), x) for i, x in ids)
    mixed = [r.doc_id for r in records.read(spark, folder, seed=4).collect()]
    assert mixed != [r.doc_id for r in records.read(spark, folder).collect()]
    assert records.round_trip(spark, empty, WORDS, 1, fresh_path(spark, "records")).count() == 0


def test_damage_is_noticed():
    data = b"".join(records.frame(i, np.arange(i + 2, dtype="<u2")) for i in range(4))
    assert [(d, x.tolist()) for _, _, d, x in records.frames(data)] == [(i, list(range(i + 2))) for i in range(4)]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(records.DamagedRecord):
            list(records.frames(bytes(broken)))
    with pytest.raises(records.DamagedRecord):
        list(records.frames(data[:-3]))


def test_count_tokens_cuts_where_the_prefix_table_does(spark, odd):
    own = counts.PrefixCounter(BYTES, P.PATTERN)
    df = spark.createDataFrame(list(enumerate(odd[:400])), "doc_id long, text string")
    for limit in (0, 1, 4):
        for r in counts.count_tokens(df, BYTES, P.PATTERN, limit).collect():
            assert r["fit_chars"] == own.cut(odd[r["doc_id"]], limit)


def test_cache_starts_afresh_beyond_its_bound(odd):
    library = Tokenizer.from_file(WORDS)
    small = chunks.LibraryCache(WORDS, cap=40)
    for text, ids in zip(odd * 2, (x for i in range(0, 6000, 50) for x in chunks.encoded(pa.array((odd * 2)[i : i + 50]), small, chunks.special_strings(WORDS))), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < len(small.held) <= 40


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """Arrow batches follow bytes: rows of half a megabyte don't travel ten thousand at a time."""
    long = spark.range(120).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id, ' other. '), 40000)").alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        assert records.tokens(long, WORDS, 1).agg(F.sum("n_tokens")).first()[0] > 120 * 3 * 40000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES
        seen = long.coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long")
        assert seen.agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
