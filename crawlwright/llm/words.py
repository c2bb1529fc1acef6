"""Words of whole texts as hashed numbers, and rolling hashes over runs of them, for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from crawlwright.llm.held import release

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(bounds, distinct words, codes): text i has the words codes[bounds[i]:bounds[i + 1]].

    Words are runs of anything but space and the characters 9 to 13; a null text has none. lower: A-Z only.
    """
    release()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy()
    words = pc.ascii_lower(lists.values) if lower else lists.values  # ascii_lower goes wrong on a slice of an array
    words = words.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    codes = words.indices.to_numpy()
    blank = pc.index(words.dictionary, "").as_py() if len(words.dictionary) else -1
    ends = ends - ends[0]
    if blank >= 0:
        full = codes != blank
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        codes = codes[full]
    return ends.astype(np.int64), words.dictionary, codes


def hashed(words: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any run of words in constant time: prefix sums of word hash times base**position, modulo 2**64,
    divided by base**start. Two different runs get the same hash with probability about 2**-58."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        base = _BASES[seed]
        n = len(hashes)
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n), dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the run of `size` words from each place on."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.back[:n])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    p = 1
    while 2 * p <= width:
        x = np.minimum(x[:-p], x[p:]) if len(x) > p else x[:0]
        p *= 2
    rest = width - p
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def inside(bounds: np.ndarray, size: int, count: int) -> np.ndarray:
    """For each of count places: whether a run of `size` words from there stays in one text."""
    ok = np.zeros(count, bool)
    step = np.zeros(count + 1, np.int64)
    long = np.diff(bounds) >= size
    np.add.at(step, bounds[:-1][long], 1)
    np.add.at(step, bounds[1:][long] - size + 1, -1)
    ok[:] = np.cumsum(step)[:count] > 0
    return ok


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of texts in parts of about limit bytes at most; a longer text is a part by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield at, texts.slice(at, upto - at)
        at = upto


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, in batches of about limit bytes in the text column; a longer text goes alone."""
    held, size = [], 0
    for batch in batches:
        for at, texts in slices(batch.column(column), limit):
            held.append(batch.slice(at, len(texts)))
            size += pc.sum(pc.fill_null(pc.binary_length(texts), 0)).as_py() or 0
            if size >= limit // 2:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
