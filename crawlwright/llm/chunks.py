"""Whole texts to token ids by way of distinct chunks.

A chunk ends before each single space that a visible character follows. The pre-tokenizers
here never join characters across such a place, so a text's ids are its chunks' ids in
order. Nor do they join a letter or digit with the punctuation after it, so the marks at a
chunk's end are a unit of their own, and words count once whatever mark follows. Distinct
units are found in Arrow and numpy and encoded through a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crawlwright.llm.common import SLICE_BYTES
from crawlwright.llm.held import once, trim
from crawlwright.llm.words import mix

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = re.compile(r" (?=\S)")
#: Bytes that a chunk's end is cut before if an ASCII letter or digit precedes them: ASCII marks but the apostrophe, which contractions begin with.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
_SOLID = np.zeros(256, bool)
_SOLID[[b for b in range(0x30, 0x7B) if chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def split_text(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """The chunks of one text; each special string is a chunk of its own."""
    if not any(s in text for s in special):
        first, *rest = _CUT.split(text)
        return [first, *(" " + x for x in rest)]
    out: list[str] = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text):
        out += [part] if part in special else split_text(part)
    return out


class Units:
    """Byte runs data[start:end], each with or without a space before it."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: np.ndarray):
        self.data, self.start, self.end, self.spaced = data, start, end, spaced

    @staticmethod
    def of(strings: list[str]) -> Units:
        raw = [s.encode() for s in strings]
        spaced = np.array([r[:1] == b" " for r in raw], bool)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        return Units(np.frombuffer(b"".join(raw), np.uint8), end - size + spaced, end, spaced)

    def keys(self, fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each unit. fold: case and the space before don't matter."""
        size = self.end - self.start
        upto = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        run = self.data[place + np.repeat(self.start, size)]
        run = (_LOWER[run] if fold else run).astype(np.uint64) + np.uint64(1)
        tag = size.astype(np.uint64) * np.uint64(2) + (np.uint64(0) if fold else self.spaced.astype(np.uint64))
        longest = int(size.max(initial=0))
        out = []
        for salt in _SALTS:
            weights = mix(np.arange(1, longest + 1, dtype=np.uint64) * salt) | np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(run * weights[place], dtype=np.uint64)])
            out.append(mix((sums[upto[1:]] - sums[upto[:-1]]) ^ mix(tag + salt)))
        return out[0], out[1]

    def strings(self, rows: np.ndarray) -> list[str]:
        data = self.data.tobytes()
        return [(" " if s else "") + data[a:b].decode() for a, b, s in zip(self.start[rows].tolist(), self.end[rows].tolist(), self.spaced[rows].tolist(), strict=True)]


class ChunkCache:
    """unit -> value, a run of 32-bit numbers, by encode_many, which gets lists of unknown units and returns bytes.

    Known units are kept as two 64-bit hashes in sorted arrays, with the place and size of their value, about 30 bytes
    a unit. Holds at most `cap` units; a unit of more than `longest` bytes isn't kept.
    tails: marks at a chunk's end are a unit by themselves. fold: the encoder ignores ASCII case and the space before a unit.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], cap: int = 1_000_000, longest: int = 200, tails: bool = True, fold: bool = False):
        self.encode_many, self.cap, self.longest, self.tails, self.fold = encode_many, cap, longest, tails, fold
        self.held, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, how many are each unit's)."""
        got = self.encode_many(units)
        return np.frombuffer(b"".join(got), np.uint32), np.fromiter((len(x) // 4 for x in got), np.int64, len(got))

    def values(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, place, size): unit i has the value flat[place[i]:place[i] + size[i]]."""
        first, second = units.keys(self.fold)
        found, one, code = np.unique(first, return_index=True, return_inverse=True)
        alone = (second[one][code] != second).any()  # two units with one hash: each is encoded and none kept
        if alone:
            found, one, code = first, np.arange(len(first)), np.arange(len(first))
        at = np.minimum(np.searchsorted(self.held, found), max(0, len(self.held) - 1))
        known = (self.held[at] == found) & (self.check[at] == second[one]) if len(self.held) and not alone else np.zeros(len(found), bool)
        place, size = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        place[known], size[known] = self.place[at[known]], self.size[at[known]]
        new = np.flatnonzero(~known)
        numbers, counts = self.fresh(units.strings(one[new])) if len(new) else (self.flat[:0], size[:0])
        flat = np.concatenate([self.flat, numbers])
        place[new], size[new] = len(self.flat) + np.cumsum(counts) - counts, counts
        if not alone:
            keep = new[(units.end - units.start)[one[new]] <= self.longest]
            self._keep(found, second[one], place, size, flat, keep)
        return flat, place[code], size[code]

    def _keep(self, found: np.ndarray, check: np.ndarray, place: np.ndarray, size: np.ndarray, flat: np.ndarray, new: np.ndarray) -> None:
        if len(self.held) + len(new) > self.cap:  # afresh, with this slice's units
            self.held, self.check, self.place, self.size = (x[:0] for x in (self.held, self.check, self.place, self.size))
            new = np.arange(len(found))[: self.cap]
            new = new[size[new] <= self.longest]
            ends = np.cumsum(size[new])
            flat = flat[np.repeat(place[new] - (ends - size[new]), size[new]) + np.arange(ends[-1] if len(ends) else 0)]
            place = place.copy()
            place[new] = ends - size[new]
        at = np.searchsorted(self.held, found[new])
        self.held, self.check = np.insert(self.held, at, found[new]), np.insert(self.check, at, check[new])
        self.place, self.size = np.insert(self.place, at, place[new]), np.insert(self.size, at, size[new].astype(np.int32))
        self.flat = flat


class LibraryCache(ChunkCache):
    """Units encoded by the tokenizers library."""

    def __init__(self, path: str, cap: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        normal, cut = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
        lower = any(n["type"] == "Lowercase" for n in normal.get("normalizers", [normal]) if n)
        # its pattern picks words and marks and leaves the blanks between them out
        blankless = any(p["type"] == "Split" and p.get("invert") and p.get("behavior") == "Removed" and not p["pattern"].get("Regex", " ").count(" ") for p in cut.get("pretokenizers", [cut]) if p)
        super().__init__(lambda units: [], cap, fold=lower and blankless)
        self.library = Tokenizer.from_file(path)

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for at in range(0, len(units), 1000):  # lists of words, since an answer for each would hold more than its ids
            part = units[at : at + 1000]
            e = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)


def encoded(texts: pa.Array, cache: ChunkCache, special: tuple[str, ...] = ()) -> Iterator[np.ndarray]:
    """For each text (null: empty), in order, its chunks' values put together as an array of 32-bit numbers."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        begun = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, begun + SLICE_BYTES, side="right")))
        yield from _slice(texts.slice(at, upto - at), cache, special)
        at = upto
        trim()


def _gather(flat: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs flat[place:place + size] one after another, where each begins and the last ends)."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(place - upto[:-1], size) + np.arange(upto[-1])], upto


def _slice(texts: pa.Array, cache: ChunkCache, special: tuple[str, ...]) -> Iterator[np.ndarray]:
    odd = pc.match_substring_regex(texts, f" $| [{_SPACES}]")
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    odd = odd.to_numpy(zero_copy_only=False)
    ids, bounds = _even(texts.filter(pa.array(~odd)), cache)
    lists = [split_text(t, special) for t in texts.filter(pa.array(odd)).to_pylist()]
    slow, each = _gather(*cache.values(Units.of([c for x in lists for c in x]))) if lists else (ids[:0], np.zeros(1, np.int64))
    each = each[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)]
    k = j = 0
    for is_odd in odd:
        if is_odd:
            yield slow[each[j] : each[j + 1]]
            j += 1
        else:
            yield ids[bounds[k] : bounds[k + 1]]
            k += 1


def _even(texts: pa.Array, cache: ChunkCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin) of texts whose chunks are what lies between single spaces."""
    lists = pc.split_pattern(texts, " ")
    ends = lists.offsets.to_numpy()
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.large_string())
    n = len(known)
    if not n:
        return cache.flat[:0], np.zeros(len(texts) + 1, np.int64)
    border = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + n + 1]
    raw = known.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    codes = words.indices.to_numpy().astype(np.int64)
    heads, head = np.unique(codes[ends[:-1]], return_inverse=True)  # the first chunk of a text has no space before it
    codes[ends[:-1]] = n + head
    which = np.concatenate([np.arange(n), heads])
    start, end = border[:-1][which], border[1:][which]
    spaced = np.arange(len(which)) < n
    cut = end.copy()
    if cache.tails and len(data):
        for _ in range(16):
            cut -= (cut > start) & _MARK[data[np.maximum(cut - 1, 0)]]
        cut = np.where((cut > start) & _SOLID[data[np.maximum(cut - 1, 0)]], cut, end)
    tail = np.flatnonzero(cut < end)
    flat, place, size = cache.values(Units(data, np.concatenate([start, cut[tail]]), np.concatenate([cut, end[tail]]), np.concatenate([spaced, np.zeros(len(tail), bool)])))
    # each chunk's numbers: those of its word, then those of its marks
    both = np.zeros((len(which), 2), np.int64), np.zeros((len(which), 2), np.int64)
    for pair, x in zip(both, (place, size), strict=True):
        pair[:, 0], pair[tail, 1] = x[: len(which)], x[len(which) :]
    flat, upto = _gather(flat, both[0].ravel(), both[1].ravel())
    begin = upto[:-1:2]
    each = (upto[2::2] - begin)[codes]
    ids, upto = _gather(flat, begin[codes], each)
    return ids, upto[ends]


def library_cache(path: str) -> ChunkCache:
    """Chunks encoded by the tokenizers library from the file at path; values are ids."""
    return once(("library", path), lambda: LibraryCache(path))


def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))
