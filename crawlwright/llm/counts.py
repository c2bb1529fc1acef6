"""Exact token counts at every prefix of a text, by dynamic programming over byte prefixes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from crawlwright.llm.chunks import ChunkCache, encoded, special_strings, split_text
from crawlwright.llm.common import bounded
from crawlwright.llm.held import once


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in means in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts the tokens of a byte-level BPE vocabulary (a .json of the tokenizers library).

    For a pre-token b, last[i] is the final token of the encoding of b[:i]. A token t that ends at i is it
    exactly if t may follow last[i - len(t)], that is, if no merge across their border would come before
    the merges that made the two. So count[i] = count[i - len(t)] + 1: one pass gives the exact count at
    every prefix, and no prefix is encoded again.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # tokens by rank: single bytes, then each merge's result in the merges' order
        self.rank = {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.joins: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = self.rank[raw(left)], self.rank[raw(right)]
            r = len(self.parts)
            self.rank.setdefault(raw(left) + raw(right), r)
            self.joins.setdefault((a, b), r)
            self.parts.append((a, b))
        self.longest = max(map(len, self.rank))
        self.special = special_strings(path)
        self.pattern = regex.compile(pattern)
        self.blank = regex.compile(r"\s")
        self.fits_known: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: taking both apart again, latest merge first, no step
        leaves neighbours that would have merged earlier."""
        key = (a, b)
        known = self.fits_known.get(key)
        if known is not None:
            return known
        joins, parts, limit, answer = self.joins, self.parts, len(self.parts) + 1, True
        while True:
            joined = joins.get((a, b))
            if joined is not None and joined < limit:
                answer = False
                break
            left_done, right_done = a < 256, b < 256
            if left_done and right_done:
                break
            # the later merge is undone; of two equal ones the right one came later
            if a > b:
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]
        if len(self.fits_known) > 500_000:
            self.fits_known.clear()
        self.fits_known[key] = answer
        return answer

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ... as one pre-token."""
        n, rank, fits, longest = len(piece), self.rank.get, self.fits, self.longest
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = rank(piece[j:i])
                if t is not None and (not j or last[j] >= 0 and fits(last[j], t)):
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    def table(self, text: str) -> np.ndarray:
        """table[k]: exact token count of text[:k] on its own, for k from 0 to len(text).

        Cutting a text changes its pre-tokens only at the cut: a blank run that a word follows gives its last
        blank to the word, while a prefix that ends in the run keeps it whole; a started contraction is a
        mark and a word; a started special string is ordinary text. These places are counted as the
        prefix has them. A text is cut between code points only.
        """
        out = np.zeros(len(text) + 1, np.int64)
        base = at = 0
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]:
            if part in self.special:
                # a prefix that ends inside it is ordinary text, from the last chunk's start on
                cuts = [m.start() for m in re.finditer(r" (?=\S)", text[since:at + 1])]
                chunk = since + (cuts[-1] if cuts else 0)
                for k in range(1, len(part)):
                    out[at + k] = out[chunk] + self._count(text[chunk : at + k])
                base += 1
                out[at + len(part)] = base
                since = at + len(part)
            else:
                since = at
                self._fill(out, at, part, base)
                base = int(out[at + len(part)])
            at += len(part)
        return out

    def _fill(self, out: np.ndarray, at: int, part: str, base: int) -> None:
        for m in self.pattern.finditer(part):
            piece = m.group()
            counts = self.prefixes(piece.encode())
            ends = np.cumsum([len(c.encode()) for c in piece])
            spot = at + m.start()
            out[spot + 1 : spot + len(piece) + 1] = [base + counts[e] for e in ends]
            if piece[0] == "'" and len(piece) == 3:  # 're, 've, 'll after two characters
                out[spot + 2] = base + self._count(piece[:2])
            if self.blank.match(piece):
                self._blanks(out, at, part, m, base)
            base += counts[-1]

    def _blanks(self, out: np.ndarray, at: int, part: str, m, base: int) -> None:
        """Prefixes that end in a blank run: the run up to there is one pre-token."""
        start = m.start()
        end = start
        while end < len(part) and self.blank.match(part[end]):
            end += 1
        run = part[start:end]
        counts = self.prefixes(run.encode())
        ends = np.cumsum([len(c.encode()) for c in run])
        before = start > 0 and self.blank.match(part[start - 1])
        if not before:
            out[at + start + 1 : at + end + 1] = [base + counts[e] for e in ends]
            self._held = (at + start + 1, [base + counts[e] for e in ends])
        else:  # the last blank of a run whose first part was its own pre-token
            first, values = self._held
            upto = at + start + 1
            if first <= upto < first + len(values) + 1:
                out[upto : upto + len(run)] = values[upto - first : upto - first + len(run)]

    def _count(self, text: str) -> int:
        return sum(self.prefixes(m.group().encode())[-1] for m in self.pattern.finditer(text))

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of text that has budget tokens at most."""
        return int(np.flatnonzero(self.table(text) <= budget)[-1])

    def cut_at(self, chunks: list[str], upto: np.ndarray, k: int, budget: int) -> int:
        """cut() of the chunks' text, where chunk k is the first whose tokens, with all before it (upto), pass the budget.
        Before a special string the chunk on its left takes part, as a cut special string is ordinary text that may join it."""
        first = k - 1 if k and chunks[k] in self.special and chunks[k - 1] not in self.special else k
        return sum(map(len, chunks[:first])) + self.cut("".join(chunks[first : k + 1]), budget - (int(upto[first - 1]) if first else 0))

    def chunk_cache(self, cap: int = 1_000_000, pieces: int = 1_200_000) -> ChunkCache:
        """chunk -> its token count, as a little-endian uint32."""
        known: dict[str, int] = {}
        findall, prefixes = self.pattern.findall, self.prefixes

        def one(piece: str) -> int:
            n = known.get(piece)
            if n is None:
                n = prefixes(piece.encode())[-1]
                if len(piece) <= 64:
                    if len(known) >= pieces:
                        known.clear()
                    known[piece] = n
            return n

        def many(chunks: list[str]) -> list[bytes]:
            return [(1 if c in self.special else sum(map(one, findall(c)))).to_bytes(4, "little") for c in chunks]

        return ChunkCache(many, cap, tails=False)


def _worker(path: str, pattern: str) -> ChunkCache:
    def make() -> ChunkCache:
        counter = PrefixCounter(path, pattern)
        cache = counter.chunk_cache()
        cache.counter = counter
        return cache

    return once(("counts", path, pattern), make)


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars): exact counts of whole texts.

    fit_chars is the length in characters of the longest prefix that has limit tokens at most: the chunk in which the
    limit is passed is found by sums, and its own table tells the place in it. Row-wise, without shuffle. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows and null keys give a row each; other columns are left out; empty in, empty out. Special
    strings inside texts are one token each, as the tokenizers library has it by default.
    """
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker(path, pattern)
        counter = cache.counter
        special = counter.special
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size, n, fit = [], [], []
            for t, each in zip(texts, encoded(batch.column(1), cache, special), strict=True):
                t = t or ""
                size.append(len(t.encode()))
                upto = np.cumsum(each, dtype=np.int64)
                n.append(int(upto[-1]) if len(upto) else 0)
                k = int(np.searchsorted(upto, limit, side="right"))
                fit.append(len(t) if k == len(upto) else counter.cut_at(split_text(t, special), upto, k, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())], [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
