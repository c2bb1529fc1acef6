"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import words as w
from crawlwright.llm.common import SLICE_BYTES, bounded
from crawlwright.llm.held import trim

#: The bounds of the training sample: rows of a language, languages, pieces of a text, words and characters of a piece.
ROWS, LANGUAGES, PIECES, PIECE_WORDS, PIECE_CHARS = 1500, 1024, 2, 60, 1200
#: Buckets that subwords are hashed to, and the embeddings' size.
BUCKETS, SIZE = 1 << 15, 16
UNKNOWN = "und"


def subwords(known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every subword of the words: runs of 2 to 4 bytes with a space before and after the word, and the word itself."""
    arr = known.cast(pa.large_binary())
    n = len(arr)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    x = np.full(len(data) + n + 1, 32, np.uint32)
    x[np.arange(len(data)) + np.repeat(np.arange(n), size) + 1] = data
    blank = x == 32
    owner = np.cumsum(blank) - 1
    buckets, owners = [], []
    for k in (2, 3, 4):
        m = len(x) - k + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        ok = owner[:m] < n
        for j in range(k):
            h |= x[j : j + m] << np.uint32(8 * j)
            if 0 < j < k - 1:
                ok &= ~blank[j : j + m]
        h = (h[ok] * np.uint32(2654435761) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        buckets.append((h >> np.uint32(32 - 15)).astype(np.int64))
        owners.append(owner[:m][ok])
    buckets.append((w.hashed(known, 5) % np.uint64(BUCKETS)).astype(np.int64))
    owners.append(np.arange(n))
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """scores: what each bucket adds to each language, the product of the embeddings and the softmax weights."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        bounds, known, codes = w.split(texts, lower=True)
        bucket, owner = subwords(known)
        n = len(known)
        per = np.bincount(owner, minlength=n).astype(float)
        out = np.empty((len(texts), len(self.languages)))
        total = np.concatenate([[0], np.cumsum(per[codes])])
        total = total[bounds[1:]] - total[bounds[:-1]]
        for c in range(len(self.languages)):
            word = np.bincount(owner, weights=self.scores[bucket, c], minlength=n)
            sums = np.concatenate([[0], np.cumsum(word[codes])])
            out[:, c] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(total, 1) + self.bias[c]
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, calibrated probability) of each text."""
        p = softmax(self.logits(texts) / self.heat)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 11, epochs: int = 6, rate: float = 1.0, batch: int = 32, lose: float = 0.001) -> Model:
    """Stochastic gradient descent on nine tenths of the pieces; the rest calibrate: the softmax's heat by
    likelihood, then the least probability to accept, which `lose` of the correctly named ones may miss."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    bounds, known, codes = w.split(pa.array(texts, pa.string()), lower=True)
    bucket, owner = subwords(known)
    order = np.argsort(owner, kind="stable")
    bucket = bucket[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(known)))])
    grams = [np.concatenate([bucket[first[c] : first[c + 1]] for c in codes[bounds[i] : bounds[i + 1]]] or [np.zeros(0, np.int64)]) for i in range(len(texts))]
    usable = np.array([len(g) > 0 for g in grams], bool)
    mixed = rng.permutation(np.flatnonzero(usable))
    held, learn = mixed[: len(mixed) // 10], mixed[len(mixed) // 10 :]
    e = rng.normal(0, 1.0, (BUCKETS, SIZE))
    weights, bias = np.zeros((SIZE, len(languages))), np.zeros(len(languages))
    share = len(learn) / len(languages) / np.maximum(1, np.bincount(y[learn], minlength=len(languages)))  # rare languages count as much
    steps, done = max(1, epochs * -(-len(learn) // batch)), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // batch))):
            if not len(rows):
                continue
            step = rate * (1 - done / steps)
            done += 1
            n = np.array([len(grams[i]) for i in rows])
            at = np.concatenate([grams[i] for i in rows])
            v = np.add.reduceat(e[at], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
            p = softmax(v @ weights + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= share[y[rows]][:, None] / len(rows)
            back = (p @ weights.T) / n[:, None]
            weights -= step * 4 * (v.T @ p)
            bias -= step * p.sum(axis=0)
            mine = np.repeat(np.arange(len(rows)), n)
            used, inverse = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(inverse, weights=back[mine, d], minlength=len(used)) for d in range(SIZE)], axis=1)
            e[used] -= step * 20 * grad
    model = Model(languages, e @ weights, bias)
    if len(held):
        x = model.logits(pa.array([texts[i] for i in held], pa.string()))
        heats = np.geomspace(0.02, 5, 60)
        model.heat = float(heats[np.argmin([-np.log(softmax(x / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in heats])])
        p = softmax(x / model.heat)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            model.least = float(min(0.4, np.quantile(p.max(axis=1)[right], lose)))
    return model


def _within(run: str, rng: np.random.Generator) -> str:
    """A run of words, or of one with very long words PIECE_CHARS characters from a place that rng gives."""
    over = len(run) - PIECE_CHARS
    if over <= 0:
        return run
    at = int(rng.integers(0, over + 1))
    return run[at : at + PIECE_CHARS]


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """A model from the rows of docs that `learn` picks and whose lang and text are given; None if there are none.

    The sample has about ROWS different texts of a language at most, picked by a hash of the text; a text that many rows have counts once. Of a text with over PIECE_WORDS
    words PIECES runs of that length are taken, at places that the hash gives, and of a run of more than PIECE_CHARS characters so many: the
    driver gets a bounded number of bytes. No language is left out; more than
    LANGUAGES labels are an error, since the classifier's size grows with them.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values; a classifier for so many doesn't fit into memory")
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, ROWS / r["count"])))])
    sample = rows.filter(F.pmod(F.col("h"), F.lit(1_000_003)) < F.coalesce(rate[F.col("lang")], F.lit(0.0)) * 1_000_003).dropDuplicates(["lang", "h"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, rng = text.split(), np.random.default_rng(h & 0xFFFFFFFF)
                if len(parts) <= PIECE_WORDS:
                    runs = [text]
                else:
                    starts = rng.integers(0, len(parts) - PIECE_WORDS + 1, PIECES)
                    # a shorter run, too: short texts are to be told apart as well
                    runs = [" ".join(parts[s : s + PIECE_WORDS // (1 + 4 * (i % 2))]) for i, s in enumerate(starts)]
                out += [(lang, _within(r, rng), h) for r in runs]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "piece", "h"), x, strict=True)) for x in out], pa.schema([("lang", pa.string()), ("piece", pa.string()), ("h", pa.int64())]))

    # no limit follows the Python stage: a task that ends early may free batches that are still being written
    got = sample.mapInArrow(pieces, "lang string, piece string, h long").toPandas().sort_values(["h", "lang", "piece"])
    model = train(got["piece"].tolist(), got["lang"].tolist()) if len(got) else None
    del got
    trim()
    return model


def identify(spark: SparkSession, docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' `keep` columns with lang_pred, score and rejected, by whole texts.

    The model learns from the rows that `learn` picks (columns lang and text); only text enters a prediction.
    lang_pred is `und` and score 0 if the text is null or has no letter, or nothing could be learned. score is
    the calibrated probability; rejected tells whether it is less than what the calibration accepts, or lang_pred
    is `und`. Row-wise but for the sample; repeated rows give a row each; empty in, empty out.
    """
    bounded(spark)
    model = spark.sparkContext.broadcast(fit(docs, learn))
    kinds = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    # only the text goes to the worker and only the answer comes back; Spark keeps the other columns meanwhile
    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for batch in batches:
            out = []
            for _, texts in w.slices(batch, SLICE_BYTES):
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if m is None:
                    best, p, letters = np.zeros(len(texts), int), np.zeros(len(texts)), letters & False
                else:
                    best, p = m.predict(texts)
                names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, p, 0.0)
                gone = ~letters | (score < (m.least if m else 1))
                out.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(gone)], fields=list(kinds)))
            yield pa.concat_arrays(out) if out else pa.array([], kinds)
            trim()

    answers = docs.select(*keep, found.asNondeterministic()("text").alias("_found"))  # so that it runs once, however many columns are read
    return answers.select(*keep, "_found.lang_pred", "_found.score", "_found.rejected")
