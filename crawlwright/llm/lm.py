"""Language-model scoring: a gated recurrent network over words with a class-factored output softmax.

The vocabulary is the most frequent words of the training documents, in classes of neighbours by frequency.
Every other word belongs to a class by its form; within such a class its probability is its smoothed share of
the corpus counts, so every word has a probability, and the counts behind it cover all training documents.
The network predicts the class, and for vocabulary classes the word in it.

Training is truncated backpropagation through time in numpy. A bounded sample warms the network up on the
driver; then each task trains a copy over all training documents of its partition, and the copies'
parameters are averaged, weighted by tokens. Scoring runs every document from its first word to its end mark
with the state carried from window to window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import words as w
from crawlwright.llm.common import bounded, most_frequent, save
from crawlwright.llm.held import trim

#: Vocabulary classes and words of one; classes of other words by form; size of the state.
CLASSES, MEMBERS, FORMS, STATE = 32, 32, 48, 16
VOCABULARY = CLASSES * MEMBERS
#: Words whose counts are broadcast; counts of rarer ones are joined.
KNOWN = 200_000
#: Steps of a window, texts side by side, bytes of the warm-up sample, about, and characters of a piece of it at most: long texts are cut.
WINDOW, LANES, WARM, WARM_LENGTH = 48, 256, 2_500_000, 20_000
#: Stands for the end of a text; no word is empty.
END = ""


def forms(known: pa.Array) -> np.ndarray:
    """Class of each word by its form: the last two characters besides closing marks, hashed."""
    tail = pc.utf8_slice_codeunits(pc.ascii_rtrim(known.cast(pa.large_string()), characters=".,;:!?$%&*#'\")|"), -2)
    tail = tail.dictionary_encode()
    return (w.hashed(tail.dictionary, 9) % np.uint64(FORMS)).astype(np.int64)[tail.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Net:
    """x: what each input adds to the gates (update, reset, candidate); u, b: state to gates; c: state to classes; m: state to words of a class."""

    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    m: np.ndarray
    mb: np.ndarray

    @staticmethod
    def fresh(class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 5) -> Net:
        """Starts as the unigram model: the biases are the counts' logarithms."""
        rng, h = np.random.default_rng(seed), STATE
        f = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        return Net(f(VOCABULARY + FORMS, 3 * h, k=0.3), f(h, 3 * h, k=1 / np.sqrt(h)), np.zeros(3 * h, np.float32), f(h, CLASSES + FORMS), np.log(class_counts + 1.0).astype(np.float32), f(CLASSES, h, MEMBERS), np.log(word_counts.reshape(CLASSES, MEMBERS) + 0.5).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.c, self.cb, self.m, self.mb]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, values: np.ndarray) -> Net:
        out, at = [], 0
        for p in self.parts():
            out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Net(*out)

    def run(self, ids: np.ndarray, first: np.ndarray, state: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States after each of ids (steps x lanes), afresh where first; keep gets what backpropagation needs."""
        h, out = STATE, np.empty((*ids.shape, STATE), np.float32)
        if keep is not None:
            keep |= {"before": np.empty_like(out), "zr": np.empty((*ids.shape, 2 * h), np.float32), "n": np.empty_like(out), "a": np.empty_like(out)}
        starts = first.any(axis=1)
        for t in range(len(ids)):
            x = self.x[ids[t]]
            if starts[t]:
                state = state * ~first[t][:, None]
            a = state @ self.u
            a += self.b
            zr = sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            n = zr[:, h:] * a[:, 2 * h :]
            n += x[:, 2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep["before"][t], keep["zr"][t], keep["n"][t], keep["a"][t] = state, zr, n, a[:, 2 * h :]
            state = state - n
            state *= zr[:, :h]
            state += n
            out[t] = state
        return out

    def output(self, states: np.ndarray, targets: np.ndarray, back: bool = False):
        """Log probability (natural) of each target after its state; with back also the gradients of their negative sum."""
        cls = np.where(targets < VOCABULARY, targets // MEMBERS, targets - VOCABULARY + CLASSES)
        got, s, total = shares(states, self.c, self.cb, cls)
        order, border = by_number(cls, CLASSES + FORMS)
        if back:
            # the softmax less one at the target; its division goes to the smaller factors
            part = np.reciprocal(total)
            ds = s @ self.c.T
            ds *= part[:, None]
            ds -= self.c.T[cls]
            dc, dcb = (states * part[:, None]).T @ s, part @ s
            dc -= sums_by(states, order, border).T
            dcb -= np.diff(border)
            dm, dmb = np.zeros_like(self.m), np.zeros_like(self.mb)
        for k in range(CLASSES):
            mine = order[border[k] : border[k + 1]]
            if not len(mine):
                continue
            hs = states[mine]
            at = targets[mine] - k * MEMBERS
            more, o, total = shares(hs, self.m[k], self.mb[k], at)
            got[mine] += more
            if back:
                o /= total[:, None]
                o[np.arange(len(mine)), at] -= 1
                dm[k], dmb[k] = hs.T @ o, np.ones(len(o), np.float32) @ o
                ds[mine] += o @ self.m[k].T
        return (got, ds, (dc, dcb, dm, dmb)) if back else got

    def learn(self, ids: np.ndarray, first: np.ndarray, targets: np.ndarray, real: np.ndarray, state: np.ndarray, sums: list[np.ndarray], rate: float) -> np.ndarray:
        """One window of truncated backpropagation and a step of stochastic gradient descent, scaled by each
        parameter's gradients so far (sums). Returns the state to carry on."""
        h, kept = STATE, {}
        out = self.run(ids, first, state, kept)
        at = np.flatnonzero(real.ravel())
        _, ds, (dc, dcb, dm, dmb) = self.output(out.reshape(-1, h)[at], targets.ravel()[at], back=True)
        douts = np.zeros((ids.size, h), np.float32)
        douts[at] = ds
        douts = douts.reshape(*ids.shape, h)
        # what the step back multiplies with doesn't depend on it and is made for all steps at once
        before, n, z, r = kept["before"], kept["n"], kept["zr"][..., :h], kept["zr"][..., h:]
        to_n = (1 - z) * (1 - n * n)
        to_z = (before - n) * z * (1 - z)
        to_r = kept["a"] * r * (1 - r)
        da, dn, back = np.empty((*ids.shape, 3 * h), np.float32), np.empty_like(out), np.ascontiguousarray(self.u.T)
        starts = first.any(axis=1)
        d = np.zeros_like(state)
        for t in range(len(ids) - 1, -1, -1):
            d += douts[t]
            np.multiply(d, to_n[t], out=dn[t])
            np.multiply(d, to_z[t], out=da[t, :, :h])
            np.multiply(dn[t], to_r[t], out=da[t, :, h : 2 * h])
            np.multiply(dn[t], r[t], out=da[t, :, 2 * h :])
            d *= z[t]
            d += da[t] @ back
            if starts[t]:
                d *= ~first[t][:, None]
        flat = da.reshape(-1, 3 * h)
        order, border = by_number(ids.ravel(), VOCABULARY + FORMS)
        used = np.flatnonzero(np.diff(border))
        du, db = before.reshape(-1, h).T @ flat, np.ones(len(flat), np.float32) @ flat
        da[..., 2 * h :] = dn
        gx = np.add.reduceat(flat[order], border[used], axis=0)
        scale = np.float32(1 / max(1, len(at)))
        sums[0][used] += (gx := gx * scale) ** 2
        self.x[used] -= rate * gx / (np.sqrt(sums[0][used]) + 1e-6)
        for p, s, g in zip(self.parts()[1:], sums[1:], (du, db, dc, dcb, dm, dmb), strict=True):
            g = g * scale
            s += g * g
            p -= rate * g / (np.sqrt(s) + 1e-6)
        return out[-1]


def by_number(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(an order by x, where each number's part of it begins and the last ends), for whole numbers under count, at most 65,536."""
    return np.argsort(x.astype(np.uint16), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(x, minlength=count))])


def sums_by(rows: np.ndarray, order: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Sums of rows for each number, in the order of by_number()."""
    out = np.zeros((len(border) - 1, rows.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(border))
    if len(some):
        out[some] = np.add.reduceat(rows[order], border[some], axis=0)
    return out


def shares(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the softmax's share at `at`, exponentials, their sums) by row. States lie between -1 and 1, so one
    bound on all logits keeps the exponentials finite; rows that vanish under it are done by their own largest logit."""
    s = states @ weights
    s += bias - (bias + np.abs(weights).sum(axis=0)).max()
    right = s[np.arange(len(at)), at]
    np.exp(s, out=s)
    total = s @ np.ones(s.shape[1], np.float32)
    if (low := total < 1e-25).any():
        own = states[low] @ weights + bias
        own -= own.max(axis=1, keepdims=True)
        right[low] = own[np.arange(len(own)), at[low]]
        s[low] = np.exp(own)
        total[low] = s[low].sum(axis=1)
    return right - np.log(total), s, total


def lanes(sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """Texts dealt to at most `width` lanes of about equal length, longest first."""
    import heapq

    n = max(1, min(width, len(sizes)))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for i in np.argsort(-sizes, kind="stable"):
        total, lane = heapq.heappop(heap)
        out[lane].append(i)
        heapq.heappush(heap, (total + int(sizes[i]), lane))
    return sorted((np.array(x) for x in out), key=lambda x: -int(sizes[x].sum()))


def streams(codes: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows over texts side by side: (place, real, word before, whether a text starts, text), steps x lanes.

    codes has each text's words and end mark. Lanes come longest first, so those that go on are the first ones of
    the window before. Where a lane is shorter than the window, real is false.
    """
    dealt = lanes(np.diff(bounds), width)
    size = np.array([int((bounds[lane + 1] - bounds[lane]).sum()) for lane in dealt], np.int64)
    texts = np.concatenate(dealt) if dealt else np.zeros(0, np.int64)
    own = (bounds[1:] - bounds[:-1])[texts]
    joined = np.arange(int(own.sum())) + np.repeat(bounds[:-1][texts] - (np.cumsum(own) - own), own)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before = np.concatenate([[0], codes[:-1]])
    first = np.zeros(len(codes), bool)
    first[bounds[:-1]] = True
    for at in range(0, int(size.max(initial=0)), WINDOW):
        live = int((size > at).sum())
        left = size[:live] - at
        step = np.arange(min(WINDOW, int(left.max())))[:, None]
        real = step < left
        place = np.where(real, joined[begin[:live] + at + np.minimum(step, left - 1)], 0)
        yield place, real, before[place], first[place], owner[place]


class Task:
    """What a worker needs to turn texts into numbers and run the network."""

    def __init__(self, net: Net, known: pa.Array):
        self.net, self.known = net, known

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """(bounds, word of each place, distinct words, their ids for the network, their rank among the known or -1); the last word is the end mark."""
        bounds, words, codes = w.split(texts, lower=True)
        words = pa.concat_arrays([words.cast(pa.large_string()), pa.array([END], pa.large_string())])
        rank = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        ids = np.where((rank >= 0) & (rank < VOCABULARY), rank, VOCABULARY + forms(words))
        size = np.diff(bounds)
        ends = bounds[1:] + np.arange(len(size))
        out = np.empty(len(codes) + len(size), np.int64)
        place = np.ones(len(out), bool)
        place[ends] = False
        out[place], out[ends] = codes, len(words) - 1
        return np.concatenate([[0], ends + 1]), out, words, ids, rank

    def windows(self, texts: pa.Array, width: int, numbers: tuple | None = None):
        """(inputs, starts, targets, real, text) of each window over the texts."""
        bounds, codes, words, ids, rank = numbers or self.numbers(texts)
        seen = ids[codes]
        end = ids[-1]
        for place, real, before, first, owner in streams(seen, bounds, width):
            before = np.where(first, end, before)
            yield before, first, seen[place], real, owner

    def train(self, texts: pa.Array, rate: float, sums: list[np.ndarray], width: int) -> int:
        done, state = 0, None
        for inputs, first, targets, real, _ in self.windows(texts, width):
            state = np.zeros((inputs.shape[1], STATE), np.float32) if state is None else state[: inputs.shape[1]]
            state = self.net.learn(inputs, first, targets, real, state, sums, rate)
            done += int(real.sum())
        return done

    def score(self, texts: pa.Array, numbers: tuple | None = None) -> np.ndarray:
        """Natural log probability of each text by the network: classes and, in the vocabulary, words."""
        out, state = np.zeros(len(texts)), None
        for inputs, first, targets, real, owner in self.windows(texts, LANES, numbers):
            state = np.zeros((inputs.shape[1], STATE), np.float32) if state is None else state[: inputs.shape[1]]
            states = self.net.run(inputs, first, state)
            state = states[-1]
            at = np.flatnonzero(real.ravel())
            got = self.net.output(states.reshape(-1, STATE)[at], targets.ravel()[at])
            out += np.bincount(owner.ravel()[at], weights=got, minlength=len(texts))
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over docs' whole texts, with the end mark. Each part of the input is summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.gathered(batches, 0, PART_BYTES):
            texts = batch.column(0)
            _, known, codes = w.split(texts, lower=True)
            words = pa.concat_arrays([known.cast(pa.string()), pa.array([END])])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(np.bincount(codes, minlength=len(known)), len(texts)).astype(np.int64))], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _by_form(counts: DataFrame, vocabulary) -> DataFrame:
    """(form, n, v): tokens and distinct words of each form outside the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).cast(pa.large_string())
            out = pc.is_null(pc.index_in(words, value_set=vocabulary.value)).to_numpy(zero_copy_only=False)
            form, c = forms(words)[out], batch.column(1).to_numpy()[out]
            n, v = (np.bincount(form, weights=x, minlength=FORMS).astype(np.int64) for x in (c, np.ones(len(c))))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS)), pa.array(n), pa.array(v)], ["form", "n", "v"])

    return counts.select("token", "c").mapInArrow(run, "form long, n long, v long").groupBy("form").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def _averaged(spark: SparkSession, docs: DataFrame, start, known) -> np.ndarray | None:
    """Each task trains a copy of the network on all its texts; returns the token-weighted mean of the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, sums = start.value
        net, sums = net.filled(net.flat()), [s.copy() for s in sums]
        task, done = Task(net, known.value), 0
        for batch in w.gathered(batches, 0, PART_BYTES):
            done += task.train(batch.column(0), 0.04, sums, LANES)
            trim()
        if done:
            flat = net.flat().astype(np.float64) * done
            cuts = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int64()), pa.array([done] * len(cuts), pa.int64()), pa.array([flat[i : i + BLOCK].astype("<f8").tobytes() for i in cuts], pa.binary())],
                ["part", "block", "n", "sums"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in table.column("sums"))
        return pa.table({"part": [table.column("part")[0].as_py()], "block": [table.column("block")[0].as_py()], "n": [sum(table.column("n").to_pylist())], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part long, block long, n long, sums binary"
    copies = docs.select("text").mapInArrow(run, schema)
    for fan in (32, 32, None):  # sums of at most 32 copies at a time, then of those; the last step adds what is left
        copies = copies.withColumn("part", F.floor(F.col("part") / fan) if fan else F.lit(0).cast("long")).groupBy("part", "block").applyInArrow(add, schema)
    got = sorted(copies.collect(), key=lambda r: r["block"])
    if not got:
        return None
    return np.concatenate([np.frombuffer(r["sums"], "<f8") / r["n"] for r in got])


#: Text bytes that training and counting take at a time; numbers of a row of a copy's parameters.
PART_BYTES, BLOCK = 16 << 20, 8192


def score(spark: SparkSession, docs: DataFrame, learn: Column, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, by its whole text.

    Tokens are runs of anything but space and characters 9 to 13, A-Z lower-cased, and an end mark for each
    text; a null text counts as empty and has the end mark alone. `learn` picks the training rows. base_score is the
    log10 probability under smoothed unigram counts, score under the network; n_known counts tokens that occur in
    training. Without any training row all counts are 0 and the network is an untrained one. Repeated rows and
    null keys give a row each; an empty table gives an empty one; other columns are left out.

    The counts of the KNOWN most frequent words are broadcast; each row's rarer words are joined with the count
    table, so no word with many rows enters the join. The network's size doesn't depend on the data.
    """
    bounded(spark)
    rows = docs.select(F.col(key).alias("key"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    training = rows.filter("learn")
    counts = save(spark, word_counts(training), "lm-counts")
    n, v, size = counts.agg(F.sum("c"), F.count("*"), F.sum(F.col("c") * (F.octet_length("token") + 1))).first()
    n, v = int(n or 0), int(v)
    top = most_frequent(counts, "c", KNOWN).sort_by([("c", "descending"), ("token", "ascending")])
    known = pa.array(top.column(0).to_pylist(), pa.large_string())
    c = top.column(1).to_numpy()
    vocabulary = known.slice(0, VOCABULARY)
    filled = np.zeros(VOCABULARY)
    filled[: len(vocabulary)] = c[:VOCABULARY]
    form = np.zeros((2, FORMS))
    for r in _by_form(counts, spark.sparkContext.broadcast(vocabulary)).collect():
        form[:, r["form"]] = r["n"], r["v"]
    net = Net.fresh(np.concatenate([filled.reshape(CLASSES, MEMBERS).sum(axis=1), form[0]]), filled)
    sums = [np.zeros_like(p) for p in net.parts()]
    if n:
        # of all pieces of all training texts, by their hashes; equal pieces count once, so many copies of a text don't fill it
        share = min(1.0, WARM / max(1, size or 0))
        cut = F.expr(f"regexp_extract_all(text, '(?s).{{1,{WARM_LENGTH}}}', 0)")
        pieces = training.select(F.explode(F.when(F.length("text") > WARM_LENGTH, cut).otherwise(F.array("text"))).alias("text")).withColumn("h", F.xxhash64("text"))
        warm = pieces.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).dropDuplicates(["h"]).toArrow().sort_by("h")
        texts = warm.column(0).combine_chunks().cast(pa.string()) if len(warm) else pa.array([], pa.string())
        for rate in (0.2, 0.1):
            for _, part in w.slices(texts, 4 << 20):
                Task(net, known).train(part, rate, sums, 48)
        held = spark.sparkContext.broadcast(known)
        mean = _averaged(spark, training, spark.sparkContext.broadcast((net, sums)), held)
        net = net.filled(mean) if mean is not None else net
    shared = spark.sparkContext.broadcast((net, known, c, np.log10(form.sum(axis=0) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, known, c, below = shared.value
        task, lc, row = Task(net, known), np.append(np.log10(c + 1.0), 0.0), TaskContext.get().partitionId() << 36
        for batch in w.gathered(batches, 1, PART_BYTES):
            texts = batch.column(1)
            numbers = task.numbers(texts)
            bounds, codes, words, ids, rank = numbers
            size, owner = np.diff(bounds), np.repeat(np.arange(len(texts)), np.diff(bounds))
            tally = lambda x: np.bincount(owner, weights=x[codes], minlength=len(texts))
            word = lc[rank]  # rank -1: 0 here, joined later
            outside = ids >= VOCABULARY
            partial = task.score(texts, numbers) / np.log(10) + tally(np.where(outside, word - below[np.where(outside, ids - VOCABULARY, 0)], 0.0))
            rare = np.flatnonzero(rank[codes] < 0)
            pair, times = np.unique(owner[rare] * len(words) + codes[rare], return_counts=True)
            ends = np.searchsorted(pair // len(words), np.arange(len(texts) + 1))
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([words.take(pa.array(pair % len(words))).cast(pa.string()), pa.array(times.astype(np.int64))], ["token", "m"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(texts))), batch.column(0), pa.array(size.astype(np.int64)), pa.array(tally(rank >= 0).astype(np.int64)), pa.array(tally(word)), pa.array(partial), listed],
                ["row", "key", "n_tokens", "seen", "base", "partial", "rare"],
            )
            row += len(texts)
            trim()

    kind = dict(rows.dtypes)["key"]
    scored = save(spark, rows.select("key", "text").mapInArrow(run, f"row long, key {kind}, n_tokens long, seen long, base double, partial double, rare array<struct<token: string, m: long>>"), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.m").join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("seen_too"))
    more, seen_too = F.coalesce("more", F.lit(0.0)), F.coalesce("seen_too", F.lit(0).cast("long"))
    return scored.drop("rare").join(rare, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("seen") + seen_too).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("partial") + more).alias("score"),
    )
