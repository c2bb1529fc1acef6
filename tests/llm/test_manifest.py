"""Operator 11 against a plain construction of the trees, and operators 12 and 13 against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlwright.llm import lines, merkle, resample
from tests.llm.conftest import frame


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level, fanout):
    """(root, proof of each node) of a list of digests."""
    proofs, where = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, at in enumerate(where):
            first = at - at % fanout
            proofs[i] += [level[k] for k in range(first, min(first + fanout, len(level))) if k != at]
            where[i] = at // fanout
        level = [sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], proofs


def trees(rows, fanout):
    """(root, a sorted list of (id, leaf, subroot, proof)) of rows (id, text, lang)."""
    groups = collections.defaultdict(list)
    for i, text, lang in rows:
        groups[lang].append((i is not None, i or 0, leaf(i, "s", lang, len(text or ""), text), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
    below = [climb([r[2] for r in groups[g]], fanout) for g in order]
    root, above = climb([b[0] for b in below], fanout)
    out = [(r[3], r[2], sub, p + up) for g, (sub, proofs), up in zip(order, below, above, strict=True) for r, p in zip(groups[g], proofs, strict=True)]
    return root, sorted(out, key=str)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def made(spark, docs, fanout, carry=None):
    return merkle.manifest(spark, docs, merkle.digest(*[F.col(c) for c in COLUMNS]), "lang", "doc_id", fanout, carry)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(spark, docs, rows, fanout):
    # repeated rows, null ids, null and many small groups
    rows = [*rows, *[(300 + k, "t", f"l{k % 7}é") for k in range(16)], (400, "t", "alone"), (400, "t", "")]
    m = made(spark, frame(spark, rows).repartition(7), fanout, {"seen": F.when(F.col("doc_id") % 5 == 0, F.lit("0" * 64)), "leaf": F.lit(1)})
    root, want = trees(rows, fanout)
    assert m.root == root
    again = merkle.folded(F.coalesce("carried.seen", "leaf"), F.col("proof"), F.col("place"), F.col("total"), F.col("group_place"), F.col("groups"), m.levels, fanout)
    got = m.rows.withColumn("again", again).collect()
    cut = lambda b: [b[k : k + 32].hex() for k in range(0, len(b), 32)]
    assert sorted([(r.doc_id, r.leaf, r.subroot, cut(bytes(r.proof))) for r in got], key=str) == want
    for r in got:
        assert (r.again == root) == (r.carried.seen is None)
    sizes = collections.Counter(lang for _, _, lang in rows)
    assert {r.lang: r.total for r in m.groups.collect()} == dict(sizes)


def test_manifest_of_little(spark, empty):
    m = made(spark, empty, 2)
    assert m.root is None and m.rows.count() == 0 and m.groups.count() == 0
    one = frame(spark, [(7, None, None)])
    m = made(spark, one, 2)
    r = m.rows.first()
    assert m.root == r.leaf == r.subroot == leaf(7, "s", None, 0, None) and bytes(r.proof) == b""
    with pytest.raises(ValueError):
        made(spark, one, 1)


def bucket(x, n):
    return zlib.crc32(x.encode()) % n


def drawn(rows, target, longest, buckets, least, percent, seed):
    def features(text):
        plain = (text or "").translate({c: c + 32 for c in range(65, 91)})
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
        return len(ws), [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    found = [(i, *features(t)) for i, t, _ in rows]
    s = collections.Counter(bucket(x, buckets) for _, _, fs in found for x in fs)
    t = collections.Counter(bucket(x, buckets) for text in target for x in features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for i, n, fs in found:
        weight = sum(gain(bucket(x, buckets)) for x in fs) // len(fs) if fs else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks[r].append(k + 1)
    return sorted([(*r, ranks[r].pop() if ranks[r] else None) for r in reversed(out)], key=str)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 97, 50), (3, 65_536, 100)])
def test_resample(spark, docs, rows, longest, buckets, percent):
    target = ["The shore of größe", None, "", "ing ing tion THE the"]
    goals = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resample.resample(spark, docs, goals, longest, buckets, 20, percent, 5)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, longest, buckets, 20, percent, 5)


def test_resample_of_little(spark, docs, empty):
    assert resample.resample(spark, empty, docs).count() == 0
    got = resample.resample(spark, docs.filter("doc_id < 6"), empty, least_words=1, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 3)) and len(got) == 5
    with pytest.raises(ValueError):
        resample.Buckets(1, 70_000)


def test_sums_of_empty_runs():
    ends = np.array([0, 0, 3, 3, 5, 5])
    assert resample.sums(ends, np.array([1, 2, 3, 4, 5])).tolist() == [0, 0, 6, 0, 9, 0]
    assert resample.sums(np.zeros(3, np.int64), np.zeros(0, np.int64)).tolist() == [0, 0, 0]


def without(rows, least_docs, least_chars):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    held = collections.Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least_chars or held[key(x)] < least_docs]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("least_docs, least_chars", [(10, 1), (3, 4), (2, 0), (1, 1)])
def test_lines(spark, rows, least_docs, least_chars, sent, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 1 << 30 if sent else -1)
    monkeypatch.setattr(lines, "SHARD_KEYS", 5)
    common = ["Home | About", " \thome | about\r", "größe", "ÉTÉ", "été", "ab", " x", "", "  "]
    more = [(200 + k, "\n".join([common[j % 9] for j in range(k % 11, k % 11 + 5)] + [f"only {k}"] * 2 + [""] * (k % 3)), "en") for k in range(60)]
    rows = [*rows, *more, more[0], (500, "home | about\n" * 3000 + "end", "en"), (501, "home | about", None)]
    got = lines.dedup(spark, frame(spark, rows).repartition(6), least_docs, least_chars)
    assert sorted(map(tuple, got.collect()), key=str) == without(rows, least_docs, least_chars)


def test_lines_keep_columns(spark, docs, empty):
    got = lines.dedup(spark, docs, keep=("doc_id", "text", "n", "row_hash"))
    assert got.columns == ["doc_id", "text", "n", "row_hash", "n_lines", "n_dropped", "kept"]
    assert got.filter("n_dropped = 0 and kept is distinct from coalesce(text, '')").count() == 0
    assert lines.dedup(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_shard_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    keys[: n // 2, 0] = 7  # equal first numbers are keys of their own
    made = lines.Shard.of(keys)
    for s in (made, lines.Shard.unpacked(made.packed())):
        assert sorted(s.slots(keys).tolist()) == list(range(n))
    other = rng.integers(0, 1 << 63, (1000, 2)).astype(np.uint64)
    assert (made.slots(other) < n).all()


def test_shard_rest(monkeypatch):
    """Keys that no level could part get slots at the end; foreign keys that reach them get none."""
    monkeypatch.setattr(lines, "LEVELS", 1)
    keys = np.random.default_rng(1).integers(0, 1 << 63, (200, 2)).astype(np.uint64)
    made = lines.Shard.of(keys)
    assert len(made.rest) and sorted(made.slots(keys).tolist()) == list(range(200))
    index = lines.Index(1, {0: (made.packed(), keys[np.argsort(made.slots(keys))][:, 1].astype("<u8").tobytes(), np.arange(200).astype("<i8").tobytes())})
    assert (index.counts(keys) == made.slots(keys)).all()
    assert not index.counts(keys + np.uint64(1)).any()
