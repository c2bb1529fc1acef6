"""Operators 7 and 9 against brute force, and their parts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from crawlwright.llm import jaccard, substring
from crawlwright.llm import words as w


def split(text, lower=False):
    data = (text or "").encode().split()
    return [x.lower() for x in data] if lower else data


def components(rows, size, num, den):
    sets = {}
    for i, text, _ in rows:
        v = split(text, True)
        sets[i] = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if len(v) >= size else ({tuple(v)} if v else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size, num, small", [(4, 85, 12), (5, 80, 12), (4, 85, 1)])
def test_linked(spark, docs, rows, size, num, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = jaccard.linked(spark, docs, size, num, 100).collect()
    want = components([r for r in rows if r[0] is not None], size, num, 100)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


@pytest.mark.parametrize("size, num", [(4, 85), (5, 80)])
def test_linked_inside_groups(spark, size, num):
    """Isolated documents of equal size and prefix whose sets differ; no other document shares a shingle with them."""
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100 + size - 1)]
        for k in range(2 + g % 3):
            rows.append((10 * g + k, " ".join([*base[:-1], f"last{k}"]), "en"))
    got = jaccard.linked(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), size, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, size, num, 100)


def test_linked_without_rows(spark, empty):
    assert jaccard.linked(spark, empty, 4, 85, 100).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100 + rng.randrange(i)) for i in range(1, 40)]
    rng.shuffle(links)
    got = {r.id: r.component for r in jaccard.components(spark, spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(40)}}


def without_repeats(rows, size):
    first = {}
    for i, text, _ in rows:
        v = split(text)
        for k in range(len(v) - size + 1):
            key = tuple(v[k : k + size])
            if i is not None and i < first.get(key, 1 << 60):
                first[key] = i
    out = []
    for i, text, _ in rows:
        v = split(text)
        stay = [True] * len(v)
        for k in range(len(v) - size + 1):
            if i is not None and first[tuple(v[k : k + size])] < i:
                stay[k : k + size] = [False] * size
        kept = b" ".join(x for x, s in zip(v, stay, strict=True) if s)
        out.append((i, len(v), len(v) - sum(stay), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 12, 5])
def test_substrings(spark, docs, rows, size):
    got, changed = substring.dedup(spark, docs, size)
    want = without_repeats(rows, size)
    assert sorted(map(tuple, got.drop("row_hash").collect()), key=str) == want
    assert changed.select("doc_id").distinct().count() == len({x[0] for x in want if x[2]})


def test_substrings_without_rows(spark, empty):
    got, changed = substring.dedup(spark, empty)
    assert got.count() == changed.count() == 0


def test_words_on_slices():
    texts = pa.array(["A b", None, " C\tDÉ ", "", "x\x0by\x1cz"] * 50)
    for start in (0, 3, 101):
        bounds, known, codes = w.split(texts.slice(start), lower=True)
        known = known.to_pylist()
        got = [[known[c].encode() for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [[x.lower() for x in (t or "").encode().split()] for t in texts.slice(start).to_pylist()]


def test_rolling_hashes_depend_on_words_alone():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    both = np.concatenate([h, h[5:20]])
    a = w.Rolling(both).windows(7)
    assert (a[5:14] == a[40:49]).all() and len(set(a[:34].tolist())) == 34
    assert w.Rolling(both).windows(100).size == 0


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16, 43])
def test_sliding_least(width):
    x = np.random.default_rng(1).integers(0, 1000, 60)
    assert w.sliding_least(x, width).tolist() == [min(x[i : i + width]) for i in range(60 - width + 1)]
    assert w.sliding_least(x[: width - 1], width).size == 0


def family(m, rng, pool=24, blocks=9, sizes=1):
    """m texts that share 130 shingles, more than their prefixes; the rest are blocks of 40 words, which as many long texts of rare words hold, too, and
    which are so the more frequent part. The m texts are few groups of many members."""
    rare = [f"r{k}" for k in range(134)]
    rows = []
    for i in range(m):
        picked = sorted(rng.sample(range(pool), blocks)) if i % 10 or not i else picked
        words = rare + [x for b in picked for x in ["z"] * 5 + [f"b{b}w{k}" for k in range(40)]]  # no shingle spans two blocks
        rows.append((i + 1, " ".join(words[: len(words) - i % sizes]), "en"))
        order = rng.sample(range(pool), pool)
        rows.append((1000 + i, " ".join([*(x for b in order for x in ["z"] * 5 + [f"b{b}w{k}" for k in range(40)]), *(f"u{i}w{k}" for k in range(3000))]), "en"))
    return rows


def test_members_of_a_group_meet_by_their_second_prefix(spark, monkeypatch):
    verified, pairs = jaccard._verified, []

    def counted(frame, *rest):
        pairs.append(frame.count())
        return verified(frame, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    tried = []
    for m in (80, 160):
        rows = family(m, random.Random(1))
        pairs.clear()
        got = jaccard.linked(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 80, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 5, 80, 100)
        tried.append(sum(pairs))
    assert tried[1] < 3 * tried[0], tried  # all pairs would be 4 times as many


@pytest.mark.parametrize("small", [1, 2])
def test_large_pairs_of_groups_go_around_their_first_members(spark, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = family(60, random.Random(4), pool=11, sizes=3)
    got = jaccard.linked(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, 5, 80, 100)


def test_no_step_of_the_join_is_one_large_plan(spark, monkeypatch):
    """Each plan and its broadcasts lie in the driver's memory."""
    words = [f"w{i}" for i in range(60)]
    docs = [(n, " ".join(w if i != n % 59 else f"x{n}" for i, w in enumerate(words))) for n in range(40)]
    plans, save = [], jaccard.save
    monkeypatch.setattr(jaccard, "save", lambda spark, df, label: plans.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), label)) or save(spark, df, label))
    found = jaccard.linked(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 5, 70, 100)
    assert found.count() == 40
    assert max(plans)[0] <= 16, sorted(plans)[-3:]
