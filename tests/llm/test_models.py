"""Operators 1 and 2: held-out quality, exact parts, gradients."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlwright.llm import language, lm
from crawlwright.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


def test_languages_of_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(spark, docs, crc_mod("doc_id", 3) != 1, ("doc_id", "lang")).toPandas()
    unseen = got[[fold(i, 3) == 1 for i in got.doc_id]]
    assert (unseen.lang == unseen.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.005
    assert got.score.between(0, 1).all()


def test_language_of_odd_texts(spark, docs, rows, empty):
    got = language.identify(spark, docs, F.lit(True), ("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in {"en", "fr", "de"} and 0 <= r.score <= 1
    assert language.identify(spark, empty, F.lit(True)).count() == 0
    nothing = language.identify(spark, docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_prediction_doesnt_depend_on_neighbours():
    model = language.train(["the cat of the", "der hund und der"] * 40, ["en", "de"] * 40)
    texts = pa.array(["the cat", None, "", "und der hund"] * 5)
    assert np.allclose(model.logits(texts)[:4], model.logits(texts.slice(0, 4)))
    assert np.allclose(model.logits(texts.slice(4, 4)), model.logits(texts.slice(0, 4)))


def test_scores(spark, docs, rows, empty):
    got = lm.score(spark, docs, crc_mod("doc_id", 7) != 2).collect()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(x for i, t, _ in rows if fold(i, 7) != 2 for x in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(words(t)), sum(c[x] > 0 for x in words(t)), n) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = sorted(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in words(t)) for _, t, _ in rows)
    assert np.allclose(sorted(r.base_score for r in got), base)
    assert all(r.score < 0 for r in got)
    assert lm.score(spark, empty, F.lit(True)).count() == 0
    assert lm.score(spark, docs, F.lit(False)).filter("train_tokens = 0 and n_known = 0").count() == len(rows)


def test_network_beats_unigrams_on_unseen_documents(spark):
    got = lm.score(spark, spark.read.parquet(f"{SF}/documents.parquet"), crc_mod("doc_id", 7) != 2).toPandas()
    unseen = got[[fold(i, 7) == 2 for i in got.doc_id]]
    assert unseen.score.sum() > unseen.base_score.sum()


@pytest.fixture
def net():
    rng = np.random.default_rng(0)
    return lm.Net.fresh(rng.integers(1, 9, lm.CLASSES + lm.FORMS), rng.integers(1, 9, lm.VOCABULARY))


def test_probabilities_sum_to_one(net):
    rng = np.random.default_rng(1)
    state = rng.normal(size=(1, lm.STATE)).astype(np.float32)
    every = np.arange(lm.VOCABULARY + lm.FORMS)
    p = np.exp(net.output(np.repeat(state, len(every), axis=0), every))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_across_windows(net, monkeypatch):
    texts = pa.array(["the of and a " * 90, "a b", None, "of " * 300])
    task = lm.Task(net, pa.array(["the", "of", "and", "a", ""], pa.large_string()))
    whole = task.score(texts)
    monkeypatch.setattr(lm, "WINDOW", 7)
    assert np.allclose(task.score(texts), whole, rtol=1e-4)
    monkeypatch.setattr(lm, "LANES", 1)
    assert np.allclose(task.score(texts), whole, rtol=1e-4)
    assert np.allclose([task.score(texts.slice(i, 1))[0] for i in range(4)], whole, rtol=1e-4)


def test_gradients(net, monkeypatch):
    rng = np.random.default_rng(2)
    ids, targets = rng.integers(0, lm.VOCABULARY + lm.FORMS, (2, 5, 3))
    first = rng.random((5, 3)) < 0.2
    real = rng.random((5, 3)) < 0.9
    state = rng.normal(size=(3, lm.STATE)).astype(np.float32)
    n = real.sum()

    def loss():
        out = net.run(ids, first, state.copy())
        at = np.flatnonzero(real.ravel())
        return -float(net.output(out.reshape(-1, lm.STATE)[at], targets.ravel()[at]).astype(np.float64).sum()) / n

    sums = [np.zeros_like(p) for p in net.parts()]
    before = net.flat().copy()
    net.learn(ids, first, targets, real, state.copy(), sums, 0.0)
    assert (net.flat() == before).all()
    for p, s in zip(net.parts(), sums, strict=True):
        flat, squares = p.reshape(-1), s.reshape(-1)
        for i in np.argsort(-squares)[:3]:
            old = flat[i]
            flat[i] = old + 2e-2
            up = loss()
            flat[i] = old - 2e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 4e-2) == pytest.approx(math.sqrt(squares[i]), rel=0.08, abs=2e-4)


def test_sample_is_bounded(spark, monkeypatch):
    """A text that most rows have counts once, and long words don't make long pieces."""
    monkeypatch.setattr(language, "ROWS", 40)
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, labels, **k: seen.append((texts, labels)))
    rows = [(f"ein Satz {n} " + "wort" * (n * 400), "de") for n in range(200)] + [("one text in most rows", "en")] * 3000 + [("an other one", "en")] * 20
    language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5), F.lit(True))
    texts, labels = seen[0]
    assert labels.count("en") <= 2 and 10 < labels.count("de") < 90
    assert max(map(len, texts)) <= language.PIECE_CHARS
