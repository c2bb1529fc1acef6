import random

import pytest

#: doc_id, text, lang, source, n_chars and columns whose names clash with what operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, length string, component_id string, row_hash string, n string"
VOCABULARY = ["the", "of", "and", "tion", "ing", "Her", "shore", "größe", "ñandú", "!!", "12", "x", "é", "日本", "foo_bar", "can't"]


def text(rng, n):
    return rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n", "\t"]).join(rng.choices(VOCABULARY, k=n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    out = [(1, None, "en"), (2, "", "en"), (3, "   \n", None), (4, "one", "en"), (5, "!!! 123", "fr")]
    base = rng.choices(VOCABULARY, k=160)
    for i in range(6, 40):  # near copies, with more and more changes
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(160)] = f"w{rng.randrange(10**6)}"
        out.append((i, " ".join(w), "en" if i % 2 else "fr"))
    for i in range(40, 70):
        out.append((i, text(rng, rng.randrange(1, 120)), rng.choice(["en", "fr", "de"])))
    passage = " ".join(f"p{k}" for k in range(70))
    for i in range(70, 90):  # a passage in many documents
        out.append((i, f"{text(rng, 30)} {passage} {text(rng, 30)}", "de"))
    out += [(i, "same text in many documents " * 20, "en") for i in range(90, 110)]
    out += [(110, "a " * 30000, "en"), (111, "x" * 20000, "fr"), (112, " ".join(rng.choices(VOCABULARY, k=9000)), "de")]
    out += [(112, out[-1][1], "de"), (None, "a row without an id " * 5, "en"), (None, None, None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "a", "b", "c", "d", "e") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
