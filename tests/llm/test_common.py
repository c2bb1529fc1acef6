"""Helpers of the corpus operators."""

import collections

import pytest

from crawlwright.llm.common import most_frequent


@pytest.mark.parametrize("counts, most", [([7] * 100, 50), ([9] * 3 + [4] * 500 + [1] * 50, 200), ([5] * 20, 20), ([5] * 20, 100), ([], 5), ([3] * 10, 0), ([1000, 999, 2], 2)])
def test_most_frequent(spark, counts, most):
    df = spark.createDataFrame([(f"k{i}", c) for i, c in enumerate(counts)], "k string, c long").repartition(3)
    got = most_frequent(df, "c", most).column("c").to_pylist()
    assert len(got) <= most
    # all that fits but a bucket of hashes at most
    assert len(got) >= min(most, len(counts)) - 1
    assert not collections.Counter(got) - collections.Counter(counts)
    if counts and most >= 3:
        assert max(got) == max(counts)
