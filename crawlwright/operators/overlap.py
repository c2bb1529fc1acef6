"""Which texts hold which passages, as a join on keys inside the passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a short passage's key.
GRAM = 3


def _words(text: str) -> Column:
    return F.split(text, r"\s+")


def _runs(words: Column) -> Column:
    """Hashes of every three neighbouring words."""
    three = lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), three))


def _grams(chars: Column) -> Column:
    """Hashes of every run of GRAM characters, of all shorter ones, and of the empty one."""
    def sized(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.xxhash64(F.lit(0), F.array_join(F.slice(chars, i + 1, n), "")))
        return F.when(F.size(chars) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    none = F.array(F.xxhash64(F.lit(0), F.lit("")))
    return F.concat(none, *map(sized, range(1, GRAM + 1)))


def contained(passages: DataFrame, texts: DataFrame, item: str = "item_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc) for each passage and each text that holds it as it stands; repeated rows on either side give a row each.

    A passage's first and last word may touch other characters in a text, so its key is the three words after the first; one with
    fewer than three words inside has its first characters as key. Only hashes of keys are exploded: those that some passage has meet the passages, each different text once, and
    texts are read again for these pairs alone, by two hashes of the text. So neither texts nor copies of them multiply on
    the way, and nothing is compared with every text. Null passages and texts hold nothing; an empty passage is in every text.
    """
    p = passages.filter(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("passage"))
    size = F.size(_words("passage"))
    long = p.filter(size >= 5).select("item", "passage", F.xxhash64(*[F.get(_words("passage"), F.lit(i)) for i in (1, 2, 3)]).alias("k"))
    short = p.filter(size < 5).select("item", "passage", F.xxhash64(F.lit(0), F.substring("passage", 1, GRAM)).alias("k"))
    t = texts.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text")).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    asked = [(long, t.withColumn("w", _words("text")).select("a", "b", F.explode(F.array_distinct(_runs(F.col("w")))).alias("k")))]
    if not short.isEmpty():  # the characters of all texts are taken apart only for those
        asked.append((short, t.withColumn("c", F.regexp_extract_all("text", F.lit("(?s)."), 0)).select("a", "b", F.explode(F.array_distinct(_grams(F.col("c")))).alias("k"))))
    out = []
    for some, keys in asked:
        met = keys.join(some.select("k").distinct(), "k", "left_semi").distinct().join(some, "k").select("a", "b", "item", "passage")
        out.append(t.join(met, ["a", "b"]).filter(F.col("text").contains(F.col("passage"))).select(F.col("item").alias(item), F.col("doc").alias(doc)))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
