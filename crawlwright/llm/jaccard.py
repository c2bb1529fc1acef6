"""Similarity join of documents by the Jaccard index of their word shingles, as a grouped prefix join.

Shingles get one order for all documents: those not seen to repeat first, then by how often they were seen,
ties by hash. A document's prefix is its first shingles in that order. Two sets whose overlap is `need` or
more must share ℓ shingles of their prefixes if each prefix leaves out fewer than need - ℓ + 1 of its set.
Documents with identical prefixes and size collapse into one group, so the index has a row per group and prefix
shingle, however many members a group has. Pairs of groups that share prefix shingles are filtered by size, place
and number of shared shingles; only the pairs that are left are expanded to members, and these are compared by
their whole sets. Members of one group share the whole prefix, so they meet by a second prefix, of the rest of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import words as w
from crawlwright.llm.common import SLICE_BYTES, bounded, collect_garbage, forget, most_frequent, save
from crawlwright.llm.held import each
from crawlwright.llm.numbering import numbered

#: Frequent shingles that are broadcast (16 bytes each), at most; they only set the order, so a missing one costs time, never a link.
MOST_FREQUENT = 300_000
#: A prefix shingle of no more than this many groups has all their pairs looked at; a larger one is first resolved around a
#: hub. So is a pair of groups with more than its square of member pairs.
SMALL = 12


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, n): the distinct shingles of each text, sorted by owner and hash, and their number by text.
    A text with fewer words than size has its whole word sequence as one; a text without words none."""
    bounds, known, codes = w.split(texts, lower=True)
    rolling = w.Rolling(w.hashed(known, 0)[codes])
    h = rolling.windows(size)
    at = np.flatnonzero(w.inside(bounds, size, len(h)))
    owner = np.searchsorted(bounds, at, side="right") - 1
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < size))
    owner = np.concatenate([owner, few])
    h = np.concatenate([h[at], w.mix(rolling.runs(bounds[few], bounds[few + 1]) + np.uint64(1))])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[new], h[new]
    return owner, h, np.bincount(owner, minlength=len(texts))


def _marks(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit marks of each set: sums of scrambled members."""
    first = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how often they were seen) of those seen in several distinct sets of one part of the input.
    Each part reports its own repeats alone; the sums are bounded in number by MOST_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for _, texts in w.slices(batch.column(0), 2 * SLICE_BYTES):
                owner, h, n = shingles(texts, size)
                a, _ = _marks(owner, h, n)
                _, one = np.unique(a, return_index=True)
                sole = np.zeros(len(n), bool)
                sole[one] = True
                found, count = np.unique(h[sole[owner]], return_counts=True)
                found, count = found[count > 1], count[count > 1]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], ["s", "c"])

    seen = docs.select("text").mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    seen = save(docs.sparkSession, seen.filter("c > 3"), "jaccard-seen")
    top = most_frequent(seen, "c", MOST_FREQUENT)
    forget(docs.sparkSession, seen)
    s, c = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(s)
    return s[order], c[order]


def _ordered(owner: np.ndarray, h: np.ndarray, n: np.ndarray, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sets' shingles in the order for all documents, the place of each in its set). s, c: the frequent shingles and their counts."""
    at = np.minimum(np.searchsorted(s, h), max(0, len(s) - 1))
    seen = np.where(s[at] == h, c[at], 0) if len(s) else np.zeros(len(h), np.int64)
    begin = np.cumsum(n) - n
    return h[np.lexsort((h, seen, owner))], np.arange(len(h)) - begin[owner]


def _prefixes(docs: DataFrame, size: int, num: int, den: int, frequent) -> DataFrame:
    """(doc_id, n, a, b, group, prefix, row_hash): prefix has the first n - ceil(n * num / den) + 1 + n // 20 shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = frequent.value
        for batch in each(batches):
            for first, texts in w.slices(batch.column(1), SLICE_BYTES):
                owner, h, n = shingles(texts, size)
                a, b = _marks(owner, h, n)
                h, place = _ordered(owner, h, n, s, c)
                length = prefix_length(n, num, den)
                keep = place < length[owner]
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                h, owner = h[keep], owner[keep]
                place = (np.arange(len(h)) - ends[owner]).astype(np.uint64)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.mix(h + place), dtype=np.uint64)])
                group = (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.array(group), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))), batch.column(2).slice(first, len(texts))],
                    ["doc_id", "n", "a", "b", "grp", "prefix", "row_hash"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(run, "doc_id long, n long, a long, b long, grp long, prefix array<long>, row_hash long")


def prefix_length(n, num: int, den: int):
    return np.where(n > 0, n + (-(n * num) // den) + 1 + n // 20, 0).clip(max=n)


def _need(x: Column, y: Column, num: int, den: int) -> Column:
    """Least overlap of sets of sizes x and y that are similar enough."""
    return F.ceil((x + y) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))


def _length(n: Column, num: int, den: int) -> Column:
    return F.least(n, n - F.ceil(n * F.lit(num) / F.lit(den) - F.lit(1e-9)) + 1 + F.floor(n / 20))


def _may(num: int, den: int) -> Column:
    """Of a row for a shared prefix shingle (sizes xn and yn, places xi and yi): whether the pair passes by size, and by place
    if this is its first common shingle. A similar pair passes at its first."""
    x, y = F.col("xn"), F.col("yn")
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (F.least(x - F.col("xi"), y - F.col("yi")) >= _need(x, y, num, den))


def _rest(n, num: int, den: int):
    """(length of the prefix, of the second prefix, least number of its shingles that two similar sets share) of sets of size n that share the
    whole prefix. The second prefix is 0 long if the shared prefix alone makes them similar."""
    p = prefix_length(n, num, den)
    more = np.ceil(2 * n * num / (num + den) - 1e-9).astype(np.int64) - p
    length = np.where(more > 0, np.minimum(n - p, n - p - more + 1 + n // 5), 0)
    return p, length, length - (n - p - more)


def _second(docs: DataFrame, crowd: DataFrame, size: int, num: int, den: int, frequent) -> DataFrame:
    """(s, v, n, i, enough): the index of second prefixes of the crowd (gid, id, a, b): s stands for the group and the
    shingle, v for the member, i for its place after the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = frequent.value
        for batch in each(batches):
            for first, texts in w.slices(batch.column(1), SLICE_BYTES):
                owner, h, n = shingles(texts, size)
                mine = _same(batch.slice(first, len(texts)), owner, h, n)
                h, place = _ordered(owner, h, n, s, c)
                p, length, enough = _rest(n, num, den)
                place = place - p[owner]
                keep = mine[owner] & (place >= 0) & (place < np.maximum(length, 1)[owner])
                h, place, owner = np.where(length[owner] > 0, h, np.uint64(0))[keep], place[keep], owner[keep]
                rows = pa.array(first + owner)
                gid = batch.column(4).take(rows).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((w.mix(h ^ w.mix(gid))).view(np.int64)), batch.column(0).take(rows), pa.array(n[owner].astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(enough[owner].astype(np.int64))], ["s", "v", "n", "i", "enough"])

    return _texts(docs, crowd.select("id", "a", "b", "gid")).mapInArrow(run, "s long, v long, n long, i long, enough long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs' (id, text) with the columns of wanted, each text of a doc_id once."""
    found = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id")
    found = found.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "a", "b", "h"])  # dealt by id already
    return found.select("id", "text", *[c for c in wanted.columns if c != "id"])


def _same(batch: pa.RecordBatch, owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which texts' sets have the marks a and b beside them: rows may share a doc_id and differ."""
    a, b = _marks(owner, h, n)
    return (a == batch.column(2).to_numpy()) & (b == batch.column(3).to_numpy())


def _sets(docs: DataFrame, wanted: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """(id, members): the whole sets of the wanted nodes, as sorted little-endian numbers. Of rows that share a
    doc_id only those count whose set has the node's marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for first, texts in w.slices(batch.column(1), SLICE_BYTES):
                owner, h, n = shingles(texts, size)
                data = h.astype("<u8").tobytes()
                ends = np.concatenate([[0], np.cumsum(n)]) * 8
                keep = np.flatnonzero(_same(batch.slice(first, len(texts)), owner, h, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + keep)), pa.array([data[ends[i] : ends[i + 1]] for i in keep], pa.binary())], ["id", "members"])

    return _texts(docs, wanted.join(marks, "id").select("id", "a", "b")).mapInArrow(run, "id long, members binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * den >= num * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("x"), F.col("members").alias("xm"))
    y = sets.select(F.col("id").alias("y"), F.col("members").alias("ym"))
    return pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "xm", "ym").mapInArrow(run, "x long, y long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (x, y) lead to, for each id in a link.

    Alternating stars: first every node's larger neighbours, then its smaller ones, are tied to the smallest
    node around it. The rounds grow with the logarithm of the longest chain. Each round's table is written.
    """
    edges = save(spark, links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").select("u", "v", "m")
        after = save(spark, tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        same = [t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for t in (edges, after)]
        forget(spark, edges)
        edges = after
        collect_garbage(spark)
        if same[0] == same[1]:
            break
    ids = edges.groupBy("u").agg(F.min("v").alias("component"))
    return save(spark, ids.select(F.col("u").alias("id"), "component").unionByName(ids.select(F.col("component").alias("id"), "component").distinct()), "components")


def _buckets(index: DataFrame) -> DataFrame:
    """index (s, v, n, i, ...) with the size and hub of its bucket, where s occurs more than once."""
    hub = F.struct("i", F.xxhash64("v").alias("z"), "v", "n")
    shared = index.groupBy("s").agg(F.count("*").alias("size"), F.min(hub).alias("hub")).filter("size > 1")
    return index.join(shared, "s")


def _wide(bucket: DataFrame) -> DataFrame:
    """(v, many): in how many large buckets a node is, for nodes that are in one."""
    return bucket.filter(F.col("size") > SMALL).groupBy("v").agg(F.count("*").alias("many"))


def _candidates(bucket: DataFrame, wide: DataFrame, enough: Column, num: int, den: int) -> DataFrame:
    """Distinct pairs (x, y) of nodes that share a bucket and pass the filters: all pairs of small buckets, in large ones those with the hub.

    enough: the least number of shared prefix shingles. Those in small buckets are counted; of the others two nodes share
    no more than either has.
    """
    few, many = bucket.filter(F.col("size") <= SMALL), bucket.filter(F.col("size") > SMALL)
    extra = [c for c in bucket.columns if c == "enough"]
    left = few.select("s", F.col("v").alias("x"), F.col("n").alias("xn"), F.col("i").alias("xi"), *extra)
    right = few.select("s", F.col("v").alias("y"), F.col("n").alias("yn"), F.col("i").alias("yi"))
    pairs = left.join(right, "s").filter("x < y").filter(F.least("xn", "yn") * den >= F.greatest("xn", "yn") * num)
    count = pairs.groupBy("x", "y", "xn", "yn", *extra).agg(F.count("*").alias("c"), F.max(_may(num, den)).alias("may"))
    for side in ("x", "y"):
        count = count.join(wide.select(F.col("v").alias(side), F.col("many").alias(side + "k")), side, "left")
    more = F.least(F.coalesce("xk", F.lit(0)), F.coalesce("yk", F.lit(0)))
    small = count.filter((F.col("may") | (more > 0)) & (F.col("c") + more >= enough)).select("x", "y")
    star = many.select(F.col("hub.v").alias("x"), F.col("hub.n").alias("xn"), F.col("hub.i").alias("xi"), F.col("v").alias("y"), F.col("n").alias("yn"), F.col("i").alias("yi"))
    star = star.filter("x <> y").filter(_may(num, den)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return small.unionByName(star).distinct()


def _unresolved(many: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) in large buckets that the hub's component doesn't hold both of: who isn't wholly in it meets all the others
    that the filters by size and place let through, each pair at its first common shingle. label (v, lo, hi, own): the least and
    largest component of a node's members, and its own; a node without a row is by itself."""
    hubs = label.select(F.col("v").alias("hub"), F.col("own").alias("hc"))
    lab = many.select("s", "v", "n", "i", F.col("hub.v").alias("hub")).join(label.drop("own"), "v", "left").join(hubs, "hub", "left")
    lab = lab.select("s", "v", "n", "i", F.coalesce("lo", "v").alias("lo"), F.coalesce("hi", "v").alias("hi"), F.coalesce("hc", "hub").alias("hc"))
    out = (F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("hc"))
    side = lambda a: [F.col("v").alias(a), *(F.col(c).alias(a + c) for c in ("n", "i", "lo", "hi"))]
    left = lab.filter(out).select("s", *side("x"))
    right = lab.select("s", *side("y"), out.alias("yout"))
    reach = (F.col("xn") - F.col("xi")) * 1.0 >= F.ceil(F.col("xn") * F.lit(num) / F.lit(den) - F.lit(1e-9))
    apart = (F.col("xlo") != F.col("xhi")) | (F.col("ylo") != F.col("yhi")) | (F.col("xlo") != F.col("ylo"))
    rest = left.filter(reach).join(right, "s").filter("x <> y and (not yout or x < y)").filter(apart).filter(_may(num, den))
    return rest.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _counted(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of nodes that share `enough` of the index's shingles, looked up by their own lists."""
    lists = index.groupBy("v").agg(F.collect_set("s").alias("p"), F.max("enough").alias("e"))
    for side in ("x", "y"):
        pairs = pairs.join(lists.select(F.col("v").alias(side), F.col("p").alias("p" + side), F.col("e").alias("e" + side)), side)
    return pairs.filter(F.size(F.array_intersect("px", "py")) >= F.col("ex")).select("x", "y")


def _sized(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs of groups with the numbers of their members, mx and my. apart (gid, m): the groups of several."""
    for side in ("x", "y"):
        pairs = pairs.join(apart.select(F.col("gid").alias(side), F.col("m").alias("m" + side)), side, "left")
    return pairs.fillna(1, ["mx", "my"])


def _members(pairs: DataFrame, crowd: DataFrame, side: str) -> DataFrame:
    """pairs with a group's id in `side` replaced by each of its members' (its own, if it has but one)."""
    some = crowd.select(F.col("gid").alias(side), F.col("id").alias("_id"))
    return pairs.join(some, side, "left").withColumn(side, F.coalesce("_id", side)).drop("_id")


def _expanded(pairs: DataFrame, crowd: DataFrame) -> DataFrame:
    """Member pairs of sized group pairs: all, or where these are many those with either group's first member."""
    one = pairs.filter("mx = 1 and my = 1").select("x", "y")
    large = F.col("mx") * F.col("my") > SMALL * SMALL
    all_of = _members(_members(pairs.filter(~large & ~F.expr("mx = 1 and my = 1")), crowd, "x"), crowd, "y").select("x", "y")
    star = _members(pairs.filter(large), crowd, "y").select("x", "y").unionByName(_members(pairs.filter(large), crowd, "x").select("x", "y"))
    return one.unionByName(all_of).unionByName(star).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y")


def _expanded_apart(pairs: DataFrame, crowd: DataFrame, found: DataFrame) -> DataFrame:
    """Member pairs of group pairs whose members aren't in one component yet: who isn't with the first group's first member
    meets the whole other group."""
    name = found.select(F.col("id").alias("x"), F.col("component").alias("c"))
    hub = pairs.select("x", "y").join(name, "x", "left").select("x", "y", F.coalesce("c", "x").alias("hc"))
    x = _members(hub.withColumn("g", F.col("x")), crowd, "x").join(name, "x", "left").withColumn("xc", F.coalesce("c", "x")).drop("c")
    name = found.select(F.col("id").alias("y"), F.col("component").alias("c"))
    y = _members(hub.withColumnRenamed("x", "g").withColumn("h", F.col("y")), crowd, "y").join(name, "y", "left").withColumn("yc", F.coalesce("c", "y")).select("g", F.col("h").alias("h"), "y", "yc", "hc")
    x = x.withColumnRenamed("y", "h").select("g", "h", "x", "xc", "hc")
    away = x.filter("xc <> hc").join(y.drop("hc"), ["g", "h"])
    home = y.filter("yc <> hc").join(x.filter("xc = hc").drop("hc"), ["g", "h"])
    both = away.select("x", "y", "xc", "yc").unionByName(home.select("x", "y", "xc", "yc")).filter("xc <> yc")
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def linked(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link if their shingle sets' Jaccard index is
    num/den or more; component_id is the smallest doc_id that links lead to, itself included.

    Words are runs of anything but space and characters 9 to 13, A-Z lower-cased; a shingle is `size` words. A
    text with fewer words has its whole sequence as its only shingle. A null text or one without words has
    none: 0 shingles, no link, its own component. A row with a null doc_id has no link and a null component.
    Rows may share a doc_id; with different texts they are documents of their own, and link or don't by their
    texts. An empty table gives an empty one; other columns are left out. No link is
    lost: candidate pairs are complete for the measure, and a pair that isn't compared lies in one component
    already. Shingles are compared as 64-bit hashes, sets in the index as two.
    """
    return _linked(spark, docs, size, num, den).select("doc_id", "n_shingles", "component_id")


def representatives(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, row_hash) of the rows that stay if one of each component does, the one with the smallest doc_id and, among rows that
    share it, the smallest row_hash, the text's xxhash64. Rows without shingles and rows with a null doc_id all stay. Distinct."""
    found = _linked(spark, docs, size, num, den)
    single = found.filter("n_shingles = 0 or doc_id is null").select("doc_id", "row_hash").distinct()
    first = found.filter("n_shingles > 0 and doc_id = component_id").groupBy("component").agg(F.min_by(F.struct("doc_id", "row_hash"), F.struct("doc_id", "row_hash")).alias("r"))
    return single.unionByName(first.select("r.*"))


def _renamed(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """_linked() where rows of different texts share doc_ids: each pair of doc_id and text gets a number, in order of the
    doc_ids, that stands for it."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    names = save(spark, rows.filter("doc_id is not null").select("doc_id", "row_hash").distinct(), "jaccard-names")
    names = save(spark, numbered(spark, names, [], ["doc_id", "row_hash"], "jaccard-named").select("doc_id", "row_hash", "place"), "jaccard-places")
    placed = save(spark, rows.join(names, ["doc_id", "row_hash"], "left").select(F.col("place").alias("doc_id"), "text"), "jaccard-placed")
    found = _linked(spark, placed, size, num, den).withColumnRenamed("doc_id", "place").drop("component")
    lead = names.select(F.col("place").alias("component_id"), F.col("doc_id").alias("lead"))
    found = found.join(names.drop("row_hash"), "place", "left").join(lead, "component_id", "left")
    return found.select("doc_id", "n_shingles", F.col("lead").alias("component_id"), "row_hash", F.col("component_id").alias("component"))


def _linked(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """linked() with row_hash, a hash of the row's text, and component, a number that no other component has."""
    bounded(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = docs
    frequent = spark.sparkContext.broadcast(_frequent(docs, size))
    read = save(spark, _prefixes(docs, size, num, den, frequent), "jaccard-read")
    if not read.filter("n > 0").groupBy("doc_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y and doc_id is not null").isEmpty():
        forget(spark, read)
        return _renamed(spark, given, size, num, den)
    some = read.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    groups = save(spark, some.groupBy("n", "grp").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix")), "jaccard-groups")
    rows = save(spark, read.select("doc_id", "n", "a", "b", "grp", "row_hash"), "jaccard-rows")
    forget(spark, read)
    some = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    members = save(spark, some.groupBy("n", "grp", "a", "b").agg(F.min("doc_id").alias("id")), "jaccard-members")
    apart = save(spark, members.groupBy("n", "grp").agg(F.count("*").alias("m"), F.min("id").alias("gid")).filter("m > 1"), "jaccard-apart")
    crowd = save(spark, members.join(apart, ["n", "grp"]).select("gid", "id", "a", "b"), "jaccard-crowd")

    # the index of groups: prefix shingles that several of them share
    index = groups.select(F.col("gid").alias("v"), "n", F.posexplode("prefix").alias("i", "s")).select("s", "v", "n", "i")
    bucket = save(spark, _buckets(index), "jaccard-index")
    forget(spark, groups)
    x, y = F.col("xn"), F.col("yn")
    enough = F.least(_length(x, num, den) - (x - _need(x, y, num, den)), _length(y, num, den) - (y - _need(x, y, num, den)))
    collect_garbage(spark)
    met = save(spark, _candidates(bucket, _wide(bucket), enough, num, den), "jaccard-met")
    many = save(spark, bucket.filter(F.col("size") > SMALL), "jaccard-many")
    forget(spark, bucket)
    collect_garbage(spark)
    # within groups: second prefixes
    own = save(spark, _buckets(_second(docs, crowd, size, num, den, frequent)), "jaccard-own")
    collect_garbage(spark)
    met_own = _candidates(own, _wide(own), F.col("enough"), num, den)

    sized = save(spark, _sized(met, apart.select("gid", "m")), "jaccard-sized")
    forget(spark, met)
    first = save(spark, _expanded(sized, crowd).unionByName(met_own).distinct(), "jaccard-pairs")
    collect_garbage(spark)
    marks = members.select("id", "a", "b")
    wanted = first.select(F.col("x").alias("id")).unionByName(first.select(F.col("y").alias("id"))).distinct()
    sets = save(spark, _sets(docs, wanted, marks, size), "jaccard-sets")
    collect_garbage(spark)
    links = save(spark, _verified(first, sets, num, den), "jaccard-links")
    found = components(spark, links)
    collect_garbage(spark)

    # what a hub stood for and isn't one component yet
    single = found.select(F.col("id").alias("v"), F.col("component").alias("lo"), F.col("component").alias("hi"), F.col("component").alias("own"))
    several = crowd.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).groupBy("gid").agg(F.min("c").alias("glo"), F.max("c").alias("ghi"))
    grouped = single.join(several.withColumnRenamed("gid", "v"), "v", "full").select("v", F.coalesce("glo", "lo").alias("lo"), F.coalesce("ghi", "hi").alias("hi"), F.coalesce("own", "v").alias("own"))
    # written step by step: as one plan these joins, each with its broadcasts, are more than the driver should hold
    label = save(spark, grouped, "jaccard-label")
    late = save(spark, _unresolved(many, label, num, den).join(sized, ["x", "y"], "left_anti"), "jaccard-late")
    forget(spark, label, many)
    collect_garbage(spark)
    large = sized.filter(F.col("mx") * F.col("my") > SMALL * SMALL).select("x", "y")
    late = late.unionByName(save(spark, large, "jaccard-large"))
    between = save(spark, _expanded_apart(late, crowd, found), "jaccard-between")
    forget(spark, late)
    collect_garbage(spark)
    inside = save(spark, _unresolved(own.filter(F.col("size") > SMALL), single, num, den), "jaccard-inside")
    collect_garbage(spark)
    rest = between.unionByName(_counted(inside, own))
    second = save(spark, rest.distinct().join(first, ["x", "y"], "left_anti"), "jaccard-pairs")
    forget(spark, between, inside)
    collect_garbage(spark)
    if not second.isEmpty():
        have = sets.select("id").distinct()
        wanted = second.select(F.col("x").alias("id")).unionByName(second.select(F.col("y").alias("id"))).distinct().join(have, "id", "left_anti")
        sets = sets.unionByName(_sets(docs, wanted, marks, size))
        links = links.unionByName(save(spark, _verified(second, sets, num, den), "jaccard-links"))
        found = components(spark, links)

    labelled = members.select("n", "a", "b", "id").join(found, "id", "left").select("n", "a", "b", F.coalesce("component", "id").alias("set"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("set", "doc_id"))
    return rows.join(labelled, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row_hash", component.alias("component"))
