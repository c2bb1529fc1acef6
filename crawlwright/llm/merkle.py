"""A Merkle manifest of a dataset: a digest for each row, a tree for each group, and a tree over the groups' roots.

Upwards: the nodes of a level are numbered within their tree; floor division of a number by the fanout gives the parent, and
the children of a parent, sorted by number, are hashed into it. Each level is a written table that holds a fraction of the rows
of the level below, so all levels together hold less than twice as many nodes as there are leaves. Downwards: one
join a level, on tree and parent, puts a node's siblings before its parent's path. A path starts at the root, so
it is carried by ever more nodes only on its way down, and the join of the leaves moves half of the paths or less.

A proof is the plain sequence of its siblings' digests (32 bytes each): how many of them stand left and right of the path at
each level follows from a leaf's place and the number of leaves.

Defined results: a null value counts as `-`; rows of one key are ordered by their digests (equal rows may change places
without effect); a null key comes first; a null group is a group of its own, before all others; an empty table has
no rows and no root; a tree of one leaf has that leaf as its root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm.common import forget, save
from crawlwright.llm.numbering import numbered

#: Levels of the way down that run as one query; their paths are written after as many.
TOGETHER = 8


@dataclass(frozen=True)
class Manifest:
    """root: the dataset's digest, None for an empty table; levels: levels of the highest tree of rows and of the tree of groups.

    rows: key, leaf, place and total in the group's tree, subroot, group_place and groups, proof (binary), carried (a struct).
    groups: group (null for the null group), group_place, total, subroot.
    """

    root: str | None
    levels: tuple[int, int]
    rows: DataFrame
    groups: DataFrame


def digest(*values: Column) -> Column:
    """The digest of a row: of each value, as text, its bytes, a colon and itself, `-` for null; lowercase hex of SHA-256."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def manifest(spark: SparkSession, df: DataFrame, leaf: Column, group: str, key: str, fanout: int = 2, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of df. leaf: a row's digest, as digest() gives it; carry: what else of a row the result takes along, as
    a struct, so names can't clash; other columns are left out."""
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    carried = F.struct(*[c.alias(k) for k, c in (carry or {"none": F.lit(None).cast("string")}).items()])
    leaves = save(spark, df.select(F.col(key).alias("key"), leaf.alias("leaf"), tree.alias("tree"), carried.alias("carried")), "merkle-leaves")
    placed = numbered(spark, leaves, ["tree"], ["key", "leaf"], "merkle-placed")
    nodes = placed.select("tree", F.col("place").alias("at"), F.col("total").alias("n"), F.unhex("leaf").alias("hash"), "key", "leaf", "carried")
    levels, tops = _grown(spark, nodes, fanout)
    below = save(spark, tops.select("tree", F.hex("hash").alias("subroot")), "merkle-subroots")
    ranked = numbered(spark, below, [], ["tree"], "merkle-groups")
    roots = ranked.select(F.lit("").alias("tree"), F.col("place").alias("at"), F.col("total").alias("n"), F.unhex("subroot").alias("hash"), F.col("tree").alias("group"))
    over, top = _grown(spark, roots, fanout)
    found = top.select(F.lower(F.hex("hash"))).first()
    empty = top.withColumn("path", F.expr("cast('' as binary)"))
    above = _paths(spark, over, empty, fanout).select(F.col("group").alias("tree"), F.col("at").alias("group_place"), F.col("n").alias("groups"), "path")
    above = save(spark, above, "merkle-above")
    rows = _paths(spark, levels, tops.join(above, "tree"), fanout, ["group_place", "groups"])
    rows = rows.select(F.col("key").alias(key), "leaf", F.col("at").alias("place"), F.col("n").alias("total"), F.lower(F.hex("top")).alias("subroot"), "group_place", "groups", F.col("path").alias("proof"), "carried")
    sizes = nodes.filter("at = 0").select("tree", F.col("n").alias("total"))
    groups = above.join(below, "tree").join(sizes, "tree").select(F.expr("substring(nullif(tree, ''), 2)").alias(group), "group_place", "total", F.lower("subroot").alias("subroot"))
    forget(spark, leaves)
    return Manifest(found[0] if found else None, (len(levels) - 1, len(over) - 1), rows, groups)


def _grown(spark: SparkSession, nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels from the leaves (tree, at, n: nodes of the tree in the level, hash, ...) up, with `kids`, the children's digests
    in order; and a row for each tree: tree, at, n, hash, kids, height."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = [nodes.withColumn("kids", F.lit(None).cast("array<binary>"))]
    while most > 1:
        children = levels[-1].filter("n > 1").groupBy("tree", F.expr(f"at div {fanout}").alias("at"))
        parents = children.agg(F.expr(f"(any_value(n) + {fanout - 1}) div {fanout}").alias("n"), F.expr("transform(array_sort(collect_list(struct(at, hash))), x -> x.hash)").alias("kids"))
        digests = F.expr("unhex(sha2(lower(array_join(transform(kids, x -> hex(x)), '')), 256))")
        levels.append(save(spark, parents.select("tree", "at", "n", digests.alias("hash"), "kids"), "merkle-level"))
        most = -(-most // fanout)
    tops = [x.filter("n = 1").select("tree", "at", "n", "hash", "kids", F.lit(i).alias("height")) for i, x in enumerate(levels)]
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return levels, save(spark, out, "merkle-tops")


def _paths(spark: SparkSession, levels: list[DataFrame], tops: DataFrame, fanout: int, along: list[str] | None = None) -> DataFrame:
    """The lowest level with `path`, the siblings up to the root and then the path that tops gives its tree's root; top: that root's
    digest; and the columns `along` of tops."""
    along = along or []
    kept = ["tree", "at", "kids", "path", "top", *along]
    heads = tops.withColumn("top", F.col("hash"))
    held = heads.filter(F.col("height") == len(levels) - 1).select(kept)
    siblings = F.expr(f"array_join(transform(filter(up_kids, (x, i) -> i <> at % {fanout}), x -> hex(x)), '')")
    for height in range(len(levels) - 2, -1, -1):
        level = levels[height]
        own = [c for c in level.columns if c not in ("tree", "at", "n", "hash", "kids")] if height == 0 else []
        parents = held.select(F.col("tree").alias("up_tree"), F.col("at").alias("up_at"), F.col("kids").alias("up_kids"), "path", "top", *along)
        met = level.filter("n > 1").join(parents, (F.col("tree") == F.col("up_tree")) & (F.expr(f"at div {fanout}") == F.col("up_at")))
        path = F.concat(F.unhex(siblings), "path").alias("path")
        cols = ["tree", "at", "kids", path, "top", *along]
        if height == 0:
            alone = level.filter("n = 1").join(heads.filter("height = 0").select("tree", "path", "top", *along), "tree")
            return met.select("n", *own, *cols).unionByName(alone.select("n", *own, *kept))
        held = met.select(cols).unionByName(heads.filter(F.col("height") == height).select(kept))
        if height % TOGETHER == 0:
            held = save(spark, held, "merkle-paths")
    # one level: every tree is a leaf
    level = levels[0]
    return level.join(heads.select("tree", "path", "top", *along), "tree")


def folded(leaf: Column, proof: Column, place: Column, total: Column, group_place: Column, groups: Column, levels: tuple[int, int], fanout: int = 2) -> Column:
    """The root that a leaf's digest and a proof give, by hashing from the leaf up; null if one of them is.

    levels: levels of the two trees, as Manifest has them; larger numbers are harmless.
    """
    state = F.struct(F.lower(leaf).alias("h"), F.lit(1).alias("p"))
    for at, n, height in ((place, total, levels[0]), (group_place, groups, levels[1])):
        begin = F.struct(state["h"].alias("h"), at.cast("long").alias("at"), n.cast("long").alias("n"), state["p"].cast("int").alias("p"))
        if height == 0:
            continue

        def step(s: Column, _: Column) -> Column:
            left = s["at"] % fanout
            width = F.least(F.lit(fanout).cast("long"), s["n"] - s["at"] + left)
            before = F.lower(F.hex(F.substring(proof, s["p"], (32 * left).cast("int"))))
            after = F.lower(F.hex(F.substring(proof, (s["p"] + 32 * left).cast("int"), (32 * (width - 1 - left)).cast("int"))))
            up = F.struct(
                F.sha2(F.concat(before, s["h"], after), 256).alias("h"),
                ((s["at"] - left) / fanout).cast("long").alias("at"),
                F.floor((s["n"] + fanout - 1) / fanout).cast("long").alias("n"),
                (s["p"] + 32 * (width - 1)).cast("int").alias("p"),
            )
            return F.when(s["n"] > 1, up).otherwise(s)

        state = F.aggregate(F.sequence(F.lit(1), F.lit(height)), begin, step)
    return state["h"]
