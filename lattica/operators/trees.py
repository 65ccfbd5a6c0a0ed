"""Trees given by a column of parents, whatever the codes look like, of any depth.

Everything is told from the edges by pointer jumping: after k rounds a node knows its ancestor 2^k steps up, so a
chain of 100,000 nodes takes 17 rounds, and a tree of four levels three. What a round needs of other nodes are joins on keys and sums, added
up before the shuffle; lineage is cut by a table for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import order as O
from lattica.sources import folders


def nodes(rows: DataFrame, parent: str = "parent_code", order: tuple[str, ...] = ()) -> DataFrame:
    """One row of each code: the first by order, then by the other columns. Rows without a code are no nodes."""
    others = [*order, *(c for c in rows.columns if c not in ("code", *order))]
    first = rows.filter(F.col("code").isNotNull()).groupBy("code").agg(F.min(F.struct(*others)).alias("_row"))
    return first.select(*[F.col(c) if c == "code" else F.col("_row")[c].alias(c) for c in rows.columns])


def nested(rows: DataFrame, parent: str = "parent_code", order: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of rows (code, parent, ...) with root_code, depth (1 at a root), n_descendants, pos and is_orphan.

    pos is the place (from 1) in depth-first order, siblings and roots by order, then code; so the nodes from pos to pos +
    n_descendants are those of the subtree. A node whose parent is null, empty or missing is a root; it is an orphan if it names
    one. Nodes on or below a cycle have no root: these four are null for them, and cycles() lists them.
    """
    spark = rows.sparkSession
    own = folders.written(nodes(rows, parent, order), "nodes")
    known = own.select(F.col("code").alias("up"))
    named = F.nullif(F.col(parent), F.lit(""))
    edges = own.select("code", named.alias("_named")).join(known, F.col("_named") == F.col("up"), "left").select("code", "up", (F.col("_named").isNotNull() & F.col("up").isNull()).alias("is_orphan"))
    table = folders.Rounds(spark, "tree")
    state = table.put(edges.select("code", "up", "is_orphan", F.col("up").alias("jump"), F.when(F.col("up").isNull(), 1).otherwise(2).cast("long").alias("depth"), F.coalesce("up", "code").alias("root_code"), F.lit(1).cast("long").alias("size")))
    n, reach = own.count(), 1
    # After a round, jump is the ancestor reach steps up (null above the root), depth and root_code are told within reach
    # steps up, and size counts the nodes within less than reach steps down. Nodes that still jump after n steps are cyclic.
    while reach <= n and not state.filter("jump IS NOT NULL").isEmpty():
        ahead = state.select(F.col("code").alias("jump"), F.col("jump").alias("_jump"), (F.col("depth") - 1).alias("_depth"), F.col("root_code").alias("_root"))
        gain = state.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("code")).agg(F.sum("size").alias("_gain"))
        met = state.join(ahead, "jump", "left").join(gain, "code", "left")
        state = table.put(met.select("code", "up", "is_orphan", F.col("_jump").alias("jump"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root_code").alias("root_code"), (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size")))
        reach *= 2
    settled = state.filter("jump IS NULL").drop("jump")
    siblings = settled.join(own.select("code", *order), "code") if order else settled
    # A node stands as far behind its parent as its earlier siblings' subtrees are large, and one more.
    step = O.running(siblings, ["up"], [*order, "code"], F.col("size"), "_before")
    path = folders.Rounds(spark, "paths")
    far = path.put(step.select("code", "is_orphan", "depth", "root_code", "size", F.col("up").alias("jump"), (F.col("_before") + 1).alias("pos")))
    while not far.filter("jump IS NOT NULL").isEmpty():
        ahead = far.select(F.col("code").alias("jump"), F.col("jump").alias("_jump"), F.col("pos").alias("_pos"))
        met = far.join(ahead, "jump", "left")
        far = path.put(met.select("code", "is_orphan", "depth", "root_code", "size", F.col("_jump").alias("jump"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos")))
    found = far.select("code", "root_code", F.col("depth").cast("int").alias("depth"), (F.col("size") - 1).alias("n_descendants"), "pos", "is_orphan")
    return own.join(found, "code", "left").withColumn("is_orphan", F.coalesce("is_orphan", F.lit(False)))


def cycles(tree: DataFrame) -> DataFrame:
    """Nodes of a nested tree that lead to no root."""
    return tree.filter(F.col("pos").isNull())


def roots(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("depth") == 1)


def subtree(tree: DataFrame, code: str) -> DataFrame:
    """The node and all below it, by its interval: two numbers of one row, no search."""
    top = tree.filter(F.col("code") == code).select("pos", "n_descendants").first()
    return tree.filter(F.lit(False)) if top is None or top.pos is None else tree.filter(F.col("pos").between(top.pos, top.pos + top.n_descendants))


def levels(tree: DataFrame) -> DataFrame:
    """depth, n_nodes, n_leaves, n_descendants (on average) of each depth."""
    return tree.filter(F.col("pos").isNotNull()).groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("n_descendants") == 0, 1)).alias("n_leaves"), F.avg("n_descendants").alias("avg_descendants"))


def statistics(tree: DataFrame) -> DataFrame:
    """Counts of nodes, roots, orphans, leaves and cyclic nodes, and the greatest depth."""
    return tree.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count(F.when(F.col("depth") == 1, 1)).alias("root_nodes"), F.count(F.when(F.col("is_orphan"), 1)).alias("n_orphans"), F.count(F.when(F.col("n_descendants") == 0, 1)).alias("n_leaves"),
        F.count(F.when(F.col("pos").isNull(), 1)).alias("n_cyclic"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )
