"""Code hierarchies as adjacency lists: (code, name, seq) rows, the parent being derived from the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import codes
from lattica.operators import order as O
from lattica.sources import folders


def first_wins(rows: DataFrame, key: str = "code", order: str = "seq") -> DataFrame:
    """One row of each key: the first by order, then by the other columns. min adds up before the shuffle, so a hot key is no burden."""
    return _one(rows, key, order, F.min)


def last_wins(rows: DataFrame, key: str = "code", order: str = "seq") -> DataFrame:
    """One row of each key: the last by order, then by the other columns."""
    return _one(rows, key, order, F.max)


def _one(rows: DataFrame, key: str, order: str, pick) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(pick(F.struct(order, *others)).alias("_row")).select(*[F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns])


def ancestors(rows: DataFrame) -> DataFrame:
    """code, ancestor, up (1: parent) for each proper prefix of each code."""
    parts = F.split("code", "-")
    return rows.select("code", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))).alias("p", "ancestor"), F.size(parts).alias("n")).filter(F.col("p") + 1 < F.col("n")).select("code", "ancestor", (F.col("n") - F.col("p") - 1).alias("up"))


def built(rows: DataFrame, orphans: str = "root") -> DataFrame:
    """code, name, level, tree_parent, is_orphan of the first row of each code.

    A code whose parent is missing becomes a root, or goes with all below it (orphans="drop"). The first rows are written once, and
    the tree too, as what follows reads it several times.
    """
    own = folders.written(first_wins(rows).withColumn("code_parent", codes.parent_code(F.col("code"))), "first-rows")
    known = own.select(F.col("code").alias("code_parent"), F.lit(True).alias("_known"))
    out = own.join(known, "code_parent", "left").withColumn("is_orphan", (F.col("code_parent") != "") & F.col("_known").isNull())
    out = out.withColumn("tree_parent", F.when(F.col("is_orphan"), "").otherwise(F.col("code_parent")))
    if orphans == "drop":
        bad = out.filter("is_orphan").select(F.col("code").alias("ancestor"))
        lost = ancestors(out).join(bad, "ancestor", "left_semi").select("code").unionByName(bad.withColumnRenamed("ancestor", "code"))
        out = out.join(lost, "code", "left_anti")
    return folders.written(out.select("code", "name", codes.level_of(F.col("code")).alias("level"), "tree_parent", "is_orphan"), "tree")


def with_depth(tree: DataFrame) -> DataFrame:
    """Adds root_code and depth (1 at a root): the nearest orphan at or above a code, or else its first part, is the root.

    Only codes below orphans have anything to look for: prefixes meet the orphans alone, which AQE broadcasts where they are few.
    """
    orphans = tree.filter("is_orphan").select(F.col("code").alias("ancestor"))
    above = ancestors(tree).filter(F.contains("ancestor", F.lit("-"))).join(orphans, "ancestor").groupBy("code").agg(F.min(F.struct("up", "ancestor")).alias("_m"))
    found = tree.join(above, "code", "left")
    up = F.when(F.col("is_orphan"), 0).otherwise(F.coalesce("_m.up", codes.dashes(F.col("code"))))
    root = F.when(F.col("is_orphan"), F.col("code")).otherwise(F.coalesce("_m.ancestor", codes.main_category(F.col("code"))))
    return found.select(*tree.columns, root.alias("root_code"), (up + 1).cast("int").alias("depth"))


def preorder(tree: DataFrame) -> DataFrame:
    """Rows with their root, depth and pos, the place (from 1) in depth-first order; placed by ranges, not sorted as a whole."""
    return O.running(with_depth(tree), [], ["root_code", "code"], F.lit(1), "_before").withColumn("pos", F.col("_before") + 1).drop("_before")


def statistics(tree: DataFrame) -> DataFrame:
    return with_depth(tree).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("max_depth"), F.count(F.when(F.col("tree_parent") == "", 1)).alias("n_roots"), *[F.count(F.when(F.col("level") == x, 1)).alias(f"n_level_{k}") for k, x in enumerate(codes.LEVELS)])


def children_count(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("tree_parent") != "").groupBy(F.col("tree_parent").alias("code")).agg(F.count(F.lit(1)).alias("n_children"))


def descendants_count(tree: DataFrame) -> DataFrame:
    return ancestors(tree).groupBy(F.col("ancestor").alias("code")).agg(F.count(F.lit(1)).alias("n_descendants"))


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("tree_parent").alias("code")), "code", "left_anti")


def roots(rows: DataFrame) -> DataFrame:
    """Rows without a parent, or whose parent is not among the rows."""
    own = rows.withColumn("_p", codes.parent_code(F.col("code")))
    return own.join(rows.select(F.col("code").alias("_p")), "_p", "left_anti").drop("_p")


def with_has_children(rows: DataFrame) -> DataFrame:
    parents = rows.select(codes.parent_code(F.col("code")).alias("code")).distinct().withColumn("_has", F.lit(True))
    return rows.join(parents, "code", "left").withColumn("has_children", F.col("_has").isNotNull()).drop("_has")


def with_parent_name(rows: DataFrame) -> DataFrame:
    parents = rows.select(F.col("code").alias("_p"), F.col("name").alias("parent_name"))
    return rows.withColumn("_p", codes.parent_code(F.col("code"))).join(parents, "_p", "left").drop("_p")


def subtree(rows: DataFrame, code: str) -> DataFrame:
    return rows.filter((F.col("code") == code) | F.startswith("code", F.lit(code + "-")))


def children(rows: DataFrame, code: str) -> DataFrame:
    return rows.filter(codes.parent_code(F.col("code")) == code)


def validated(rows: DataFrame) -> DataFrame:
    """code, error: a row for each thing wrong."""
    return rows.select("code", F.explode(codes.errors(F.col("code"), F.col("name"), F.col("level"))).alias("error"))


def missing_parents(rows: DataFrame) -> DataFrame:
    return ancestors(rows).select(F.col("ancestor").alias("code")).distinct().join(rows.select("code"), "code", "left_anti")


def limited(tree: DataFrame, max_depth: int, max_children: int) -> DataFrame:
    """Codes down to max_depth, the first max_children of each parent; all roots stay, and are not ranked."""
    near = with_depth(tree).filter(F.col("depth") <= max_depth)
    place = Window.partitionBy("tree_parent").orderBy("code")
    below = near.filter(F.col("tree_parent") != "").withColumn("_k", F.row_number().over(place)).filter(F.col("_k") <= max_children).drop("_k")
    return near.filter(F.col("tree_parent") == "").unionByName(below)


def sorted_children(tree: DataFrame) -> DataFrame:
    """code, children (sorted codes) of each parent; roots have no parent, so they are no one's children."""
    return tree.filter(F.col("tree_parent") != "").groupBy(F.col("tree_parent").alias("code")).agg(F.array_sort(F.collect_list("code")).alias("children"))


def breadth_first(tree: DataFrame) -> DataFrame:
    return with_depth(tree).orderBy("depth", "root_code", "code")


def at_level(tree: DataFrame, depth: int) -> DataFrame:
    return with_depth(tree).filter(F.col("depth") == depth)


def found(tree: DataFrame, *conditions: Column) -> DataFrame:
    """Nodes that meet all conditions, in depth-first order."""
    out = with_depth(tree)
    for c in conditions:
        out = out.filter(c)
    return out.orderBy("root_code", "code")


def tree_statistics(tree: DataFrame) -> DataFrame:
    """Nodes, leaves, depths, children and orphans of a whole tree."""
    rows = with_depth(tree).join(children_count(tree), "code", "left")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n_nodes"), F.count(F.when(F.col("n_children").isNull(), 1)).alias("n_leaves"), F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_depth"), F.coalesce(F.max("n_children"), F.lit(0)).alias("max_children"),
        F.coalesce(F.avg("n_children"), F.lit(0.0)).alias("avg_children"), F.count(F.when(F.col("is_orphan"), 1)).alias("n_orphans"),
    )


def pruned(tree: DataFrame, max_depth: int | None = None, min_children: int = 0, keep_levels: tuple | None = None, empty: bool = False, orphans: bool = False, keep: Column | None = None) -> DataFrame:
    """A tree without the nodes that an option takes, and without what then hangs below them.

    max_depth and keep_levels (depths) are looked at by depth; min_children spares leaves; empty takes nodes without
    a name, orphans those whose parent is missing; keep is any condition of a node.
    """
    rows = with_depth(tree).join(children_count(tree), "code", "left")
    gone = F.lit(False)
    if max_depth is not None:
        gone = gone | (F.col("depth") > max_depth)
    if keep_levels is not None:
        gone = gone | ~F.col("depth").isin(*keep_levels)
    if min_children:
        gone = gone | (F.coalesce("n_children", F.lit(min_children)) < min_children)
    if empty:
        gone = gone | (F.coalesce("name", F.lit("")) == "")
    if orphans:
        gone = gone | F.col("is_orphan")
    if keep is not None:
        gone = gone | ~keep
    marked = rows.withColumn("_gone", gone)
    lost = ancestors(marked).join(marked.filter("_gone").select(F.col("code").alias("ancestor")), "ancestor", "left_semi").select("code").distinct()
    return marked.filter(~F.col("_gone")).join(lost, "code", "left_anti").select(*tree.columns)


def split_up(rows: DataFrame, by: str, size: int = 1000, column: str | None = None) -> DataFrame:
    """Adds part: by "size" the lot of size codes that a code's place falls into, by "level" its dashes, by "property" a column."""
    if by == "level":
        return rows.withColumn("part", codes.dashes(F.col("code")).cast("string"))
    if by == "property":
        return rows.withColumn("part", F.col(column).cast("string"))
    if by != "size":
        raise ValueError(f"rows are not split by {by!r}")
    whole = O.numbered(rows.withColumn("_all", F.lit(0)), ["_all"], F.col("seq"), name="_n")
    return whole.withColumn("part", F.floor((F.col("_n") - 1) / size).cast("string")).drop("_all", "_n")


#: What becomes of a code that both lists have with other contents.
CONFLICTS = {"skip": "first", "overwrite": "last"}


def merged(left: DataFrame, right: DataFrame, how: str = "union", conflict: str = "skip") -> DataFrame:
    """Two code lists of one schema as one: their union, their intersection, or the codes of the first or the last with any.

    A code of both keeps the left row (conflict="skip"), gets the right one ("overwrite"), or stops the query where
    the rows differ ("error"). how="first" and "last" are unions that skip and overwrite.
    """
    if how == "intersection":
        left, right = (a.join(b.select("code"), "code", "left_semi") for a, b in ((left, right), (right, left)))
    wins = how if how in ("first", "last") else CONFLICTS.get(conflict, "first")
    both = left.withColumn("_s", F.lit(0)).unionByName(right.withColumn("_s", F.lit(1)))
    if conflict != "error":
        return (first_wins if wins == "first" else last_wins)(both, order="_s").drop("_s")
    others = [c for c in left.columns if c != "code"]
    sides = both.groupBy("code").agg(F.min(F.struct("_s", *others)).alias("_row"), F.count(F.lit(1)).alias("_n"), F.min(F.struct(*others)).alias("_a"), F.max(F.struct(*others)).alias("_b"))
    stop = F.raise_error(F.concat(F.lit("rows differ for code "), F.col("code")))
    return sides.withColumn("code", F.when(~F.col("_a").eqNullSafe(F.col("_b")), stop).otherwise(F.col("code"))).select(*[F.col(c) if c == "code" else F.col(f"_row.{c}") for c in left.columns])


def in_prefixes(rows: DataFrame, depth: int = 2, size: int = 1000) -> DataFrame:
    """prefix, part, items: the rows (code, name) below each prefix of depth parts, by code, in parts of at most size rows, numbered from 0."""
    own = rows.select(F.substring_index("code", "-", depth).alias("prefix"), "code", "name")
    placed = O.running(own, ["prefix"], ["code", "name"], F.lit(1), "_before")
    return placed.groupBy("prefix", F.floor(F.col("_before") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("code", "name"))).alias("items"))


def small_of_details(rows: DataFrame) -> DataFrame:
    """Detail codes (three dashes, digits after the last) with the code and name of the class that they are right below."""
    small = rows.select(F.col("code").alias("small"), F.col("name").alias("small_name"))
    return rows.filter(codes.dashes(F.col("code")) == 3).withColumn("small", codes.parent_code(F.col("code"))).join(small, "small").filter(codes.is_detail_of(F.col("code"), F.col("small")))
