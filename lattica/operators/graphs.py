"""Graphs given by edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources import folders


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folders.shared(df.sparkSession))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the least node that it is connected with.

    A round takes the least label of the neighbours, added up before the shuffle, and then the label's own label, so
    labels travel at least twice as far each round. Lineage is cut every round.
    """
    both = _cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    labels = _cut(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("least"))
        met = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("to"))
        own = met.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = _cut(met.join(own, "to", "left").select("node", F.col("component").alias("was"), F.coalesce("next", "to").alias("component")))
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones, each pair once; of a pair's rows the new one stays."""
    both = edges.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return both.groupBy("src", "dst").agg(F.max(F.struct("_s", *others)).alias("_row")).select("src", "dst", *[f"_row.{c}" for c in others])


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def path(edges: DataFrame, start, end, rounds: int = 50) -> DataFrame:
    """step, node of a shortest path along edges from start to end, by the least nodes of those that tie; no rows if there is none.

    A round goes one edge further from all nodes reached, once each; lineage is cut every round.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    own = _cut(edges.select("src", "dst").distinct())
    reached = _cut(spark.createDataFrame([(start,)], "node " + kind.simpleString()).select("node", F.lit(0).alias("step"), F.lit(None).cast(kind).alias("came")))
    for k in range(1, rounds + 1):
        if not reached.filter(F.col("node") == F.lit(end)).isEmpty():
            break
        near = reached.filter(F.col("step") == k - 1).join(own, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("came"))
        new = near.join(reached.select("node"), "node", "left_anti").select("node", F.lit(k).alias("step"), "came")
        if (new := _cut(new)).isEmpty():
            break
        reached = _cut(reached.unionByName(new))
    else:
        raise RuntimeError(f"no path within {rounds} edges, and nodes are left")
    # Back from the end: a row for each step, as many as the path is long.
    back, node = [], end
    while (row := reached.filter(F.col("node") == F.lit(node)).first()) is not None:
        back.append((row.step, row.node))
        if row.came is None:
            break
        node = row.came
    return spark.createDataFrame(back, "step int, node " + kind.simpleString())


def children_of(tasks: DataFrame, relations: DataFrame, relationship: str | None = None) -> DataFrame:
    """Relations (parent_task_id, child_task_id, relationship) with the child's row of tasks, for parents that exist."""
    own = relations if relationship is None else relations.filter(F.col("relationship") == relationship)
    own = own.join(tasks.select(F.col("task_id").alias("parent_task_id")), "parent_task_id", "left_semi")
    return own.join(tasks.withColumnRenamed("task_id", "child_task_id"), "child_task_id")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, largest and mean out-degree, nodes without edges out, density (edges of those that directed pairs allow)."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.join(degree, F.col("node") == F.col("src"), "left")
    return joined.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.coalesce("degree", F.lit(0))).alias("n_edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.count(F.when(F.col("degree").isNull(), 1)).alias("n_leaves")).withColumns({
        "avg_degree": F.coalesce(F.col("n_edges") / F.nullif(F.col("n_nodes"), F.lit(0)), F.lit(0.0)), "density": F.coalesce(F.col("n_edges") / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1).cast("double"), F.lit(0.0)), F.lit(0.0)),
    })
