"""Property-graph operators over nodes (id, label, type) and edges (source, target, relation, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators._lineage import cut


def degree(edges: DataFrame) -> DataFrame:
    """id and number of incident edge ends; a self-loop counts twice."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each source, target and relation, of the largest weight; edges without both nodes go."""
    ids = nodes.select("id").distinct()
    live = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return live.groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))


def merge_pairs(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair: the largest weight and its relation (ties: the first by name), and all relations."""
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation", "weight")
    best = F.min(F.struct((-F.col("weight")).alias("w"), "relation"))
    return pair.groupBy("a", "b").agg(F.max("weight").alias("weight"), best.alias("best"), F.array_join(F.sort_array(F.collect_set("relation")), ";").alias("relations")).select("a", "b", "weight", F.col("best.relation").alias("relation"), "relations")


#: Nodes of a frontier that go to every task, so that edges stay where they lie; more are joined by a shuffle, whose large keys the engine splits.
FRONTIER = 100_000


def reach(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """id and the least number of steps, at most `depth`, from any of `seeds` (id). One join a step, of nodes that were new in the
    step before with narrow edges that are written once; each step is a table of its own."""
    steps = edges.select("source", "target")
    if not directed:
        steps = steps.unionByName(steps.select(F.col("target").alias("source"), F.col("source").alias("target")))
    steps = cut(steps, "steps") if depth > 1 else steps
    frontier = seeds.select("id").distinct().withColumn("step", F.lit(0))
    seen = frontier
    for k in range(1, depth + 1):
        few = frontier.limit(FRONTIER + 1).count() <= FRONTIER
        start = frontier.select(F.col("id").alias("source"))
        found = steps.join(F.broadcast(start) if few else start, "source").select(F.col("target").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("step", F.lit(k)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def subgraph_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges that touch a node reached in fewer than `depth` steps."""
    inner = reached.filter(F.col("step") < depth).select("id")
    touch = lambda c: edges.join(inner.withColumnRenamed("id", c), c, "left_semi").select(edges.columns)
    return touch("source").unionByName(touch("target")).distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(degree(edges).select("id"), "id", "left_anti")


def drop_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in `gone` (id)."""
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), edges


def tag_classes(items: DataFrame) -> DataFrame:
    """Items (id, tags) with one set of tags each collapsed to one row: class_id (the least id), n (items), tags; items without tags have no class."""
    return items.filter(F.size("tags") > 0).groupBy("tags").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))


def tag_class_pairs(classes: DataFrame, least: float) -> DataFrame:
    """Pairs of classes, a <= b, whose Jaccard similarity is at least `least`, with the items of each; a = b is a class of several items."""
    each = classes.select("class_id", "n", F.size("tags").alias("m"), F.explode("tags").alias("tag"))
    left, right = each.toDF("a", "n_a", "m_a", "tag"), each.toDF("b", "n_b", "m_b", "tag")
    both = left.join(right, "tag").filter((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n_a") > 1)))
    k = both.groupBy("a", "b", "n_a", "n_b", "m_a", "m_b").agg(F.count(F.lit(1)).alias("k"))
    s = F.col("k") / (F.col("m_a") + F.col("m_b") - F.col("k"))
    return k.filter(s >= least).select("a", "b", "n_a", "n_b", F.round(s, 6).alias("similarity"))


def tag_class_members(items: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each item's class and the number of other items that its class's pairs link it to."""
    ends = pairs.select(F.col("a").alias("class_id"), F.when(F.col("a") == F.col("b"), F.col("n_b") - 1).otherwise(F.col("n_b")).alias("n"))
    ends = ends.unionByName(pairs.filter("a < b").select(F.col("b").alias("class_id"), F.col("n_a").alias("n")))
    links = ends.groupBy("class_id").agg(F.sum("n").alias("links"))
    return items.join(classes.select("tags", "class_id"), "tags").join(links, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
