"""Graph operators over (graph_id, src, dst) edge tables and node tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.components import connected_components
from corpusloom.session import Scratch


def on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The directed edges that remain when nodes without an incoming or without an outgoing edge are peeled off, round by
    round: empty exactly if there is no cycle."""
    scratch = Scratch(edges.sparkSession, "peel")
    left = scratch(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "edges")
    n = left.count()
    while n:
        heads, tails = left.select(F.col("dst").alias("src")), left.select(F.col("src").alias("dst"))
        left = scratch(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"), "edges")
        scratch.drop("edges", keep=1)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, node_id, n): duplicate ids and labels, dangling edge ends, self loops, nodes without an edge."""
    repeated = nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("code"), "node_id", "n")
    labels = nodes.groupBy(F.lower(F.trim("label")).alias("l")).agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n > 1").select(F.lit("duplicate_label").alias("code"), "node_id", "n")
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    dangling = ends.join(nodes, "node_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("n")).select(F.lit("dangling_edge").alias("code"), "node_id", "n")
    loops = edges.where("src = dst").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n")).select(F.lit("self_loop").alias("code"), "node_id", "n")
    alone = nodes.select("node_id").distinct().join(ends, "node_id", "left_anti").select(F.lit("isolated").alias("code"), "node_id", F.lit(1).cast("long").alias("n"))
    return repeated.union(labels).union(dangling).union(loops).union(alone)


def sized_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size): nodes without edges are components of their own."""
    parts = connected_components(edges, "src", "dst")
    held = nodes.select("node_id").distinct().join(parts.withColumnRenamed("node", "node_id"), "node_id", "left")
    return held.select(F.coalesce("component", "node_id").alias("component")).groupBy("component").agg(F.count("*").alias("size"))


def bridges(components: DataFrame) -> DataFrame:
    """(src, dst): edges that chain the components' representatives, the largest first, ties by id.

    Components are sorted by ranges and chained inside each; what reaches over is one row a range."""
    ranged = components.repartitionByRange(F.desc("size"), "component").select("component", "size", F.spark_partition_id().alias("part"))
    ranged = Scratch(components.sparkSession, "bridges")(ranged, "ranges")
    inside = F.lag("component").over(Window.partitionBy("part").orderBy(F.desc("size"), "component"))
    ends = ranged.groupBy("part").agg(F.max(F.struct(-F.col("size"), F.col("component"))).alias("last"))
    ends = ends.select("part", F.lag("last.component").over(Window.orderBy("part")).alias("before"))
    chained = ranged.withColumn("src", inside).join(F.broadcast(ends), "part")
    return chained.select(F.coalesce("src", "before").alias("src"), F.col("component").alias("dst")).where("src is not null")


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): nodes that the roots (node) reach, a root having depth 1, others the least one: a join a level, each
    with the last level's nodes only."""
    scratch = Scratch(edges.sparkSession, "depths")
    step = scratch(edges.select(F.col("src").alias("node"), "dst").distinct(), "edges")
    seen = scratch(roots.select("node").distinct().withColumn("depth", F.lit(1)), "seen")
    level = 1
    while True:
        near = seen.where(F.col("depth") == level).join(step, "node").select(F.col("dst").alias("node")).distinct()
        fresh = scratch(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(level + 1)), "level")
        if fresh.isEmpty():
            return seen
        seen = scratch(seen.union(fresh), "seen")
        scratch.drop("seen", keep=1)
        level += 1


def merged(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of several (nodes, edges): a node's first non-empty label in the order of the graphs, each edge once."""
    nodes = reduce(DataFrame.unionByName, (n.select("node_id", "label", F.lit(i).alias("g")) for i, (n, _) in enumerate(graphs)))
    nodes = nodes.groupBy("node_id").agg(F.min_by("label", F.when(F.coalesce("label", F.lit("")) != "", F.col("g"))).alias("label"))
    return nodes, reduce(DataFrame.unionByName, (e.select("src", "dst") for _, e in graphs)).distinct()


def merge_equal_labels(nodes: DataFrame, edges: DataFrame, label) -> tuple[DataFrame, DataFrame]:
    """(node_id, into) and the edges between what is left, when nodes whose normalised `label` is equal become the one with
    the smallest id; loops that this makes and repeated edges go, nodes without a label too."""
    named = nodes.select("node_id", label.alias("l")).where("l <> ''")
    into = named.join(named.groupBy("l").agg(F.min("node_id").alias("into")), "l").select("node_id", "into")
    end = lambda c: into.select(F.col("node_id").alias(c), F.col("into").alias(f"{c}_into"))
    kept = edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_into").alias("src"), F.col("dst_into").alias("dst"))
    return into, kept.where("src <> dst").distinct()


def descendants(edges: DataFrame) -> DataFrame:
    """(node, below): every node that a node's edges lead to, itself too if it is on a cycle. Paths are doubled: a round joins what is
    known with itself, so there are as many rounds as the longest shortest path has binary digits. The result has a row for each pair."""
    scratch = Scratch(edges.sparkSession, "descendants")
    known = scratch(edges.select(F.col("src").alias("node"), F.col("dst").alias("below")).distinct(), "known")
    n = known.count()
    while n:
        on = known.select(F.col("node").alias("below"), F.col("below").alias("next"))
        known = scratch(known.union(known.join(on, "below").select("node", F.col("next").alias("below"))).distinct(), "known")
        scratch.drop("known", keep=1)
        m = known.count()
        if m == n:
            break
        n = m
    return known


def single_root(nodes: DataFrame, edges: DataFrame, root: str = "root") -> DataFrame:
    """(src, dst): the edges of a tree under one new root that reaches every node: each node keeps its least parent, and hangs under the root where
    it has none. Of a cycle of such parents the least node lets go of its own."""
    kept = edges.where("src <> dst").groupBy("dst").agg(F.min("src").alias("src"))
    loops = descendants(on_cycles(kept))
    # the nodes of a cycle reach each other: the least of them is below itself and above none that is less
    cut = loops.groupBy("node").agg(F.min("below").alias("least")).where("node = least").select(F.col("node").alias("dst"))
    kept = kept.join(cut, "dst", "left_anti").select("src", "dst")
    bare = nodes.select(F.col("node_id").alias("dst")).distinct().join(kept, "dst", "left_anti")
    return kept.union(bare.select(F.lit(root).alias("src"), "dst"))
