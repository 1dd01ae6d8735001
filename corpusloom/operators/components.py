"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch

# edges that a task contracts at once, in memory
PIECE = 200_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for each node of some edges that isn't that node itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of a task's edges, PIECE at a time: never more are held, whatever the size of the partition."""
    held, size = [], 0

    def stars() -> pd.DataFrame:
        edges = pd.concat(held)
        u, v = local_stars(edges["u"].to_numpy(), edges["v"].to_numpy())
        return pd.DataFrame({"u": u, "v": v})

    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= PIECE:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two larger-to-smaller edges, or edges both ways: then the edges aren't stars yet."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable. `edges` is counted and
    read, so it should be a staged table.

    First each task makes stars of the edges it has, a bounded piece at a time; few edges are dealt to few tasks. Then each
    round replaces a node's edges by edges to its smallest neighbour: for the larger neighbours (large-star), then for the
    smaller ones and the node itself (small-star). The edges end as stars round the smallest node of each component. A hot
    node is no group in memory: its minimum is a partial aggregate, and the join that hands it out is one that AQE can
    split. Rounds are cut by tables in the shared folder; only a count and a flag reach the driver. Null ends and self
    loops link nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    kind = e.schema["u"].dataType.simpleString()
    tasks = -(-edges.count() // PIECE) or 1
    e = scratch(e.coalesce(tasks).mapInPandas(_contract, f"u {kind}, v {kind}").distinct(), "stars")
    while tasks > 1 and _unfinished(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch(small.union(low).where("u <> v").distinct(), "stars")
        scratch.drop("stars", keep=1)
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
