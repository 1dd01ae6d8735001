"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Every vector queries the graph of every shard. Graphs are built and searched for many vectors at once in numpy: a round
expands the best few open entries of each query's beam. Beams widen where they are full of links, and for a whole block
of queries until an audit against exact search passes. Links are counted and contracted to stars where they are found:
what leaves a block grows with its vectors, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import connected_components, local_stars
from corpusloom.session import Scratch

COSINE = 0.9
# links of a node above and in the ground layer, beam while building, first beam of a query, beam entries per round
LINKS, GROUND_LINKS, BUILD_BEAM, BEAM, WIDTH = 16, 32, 48, 24, 4
# a shard's bytes of 32-bit floats at most, shards at least, vectors of a query block, queries of each block that are audited
# in each shard, and the recall to reach
SHARD_BYTES, LEAST_SHARDS, BLOCK_ROWS, AUDITED, AUDIT_RECALL = 64_000_000, 4, 25_000, 256, 0.99
# the widest beam, whatever the size of the shard; what it can't hold or an audit misses in it is searched for exactly
WIDEST = 192
CHUNK, FIRST, GROWTH = 1024, 1024, 2048
SLACK = 1e-5


def _similar(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Dot products of each query with its own row of ids (-1: none)."""
    sims = np.matmul(vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]
    sims[ids < 0] = -np.inf
    return sims


def descend(vectors: np.ndarray, tables: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The node at which greedy search through the given layers, top first, ends for each query."""
    at = np.zeros(len(queries), np.int64)
    best = queries @ vectors[0] if len(vectors) else np.zeros(len(queries))
    for table in tables:
        going = np.arange(len(queries))
        while len(going):
            near = table[at[going]]
            sims = _similar(vectors, near, queries[going])
            top = sims.argmax(1)
            value = sims[np.arange(len(going)), top]
            up = value > best[going]
            going = going[up]
            at[going], best[going] = near[up, top[up]], value[up]
    return at


def beam(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the `size` best nodes that beam search finds for each query, best first; -1 and -inf where
    there are fewer."""
    b = len(queries)
    size = max(size, WIDTH + 1)
    ids, sims, done = np.full((b, size), -1, np.int64), np.full((b, size), -np.inf, np.float32), np.zeros((b, size), bool)
    ids[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", queries, vectors[entry])
    going = np.arange(b)
    while len(going):
        i, s, d = ids[going], sims[going], done[going]
        open_sims = np.where(d, -np.inf, s)
        pick = np.argpartition(-open_sims, WIDTH - 1, 1)[:, :WIDTH]
        valid = np.take_along_axis(open_sims, pick, 1) > -np.inf
        np.put_along_axis(d, pick, np.take_along_axis(d, pick, 1) | valid, 1)
        near = table[np.where(valid, np.take_along_axis(i, pick, 1), 0)].astype(np.int64)
        near[~valid] = -1
        near = near.reshape(len(going), -1)
        found = _similar(vectors, near, queries[going])
        poor = found <= s.min(1, keepdims=True)
        near[poor], found[poor] = -1, -np.inf
        i, s, d = np.c_[i, near], np.c_[s, found], np.c_[d, np.zeros(near.shape, bool)]
        order = np.argsort(i, 1, kind="stable")
        i, s, d = (np.take_along_axis(x, order, 1) for x in (i, s, d))
        s[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf
        top = np.argpartition(-s, size - 1, 1)[:, :size]
        i, s, d = (np.take_along_axis(x, top, 1) for x in (i, s, d))
        d |= s == -np.inf
        ids[going], sims[going], done[going] = np.where(s > -np.inf, i, -1), s, d
        going = going[~d.all(1)]
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates, best first, up to `most` links: first those nearer to the node than to any link
    chosen before, so that links point different ways, then the nearest of the rest."""
    b, c = ids.shape
    each = vectors[np.maximum(ids, 0)]
    pairs = np.matmul(each, each.transpose(0, 2, 1))
    chosen, nearest, count = np.zeros((b, c), bool), np.full((b, c), -np.inf, np.float32), np.zeros(b, np.int64)
    for j in range(c):
        own = (ids[:, j] >= 0) & (count < most) & (nearest[:, j] < sims[:, j])
        chosen[own, j] = True
        count += own
        nearest[own] = np.maximum(nearest[own], pairs[own, j])
    rank = np.where(ids < 0, 2, np.where(chosen, 0, 1)) * c + np.arange(c)
    order = np.argsort(rank, 1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return out if out.shape[1] == most else np.c_[out, np.full((b, most - out.shape[1]), -1)]


def _link_back(vectors: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
    """Add the links of `rows` to the nodes they lead to; a node with too many chooses again."""
    most = table.shape[1]
    source, target = np.repeat(rows, most), table[rows].ravel().astype(np.int64)
    source, target = source[target >= 0], target[target >= 0]
    sims = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    nodes, start, size = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(start, size)
    held = rank < most
    fresh = np.full((len(nodes), min(most, int(size.max(initial=0)))), -1, np.int64)
    fresh[np.repeat(np.arange(len(nodes)), size)[held], rank[held]] = source[held]
    for k in range(0, len(nodes), CHUNK):
        part = nodes[k : k + CHUNK]
        ids = np.c_[table[part].astype(np.int64), fresh[k : k + CHUNK]]
        ids = np.sort(ids, 1)[:, ::-1]
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = _similar(vectors, ids, vectors[part])
        order = np.argsort(-sims, 1, kind="stable")
        table[part] = choose(vectors, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), most)


def _nearest(vectors: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of `among` to each of `rows`, itself not included, by exact search."""
    sims = vectors[rows] @ vectors[among].T
    sims[rows[:, None] == among[None]] = -np.inf
    k = min(k, len(among))
    top = np.argpartition(-sims, k - 1, 1)[:, :k]
    value = np.take_along_axis(sims, top, 1)
    order = np.argsort(-value, 1, kind="stable")
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    return np.where(value > -np.inf, among[top], -1), value


def _layer(vectors: np.ndarray, n: int, above: list[np.ndarray], most: int) -> np.ndarray:
    """The layer of the first n nodes. They go in by growing batches: a batch searches what is there from where the layers
    above lead, and its own members exactly."""
    table = np.full((n, most), -1, np.int32)
    done = 0
    while done < n:
        rows = np.arange(done, min(n, done + (min(GROWTH, done) or FIRST)))
        for k in range(0, len(rows), CHUNK):
            part = rows[k : k + CHUNK]
            ids, sims = _nearest(vectors, part, rows, BUILD_BEAM)
            if done:
                old, value = beam(vectors, table, vectors[part], np.minimum(descend(vectors, above, vectors[part]), done - 1), BUILD_BEAM)
                ids, sims = np.c_[ids, old], np.c_[sims, value]
            order = np.argsort(-sims, 1, kind="stable")[:, :BUILD_BEAM]
            table[part] = choose(vectors, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), most)
        _link_back(vectors, table, rows)
        done = int(rows[-1]) + 1
    return table


def build(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers) of unit vectors. order renames them so that each layer has the first nodes; layers: top first, a
    row of links a node, -1 for none."""
    rng, n = np.random.default_rng(seed), len(vectors)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    vectors, level = vectors[order], level[order]
    layers: list[np.ndarray] = []
    for k in range(int(level.max(initial=0)), -1, -1):
        layers.append(_layer(vectors, int((level >= k).sum()), layers, LINKS if k else GROUND_LINKS))
    return order, layers


def exact(vectors: np.ndarray, queries: np.ndarray, rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, node) of all pairs of the queries `rows` with a node at `least` or nearer, some queries at a time."""
    step = max(1, 16_000_000 // max(len(vectors), 1))
    for k in range(0, len(rows), step):
        i, j = np.nonzero(queries[rows[k : k + step]] @ vectors.T >= least)
        yield rows[k + i], j


def _widening(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, rows: np.ndarray, size: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, node) of the pairs at `least` or nearer that beam search finds, some queries at a time. Queries whose beams are
    full of such nodes search again with beams twice as wide; those that fill the widest beam go through the whole shard."""
    entry = np.zeros(len(queries), np.int64)
    entry[rows] = descend(vectors, layers[:-1], queries[rows])
    going = rows
    while len(going):
        if size > WIDEST:
            yield from exact(vectors, queries, going, least)
            return
        again = []
        step = max(32, CHUNK * BEAM // size)
        for k in range(0, len(going), step):
            part = going[k : k + step]
            ids, sims = beam(vectors, layers[-1], queries[part], entry[part], size)
            hit = sims >= least
            full = hit.all(1)
            again.append(part[full])
            hit[full] = False
            i, j = np.nonzero(hit)
            yield part[i], ids[i, j]
        going, size = np.concatenate(again), size * 2


def search(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, least: float, reached: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, node) of the pairs of a query with a node at `least` or nearer, some at a time. AUDITED queries, evenly spread,
    are searched exactly first; while beams find less than AUDIT_RECALL of their pairs, all beams are doubled. Only where the
    widest beam fails the audit are all queries searched exactly. `reached` gets the pairs that the audit wanted and those that
    the last beams found."""
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(np.int64))
    code = lambda pairs: np.concatenate([np.empty(0, np.int64), *(i * len(vectors) + j for i, j in pairs)])
    wanted, size = code(exact(vectors, queries, audit, least)), BEAM
    while True:
        met = len(np.intersect1d(code(_widening(vectors, layers, queries, audit, size, least)), wanted))
        if met >= AUDIT_RECALL * len(wanted) or size > WIDEST:
            break
        size *= 2
    if reached is not None:
        reached += [len(wanted), met]
    yield from _widening(vectors, layers, queries, np.arange(len(queries)), size, least)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def usable(c: str) -> object:
    """Not null, not zero, and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(c, fine) & F.exists(c, lambda x: x != 0), F.lit(False))


FOUND = "id {kind}, linked long, u {kind}, v {kind}, wanted long, met long"


def linked(reps: DataFrame, cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """What the pairs of distinct vectors (id, vec, copies) with a cosine of `cosine` or more, in double precision, come down
    to, a block of queries and a shard at a time: rows with id and linked, the copies of other vectors linked with it; rows
    with u > v, stars of the links; and a row with the pairs that the audit wanted and met. Vectors of different lengths
    are never compared. Only a count and the largest length are asked of the driver."""
    told = reps.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = told["n"], told["dim"] or 1
    shards, blocks = max(-(-n * 4 * dim // SHARD_BYTES), LEAST_SHARDS), max(2, -(-n // BLOCK_ROWS))
    placed = reps.select("id", "vec", "copies", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    kind = reps.schema["id"].dataType.simpleString()
    exactly = np.float32 if reps.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        raw = np.stack(rows["vec"].to_numpy()).astype(exactly)
        order, layers = build(_unit(raw.astype(np.float64)).astype(np.float32))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [rows["id"].to_numpy()[order]], "copies": [rows["copies"].to_numpy()[order]], "vectors": [raw[order].tobytes()], "layers": [[x.tobytes() for x in layers]]})

    graphs = placed.groupBy("dim", "shard").applyInPandas(make, f"dim int, shard int, ids array<{kind}>, copies array<long>, vectors binary, layers array<binary>")
    graphs = (scratch or Scratch(reps.sparkSession, "hnsw"))(graphs, "graphs")

    def ask(key: tuple, queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "linked", "u", "v", "wanted", "met"]
        if not len(queries) or not len(graph):
            return pd.DataFrame({c: pd.Series([], dtype="Int64") for c in columns})
        row = graph.iloc[0]
        names, copies = np.asarray(row["ids"]), np.asarray(row["copies"])
        full = _unit(np.frombuffer(row["vectors"], exactly).reshape(len(names), -1).astype(np.float64))
        layers = [np.frombuffer(x, np.int32).reshape(-1, GROUND_LINKS if k == len(row["layers"]) - 1 else LINKS) for k, x in enumerate(row["layers"])]
        queries = queries.sort_values("id", kind="stable")
        own, asked = queries["id"].to_numpy(), _unit(np.stack(queries["vec"].to_numpy()).astype(np.float64))
        degree, stars, size, audit = np.zeros(len(own), np.int64), [], 0, []
        for q, node in search(full.astype(np.float32), layers, asked.astype(np.float32), cosine - SLACK, audit):
            keep = np.concatenate([np.empty(0, bool), *(np.einsum("ij,ij->i", asked[q[k : k + 65536]], full[node[k : k + 65536]]) >= cosine for k in range(0, len(q), 65536))])
            q, node = q[keep], node[keep]
            other = own[q] != names[node]
            q, node = q[other], node[other]
            np.add.at(degree, q, copies[node])
            stars.append((own[q], names[node]))
            size += len(q)
            if size > 1_000_000:
                stars, size = [local_stars(*map(np.concatenate, zip(*stars)))], 0
        u, v = local_stars(*map(np.concatenate, zip(*stars)))
        some = degree > 0
        told = pd.DataFrame({"id": own[some], "linked": degree[some]}).astype("Int64")
        return pd.concat([told, pd.DataFrame({"u": u, "v": v}).astype("Int64"), pd.DataFrame({"wanted": audit[:1], "met": audit[1:]}).astype("Int64")]).reindex(columns=columns)

    asked = placed.select("id", "vec", "dim", "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    offered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["dim", "block", "shard"]
    return asked.groupBy(*by).cogroup(offered.groupBy(*by)).applyInPandas(ask, FOUND.format(kind=kind))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """A row for each of `df`: its key, n_links (other vectors linked with it), component_id (the smallest key that links
    reach), kept, and audit_passed: whether the audits of all shards together met AUDIT_RECALL of the pairs that they wanted.

    Equal vectors are one node of the graphs, with a count, so that a vector that a third of the rows have is neither a
    hot group nor a hot spot of a graph. Vectors that share their smallest key are one node: what one of them links, all
    rows of either have. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Keys must be integers; null keys link with nothing. Other columns are not read; an empty table gives no
    rows."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vec")).withColumn("fine", usable("vec") & F.col("id").isNotNull())
    scratch = Scratch(df.sparkSession, "hnsw")
    reps = scratch(rows.where("fine").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    found = scratch(linked(reps, cosine, scratch), "found")
    scratch.drop("graphs")
    audit = found.agg(F.coalesce(F.sum("met") >= AUDIT_RECALL * F.sum("wanted"), F.lit(True)).alias("audit_passed"))
    degree = found.where("id is not null").groupBy("id").agg(F.sum("linked").alias("linked"))
    parts = connected_components(found.where("u is not null").select("u", "v"))
    named = reps.join(degree, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("vec", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = rows.where("fine").join(named, "vec").select("id", "n_links", "component_id")
    rest = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = reduce(DataFrame.union, [good, rest]).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out.crossJoin(F.broadcast(audit))  # one row
