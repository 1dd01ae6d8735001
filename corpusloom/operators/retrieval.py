"""Dense and pattern retrieval, fusion of result lists, selection, and document roll-up."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REGEX_BASE, REGEX_MORE, REGEX_CAP = 1.5, 0.1, 0.6
RRF_K = 60
SPAN_GAP = 240


def cosine(a, b) -> object:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def dense(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, score): the cosine of every vector to each query vector (qid, qvec). The stated queries are the small
    side of a nested-loop join; scores at or under 0 stay."""
    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("vec")).join(queries.select("qid", "qvec"), F.size("vec") == F.size("qvec")).select("qid", "key", cosine(F.col("vec"), F.col("qvec")).alias("score"))


def safe_pattern(pattern: str) -> tuple[str, bool]:
    """A pattern that both Python and the engine take, and whether it had to be quoted to be one."""
    try:
        re.compile(pattern)
        return pattern, False
    except re.error:
        return re.escape(pattern), True


def regex_search(docs: DataFrame, patterns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, matches, first_pos) of texts that some pattern finds, case ignored, line by line; first_pos is 0-based in
    the trimmed text. Patterns that don't compile are taken literally. A few patterns are columns of one scan, not a join."""
    body = F.btrim(F.col(text), F.lit(" \t\n\r"))
    # case and lines as Python takes them: ^ and $ hold at every line, which only a line feed ends
    made = [f"(?imud-s:{safe_pattern(p)[0]})" for p in patterns]
    hit = [F.col("body").rlike(p) for p in made]
    at = [F.when(h, F.length(F.regexp_extract("body", rf"(?s)\A(.*?){p}", 1))) for h, p in zip(hit, made)]
    rows = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("matches", reduce(lambda a, b: a + b, (h.cast("int") for h in hit)))
    rows = rows.where("matches > 0").withColumn("first_pos", F.least(*at, F.lit(2**31 - 1)).cast("long"))
    return rows.select("key", (REGEX_BASE + F.least(F.lit(REGEX_CAP), REGEX_MORE * (F.col("matches") - 1))).alias("score"), F.col("matches").cast("long").alias("matches"), "first_pos")


def regex_order(found: DataFrame, k: int) -> DataFrame:
    """The k best of what regex_search found, with rank: most patterns, then the earliest place, then the order of keys."""
    best = found.orderBy(F.desc("matches"), F.desc("score"), "first_pos", "key").limit(k)
    # k rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matches"), F.desc("score"), "first_pos", "key")))


def pattern_hits(found: DataFrame) -> DataFrame:
    """(qid, key, score) of (qid, key, term): the score of a text that so many of a query's patterns find."""
    n = found.groupBy("qid", "key").agg(F.count("*").alias("n"))
    return n.select("qid", "key", (REGEX_BASE + F.least(F.lit(REGEX_CAP), REGEX_MORE * (F.col("n") - 1))).alias("score"))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, key, score): the sum over the lists (qid, key, rank) of 1 / (k + rank), rank from 1."""
    rows = reduce(DataFrame.unionByName, (x.select("qid", "key", "rank") for x in lists))
    return rows.groupBy("qid", "key").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def rank_trace(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """(qid, key, <name>_rank and <name>_score of each list, fused_rank) of the k best fused hits: where each hit came from.
    In a list that has a hit twice, its best rank counts."""
    rows = reduce(DataFrame.unionByName, (x.select("qid", "key", "score", "rank", F.lit(n).alias("bucket")) for n, x in lists.items()))
    of = lambda n, c: F.min_by(c, F.when(F.col("bucket") == n, F.col("rank")))
    held = rows.groupBy("qid", "key").agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("score"), *(of(n, "rank").cast("long").alias(f"{n}_rank") for n in lists), *(of(n, "score").alias(f"{n}_score") for n in lists))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "key")
    return held.withColumn("fused_rank", F.row_number().over(order).cast("long")).where(F.col("fused_rank") <= k)


def max_dedupe(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.select("qid", "key", "score") for x in lists)).groupBy("qid", "key").agg(F.max("score").alias("score"))


def regex_first(regex: DataFrame, semantic: DataFrame) -> DataFrame:
    """(qid, key, score, part): regex hits that the semantic list lacks, then that list. A hit in both keeps its semantic
    score."""
    alone = regex.join(semantic.select("qid", "key"), ["qid", "key"], "left_anti")
    return alone.select("qid", "key", "score", F.lit(0).alias("part")).union(semantic.select("qid", "key", "score", F.lit(1)))


def select_hits(ranked: DataFrame, mode: str = "top_k", k: int = 5, threshold: float = 0.05) -> DataFrame:
    """By rank, by score (not cut), or by both, of rows with rank and score."""
    if mode == "threshold":
        return ranked.where(F.col("score") >= threshold)
    if mode == "top_k_threshold":
        kept = ranked.where(F.col("score") >= threshold)
        order = Window.partitionBy("qid").orderBy("rank")
        return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") <= k)


def hit_clusters(hits: DataFrame, gap: int = SPAN_GAP) -> DataFrame:
    """`hits` (qid, doc, span_start, span_end, chunk_idx, score) with cluster: a hit joins the one before it if it starts
    within `gap` of the furthest end so far."""
    order = Window.partitionBy("qid", "doc").orderBy("span_start", "chunk_idx", F.desc("score"))
    furthest = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(furthest.isNull() | (F.col("span_start") > furthest + gap), 1).otherwise(0)
    return hits.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def roll_up(clustered: DataFrame) -> DataFrame:
    """(qid, doc, score, hit_count, cluster_count, span_start, span_end): a document's best hit with bonuses for further
    hits, methods and clusters. Hits have an array `methods`."""
    by = clustered.groupBy("qid", "doc").agg(
        F.max("score").alias("best"), F.count("*").alias("hit_count"), F.max("cluster").alias("cluster_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("n_methods"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"),
    )
    bonus = lambda cap, step, n: F.least(F.lit(cap), step * F.greatest(F.lit(0), n - 1))
    score = F.col("best") + bonus(0.40, 0.08, F.col("hit_count")) + bonus(0.15, 0.05, F.col("n_methods")) + bonus(0.15, 0.05, F.col("cluster_count"))
    return by.select("qid", "doc", score.alias("score"), "hit_count", "cluster_count", "span_start", "span_end")


ASKED_ROWS = 256


def best_of_block(vectors, queries, k: int, step: int = ASKED_ROWS):
    """(row of the query, row of the vector, cosine) of the k best for each query, ties by the order of vectors. Both are matrices
    without zero rows; `step` queries at a time, so that a block's memory doesn't grow with the number of queries."""
    import numpy as np

    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (vectors, queries))
    k, parts = min(k, len(a)), []
    for start in range(0, len(b), step):
        sims = b[start : start + step] @ a.T
        told = sims.round(12)
        told[np.isnan(told)] = -np.inf  # vectors that aren't finite come last
        # all that are as good as the k-th, then the first k of them
        row, col = np.nonzero(told >= np.partition(told, -k, axis=1)[:, -k][:, None])
        order = np.lexsort((col, -told[row, col], row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        parts.append((row + start, col, sims[row, col]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_rows: int = 8192) -> DataFrame:
    """(qid, key, score, rank): the k vectors of the largest cosine for each query (qid, qvec), ties by key.

    Blocks of vectors meet blocks of queries, one matrix product a pair of blocks, and only the k best of each leave it;
    so what is shuffled grows with queries times blocks, not with pairs. Vectors that are null, zero or of another length
    than the query are not scored."""
    n, m = vectors.count(), queries.count()
    nb, qb = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))
    fine = lambda c: F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull())
    block = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    left = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vec")).where(fine("vec")).withColumn("b", block("key", nb)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    right = queries.select("qid", "qvec").where(fine("qvec")).withColumn("q", block("qid", qb)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def best(rows, asked):
        import numpy as np
        import pandas as pd

        out = []
        for dim in set(map(len, asked["qvec"])) if len(rows) else ():
            v, q = rows[rows["vec"].map(len) == dim].sort_values("key"), asked[asked["qvec"].map(len) == dim]
            if not len(v) or not len(q):
                continue
            a, b = (np.stack(x.to_numpy()).astype(float) for x in (v["vec"], q["qvec"]))
            row, col, score = best_of_block(a, b, k)
            out.append(pd.DataFrame({"qid": q["qid"].to_numpy()[row], "key": v["key"].to_numpy()[col], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "key": [], "score": []})

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, key {vectors.schema[key].dataType.simpleString()}, score double"
    scored = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(best, kinds)
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
