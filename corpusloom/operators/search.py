"""Search over documents cut into chunks: ranked lists of chunks are fused, hits of patterns come first, and the hits of a
document are brought together into passages, which rank the documents.

What a query fetches is bounded by the sizes of its lists, so all that comes after the lists is small, whatever the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import chunking, excerpts, lexical, matching, retrieval
from corpusloom.session import staged

BETWEEN_PASSAGES = "\n\n[...]\n\n"


def chunk_index(docs: DataFrame, strategy: str = "sliding", size: int = 800, overlap: int = 100, key: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """(key, doc, chunk_idx, raw_text, indexed_text) of every chunk, staged; `key` is the struct (doc, chunk_idx). Null and
    empty texts have no chunk."""
    cut = chunking.chunk(docs, strategy, size, overlap, key, text, name)
    return staged(cut.select(F.struct(F.col(key).alias("doc"), "chunk_idx").alias("key"), F.col(key).alias("doc"), "chunk_idx", "raw_text", "indexed_text"), "chunk-index")


def chunks_of_documents(index: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(qid, key, score, rank): the k best chunks where each has the score of its document in `ranked` (qid, key, score).
    `ranked` has to hold k documents with chunks, or all."""
    found = ranked.select("qid", F.col("key").alias("doc"), "score").join(index.select("doc", "key"), "doc")
    return lexical.top_k(found, k).select("qid", "key", "score", "rank")


def merged_hits(lists: dict[str, DataFrame], patterns: DataFrame, k: int) -> DataFrame:
    """(qid, key, score, methods): a query's k best chunks by rank fusion of `lists` (qid, key, score, rank), or by the
    score of the only one, and the hits of patterns (qid, key, score) that are not among these. `methods` names every
    list that found the chunk, `regex` for patterns."""
    told = {n: x.select("qid", "key", "score", "rank") for n, x in lists.items()}
    fused = retrieval.rrf(list(told.values())) if len(told) > 1 else next(iter(told.values())).select("qid", "key", "score")
    best = lexical.top_k(fused, k).select("qid", "key", "score")
    merged = retrieval.regex_first(patterns, best).select("qid", "key", "score")
    seen = [x.select("qid", "key", F.lit(n).alias("method")) for n, x in told.items()] + [patterns.select("qid", "key", F.lit("regex").alias("method"))]
    methods = reduce(DataFrame.union, seen).groupBy("qid", "key").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return merged.join(methods, ["qid", "key"])


def with_passages(hits: DataFrame, index: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`hits` with doc, chunk_idx, span_start, span_end and excerpt: the whole paragraphs that the chunk's place in its
    document touches, or the chunk itself where its text, whose parts were trimmed, has no place."""
    placed = hits.join(index.select("key", "doc", "chunk_idx", "raw_text"), "key").join(docs.select(F.col(key).alias("doc"), F.col(text).alias("full")), "doc")
    placed = placed.withColumns({"span_start": excerpts.chunk_start(F.col("full"), F.col("raw_text")), "span_end": excerpts.chunk_end(F.col("full"), F.col("raw_text"))})
    whole = F.nullif(excerpts.paragraphs_round(F.col("full"), F.col("span_start"), F.col("span_end")), F.lit(""))
    return placed.withColumn("excerpt", F.coalesce(whole, "raw_text")).drop("full", "raw_text")


def clustered(hits: DataFrame, gap: int = retrieval.SPAN_GAP) -> DataFrame:
    """`hits` with place, their order in a document, and cluster: a hit joins the one before it if it starts within `gap` of
    the furthest end so far. Hits without a span come last; one of them joins if its number follows the largest so far of
    the cluster before it."""
    by = Window.partitionBy("qid", "doc")
    hits = hits.withColumn("place", F.row_number().over(by.orderBy(F.col("span_start").asc_nulls_last(), "chunk_idx", F.desc("score"))))
    before = by.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    spanned = F.col("span_start").isNotNull()
    apart = F.coalesce(F.col("span_start") > F.max("span_end").over(before) + gap, F.lit(True))
    to_here = by.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("cluster", F.sum(F.when(spanned & apart, 1).otherwise(0)).over(to_here))
    # the numbers of the last cluster of spans, and of the hit before: a gap over both begins a cluster
    last = hits.withColumn("ended", F.max("cluster").over(by))
    largest = F.max(F.when(spanned & (F.col("cluster") == F.col("ended")), F.col("chunk_idx"))).over(by)
    previous = F.lag(F.when(~spanned, F.col("chunk_idx"))).over(by.orderBy("place"))
    reach = F.greatest(largest, previous) + 1
    fresh = F.when(~spanned & F.coalesce(F.col("chunk_idx") > reach, F.lit(True)), 1).otherwise(0)
    last = last.withColumn("fresh", fresh)
    return last.withColumn("cluster", F.col("cluster") + F.sum("fresh").over(to_here)).drop("ended", "fresh")


def _told_once(text) -> object:
    return F.array_join(matching.without_repeats(text, r"\n{2,}"), "\n\n")


def documents(hits: DataFrame, k: int, gap: int = retrieval.SPAN_GAP) -> DataFrame:
    """(qid, doc, rank, score, hit_count, cluster_count, methods, span_start, span_end, excerpt): the k documents of the best
    scores for each query, equal ones in order of `doc`. An excerpt is the text of a document's clusters, overlaps told
    once, with a mark between them."""
    held = clustered(hits, gap)
    ranked = lexical.top_k(retrieval.roll_up(held), k, pos="doc")
    # only what is shown is told
    shown = held.join(ranked.select("qid", "doc"), ["qid", "doc"], "left_semi")
    parts = shown.groupBy("qid", "doc", "cluster").agg(F.array_sort(F.collect_list(F.struct("place", "excerpt"))).alias("l"), F.array_distinct(F.flatten(F.collect_list("methods"))).alias("m"))
    told = parts.withColumn("told", _told_once(excerpts.merged_blocks(F.transform("l", lambda x: x["excerpt"]))))
    texts = told.groupBy("qid", "doc").agg(F.array_sort(F.collect_list(F.struct("cluster", "told"))).alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("methods"))
    texts = texts.select("qid", "doc", "methods", _told_once(F.array_join(F.transform("l", lambda x: x["told"]), BETWEEN_PASSAGES)).alias("excerpt"))
    return ranked.join(texts, ["qid", "doc"])
