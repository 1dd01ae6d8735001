"""Registered queries over the chunked index, and their DuckDB SQL where there is any.

Pages and embeddings are paired by page_id = vec_id, and a benchmark item asks with the embedding of its own number."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import lexical, retrieval, search
from corpusloom.plans.catalog import ORACLES, PATTERNS, _docs, _outlines, _queries, query, r6
from corpusloom.session import staged, table

DOCUMENTS, CANDIDATES, FETCH, PATTERN_HITS = 5, 20, 30, 3
PAGE_PATTERNS = [r"^# .*\bthe\b", r"\bund\b[^.]{0,40}\bund\b", "les (la"]


@query(f"SELECT doc_id, score, matches, first_pos, row_number() OVER (ORDER BY matches DESC, first_pos, doc_id) AS rank FROM ({ORACLES['regex_search']}) QUALIFY rank <= {PATTERN_HITS}")
def regex_order(spark, sf_dir):
    """The documents that a search by patterns puts first."""
    best = retrieval.regex_order(retrieval.regex_search(_docs(spark, sf_dir), PATTERNS), PATTERN_HITS)
    return best.select(F.col("key").alias("doc_id"), r6("score"), "matches", "first_pos", F.col("rank").cast("long").alias("rank"))


@query()
def chunk_search(spark, sf_dir):
    """The pages that answer each benchmark item best, by their chunks: BM25 over chunks under their headings, the pages'
    vectors, and patterns that every item asks for. SQL has no heading-aware chunks; a test plays the search in plain
    Python."""
    pages, asked = _outlines(spark, sf_dir), _queries(spark, sf_dir)
    index = search.chunk_index(pages, "sliding", 800, 100, "page_id", "text", "url")
    words = lexical.top_k(lexical.bm25(lexical.index(index, asked, "key", "indexed_text"), most=FETCH), FETCH)
    v = table(spark, sf_dir, "embeddings")
    vectors = v.join(index.select(F.col("doc").alias("vec_id")).distinct(), "vec_id", "left_semi")
    own = asked.join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid").select("qid", "qvec")
    dense = search.chunks_of_documents(index, retrieval.dense_top_k(vectors, own, FETCH), FETCH)
    found = retrieval.regex_order(retrieval.regex_search(index, PAGE_PATTERNS, "key", "raw_text"), PATTERN_HITS)
    everyone = asked.select("qid").crossJoin(F.broadcast(found.select("key", "score")))  # PATTERN_HITS rows
    hits = search.merged_hits({"lexical": staged(words, "chunk-lexical"), "dense": staged(dense, "chunk-dense")}, staged(everyone, "chunk-regex"), CANDIDATES)
    best = search.documents(staged(search.with_passages(hits, index, pages, "page_id"), "chunk-hits"), DOCUMENTS)
    return best.select(
        "qid", F.col("rank").cast("long").alias("rank"), F.col("doc").alias("page_id"), r6("score"), "hit_count", F.col("cluster_count").cast("long").alias("cluster_count"), F.array_join("methods", ",").alias("methods"),
        F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), F.length("excerpt").cast("long").alias("n_chars"), F.md5(F.encode("excerpt", "UTF-8")).alias("digest"),
    )
