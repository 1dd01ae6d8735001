"""Lexical index and ranking: term statistics, TF-IDF and BM25 for a batch of queries.

Tokens are runs of two or more letters of the lower-cased text. The queries' distinct terms are handed to all tasks while
they are few, so that of the documents' tokens only theirs are ever shuffled, a document's in one row; what is found is staged
once for all scores, which are products of numpy matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from corpusloom.session import staged

TOKEN = r"[\p{L}\p{Nl}\p{No}]{2,}"


def tokens(text) -> object:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl) for every term of every document."""
    cut = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t").cast("long"))
    return cut.select(key, "dl", F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, total_tokens, avgdl. Null texts are documents without tokens."""
    size = F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN)), F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("n_docs"), F.sum(size).alias("total_tokens")).withColumn("avgdl", F.col("total_tokens") / F.greatest("n_docs", F.lit(1)))


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, cf): documents and places that have the term. Both are counted before anything is shuffled."""
    t = docs.select(tokens(F.col(text)).alias("t"))
    # the outer form: else a filter on the list is inferred and the tokens are made twice
    once = t.select(F.explode_outer(F.array_distinct("t")).alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))
    each = t.select(F.explode_outer("t").alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))
    return once.union(each).where("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "query") -> DataFrame:
    return queries.select(qid, F.explode(tokens(F.col(text))).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("qtf"))


@dataclass
class Index:
    """What the scores of some queries need: wanted (qid, term, qtf), found (key, dl, term, tf) of the wanted terms, df
    (term, df), and stats, one row. Where the wanted terms are few, also rows (key, dl, terms, tfs), a document's postings in one,
    whose terms are numbers of `numbers` (number, term)."""

    wanted: DataFrame
    found: DataFrame
    df: DataFrame
    stats: DataFrame
    rows: DataFrame | None = None
    numbers: DataFrame | None = None


MOST_TERMS = 500_000
# documents that are taken at once, and bytes of their texts, about; cells of a matrix, and queries that meet it in one product
BLOCK, TEXTS, CELLS, ASKED = 512, 2_000_000, 4_000_000, 256


def index(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Documents are tokenised once. While the queries' distinct terms are few, a document's postings are counted where it is
    read, and only those are dealt out, a row a document; else every token meets the terms in a join."""
    wanted = query_terms(queries)
    terms = staged(wanted.select("term").distinct(), "lexical-terms")
    cut = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    if terms.count() <= MOST_TERMS:
        return _numbered(wanted, terms, cut)
    # the outer form: else a filter on the list is inferred and the tokens are made twice
    rows = cut.withColumn("dl", F.greatest(F.lit(1), F.size("t")).cast("long")).select("key", "dl", F.explode_outer("t").alias("term")).join(terms, "term")
    found = staged(rows.groupBy("key", "dl", "term").agg(F.count("*").alias("tf")), "lexical-found")
    return Index(wanted, found, found.groupBy("term").agg(F.count("*").alias("df")), staged(corpus_stats(docs, text), "lexical-stats"))


def _numbered(wanted: DataFrame, terms: DataFrame, cut: DataFrame) -> Index:
    """The index of documents (key, t), with numbers for terms. Rows of one key and text are one document with its words
    repeated."""
    spark = cut.sparkSession
    known = sorted(r["term"] for r in terms.collect())
    numbers = spark.createDataFrame(list(enumerate(known)), "number int, term string")
    shared = spark.sparkContext.broadcast(known)
    # as one text: a list of short words takes several times its letters on its way
    texts = cut.select("key", F.coalesce(F.array_join("t", " "), F.lit("")).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_terms = pa.array(shared.value, pa.string())
        for batch in batches:
            letters = np.cumsum(pc.binary_length(batch.column("said")).to_numpy(), dtype=np.int64) // TEXTS
            starts = np.flatnonzero(np.r_[True, (letters[1:] != letters[:-1]) | (np.arange(1, len(batch)) % BLOCK == 0)]) if len(batch) else []
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                part = batch.slice(start, end - start)
                said = part.column("said")
                lists = pc.split_pattern(said, " ")
                size = lists.value_lengths().to_numpy()
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=all_terms), -1).to_numpy()
                doc = np.repeat(np.arange(len(part)), size)
                pair, n = np.unique(doc[at >= 0] * max(len(known), 1) + at[at >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(len(part) + 1) * max(len(known), 1)).astype(np.int32))
                cells = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % max(len(known), 1), n)]
                # a text without words is one empty piece
                words = np.where(pc.binary_length(said).to_numpy() > 0, size, 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text"), pa.array(words), *cells], ["key", "text", "n", "terms", "tfs"])

    schema = StructType([texts.schema["key"], *StructType.fromDDL("text string, n long, terms array<int>, tfs array<int>").fields])
    made = texts.select("key", F.md5("said").alias("text"), "said").mapInArrow(run, schema)
    one = made.groupBy("key", "text").agg(F.first(F.struct("n", "terms", "tfs")).alias("r"), F.count("*").alias("copies"))
    rows = one.select("key", F.col("r.n").alias("n"), "copies", F.greatest(F.lit(1).cast("long"), "r.n").alias("dl"), F.col("r.terms").alias("terms"), F.transform("r.tfs", lambda x: x * F.col("copies")).alias("tfs"))
    rows = staged(rows, "lexical-rows")
    stats = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_docs"), F.sum(F.col("n") * F.col("copies")).alias("total_tokens")).withColumn("avgdl", F.col("total_tokens") / F.greatest("n_docs", F.lit(1)))
    df = rows.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df")).join(F.broadcast(numbers), "number").select("term", "df")
    each = rows.select("key", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("key", "dl", F.col("p.terms").alias("number"), F.col("p.tfs").alias("tf"))
    found = each.join(F.broadcast(numbers), "number").select("key", "dl", "term", "tf")
    return Index(wanted, found, staged(df, "lexical-df"), staged(stats, "lexical-stats"), rows, numbers)


def shared_terms(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", most: int | None = None, once: bool = False) -> DataFrame:
    """(qid, key, score): the part of a query's distinct terms that a document has, for those that share any; with `most`, so many of
    each query at least, the best among them. Rows of one key are one document. They are dealt out by key first, as for the
    other scores, but not where each key comes `once`."""
    wanted = query_terms(queries).select("qid", "term")
    sized = wanted.groupBy("qid").agg(F.count("*").alias("n"))
    asked = staged(wanted.join(sized, "qid"), "lexical-asked")
    few = asked.count() <= MOST_TERMS
    # as one text: a list of short words takes several times its letters in a shuffle
    cut = docs.select(F.col(key).alias("key"), F.array_join(F.array_distinct(tokens(F.col(text))), " ").alias("t"))
    if few and most:
        return _best_shared(cut if once else cut.repartition("key").sortWithinPartitions("key"), asked, queries, most)
    asked = F.broadcast(asked) if few else asked
    met = cut.repartition("key").select("key", F.explode_outer(F.split("t", " ")).alias("term")).join(asked, "term")
    return met.groupBy("qid", "key", "n").agg(F.count("*").alias("met")).select("qid", "key", (F.col("met") / F.col("n")).alias("score"))


def _best_shared(cut: DataFrame, asked: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The best of shared_terms among documents (key, t), whose distinct words are one text; `asked` (qid, term, n) is small."""
    spark = cut.sparkSession
    words = asked.collect()
    terms, numbers = ({x: i for i, x in enumerate(dict.fromkeys(r[c] for r in words))} for c in ("term", "qid"))
    term, query = (np.array([of[r[c]] for r in words], np.int64) for of, c in ((terms, "term"), (numbers, "qid")))
    order = np.argsort(term, kind="stable")
    shared = spark.sparkContext.broadcast((list(terms), np.searchsorted(term[order], np.arange(len(terms) + 1)), query[order], len(numbers)))
    rows = cut.select("key", F.xxhash64("key").alias("same"), F.coalesce("t", F.lit("")).alias("said"))
    found = rows.mapInArrow(lambda batches: most_shared(batches, shared.value, most), StructType([StructField("query", IntegerType()), rows.schema["key"], StructField("met", LongType())]))
    sizes = {r["qid"]: r["n"] for r in words}
    qids = spark.createDataFrame([(i, q, sizes[q]) for q, i in numbers.items()], StructType([StructField("query", IntegerType()), queries.schema["qid"], StructField("n", LongType())]))
    return found.join(F.broadcast(qids), "query").select("qid", "key", (F.col("met") / F.col("n")).alias("score"))


def most_shared(batches: Iterator[pa.RecordBatch], asked: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """(query, key, met) of the k documents that share most terms with each query among a task's rows (key, same, said); ties go by
    key. Rows with an equal `same`, one after another, are one document.

    asked: the terms, for each the place of its first query, these queries, one term after another, and their number. Only the queries
    that have a document's terms are looked at, and only what shares as much as a query's k-th so far is kept."""
    known, first, of, n_queries = asked
    known, many = pa.array(known, pa.string()), np.diff(first)
    least, size = np.ones(n_queries, np.int64), 0
    held: list[pa.Table] = []
    carried = None  # of the last document: same, terms met by each query, key

    def best() -> None:
        nonlocal held, size
        all_held = pa.concat_tables(held).combine_chunks()
        keys = all_held.column("key").combine_chunks()
        parts = keys.flatten() if pa.types.is_struct(keys.type) else [keys]
        order = pc.sort_indices(pa.table([all_held.column("query"), all_held.column("met"), *parts], [str(i) for i in range(2 + len(parts))]), sort_keys=[("0", "ascending"), ("1", "descending"), *((str(i + 2), "ascending") for i in range(len(parts)))], null_placement="at_start")
        all_held = all_held.take(order)
        q = all_held.column("query").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(place == k - 1)
        least[q[last]] = all_held.column("met").to_numpy()[last]
        held = [all_held.filter(pa.array(place < k))]
        size = len(held[0])

    def offer(met: np.ndarray, keys: pa.Array) -> None:
        nonlocal size
        row, q = np.nonzero(met >= least)
        held.append(pa.table([pa.array(q.astype(np.int32)), keys.take(pa.array(row)), pa.array(met[row, q])], ["query", "key", "met"]))
        size += len(row)
        if size > 50_000 + k * n_queries:
            best()

    for batch in batches if n_queries else ():
        if not len(batch):
            continue
        keys, same = batch.column("key"), batch.column("same").to_numpy()
        lists = pc.split_pattern(batch.column("said"), " ")
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
        row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())[at >= 0]
        at = at[at >= 0]
        begin = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        doc = np.searchsorted(begin, row, "right") - 1
        # a part's cells: one for each query, and one for each query of each term
        costs = np.cumsum(np.bincount(doc, many[at], len(begin)) + n_queries) // CELLS
        starts = np.flatnonzero(np.r_[True, costs[1:] != costs[:-1]])
        for a, z in zip(starts, [*starts[1:], len(begin)]):
            inside = slice(*np.searchsorted(doc, (a, z)))
            t, n = at[inside], many[at[inside]]
            q = of[np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            met = np.bincount(np.repeat(doc[inside] - a, n) * n_queries + q, minlength=(z - a) * n_queries).reshape(z - a, n_queries)
            told = keys.take(pa.array(begin[a:z]))
            if carried and carried[0] == same[begin[a]]:
                met[0] += carried[1]
            elif carried:
                offer(carried[1][None], carried[2])
            carried = same[begin[z - 1]], met[-1].copy(), told[-1:]
            offer(met[:-1], told[:-1])
    if carried:
        offer(carried[1][None], carried[2])
        best()
        yield from held[0].cast(pa.schema([pa.field("query", pa.int32()), held[0].schema.field("key"), pa.field("met", pa.int64())])).combine_chunks().to_batches()


def best_of(batches: Iterator[pa.RecordBatch], asked: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """(query, key, score) of the k best of each query among a task's rows (key, same, terms, parts), which come in the order of keys;
    scores that are equal to 9 digits go by that order. Rows with an equal `same`, one after another, are one document.

    asked: term, query and weight of each word of the queries, by query, and the numbers of terms and queries. Documents meet the
    queries in matrix products, a block at a time, and only what is better than a query's k-th so far is kept."""
    term, query, weight, n_terms, n_queries = asked
    cuts = np.searchsorted(query, np.arange(0, n_queries + ASKED, ASKED))
    least, seen, size = np.full(n_queries, -1.0), 0, 0
    held: list[tuple] = []
    carried = None  # of the last document: same, scores, key

    def scores(n: int, doc: np.ndarray, of: np.ndarray, part: np.ndarray) -> np.ndarray:
        there = np.zeros(n_terms, bool)
        there[of] = True
        m = int(there.sum())
        if n > 1 and n * m > CELLS:
            low = doc < n // 2
            return np.concatenate([scores(n // 2, doc[low], of[low], part[low]), scores(n - n // 2, doc[~low] - n // 2, of[~low], part[~low])])
        place = np.cumsum(there) - 1
        own = np.bincount(doc * m + place[of], part, n * m).reshape(n, m)
        out = np.zeros((n, n_queries))
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            word = np.flatnonzero(there[term[a:z]]) + a
            table = np.zeros((m, min(ASKED, n_queries - i * ASKED)))
            table[place[term[word]], query[word] - i * ASKED] = weight[word]
            out[:, i * ASKED : i * ASKED + table.shape[1]] = own @ table
        return out

    def best() -> None:
        nonlocal held, size
        q, told, score, place = (np.concatenate([h[i] for h in held]) for i in range(4))
        keys = pa.concat_arrays([h[4] for h in held])
        order = np.lexsort((place, -told, q))
        first = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[first == k - 1]
        least[q[last]] = told[last]
        order = order[first < k]
        held, size = [(q[order], told[order], score[order], place[order], keys.take(pa.array(order)))], 0

    def offer(score: np.ndarray, keys: pa.Array) -> None:
        nonlocal seen, size
        told = score.round(9)
        row, q = np.nonzero((score > 0) & (told > least))
        held.append((q, told[row, q], score[row, q], seen + row, keys.take(pa.array(row))))
        seen, size = seen + len(score), size + len(row)
        if size > 50_000:
            best()

    for batch in batches:
        if not len(batch):
            continue
        same, keys = batch.column("same").to_numpy(), batch.column("key")
        lists = batch.column("terms")
        of, part = lists.flatten().to_numpy(), batch.column("parts").flatten().to_numpy()
        begin = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        step = max(1, min(BLOCK, CELLS // max(n_queries, 1)))
        for a in range(0, len(begin), step):
            rows = begin[a : a + step]
            end = begin[a + step] if a + step < len(begin) else len(batch)
            inside = slice(ends[rows[0]], ends[end])
            doc = np.repeat(np.searchsorted(rows, np.arange(rows[0], end), "right") - 1, np.diff(ends[rows[0] : end + 1]))
            score = scores(len(rows), doc, of[inside], part[inside])
            if carried and carried[0] == same[rows[0]]:
                score[0] += carried[1]
            elif carried:
                offer(carried[1][None], carried[2])
            told = keys.take(pa.array(rows))
            carried = same[rows[-1]], score[-1].copy(), told[-1:]
            offer(score[:-1], told[:-1])
    if carried:
        offer(carried[1][None], carried[2])
        best()
        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int32)), held[0][4], pa.array(held[0][2])], ["query", "key", "score"])


def _scored(held: Index, weight: Column, part: Callable[[Column], Column], most: int | None = None) -> DataFrame:
    """(qid, key, score > 0): sums of `weight`, of a query's term, times `part`, of a document's frequency. Documents are dealt out by
    key before they meet the queries, so sums need no shuffle of their own, and of a task's sums only the best go on: with `most`,
    so many of each query."""
    asked = staged(held.wanted.join(held.df, "term").crossJoin(F.broadcast(held.stats)).select("qid", "term", weight.alias("weight")), "lexical-weights")  # one row of statistics
    few = asked.count() <= MOST_TERMS
    if few and most and held.rows is not None:
        return _best(held, asked, part, most)
    # a join that shuffles would undo the deal by key, and every pair of query and document would be shuffled for its sum
    asked = F.broadcast(asked) if few else asked
    rows = held.found.repartition("key").crossJoin(F.broadcast(held.stats)).select("key", "term", part(F.col("tf")).alias("part"))
    return asked.join(rows, "term").groupBy("qid", "key").agg(F.sum(F.col("weight") * F.col("part")).alias("score")).where("score > 0")


def _best(held: Index, asked: DataFrame, part: Callable[[Column], Column], most: int) -> DataFrame:
    spark = asked.sparkSession
    words = asked.join(held.numbers, "term").select("qid", "number", "weight").collect()
    numbers = {q: i for i, q in enumerate(dict.fromkeys(r["qid"] for r in words))}
    query = np.array([numbers[r["qid"]] for r in words], np.int64)
    order = np.argsort(query, kind="stable")
    table = np.array([r["number"] for r in words], np.int64)[order], query[order], np.array([r["weight"] for r in words], float)[order], held.numbers.count(), len(numbers)
    shared = spark.sparkContext.broadcast(table)
    rows = held.rows.where(F.size("terms") > 0).crossJoin(F.broadcast(held.stats)).select("key", F.xxhash64("key").alias("same"), "terms", F.transform("tfs", part).alias("parts"))
    schema = StructType([StructField("query", IntegerType()), held.rows.schema["key"], StructField("score", DoubleType())])
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: best_of(batches, shared.value, most), schema)
    qids = spark.createDataFrame([(i, q) for q, i in numbers.items()], StructType([StructField("query", IntegerType()), held.wanted.schema["qid"]]))
    return found.join(F.broadcast(qids), "query").select("qid", "key", "score")


def bm25(held: Index, k1: float = 1.2, b: float = 0.75, most: int | None = None) -> DataFrame:
    """(qid, key, score) with a positive score; with `most`, so many of each query at least, the best among them."""
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = (1 - b) + b * F.col("dl") / F.col("avgdl")
    return _scored(held, F.col("qtf") * idf * (k1 + 1), lambda tf: tf / (tf + k1 * norm), most)


def tfidf(held: Index, most: int | None = None) -> DataFrame:
    """(qid, key, score): the sum over the query's tokens, repeats counted, of tf / dl * (ln((N + 1) / (1 + df)) + 1)."""
    return _scored(held, F.col("qtf") * (F.log((F.col("n_docs") + 1) / (1 + F.col("df"))) + 1), lambda tf: tf / F.col("dl"), most)


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", pos: str = "key") -> DataFrame:
    """The k best of each query with their 1-based rank; equal scores (to 9 digits) in order of `pos`, the order in which
    documents came. The limit is pushed into each task before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), pos)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
