"""The registered queries over the reference's operators, and their DuckDB SQL.

Every query reads its whole tables. The benchmark items are the stated, small side of retrieval: 40 to 200 queries.
Doubles are rounded to 6 digits, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunking, evaluation, graph, lexical, matching, retrieval, upkeep
from corpusloom.operators.components import connected_components
from corpusloom.session import spread, staged, table
from corpusloom.sources import importers
from corpusloom.streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PATTERNS = ["licensed under", r"\bversion\s+\d", "the (and"]
GLOSSARY = ["the", "license", "und", "les", "para"]


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str) -> object:
    return F.round(c, 6).alias(c)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nl}}\p{{No}}]{{2,}}')"
# shared by the SQL of the ranked queries: tf of the queries' terms, document lengths, df
BASE = f"""
d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, greatest(1, len(t)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, t, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM d),
bm AS (SELECT qid, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY qid, doc_id),
ti AS (SELECT qid, doc_id, sum(qtf * (tf / dl) * (ln((n + 1) / (1 + df)) + 1)) AS score FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY qid, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm),
tir AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ti)"""


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.index(_docs(spark, sf_dir), _queries(spark, sf_dir))


def _lists(spark: SparkSession, sf_dir: str, k: int) -> list[DataFrame]:
    """The BM25 and the TF-IDF list of the same index."""
    held = _index(spark, sf_dir)
    return [lexical.top_k(lexical.bm25(held, most=k), k), lexical.top_k(lexical.tfidf(held, k), k)]


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.top_k(lexical.bm25(_index(spark, sf_dir), most=k), k)


def _tfidf(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.top_k(lexical.tfidf(_index(spark, sf_dir), k), k)


@query(f"WITH {BASE} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("qid", F.col("key").alias("doc_id"), r6("score"), "rank")


@query(f"WITH {BASE} SELECT qid, doc_id, round(score, 6) AS score, rank FROM tir WHERE rank <= 10")
def tfidf_topk(spark, sf_dir):
    return _tfidf(spark, sf_dir, 10).select("qid", F.col("key").alias("doc_id"), r6("score"), "rank")


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def term_stats(spark, sf_dir):
    return lexical.term_stats(_docs(spark, sf_dir))


@query(f"SELECT count(*) AS n_docs, sum(coalesce(len({TOKENS.format('text')}), 0))::BIGINT AS total_tokens, round(sum(coalesce(len({TOKENS.format('text')}), 0)) / count(*), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(_docs(spark, sf_dir)).select("n_docs", "total_tokens", r6("avgdl"))


@query("""
WITH b AS (SELECT doc_id, trim(text, E' \\t\\n\\r') AS body FROM documents),
p(p) AS (VALUES ('licensed under'), ('\\bversion\\s+\\d'), ('the \\(and')),
h AS (SELECT doc_id, length(regexp_extract(body, '(?is)^(.*?)(?:' || p || ')', 1)) AS pos FROM b, p WHERE regexp_matches(body, '(?is)' || p))
SELECT doc_id, round(1.5 + least(0.6, 0.1 * (count(*) - 1)), 6) AS score, count(*) AS matches, min(pos) AS first_pos FROM h GROUP BY doc_id""")
def regex_search(spark, sf_dir):
    return retrieval.regex_search(_docs(spark, sf_dir), PATTERNS).select(F.col("key").alias("doc_id"), r6("score"), "matches", "first_pos")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0)))
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS qid, v.vec_id, list_cosine_similarity(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 12) DESC, v.vec_id) AS rank
  FROM v q JOIN v ON q.vec_id % 20 = 0) WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return retrieval.dense_top_k(v, asked, 10).select("qid", F.col("key").alias("vec_id"), r6("score"), F.col("rank").cast("long").alias("rank"))


FUSED = f"""{BASE}, l AS (SELECT qid, doc_id, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT qid, doc_id, rank FROM tir WHERE rank <= 30),
rrf AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM l GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rrf)"""


def _fused(spark, sf_dir):
    return retrieval.rrf(_lists(spark, sf_dir, 30))


@query(f"WITH {FUSED} SELECT qid, doc_id, round(score, 6) AS score, rank FROM rr WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    return lexical.top_k(_fused(spark, sf_dir), 20).select("qid", F.col("key").alias("doc_id"), r6("score"), "rank")


@query(f"WITH {BASE}, l AS (SELECT qid, doc_id, score FROM bmr WHERE rank <= 30 UNION ALL SELECT qid, doc_id, score FROM tir WHERE rank <= 30) SELECT qid, doc_id, round(max(score), 6) AS score FROM l GROUP BY ALL")
def max_dedupe(spark, sf_dir):
    return retrieval.max_dedupe(_lists(spark, sf_dir, 30)).select("qid", F.col("key").alias("doc_id"), r6("score"))


@query(f"""WITH {BASE}, p AS (SELECT DISTINCT qid, term FROM q WHERE length(term) >= 11), x AS (SELECT qid, doc_id, round(1.5 + least(0.6, 0.1 * (count(*) - 1)), 6) AS score FROM p JOIN tf USING (term) GROUP BY qid, doc_id),
sem AS (SELECT qid, doc_id, score FROM bmr WHERE rank <= 10)
SELECT qid, doc_id, score, 0 AS part FROM x WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM sem) UNION ALL SELECT qid, doc_id, round(score, 6), 1 FROM sem""")
def regex_first_merge(spark, sf_dir):
    """A query owns its words of eleven letters or more as patterns."""
    held = _index(spark, sf_dir)
    owned = held.wanted.where(F.length("term") >= 11).select("qid", "term")
    found = retrieval.pattern_hits(owned.join(held.found.select("key", "term"), "term"))
    return retrieval.regex_first(found, lexical.top_k(lexical.bm25(held, most=10), 10)).select("qid", F.col("key").alias("doc_id"), r6("score"), "part")


@query(f"WITH {BASE} SELECT qid, doc_id, rank FROM bmr WHERE rank <= 5")
def select_topk(spark, sf_dir):
    return retrieval.select_hits(_bm25(spark, sf_dir, 30), "top_k", 5).select("qid", F.col("key").alias("doc_id"), "rank")


@query(f"WITH {FUSED} SELECT qid, doc_id, round(score, 6) AS score FROM rr WHERE score >= 0.03")
def select_threshold(spark, sf_dir):
    return retrieval.select_hits(_fused(spark, sf_dir), "threshold", threshold=0.03).select("qid", F.col("key").alias("doc_id"), r6("score"))


@query(f"WITH {FUSED} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS rank FROM rr WHERE score >= 0.02 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 5")
def select_topk_threshold(spark, sf_dir):
    ranked = lexical.top_k(_fused(spark, sf_dir), 60)
    return retrieval.select_hits(ranked, "top_k_threshold", 5, 0.02).select("qid", F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 800 THEN range(0, length(text) - 799, 700) WHEN length(text) > 0 THEN [0] ELSE [] END) AS s FROM documents)
SELECT doc_id, (s // 700)::BIGINT AS chunk_idx, length(substring(text, s + 1, 800))::BIGINT AS n_chars, md5(substring(text, s + 1, 800)) AS digest FROM c""")
def chunk_fixed_size(spark, sf_dir):
    return chunking.fixed_size(_docs(spark, sf_dir), 800, 100).select("doc_id", "chunk_idx", F.length("chunk").cast("long").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


def _outlines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", importers.html_outline(F.col("html")).alias("text"))


def _chunked(strategy):
    def run(spark, sf_dir):
        return chunking.chunk(_outlines(spark, sf_dir), strategy, 800, 100, "page_id").select("page_id", "chunk_idx", F.length("raw_text").cast("long").alias("n_chars"), F.md5(F.encode("indexed_text", "UTF-8")).alias("digest"), F.size("breadcrumb").alias("depth"))

    return run


QUERIES |= {f"chunk_{s}": _chunked(s) for s in ("sliding", "section", "recursive")}

def spans_sql(term: str) -> str:
    """(doc_id, i, a, e): the places of a term in the lower-cased texts, one after another."""
    n = len(term)
    pieces = f"SELECT doc_id, unnest(string_split(lower(text), '{term}')) AS piece, generate_subscripts(string_split(lower(text), '{term}'), 1) AS i FROM documents"
    placed = f"SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {n} AS a, max(i) OVER (PARTITION BY doc_id) AS last FROM ({pieces})"
    return f"SELECT doc_id, i::BIGINT AS i, a::BIGINT AS a, (a + {n})::BIGINT AS e FROM ({placed}) WHERE i < last"


HITS = f"""
WITH h AS (SELECT doc_id, a, e, i, 1.0 AS score, true AS x, false AS y FROM ({spans_sql('license')}) UNION ALL SELECT doc_id, a, e, i, 0.5, false, true FROM ({spans_sql('and attion')})),
f AS (SELECT *, CASE WHEN a > max(e) OVER (PARTITION BY doc_id ORDER BY a, i, score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 240 OR row_number() OVER (PARTITION BY doc_id ORDER BY a, i, score DESC) = 1 THEN 1 ELSE 0 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, i, score DESC)::BIGINT AS cluster FROM f)"""


def _hits(spark, sf_dir):
    """Every place of two terms in the whole texts is a hit."""
    found = matching.term_spans(_docs(spark, sf_dir), ["license", "and attion"])
    first = F.col("term") == "license"
    score = F.when(first, 1.0).otherwise(0.5).alias("score")
    return found.select(F.lit(0).alias("qid"), F.col("key").alias("doc"), F.col("nth").alias("chunk_idx"), "span_start", "span_end", score, F.array(F.when(first, "license").otherwise("line")).alias("methods"))


@query(HITS + " SELECT doc_id, a AS span_start, e AS span_end, cluster FROM g")
def hit_clusters(spark, sf_dir):
    return retrieval.hit_clusters(_hits(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "span_start", "span_end", "cluster")


@query(HITS + """ SELECT doc_id, round(max(score) + least(0.4, 0.08 * (count(*) - 1)) + least(0.15, 0.05 * greatest(0, bool_or(x)::INT + bool_or(y)::INT - 1)) + least(0.15, 0.05 * (max(cluster) - 1)), 6) AS score,
count(*) AS hit_count, max(cluster) AS cluster_count, min(a) AS span_start, max(e) AS span_end FROM g GROUP BY doc_id""")
def doc_rollup(spark, sf_dir):
    rolled = retrieval.roll_up(retrieval.hit_clusters(_hits(spark, sf_dir)))
    return rolled.select(F.col("doc").alias("doc_id"), r6("score"), "hit_count", "cluster_count", "span_start", "span_end")


NORMAL = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
CONTAINED = f"ev AS (SELECT b.item_id AS qid, x.doc_id FROM benchmark b JOIN (SELECT doc_id, {NORMAL.format('text')} AS hay FROM documents) x ON contains(x.hay, {NORMAL.format('b.text')}))"


def _evidence(spark, sf_dir):
    facts = _queries(spark, sf_dir).select(F.col("qid").alias("fact_id"), F.col("query").alias("fact"))
    return matching.evidence_containment(facts, _docs(spark, sf_dir).select(F.col("doc_id").alias("key"), "text"))


@query(f"WITH {CONTAINED} SELECT qid AS item_id, doc_id FROM ev")
def evidence_containment(spark, sf_dir):
    return _evidence(spark, sf_dir).select(F.col("fact_id").alias("item_id"), F.col("key").alias("doc_id"))


METRICS = f"""WITH {BASE}, {CONTAINED}, top AS (SELECT qid, doc_id, rank FROM bmr WHERE rank <= 10),
c AS (SELECT item_id AS qid FROM benchmark), x AS (SELECT qid, count(*) AS ne FROM ev GROUP BY qid),
t AS (SELECT top.*, (ev.qid IS NOT NULL)::INT AS rel, sum((ev.qid IS NOT NULL)::INT) OVER (PARTITION BY top.qid ORDER BY rank) AS sofar FROM top LEFT JOIN ev USING (qid, doc_id)),
g AS (SELECT qid, count(*) AS np, sum(rel) AS tp, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN sofar / rank ELSE 0 END) AS aps, sum(CASE WHEN rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM t GROUP BY qid),
m0 AS (SELECT qid, coalesce(ne, 0) AS ne, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, first, coalesce(aps, 0) AS aps, coalesce(dcg, 0) AS dcg FROM c LEFT JOIN x USING (qid) LEFT JOIN g USING (qid)),
m1 AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN ne > 0 THEN tp / ne WHEN np = 0 THEN 1 ELSE 0 END AS recall,
  (SELECT sum(1 / log2(i + 1)) FROM range(1, least(ne, np)::BIGINT + 1) AS r(i)) AS idcg FROM m0),
m AS (SELECT qid, tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, greatest(0, ne - tp)::BIGINT AS fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
  (tp > 0)::INT::DOUBLE AS hit_at_k, coalesce(1 / first, 0) AS mrr, CASE WHEN ne > 0 THEN aps / ne ELSE 0 END AS ap, CASE WHEN ne > 0 THEN coalesce(dcg / idcg, 0) ELSE dcg END AS ndcg FROM m1)"""
MEANS = ("precision", "recall", "f1", "hit_at_k", "mrr", "ap", "ndcg")


def _metrics(spark, sf_dir):
    expected = staged(_evidence(spark, sf_dir).select(F.col("fact_id").alias("qid"), "key"), "evidence")
    return evaluation.rank_metrics(_bm25(spark, sf_dir, 10).select("qid", "key", "rank"), expected, _queries(spark, sf_dir))


@query(METRICS + " SELECT qid, tp, fp, fn, " + ", ".join(f"round({c}, 6) AS {c}" for c in MEANS) + " FROM m")
def rank_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("qid", "tp", "fp", "fn", *map(r6, MEANS))


@query(METRICS + " SELECT count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, " + ", ".join(f"round(avg({c}), 6) AS macro_{c}" for c in MEANS) + """,
round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 6) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM m""")
def metrics_micro_macro(spark, sf_dir):
    s = evaluation.summarise(_metrics(spark, sf_dir))
    return s.select("cases", "tp", "fp", "fn", *(r6(f"macro_{c}") for c in MEANS), *(r6(f"micro_{c}") for c in ("precision", "recall", "f1")))


@query(METRICS + """, l AS (SELECT item_id AS qid, unnest(CASE WHEN length(text) > 200 THEN ['long', 'any'] WHEN length(text) > 150 THEN ['any'] ELSE ['__unlabeled__'] END) AS label FROM benchmark)
SELECT label, count(*) AS cases, """ + ", ".join(f"round(avg({c}), 6) AS macro_{c}" for c in ("precision", "recall", "f1", "mrr", "ndcg")) + " FROM m JOIN l USING (qid) GROUP BY label")
def metrics_by_label(spark, sf_dir):
    n = F.length("query")
    labels = _queries(spark, sf_dir).select("qid", F.when(n > 200, F.array(F.lit("long"), F.lit("any"))).when(n > 150, F.array(F.lit("any"))).alias("labels"))
    s = evaluation.by_label(_metrics(spark, sf_dir), labels)
    return s.select("label", "cases", *(r6(f"macro_{c}") for c in ("precision", "recall", "f1", "mrr", "ndcg")))


PAIRS = "p AS (SELECT a.conv_id * 1000 + a.turn AS case_id, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual"))
    return c.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("text").alias("expected"), "actual")


@query(f"""WITH {PAIRS}, a AS (SELECT case_id, term, count(*) AS n FROM (SELECT case_id, unnest({TOKENS.format('x')}) AS term FROM p) GROUP BY ALL), b AS (SELECT case_id, term, count(*) AS n FROM (SELECT case_id, unnest({TOKENS.format('y')}) AS term FROM p) GROUP BY ALL),
o AS (SELECT case_id, sum(least(a.n, b.n)) AS overlap FROM a JOIN b USING (case_id, term) GROUP BY case_id), na AS (SELECT case_id, sum(n) AS na FROM a GROUP BY case_id), nb AS (SELECT case_id, sum(n) AS nb FROM b GROUP BY case_id)
SELECT case_id, coalesce(overlap, 0)::BIGINT AS overlap, round(coalesce(overlap / nb, 0), 6) AS precision, round(coalesce(overlap / na, 0), 6) AS recall, round(coalesce(2 * overlap / (na + nb), 0), 6) AS f1 FROM p LEFT JOIN o USING (case_id) LEFT JOIN na USING (case_id) LEFT JOIN nb USING (case_id)""")
def token_multiset_f1(spark, sf_dir):
    return evaluation.token_multiset_f1(_pairs(spark, sf_dir), lexical.tokens).select("case_id", F.col("overlap").cast("long").alias("overlap"), r6("precision"), r6("recall"), r6("f1"))


WORDS4 = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"


@query(f"""WITH {PAIRS}, w AS (SELECT case_id, {WORDS4.format('x')} AS a, {WORDS4.format('y')} AS b FROM p)
SELECT case_id, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0), 6) AS overlap FROM w""")
def token_overlap(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("case_id", F.round(matching.token_overlap(matching.words4(F.col("expected")), matching.words4(F.col("actual"))), 6).alias("overlap"))


@query(f"""WITH {BASE}, u AS (SELECT b.qid AS claim_id, rank - 1 AS seq, {WORDS4.format('i.text')} AS a, {WORDS4.format('d0.text')} AS w FROM bmr b JOIN benchmark i ON i.item_id = b.qid JOIN documents d0 ON d0.doc_id = b.doc_id WHERE rank <= 10),
e AS (SELECT claim_id, seq, round(coalesce(len(list_intersect(a, w)) / nullif(least(len(a), len(w)), 0), 0), 6) AS en FROM u),
f AS (SELECT *, round(0.4 * (1 - en), 6) AS co, coalesce(max(en) OVER (PARTITION BY claim_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
g AS (SELECT claim_id, max(en) AS entailment, arg_max(seq, (en, -seq)) AS entailment_seq, max(co) AS contradiction, arg_max(seq, (co, -seq)) AS contradiction_seq, count(*) AS units FROM f WHERE before < 0.9 GROUP BY claim_id)
SELECT *, CASE WHEN entailment >= contradiction AND entailment >= 0.55 THEN 'supported' WHEN entailment >= contradiction AND entailment > 0 THEN 'partial' WHEN contradiction > entailment THEN 'contradicted' ELSE 'not_found' END AS status FROM g""")
def nli_tracker(spark, sf_dir):
    """Overlap stands in for the entailment model, which is a pluggable function."""
    top = _bm25(spark, sf_dir, 10).select(F.col("qid").alias("claim_id"), F.col("key").alias("doc_id"), (F.col("rank") - 1).cast("long").alias("seq"))
    units = top.join(_queries(spark, sf_dir).withColumnRenamed("qid", "claim_id"), "claim_id").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    en = F.round(matching.token_overlap(matching.words4(F.col("query")), matching.words4(F.col("text"))), 6)
    scored = units.select("claim_id", "seq", en.alias("entailment")).withColumn("contradiction", F.round(0.4 * (1 - F.col("entailment")), 6))
    return matching.track(scored)


GRAPH = r"""u AS (SELECT page_id, regexp_extract(url, '^.*?://([^/?#]*)', 1) AS host, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages),
l AS (SELECT host, links, unnest(links) AS link, generate_subscripts(links, 1) AS i FROM u),
e AS (SELECT DISTINCT host AS src, link AS dst FROM l UNION SELECT link, links[i + 1] FROM l WHERE i < len(links) UNION SELECT DISTINCT regexp_replace(host, '^(www|m|blog)[.]', ''), host FROM u),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def _graph(spark, sf_dir):
    """Hosts lead to every link of their pages, links to the link that follows them on a page, and bare hosts to their
    subdomains."""
    u = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1).alias("host"), F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1).alias("links"))
    links = u.select("host", "links", F.posexplode("links").alias("i", "link"))
    after = links.select(F.col("link").alias("src"), F.get("links", F.col("i") + 1).alias("dst")).where("dst is not null")
    bare = u.select(F.regexp_replace("host", "^(www|m|blog)[.]", "").alias("src"), F.col("host").alias("dst"))
    edges = staged(links.select(F.col("host").alias("src"), F.col("link").alias("dst")).union(after).union(bare).distinct(), "page-graph")
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct().withColumn("label", F.regexp_extract("node_id", "[^/]*$", 0))
    return nodes, edges


CLOSURE = ", y AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), r(a, b) AS (SELECT a, b FROM y UNION SELECT r.a, y.b FROM r JOIN y ON r.b = y.a), k AS (SELECT a, min(b) AS b FROM r GROUP BY a)"


@query(f"WITH RECURSIVE {GRAPH} {CLOSURE} SELECT a AS node, least(a, b) AS component FROM k")
def graph_components(spark, sf_dir):
    return connected_components(_graph(spark, sf_dir)[1], "src", "dst")


@query(f"WITH RECURSIVE {GRAPH} {CLOSURE}, z AS (SELECT coalesce(least(a, b), id) AS component, count(*) AS size FROM n LEFT JOIN k ON a = id GROUP BY 1) SELECT lag(component) OVER (ORDER BY size DESC, component) AS src, component AS dst FROM z QUALIFY src IS NOT NULL")
def graph_bridge(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.bridges(graph.sized_components(nodes, edges))


@query(f"""WITH {GRAPH}, nl AS (SELECT id, regexp_extract(id, '[^/]*$') AS label FROM n)
SELECT 'duplicate_label' AS code, min(id) AS node_id, count(*) AS n FROM nl GROUP BY lower(trim(label)) HAVING count(*) > 1 UNION ALL SELECT 'self_loop', src, count(*) FROM e WHERE src = dst GROUP BY src""")
def graph_validate(spark, sf_dir):
    return graph.issues(*_graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRAPH}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), c AS (SELECT a FROM r WHERE a = b),
after AS (SELECT b AS id FROM r JOIN c USING (a) UNION SELECT a FROM c), before AS (SELECT r.a AS id FROM r JOIN c ON r.b = c.a UNION SELECT a FROM c)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM after) AND dst IN (SELECT id FROM before)""")
def graph_cycles(spark, sf_dir):
    return graph.on_cycles(_graph(spark, sf_dir)[1])


@query("""WITH t(term) AS (VALUES ('the'), ('license'), ('und'), ('les'), ('para')), m AS (SELECT doc_id, term, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: w = term)) AS matches FROM documents, t)
SELECT doc_id, term, matches FROM m WHERE matches > 0""")
def glossary_matches(spark, sf_dir):
    return matching.glossary_matches(_docs(spark, sf_dir), GLOSSARY).select(F.col("key").alias("doc_id"), "term", "matches")


@query("SELECT page_id, length(x)::BIGINT AS n_chars, md5(x) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\n{3,}', E'\\n\\n', 'g'), E' \\t\\n\\r') AS x FROM pages)")
def html_to_text(spark, sf_dir):
    x = importers.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(x).cast("long").alias("n_chars"), F.md5(F.encode(x, "UTF-8")).alias("digest"))


FEEDBACK = "f AS (SELECT ts, CASE WHEN event_type IN ('view', 'signup', 'click', 'error', 'purchase') THEN event_type ELSE 'other' END AS use_case, strftime(ts, '%Y-%m-%d') AS day, event_type = 'error' OR value < 0 AS bad FROM events)"


@query(f"WITH {FEEDBACK} SELECT use_case, day, count(*) AS n, count(*) FILTER (bad) AS negative, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM f GROUP BY GROUPING SETS ((), (use_case), (day))")
def feedback_counters(spark, sf_dir):
    c = upkeep.feedback_counters(table(spark, sf_dir, "events"))
    return c.select("use_case", "day", "n", "negative", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query(f"WITH {FEEDBACK} SELECT day, use_case, count(*) AS n, count(*) FILTER (bad) AS negative FROM f GROUP BY ALL")
def feedback_daily(spark, sf_dir):
    return counters.daily_counts(table(spark, sf_dir, "events"))


@query("""WITH o AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE lang IS DISTINCT FROM 'es'), n AS (SELECT doc_id, CASE WHEN lang = 'de' THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END AS t FROM documents WHERE lang IS DISTINCT FROM 'fr')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.t = n.t THEN 'same' ELSE 'changed' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def corpus_sync(spark, sf_dir):
    d = _docs(spark, sf_dir)
    new = d.where(~F.col("lang").eqNullSafe("fr")).withColumn("text", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")))
    return upkeep.corpus_sync(d.where(~F.col("lang").eqNullSafe("es")), new, "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("WITH r AS (SELECT DISTINCT lang AS run, source AS case_id FROM documents) SELECT run, case_id FROM r WHERE case_id IN (SELECT case_id FROM r GROUP BY case_id HAVING count(*) = (SELECT count(DISTINCT run) FROM r))")
def common_cases(spark, sf_dir):
    return evaluation.common_cases(_docs(spark, sf_dir).select(F.col("lang").alias("run"), F.col("source").alias("case_id")).distinct())


@query("SELECT 'toxic' AS variant, count(*) AS cases, count(*) FILTER (toxic > quality) AS wins, count(*) FILTER (toxic = quality) AS ties, count(*) FILTER (toxic < quality) AS losses, round(avg(toxic - quality), 6) AS mean_delta FROM labels")
def variant_vs_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (variant, score)"))
    return evaluation.variant_vs_baseline(rows, "quality").select("variant", "cases", "wins", "ties", "losses", r6("mean_delta"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS purchase_now, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click_now
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def latest_state_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", *(F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in ("purchase", "click")))
    return upkeep.latest_state(e, "user_id", ["ts", "event_id"], ["purchase", "click"]).select("event_id", "purchase_now", "click_now")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source FROM p WHERE k = 1""")
def first_wins(spark, sf_dir):
    return upkeep.first_wins(_docs(spark, sf_dir).select("doc_id", "source"), F.lower(F.trim("source")), "doc_id")


@query(r"""WITH a AS (SELECT doc_id, text AS t, length(text) AS n, CASE WHEN strpos(lower(text), 'license') > 0 THEN strpos(lower(text), 'license') - 1 WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 END AS p FROM documents),
b AS (SELECT *, greatest(0, p - 200) AS s0, least(n, p + 200) AS e0 FROM a), c AS (SELECT *, CASE WHEN s0 = 0 THEN least(n, 400) ELSE e0 END AS e1 FROM b), d AS (SELECT *, CASE WHEN e1 = n THEN greatest(0, n - 400) ELSE s0 END AS s1 FROM c)
SELECT doc_id, md5(CASE WHEN p IS NULL THEN trim(regexp_replace(substring(t, 1, 400), '\n{3,}', E'\n\n', 'g'), E' \t\n\r') || CASE WHEN n > 400 THEN '…' ELSE '' END
ELSE (CASE WHEN s1 > 0 THEN '…' ELSE '' END) || trim(regexp_replace(substring(t, s1 + 1, e1 - s1), '\n{3,}', E'\n\n', 'g'), E' \t\n\r') || (CASE WHEN e1 < n THEN '…' ELSE '' END) END) AS digest FROM d""")
def excerpt_window(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.encode(matching.excerpt(F.col("text"), ["license", "the"]), "UTF-8")).alias("digest"))


@query("SELECT doc_id, greatest(1, coalesce(length(text), 0) // 4)::BIGINT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


STEM = "CASE WHEN length(w) <= 3 THEN w " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN left(w, length(w) - {len(e)})" for e in text.ENDINGS) + " ELSE w END"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[a-z0-9]+') AS l FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(l, lambda w: {STEM}), lambda x: length(x) >= 3))), ' ') AS stems FROM w""")
def label_fingerprint(spark, sf_dir):
    """The stems that a document's whole text comes down to."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.fingerprint(text.ascii_fold("text")), " ").alias("stems"))


@query("SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(trim(source)), '[^\\p{L}\\p{N} \\-_/+.]', '', 'g'), '[ \\-_/+.]+', ' ', 'g')) AS term FROM documents WHERE source IS NOT NULL")
def glossary_terms(spark, sf_dir):
    return _docs(spark, sf_dir).where("source is not null").select(text.glossary_normal(F.col("source")).alias("term")).distinct()
