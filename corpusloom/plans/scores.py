"""Registered queries over hybrid retrieval, evaluation summaries and graph upkeep, and their DuckDB SQL.

Documents and embeddings are paired by doc_id = vec_id, and a benchmark item asks with the embedding of its own number."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import segments
from corpusloom.operators import evaluation, graph, lexical, matching, retrieval, summaries
from corpusloom.plans.catalog import BASE, CLOSURE, CONTAINED, GRAPH, PAIRS, TOKENS, _bm25, _docs, _graph, _pairs, _queries, query, r6
from corpusloom.session import merged, staged, table

TOP = 10
# candidates that are fetched for each list before they are fused
FETCH = max(30, 4 * TOP)
# sentences of a query, and ids of several documents that are handed to all tasks
HITS, MOST_IDS = 8, 1_000_000
HYBRID = f"""{BASE}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0))),
dn AS (SELECT item_id AS qid, b.vec_id AS doc_id, list_cosine_similarity(a.e, b.e) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(a.e, b.e), 12) DESC, b.vec_id) AS rank FROM benchmark JOIN v a ON a.vec_id = item_id, v b),
lists AS (SELECT qid, doc_id, score, rank, 'lexical' AS bucket FROM bmr WHERE rank <= {FETCH} UNION ALL SELECT qid, doc_id, score, rank, 'dense' FROM dn WHERE rank <= {FETCH}),
fs AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM lists GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fs)"""


def _both(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    asked = _queries(spark, sf_dir).join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid").select("qid", "qvec")
    dense = retrieval.dense_top_k(v, asked, FETCH).select("qid", "key", "score", "rank")
    return [_bm25(spark, sf_dir, FETCH).select("qid", "key", "score", "rank"), dense]


@query(f"WITH {HYBRID} SELECT qid, doc_id, round(score, 6) AS score, rank FROM fr WHERE rank <= {TOP}")
def hybrid_search(spark, sf_dir):
    return lexical.top_k(retrieval.rrf(_both(spark, sf_dir)), TOP).select("qid", F.col("key").alias("doc_id"), r6("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {HYBRID} SELECT qid, doc_id, min(l.rank) FILTER (bucket = 'lexical')::BIGINT AS lexical_rank, round(max(l.score) FILTER (bucket = 'lexical'), 6) AS lexical_score,
min(l.rank) FILTER (bucket = 'dense')::BIGINT AS dense_rank, round(max(l.score) FILTER (bucket = 'dense'), 6) AS dense_score, max(fr.rank)::BIGINT AS fused_rank FROM lists l JOIN fr USING (qid, doc_id) WHERE fr.rank <= {TOP} GROUP BY qid, doc_id""")
def rank_trace(spark, sf_dir):
    return retrieval.rank_trace({n: staged(x, "trace") for n, x in zip(("lexical", "dense"), _both(spark, sf_dir))}, TOP).select(
        "qid", F.col("key").alias("doc_id"), "lexical_rank", r6("lexical_score"), "dense_rank", r6("dense_score"), "fused_rank"
    )


@query(f"WITH {BASE}, {CONTAINED}, m AS (SELECT qid, count(*) AS n FROM bmr JOIN ev USING (qid, doc_id) WHERE rank <= 10 GROUP BY qid) SELECT item_id AS qid, (n IS NOT NULL)::INT::BIGINT AS matched, (n IS NOT NULL)::INT::DOUBLE AS recall FROM benchmark LEFT JOIN m ON qid = item_id")
def contains_recall(spark, sf_dir):
    top = _bm25(spark, sf_dir, TOP).select("qid", "key").join(_docs(spark, sf_dir).select(F.col("doc_id").alias("key"), "text"), "key")
    return evaluation.contains_recall(_queries(spark, sf_dir), top, matching.normal)


@query(f"""WITH chunks AS (SELECT doc_id, c, i FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), '\\x02|\\n{{2,}}'), lambda x: trim(x, E' \\t\\r\\n')), lambda x: x <> '') AS l FROM documents))),
q AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS.format('text')}) AS term FROM benchmark), n AS (SELECT qid, count(*) AS n FROM q GROUP BY qid), t AS (SELECT DISTINCT doc_id, i, unnest({TOKENS.format('c')}) AS term FROM chunks),
s AS (SELECT qid, doc_id, i, count(*) / any_value(n) AS score FROM q JOIN t USING (term) JOIN n USING (qid) GROUP BY qid, doc_id, i)
SELECT qid, doc_id, i AS chunk, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, i) AS rank FROM s QUALIFY rank <= 8""")
def source_search(spark, sf_dir):
    """The sentences that hold the most of a query's words. Documents whose id others share are dealt out by their sentences'
    keys; those of all others, the most, are scored where they are read."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    again = staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "source-again")
    n = again.count()

    def best(docs, once):
        cut = docs.select("doc_id", F.posexplode(segments.candidates(F.col("text"))).alias("i", "text"))
        chunks = cut.select(F.struct("doc_id", (F.col("i") + 1).cast("long").alias("chunk")).alias("key"), "text")
        return lexical.shared_terms(chunks, _queries(spark, sf_dir), key="key", most=HITS, once=once)

    same = F.col("doc_id").eqNullSafe(F.col("id"))
    again = F.broadcast(again) if n <= MOST_IDS else merged(again)
    scored = best(docs.join(again, same, "left_anti"), True).union(best(docs.join(again, same, "left_semi"), False)) if n else best(docs, True)
    return lexical.top_k(scored, HITS).select("qid", "key.doc_id", "key.chunk", r6("score"), F.col("rank").cast("long").alias("rank"))


def _judgements(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("value") > 50).alias("correct"), (F.col("event_type") != "error").alias("parsed"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("confidence"), F.abs("value").alias("duration_ms"), F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").alias("preferred"))


@query("SELECT count(*) AS cases, count(*) FILTER (value > 50) AS correct, count(*) - count(*) FILTER (value > 50) AS incorrect, round(count(*) FILTER (value > 50) / count(*), 6) AS accuracy, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS parsed_rate, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 4) AS avg_confidence, round(avg(abs(value)), 4) AS avg_duration_ms, count(*) FILTER (value > 50) / count(*) >= 0.8 AS passed FROM events")
def judge_summary(spark, sf_dir):
    s = summaries.judged(_judgements(spark, sf_dir))
    return s.select("cases", "correct", "incorrect", r6("accuracy"), r6("parsed_rate"), *(F.round(c, 4).alias(c) for c in ("avg_confidence", "avg_duration_ms")), "passed")


@query("""WITH s AS (SELECT count(*) AS cases, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type <> 'error') AS parsed FROM events), g AS (SELECT *, a / cases - b / cases AS gap FROM s)
SELECT cases, a AS preferred_a, b AS preferred_b, cases - a - b AS undecided, parsed, round(parsed / cases, 6) AS parsed_rate, round(gap, 6) AS win_gap, CASE WHEN gap > 0 THEN 'A' WHEN gap < 0 THEN 'B' ELSE 'tie' END AS winner, abs(gap) > 0.05 AS passed FROM g""")
def compare_summary(spark, sf_dir):
    s = summaries.compared(_judgements(spark, sf_dir))
    return s.select("cases", "preferred_a", "preferred_b", "undecided", "parsed", r6("parsed_rate"), r6("win_gap"), "winner", "passed")


@query("""WITH r AS (SELECT event_type AS variant, value > 0 AS ok, (user_id % 5) / 4 AS pass_rate, abs(value) AS t FROM events), s AS (SELECT *, 0.35 * ok::INT + 0.5 * pass_rate + 0.15 / (1 + t / 150) AS score FROM r)
SELECT variant, count(*) AS cases, round(avg(ok::INT), 6) AS ok_rate, round(avg(t), 4) AS mean_elapsed_ms, round(avg(pass_rate), 6) AS mean_pass_rate, round(avg(score), 6) AS mean_score FROM s GROUP BY variant""")
def variant_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), (F.col("value") > 0).alias("ok"), (F.pmod("user_id", F.lit(5)) / 4).alias("pass_rate"), F.abs("value").alias("elapsed_ms"))
    s = summaries.variants(evaluation.agentic_score(e))
    return s.select("variant", "cases", r6("ok_rate"), F.round("mean_elapsed_ms", 4).alias("mean_elapsed_ms"), r6("mean_pass_rate"), r6("mean_score"))


@query("SELECT CASE event_type WHEN 'view' THEN 'belegt' WHEN 'click' THEN 'teilweise' WHEN 'error' THEN 'widerspruch' ELSE 'nicht_belegt' END AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    told = F.when(F.col("event_type") == "view", " Supported ").when(F.col("event_type") == "click", "PARTIAL").when(F.col("event_type") == "error", "conflict").otherwise(F.col("event_type"))
    return summaries.status_counts(table(spark, sf_dir, "events").select(told.alias("status")))


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) = 1")
def sweep_best_run(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return summaries.best_run(runs, "event_type", "user_id", "n")


def _more(pattern: str) -> str:
    return f"len(regexp_extract_all(y, '{pattern}')) - len(regexp_extract_all(x, '{pattern}'))"


@query(f"""WITH {PAIRS}, d AS (SELECT case_id, ({_more(chr(92) + 'n')})::INT AS newline_delta, ({_more('(?m)^\\s{0,3}#{1,6}\\s+')})::INT AS heading_delta, ({_more('(?m)^\\s*(?:[-+*]|\\d+[.)])\\s+')})::INT AS list_delta FROM p)
SELECT *, concat_ws(',', CASE WHEN newline_delta > 8 THEN 'too_many_line_breaks' END, CASE WHEN newline_delta < -8 THEN 'too_few_line_breaks' END, CASE WHEN abs(heading_delta) >= 2 THEN 'heading_structure_drift' END, CASE WHEN abs(list_delta) >= 2 THEN 'list_structure_drift' END) AS tags FROM d""")
def structure_drift(spark, sf_dir):
    return summaries.structure_deltas(_pairs(spark, sf_dir)).select("case_id", "newline_delta", "heading_delta", "list_delta", F.array_join("tags", ",").alias("tags"))


ASSERTIONS = (("type", "exists", None), ("type", "equals", "click"), ("type", "len_gte", 5), ("value", "gte", 50), ("value", "lte", 10), ("type", "contains", "i"), ("none", "exists", None), ("type", "not_equals", "view"))


@query("""WITH p AS (SELECT event_id, value > 50 OR value = 50 AS g, value <= 10 AS l, event_type AS t FROM events)
SELECT event_id, 1 + (t = 'click')::INT + (length(t) >= 5)::INT + coalesce(g, false)::INT + coalesce(l, false)::INT + contains(t, 'i')::INT + (t <> 'view')::INT AS passed FROM p""")
def assertion_counts(spark, sf_dir):
    """How many of eight assertions hold for each event."""
    e = table(spark, sf_dir, "events")
    of = {"type": F.col("event_type"), "value": F.col("value").cast("string"), "none": F.lit(None).cast("string")}
    passed = sum(summaries.asserted(of[path], op, expected).cast("int") for path, op, expected in ASSERTIONS)
    return e.select("event_id", passed.alias("passed"))


@query(f"WITH RECURSIVE {GRAPH}, r(id, depth) AS (SELECT min(host), 1 FROM u UNION SELECT e.dst, depth + 1 FROM r JOIN e ON r.id = e.src WHERE depth < 40) SELECT id AS node, min(depth)::INT AS depth FROM r GROUP BY id")
def graph_depths(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    hosts = table(spark, sf_dir, "pages").agg(F.min(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1)).alias("node"))
    return graph.depths(edges, hosts)


@query(f"""WITH {GRAPH}, nl AS (SELECT id, lower(trim(regexp_extract(id, '[^/]*$'))) AS l FROM n), i AS (SELECT id, min(id) OVER (PARTITION BY l) AS into_id FROM nl WHERE l <> '')
SELECT DISTINCT a.into_id AS src, b.into_id AS dst FROM e JOIN i a ON a.id = src JOIN i b ON b.id = dst WHERE a.into_id <> b.into_id""")
def graph_label_merge(spark, sf_dir):
    return graph.merge_equal_labels(*_graph(spark, sf_dir), F.lower(F.trim("label")))[1]


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '^.*?://([^/?#]*)', 1) AS host, lang FROM (SELECT url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)), a AS (SELECT host AS src, 'x' AS dst FROM h WHERE lang = 'de' UNION SELECT host, 'x' FROM h WHERE lang = 'fr')
SELECT src AS node_id, CASE WHEN src IN (SELECT host FROM h WHERE lang = 'de') THEN 'de' ELSE 'fr' END AS label FROM a""")
def graph_merge(spark, sf_dir):
    """The hosts of German and of French pages as one graph; a host of both keeps the first one's label."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1).alias("node_id"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("label"))
    side = lambda lang: p.where(F.col("label") == lang).distinct()
    edges = lambda n: n.select(F.col("node_id").alias("src"), F.lit("x").alias("dst"))
    return graph.merged([(side(x), edges(side(x))) for x in ("de", "fr")])[0]
