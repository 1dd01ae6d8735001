"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table. ORACLES holds
DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, conversations, extraction, hnsw, language, minhash, mixing, quality, sharding, suffixes, urls, warc, whitening
from corpusloom.session import spread, table


def vocabulary() -> str:
    """The public byte-level vocabulary, read on the driver; tasks get it as a broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(spread(table(spark, sf_dir, "documents")), vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = warc.captures(table(spark, sf_dir, "pages"))
    told = F.col("response.record_type")
    # a revisit's payload is the response's, whose length its HTTP header gives
    return met.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), told.alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = language.fit(docs.where(~language.held_out()))
    told = language.identify(docs, model)
    return told.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.measured(spread(table(spark, sf_dir, "documents")))).drop("repeat_spans")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spread(table(spark, sf_dir, "pages")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedupe(spread(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_extendible_hashing": op4_extendible_hashing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_minhash": op8_minhash,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.top IS NULL OR g.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
""",
    "op4_extendible_hashing": """
WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     l AS (SELECT doc_id, bytes, d::INTEGER AS depth, h >> (60 - d)::INTEGER AS slot FROM r, range(25) AS t(d)),
     s AS (SELECT depth, slot, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY depth, slot),
     f AS (SELECT l.doc_id, l.bytes, l.depth, l.slot, s.shard_bytes, s.shard_rows,
                  row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k
           FROM l JOIN s USING (depth, slot) WHERE s.shard_bytes <= 1048576)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(slot), depth, '0') END AS shard, depth, shard_bytes, shard_rows
FROM f WHERE k = 1
""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS y FROM r GROUP BY x),
d AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept, TRUE AS audit_passed
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)
""",
    "op7_url_filters": r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, url, contains(url, '://') AS ok, regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') AS host0, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path0,
         regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest FROM pages),
n AS (SELECT page_id, html, url, translate(coalesce(host0, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path0, '') AS path,
         CASE WHEN ok THEN translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS node FROM u),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
links AS (SELECT url, node, unnest(regexp_extract_all(html, '<(?:link|LINK)[^>]*rel\s*=\s*["'']?canonical[^>]*href\s*=\s*["'']?([^"''\s>]+)', 1)) AS dst FROM n WHERE node IS NOT NULL),
edges AS (SELECT node AS a, translate(regexp_extract(dst, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN starts_with(regexp_extract(dst, '^.*?://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract(dst, '^.*?://[^/?#]*([^#]*)', 1) AS b FROM links WHERE contains(dst, '://')),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
fit AS (SELECT x.node, x.host || x.path AS hp, rules.* FROM (SELECT node, regexp_extract(node, '^[^/]*') AS host, regexp_extract(node, '^[^/]*([^?]*)', 1) AS path FROM (SELECT a AS node FROM edges UNION SELECT b FROM edges)) x JOIN rules ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p)),
own AS (SELECT node, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM fit GROUP BY node),
own_np AS (SELECT n.page_id, n.host, n.path, n.node, (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, p)) AS rule,
           (SELECT arg_max(verdict, length(h || p)) FROM rules WHERE (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, p)) AS own FROM n),
around AS (SELECT a, b FROM reach UNION SELECT a, a FROM reach),
alias AS (SELECT r.a AS node, bool_or(o.verdict = 'block') AND NOT coalesce(bool_or(o.verdict = 'allow'), false) AS blocked FROM around r JOIN own o ON o.node = r.b GROUP BY r.a)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM own_np LEFT JOIN alias USING (node)
""",
    "op8_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op10_mixing": r"""
WITH s AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  ('0x' || substr(md5('0/' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
g0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
g1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER ()::BIGINT AS total, 3 * source_size AS cap FROM g0),
g2 AS (SELECT *, row_number() OVER f AS pos, total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS l,
              sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS heavy FROM g1 WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
g3 AS (SELECT *, (SELECT arg_min(l::DOUBLE / heavy, pos) FROM g2 WHERE l * w <= cap * heavy) AS level FROM g2),
goal AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM g3),
w0 AS (SELECT *, floor(target)::BIGINT AS takes FROM goal WHERE target >= 1),
w1 AS (SELECT *, greatest(ceil(sum(takes) OVER () / greatest(16, least(4096, ceil(sum(takes) OVER () / 262144.0)))), 64 * count(*) OVER ())::BIGINT AS n FROM w0),
w2 AS (SELECT *, greatest(takes / (sum(takes) OVER ()), 64.0::DOUBLE / n) AS part FROM w1),
lo AS (SELECT *, floor(coalesce(sum(part) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / (sum(part) OVER ()) * 4294967296)::BIGINT AS lo FROM w2),
iv AS (SELECT *, coalesce(lead(lo) OVER (ORDER BY source NULLS LAST), 4294967296) AS hi FROM lo),
slots AS (SELECT i, (i * 2654435769) % 4294967296 AS x FROM range((SELECT max(n) FROM iv)) AS t(i)),
drawn AS (SELECT iv.source, takes, i, row_number() OVER (PARTITION BY iv.source ORDER BY i) - 1 AS b, count(*) OVER (PARTITION BY iv.source) AS k FROM slots JOIN iv ON x >= lo AND x < hi),
blocks AS (SELECT source, i, b, b * (takes // k) + least(b, takes % k) AS s0, (b + 1) * (takes // k) + least(b + 1, takes % k) AS s1 FROM drawn),
cuts AS (SELECT DISTINCT source, takes, takes // k AS q, takes % k AS m FROM drawn),
placed AS (SELECT s.*, goal.source_size, goal.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source),
turns AS (SELECT doc_id, placed.source, q, m, start + e * source_size AS a, least(start + e * source_size + size, takes) AS z FROM placed JOIN cuts ON placed.source IS NOT DISTINCT FROM cuts.source, range(3) AS t(e) WHERE size > 0 AND start + e * source_size < takes),
cut AS (SELECT doc_id, source, a, z, unnest(range(CASE WHEN a < m * (q + 1) THEN a // (q + 1) ELSE m + (a - m * (q + 1)) // q END, 1 + CASE WHEN z - 1 < m * (q + 1) THEN (z - 1) // (q + 1) ELSE m + (z - 1 - m * (q + 1)) // q END)) AS b FROM turns),
got AS (SELECT doc_id, sum(least(z, s1) - greatest(a, s0))::BIGINT AS taken, min(i)::BIGINT AS first_slot, count(*) AS n_slots FROM cut JOIN blocks ON cut.b = blocks.b AND cut.source IS NOT DISTINCT FROM blocks.source GROUP BY doc_id)
SELECT placed.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots FROM placed LEFT JOIN got USING (doc_id)
""",
}
