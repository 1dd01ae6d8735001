"""Registered queries over maps of texts, and their DuckDB SQL. A document's map has its first line as root and its most frequent
words below it; its first sentence stands for the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import labels
from corpusloom.operators import maps
from corpusloom.plans.answers import TITLES, _clean, _stems, _titles, _words
from corpusloom.plans.catalog import query
from corpusloom.plans.texts import COLLAPSED, sql_of
from corpusloom.session import Scratch, spread, staged, table

BLANK = r"E' \t\r\n\f\x0b'"
LAST = lambda sep: f"CASE WHEN contains(left(rest, 700), '{sep}') THEN 699 - strpos(reverse(left(rest, 700)), '{sep[::-1]}') ELSE -1 END"
SEGMENTS = rf"""bl AS (SELECT doc_id, trim(unnest(b), {BLANK}) AS chunk, generate_subscripts(b, 1) AS bi FROM (SELECT doc_id, regexp_split_to_array(trim(text, {BLANK}), '\n\s*\n') AS b FROM documents WHERE text IS NOT NULL)),
cutting AS (SELECT doc_id, bi, 0 AS k, '' AS piece, chunk AS rest FROM bl
  UNION ALL SELECT doc_id, bi, k + 1, trim(left(rest, cut), {BLANK}), trim(substr(rest, cut + 1), {BLANK}) FROM (SELECT *, CASE WHEN length(rest) <= 700 THEN length(rest) WHEN m >= 350 THEN m ELSE 700 END AS cut FROM (SELECT *, greatest({LAST('. ')}, {LAST('; ')}, {LAST(', ')}) AS m FROM cutting WHERE rest <> ''))),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bi, k)::INT AS nth, piece FROM cutting WHERE k > 0 AND piece <> '')"""
SEEDS = f"""{SEGMENTS}, wd AS (SELECT doc_id, nth, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, nth, {_words('piece', 4)} AS w FROM seg)),
ct AS (SELECT doc_id, word, count(*) AS n, min((nth, pos)) AS first FROM wd GROUP BY ALL), tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM ct QUALIFY rank <= 36),
nm AS (SELECT *, {_clean('word', 4, 60)} AS label, {_stems('word')} AS stems FROM tp), kp AS (SELECT * FROM nm WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, stems ORDER BY rank) = 1),
seeds AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rank))::INT AS place, label, n FROM kp QUALIFY place <= 12)"""
ROUNDS = f"""{SEEDS}, q AS (SELECT doc_id, left(split_part(text, '.', 1), 200) AS query, split_part(text, chr(10), 1) AS line FROM documents WHERE text IS NOT NULL),
nd AS (SELECT doc_id, 'n' || lpad(place::VARCHAR, 2, '0') AS node_id, label, 2 AS depth, 0 AS children FROM seeds UNION ALL SELECT doc_id, 'n00', line, 1, coalesce(c, 0) FROM q LEFT JOIN (SELECT doc_id, count(*) AS c FROM seeds GROUP BY ALL) USING (doc_id)),
nc AS (SELECT doc_id, node_id, {_clean('label', 2, 80)} AS label, 4 * (3 - depth) + 2 * greatest(0, 3 - children) AS base FROM nd WHERE depth < 3 AND children < 5),
nb AS (SELECT doc_id, node_id, label, base + 3 * len(list_intersect({_words('query')}, {_words('label')})) AS base FROM nc JOIN q USING (doc_id) WHERE label <> ''),
w AS (SELECT doc_id, 0 AS round, node_id, label, base, 0 AS visits, false AS picked FROM nb
  UNION ALL SELECT doc_id, round + 1, node_id, label, base, visits + best::INT, best FROM (SELECT *, visits < 2 AND row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN visits < 2 THEN base - 4 * visits END DESC NULLS LAST, node_id) = 1 AS best FROM w) WHERE round < 6),
pk AS (SELECT doc_id, round, node_id, label, base - 4 * (visits - 1) AS score FROM w WHERE picked),
ev AS (SELECT doc_id, round, nth, shared FROM (SELECT p.doc_id, round, nth, len(list_intersect(p.words, s.words)) AS shared
    FROM (SELECT doc_id, round, list_distinct(list_concat({_words('label')}, {_words('query')})) AS words FROM pk JOIN q USING (doc_id)) p JOIN (SELECT doc_id, nth, {_words('piece')} AS words FROM seg) s ON p.doc_id = s.doc_id)
  WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, round ORDER BY shared DESC, nth) <= 5)"""


def _segments(spark, sf_dir):
    return maps.segmented(spread(table(spark, sf_dir, "documents")), "doc_id")


def _map(spark, sf_dir, rounds=6):
    """Segments, nodes, picks and evidence of every document's map; segments and picks are read by several steps."""
    scratch = Scratch(spark, "map")
    docs = spread(table(spark, sf_dir, "documents")).where("text is not null")
    pieces = scratch(maps.segmented(docs, "doc_id"), "segments")
    seeds = scratch(maps.seed_concepts(pieces), "seeds")
    below = seeds.select("key", F.format_string("n%02d", "place").alias("node_id"), "label", F.lit(2).alias("depth"), F.lit(0).cast("long").alias("children"))
    counts = seeds.groupBy("key").agg(F.count("*").alias("children"))
    roots = docs.select(F.col("doc_id").alias("key"), F.lit("n00").alias("node_id"), F.substring_index("text", "\n", 1).alias("label"), F.lit(1).alias("depth"))
    nodes = below.unionByName(roots.join(counts, "key", "left").fillna(0, "children"))
    asked = docs.select(F.col("doc_id").alias("key"), F.left(F.substring_index("text", ".", 1), F.lit(200)).alias("query"))
    picks = scratch(maps.frontier_rounds(nodes, asked, rounds), "picks")
    return pieces, nodes, picks, maps.evidence(picks, pieces, asked)


@query(f"WITH RECURSIVE {SEGMENTS} SELECT doc_id, nth, length(piece)::BIGINT AS n_chars, md5(piece) AS digest FROM seg")
def context_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return s.select(F.col("key").alias("doc_id"), "nth", F.length("segment").cast("long").alias("n_chars"), F.md5("segment").alias("digest"))


@query(f"WITH RECURSIVE {SEEDS} SELECT doc_id, place, label, n FROM seeds")
def seed_concepts(spark, sf_dir):
    return maps.seed_concepts(_segments(spark, sf_dir)).withColumnRenamed("key", "doc_id")


@query(f"""WITH RECURSIVE {ROUNDS}, fs AS (SELECT doc_id, nth, min(round) AS round FROM ev GROUP BY ALL), tt AS (SELECT doc_id, count(*) AS total FROM seg GROUP BY ALL)
SELECT pk.doc_id, round, node_id, score::INT AS score, (SELECT count(*) FROM fs WHERE fs.doc_id = pk.doc_id AND fs.round <= pk.round) AS covered, round((SELECT count(*) FROM fs WHERE fs.doc_id = pk.doc_id AND fs.round <= pk.round) / greatest(total, 1), 4) AS coverage_ratio FROM pk JOIN tt ON tt.doc_id = pk.doc_id""")
def coverage_rounds(spark, sf_dir):
    """The node of each of six rounds, and what its evidence has covered by then; the SQL plays the rounds one after another."""
    pieces, _, picks, found = _map(spark, sf_dir)
    out = picks.drop("label").join(maps.coverage(picks, found, pieces), ["key", "round"])
    return out.withColumnRenamed("key", "doc_id")


@query(f"""WITH RECURSIVE {ROUNDS}, lb AS (SELECT doc_id, node_id, {_clean('label', 2, 120)} AS x FROM nd), lw AS (SELECT *, {_words('x')} AS w FROM lb WHERE x <> ''),
op AS (SELECT doc_id, nth, piece, {_words('piece')} AS w, {sql_of(COLLAPSED, 'lower(piece)')} AS low FROM seg ANTI JOIN ev USING (doc_id, nth)),
gp AS (SELECT doc_id, nth, piece, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS gap FROM op WHERE NOT EXISTS (SELECT 1 FROM lw WHERE lw.doc_id = op.doc_id AND (list_has_any(lw.w, op.w) OR (length(x) >= 8 AND contains(low, lower(x))))) QUALIFY gap <= 4),
la AS (SELECT *, {_clean("split_part(split_part(piece, chr(10), 1), '.', 1)", 2, 72)} AS a, array_to_string({_words('piece', 4)}[1:4], ' ') AS b FROM gp)
SELECT doc_id, gap::INT AS gap, nth, CASE WHEN a <> '' THEN a WHEN {_clean('b', 2, 72)} <> '' THEN {_clean('b', 2, 72)} ELSE 'Luecke ' || gap END AS gap_label, (SELECT min(node_id) FROM lw WHERE lw.doc_id = la.doc_id) AS parent_id FROM la""")
def coverage_gaps(spark, sf_dir):
    """The first segments of each document that the rounds' evidence and all labels leave out."""
    pieces, nodes, _, found = _map(spark, sf_dir)
    return maps.gaps(pieces, found, nodes).withColumnRenamed("key", "doc_id")


OUTLINE = rf"""{SEGMENTS}, ln AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {BLANK}) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS nth FROM documents),
hd AS (SELECT doc_id, nth, CASE WHEN regexp_matches(line, '{maps.HEADING}') THEN length(regexp_extract(line, '{maps.HEADING}', 1)) WHEN regexp_matches(line, '{maps.NUMBERED}') THEN 1 + length(regexp_replace(regexp_extract(line, '{maps.NUMBERED}', 1), '[^.]', '', 'g'))
    WHEN length(line) <= 80 AND NOT regexp_matches(line, '{maps.UNTITLED}') AND NOT regexp_matches(line, '[.:;]$') THEN 1 END AS level,
  CASE WHEN regexp_matches(line, '{maps.HEADING}') THEN regexp_extract(line, '{maps.HEADING}', 2) WHEN regexp_matches(line, '{maps.NUMBERED}') THEN regexp_extract(line, '{maps.NUMBERED}', 2) ELSE line END AS said FROM ln WHERE line <> ''),
fd AS (SELECT doc_id, nth, {_clean('said', 2, 90)} AS label, level FROM hd WHERE level IS NOT NULL), fk AS (SELECT * FROM fd WHERE label <> ''),
sx AS (SELECT * FROM fk UNION ALL SELECT * FROM (SELECT doc_id, nth, {_clean("split_part(piece, '.', 1)", 2, 72)} AS label, 1 AS level FROM seg WHERE nth <= 6 AND doc_id NOT IN (SELECT doc_id FROM fk)) WHERE label <> ''),
qq AS (SELECT doc_id, {_words("left(split_part(text, '.', 1), 200)")} AS asked FROM documents WHERE text IS NOT NULL)"""


def _outline(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).where("text is not null").select(F.col("doc_id").alias("key"), "text")
    pieces = staged(maps.segmented(docs, "key"), "segments")
    return maps.outline(docs, pieces), pieces, docs.select("key", F.left(F.substring_index("text", ".", 1), F.lit(200)).alias("query"))


@query(f"WITH RECURSIVE {OUTLINE} SELECT doc_id, nth, label, level::INT AS level FROM sx")
def outline(spark, sf_dir):
    return _outline(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


@query(f"""WITH RECURSIVE {OUTLINE}, a AS (SELECT doc_id, nth, len(list_intersect(asked, {_words('label')}))::INT AS shared FROM sx JOIN qq USING (doc_id)), b AS (SELECT doc_id, nth, (CASE WHEN len(asked) = 0 THEN 1 ELSE len(list_intersect(asked, {_words('piece')})) END)::INT AS shared FROM seg JOIN qq USING (doc_id))
SELECT doc_id, 'section' AS kind, (row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, nth))::INT AS rank, nth, shared FROM a QUALIFY rank <= 6 UNION ALL SELECT doc_id, 'segment', (row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, nth))::INT AS rank, nth, shared FROM b WHERE shared > 0 QUALIFY rank <= 10""")
def source_focus(spark, sf_dir):
    """The sections and segments of each document that have most of its first sentence's words."""
    sections, pieces, asked = _outline(spark, sf_dir)
    kind = lambda d, k: d.select(F.col("key").alias("doc_id"), F.lit(k).alias("kind"), "rank", "nth", "shared")
    return kind(maps.focus_sections(sections, asked), "section").union(kind(maps.focus_segments(pieces, asked), "segment"))


LABELS = ("a", "b", "c")


@query(rf"""WITH {TITLES}, p AS (SELECT page_id, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS body FROM pages), n AS (SELECT page_id, unnest([a, b, c]) AS label FROM t),
s AS (SELECT page_id, {_stems('body')} AS stems, list_transform(regexp_extract_all(body, '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-z])(?:$|[^\p{{L}}\p{{N}}_])', 1), lambda x: lower(x)) AS one, strip_accents(replace(lower(body), 'ß', 'ss')) AS hay FROM p),
l AS (SELECT page_id, trim(label, ' ') AS label, strip_accents(replace(lower(trim(label, ' ')), 'ß', 'ss')) AS folded, {_stems("trim(label, ' ')")} AS st FROM n),
g AS (SELECT l.page_id, label <> '' AND (list_has_any(st, stems) OR (regexp_extract(folded, '{labels.WORD}') <> '' AND list_contains(one, left(regexp_extract(folded, '{labels.WORD}'), 1))) OR (length(trim({sql_of(COLLAPSED, 'folded')}, ' -_:;,.''"')) >= 8 AND contains(hay, trim({sql_of(COLLAPSED, 'folded')}, ' -_:;,.''"')))) AS good,
  label <> '' AND (regexp_matches(label, '{maps.MARKUP}') OR len(st) = 0 OR list_has_all(st, ['source', 'target']) OR list_has_all(st, ['graph', 'format']) OR list_has_all(st, ['mindmap', 'format'])) AS meta FROM l JOIN s USING (page_id)),
c AS (SELECT page_id, count(*) AS total, count_if(good)::BIGINT AS good, count_if(meta)::BIGINT AS meta FROM g GROUP BY page_id)
SELECT page_id, total AS total_nodes, good AS grounded_nodes, round(good / total, 4) AS grounded_ratio, meta AS meta_like_nodes, round(meta / total, 4) AS meta_like_ratio, good >= 2 AND good / total >= 0.45 AND meta <= 1 AND meta / total <= 0.34 AS ok,
CASE WHEN (meta > 1 OR meta / total > 0.34) AND (good = 0 OR meta / total >= 0.5) THEN 'meta_labels_detected' WHEN good < 2 OR good / total < 0.45 THEN 'grounding_insufficient' ELSE 'grounded' END AS reason FROM c""")
def grounding_report(spark, sf_dir):
    """A page's title and headings as labels, its first paragraph as text."""
    named = F.posexplode(F.array(*LABELS)).alias("node_id", "label")
    nodes = _titles(spark, sf_dir).select(F.col("page_id").alias("key"), named)
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("text"), F.lit("").alias("query"))
    return maps.grounding_report(nodes, texts).withColumnRenamed("key", "page_id")
