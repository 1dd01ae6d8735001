"""Registered queries over page layout, spans and trees, and their DuckDB SQL.

A host stands for a book and its pages, in order of their ids, for the book's pages: their titles and headings are the lines
at the top, what their footers say before the dot in the middle the line at the bottom, and lengths stand for heights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import graph, layout, matching
from corpusloom.plans.catalog import GLOSSARY, GRAPH, _graph, query, spans_sql
from corpusloom.session import spread, staging_path, table
from corpusloom.streaming import index

HOST = r"^.*?://([^/?#]*)"
LAYOUT = r"""s AS (SELECT page_id AS page, regexp_extract(url, '^.*?://([^/?#]*)', 1) AS book, regexp_extract(html, '<title>([^<]*)', 1) AS t, regexp_extract(html, '<h1>([^<]*)', 1) AS h, regexp_extract(html, '<footer>([^<]*)', 1) AS f FROM pages),
l AS (SELECT book, page, 'top' AS side, lower(regexp_extract(t, '^\S+')) AS key, length(t) + 6.0 AS margin FROM s WHERE t <> '' UNION ALL SELECT book, page, 'top', lower(regexp_extract(h, '^\S+ \S+')), length(h) + 7.0 FROM s WHERE h <> ''
  UNION ALL SELECT book, page, 'bottom', lower(regexp_extract(f, '^[^ ]* [^ ]*')), length(f) + 6.0 FROM s WHERE f <> ''),
acc AS (SELECT book, side, key FROM l GROUP BY ALL HAVING count(DISTINCT page) >= 2),
ch AS (SELECT l.* FROM l SEMI JOIN acc USING (book, side, key) QUALIFY row_number() OVER (PARTITION BY book, page, side ORDER BY margin DESC, key) = 1),
c AS (SELECT s.book, s.page, h.key AS header, coalesce(h.margin, 0)::DOUBLE AS top, f.key AS footer, coalesce(f.margin, 0)::DOUBLE AS bottom FROM s LEFT JOIN ch h ON s.book = h.book AND s.page = h.page AND h.side = 'top' LEFT JOIN ch f ON s.book = f.book AND s.page = f.page AND f.side = 'bottom'),
pr AS (SELECT book, header, footer, count(*) AS n, list_sort(list(top)) AS t, list_sort(list(bottom)) AS b FROM c GROUP BY ALL),
pq AS (SELECT book, header, footer, n, (header IS NOT NULL)::INT + (footer IS NOT NULL)::INT AS sides, t[1 + round_even(0.5 * (n - 1), 0)::INT] + b[1 + round_even(0.5 * (n - 1), 0)::INT] AS mid, t[1 + round_even(0.85 * (n - 1), 0)::INT] AS proto_top, b[1 + round_even(0.85 * (n - 1), 0)::INT] AS proto_bottom FROM pr),
rk AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, sides DESC, mid DESC, header NULLS FIRST, footer NULLS FIRST) AS place FROM pq),
pp AS (SELECT book, header, footer, n, place, proto_top, proto_bottom, CASE WHEN bool_or(place = 1 AND sides = 0) OVER (PARTITION BY book) AND max(place) OVER (PARTITION BY book) > 1 THEN place BETWEEN 2 AND 3 ELSE place <= 3 END AS selected FROM rk)"""
SMOOTH = f"""{LAYOUT}, d AS (SELECT c.book, page, place, abs(top - proto_top) + abs(bottom - proto_bottom)
  + CASE WHEN c.header IS NOT NULL AND p.header IS NOT NULL THEN CASE WHEN c.header <> p.header THEN 22 ELSE 0 END WHEN c.header IS NOT NULL THEN 28 WHEN p.header IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN c.footer IS NOT NULL AND p.footer IS NOT NULL THEN CASE WHEN c.footer <> p.footer THEN 22 ELSE 0 END WHEN c.footer IS NOT NULL THEN 28 WHEN p.footer IS NOT NULL THEN 10 ELSE 0 END AS dist FROM c JOIN pp p ON c.book = p.book AND selected),
a AS (SELECT book, page, arg_min(place, (dist, place)) AS place FROM d GROUP BY ALL),
z AS (SELECT *, row_number() OVER w AS i, lag(place) OVER w AS before, lead(place) OVER w AS after FROM a WINDOW w AS (PARTITION BY book ORDER BY page)),
y AS (SELECT z.*, coalesce(before = after AND z.place <> before AND d1.dist <= d2.dist + 6, false) AS could FROM z LEFT JOIN d d1 ON d1.book = z.book AND d1.page = z.page AND d1.place = z.before LEFT JOIN d d2 ON d2.book = z.book AND d2.page = z.page AND d2.place = z.place)"""


def _chosen(spark, sf_dir):
    part = lambda p: F.regexp_extract("html", p, 1)
    s = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("page"), F.regexp_extract("url", HOST, 1).alias("book"), part("<title>([^<]*)").alias("t"), part("<h1>([^<]*)").alias("h"), part("<footer>([^<]*)").alias("f"))
    line = lambda side, c, key, more: F.when(F.col(c) != "", F.struct(F.lit(side).alias("side"), F.lower(F.regexp_extract(c, key, 0)).alias("key"), (F.length(c) + F.lit(more)).alias("margin")))
    found = F.array_compact(F.array(line("top", "t", r"^\S+", 6.0), line("top", "h", r"^\S+ \S+", 7.0), line("bottom", "f", "^[^ ]* [^ ]*", 6.0)))
    lines = s.select("book", "page", F.explode(found).alias("x")).select("book", "page", "x.*")
    return layout.choices(s.select("book", "page"), lines)


@query(f"WITH {LAYOUT} SELECT book, header, footer, n, place::BIGINT AS place, selected, proto_top, proto_bottom FROM pp")
def layout_pairs(spark, sf_dir):
    """The pairs of running header and footer that a host's pages have."""
    return layout.pairs(_chosen(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH RECURSIVE {SMOOTH}, w AS (SELECT book, page, i, place, before, could, could AS moved FROM y WHERE i = 1 UNION ALL SELECT y.book, y.page, y.i, y.place, y.before, y.could, y.could AND NOT w.moved FROM w JOIN y ON y.book = w.book AND y.i = w.i + 1)
SELECT book, page, place::BIGINT AS place, (CASE WHEN moved THEN before ELSE place END)::BIGINT AS smooth FROM w""")
def layout_smooth(spark, sf_dir):
    """Each page's pair, before and after single pages between two of another pair are taken in."""
    chosen = _chosen(spark, sf_dir)
    out = layout.smoothed(layout.assigned(chosen, layout.pairs(chosen)))
    return out.select("book", "page", F.col("place").cast("long").alias("place"), F.col("smooth").cast("long").alias("smooth"))


BARE = r"E' \t\r\f\x0b'"
REFLOW = rf"""l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: rtrim(x, {BARE})) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, l, list_sort(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(trim(x, {BARE})))) AS z FROM l),
i AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, greatest(1, coalesce(z[1 + floor((len(z) - 1) * 0.85)::INT], 1)) AS width FROM w),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM i),
g AS (SELECT doc_id, i, CASE WHEN line = '' THEN chr(2) ELSE CASE WHEN coalesce(before, '') = '' THEN '' WHEN regexp_matches(before, '-[ \t\r\f\x0B]*$') THEN '' WHEN regexp_matches(before, '[.!?][''"”)\]]?[ \t\r\f\x0B]*$') AND length(trim(before, {BARE})) < width * 0.75 THEN chr(2) ELSE ' ' END
  || CASE WHEN regexp_matches(line, '-[ \t\r\f\x0B]*$') THEN rtrim(rtrim(line, '-'), {BARE}) ELSE line END END AS piece FROM b),
j AS (SELECT doc_id, list_filter(string_split(string_agg(piece, '' ORDER BY i), chr(2)), lambda p: p <> '') AS p FROM g GROUP BY doc_id)"""


@query(f"WITH {REFLOW} SELECT doc_id, unnest(p) AS paragraph, generate_subscripts(p, 1)::BIGINT AS nth FROM j")
def reflow(spark, sf_dir):
    return layout.reflowed(spread(table(spark, sf_dir, "documents")), "doc_id")


PLAIN = r"(?:#{1,6}\s|```|\||\s{0,3}(?:[-*+]|\d+[.)])\s|\[Seite \d+\]|---+\s*$)"


@query(rf"""WITH RECURSIVE b AS (SELECT conv_id AS book, turn AS page, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n\s*'), lambda b: trim(b, E' \t\r\n')), lambda b: b <> '') AS b FROM conversations),
r AS (SELECT *, len(b) AS n, row_number() OVER o AS i, lag(b[-1]) OVER o AS tail, lag(len(b)) OVER o AS before FROM b WINDOW o AS (PARTITION BY book ORDER BY page)),
c AS (SELECT *, coalesce(NOT regexp_matches(tail, '(?m)^{PLAIN}') AND NOT regexp_matches(b[1], '(?m)^{PLAIN}') AND (NOT regexp_matches(tail, '[.!?][''"”)\]]?[ \t\r\f\x0B]*$') OR regexp_matches(b[1], '^\p{{Ll}}')), false) AS could FROM r),
w AS (SELECT *, could AS gives FROM c WHERE i = 1 UNION ALL SELECT c.*, c.could AND NOT (c.before = 1 AND w.gives) FROM w JOIN c ON c.book = w.book AND c.i = w.i + 1),
f AS (SELECT *, lead(CASE WHEN gives THEN b[1] END) OVER (PARTITION BY book ORDER BY page) AS takes FROM w),
k AS (SELECT *, CASE WHEN takes IS NULL THEN b ELSE list_concat(b[1:n - 1], [CASE WHEN regexp_matches(b[-1], '-[ \t\r\f\x0B]*$') THEN rtrim(rtrim(rtrim(b[-1]), '-')) || takes ELSE b[-1] || ' ' || takes END]) END AS kept FROM f)
SELECT book, page, array_to_string(CASE WHEN gives THEN kept[2:] ELSE kept END, chr(10) || chr(10)) AS text FROM k""")
def page_merge(spark, sf_dir):
    """A conversation is a book here and its turns are the pages."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    return layout.merged_pages(pages)


SPANS = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, a, e FROM ({spans_sql(t)})" for t in GLOSSARY)


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::BIGINT AS seg_start, length(line)::BIGINT AS n FROM l), t AS ({SPANS}),
m AS (SELECT s.doc_id, seg_start, a, e, term FROM s JOIN t ON s.doc_id = t.doc_id AND a < seg_start + n AND e > seg_start WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY s.doc_id, seg_start ORDER BY e - a DESC, a, term) = 1)
SELECT s.doc_id, s.seg_start, s.seg_start + n AS seg_end, a AS span_start, e AS span_end, term FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.seg_start = m.seg_start WHERE n > 0""")
def segment_matches(spark, sf_dir):
    """For each line of a document, the widest place of a glossary term in it."""
    docs = spread(table(spark, sf_dir, "documents"))
    cut = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long")).alias("n"))
    rows = cut.select("doc_id", F.posexplode("n").alias("i", "n"))
    start = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("i")) - F.col("n") - 1
    segments = rows.select(F.col("doc_id").alias("key"), start.alias("seg_start"), (start + F.col("n")).alias("seg_end")).where("seg_end > seg_start")
    spans = matching.term_spans(docs, GLOSSARY).select("key", "span_start", "span_end", "term")
    out = matching.widest_cover(segments, spans)
    return out.select(F.col("key").alias("doc_id"), "seg_start", "seg_end", F.col("span.span_start").cast("long").alias("span_start"), F.col("span.span_end").cast("long").alias("span_end"), "span.term")


@query(f"WITH RECURSIVE {GRAPH}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT a AS node, count(*) AS below FROM r GROUP BY a")
def graph_descendants(spark, sf_dir):
    """How many nodes each node leads to."""
    return graph.descendants(_graph(spark, sf_dir)[1]).groupBy("node").agg(F.count("*").alias("below"))


@query(f"""WITH RECURSIVE {GRAPH}, p AS (SELECT dst, min(src) AS src FROM e WHERE src <> dst GROUP BY dst), up(a, b) AS (SELECT dst, src FROM p UNION SELECT up.a, p.src FROM up JOIN p ON up.b = p.dst),
back AS (SELECT x.a, min(x.b) AS least FROM up x JOIN up y ON y.a = x.b AND y.b = x.a GROUP BY x.a), c AS (SELECT a FROM back WHERE a = least)
SELECT src, dst FROM p WHERE dst NOT IN (SELECT a FROM c) UNION ALL SELECT 'root', id FROM n WHERE id NOT IN (SELECT dst FROM p) OR id IN (SELECT a FROM c)""")
def graph_single_root(spark, sf_dir):
    return graph.single_root(*_graph(spark, sf_dir))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN lang = 'en' THEN text || ' second edition' ELSE text END), '[\p{L}\p{Nl}\p{No}]{2,}') AS t FROM documents WHERE lang IS DISTINCT FROM 'de'),
x AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM x GROUP BY term""")
def index_upkeep(spark, sf_dir):
    """The index of all documents after two batches of changes: those in one language get new texts while those in two others are
    removed, then those in one of these are back again."""
    docs, path = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("key"), "text", F.coalesce("lang", F.lit("")).alias("lang")), staging_path(spark, "index-log")
    edited = F.when(F.col("lang") == "en", F.concat("text", F.lit(" second edition"))).otherwise(F.col("text"))
    changed = docs.where(F.col("lang").isin("en", "de", "fr")).select("key", edited.alias("text"), (F.col("lang") != "en").alias("removed"))
    for i, batch in enumerate((docs.select("key", "text", F.lit(False).alias("removed")), changed, docs.where("lang = 'fr'").select("key", "text", F.lit(False).alias("removed")))):
        index.apply_changes(batch.withColumn("seq", F.lit(i)), i, path)
    return index.term_table(spark, path, "bigint")
