"""Registered queries over highlight records, and their DuckDB SQL; terms of one text looked for in another.

Each place of a word in a document is an anchor, and each document is then edited: some get a line in front, in some the
word is another, some lose their beginning."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import alignment, highlights, matching, variables
from corpusloom.plans.answers import TITLES, _titles
from corpusloom.plans.catalog import GLOSSARY, _pairs, query, r6, spans_sql
from corpusloom.session import spread, table

ANCHORS = f"""a AS (SELECT s.doc_id, i AS nth, text[a + 1:e] AS exact, text[greatest(0, a - 48) + 1:a] AS prefix, text[e + 1:e + 48] AS suffix FROM ({spans_sql('license')}) s JOIN documents USING (doc_id)),
b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Edited copy.' || chr(10) || text WHEN 1 THEN replace(text, 'license', 'permit') ELSE text[200:] END AS body FROM documents WHERE text IS NOT NULL),
m AS (SELECT a.*, body FROM a JOIN b USING (doc_id) WHERE body <> ''),
p AS (SELECT doc_id, nth, exact, prefix, suffix, body, unnest(string_split(body, exact)) AS piece, generate_subscripts(string_split(body, exact), 1) AS i, len(string_split(body, exact)) AS n FROM m WHERE contains(body, exact)),
q AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY doc_id, nth ORDER BY i) + (i - 1) * length(exact))::BIGINT AS s FROM p QUALIFY i < n),
sc AS (SELECT *, len(list_filter(range(1, 49), lambda k: k <= least(s, length(prefix)) AND body[s - k + 1:s] = prefix[length(prefix) - k + 1:])) + len(list_filter(range(1, 49), lambda k: k <= length(suffix) AND s + length(exact) + k <= length(body) AND body[s + length(exact) + 1:s + length(exact) + k] = suffix[1:k])) AS score FROM q),
direct AS (SELECT doc_id, nth, s, s + length(exact) AS e FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, nth ORDER BY score DESC, s) = 1),
g AS (SELECT *, list_filter([length(prefix), 32, 24, 16, 12, 8], lambda k: k > 0 AND k <= length(prefix) AND contains(body, right(prefix, k)))[1] AS hk, list_filter([length(suffix), 32, 24, 16, 12, 8], lambda k: k > 0 AND k <= length(suffix) AND contains(body, left(suffix, k)))[1] AS tk FROM m WHERE NOT contains(body, exact)),
gg AS (SELECT doc_id, nth, right(prefix, hk) AS head, left(suffix, tk) AS tail, string_split(body, right(prefix, hk)) AS hp, string_split(body, left(suffix, tk)) AS tp FROM g WHERE hk IS NOT NULL AND tk IS NOT NULL),
h AS (SELECT doc_id, nth, unnest(hp) AS piece, generate_subscripts(hp, 1) AS i, len(hp) AS n, length(head) AS w FROM gg), t AS (SELECT doc_id, nth, unnest(tp) AS piece, generate_subscripts(tp, 1) AS i, len(tp) AS n, length(tail) AS w FROM gg),
hs AS (SELECT doc_id, nth, (sum(length(piece)) OVER (PARTITION BY doc_id, nth ORDER BY i) + i * w)::BIGINT AS s FROM h QUALIFY i < n), ts AS (SELECT doc_id, nth, (sum(length(piece)) OVER (PARTITION BY doc_id, nth ORDER BY i) + (i - 1) * w)::BIGINT AS e FROM t QUALIFY i < n),
inf AS (SELECT doc_id, nth, s, e FROM hs JOIN ts USING (doc_id, nth) WHERE e >= s QUALIFY row_number() OVER (PARTITION BY doc_id, nth ORDER BY e - s, s) = 1),
f AS (SELECT *, false AS inferred FROM direct UNION ALL SELECT *, true FROM inf)"""
TERMS = ", ".join(f"('{t}')" for t in GLOSSARY)
PLACES = rf"""w AS (SELECT doc_id, string_split(regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS w FROM (SELECT doc_id, body AS text FROM b)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w), y AS (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM x)"""


def _records(spark, sf_dir):
    """The anchors of the documents, and the documents edited."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    spans = matching.term_spans(docs, ["license"]).select(F.col("key").alias("doc_id"), "nth", "span_start", "span_end").join(docs, "doc_id")
    made = matching.anchors(spans, highlights.CONTEXT)
    anchors = made.select(F.concat_ws(":", "doc_id", "nth").alias("record_id"), F.col("doc_id").alias("key"), "exact", "prefix", "suffix")
    turn = F.col("doc_id") % 3
    body = F.when(turn == 0, F.concat(F.lit("Edited copy.\n"), "text")).when(turn == 1, F.replace("text", F.lit("license"), F.lit("permit"))).otherwise(F.expr("substring(text, 200)"))
    return anchors, docs.where("text is not null").select(F.col("doc_id").alias("key"), body.alias("text"))


@query(f"WITH {ANCHORS} SELECT doc_id || ':' || nth AS record_id, doc_id, s AS found_start, e AS found_end, inferred FROM f")
def anchor_refound(spark, sf_dir):
    return highlights.found_anchors(*_records(spark, sf_dir)).withColumnRenamed("key", "doc_id")


@query(f"""WITH {ANCHORS}, {PLACES} SELECT doc_id || ':' || nth AS record_id, 'mark' AS kind, doc_id, s AS found_start, e AS found_end FROM f WHERE e > s
UNION ALL SELECT word, 'glossary', doc_id, e - length(word), e FROM y WHERE word IN (SELECT * FROM (VALUES {TERMS}))""")
def resolve_matches(spark, sf_dir):
    """The anchors, and a glossary's terms in all documents."""
    anchors, texts = _records(spark, sf_dir)
    marks = anchors.select("*", F.lit("mark").alias("kind"), F.lit("anchor").alias("mode"), F.lit(True).alias("case_sensitive"), F.lit(False).alias("whole_word"))
    terms = spark.createDataFrame([(t,) for t in GLOSSARY], "record_id string")
    terms = terms.select("record_id", F.lit(None).cast("long").alias("key"), F.col("record_id").alias("exact"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.lit("glossary").alias("kind"), F.lit("term_all").alias("mode"), F.lit(False).alias("case_sensitive"), F.lit(True).alias("whole_word"))
    return highlights.resolve_matches(marks.unionByName(terms), texts).withColumnRenamed("key", "doc_id")


@query(f"""WITH {ANCHORS}, z AS (SELECT a.doc_id, a.nth, a.exact, a.prefix, a.suffix, f.s, f.e, b.body FROM a LEFT JOIN f USING (doc_id, nth) LEFT JOIN b ON b.doc_id = a.doc_id),
n AS (SELECT doc_id, nth, s IS NOT NULL AS there, CASE WHEN s IS NULL THEN exact ELSE body[s + 1:e] END AS exact, CASE WHEN s IS NULL THEN prefix ELSE body[greatest(0, s - 48) + 1:s] END AS prefix, CASE WHEN s IS NULL THEN suffix ELSE body[e + 1:e + 48] END AS suffix, exact AS x, prefix AS y, suffix AS z FROM z)
SELECT doc_id || ':' || nth AS record_id, doc_id, md5(exact) AS exact, md5(prefix) AS prefix, md5(suffix) AS suffix, there AND (exact <> x OR prefix <> y OR suffix <> z) AS changed FROM n WHERE NOT there OR regexp_matches(exact, '\\S')""".replace("\\\\S", "\\S"))
def anchor_sync(spark, sf_dir):
    out = highlights.synced_anchors(*_records(spark, sf_dir))
    return out.select("record_id", F.col("key").alias("doc_id"), *(F.md5(c).alias(c) for c in ("exact", "prefix", "suffix")), "changed")


def _term_lists(spark, sf_dir):
    """Runs of up to three words of each turn, and of its answer, side by side."""
    cut = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+(?: [\p{L}\p{N}]+){0,2}"), 0))
    return _pairs(spark, sf_dir).select("case_id", cut("expected").alias("expected"), cut("actual").alias("generated"))


def _terms(spark, sf_dir):
    """The same runs, one after another."""
    lists = _term_lists(spark, sf_dir)
    return tuple(lists.select("case_id", F.posexplode(c).alias(at, "term")) for c, at in (("expected", "i"), ("generated", "j")))


@query()
def glossary_metrics(spark, sf_dir):
    """How many of a turn's terms its answer has, or has one that is like them."""
    out = alignment.listed_term_metrics(_term_lists(spark, sf_dir), "case_id")
    return out.select("case_id", "expected", "generated", "found", r6("recall"), r6("precision"), r6("f1"), "hit_all")


VARIABLES = [("License Name", "permit {{ und }}"), ("und", "and ${the}"), ("THE", "our")]


@query("""WITH t AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'license', '${license-name}'), ' the ', ' ${the} '), ' und ', ' {{ und }} ') || '${nobody}{{  }}' AS t FROM documents),
a AS (SELECT *, replace(replace(t, '${license-name}', 'permit {{ und }}'), '${the}', 'our') AS b FROM t)
SELECT doc_id, md5(replace(b, '{{ und }}', 'and ${the}')) AS digest,
  array_to_string(list_transform(list_sort(list_filter([(strpos(t, '${license-name}'), 'license-name'), (strpos(t, '${the}'), 'the')], lambda x: x[1] > 0)), lambda x: x[2]), ',') || CASE WHEN NOT contains(b, '{{ und }}') THEN '' WHEN contains(t, '${license-name}') OR contains(t, '${the}') THEN ',und' ELSE 'und' END AS used, 'nobody' AS missing FROM a""")
def variable_substitution(spark, sf_dir):
    """Documents with placeholders for some words, filled in."""
    text = F.coalesce("text", F.lit(""))
    for word, holder in (("license", "${license-name}"), (" the ", " ${the} "), (" und ", " {{ und }} ")):
        text = F.replace(text, F.lit(word), F.lit(holder))
    texts = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("key"), F.concat(text, F.lit("${nobody}{{  }}")).alias("text"))
    known = spark.createDataFrame([(i, *v) for i, v in enumerate(VARIABLES)], "place int, name string, value string")
    out = variables.substituted(texts, known)
    return out.select(F.col("key").alias("doc_id"), F.md5("text").alias("digest"), F.array_join("used", ",").alias("used"), F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {TITLES}, e AS (SELECT page_id, unnest([trim(a), trim(b), trim(c)]) AS exact, generate_subscripts([a, b, c], 1) AS nth FROM t)
SELECT exact, 'page ' || page_id AS definition, 'glossary' AS kind FROM e WHERE length(exact) >= 2 QUALIFY row_number() OVER (PARTITION BY lower(exact) ORDER BY page_id, nth) = 1""")
def glossary_records(spark, sf_dir):
    """A glossary of all pages' titles, their headings as aliases."""
    entries = _titles(spark, sf_dir).select(F.col("page_id").alias("place"), F.col("a").alias("term"), F.array("b", "c").alias("aliases"), F.concat(F.lit("page "), "page_id").alias("definition"))
    return highlights.glossary_records(entries).select("exact", "definition", "kind")


TABS = r"""SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS tabs, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS exact FROM pages"""


def _tabs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1).alias("tabs"), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("exact"))


@query(rf"""WITH p AS ({TABS}), l AS (SELECT page_id, tabs, trim(regexp_replace(exact, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g')) AS line FROM p)
SELECT page_id, len(tabs)::BIGINT AS tabs, CASE WHEN length(line) > 40 THEN left(line, 37) || '...' ELSE line END AS exact_preview FROM l WHERE page_id % 7 <> 0""")
def jump_targets(spark, sf_dir):
    """Each page's first paragraph as an anchor, its links as tabs; every seventh page's record is a glossary's, which is no target."""
    kind = F.when(F.col("page_id") % 7 == 0, "glossary").otherwise("mark").alias("kind")
    out = highlights.jump_targets(_tabs(spark, sf_dir).select(F.col("page_id").alias("record_id"), kind, "tabs", "exact"))
    return out.select(F.col("record_id").alias("page_id"), F.size("tabs").cast("long").alias("tabs"), "exact_preview")


@query(rf"""WITH p AS ({TABS}), d AS (SELECT page_id, tabs, list_transform(tabs, lambda t: CASE WHEN t = '/de' THEN '/the' ELSE t END) AS moved FROM p)
SELECT page_id, array_to_string(CASE WHEN list_contains(tabs, '/de') THEN list_filter(moved, lambda t, i: list_position(moved, t) = i) ELSE tabs END, ' ') AS tabs FROM d""")
def rename_tab(spark, sf_dir):
    """One link of the pages takes the name of another."""
    return _tabs(spark, sf_dir).select("page_id", F.array_join(highlights.renamed_tabs(F.col("tabs"), "/de", "/the"), " ").alias("tabs"))
