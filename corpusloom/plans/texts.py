"""Registered queries over text normalisers, segmenters, anchors and paragraph rules, and their DuckDB SQL.

Lists are compared by their size and a digest of their elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import segments, text
from corpusloom.operators import matching
from corpusloom.plans.catalog import PAIRS, _docs, _pairs, query, spans_sql
from corpusloom.session import table

# the SQL of what the functions share
def sql_of(pattern: str, x: str) -> str:
    """A SQL pattern with its argument in place of each @."""
    return pattern.replace("@", x)


WS = r"[\s\x0B\x{85}\p{Z}]"
COLLAPSED = r"trim(regexp_replace(@, '" + WS + r"+', ' ', 'g'), ' ')"
PLAIN = sql_of(COLLAPSED, r"regexp_replace(replace(lower(@), chr(173), ''), '[^\p{L}\p{N}_\p{Mn}\s]', ' ', 'g')")
LINES = "list_transform(regexp_split_to_array(regexp_replace(@, '(?i)<\\s*/?\\s*br\\s*/?\\s*>', E'\\n', 'g'), '[\\n\\r]'), lambda x: " + sql_of(COLLAPSED, "x") + ")"
BULLET = r"^(?:[-*•]+|\d+[.)])\s+\S"
MARKED = r"CASE WHEN x = '' OR x[1] = '#' OR x[1] = '|' THEN chr(1) WHEN regexp_matches(x, '" + BULLET + r"') THEN chr(1) || regexp_replace(x, '^(?:[-*•]+|\d+[.)])\s+', '') || chr(1) ELSE x || ' ' END"
BLOCKS = "list_filter(list_transform(string_split(array_to_string(list_transform(" + LINES + ", lambda x: " + MARKED + "), ''), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
CUT = r"string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2))"
SENTENCES = "list_filter(list_transform(flatten(list_transform(" + BLOCKS + ", lambda x: " + CUT + ")), lambda x: trim(x, E' \\t-')), lambda x: x <> '')"


def _listed(sql: str) -> str:
    return f"SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, {sql_of(sql, 'text')} AS l FROM documents WHERE text IS NOT NULL)"


def _list(spark, sf_dir, make):
    l = _docs(spark, sf_dir).where("text is not null").select("doc_id", make(F.col("text")).alias("l"))
    return l.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.encode(F.array_join("l", "|"), "UTF-8")).alias("digest"))


@query(_listed(SENTENCES))
def sentence_split(spark, sf_dir):
    return _list(spark, sf_dir, segments.sentences)


@query(_listed("list_filter(list_transform(list_filter(" + LINES + r", lambda x: x <> '' AND x[1] <> '#' AND NOT (x[1] = '|' AND x[-1] = '|') AND (regexp_matches(x, '" + BULLET + r"') OR regexp_matches(x, '[.!?…]$'))), lambda x: trim(regexp_replace(x, '^(?:[-*•]+|\d+[.)])\s*', ''), ' ')), lambda x: length(x) >= 2)"))
def line_facts(spark, sf_dir):
    return _list(spark, sf_dir, segments.line_facts)


# DuckDB's list_distinct keeps no order: places of first occurrence do
FIRST = "list_filter(@, lambda x, i: list_position(@, x) = i)"
CLAIMS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(@, '([.!?])\\s+', '\\1' || chr(2), 'g'), '\\x02|\\n+'), lambda x: " + sql_of(COLLAPSED, "x") + "), lambda x: length(x) >= 8)"


@query("SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, " + sql_of(FIRST, "c") + f" AS l FROM (SELECT doc_id, {sql_of(CLAIMS, 'text')} AS c FROM documents WHERE text IS NOT NULL))")
def claim_split(spark, sf_dir):
    return _list(spark, sf_dir, segments.claims)


@query(_listed("list_filter(list_transform(regexp_split_to_array(regexp_replace(@, '([.!?])\\s+', '\\1' || chr(2), 'g'), '\\x02|\\n{2,}'), lambda x: trim(x, E' \\t\\r\\n')), lambda x: x <> '')"))
def candidate_split(spark, sf_dir):
    return _list(spark, sf_dir, segments.candidates)


@query("SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, " + sql_of(FIRST, "c") + " AS l FROM (SELECT doc_id, list_filter(" + sql_of(SENTENCES, "text") + ", lambda x: length(x) >= 12) AS c FROM documents WHERE text IS NOT NULL))")
def nli_units(spark, sf_dir):
    return _list(spark, sf_dir, segments.units)


@query(r"""WITH a AS (SELECT doc_id, len(list_filter(""" + sql_of(SENTENCES, "text") + r""", lambda x: length(x) >= 12)) + len(regexp_extract_all(text, '(?m)^\s*(?:[-*•]+|\d+[.)])\s+\S+')) AS base, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM documents),
b AS (SELECT doc_id, CASE WHEN base > 0 THEN base WHEN words > 0 THEN greatest(24, words // 6) END AS base FROM a)
SELECT doc_id, CASE WHEN base IS NULL THEN 24 ELSE greatest(24, least(180, floor(base * 1.15::DOUBLE) + 4)) END::BIGINT AS n FROM b""")
def fact_limit(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", segments.fact_limit(F.col("text")).alias("n"))


@query(f"""WITH {PAIRS}, w AS (SELECT case_id, {sql_of(COLLAPSED, 'lower(x)')} AS f, {sql_of(COLLAPSED, 'lower(y)')} AS t, list_filter(string_split({sql_of(PLAIN, 'x')}, ' '), lambda w: length(w) >= 4) AS own, list_filter(string_split({sql_of(PLAIN, 'y')}, ' '), lambda w: length(w) >= 4) AS theirs FROM p),
m AS (SELECT case_id, contains(t, f) AS held, length(f) > 0 AND length(t) > 0 AS filled, len(own) AS n, len(list_filter(own, lambda w: list_contains(theirs, w))) AS met FROM w)
SELECT case_id, coalesce(filled AND (held OR CASE WHEN n < 2 THEN false WHEN n <= 4 THEN met >= 2 AND met / n >= 0.60 ELSE (met >= 3 AND met / n >= 0.52) OR (met >= 5 AND met / n >= 0.42) END), false) AS belongs FROM m""")
def fact_belongs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("case_id", segments.belongs(F.col("expected"), F.col("actual")).alias("belongs"))


def _changed(sql: str) -> str:
    return f"SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT doc_id, {sql} AS t FROM documents WHERE text IS NOT NULL)"


def _change(spark, sf_dir, make):
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", make(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query(_changed(sql_of(PLAIN, "text")))
def plain_normalise(spark, sf_dir):
    return _change(spark, sf_dir, text.plain_normal)


@query(_changed(r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', E'\n', 'g'), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t')"""))
def context_normalise(spark, sf_dir):
    return _change(spark, sf_dir, text.context_normal)


@query(_changed(sql_of(COLLAPSED, r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(text, '(?i)<\s*/?\s*br\s*/?\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), ' '), '^`+|`+$', '', 'g'), ' "''„“‚‘’”«»')""")))
def clean_cell(spark, sf_dir):
    return _change(spark, sf_dir, text.clean_cell)


@query(_changed(r"""regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', E'\n', 'g'), '[ \t]+\n', E'\n', 'g'), '[ \t]+$', '')"""))
def trailing_blanks(spark, sf_dir):
    return _change(spark, sf_dir, text.trailing_blanks_off)


@query(_changed("translate(text, '#*%&$', '')"))
def forbidden_characters(spark, sf_dir):
    return _change(spark, sf_dir, lambda c: text.without_characters(c, "#*%&$"))


@query("SELECT conv_id, turn, length(x)::BIGINT AS n, md5(x) AS digest FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN trim(text, ' ') ELSE trim(substring(text, 11), ' ') END AS x FROM conversations)")
def think_strip(spark, sf_dir):
    """Answers with their question as a thought before them, and questions whose first ten characters are one."""
    c = table(spark, sf_dir, "conversations")
    told = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"), F.col("text"))).otherwise(F.concat(F.substring("text", 1, 10), F.lit("</think>"), F.expr("substring(text, 11)")))
    x = text.without_thoughts(told)
    return c.select("conv_id", "turn", F.length(x).cast("long").alias("n"), F.md5(F.encode(x, "UTF-8")).alias("digest"))


@query("SELECT page_id, lower(regexp_extract(url, '[^/]*$')) AS name FROM pages")
def canonical_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_name(F.col("url")).alias("name"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')")
def rebuild_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("text").rlike(r"\S")).select("doc_id")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM documents)
SELECT token, round(ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM w GROUP BY token""")
def whitespace_idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    seen = docs.select(F.explode(F.array_distinct(segments.filled(F.split(F.lower("text"), r"\s+")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    one = docs.agg(F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(one)).select("token", F.round(F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))  # one row of statistics


@query(f"SELECT doc_id, term, i AS nth, a AS span_start, e AS span_end FROM (SELECT 'license' AS term, * FROM ({spans_sql('license')}) UNION ALL SELECT 'version', * FROM ({spans_sql('version')}))")
def term_spans(spark, sf_dir):
    return matching.term_spans(_docs(spark, sf_dir), ["license", "version"]).select(F.col("key").alias("doc_id"), "term", "nth", "span_start", "span_end")


@query(f"""WITH s AS (SELECT * FROM ({spans_sql('license')})) SELECT doc_id, i AS nth, substring(text, a + 1, e - a) AS exact, substring(text, greatest(0, a - 24) + 1, a - greatest(0, a - 24)) AS prefix, substring(text, e + 1, 24) AS suffix FROM s JOIN documents USING (doc_id)""")
def build_anchor(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = matching.term_spans(docs, ["license"])
    return matching.anchors(found.select(F.col("key").alias("doc_id"), "nth", "span_start", "span_end").join(docs.select("doc_id", "text"), "doc_id"), 24).select("doc_id", "nth", "exact", "prefix", "suffix")


@query(r"""WITH s AS (SELECT doc_id, a, text AS t, length(text) AS n FROM (""" + spans_sql("license") + r""") JOIN documents USING (doc_id) WHERE i = 1), b AS (SELECT *, greatest(0, a - 200) AS s0, least(n, a + 200) AS e0 FROM s),
c AS (SELECT *, CASE WHEN s0 = 0 THEN least(n, 400) ELSE e0 END AS e1 FROM b), d AS (SELECT *, CASE WHEN e1 = n THEN greatest(0, n - 400) ELSE s0 END AS s1 FROM c)
SELECT doc_id, md5((CASE WHEN s1 > 0 THEN '…' ELSE '' END) || trim(regexp_replace(substring(t, s1 + 1, e1 - s1), '\n{3,}', E'\n\n', 'g'), E' \t\n\r') || (CASE WHEN e1 < n THEN '…' ELSE '' END)) AS digest FROM d""")
def excerpt_at(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    first = matching.term_spans(docs, ["license"]).where("nth = 1").select(F.col("key").alias("doc_id"), "span_start")
    return first.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.md5(F.encode(matching.excerpt_at(F.col("text"), F.col("span_start").cast("int")), "UTF-8")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, trim(x, E' \\t\\r\\n') AS part, i FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n+')) AS x, generate_subscripts(regexp_split_to_array(text, '\\n+'), 1) AS i FROM documents) WHERE trim(x, E' \\t\\r\\n') <> ''),
k AS (SELECT *, lag(lower(""" + sql_of(COLLAPSED, "part") + ")) OVER (PARTITION BY doc_id ORDER BY i) AS before, lower(" + sql_of(COLLAPSED, "part") + ") AS now FROM p)\nSELECT doc_id, count(*) AS n, md5(string_agg(part, E'\\n' ORDER BY i)) AS digest FROM k WHERE before IS NULL OR before <> now GROUP BY doc_id")
def adjacent_dedupe(spark, sf_dir):
    parts = _docs(spark, sf_dir).select("doc_id", matching.without_repeats(F.col("text"), r"\n+").alias("l")).where(F.size("l") > 0)
    return parts.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.encode(F.array_join("l", "\n"), "UTF-8")).alias("digest"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-3]>(.*?)</h[1-3]>', 1)) AS title, unnest(regexp_extract_all(html, '<h([1-3])>.*?</h[1-3]>', 1)) AS level, generate_subscripts(regexp_extract_all(html, '<h([1-3])>.*?</h[1-3]>', 1), 1) AS i FROM pages)
SELECT page_id, count(*) AS n, md5(string_agg(repeat('  ', level::INT - 1) || trim(title, ' '), E'\n' ORDER BY i)) AS digest FROM h WHERE i <= 8 GROUP BY page_id""")
def page_toc(spark, sf_dir):
    """The first eight headings of each page, indented by level."""
    found = table(spark, sf_dir, "pages").select("page_id", F.slice(F.regexp_extract_all("html", F.lit(r"<h[1-3]>.*?</h[1-3]>"), 0), 1, 8).alias("h")).where(F.size("h") > 0)
    line = F.transform("h", lambda x: F.concat(F.repeat(F.lit("  "), F.substring(x, 3, 1).cast("int") - 1), F.trim(F.regexp_extract(x, r"<h[1-3]>(.*?)</h", 1))))
    return found.select("page_id", F.size("h").cast("long").alias("n"), F.md5(F.encode(F.array_join(line, "\n"), "UTF-8")).alias("digest"))
