"""Registered queries over labels, answers, excerpts, alignments and selections, and their DuckDB SQL.

Model answers have no table here: they are made of the events' properties and of conversation turns, each row in one of the
shapes that answers come in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import answers, labels, segments, text
from corpusloom.operators import alignment, chunking, excerpts, highlights
from corpusloom.operators.matching import anchors, term_spans
from corpusloom.plans.catalog import BASE, PAIRS, STEM, _bm25, _docs, _pairs, query, r6, spans_sql
from corpusloom.plans.texts import CLAIMS, COLLAPSED, sql_of
from corpusloom.session import table

FOLD = "strip_accents(replace(lower(@), 'ß', 'ss'))"
STOP = "[" + ", ".join(f"'{w}'" for w in labels.STOP_WORDS) + "]"
META = ", ".join(f"'{w}'" for w in labels.META_LABELS)


def _words(x: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all({sql_of(FOLD, x)}, '{labels.WORD}'), lambda w: length(w) >= {least} AND NOT list_contains({STOP}, w))"


def _clean(x: str, least: int = 3, longest: int = 80) -> str:
    bare = f"replace(replace({x}, '\\n', ' '), '\\t', ' ')"
    for ends in ("E' \\t\\r\\n'", "'` '", "'\"'''", "E' \\t\\r\\n'"):
        bare = f"trim({bare}, {ends})"
    bare = f"trim(regexp_replace({bare}, '[,;:]+$', ''), E' \\t\\r\\n')"
    bare = sql_of(COLLAPSED, rf"regexp_replace(regexp_replace({bare}, '^#{{1,6}}\s+', ''), '^(?:[-*+]\s+|\d+[.)]\s+)', '')")
    return f"list_transform([{bare}], lambda c: CASE WHEN {sql_of(FOLD, 'c')} NOT IN ({META}) AND len({_words('c', least)}) > 0 THEN trim(substring(c, 1, {longest}), ' ') ELSE '' END)[1]"


def _stems(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({sql_of(FOLD, x)}, '[a-z0-9]+'), lambda w: {STEM}), lambda z: length(z) >= 3)))"


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", (F.col("i") + 1).cast("long"))


@query(f"WITH {LINES} SELECT doc_id, i, {_clean('line')} AS label FROM l")
def clean_label(spark, sf_dir):
    """Every line of every document as a label."""
    return _lines(spark, sf_dir).select("doc_id", "i", labels.clean(F.col("line")).alias("label"))


@query(f"SELECT doc_id, len({_words('text')})::BIGINT AS n, md5(array_to_string({_words('text')}, ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def word_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", labels.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.encode(F.array_join("w", " "), "UTF-8")).alias("digest"))


TITLES = r"t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS a, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS b, regexp_extract(html, '<h2>(.*?)</h2>', 1) AS c FROM pages)"


def _titles(spark, sf_dir):
    part = lambda tag: F.regexp_extract("html", f"<{tag}>(.*?)</{tag}>", 1)
    return table(spark, sf_dir, "pages").select("page_id", part("title").alias("a"), part("h1").alias("b"), part("h2").alias("c"))


@query(f"""WITH {TITLES}, k AS (SELECT page_id, {_clean('a', 1, 200)} AS x, {_clean('b', 1, 200)} AS y, {_clean('c', 1, 200)} AS z FROM t)
SELECT page_id, x <> '' AND y <> '' AND (lower(x) = lower(y) OR {_stems('x')} = {_stems('y')}) AS heading, x <> '' AND z <> '' AND (lower(x) = lower(z) OR {_stems('x')} = {_stems('z')}) AS second FROM k""")
def labels_equivalent(spark, sf_dir):
    """Whether a page's title says the same as its first and its second heading."""
    return _titles(spark, sf_dir).select("page_id", labels.same(F.col("a"), F.col("b")).alias("heading"), labels.same(F.col("a"), F.col("c")).alias("second"))


@query(f"""WITH {TITLES}, k AS (SELECT *, {_stems('a')} AS x, {_stems('b')} AS y FROM t)
SELECT page_id, CASE WHEN trim(a) = '' OR (trim(b) <> '' AND (len(y) > len(x) OR (len(y) = len(x) AND length(trim(b)) > length(trim(a))))) THEN trim(b) ELSE trim(a) END AS label FROM k""")
def prefer_label(spark, sf_dir):
    return _titles(spark, sf_dir).select("page_id", labels.preferred(F.col("a"), F.col("b")).alias("label"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l), k AS (SELECT *, {_clean('line', 2, 120)} AS x FROM m)
SELECT doc_id, i, coalesce(x <> '' AND trim(before) <> '' AND ((length(x) >= 8 AND contains({sql_of(COLLAPSED, 'lower(before)')}, lower(x))) OR list_has_any({_words('x')}, {_words('before')})), false) AS grounded FROM k""")
def label_grounded(spark, sf_dir):
    """Whether each line, as a label, is borne out by the line before it."""
    cut = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", "l", F.posexplode("l").alias("i", "line"))
    cut = cut.withColumn("before", F.when(F.col("i") > 0, F.get("l", F.col("i") - 1)))
    # lists of one are steps of their own: else the label is cleaned again wherever it is used
    cut = cut.select("doc_id", "i", "before", F.explode_outer(F.array(labels.bare(F.col("line")))).alias("x"))
    cut = cut.select("doc_id", "i", "before", F.explode_outer(F.array(labels.named(F.col("x"), 2, 120))).alias("x"))
    return cut.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), labels.holds(F.col("before"), F.col("x")).alias("grounded"))


@query(f"WITH {LINES}, k AS (SELECT *, lower(trim(line)) AS x FROM l) SELECT doc_id, i, x = '' OR len({_words('x')}) = 0 OR " + " OR ".join(f"contains(x, '{t}')" for t in labels.META_TRACES) + " AS meta FROM k")
def meta_like_label(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "i", labels.names_form(F.col("line")).alias("meta"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN (props->>'$.k')::BIGINT END AS k FROM events")
def json_recover(spark, sf_dir):
    """The properties of events, from answers that are JSON, fenced, amid prose, a list of one, or cut off."""
    e, p, n = table(spark, sf_dir, "events"), F.col("props"), F.col("event_id") % 5
    said = F.when(n == 0, p).when(n == 1, F.concat(F.lit("So:\n```json\n"), p, F.lit("\n```\ndone"))).when(n == 2, F.concat(F.lit("The answer is "), p, F.lit(". That's all.")))
    said = said.when(n == 3, F.concat(F.lit("List: ["), p, F.lit("] &amp; end"))).otherwise(F.concat(F.lit("It is "), F.expr("substring(props, 1, length(props) - 1)")))
    value = answers.json_payload(said)
    return e.select("event_id", F.coalesce(F.try_variant_get(value, "$.k", "long"), F.try_variant_get(value, "$[0].k", "long")).alias("k"))


@query(f"WITH c AS (SELECT doc_id, {sql_of(CLAIMS, 'text')} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS digest FROM c")
def fact_strings(spark, sf_dir):
    """The sentences of a document as an answer lists them: as strings in even documents, as objects in odd ones, under a
    key in every third."""
    each = F.filter(F.transform(F.split("text", segments.AFTER_END + r"|\n+"), text.collapsed), lambda x: F.length(x) >= 8)
    plain, named = F.to_json(F.col("l")), F.to_json(F.transform("l", lambda x: F.struct(x.alias("claim"), F.lit(1).alias("n"))))
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", each.alias("l"))
    said = F.when(F.col("doc_id") % 2 == 0, plain).otherwise(named)
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"facts": '), said, F.lit("}"))).otherwise(said)
    f = d.select("doc_id", answers.facts(F.try_parse_json(said)).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n"), F.md5(F.encode(F.array_join("f", "|"), "UTF-8")).alias("digest"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B' WHEN 3 THEN 'A' ELSE '' END AS winner,
CASE WHEN event_id % 5 = 0 THEN (props->>'$.k')::DOUBLE / CASE WHEN (props->>'$.k')::DOUBLE > 1 THEN 100 ELSE 1 END END AS confidence,
CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'regex' WHEN 3 THEN 'regex' ELSE 'unparsed' END AS mode FROM events""")
def judge_parse(spark, sf_dir):
    """Judges' answers of five shapes, the events' properties as confidence."""
    e, n, k = table(spark, sf_dir, "events"), F.col("event_id") % 5, F.get_json_object("props", "$.k")
    said = F.when(n == 0, F.concat(F.lit('I think {"winner": "answer_a", "confidence": '), k, F.lit("}"))).when(n == 1, F.concat(F.lit('{"pick": "Right", "why": "'), "event_type", F.lit('"}')))
    said = said.when(n == 2, F.lit("Winner: b, since it is short")).when(n == 3, F.lit(" a ")).otherwise(F.concat(F.lit("Both are "), "event_type"))
    return e.select("event_id", answers.judged(said).alias("j")).select("event_id", "j.winner", "j.confidence", "j.mode")


FRAGMENT = r"""x = '' OR regexp_matches(x, '^[-–—_=~*#.`:;/\\|+\s]+$') OR regexp_matches(lower(x), '^(?:col|column|item)\s*\d+$') OR lower(x) IN ('beispiele:', 'example:', 'happy writing.', 'view.', 'context.')
OR (n <= 1 AND length(x) <= 24) OR (n < 2 AND length(x) < 10) OR ends_with(x, ':')"""
CELL = sql_of(COLLAPSED, r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(line, '(?i)<\s*/?\s*br\s*/?\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), ' '), '^`+|`+$', '', 'g'), ' "''„“‚‘’”«»')""")


@query(f"WITH {LINES}, k AS (SELECT doc_id, i, {CELL} AS x FROM l), m AS (SELECT *, len(regexp_extract_all(x, '\\p{{L}}{{2,}}')) AS n FROM k) SELECT doc_id, i, {FRAGMENT} AS fragment FROM m")
def fact_fragment(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "i", answers.fragment(F.col("line")).alias("fragment"))


@query(f"""WITH {LINES}, a AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(trim(line, E' \\t\\r\\n'), '(?i)^\\s*regex\\s*:\\s*', ''), '^\\s*(?:[-*•]+|\\d+[.)])\\s*', ''), ' ') AS x FROM l),
b AS (SELECT doc_id, i, CASE WHEN length(x) >= 2 AND x[1] = x[-1] AND x[1] IN ('"', '''', '`') THEN trim(substring(x, 2, length(x) - 2), ' ') ELSE x END AS x FROM a)
SELECT doc_id, min(i)::BIGINT AS i, lower(x) AS folded FROM b WHERE x <> '' AND length(x) <= 240 GROUP BY doc_id, lower(x)""")
def pattern_normalise(spark, sf_dir):
    """The distinct patterns that a document's lines are, each at its first place."""
    p = _lines(spark, sf_dir).select("doc_id", "i", F.lower(answers.pattern_normal(F.col("line"))).alias("folded")).where("folded is not null")
    return p.groupBy("doc_id", "folded").agg(F.min("i").alias("i")).select("doc_id", "i", "folded")


def _md5(c):
    return F.md5(F.encode(c, "UTF-8"))


CHUNKS = """c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 800 THEN range(0, length(text) - 100, 700) WHEN length(text) > 0 THEN [0] ELSE [] END) AS s FROM documents),
p AS (SELECT doc_id, text, s // 700 AS chunk_idx, substring(text, s + 1, 800) AS chunk FROM c), k AS (SELECT *, strpos(text, chunk) - 1 AS a, strpos(text, chunk) - 1 + length(chunk) AS e FROM p)"""


def _placed(spark, sf_dir):
    d = _docs(spark, sf_dir)
    c = chunking.fixed_size(d, 800, 100, tail=True).select("doc_id", "chunk_idx", "chunk").join(d.select("doc_id", "text"), "doc_id")
    return c.withColumns({"a": excerpts.chunk_start(F.col("text"), F.col("chunk")), "e": excerpts.chunk_end(F.col("text"), F.col("chunk"))})


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, a::BIGINT AS span_start, e::BIGINT AS span_end FROM k")
def chunk_span(spark, sf_dir):
    """Each chunk back at its first place in its document."""
    return _placed(spark, sf_dir).select("doc_id", "chunk_idx", F.col("a").cast("long").alias("span_start"), F.col("e").cast("long").alias("span_end"))


TIDY = r"trim(regexp_replace(@, '\n{3,}', E'\n\n', 'g'), E' \t\r\n')"


@query(f"""WITH {CHUNKS}, m AS (SELECT *, a - length(list_last(string_split(substring(text, 1, a), E'\\n\\n'))) AS first, e + length(string_split(substring(text, e + 1), E'\\n\\n')[1]) AS last FROM k)
SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, md5({sql_of(TIDY, 'substring(text, first + 1, last - first)')}) AS digest FROM m""")
def paragraph_excerpt(spark, sf_dir):
    x = excerpts.paragraphs_round(F.col("text"), F.col("a"), F.col("e"))
    return _placed(spark, sf_dir).select("doc_id", "chunk_idx", _md5(x).alias("digest"))


@query(f"""WITH {CHUNKS}, m AS (SELECT *, greatest(0, a - 300) AS first, least(length(text), e + 500) AS last FROM k)
SELECT doc_id, chunk_idx::BIGINT AS chunk_idx, md5(CASE WHEN first > 0 THEN '…' ELSE '' END || {sql_of(TIDY, 'substring(text, first + 1, last - first)')} || CASE WHEN last < length(text) THEN '…' ELSE '' END) AS digest FROM m""")
def extended_excerpt(spark, sf_dir):
    return _placed(spark, sf_dir).select("doc_id", "chunk_idx", _md5(excerpts.span_extended(F.col("text"), F.col("a"), F.col("e"), 300, 500)).alias("digest"))


MERGED = """list_reduce(@, lambda x, y: CASE WHEN contains(x, y) THEN x WHEN contains(y, x) THEN y ELSE list_transform([list_filter(range(least(length(x), length(y), 500), 39, -1), lambda n: right(x, n) = left(y, n))[1]], lambda o: CASE WHEN o IS NULL THEN rtrim(x, ' ') || E'\\n\\n' || y ELSE x || substring(y, o + 1) END)[1] END)"""


@query(f"WITH {CHUNKS}, b AS (SELECT doc_id, list(trim(chunk, E' \\t\\r\\n') ORDER BY chunk_idx) FILTER (trim(chunk, E' \\t\\r\\n') <> '') AS l FROM p GROUP BY doc_id), m AS (SELECT doc_id, {sql_of(MERGED, 'l')} AS t FROM b WHERE len(l) > 0) SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM m")
def overlap_merge(spark, sf_dir):
    """A document's overlapping chunks as one text again."""
    c = chunking.fixed_size(_docs(spark, sf_dir), 800, 100, tail=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))).alias("l"))
    # the list of one is a step of its own: else the blocks are merged again for each use of the text
    m = c.select("doc_id", F.explode_outer(F.array(excerpts.merged_blocks(F.transform("l", lambda x: x["chunk"])))).alias("t")).where("t <> ''")
    return m.select("doc_id", F.length("t").cast("long").alias("n"), _md5(F.col("t")).alias("digest"))


def _alike(a: str, b: str) -> str:
    return f"coalesce(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substring({a}, i, 1) <> substring({b}, i, 1))[1] - 1, least(length({a}), length({b})))::BIGINT"


@query(f"WITH {PAIRS} SELECT case_id, {_alike('x', 'y')} AS prefix, {_alike('reverse(x)', 'reverse(y)')} AS suffix FROM p")
def shared_affixes(spark, sf_dir):
    x, y = F.col("expected"), F.col("actual")
    return _pairs(spark, sf_dir).select("case_id", excerpts.shared_start(x, y).cast("long").alias("prefix"), excerpts.shared_end(x, y).cast("long").alias("suffix"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?i)license'))::BIGINT AS anywhere, len(regexp_extract_all(text, '\bLicense\b'))::BIGINT AS as_word FROM documents")
def find_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", excerpts.count_found(F.col("text"), "license").cast("long").alias("anywhere"), excerpts.count_found(F.col("text"), "License", True, True).cast("long").alias("as_word"))


@query(r"SELECT page_id, array_to_string(regexp_extract_all(html, '\d+(?:[.,]\d+)?'), ' ') AS numbers FROM pages")
def numbers_signature(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"\d+(?:[.,]\d+)?"), 0), " ").alias("numbers"))


@query()
def fact_matching(spark, sf_dir):
    """The sentences of a turn against those of its answer."""
    p = _pairs(spark, sf_dir).select("case_id", segments.sentences(F.col("expected")).alias("expected"), segments.sentences(F.col("actual")).alias("observed"))
    return alignment.match_metrics(p, "case_id").select("case_id", "matched", "expected", "predicted", r6("precision"), r6("recall"), r6("f1"))


@query()
def line_comparison(spark, sf_dir):
    """A turn's lines against those of its answer."""
    p = _pairs(spark, sf_dir).select("case_id", alignment.compared_lines(F.col("expected"), F.col("actual")).alias("d"))
    return p.select("case_id", F.round("d.line_ratio", 6).alias("line_ratio"), "d.best_block", "d.inserted_lines", "d.deleted_lines", "d.replaced_lines")


@query(f"WITH {PAIRS}, a AS (SELECT case_id, list_distinct({sql_of(CLAIMS, 'x')}) AS f, list_distinct({sql_of(CLAIMS, 'y')}) AS g FROM p) SELECT case_id, len(list_filter(f, lambda x: NOT list_contains(list_transform(g, lambda z: lower(z)), lower(x))))::BIGINT AS missing FROM a")
def missing_claims(spark, sf_dir):
    """How many of a turn's claims its answer doesn't have."""
    held = F.transform(segments.claims(F.col("actual")), lambda x: F.lower(x))
    p = _pairs(spark, sf_dir).select("case_id", segments.claims(F.col("expected")).alias("f"), held.alias("g"))
    return p.select("case_id", F.size(F.filter("f", lambda x: ~F.array_contains("g", F.lower(x)))).cast("long").alias("missing"))


@query("""WITH e AS (SELECT event_id, event_type, ts FROM events WHERE event_type = 'click' AND contains(lower(concat_ws(' ', event_id, event_type, props)), '"k": 8')) SELECT event_id, ts FROM e""")
def case_filter(spark, sf_dir):
    """Events of one kind whose fields, as one string, hold what is looked for."""
    hay = F.lower(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props"))
    return table(spark, sf_dir, "events").where((F.col("event_type") == "click") & hay.contains('"k": 8')).select("event_id", "ts")


@query(f"""WITH {BASE}, h AS (SELECT qid, doc_id, score, rank FROM bmr WHERE rank <= 10), g AS (SELECT doc_id, length(text) % 4 AS grade FROM documents),
j AS (SELECT qid, doc_id, round(score, 6) AS score, [0.0, 0.4, 0.7, 1.0][grade + 1]::DOUBLE AS rerank_score FROM h JOIN g USING (doc_id) WHERE grade >= 2)
SELECT qid, doc_id, score, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, score DESC, doc_id) AS rank FROM j""")
def rerank_join(spark, sf_dir):
    """Ranked hits with the class that a reranker gave them (here: by length), those under the least score gone."""
    decided = _docs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.get(F.array(*map(F.lit, (0.0, 0.4, 0.7, 1.0))), F.length("text") % 4).alias("rerank_score")).where("rerank_score >= 0.45")
    kept = _bm25(spark, sf_dir, 10).select("qid", "key", r6("score")).join(decided, "key")
    best = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), F.desc("score"), "key")
    return kept.select("qid", F.col("key").alias("doc_id"), "score", "rerank_score", F.row_number().over(best).cast("long").alias("rank"))


@query(f"WITH {PAIRS} SELECT case_id, CASE WHEN case_id % 2 = 1 THEN md5(y) ELSE md5(x) END AS first, CASE WHEN case_id % 2 = 1 THEN md5(x) ELSE md5(y) END AS second, case_id % 2 = 1 AS swapped FROM p")
def swap_order(spark, sf_dir):
    """The two sides of a comparison, changed about in every other case."""
    odd, x, y = F.col("case_id") % 2 == 1, _md5(F.col("expected")), _md5(F.col("actual"))
    return _pairs(spark, sf_dir).select("case_id", F.when(odd, y).otherwise(x).alias("first"), F.when(odd, x).otherwise(y).alias("second"), odd.alias("swapped"))


@query("WITH l AS (SELECT doc_id, list_sort(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, l[1 + round_even(0.9::DOUBLE * (len(l) - 1), 0)::INT]::BIGINT AS q90, l[1 + round_even(0.5::DOUBLE * (len(l) - 1), 0)::INT]::BIGINT AS q50 FROM l")
def robust_quantile(spark, sf_dir):
    """Quantiles of a document's line lengths, by the nearest rank."""
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.array_sort(F.transform(F.split("text", "\n"), F.length)).alias("l"))
    at = lambda q: F.get("l", F.bround(F.lit(q) * (F.size("l") - 1), 0).cast("int")).cast("long")
    return d.select("doc_id", at(0.9).alias("q90"), at(0.5).alias("q50"))


@query(r"SELECT doc_id, i AS nth, a AS span_start FROM (" + spans_sql("license") + ")")
def anchor_found(spark, sf_dir):
    """Anchors that were made at the places of a term, found again by the exact words and what stands round them."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    made = anchors(term_spans(d, ["license"]).select(F.col("key").alias("doc_id"), "nth", "span_start", "span_end").join(d, "doc_id"), 60)
    marks = made.select(F.struct("doc_id", "nth").alias("record_id"), F.col("doc_id").alias("key"), "exact", "prefix", "suffix")
    found = highlights.found_anchors(marks, d.select(F.col("doc_id").alias("key"), "text"))
    return found.select("record_id.doc_id", "record_id.nth", F.col("found_start").alias("span_start"))
