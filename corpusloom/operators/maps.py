"""Maps of texts: segments, concepts to begin with, which node to work on next, the evidence for it, what is covered and what is not,
and whether a map's labels are those of its text.

A map is told by its key, and all maps are worked on at once. Segments are (key, nth, segment), nodes (key, node_id, label, depth,
children), and queries (key, query)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import labels
from corpusloom.functions.text import ascii_fold, collapsed, fingerprint
from corpusloom.session import merged, staged

WHITE = " \t\r\n\f\x0b"
# fixed values: what a level that is left, a free place for a child, a shared word and an earlier visit count for
LEVEL, ROOM, SHARED, VISIT = 4, 2, 3, 4
# fixed values: phrases and sets of words of an instruction that a label must not repeat, and marks of markup
META_PHRASES = (
    "ich habe versucht", "strukturiertes graph-format", "graph-ausgabe", "mindmap-ausgabe",
    "die art der beziehung zwischen den knoten", "keine erklaerungen ausserhalb", "antworte nur mit",
)
META_SETS = (("relation", "beziehung", "knoten"), ("source", "target"), ("nodes", "edges"), ("graph", "format"), ("mindmap", "format"))
# fixed values: marked and numbered headings; a small letter that begins a word, or a capital inside one
HEADING, NUMBERED = r"^(#{1,6})\s+(.+?)\s*$", r"^(\d+(?:\.\d+){0,4})\s+(.+?)\s*$"
UNTITLED = r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
MARKUP = r"(?m)(?:```|^\s*#+\s|^\s*[-*]\s|\*\*|^\s*[\[\]{}(),:;]+\s*$)"


def segments(text: Column, longest: int = 700) -> Column:
    """A text's blocks between empty lines; one of over `longest` characters is cut before the last ". ", "; " or ", " in the latter
    half of them, or after them all. One pass of one pattern over each block. Null has none."""
    half = longest // 2
    piece = rf"(?s)\s*(.{{1,{longest}}}\z|.{{{half},{longest - 2}}}(?=[.;,] )|.{{{longest}}})"
    blocks = F.transform(F.split(F.btrim(text, F.lit(WHITE)), r"\n\s*\n"), lambda b: F.btrim(b, F.lit(WHITE)))
    pieces = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(piece), 1)))
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != "")


def segmented(docs: DataFrame, key: str, longest: int = 700) -> DataFrame:
    """(key, nth, segment) of every text, from 1."""
    return docs.select(F.col(key).alias("key"), F.posexplode(segments(F.col("text"), longest)).alias("i", "segment")).select("key", (F.col("i") + 1).alias("nth"), "segment")


def outline(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, nth, label, level): the lines of each text (key, text) that are headings: marked ones, numbered ones, by the parts of their number, and
    short ones in which every word begins with a capital. Of a text without any, the first sentences of its first six segments."""
    lines = docs.select("key", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("key", (F.col("i") + 1).alias("nth"), F.btrim("line", F.lit(WHITE)).alias("line")).where("line <> ''")
    part = lambda pattern, group: F.regexp_extract("line", pattern, group)
    marked, numbered = F.col("line").rlike(HEADING), F.col("line").rlike(NUMBERED)
    capital = (F.length("line") <= 80) & ~F.col("line").rlike(UNTITLED) & ~F.col("line").rlike("[.:;]$")
    level = F.when(marked, F.length(part(HEADING, 1))).when(numbered, F.length(F.regexp_replace(part(NUMBERED, 1), "[^.]", "")) + 1).when(capital, F.lit(1))
    said = F.when(marked, part(HEADING, 2)).when(numbered, part(NUMBERED, 2)).otherwise(F.col("line"))
    # the lists of one and the table are steps of their own: else lines are read and cleaned again wherever they are used
    found = lines.withColumn("level", F.explode_outer(F.array(level))).where("level is not null").select("key", "nth", F.explode_outer(F.array(labels.bare(said))).alias("label"), "level")
    found = staged(found.withColumn("label", F.explode_outer(F.array(labels.named(F.col("label"), 2, 90)))).where("label <> ''"), "outline")
    bare = pieces.where("nth <= 6").join(docs.select("key"), "key", "left_semi").join(found.select("key").distinct(), "key", "left_anti")
    first = labels.clean(F.substring_index("segment", ".", 1), 2, 72)
    return found.union(bare.select("key", "nth", first.alias("label"), F.lit(1).alias("level")).where("label <> ''"))


def focus_sections(sections: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """(key, rank, nth, shared): a map's sections (key, nth, label) by how many words of the query they have; ties: the first. Those without one come last."""
    asked = queries.select("key", labels.words(F.coalesce("query", F.lit(""))).alias("asked"))
    told = sections.join(asked, "key", "left").withColumn("shared", F.size(F.array_intersect(F.coalesce("asked", F.array().cast("array<string>")), labels.words(F.col("label")))))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "nth"))
    return told.withColumn("rank", rank).where(F.col("rank") <= limit).select("key", "rank", "nth", "shared")


def focus_segments(pieces: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(key, rank, nth, shared): a map's segments by how many words of the query they have, only those that have one; ties: the first.
    A query without words, or none, has them all count as one."""
    asked = queries.select("key", labels.words(F.coalesce("query", F.lit(""))).alias("asked"))
    none = F.array().cast("array<string>")
    told = pieces.join(asked, "key", "left").select("key", "nth", F.coalesce("asked", none).alias("asked"), labels.words(F.col("segment")).alias("w"))
    shared = F.when(F.size("asked") == 0, 1).otherwise(F.size(F.array_intersect("asked", "w")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "nth"))
    return told.withColumn("shared", shared).where("shared > 0").withColumn("rank", rank).where(F.col("rank") <= limit).select("key", "rank", "nth", "shared")


def seed_concepts(pieces: DataFrame, limit: int = 12) -> DataFrame:
    """(key, place, label, n): a map's most frequent words of four letters or more; ties: that which comes first. Of the three times
    `limit` first ones those that name a form, or have the stems of an earlier one, are left out."""
    # a map's words come to one task as one text a segment, and are counted and ranked there; the outer form, else they are made twice
    told = pieces.select("key", "nth", F.array_join(labels.words(F.col("segment"), 4), " ").alias("told")).repartition("key")
    each = told.select("key", "nth", F.posexplode_outer(F.split("told", " ")).alias("at", "word")).where("word <> ''")
    counts = each.groupBy("key", "word").agg(F.count("*").alias("n"), F.min(F.struct("nth", "at")).alias("first"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "first")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3 * limit)
    named = top.withColumn("label", labels.clean(F.col("word"), 4, 60)).where("label <> ''")
    kept = named.groupBy("key", fingerprint(F.col("word")).alias("stems")).agg(F.min(F.struct("rank", "label", "n")).alias("b")).select("key", "b.*")
    place = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).select("key", "place", "label", "n")


def frontier_rounds(nodes: DataFrame, queries: DataFrame, rounds: int, target_depth: int = 3, most_visits: int = 2, most_children: int = 5) -> DataFrame:
    """(key, round, node_id, label, score): the node that each round works on, that with the highest score; ties: the least id.

    A visit only lowers the score of the node that it is made to. So the rounds are the possible visits of all nodes sorted by what each
    would count, and need no loop."""
    held = nodes.withColumn("label", labels.clean(F.col("label"), 2, 80)).where((F.col("label") != "") & (F.col("depth") < target_depth) & (F.col("children") < most_children))
    told = held.join(queries.select("key", labels.words(F.col("query")).alias("asked")), "key", "left")
    shared = F.coalesce(F.size(F.array_intersect("asked", labels.words(F.col("label")))), F.lit(0))
    base = LEVEL * (target_depth - F.col("depth")) + ROOM * F.greatest(F.lit(0), 3 - F.col("children")) + SHARED * F.when(F.col("asked").isNull(), 0).otherwise(shared)
    visits = told.select("key", "node_id", "label", base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(most_visits - 1))).alias("visit"))
    scored = visits.select("key", "node_id", "label", (F.col("base") - VISIT * F.col("visit")).alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("round", F.row_number().over(order)).where(F.col("round") <= rounds).select("key", "round", "node_id", "label", "score")


def evidence(picks: DataFrame, pieces: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """(key, round, nth, shared): the segments that share most words with a round's label and the map's query; ties: the first. A map's
    rounds meet each of its segments whole; segments without a shared word are no evidence."""
    words = F.array_union(labels.words(F.col("label")), labels.words(F.coalesce("query", F.lit(""))))
    asked = picks.join(queries, "key", "left").select("key", "round", words.alias("w")).groupBy("key").agg(F.collect_list(F.struct("round", "w")).alias("asked"))
    told = pieces.join(merged(asked), "key").select("key", "nth", "asked", labels.words(F.col("segment")).alias("has"))
    each = F.transform("asked", lambda a: F.struct(a["round"].alias("round"), F.size(F.array_intersect(a["w"], F.col("has"))).cast("long").alias("shared")))
    # the outer form: else a filter on the list is inferred and the words are made twice
    found = told.select("key", "nth", F.explode_outer(each).alias("e")).where("e.shared > 0").select("key", "e.round", "nth", "e.shared")
    order = Window.partitionBy("key", "round").orderBy(F.desc("shared"), "nth")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("key", "round", "nth", "shared")


def coverage(picks: DataFrame, found: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, round, covered, coverage_ratio): how many of a map's segments are evidence by the end of each round."""
    fresh = found.groupBy("key", "nth").agg(F.min("round").alias("round")).groupBy("key", "round").agg(F.count("*").alias("fresh"))
    total = pieces.groupBy("key").agg(F.count("*").alias("total"))
    held = picks.select("key", "round").join(fresh, ["key", "round"], "left").join(total, "key", "left").fillna(0, ["fresh", "total"])
    covered = F.sum("fresh").over(Window.partitionBy("key").orderBy("round"))
    return held.select("key", "round", covered.alias("covered"), "total").select("key", "round", "covered", F.round(F.col("covered") / F.greatest("total", "covered", F.lit(1)), 4).alias("coverage_ratio"))


def gaps(pieces: DataFrame, found: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """(key, gap, nth, gap_label, parent_id): a map's first `most` segments that are no evidence and hold none of the labels, each with
    a label from its first sentence. Since no node shares a word with it, the parent is the node with the least id."""
    named = nodes.select("key", "node_id", labels.clean(F.col("label"), 2, 120).alias("whole")).where("whole <> ''")
    open_ = pieces.join(merged(found.select("key", "nth").distinct()), ["key", "nth"], "left_anti")
    held = named.select("key", labels.words(F.col("whole")).alias("w"), F.when(F.length("whole") >= 8, F.lower("whole")).alias("needle"))
    held = held.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("of"), F.collect_list("needle").alias("needles"))
    rest = open_.join(merged(held), "key", "left").withColumn("low", collapsed(F.lower("segment")))
    met = F.arrays_overlap("of", labels.words(F.col("segment"))) | F.exists("needles", lambda n: F.contains("low", n))
    bare = rest.where(~F.coalesce(met, F.lit(False))).select(*pieces.columns)
    first = bare.withColumn("gap", F.row_number().over(Window.partitionBy("key").orderBy("nth"))).where(F.col("gap") <= most)
    parent = named.groupBy("key").agg(F.min("node_id").alias("parent_id"))
    line = F.substring_index(F.substring_index("segment", "\n", 1), ".", 1)
    told = F.array_join(F.slice(labels.words(F.col("segment"), 4), 1, 4), " ")
    said = first.withColumns({"a": labels.clean(line, 2, 72), "b": labels.clean(told, 2, 72)})
    label = F.when(F.col("a") != "", F.col("a")).when(F.col("b") != "", F.col("b")).otherwise(F.concat(F.lit("Luecke "), F.col("gap").cast("string")))
    return said.join(parent, "key", "left").select("key", "gap", "nth", label.alias("gap_label"), "parent_id")


def grounding_report(nodes: DataFrame, texts: DataFrame, least_nodes: int = 2, least_ratio: float = 0.45, most_meta: int = 1, most_meta_ratio: float = 0.34) -> DataFrame:
    """(key, total_nodes, grounded_nodes, grounded_ratio, meta_like_nodes, meta_like_ratio, ok, reason) of every map of `texts` (key, text, query).

    A label is grounded if it shares a stem with text or query, if its first letter stands alone in them, or if they hold it, of
    eight characters or more, whole. Stems and letters meet through postings; texts are searched only for labels that these leave."""
    both = texts.select("key", F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("query", F.lit(""))).alias("body"))
    stems = both.select("key", F.explode(fingerprint(ascii_fold("body"))).alias("stem"))
    single = both.select("key", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"(?U)\b([A-Za-z])\b"), 1), F.lower))).alias("stem"))
    bare = nodes.select("key", "node_id", F.trim(F.coalesce("label", F.lit(""))).alias("label"))
    n = bare.withColumns({"folded": ascii_fold("label")}).withColumns({"stems": fingerprint(F.col("folded")), "initial": F.substring(F.regexp_extract("folded", labels.WORD, 0), 1, 1)}).where("label <> ''")
    ids = ("key", "node_id")
    sure = n.select(*ids, F.explode("stems").alias("stem")).join(stems, ["key", "stem"], "left_semi").select(*ids)
    sure = sure.union(n.select(*ids, F.col("initial").alias("stem")).join(single, ["key", "stem"], "left_semi").select(*ids)).distinct()
    phrase = F.btrim(collapsed(F.col("folded")), F.lit(" -_:;,.'\""))
    asked = n.join(sure, list(ids), "left_anti").select(*ids, phrase.alias("phrase")).where(F.length("phrase") >= 8)
    held = asked.join(both.select("key", ascii_fold("body").alias("hay")), "key").where(F.contains("hay", "phrase")).select(*ids)
    traces = reduce(lambda a, b: a | b, (F.contains("folded", F.lit(p)) for p in META_PHRASES))
    # a label's stems are what its words come down to, so the sets are held against these
    sets = reduce(lambda a, b: a | b, (F.size(F.array_except(F.array(*map(F.lit, s)), F.col("stems"))) == 0 for s in META_SETS))
    quoted = F.col("label").rlike(r'"\s+und\s+"') | (F.regexp_count("label", F.lit(labels.WORD)) >= 8) & F.endswith("label", F.lit('"'))
    meta = n.where(F.col("label").rlike(MARKUP) | traces | quoted | (F.size("stems") == 0) | sets).select("key").groupBy("key").agg(F.count("*").alias("meta"))
    good = sure.union(held).distinct().groupBy("key").agg(F.count("*").alias("good"))
    out = texts.select("key").join(nodes.groupBy("key").agg(F.count("*").alias("total_nodes")), "key", "left").join(good, "key", "left").join(meta, "key", "left").fillna(0, ["total_nodes", "good", "meta"])
    of = F.greatest(F.col("total_nodes"), F.lit(1))
    ratio, share = F.col("good") / of, F.col("meta") / of
    few = (F.col("good") < max(1, least_nodes)) | (ratio < least_ratio)
    many = (F.col("meta") > most_meta) | (share > most_meta_ratio)
    reason = F.when(many & ((F.col("good") == 0) | (share >= 0.5)), "meta_labels_detected").when(few, "grounding_insufficient").otherwise("grounded")
    reason = F.when(F.col("total_nodes") == 0, "grounding_missing_spec").otherwise(reason)
    return out.select("key", "total_nodes", F.col("good").alias("grounded_nodes"), F.round(ratio, 4).alias("grounded_ratio"), F.col("meta").alias("meta_like_nodes"), F.round(share, 4).alias("meta_like_ratio"), (~few & ~many & (F.col("total_nodes") > 0)).alias("ok"), reason.alias("reason"))
