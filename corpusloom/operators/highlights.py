"""Highlight records over texts: every place of a term, an anchor found again by its words or by what stands round them, and
records brought up to date with an edited text.

A record is (record_id, kind, mode, key, exact, prefix, suffix, case_sensitive, whole_word), its mode term_all or anchor; ids are
unique. A text is (key, text). A term record without a key is for all texts, and there always of whole words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.excerpts import shared_start

CONTEXT = 48
# fixed values: how much of a context is looked for where the whole of it isn't in the text
SIZES = (32, 24, 16, 12, 8)
WORD = r"[\p{L}\p{N}_]"


def literal(needle: Column) -> Column:
    """A pattern for just this string."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def unified(text: Column) -> Column:
    """Line and paragraph ends as \\n; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\u2029"), F.lit("\n"))


def _starts(rows: DataFrame, needle: str, *ids: str) -> DataFrame:
    """(ids, at): every place of the needle in `body`, also where two overlap. The text is cut before each place, so lengths add up
    to places; only lengths are sorted."""
    pieces = F.transform(F.split(F.col("body"), F.concat(F.lit("(?="), literal(F.col(needle)), F.lit(")")), -1), F.length)
    cut = rows.where(F.contains("body", needle)).select(*ids, F.startswith("body", needle).alias("first"), F.posexplode(pieces).alias("i", "n"))
    at = F.sum("n").over(Window.partitionBy(*ids).orderBy("i")) - F.col("n")
    return cut.select(*ids, "i", "first", at.alias("at")).where("i > 0 or first").select(*ids, "at")


def _part(context: str, tail: bool) -> Column:
    """The longest part of a context, of the stated sizes and at its inner end, that the text has."""
    c = F.col(context)
    cut = lambda n: F.right(c, F.lit(n)) if tail else F.left(c, F.lit(n))
    return F.coalesce(F.when((c != "") & F.contains("body", c), c), *(F.when((F.length(c) >= n) & F.contains(F.col("body"), cut(n)), cut(n)) for n in SIZES))


def found_anchors(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, key, found_start, found_end, inferred) for the anchors (record_id, key, exact, prefix, suffix) that their text still has.

    Of several places of the exact words that with most characters of the contexts next to it wins; ties: the first. Where
    the words are gone, the shortest stretch from an end of the prefix to a start of the suffix is taken, ties: the first; it may
    be empty. Without both contexts nothing is inferred. Null parts are empty."""
    filled = anchors.select("record_id", "key", *(unified(F.col(c)).alias(c) for c in ("exact", "prefix", "suffix")))
    met = filled.join(texts.select("key", unified(F.col("text")).alias("body")), "key").where("body <> ''")
    there = (F.col("exact") != "") & F.contains("body", "exact")
    # what follows a place comes with it as a group of the pattern; what is before it follows it in the reversed text
    follows = lambda c, needle, context: F.regexp_extract_all(c, F.concat(F.lit("(?s)(?="), literal(needle), F.lit("(.{0,"), F.length(context), F.lit("}))")), 1)
    behind = follows(F.reverse("body"), F.reverse("exact"), "prefix")
    direct = met.where(there).withColumns({"after": follows(F.col("body"), F.col("exact"), "suffix"), "before": F.reverse(behind)})
    scores = F.zip_with("before", "after", lambda b, a: shared_start(b, F.reverse("prefix")) + shared_start(a, F.col("suffix")))
    best = F.array_max(F.transform(scores, lambda s, i: F.struct(s.alias("score"), (-i).alias("back"))))
    direct = direct.withColumn("nth", -best["back"] + F.when(F.startswith("body", "exact"), 0).otherwise(1))
    pieces = F.split(F.col("body"), F.concat(F.lit("(?="), literal(F.col("exact")), F.lit(")")), -1)
    start = F.aggregate(F.slice(pieces, F.lit(1), F.col("nth")), F.lit(0), lambda s, p: s + F.length(p))
    direct = direct.select("record_id", "key", start.cast("long").alias("found_start"), F.length("exact").alias("n"))
    direct = direct.select("record_id", "key", "found_start", (F.col("found_start") + F.col("n")).alias("found_end"), F.lit(False).alias("inferred"))
    gone = met.where(~there).withColumns({"head": _part("prefix", True), "tail": _part("suffix", False)}).where("head is not null and tail is not null")
    ids = ("record_id", "key")
    opens = _starts(gone.withColumn("shift", F.length("head")), "head", *ids, "shift").select(*ids, (F.col("at") + F.col("shift")).alias("at"), F.lit(0).alias("side"))
    closes = _starts(gone, "tail", *ids).select(*ids, "at", F.lit(1).alias("side"))
    order = Window.partitionBy(*ids).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("side") == 0, F.col("at"))).over(order)
    held = opens.union(closes).withColumn("open", last).where("side = 1 and open is not null")
    won = held.groupBy(*ids).agg(F.min(F.struct((F.col("at") - F.col("open")).alias("gap"), "open")).alias("w"))
    return direct.union(won.select(*ids, F.col("w.open").alias("found_start"), (F.col("w.open") + F.col("w.gap")).alias("found_end"), F.lit(True).alias("inferred")))


def found_terms(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, key, found_start, found_end): every place of the terms (record_id, key, exact, case_sensitive, whole_word), from left to right
    and without overlaps. Terms that are blank have none.

    A term without a key meets the texts that have its longest word; nothing else of them is searched."""
    low = lambda c: F.lower(unified(F.col(c)))
    filled = terms.withColumn("exact", F.coalesce("exact", F.lit(""))).where(F.trim("exact") != "")
    body = texts.select("key", unified(F.col("text")).alias("body"))
    own = filled.where("key is not null").join(body, "key")
    words = F.regexp_extract_all(low("exact"), F.lit(f"{WORD}+"), 0)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    probes = filled.where("key is null").drop("key").withColumns({"probe": longest, "whole_word": F.lit(True)}).where("probe is not null")
    wanted = probes.select("probe").distinct()
    held = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all(low("text"), F.lit(f"{WORD}+"), 0))).alias("probe")).join(wanted, "probe", "left_semi")
    common = probes.join(held, "probe").drop("probe").join(body, "key")
    rows = own.unionByName(common)
    edge = lambda side: F.when(F.col("whole_word"), F.lit(f"(?{side}{WORD})")).otherwise(F.lit(""))
    pattern = F.concat(F.when(F.col("case_sensitive"), F.lit("")).otherwise(F.lit("(?iu)")), edge("<!"), literal(F.col("exact")), edge("!"))
    cut = rows.select("record_id", "key", F.length("exact").alias("n"), F.transform(F.split(F.col("body"), pattern, -1), F.length).alias("gaps")).where(F.size("gaps") > 1)
    each = cut.select("record_id", "key", "n", F.size("gaps").alias("of"), F.posexplode("gaps").alias("i", "gap"))
    start = F.sum("gap").over(Window.partitionBy("record_id", "key").orderBy("i")) + F.col("i") * F.col("n")
    each = each.withColumn("found_start", start.cast("long")).where("i < of - 1")
    return each.select("record_id", "key", "found_start", (F.col("found_start") + F.col("n")).alias("found_end"))


def resolve_matches(records: DataFrame, texts: DataFrame, glossary: bool = True) -> DataFrame:
    """(record_id, kind, key, found_start, found_end): where the records show in the texts, those of the glossary only if it is on. Anchors
    whose stretch is empty don't show."""
    shown = records if glossary else records.where("kind is distinct from 'glossary'")
    terms = found_terms(shown.where("mode = 'term_all'"), texts)
    anchors = found_anchors(shown.where("mode = 'anchor' and key is not null"), texts).where("found_end > found_start").drop("inferred")
    return terms.unionByName(anchors).join(shown.select("record_id", "kind"), "record_id").select("record_id", "kind", "key", "found_start", "found_end")


def synced_anchors(records: DataFrame, texts: DataFrame) -> DataFrame:
    """The anchors (record_id, key, exact, prefix, suffix), made anew where their text has them, with `changed`. Those that their text
    has no more, or that have no text, stay as they are; those whose stretch is empty or blank go."""
    found = found_anchors(records, texts).join(texts.select("key", unified(F.col("text")).alias("body")), "key")
    s, e, body = F.col("found_start").cast("int"), F.col("found_end").cast("int"), F.col("body")
    first = F.greatest(F.lit(0), s - CONTEXT)
    fresh = F.struct(F.substring(body, s + 1, e - s).alias("exact"), F.substring(body, first + 1, s - first).alias("prefix"), F.substring(body, e + 1, F.lit(CONTEXT)).alias("suffix"))
    made = records.join(found.select("record_id", "key", fresh.alias("made")), ["record_id", "key"], "left")
    kept = made.where(F.col("made").isNull() | F.col("made.exact").rlike(r"(?U)\S"))
    parts = ("exact", "prefix", "suffix")
    same = F.lit(True)
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"made.{c}"))
    rest = [c for c in records.columns if c not in parts]
    return kept.select(*rest, *(F.when(F.col("made").isNull(), F.col(c)).otherwise(F.col(f"made.{c}")).alias(c) for c in parts), (F.col("made").isNotNull() & ~same).alias("changed"))


def tab_name(name: Column) -> Column:
    """A tab's name without blanks round it and without the mark of a locked one."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(bare.startswith("\U0001f512 "), F.trim(F.substring(bare, 3, 1 << 30))).otherwise(bare)


def glossary_records(entries: DataFrame) -> DataFrame:
    """(exact, definition, kind, mode, case_sensitive, whole_word): a record for each term and alias of two characters or more of `entries` (place,
    term, aliases, definition), whatever its case once only, as its first entry has it; an entry's term comes before its aliases. Places are unique."""
    names = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = entries.select("place", F.trim(F.coalesce("definition", F.lit(""))).alias("definition"), F.posexplode(F.transform(names, lambda n: F.trim(n))).alias("at", "exact")).where(F.length("exact") >= 2)
    won = each.groupBy(F.lower("exact").alias("low")).agg(F.min(F.struct("place", "at", "exact", "definition")).alias("w"))
    return won.select("w.exact", "w.definition", F.lit("glossary").alias("kind"), F.lit("term_all").alias("mode"), F.lit(False).alias("case_sensitive"), F.lit(True).alias("whole_word"))


def preview(exact: Column, longest: int = 40) -> Column:
    """An anchor's words on one line, cut with dots beyond `longest` characters."""
    line = F.trim(F.regexp_replace(F.coalesce(exact, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(line) > longest, F.concat(F.left(line, F.lit(longest - 3)), F.lit("..."))).otherwise(line)


def jump_targets(records: DataFrame) -> DataFrame:
    """(record_id, kind, tabs, exact_preview) of the records (record_id, kind, tabs, exact) that are no glossary's."""
    tabs = F.filter(F.transform(F.coalesce("tabs", F.array().cast("array<string>")), tab_name), lambda t: t != "")
    return records.where("kind is distinct from 'glossary'").select("record_id", "kind", tabs.alias("tabs"), preview(F.col("exact")).alias("exact_preview"))


def renamed_tabs(tabs: Column, old: str, new: str) -> Column:
    """Names of tabs after one is renamed, each once, in order. Names without the old one, and all if old or new is blank or they are equal, stay as they are."""
    before, after = tab_name(F.lit(old)), tab_name(F.lit(new))
    bare = F.filter(F.transform(tabs, tab_name), lambda t: t != "")
    moved = F.array_distinct(F.transform(bare, lambda t: F.when(t == before, after).otherwise(t)))
    return F.when((before != "") & (after != "") & (before != after) & F.array_contains(bare, before), moved).otherwise(tabs)
