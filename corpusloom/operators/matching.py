"""Matching text against text: glossary terms, evidence, overlap, verdict tracking, anchors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

STRONG, SUPPORTED = 0.90, 0.55


def normal(text) -> object:
    """Lower case, soft hyphens dropped, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("­"), F.lit(""))), r"(?U)\s+", " "))


def words4(text) -> object:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{4,}"), 0))


def token_overlap(a, b) -> object:
    """Shared tokens of four characters or more, over the smaller set."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


MOST_FACTS = 20_000


def evidence_containment(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(fact_id, key) where a source (key, text) holds the normalised fact (fact_id, fact) of six characters or more.

    The facts are the stated, small side. While they are few, each source is searched for all of them in one pass, where it is
    read; else a source's words meet each fact's longest word, and only sources that have it are searched."""
    few = facts.select("fact_id", normal(F.col("fact")).alias("needle")).where(F.length("needle") >= 6)
    if few.count() > MOST_FACTS:
        return _probed(facts, docs)
    shared = docs.sparkSession.sparkContext.broadcast([r["needle"] for r in few.select("needle").distinct().collect()])
    hays = docs.select("key", normal(F.col("text")).alias("hay"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ahocorasick.Automaton()
        for needle in shared.value:
            known.add_word(needle, needle)
        known.make_automaton()
        for batch in batches if shared.value else ():
            met = [{needle for _, needle in known.iter(hay)} if (hay := x.as_py()) else () for x in batch.column("hay")]
            row = [i for i, of in enumerate(met) for _ in of]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), pa.array([n for of in met for n in of], pa.string())], ["key", "needle"])

    held = hays.mapInArrow(run, StructType([hays.schema["key"], StructField("needle", StringType())]))
    return F.broadcast(few).join(held, "needle").select("fact_id", "key")


def _probed(facts: DataFrame, docs: DataFrame) -> DataFrame:
    split = F.split("needle", " ")
    f = facts.select("fact_id", normal(F.col("fact")).alias("needle")).where(F.length("needle") >= 6)
    # a fact's first and last word may be parts of longer ones in the source, so only an inner word is a sure probe
    inner = F.slice(split, 2, F.greatest(F.lit(0), F.size(split) - 2))
    longest = F.element_at(F.sort_array(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1)["w"]
    d = docs.select("key", normal(F.col("text")).alias("hay"))
    words = d.select("key", F.explode(F.array_distinct(F.split("hay", " "))).alias("probe"))
    near = f.where(F.size(split) > 2).withColumn("probe", longest).join(words, "probe").select("fact_id", "needle", "key")
    held = near.join(d, "key").where(F.contains("hay", "needle")).select("fact_id", "key")
    short = d.join(f.where(F.size(split) <= 2), F.contains("hay", "needle")).select("fact_id", "key")
    return held.union(short)


def glossary_matches(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, matches): whole-word occurrences of a short list of terms, case ignored, counted in one scan."""
    edge = lambda t: r"(?iu)(?<![\p{L}\p{N}_])\Q" + t + r"\E(?![\p{L}\p{N}_])"
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.regexp_count(F.col(text), F.lit(edge(t))).cast("long").alias("matches")) for t in terms)))
    return docs.select(F.col(key).alias("key"), each.alias("m")).select("key", "m.term", "m.matches").where("matches > 0")


def term_spans(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, nth, span_start, span_end): every place of each term in the whole text, case ignored, without overlaps,
    from left to right. The lengths of what lies between the places add up to where they are."""
    grow = lambda n: lambda acc, piece: F.struct((acc["at"] + F.length(piece) + n).alias("at"), F.array_append(acc["starts"], acc["at"] + F.length(piece)).alias("starts"))
    each = []
    for t in terms:
        pieces = F.split(F.lower(text), re.escape(t), -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        each.append(F.struct(F.lit(t).alias("term"), F.lit(len(t)).alias("size"), F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, grow(len(t)))["starts"].alias("starts")))
    held = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*each)).alias("t")).select("key", "t.term", "t.size", F.posexplode("t.starts").alias("i", "a"))
    return held.select("key", "term", (F.col("i") + 1).cast("long").alias("nth"), F.col("a").cast("long").alias("span_start"), (F.col("a") + F.col("size")).cast("long").alias("span_end"))


def track(scored: DataFrame) -> DataFrame:
    """A row per claim of (claim_id, seq, entailment, contradiction): the best of each, where the first wins ties, and the
    verdict. Units after the first with an entailment of STRONG or more are not looked at."""
    order = Window.partitionBy("claim_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = scored.withColumn("before", F.coalesce(F.max("entailment").over(order), F.lit(0.0))).where(F.col("before") < STRONG)
    best = seen.groupBy("claim_id").agg(F.max(F.struct("entailment", (-F.col("seq")).alias("s"))).alias("e"), F.max(F.struct("contradiction", (-F.col("seq")).alias("s"))).alias("c"), F.count("*").alias("units"))
    e, c = F.col("e.entailment"), F.col("c.contradiction")
    status = F.when((e >= c) & (e >= SUPPORTED), "supported").when((e >= c) & (e > 0), "partial").when(c > e, "contradicted").otherwise("not_found")
    return best.select("claim_id", e.alias("entailment"), (-F.col("e.s")).alias("entailment_seq"), c.alias("contradiction"), (-F.col("c.s")).alias("contradiction_seq"), "units", status.alias("status"))


def anchors(spans: DataFrame, context: int = 24, text: str = "text") -> DataFrame:
    """`spans` (span_start, span_end, text) with exact, the text of the span, and the prefix and suffix that tell it from
    equal ones."""
    s, e = F.col("span_start").cast("int"), F.col("span_end").cast("int")
    first = F.greatest(F.lit(0), s - context)
    body = F.col(text)
    return spans.withColumns({"exact": F.substring(body, s + 1, e - s), "prefix": F.substring(body, first + 1, s - first), "suffix": F.substring(body, e + 1, F.lit(context))})


def without_repeats(body, between: str) -> object:
    """The parts of a text, in order, without those that say the same as the one before, case and white space aside."""
    parts = F.filter(F.transform(F.split(body, between), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    same = lambda p: F.lower(F.btrim(F.regexp_replace(p, r"(?U)\s+", " "), F.lit(" ")))
    told = F.transform(parts, lambda p: F.struct(p.alias("part"), same(p).alias("same")))
    # a one-element array binds the parts, which would else be made again for each of them
    kept = F.transform(F.array(told), lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p["same"] != F.get(ps, i - 1)["same"])))
    return F.transform(F.get(kept, F.lit(0)), lambda p: p["part"])


def excerpt(body, terms: list[str], window: int = 400) -> object:
    """A passage of about `window` characters round the first of `terms`, in their order, that the text has; its start
    where none is found. Cut ends are marked."""
    low = F.lower(body)
    at = F.coalesce(*(F.when(F.locate(t, low) > 0, F.locate(t, low) - 1) for t in terms))
    missing = F.concat(_tidy(F.substring(body, 1, window)), _mark(F.length(body) > window))
    return F.when(at.isNull(), missing).otherwise(excerpt_at(body, at, window))


def _tidy(x) -> object:
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def _mark(cond) -> object:
    return F.when(cond, F.lit("…")).otherwise(F.lit(""))


def excerpt_at(body, at, window: int = 400) -> object:
    """A passage of about `window` characters round a place of the text; cut ends are marked."""
    n, half = F.length(body), window // 2
    start, end = F.greatest(F.lit(0), at - half), F.least(n, at + half)
    end = F.when(start == 0, F.least(n, F.lit(window))).otherwise(end)
    start = F.when(end == n, F.greatest(F.lit(0), n - window)).otherwise(start)
    return F.concat(_mark(start > 0), _tidy(F.substring(body, start + 1, end - start)), _mark(end < n))


def widest_cover(segments: DataFrame, spans: DataFrame, key: str = "key", width: int = 512) -> DataFrame:
    """The rows of `segments` (key, seg_start, seg_end) with the span (span_start, span_end, and its other columns as `span`) of `spans` that
    overlaps them and is the widest; ties: the first, then the least of the other columns. Null where none overlaps.

    Both sides are cut into bins of `width` places, and what shares a bin is joined; a pair counts in its first common bin
    only. So neither a text with many spans nor one long span makes all pairs."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / width))).alias("bin")
    rest = [c for c in spans.columns if c not in (key, "span_start", "span_end")]
    left = segments.select(key, "seg_start", "seg_end", bins("seg_start", "seg_end"))
    right = spans.select(key, "span_start", "span_end", *rest, bins("span_start", "span_end"))
    first = F.col("bin") == F.greatest(F.floor(F.col("seg_start") / width), F.floor(F.col("span_start") / width))
    met = left.join(right, [key, "bin"]).where(first & (F.col("span_start") < F.col("seg_end")) & (F.col("span_end") > F.col("seg_start")))
    best = F.min(F.struct((F.col("span_start") - F.col("span_end")).alias("narrow"), "span_start", "span_end", *rest))
    won = met.groupBy(key, "seg_start", "seg_end").agg(best.alias("w")).select(key, "seg_start", "seg_end", F.struct("w.span_start", "w.span_end", *(f"w.{c}" for c in rest)).alias("span"))
    return segments.join(won, [key, "seg_start", "seg_end"], "left")
