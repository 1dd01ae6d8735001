"""Sentences, facts and claims of a text, as array columns: no row leaves its place, and nothing is sequential but what an
array function does inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import BREAK, collapsed, plain_normal

# fixed values: what begins a list item, and what ends a sentence
BULLET = r"^(?:[-*•]+|\d+[.)])\s+(?=\S)"
AFTER_END = r"(?<=[.!?])\s+"
# between blocks while they are one string
CUT = "\x00"


def lines(text: Column) -> Column:
    """The lines of a text, breaks included, with white space collapsed."""
    return F.transform(F.split(F.regexp_replace(text, BREAK, "\n"), r"[\n\r]"), collapsed)


def filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def blocks(text: Column) -> Column:
    """Runs of plain lines joined by blanks, and list items; headings and table rows part them and are left out."""
    mark = lambda x: F.when((x == "") | x.startswith("#") | x.startswith("|"), F.lit(CUT)).when(x.rlike(BULLET), F.concat(F.lit(CUT), F.regexp_replace(x, BULLET, ""), F.lit(CUT))).otherwise(F.concat(x, F.lit(" ")))
    return filled(F.transform(F.split(F.array_join(F.transform(lines(text), mark), ""), CUT), lambda b: F.trim(b)))


def sentences(text: Column) -> Column:
    """The sentences of a text's blocks, without blanks and hyphens at their ends."""
    each = F.flatten(F.transform(blocks(text), lambda b: F.split(b, AFTER_END)))
    return filled(F.transform(each, lambda x: F.btrim(x, F.lit(" \t-"))))


def line_facts(text: Column) -> Column:
    """List items, and lines that end like a sentence; headings and table rows are left out."""
    kept = F.filter(lines(text), lambda x: (x != "") & ~x.startswith("#") & ~(x.startswith("|") & x.endswith("|")) & (x.rlike(BULLET) | x.rlike("[.!?…]$")))
    return F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"^(?:[-*•]+|\d+[.)])\s*", ""))), lambda x: F.length(x) >= 2)


def claims(text: Column, least: int = 8) -> Column:
    """Distinct sentences or lines of `least` characters or more, in order."""
    each = F.transform(F.split(text, AFTER_END + r"|\n+"), collapsed)
    return F.array_distinct(F.filter(each, lambda x: F.length(x) >= least))


def candidates(text: Column) -> Column:
    """Paragraphs and sentences."""
    return filled(F.transform(F.split(text, r"\n{2,}|" + AFTER_END), lambda x: F.btrim(x, F.lit(" \t\r\n"))))


def units(text: Column, least: int = 12) -> Column:
    """Distinct sentences that are long enough to be judged."""
    return F.array_distinct(F.filter(sentences(text), lambda x: F.length(x) >= least))


def fact_limit(text: Column) -> Column:
    """How many facts to expect: sentences of 12 characters or more and list items, else a sixth of the words, with a margin,
    from 24 to 180; without any word 24."""
    items = F.regexp_count(text, F.lit(r"(?m)^\s*(?:[-*•]+|\d+[.)])\s+\S+"))
    base = F.size(F.filter(sentences(text), lambda x: F.length(x) >= 12)) + items
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))
    base = F.when(base > 0, base).when(words > 0, F.greatest(F.lit(24), F.floor(words / 6)))
    return F.when(base.isNull(), 24).otherwise(F.greatest(F.lit(24), F.least(F.lit(180), F.floor(base * 1.15) + 4))).cast("long")


def belongs(fact: Column, target: Column) -> Column:
    """Whether a fact comes from a text: the text holds it, or enough of its words of four letters or more."""
    own = F.filter(F.split(plain_normal(fact), " "), lambda w: F.length(w) >= 4)
    theirs = F.array_distinct(F.filter(F.split(plain_normal(target), " "), lambda w: F.length(w) >= 4))
    n, met = F.size(own), F.size(F.filter(own, lambda w: F.array_contains(theirs, w)))
    part = F.try_divide(met.cast("double"), n)
    enough = F.when(n < 2, False).when(n <= 4, (met >= 2) & (part >= 0.60)).otherwise((met >= 3) & (part >= 0.52) | (met >= 5) & (part >= 0.42))
    held = F.contains(collapsed(F.lower(target)), collapsed(F.lower(fact)))
    return F.coalesce((F.length(F.trim(fact)) > 0) & (F.length(F.trim(target)) > 0) & (held | F.coalesce(enough, F.lit(False))), F.lit(False))
