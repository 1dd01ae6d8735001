"""Labels: cleaning, their words, when two are the same, and which of two to keep. Columns throughout; folding is the one
Arrow function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ascii_fold, collapsed, fingerprint

# fixed values: words that say nothing, labels that name the form and not a thing, and traces of an instruction
STOP_WORDS = (
    "aber", "als", "also", "am", "an", "and", "auch", "auf", "aus", "bei", "by",
    "das", "dem", "den", "der", "des", "die", "dies", "doch", "ein", "eine", "einer",
    "einem", "einen", "einerseits", "eines", "er", "es", "for", "from", "hat", "haben",
    "ich", "im", "in", "ist", "it", "mit", "nicht", "of", "on", "oder", "sie", "so",
    "the", "to", "und", "von", "was", "we", "wie", "with", "zu", "zum", "zur",
)
META_LABELS = (
    "children", "nodes", "edges", "label", "labels", "relation", "relations", "source",
    "target", "text", "name", "title", "node", "graph", "mindmap", "format",
)
META_TRACES = ("antworte", "format", "children", "nodes", "edges", "relation", "source", "target")
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def words(text: Column, least: int = 3) -> Column:
    """Folded words of `least` letters or more that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(ascii_fold(text), F.lit(WORD), 0), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def clean(label: Column, least: int = 3, longest: int = 80) -> Column:
    """A label without quotes, heading and list marks, trailing commas and doubled blanks; empty if it names only the form
    or has no word of `least` letters."""
    return named(bare(label), least, longest)


def bare(label: Column) -> Column:
    """A label without what surrounds it."""
    x = F.replace(F.replace(label, F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" "))
    for ends in (" \t\r\n", "` ", "\"'", " \t\r\n"):
        x = F.btrim(x, F.lit(ends))
    x = F.btrim(F.regexp_replace(x, "[,;:]+$", ""), F.lit(" \t\r\n"))
    return collapsed(F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s+", ""), r"^(?:[-*+]\s+|\d+[.)]\s+)", ""))


def named(x: Column, least: int = 3, longest: int = 80) -> Column:
    """A bare label, cut to `longest`; empty if it names only the form or has no word of `least` letters."""
    told = ~ascii_fold(x).isin(*META_LABELS) & (F.size(words(x, least)) > 0)
    return F.when(told, F.btrim(F.substring(x, 1, longest))).otherwise("")


def same(left: Column, right: Column) -> Column:
    """Whether two labels, cleaned, are equal but for case, or come down to the same stems."""
    a, b = clean(left, 1, 200), clean(right, 1, 200)
    alike = (F.lower(a) == F.lower(b)) | (fingerprint(ascii_fold(a)) == fingerprint(ascii_fold(b)))
    return F.coalesce((a != "") & (b != "") & alike, F.lit(False))


def stems_agree(left: Column, right: Column) -> Column:
    """Whether two labels are equal but for case, share all stems, or the smaller set, of two or more, lies in the other."""
    a, b = fingerprint(ascii_fold(left)), fingerprint(ascii_fold(right))
    met, fewer = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    whole = (met > 0) & (met == F.size(a)) & (met == F.size(b))
    filled = (F.trim(left) != "") & (F.trim(right) != "")
    return F.coalesce(filled & ((F.lower(F.trim(left)) == F.lower(F.trim(right))) | whole | (met >= 2) & (met == fewer)), F.lit(False))


def preferred(current: Column, candidate: Column) -> Column:
    """The label with more stems, of as many the longer one; the current one in a tie, the other if one is empty."""
    a, b = F.trim(F.coalesce(current, F.lit(""))), F.trim(F.coalesce(candidate, F.lit("")))
    na, nb = F.size(fingerprint(ascii_fold(a))), F.size(fingerprint(ascii_fold(b)))
    better = (a == "") | (b != "") & ((nb > na) | (nb == na) & (F.length(b) > F.length(a)))
    return F.when(better, b).otherwise(a)


def grounded(label: Column, text: Column) -> Column:
    """Whether a text holds a label of eight characters or more, or shares a word with it."""
    return holds(text, clean(label, 2, 120))


def holds(text: Column, x: Column) -> Column:
    """The same for a label that is clean, so that a query can clean it in a step of its own."""
    held = (F.length(x) >= 8) & F.contains(collapsed(F.lower(text)), F.lower(x))
    return F.coalesce((x != "") & (F.trim(text) != "") & (held | F.arrays_overlap(words(x), words(text))), F.lit(False))


def names_form(label: Column) -> Column:
    """Whether a label has no word, or a trace of an instruction."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    trace = F.lit(False)
    for t in META_TRACES:
        trace = trace | F.contains(low, F.lit(t))
    return (low == "") | (F.size(words(low)) == 0) | trace
