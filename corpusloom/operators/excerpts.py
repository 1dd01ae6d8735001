"""Where a chunk stands in its document, the passages round it, anchors found again, and overlapping blocks as one text.
All of it is columns: a row never leaves its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n"
PART = "\uffff"


def _tidy(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(WHITE))


def chunk_start(full: Column, chunk: Column) -> Column:
    """The 0-based place of a chunk in a text, or of its first 200 characters; null if neither is found."""
    head = F.substring(F.btrim(chunk, F.lit(WHITE)), 1, 200)
    place = lambda x: F.when(F.length(x) > 0, F.nullif(F.position(x, full), F.lit(0)) - 1)
    return F.coalesce(place(chunk), place(head))


def chunk_end(full: Column, chunk: Column) -> Column:
    """Where that passage ends."""
    head = F.substring(F.btrim(chunk, F.lit(WHITE)), 1, 200)
    return chunk_start(full, chunk) + F.when(F.contains(full, chunk), F.length(chunk)).otherwise(F.length(head))


def paragraphs_round(full: Column, start: Column, end: Column) -> Column:
    """The whole paragraphs that a span touches."""
    before = F.substring(full, F.lit(1), start)
    first = start - F.length(F.substring_index(before, "\n\n", -1))
    after = F.substring(full, end + 1, F.length(full))
    return _tidy(F.substring(full, first + 1, end + F.length(F.substring_index(after, "\n\n", 1)) - first))


def span_extended(full: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """A span with so many characters before and after it; cut ends are marked."""
    s, e = F.greatest(F.lit(0), start - before), F.least(F.length(full), end + after)
    mark = lambda cond: F.when(cond, F.lit("…")).otherwise(F.lit(""))
    return F.concat(mark(s > 0), _tidy(F.substring(full, s + 1, e - s)), mark(e < F.length(full)))


def shared_start(left: Column, right: Column) -> Column:
    """How many characters two strings begin with alike."""
    n = F.least(F.length(left), F.length(right))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    odd = F.filter(places, lambda i: F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1)))
    return F.coalesce(F.get(odd, F.lit(0)) - 1, n)


def shared_end(left: Column, right: Column) -> Column:
    return shared_start(F.reverse(left), F.reverse(right))


def merged_blocks(blocks: Column, least: int = 40, most: int = 500) -> Column:
    """Blocks as one text: what the text so far holds is left out, an overlap of `least` to `most` characters is written
    once, and others are parted by an empty line."""
    filled = F.filter(F.transform(blocks, lambda b: F.btrim(b, F.lit(WHITE))), lambda b: b != "")

    # the leftmost place from which the text so far runs to its end as the block begins; PART, a code point that is no
    # character, stands between the two
    again = rf"([^{PART}]{{{least},}}+){PART}\1"

    def overlap(tail, block):
        # there the block's first characters stand; mostly they do where they are first met, and the search is over
        head = F.left(block, F.lit(least))
        rest = F.substring(tail, F.position(head, tail), F.lit(most))
        met = F.length(F.regexp_extract(F.concat(tail, F.lit(PART), F.left(block, F.lit(most))), again, 1))
        whole = F.startswith(block, rest) & ~F.contains(rest, F.lit(PART))
        return F.when((F.length(block) < least) | ~F.contains(tail, head), 0).when(whole, F.length(rest)).otherwise(met)

    def joined(told, block):
        # a one-element array binds the overlap, which would else be looked for twice
        new = F.transform(F.array(overlap(F.right(told, F.lit(most)), block)), lambda k: F.when(k == 0, F.concat(F.rtrim(told), F.lit("\n\n"), block)).otherwise(F.concat(told, F.substring(block, k + 1, F.length(block)))))
        return F.when(told == "", block).when(F.contains(told, block), told).when(F.contains(block, told), block).otherwise(F.get(new, F.lit(0)))

    return F.aggregate(filled, F.lit(""), joined)


def count_found(text: Column, needle: str, case_sensitive: bool = False, whole_words: bool = False) -> Column:
    """How often a text has a needle, taken literally."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in needle)
    return F.regexp_count(text, F.lit(("" if case_sensitive else "(?iu)") + (rf"\b{quoted}\b" if whole_words else quoted)))
