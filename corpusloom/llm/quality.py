"""Quality rules: counts over words, symbols and lines, and repetition inside a text by suffix array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import per_text
from corpusloom.llm.words import numbered

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 20, 30, 8
# the method's own limits: words in maximal repeats of MIN_REPEAT words or more, and the longest of them
MIN_REPEAT, MOST_COVERED, MOST_LONGEST = 4, 0.5, 100
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_words long, repeat_spans array<struct<start:int,end:int>>"


def suffix_ranks(doc: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words within their text, until no two are equal.

    Suffixes are sorted by doubling; a round sorts only those that still tie, which in prose are few. The last ranks are
    the inverse of the suffix array. Equal ranks at level k mean equal first 2^k words of one text."""
    n = len(doc)
    end = np.searchsorted(doc, doc, "right")
    tied, group = np.arange(n), np.zeros(n, np.int64)
    key = doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    levels, rank, step = [], np.zeros(n, np.int64), 0
    while True:
        order = np.argsort(key, kind="stable")
        tied, group, key = tied[order], group[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        # a class's rank: where its old class began, and how many tied suffixes of the old class come before it
        fresh = np.r_[True, group[1:] != group[:-1]]
        origin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        rank[tied] = group + first[of] - origin
        levels.append(rank.astype(np.int32))
        size = np.diff(np.r_[first, len(key)])[of]
        tied = tied[size > 1]
        if not len(tied):
            return levels
        step = 2 * step or 1
        group = rank[tied]
        ahead = tied + step
        beyond = ahead >= end[tied]
        key = group * (n + 1) + np.where(beyond, 0, rank[np.where(beyond, 0, ahead)] + 1)


def repeat_lengths(doc: np.ndarray, word: np.ndarray, least: int) -> np.ndarray:
    """For every place, how many words from it on occur elsewhere in the same text too (0 if under `least`).

    That is the larger of the common prefixes with the two neighbours in the suffix array. Prefixes are added up from
    the doubling's levels, the longest power of two first; only neighbours that agree in the largest power of two up to
    `least` are looked at."""
    n = len(doc)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    levels = suffix_ranks(doc, word)
    floor = least.bit_length() - 1
    if len(levels) <= floor:
        return out
    end = np.searchsorted(doc, doc, "right")
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    a, b = sa[:-1], sa[1:]
    near = levels[floor][a] == levels[floor][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        common += same << k
    common[common < least] = 0
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _covered(length: np.ndarray) -> np.ndarray:
    """Whether each place lies in a repeat: the union of the spans [i, i + length[i])."""
    change = np.zeros(len(length) + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(change, at, 1)
    np.add.at(change, at + length[at], -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: pa.Array, window: int = WINDOW, min_repeat: int = MIN_REPEAT) -> list[pa.Array]:
    """The columns of RULES for a piece of a column of texts."""
    n = len(texts)
    plain = [t or "" for t in texts.to_pylist()]
    doc, word, _ = numbered([t.encode() for t in plain])
    n_words = np.bincount(doc, minlength=n)
    word_chars = [len(t) - sum(map(t.count, SPACES)) for t in plain]
    symbols = [sum(map(t.count, SYMBOLS)) for t in plain]
    dup_lines = []
    for t in plain:
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    length = repeat_lengths(doc, word, min(window, min_repeat))
    in_window = _covered(np.where(length >= window, length, 0))
    covered = in_window if window == min_repeat else _covered(np.where(length >= min_repeat, length, 0))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, np.where(length >= min_repeat, length, 0))
    per_doc = lambda flag: np.bincount(doc[flag], minlength=n)
    # spans of covered words, numbered inside the text
    base = np.r_[0, np.cumsum(n_words)]
    edge = lambda step: np.flatnonzero(covered & np.r_[True, ~covered[:-1] | (doc[1:] != doc[:-1])]) if step < 0 else np.flatnonzero(covered & np.r_[~covered[1:] | (doc[1:] != doc[:-1]), True]) + 1
    starts, ends = (edge(-1), edge(1)) if len(doc) else (np.empty(0, np.int64),) * 2
    owner = doc[starts] if len(doc) else np.empty(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array((starts - base[owner]).astype(np.int32)), pa.array((ends - base[owner]).astype(np.int32))], ["start", "end"])
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    ints = [n_words, word_chars, symbols, dup_lines, per_doc(in_window), longest, per_doc(covered)]
    return [*(pa.array(np.asarray(x, np.int64)) for x in ints), pa.ListArray.from_arrays(pa.array(offsets), spans)]


def measured(df: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` with those of RULES for each whole text; null and empty texts have none of anything.

    Texts are measured a few hundred at a time; a text that is longer than such a piece by itself is measured alone,
    in memory in proportion to it. Other columns are not read."""
    return per_text(df, text, keep, RULES, measure, chars=1_500_000)


def judged(rows: DataFrame) -> DataFrame:
    """`rows` with base_failed and kept. The method rejects where the union of repeated spans is over MOST_COVERED of
    the words, or one repeat is over MOST_LONGEST words long."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    repeats = (F.col("covered_words") > MOST_COVERED * F.col("n_words")) | (F.col("longest_repeat") > MOST_LONGEST)
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~repeats)
