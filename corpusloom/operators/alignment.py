"""Pairs of texts set side by side: facts matched one to one, over tables of scored pairs, and lines compared."""

from __future__ import annotations

import difflib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from corpusloom.functions.text import collapsed, glossary_normal, plain_normal
from corpusloom.session import Scratch, merged

COUNTS = ("best_block", "inserted_lines", "deleted_lines", "replaced_lines")
LINES = StructType([StructField("line_ratio", DoubleType()), *(StructField(c, IntegerType()) for c in COUNTS)])
THRESHOLD = 0.36
# what a term counts as that holds another
WITHIN = 0.92
# distinct runs of characters, or keys, that are handed to all tasks; terms of a key on one side that meet in one task, and those
# that meet in one row; rows of a frame
MOST_RUNS, MOST_LISTED, MOST_BESIDE, FRAME = 500_000, 5_000, 1_000, 200_000
# characters of a string up to which pairs are compared on a grid of bits: 2 MB for two of that length
LONGEST = 4_000


@lru_cache(maxsize=256)
def _places(text: str) -> tuple[int, dict[str, bytes]]:
    """The bytes of a row of a grid over `text`, and for each character the row in which its places are set; the last bit
    of a row is never set, so that no run goes on in the next one."""
    wide, at = len(text) // 8 + 1, defaultdict(int)
    for j, c in enumerate(text):
        at[c] |= 1 << j
    return wide, {c: bits.to_bytes(wide, "little") for c, bits in at.items()}


def agreeing(a: str, b: str, least: float = 0) -> int:
    """How many characters are in difflib's blocks of two strings: their longest common run, the first in `a`, then in `b`, and in the
    same way those left and right of it. 0 where that is less than `least`, as soon as it is certain.

    A row of the grid is a character of `a`, with the places of `b` that have it set; a number holds the grid, and an
    `and` with itself moved by a row and a place leaves the starts of longer runs. No run within a part is longer than the one that
    parts it, and between two runs one side has a character or more: k runs of m at most in r rows and t places have 2mk + k - 1 <= r + t."""
    wide, rows = _places(b)
    row, none = 8 * wide, bytes(wide)
    grid = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    found, most = 0, min(len(a), len(b))
    todo = [(most, grid, len(a), 0, len(b))]
    while todo and most >= least:
        fits, grid, n, start, end = todo.pop()
        most -= fits
        grid &= int.from_bytes(((1 << end) - (1 << start)).to_bytes(wide, "little") * n, "little")
        if not grid:
            continue
        runs, size = [grid], 1
        while longer := runs[-1] & runs[-1] >> (row + 1) * size:
            runs.append(longer)
            size *= 2
        last, step = runs.pop(), size
        while runs:
            step //= 2
            if longer := last & runs.pop() >> (row + 1) * size:
                last, size = longer, size + step
        i, j = divmod((last & -last).bit_length() - 1, row)
        found, most = found + size, most + size
        parts = []
        for rest, r, s, e in ((grid, i, start, j), (grid >> row * (i + size), n - i - size, j + size, end)):
            if fits := min(r, e - s, (r + e - s + 1) * size // (2 * size + 1)):
                parts.append((fits, rest, r, s, e))
                most += fits
        todo += sorted(parts)
    return found if most >= least else 0


def likeness(a: str, b: str, least: float = 0) -> float:
    """difflib's ratio of two strings; 0 where that is less than `least`."""
    both = len(a) + len(b)
    if max(len(a), len(b)) > LONGEST:
        held = difflib.SequenceMatcher(None, a, b, autojunk=False)
        return held.ratio() if held.quick_ratio() >= least - 1e-9 else 0.0
    return 2.0 * agreeing(a, b, least * both / 2 - 1e-9) / both if both else 1.0


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """How much of two strings agrees; 0 where that is less than `least`, or where one is null."""
    return pd.Series([likeness(a, b, x) if a is not None and b is not None else 0.0 for a, b, x in zip(left, right, least)], dtype=float)


def scored_pairs(rows: DataFrame, key: str, least: float = THRESHOLD) -> DataFrame:
    """(key, i, j, score): how similar the facts of two lists (key, expected, observed) are, where that is `least` or more: 1 where one
    holds the other, else shared words, or four fifths of the characters that agree. Characters are compared only where
    the lengths allow for more than the words give. Null lists have no facts."""
    each = lambda c, at: rows.select(key, F.posexplode(c).alias(at, "t")).select(key, at, F.lower(F.trim("t")).alias(f"{at}_low"), collapsed(F.lower("t")).alias(f"{at}_held"), F.filter(F.array_distinct(F.split(plain_normal(F.col("t")), " ")), lambda w: F.length(w) >= 4).alias(f"{at}_words"))
    met = each("expected", "i").join(each("observed", "j"), key)
    filled = (F.col("i_held") != "") & (F.col("j_held") != "")
    held = filled & (F.contains("i_held", "j_held") | F.contains("j_held", "i_held"))
    words = F.coalesce(F.try_divide(F.size(F.array_intersect("i_words", "j_words")).cast("double"), F.least(F.size("i_words"), F.size("j_words"))), F.lit(0.0))
    shorter, both = F.least(F.length("i_low"), F.length("j_low")), F.length("i_low") + F.length("j_low")
    # lists of one are steps of their own: else words are met, and characters compared, again wherever the outcome is used
    known = F.array(F.struct(F.when(held, 1.0).otherwise(words).alias("sure"), (1.6 * shorter / F.greatest(both, F.lit(1))).alias("most")))
    met = met.select(key, "i", "j", "i_low", "j_low", F.inline(known)).where(F.greatest("sure", "most") >= least)
    needed = F.greatest("sure", F.lit(least - 1e-9))
    ask = lambda c: F.when(F.col("most") > needed, F.col(c))
    met = met.select(key, "i", "j", "sure", _ratio(ask("i_low"), ask("j_low"), needed / 0.8).alias("ratio"))
    return met.select(key, "i", "j", F.explode(F.array(F.greatest("sure", 0.8 * F.col("ratio")))).alias("score")).where(F.col("score") >= least)


def one_to_one(pairs: DataFrame, key: str) -> DataFrame:
    """The rows of `pairs` (key, i, j, score) in which each i, in order, gets the best j that no earlier i has; ties: the
    first j.

    All i ask at once, each for the best j that it has left, and a j stays with the first i that asks; an i loses every
    pair whose j is held by an earlier one. When nobody asks in vain, that is what taking turns would give: the matching is
    the only stable one. So a round is two aggregates and a join, however many lists there are, and none is held whole."""
    scratch = Scratch(pairs.sparkSession, "one-to-one")
    left = scratch(pairs.select(key, "i", "j", "score"), "left")
    while True:
        best = left.groupBy(key, "i").agg(F.max(F.struct("score", (-F.col("j")).alias("back"))).alias("b")).select(key, "i", (-F.col("b.back")).alias("j"), "b.score")
        best = scratch(best, "best")
        held = scratch(best.groupBy(key, "j").agg(F.min("i").alias("first")), "held")
        if best.join(held, [key, "j"]).where("i > first").isEmpty():
            scratch.drop("left", "held")
            return best
        left = scratch(left.join(held, [key, "j"], "left").where("first is null or i <= first").select(key, "i", "j", "score"), "left")
        scratch.drop("left", "best", "held", keep=1)


def match_metrics(rows: DataFrame, key: str) -> DataFrame:
    """(key, matched, expected, predicted, precision, recall, f1) of (key, expected, observed) lists of facts, matched one to
    one. Keys are unique. The lists are staged, so that they are made once."""
    rows = Scratch(rows.sparkSession, "facts")(rows.select(key, "expected", "observed"), "lists")
    found = one_to_one(scored_pairs(rows, key), key).groupBy(key).agg(F.count("*").cast("int").alias("matched"))
    n = rows.select(key, F.size("expected").alias("expected"), F.size("observed").alias("predicted")).join(found, key, "left").fillna(0, "matched")
    part = lambda c: F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col(c)), F.lit(0.0))
    n = n.withColumns({"recall": part("expected"), "precision": part("predicted")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return n.select(key, "matched", "expected", "predicted", "recall", "precision", f1.alias("f1"))


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of `n` characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def similar_terms(expected: DataFrame, generated: DataFrame, key: str, within: float = WITHIN, scratch: Scratch | None = None) -> DataFrame:
    """(key, i, j, score) of the terms (key, i, term) and (key, j, term) that are alike: 1 where they are equal in their normal form, `within`
    where one holds the other, else the ratio of characters that agree, if it is 0.9 or more. Blank terms are like none.

    A key's terms meet in one task, each dealt out once; only those of keys that have more than MOST_LISTED on a side meet by their runs
    of characters, in joins. Terms are staged first, unless they are already, in `scratch`."""
    own = scratch or Scratch(expected.sparkSession, "terms")
    left, right = (expected, generated) if scratch else (own(expected.select(key, "i", "term"), "left"), own(generated.select(key, "j", "term"), "right"))
    sizes = (d.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MOST_LISTED).select(key) for d in (left, right))
    large = own(reduce(DataFrame.union, sizes).where(F.col(key).isNotNull()).distinct(), "large")
    n = large.count()
    held = F.broadcast(large) if n <= MOST_RUNS else merged(large)
    side = lambda d, at: d.select(key, at, glossary_normal(F.col("term")).alias("t")).where(f"t <> '' and {at} is not null")
    many = [own(side(d.join(held, key, "left_semi"), at), f"large-{at}") for d, at in ((left, "i"), (right, "j"))]
    few = [side(d.join(held, key, "left_anti") if n else d, at) for d, at in ((left, "i"), (right, "j"))]
    out = own(_listed(*few, key, within).union(_by_runs(own, *many, key, within)), "alike")
    own.drop("left", "right", "large", "large-i", "large-j", "a", "b", "often")
    return out


def _listed(left: DataFrame, right: DataFrame, key: str, within: float) -> DataFrame:
    """similar_terms of (key, i, t) and (key, j, t), terms in their normal form, of which no key has many."""
    none = lambda d, at: F.lit(None).cast(d.schema[at].dataType).alias(at)
    both = left.select(key, "i", none(right, "j"), "t").union(right.select(key, none(left, "i"), "j", "t")).where(F.col(key).isNotNull())
    rows = both.repartition(key).sortWithinPartitions(key, F.col("i").isNull()).select(key, F.xxhash64(key).alias("same"), "i", "j", "t")
    return rows.mapInArrow(lambda batches: listed_pairs(batches, within), StructType([rows.schema[key], rows.schema["i"], rows.schema["j"], StructField("score", DoubleType())]))


def listed_pairs(batches: Iterator[pa.RecordBatch], within: float) -> Iterator[pa.RecordBatch]:
    """(key, i, j, score) of the terms that are alike among a task's rows (key, same, i, j, t): those of a key come one after
    another, of the left side (i) first, with an equal `same`."""
    rest = None

    def told(rows: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        terms, right = rows.column("t").to_pylist(), np.cumsum(np.r_[0, rows.column("i").is_null().to_numpy()])
        found: list[tuple] = []

        def frame() -> pa.RecordBatch:
            i, j, score = zip(*found)
            found.clear()
            out = [rows.column(0).take(pa.array(i)), rows.column("i").take(pa.array(i)), rows.column("j").take(pa.array(j)), pa.array(score)]
            return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], [rows.column_names[0], "i", "j", "score"])

        for start, end in zip([0, *ends], ends):
            middle = end - int(right[end] - right[start])
            places = defaultdict(list), defaultdict(list)
            for of, place in ((range(start, middle), places[0]), (range(middle, end), places[1])):
                for at in of:
                    place[terms[at]].append(at)
            for x, y, score in alike(places[0], places[1], within):
                for i in places[0][x]:
                    found += ((i, j, score) for j in places[1][y])
                if len(found) > FRAME:
                    yield frame()
        if found:
            yield frame()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
        same = rows.column("same").to_numpy()
        ends = (np.flatnonzero(same[1:] != same[:-1]) + 1).tolist()
        yield from told(rows, ends)
        rest = rows.slice(ends[-1]) if ends else rows
    if rest is not None and len(rest):
        yield from told(rest, [len(rest)])


def _laid(terms: Iterable[str]) -> tuple[list[str], list[int], str, list[int]]:
    """Distinct terms from short to long, their lengths, the text of all of them, and where each starts in it."""
    terms = sorted(terms, key=len)
    sizes = [len(t) for t in terms]
    return terms, sizes, "\n".join([*terms, ""]), [0, *accumulate(n + 1 for n in sizes)]


def _holders(part: str, laid: tuple, least: int) -> Iterator[str]:
    """The terms of `least` characters or more that hold a part."""
    terms, sizes, text, starts = laid
    at = text.find(part, starts[bisect_left(sizes, least)])
    while at >= 0:
        k = bisect_right(starts, at) - 1
        yield terms[k]
        at = text.find(part, starts[k + 1])


def alike(left: Iterable[str], right: Iterable[str], within: float) -> Iterator[tuple[str, str, float]]:
    """(x, y, score) of the distinct terms x and y that are alike, 0.9 or more, as similar_terms has it. Terms hold no line ends.

    Terms with u characters in which they differ, at most a tenth of both lengths, agree in runs: each of the u touches one of x's u + 1
    parts at most, so one part stands whole in y, moved by no more characters than one of them may have of its own. No
    more than u of x's pairs of characters are missing there either."""
    xs, ys = _laid(left), _laid(right)
    for x, n in zip(xs[0], xs[1]):
        sure = set()
        for y in _holders(x, ys, n):
            sure.add(y)
            score = 1.0 if x == y else within
            if score >= 0.9:
                yield x, y, score
        # with y as long as a ratio of 0.9 allows, both have 20/9 of the length of x, and differ in a tenth of that
        first, last = bisect_left(ys[1], -(-9 * n // 11)), bisect_right(ys[1], 11 * n // 9)
        parts = 2 * n // 9 + 1
        if parts == 1 or first == last:
            continue
        terms, sizes, text, starts = ys
        for k in range(parts):
            a, z = n * k // parts, n * (k + 1) // parts
            at = text.find(x[a:z], starts[first], starts[last])
            while at >= 0:
                to = bisect_right(starts, at) - 1
                y, m = terms[to], sizes[to]
                agreed = -(-9 * (n + m) // 20)
                moved = at - starts[to] - a
                if y in sure or moved > m - agreed:
                    at = text.find(x[a:z], starts[to + 1], starts[last])
                    continue
                if moved >= agreed - n:
                    sure.add(y)
                    if y not in x and _in_place(x, y, agreed) and (score := likeness(x, y, 0.9)) >= 0.9:
                        yield x, y, score
                at = text.find(x[a:z], at + 1, starts[last])
    if within >= 0.9:
        for y, m in zip(ys[0], ys[1]):
            for x in _holders(y, xs, m + 1):
                yield x, y, within


def _in_place(x: str, y: str, agreed: int) -> bool:
    """Whether so many of x's pairs of characters stand in y, near their place, that `agreed` characters may agree."""
    n, m = len(x), len(y)
    back, on, left = n - agreed, m - agreed + 2, n + m - 2 * agreed
    for a in range(0, n - 1, 2):
        if y.find(x[a : a + 2], max(0, a - back), a + on) < 0:
            left -= 1
            if left < 0:
                return False
    return True


def _by_runs(scratch: Scratch, left: DataFrame, right: DataFrame, key: str, within: float) -> DataFrame:
    """similar_terms of staged (key, i, t) and (key, j, t), terms in their normal form.

    No term is held against all others. Two terms with u characters in which they differ, at most a tenth of both lengths, agree in u + 1
    runs at most, of which one has three characters or more: they share a run of three. Besides, u changes break three such runs
    each, so of the 3u + 1 runs of a term that are rarest one is in the other. A term that is held by another has its rarest run in it."""
    runs = lambda d, at: d.select(key, at, F.length("t").alias("n"), F.explode(_grams(F.col("t"), 3)).alias("gram"))
    a, b = scratch(runs(left, "i"), "a"), scratch(runs(right, "j"), "b")
    often = scratch(a.select("gram").union(b.select("gram")).groupBy("gram").agg(F.count("*").alias("df")), "often")
    often = F.broadcast(often) if often.count() <= MOST_RUNS else merged(often)
    ranked = lambda d, at: d.join(often, "gram").withColumn("rank", F.row_number().over(Window.partitionBy(key, at).orderBy("df", "gram")))
    # with the other term as long as a ratio of 0.9 allows, both have 20/9 of this one's length, and differ in a tenth of that
    probes = ranked(a, "i").where(F.col("rank") <= 3 * F.floor(F.col("n") * 2 / 9) + 1).select(key, "i", "gram")
    met = probes.join(merged(b.select(key, "j", "gram")), [key, "gram"]).select(key, "i", "j")
    held = ranked(b, "j").where("rank = 1").select(key, "j", "gram").join(merged(a.select(key, "i", "gram")), [key, "gram"]).select(key, "i", "j")
    equal = left.join(merged(right), [key, "t"]).select(key, "i", "j")
    # terms of one or two characters are looked for among runs of their length
    short = lambda few, many, at, to: few.where("length(t) < 3").select(key, at, F.col("t").alias("gram")).join(merged(many.select(key, to, F.explode(F.concat(_grams(F.col("t"), 1), _grams(F.col("t"), 2))).alias("gram"))), [key, "gram"]).select(key, "i", "j")
    pairs = met.union(held).union(equal).union(short(left, right, "i", "j")).union(short(right, left, "j", "i")).distinct()
    told = pairs.join(merged(left.withColumnRenamed("t", "x")), [key, "i"]).join(merged(right.withColumnRenamed("t", "y")), [key, "j"])
    sure = F.when(F.col("x") == F.col("y"), 1.0).when(F.contains("x", "y") | F.contains("y", "x"), within)
    near = 2 * F.least(F.length("x"), F.length("y")) >= 0.9 * (F.length("x") + F.length("y")) - 1e-9
    told = told.withColumn("sure", sure).where(F.col("sure").isNotNull() | near)
    ask = lambda c: F.when(F.col("sure").isNull(), F.col(c))
    return told.select(key, "i", "j", F.coalesce("sure", _ratio(ask("x"), ask("y"), F.lit(0.9))).alias("score")).where("score >= 0.9")


def term_metrics(expected: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """(key, expected, generated, found, recall, precision, f1, hit_all) for every key of either side: a term is found if a generated one is like
    it; several may be found by the same one."""
    scratch = Scratch(expected.sparkSession, "terms")
    expected, generated = scratch(expected.select(key, "i", "term"), "expected"), scratch(generated.select(key, "j", "term"), "generated")
    found = similar_terms(expected, generated, key, scratch=scratch).select(key, "i").distinct().groupBy(key).agg(F.count("*").alias("found"))
    n = scratch(expected.groupBy(key).agg(F.count("*").alias("expected")).join(generated.groupBy(key).agg(F.count("*").alias("generated")), key, "full"), "counts")
    scratch.drop("expected", "generated")
    return _rated(n.join(merged(found), key, "left").fillna(0, ["expected", "generated", "found"]), key)


def _rated(n: DataFrame, key: str) -> DataFrame:
    part = lambda c: F.coalesce(F.try_divide(F.col("found").cast("double"), F.col(c)), F.lit(0.0))
    n = n.withColumns({"recall": part("expected"), "precision": part("generated")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return n.select(key, "expected", "generated", "found", "recall", "precision", f1.alias("f1"), ((F.col("expected") > 0) & (F.col("found") >= F.col("expected"))).alias("hit_all"))


def listed_term_metrics(rows: DataFrame, key: str) -> DataFrame:
    """term_metrics of lists of terms that stand side by side: (key, expected, generated). They meet in their row; only those of keys
    that several rows have, of null keys, and of more than MOST_BESIDE terms are dealt out by key."""
    scratch = Scratch(rows.sparkSession, "listed")
    held = lambda keys: F.broadcast(keys) if keys.count() <= MOST_RUNS else merged(keys)
    again = scratch(rows.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").select(key), "again")
    once = rows if again.isEmpty() else rows.where(F.col(key).isNotNull()).join(held(again), key, "left_anti")
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long")
    sized = once.select(key, "expected", "generated", size("expected").alias("n"), size("generated").alias("m"))
    few = (F.col("n") <= MOST_BESIDE) & (F.col("m") <= MOST_BESIDE)
    sides = sized.select(key, "n", "m", *(F.when(few, F.transform(c, glossary_normal)).alias(c) for c in ("expected", "generated")), few.alias("few"))
    kinds = StructType([sides.schema[key], *(StructField(c, LongType()) for c in ("expected", "generated", "found"))])
    told = scratch(sides.where("n + m > 0").mapInArrow(found_beside, kinds), "told")
    out = _rated(told.where("found is not null"), key)
    rest = scratch(again.union(told.where("found is null").select(key)), "rest")
    if not rest.isEmpty():
        rest = rows.join(held(rest), key, "left_semi").union(rows.where(F.col(key).isNull()))
        out = out.union(term_metrics(*(rest.select(key, F.posexplode(c).alias(at, "term")) for c, at in (("expected", "i"), ("generated", "j"))), key))
    scratch.drop("again", "rest")
    return out


def found_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, expected, generated, found) of rows (key, n, m, expected, generated, few), lists of terms in their normal form: how many of
    the first have one like them in the second; null where a row has not `few` terms."""
    for batch in batches:
        found = []
        for few, expected, generated in zip(*(batch.column(c).to_pylist() for c in ("few", "expected", "generated"))):
            if few:
                ys = {*filter(None, generated or ())}
                here = {*filter(None, expected or ())}
                met = here & ys
                met |= {x for x, _, _ in alike(here - met, ys, WITHIN)}
                found.append(sum(x in met for x in expected or ()))
            else:
                found.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], [batch.schema.names[0], "expected", "generated", "found"])


@F.pandas_udf(LINES)
def _lines(expected: pd.Series, actual: pd.Series) -> pd.DataFrame:
    def one(a, b):
        m = difflib.SequenceMatcher(None, a.split("\n") if a else [], b.split("\n") if b else [], autojunk=False)
        n = {"insert": 0, "delete": 0, "replace": 0, "equal": 0}
        for kind, i, j, k, e in m.get_opcodes():
            n[kind] += max(j - i, e - k)
        return m.ratio(), max(x.size for x in m.get_matching_blocks()), n["insert"], n["delete"], n["replace"]

    return pd.DataFrame([one(a or "", b or "") for a, b in zip(expected, actual)], columns=["line_ratio", *COUNTS])


def line_normal(text: Column) -> Column:
    """Line ends as \\n, lines without blanks at their ends, the text without any round it."""
    x = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.btrim(x, F.lit(" \t\n"))


def compared_lines(expected: Column, actual: Column) -> Column:
    """How the lines of two texts differ, as a struct; a null text has none."""
    return _lines(line_normal(expected), line_normal(actual))
