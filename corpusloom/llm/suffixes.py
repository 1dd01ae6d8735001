"""Exact removal of long repeated byte strings by distributed prefix doubling over sampled suffixes.

Ranking the suffix at every byte would shuffle many times the corpus in each round. So suffixes are sampled where the text
itself decides: the anchor of a start p is the place of the least hash of GRAM bytes within the SPAN places from p on. Equal strings of
LENGTH bytes have their anchor at the same offset, and about one place in SPAN / 2 is an anchor. To say whether the string
at a start occurs elsewhere it is enough to compare anchors, at all offsets that belong to them.

Spark sorts the anchors by the rank of their next LENGTH - SPAN + 1 bytes, which every string of theirs covers. Unique ones drop out.
What is left is ranked by pairs of the rank so far and the next bytes, for ever narrower ranges of offsets: each round
adds bytes to the left and right of what is known to be equal, until a range is unique, has all its bytes equal, or a single string of LENGTH
bytes is left in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import slices
from corpusloom.session import Scratch

LENGTH, SPAN, GRAM = 200, 128, 16
# bytes from an anchor on that all strings of it hold
CORE = LENGTH - SPAN + 1
# offsets of a range in each round: what is known equal grows to LENGTH - range + 1 bytes
RANGES = (32, 8, 1)
# starts that are looked at in one piece, and bits of a place inside one
BLOCK, PLACE = 1 << 18, np.uint64(20)
U = np.uint64


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on; its low bits are left free."""
    n = len(data) - GRAM + 1
    low, high = (np.ndarray((n,), "<u8", data, offset=k, strides=(1,)) for k in (0, 8))
    h = low * U(0x9E3779B97F4A7C15) ^ (high + U(0x165667B19E3779F9)) * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) for each run of starts with one anchor, in the joined texts `data`, which end at
    `ends`. Starts are the places with LENGTH bytes of their text from there on; of equal hashes the first decides."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(data) - LENGTH + 1, BLOCK):
        starts = min(BLOCK, len(data) - LENGTH + 1 - s)
        h = _hashes(data[s : s + starts + SPAN + GRAM - 2])
        h = (h >> PLACE << PLACE) | np.arange(len(h), dtype=U)
        rows = -(-len(h) // SPAN)
        grid = np.full(rows * SPAN, np.iinfo(U).max, U)
        grid[: len(h)] = h
        grid = grid.reshape(rows, SPAN)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(after[:starts], before[SPAN - 1 : SPAN - 1 + starts]) & U((1 << 20) - 1)).astype(np.int64) + s
        p = np.arange(s, s + starts)
        text = np.searchsorted(ends, p, "right")
        valid = np.flatnonzero(p + LENGTH <= ends[text])
        if not len(valid):
            continue
        new = np.flatnonzero(np.r_[True, (np.diff(at[valid]) != 0) | (np.diff(valid) != 1)])
        found.append((at[valid[new]], p[valid[new]], p[valid[np.r_[new[1:] - 1, len(valid) - 1]]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, first, last = (np.concatenate(x) for x in zip(*found))
    # a run may go on from one block to the next
    new = np.r_[True, (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)]
    return at[new], first[new], last[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]


def sampled(docs: DataFrame) -> DataFrame:
    """(core, hull, text, at, low, high) of the anchors of `docs` (text, as bytes): hashes of the bytes that all strings of an anchor hold, and
    of those that any of them may hold; the text's digest, the anchor's place there, and the range of its offsets from a start.

    Each task leaves out texts that it has already had. What copies lose is settled by their number; for other texts
    one copy is as good as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                texts, names = [], []
                for t in part.column("text").to_pylist():
                    if len(t) >= LENGTH and (name := hashlib.md5(t).digest()) not in seen:
                        seen.add(name)
                        texts.append(t)
                        names.append(name)
                if not texts:
                    continue
                joined = b"".join(texts)
                size = np.array([len(t) for t in texts])
                ends = np.cumsum(size)
                at, first, last = anchors(np.frombuffer(joined, np.uint8), ends)
                text = np.searchsorted(ends, first, "right")
                begin = (ends - size)[text]
                core, hull = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
                view = memoryview(joined)
                cores, hulls = core.view(U), hull.view(U)
                for i, (a, b, e) in enumerate(zip(at.tolist(), begin.tolist(), ends[text].tolist())):
                    cores[i] = xxhash.xxh3_64_intdigest(view[a : a + CORE])
                    left = max(b, a - SPAN + 1)
                    hulls[i] = xxhash.xxh3_64_intdigest(view[left : min(e, a + LENGTH)], a - left)
                held = pa.array(names, pa.binary()).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(hull), held, pa.array((at - begin).astype(np.int32)), pa.array((at - last).astype(np.int16)), pa.array((at - first).astype(np.int16))], names=["core", "hull", "text", "at", "low", "high"])

    return docs.select("text").mapInArrow(run, "core long, hull long, text binary, at int, low short, high short")


def repeated_cores(found: DataFrame) -> DataFrame:
    """The rows of `found` whose core another row has as well.

    Spark deals the rows out by ranges of core, hull and text, so that a core that many rows have is spread over as many
    tasks as it needs, and each task reads its rows in order. The first and last core of a task may go on in the next, so their
    rows always pass."""
    dealt = found.repartitionByRange("core", "hull", "text", "at").sortWithinPartitions("core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alone, first = None, True, True  # the last row, whether it is the only one of its core so far, whether that core began the task
        for batch in batches:
            if not len(batch):
                continue
            core = batch.column("core").to_numpy()
            if held is not None:
                same = held.column("core")[0].as_py() == core[0]
                if same or not alone or first:
                    yield held
                first, alone = first and same, alone and not same
            change = np.r_[True, core[1:] != core[:-1]]
            if held is not None and same:
                change[0] = False
            again = ~change
            passes = again | np.r_[again[1:], False]
            if first:
                later = np.flatnonzero(change[1:]) + 1
                passes[: later[0] if len(later) else len(core)] = True
                first = not len(later)
            alone = bool(change[-1])
            held = batch.slice(len(batch) - 1)
            if len(batch) > 1:
                yield batch.slice(0, len(batch) - 1).filter(pa.array(passes[:-1]))
        if held is not None:
            yield held

    return dealt.mapInArrow(run, found.schema)


def _contexts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """`items` (core, hull, n, text, at, low, high) with `pre` and `post`: the bytes before the anchor, and from it on, that its strings may hold."""
    wanted = items.groupBy("text").agg(F.collect_list(F.struct("core", "hull", "n", "low", "high", "at")).alias("items"))
    met = docs.select(digest("text").alias("name"), F.col("text").alias("bytes")).join(wanted, F.col("name") == F.col("text")).select("name", "bytes", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch, "bytes"):
                rows = []
                for name, data, own in zip(part.column("name").to_pylist(), part.column("bytes").to_pylist(), part.column("items").to_pylist()):
                    if name != last:  # copies come one after the other
                        rows += [(x["core"], x["hull"], x["n"], x["low"], x["high"], data[max(0, x["at"] - SPAN + 1) : x["at"]], data[x["at"] : x["at"] + LENGTH]) for x in own]
                    last = name
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names, kinds = ["core", "hull", "n", "low", "high", "pre", "post"], (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.binary())
    return met.mapInArrow(run, "core long, hull long, n long, low short, high short, pre binary, post binary").dropDuplicates(["core", "hull"])


def _narrowed(open_: DataFrame, before: int, after: int) -> DataFrame:
    """(core, hull, n, low, high, begin, rank, name): each range of `before` offsets cut into the ranges of `after` offsets that its anchor has.

    The new rank is the digest of a pair: the old rank, and the bytes that all strings of the new range hold besides those of the old one. The name
    is that of all bytes that any string of the new range may hold."""
    cut = open_.select("*", F.explode(F.sequence(F.col("begin"), F.col("begin") + before - after, F.lit(after))).alias("to")).where(f"to <= high and to + {after} > low")
    # a range of `size` offsets from `begin` on holds `begin` bytes before the anchor and LENGTH - begin - size + 1 from it on in any case
    more_pre = F.expr("substring(pre, length(pre) - to + 1, to - begin)")
    more_post = F.expr(f"substring(post, {LENGTH} - begin - {before} + 2, begin + {before} - to - {after})")
    any_pre = F.expr(f"substring(pre, greatest(length(pre) - to - {after} + 2, 1), {SPAN})")
    any_post = F.expr(f"substring(post, 1, {LENGTH} - to)")
    text = lambda c: F.encode(F.concat(c.cast("string"), F.lit("/")), "utf-8")
    return cut.select("core", "hull", "n", "low", "high", F.col("to").alias("begin"), digest(F.concat("rank", text(F.col("to")), text(F.length(more_pre)), more_pre, more_post)).alias("rank"), digest(F.concat(text(F.length(any_pre)), any_pre, any_post)).alias("name"))


def digest(c) -> object:
    return F.unhex(F.md5(c))


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, begin, end): by text digest, bytes that strings of LENGTH bytes cover which occur elsewhere. `docs` (text, as bytes) is
    read twice. Texts that are copies of each other are taken as one."""
    found = scratch(sampled(docs), "anchors")
    left = scratch(repeated_cores(found), "repeated")
    scratch.drop("anchors")
    left = scratch(left.groupBy("core", "hull", "text", "at").agg(F.first("low").alias("low"), F.first("high").alias("high")), "places")
    hulls = scratch(left.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("text", "at", "low", "high")).alias("own")), "hulls")
    whole = left.join(hulls.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi")
    # staged, as below, so that the join's hot cores can be split
    several = scratch(hulls.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core"), "several")
    contexts = scratch(_contexts(hulls.join(several, "core", "left_semi").select("core", "hull", "n", "own.*"), docs), "contexts")
    open_, size, told = contexts.select("*", F.lit(0).alias("begin"), digest(F.expr(f"substring(post, 1, {CORE})")).alias("rank")), SPAN, []
    for narrower in RANGES:
        cut = scratch(_narrowed(open_, size, narrower), "cut")
        names = scratch(cut.groupBy("rank", "name").agg(F.sum("n").alias("seen"), F.min(F.struct("core", "hull")).alias("chosen")), "names")
        equal = cut.where("n = 1").join(names.where("seen > 1").select("rank", "name"), ["rank", "name"], "left_semi")
        told.append(scratch(equal.select("core", "hull", F.greatest("begin", "low").alias("low"), F.least(F.col("begin") + narrower - 1, "high").alias("high")), "told"))
        if narrower == 1:
            break
        # a rank whose strings may still differ goes on; of rows with the same name, one stands for all
        split = scratch(names.groupBy("rank").agg(F.count("*").alias("m")).where("m > 1").select("rank"), "split")
        on = cut.join(names.join(split, "rank", "left_semi"), ["rank", "name"]).where("seen = 1 or (chosen.core = core and chosen.hull = hull)")
        on = on.select("core", "hull", F.greatest("n", "seen").alias("n"), "low", "high", "begin", "rank")
        open_, size = scratch(on.join(contexts.select("core", "hull", "pre", "post"), ["core", "hull"]), "open"), narrower
        scratch.drop("cut", "names", "split")
        scratch.drop("open", keep=1)
    parts = reduce(DataFrame.union, told)
    # what stands alone in its hull has the hull's own place
    placed = parts.join(hulls.where("n = 1"), ["core", "hull"]).select("own.text", "own.at", parts["low"], parts["high"])
    runs = whole.select("text", "at", "low", "high").union(placed).select("text", (F.col("at") - F.col("high")).alias("begin"), (F.col("at") - F.col("low") + LENGTH).alias("end"))
    runs = scratch(runs, "runs")
    scratch.drop("repeated", "places", "hulls", "several", "contexts", "told", "open", "cut", "names")
    return runs


def dedupe(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of `df` as (key, n_bytes, spans, kept): maximal runs [start, end) of bytes that are covered by strings of LENGTH bytes that
    also start elsewhere, in the same text or another, and the bytes that remain.

    Texts are taken as UTF-8 bytes, null as none, of any length; strings never cross texts. Repeated rows are texts of
    their own, so copies of LENGTH bytes or more lose everything. Null and repeated keys are kept as they are; other
    columns are not read. An empty table gives no rows."""
    scratch = Scratch(df.sparkSession, "suffixes")
    rows = df.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"))
    long = rows.where(F.length("text") >= LENGTH)
    runs = repeats(long, scratch)
    copies = long.groupBy(digest("text").alias("text")).agg(F.count("*").alias("n")).where("n > 1").select("text", F.lit(0).alias("begin"), F.lit(2**31 - 1).alias("end"))
    told = scratch(runs.union(copies).groupBy("text").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("runs")), "told")
    scratch.drop("runs")
    met = rows.select("key", digest("text").alias("name"), F.col("text").alias("bytes")).join(told, F.col("name") == F.col("text"), "left").select("key", "bytes", "runs")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "bytes"):
                spans, kept = [], []
                for data, own in zip(part.column("bytes").to_pylist(), part.column("runs").to_pylist()):
                    merged: list[list[int]] = []
                    for x in own or ():
                        if merged and x["begin"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], min(x["end"], len(data)))
                        else:
                            merged.append([x["begin"], min(x["end"], len(data))])
                    edges = [0, *(e for m in merged for e in m), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([part.column("key"), pc.binary_length(part.column("bytes")).cast(pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return met.mapInArrow(run, f"`{key}` {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
