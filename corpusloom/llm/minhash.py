"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Two small collections of HALVES half-keys each, a half-key being ROWS minhashes, are enough for HALVES^2 tables: table
(i, j) has the pair of half-key i of the first collection and j of the second as its key. 2 * HALVES * ROWS minhashes do
what HALVES^2 * 2 * ROWS would in plain banding. At a similarity of s a link is met with probability
(1 - (1 - s^ROWS)^HALVES)^2.

A pair that meets is first held against SIGNATURE minhashes of six bits, which a pair at the threshold fails about once
in 14,000 times, then compared on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import per_text, slices
from corpusloom.llm.words import numbered
from corpusloom.operators.components import connected_components, local_stars
from corpusloom.session import Scratch

WORDS, PERCENT = 5, 75
HALVES, ROWS = 8, 2
# minhashes of the signature, eight to a long, and how many must agree; a pair at the threshold expects 96
SIGNATURE, LEAST_AGREE = 128, 78
# members of a bucket that are compared in one piece: a larger bucket is cut into blocks, which meet two by two
BLOCK = 2048
# pairs that are looked at in one go, and ids of at most so many texts that are handed to all tasks
PAIRS, BROADCAST_IDS = 500_000, 1_000_000
SIGNED = "n_shingles long, set_a long, set_b long, halves array<long>, signature array<long>"
SIX, SEVENTH = 0x3F3F3F3F3F3F3F3F, 0x4040404040404040
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the distinct word shingles of each text, sorted. A-Z are lower-cased, words end at
    ASCII white space; a text with fewer words than a shingle is one shingle, one without words has none."""
    doc, index, distinct = numbered([t.encode().lower() if t else b"" for t in texts.to_pylist()])
    word = _mixed(np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], U))[index]
    if not len(doc):
        return doc, word
    size = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(size)
    start = end - size
    first = np.arange(len(doc))
    full = first + words <= end[doc]
    short = (first == start[doc]) & (size[doc] < words)
    at = first[full]
    code = np.zeros(len(at), U)
    for k in range(words):
        code = _mixed(code + word[at + k])
    at_short, code_short = first[short], np.zeros(int(short.sum()), U)
    for k in range(words - 1):
        there = k < size[doc[at_short]]
        code_short = np.where(there, _mixed(code_short + word[np.minimum(at_short + k, len(word) - 1)]), code_short)
    code_short = _mixed(code_short + size[doc[at_short]].astype(U))
    doc, code = np.r_[doc[at], doc[at_short]], np.r_[code, code_short]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]
    return doc[new], code[new]


def sums(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Two sums over each text's shingles that together name the set."""
    out = np.zeros((2, n), U)
    if len(doc):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[:, doc[starts]] = np.add.reduceat(code, starts), np.add.reduceat(_mixed(code ^ U(0x5851F42D4C957F2D)), starts)
    return out


def sign(texts: pa.Array) -> list[pa.Array]:
    """The columns of SIGNED: the set's size, its two sums, its half-keys and its signature."""
    n, k = len(texts), 2 * HALVES * ROWS
    m = max(k, SIGNATURE)
    doc, code = shingles(texts)
    size = np.bincount(doc, minlength=n)
    mins = np.zeros((m, n), U)
    if len(doc):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = doc[starts]
        for j in range(m):
            seed = _mixed(np.array([2 * j + 1, 2 * j + 2], U))
            hashed = code * (seed[0] | U(1)) + seed[1]
            mins[j, own] = np.minimum.reduceat(_mixed(hashed) if j < k else hashed, starts)
    keys = np.zeros((2 * HALVES, n), U)
    for j in range(k):
        keys[j // ROWS] = _mixed(keys[j // ROWS] + mins[j])
    packed = np.ascontiguousarray((mins[:SIGNATURE] >> U(20) & U(63)).astype(np.uint8).T).view(np.int64)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys.T.view(np.int64) if n else np.empty((0, 2 * HALVES), np.int64), packed)]
    return [pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums(doc, code, n)), *lists]


def signed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return per_text(df.select(F.col(key).alias("id"), text), text, ("id",), SIGNED, sign, chars=1_500_000)


def buckets(sets: DataFrame) -> DataFrame:
    """(key, low, node): HALVES^2 table keys for each set. The last bits of a key are its table's number."""
    pair = [F.xxhash64(F.lit(i * HALVES + j), F.col("halves")[i], F.col("halves")[HALVES + j]).bitwiseAND(F.lit(-(HALVES**2))).bitwiseOR(F.lit(i * HALVES + j)) for i in range(HALVES) for j in range(HALVES)]
    return sets.select(F.explode(F.array(*pair)).alias("key"), "low", "node")


def shared_buckets(keys: DataFrame) -> DataFrame:
    """(key, node, pivot) for the keys that more than one node has; a bucket's pivot is its node with the smallest `low`.

    Rows are dealt out by ranges of key and node, so that a bucket of any size is spread over as many tasks as it needs, and
    pass a task in order. A bucket on the border of two tasks has a pivot in each. The first and the last row of a task
    always pass, since their bucket may go on in the next one."""
    ordered = keys.repartitionByRange("key", "low", "node").sortWithinPartitions("key", "low", "node").select("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: key, node, its bucket's pivot, whether the row before has its key
        for batch in batches:
            if not len(batch):
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if held:
                key, node = np.r_[held[0], key], np.r_[held[1], node]
            same = key[1:] == key[:-1]
            first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(key)), 0))
            pivot = node[first]
            if held:
                pivot[first == 0] = held[2]
            before = np.r_[held[3] if held else True, same]
            keep = (before | np.r_[same, False])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (key, node, pivot)], ["key", "node", "pivot"])
            held = key[-1], node[-1], pivot[-1], before[-1]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:3]], ["key", "node", "pivot"])

    return ordered.mapInArrow(run, "key long, node long, pivot long")


def agreeing(a: str, b: str) -> object:
    """How many of the SIGNATURE bytes of two signatures are equal. Bytes have six bits, so that adding 63 to the xor of
    two sets the seventh bit just where they differ."""
    differ = [F.bit_count((F.col(a)[i].bitwiseXOR(F.col(b)[i]) + F.lit(SIX)).bitwiseAND(F.lit(SEVENTH))) for i in range(SIGNATURE // 8)]
    return SIGNATURE - sum(differ[1:], differ[0])


def with_codes(df: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, codes): the whole shingle sets of nodes (node, low, set_a, set_b), made again from their texts. Only texts
    whose id some node has are read; few ids are handed to all tasks, many meet the texts in a join."""
    ids = nodes.select(F.col("low").alias("id")).distinct()
    ids = F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids.hint("merge")
    texts = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")

    def make(texts: pa.Array) -> list[pa.Array]:
        doc, code = shingles(texts)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        return [*(pa.array(x.view(np.int64)) for x in sums(doc, code, len(texts))), pa.ListArray.from_arrays(pa.array(cut), pa.array(code.view(np.int64)))]

    made = per_text(texts, "text", ("id",), "set_a long, set_b long, codes array<long>", make, chars=1_500_000)
    return made.withColumnRenamed("id", "low").join(nodes, ["low", "set_a", "set_b"]).select("node", "codes").dropDuplicates(["node"])


def enough(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with `both` in common are similar enough."""
    return (both > 0) & (100 * both >= PERCENT * (a + b - both))


def verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets are similar enough. The sets travel to the pairs in sort-merge joins,
    which AQE can split where one node has many pairs."""
    left = codes.select(F.col("node").alias("u"), F.col("codes").alias("a"))
    right = codes.select(F.col("node").alias("v"), F.col("codes").alias("b"))
    met = pairs.select("u", "v").join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= PERCENT * max(len(a), len(b)) else 0
                keep.append(bool(enough(np.int64(both), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "u long, v long")


def blocked(seats: DataFrame) -> DataFrame:
    """`seats` (key, members, node, ...) with one, other and own: a bucket of more than BLOCK members is cut into blocks,
    and a seat goes to each pair of blocks (one, other) that holds its own."""
    n = F.ceil(F.col("members") / BLOCK).cast("int")
    seats = seats.withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), n - 1)))
    return seats.withColumn("one", F.least("own", "o")).withColumn("other", F.greatest("own", "o")).drop("o", "members")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted batches as tables with the places where groups begin, and the table's length."""
    held: list[pa.RecordBatch] = []

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for c in by:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def last(b: pa.RecordBatch, at: int) -> tuple:
        return tuple(b.column(c)[at].as_py() for c in by)

    for batch in batches:
        if not len(batch):
            continue
        if held and last(held[0], 0) != last(batch, len(batch) - 1):
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            at = begins(t)
            yield t.slice(0, at[-1]), at
            held = t.slice(at[-1]).to_batches()
        else:
            held.append(batch)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.r_[begins(t), len(t)]


def in_groups(seats: DataFrame, run, schema: str) -> DataFrame:
    """What `run`(table, begins) gives for the groups of `blocked` seats. A group has 2 * BLOCK rows or so at most."""
    by = ["key", "one", "other"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, by):
            yield from run(t, at)

    return seats.repartition(*by).sortWithinPartitions(*by).mapInArrow(each, schema)


def _pairs_within(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs inside the groups that begin at at[:-1], about PAIRS at a time."""
    rows = np.arange(at[-1])
    left = np.repeat(at[1:], np.diff(at)) - rows - 1
    total = np.r_[0, np.cumsum(left)]
    start = 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, "right")) - 1)
        size = left[start:end]
        i = np.repeat(rows[start:end], size)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        start = end


def candidates(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The seats (key, one, other, own, node, c, n, halves, signature) that have a partner of another component in their
    group whose size and signature allow the similarity. A pair counts in one table only, that of the first half-keys which
    the two have in common, so that seats don't come back in every table they share."""
    c, n, own, one, other = (t.column(x).to_numpy() for x in ("c", "n", "own", "one", "other"))
    halves, signature = (t.column(x).combine_chunks().flatten().to_numpy().reshape(len(t), -1) for x in ("halves", "signature"))
    table = t.column("key").to_numpy() & (HALVES**2 - 1)
    kept = np.zeros(len(t), bool)
    for i, j in _pairs_within(at):
        fits = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & ((one[i] == other[i]) | (own[i] != own[j]))
        i, j = i[fits], j[fits]
        same = halves[i] == halves[j]
        fits = same[:, :HALVES].argmax(1) * HALVES + same[:, HALVES:].argmax(1) == table[i]
        i, j = i[fits], j[fits]
        differ = np.zeros(len(i), np.int64)
        for k in range(SIGNATURE // 8):
            differ += np.bitwise_count(((signature[i, k] ^ signature[j, k]) + SIX) & SEVENTH)
        fits = SIGNATURE - differ >= LEAST_AGREE
        kept[i[fits]] = kept[j[fits]] = True
    yield from t.select(["key", "one", "other", "own", "node", "c"]).filter(pa.array(kept)).to_batches()


def links_within(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(u, v): the components that links inside the groups of seats (..., c, codes) tie together, as stars. Every pair of
    different components is compared on whole sets, by counting along the members that have each shingle."""
    c, own, one, other = (t.column(x).to_numpy() for x in ("c", "own", "one", "other"))
    lists = t.column("codes").combine_chunks()
    starts, codes = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
    for a, b in zip(at[:-1], at[1:]):
        size = np.diff(starts[a : b + 1])
        _, code = np.unique(codes[starts[a] : starts[b]], return_inverse=True)
        member = np.repeat(np.arange(b - a), size)
        order = np.argsort(code, kind="stable")
        holders, place = member[order], np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
        base = starts[a : b + 1] - starts[a]
        found_u, found_v = [], []
        for i in range(b - a - 1):
            own_codes = code[base[i] : base[i + 1]]
            first, many = place[own_codes], place[own_codes + 1] - place[own_codes]
            at_holders = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both = np.bincount(holders[at_holders], minlength=b - a)[i + 1 :]
            hit = enough(both, size[i], size[i + 1 :]) & (c[a + i] != c[a + i + 1 : b]) & ((one[a] == other[a]) | (own[a + i] != own[a + i + 1 : b]))
            near = np.unique(c[a + i + 1 : b][hit])
            found_u.append(np.full(len(near), c[a + i]))
            found_v.append(near)
        if found_u:
            u, v = local_stars(np.concatenate(found_u), np.concatenate(found_v))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of `df`: its key, n_shingles, component_id (the smallest key that links reach), kept.

    Equal sets are one node, found by the two sums of their hashes; so rows that share a key and not a text are nodes of
    their own. In the buckets that more than one node has, each node is paired with the bucket's pivot. Of a node's pivots
    that sizes and signatures allow, the one that agrees best is compared on whole sets: that ties up most copies by a
    few links. Then no choice is made any more: in every bucket that still holds several components, all members of
    different components are held against each other by signature, in blocks, and those that may be similar on whole sets.
    A link is not needed where its ends are connected. What a bucket costs then grows with the square of those members that
    no link ties together; they are compared in place, and only links leave a block.

    Null and empty texts have no shingles and link with nothing; null keys link with nothing and have a null component.
    Repeated rows are one node. Other columns are not read; an empty table gives no rows."""
    scratch = Scratch(df.sparkSession, "minhash")
    rows = scratch(signed(df, key, text), "signed")
    whole = rows.where("n_shingles > 0 and id is not null")
    sets = whole.groupBy("set_a", "set_b").agg(F.min("id").alias("low"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("signature").alias("signature"))
    sets = scratch(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    members = scratch(shared_buckets(buckets(sets)), "members")

    nodes = members.select("node").distinct().join(sets.select("node", "low", "set_a", "set_b"), "node")
    codes = scratch(with_codes(df, scratch(nodes, "nodes"), key, text), "codes")
    end = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
    pairs = members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    pairs = pairs.join(end("u"), "u").join(end("v"), "v").where(100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v"))
    pairs = pairs.select("u", "v", agreeing("s_u", "s_v").alias("agree")).where(F.col("agree") >= LEAST_AGREE)
    best = pairs.groupBy("u").agg(F.max(F.struct("agree", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    links = scratch(verified(best, codes), "links")
    parts = scratch(connected_components(links), "parts")

    seats = members.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    seats = scratch(seats, "seats")
    mixed = seats.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    seats = seats.join(mixed, "key").join(sets.select("node", "n", "halves", "signature"), "node")
    seats = blocked(seats)
    seats = scratch(in_groups(seats, candidates, "key long, one int, other int, own int, node long, c long"), "candidates")
    found = scratch(in_groups(seats.join(codes.hint("merge"), "node"), links_within, "u long, v long"), "found")
    parts = connected_components(scratch(found.union(parts.select("node", "component")), "edges"))
    parts = scratch(parts, "parts")

    low = parts.join(sets.select("node", "set_a", "set_b", "low"), "node")
    named = low.join(low.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("set_a", "set_b", "component_id")
    copies = sets.select("set_a", "set_b", "low")
    named = copies.join(named, ["set_a", "set_b"], "left").select("set_a", "set_b", F.coalesce("component_id", "low").alias("component_id"))
    scratch.drop("members", "nodes", "codes", "links", "seats", "candidates", "found", "edges")
    scratch.drop("parts", keep=1)
    out = rows.join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    out = out.select(F.col("id").alias(key), "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
