"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation's signature has one symbol a row: its role and its fault. Signatures that end alike are repaired alike from
there on, whatever came before. So the distinct signatures of all conversations are brought in order of their reversals,
in which those that share a suffix are neighbours; a task walks along them and keeps the path of the automaton from the end
to the present node. Each node, that is each distinct suffix, is solved once: for every state of the grammar the least
cost from there to the end, and the edit with which the best audit goes on. Conversations get the audit of their signature by a
join, and their rows are then repaired in one ordered pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.session import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = r"\x20\x09-\x0D"
# grammar (s?(ua)+)?: its states are the start, after s, after u and after a; what a state expects, and where that leads
START, AFTER_S, AFTER_U, AFTER_A = range(4)
EXPECTED, FOLLOWING = "uuau", (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = {"u": "user", "a": "assistant"}
# symbols: a row that has to go; sound rows by the initial of their role (x: any other); the same, truncated
GONE, SOUND, CUT = "-", "suax", "SUAX"
# symbols of the last piece of a signature; the pieces before it hold twice as many each
PIECE = 256
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged(df: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, live) after damage, nulls of role and text as one space. A row that is dropped
    stays with live = false, so that its conversation is known; a repeated row is there twice."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = df.select("conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"), F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), draw.alias("draw"))
    twice = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("draw") != 0).alias("live"), F.explode(twice).alias("__again")).drop("__again")


def ordered_light(rows: DataFrame) -> DataFrame:
    """Rows without their texts: place in order (turn, nulls first; ties by role, then by the text's digest), blank, truncated,
    and whether role and text were seen before. Each conversation is in one partition, in order."""
    last = F.regexp_extract("text", rf"(?s)([^{SPACES}])[{SPACES}]*$", 1)
    light = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "live")
    before = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "live").orderBy("turn")) > 1
    return light.repartition("conv_id").withColumn("duplicate", before).sortWithinPartitions("conv_id", "turn", "role", "digest")


def _same(a: pa.Array) -> np.ndarray:
    """For every place but the first whether its value is that before it; null equals null."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    eq = pc.equal(x, y).fill_null(False).to_numpy(zero_copy_only=False)
    return eq | (x.is_null().to_numpy(zero_copy_only=False) & y.is_null().to_numpy(zero_copy_only=False))


def signatures(light: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, the counts of STATS, and its signature.

    A task reads its ordered rows batch by batch and keeps only the counts and the signature, a byte a row, of the present
    conversation, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column("conv_id")
            starts = np.flatnonzero(np.r_[True, ~_same(conv)])
            role, turn = batch.column("role").to_pylist(), batch.column("turn").to_pylist()
            blank, dup, cut, live = (batch.column(c).to_pylist() for c in ("blank", "duplicate", "truncated", "live"))
            done = []
            for i, j in zip(starts, [*starts[1:], len(batch)]):
                key = conv[int(i)].as_py()
                if held is None or held["conv_id"] != key:
                    if held is not None:
                        done.append(held)
                    held = {"conv_id": key, "counts": [0, 0, 0, 0], "first": None, "last": None, "turns": 0, "initial": None, "signature": []}
                counts, signature = held["counts"], []
                for r in range(i, j):
                    if not live[r]:
                        continue
                    if turn[r] is not None and turn[r] != held["last"]:
                        held["turns"] += 1
                        held["first"], held["last"] = turn[r] if held["first"] is None else held["first"], turn[r]
                    initial = role[r][:1]
                    if held["initial"] is not None and held["initial"] + initial not in ("su", "ua", "au"):
                        counts[3] += 1
                    held["initial"] = initial
                    if blank[r] or dup[r]:
                        counts[0 if blank[r] else 1] += 1
                        signature.append(GONE)
                        continue
                    counts[2] += cut[r]
                    at = SOUND.find(initial) if initial else -1
                    signature.append((CUT if cut[r] else SOUND)[at if at >= 0 else 3])
                held["signature"].append("".join(signature))
            if done:
                yield table(done)
        if held is not None:
            yield table([held])

    def table(found: list[dict]) -> pa.RecordBatch:
        gaps = [0 if h["first"] is None else h["last"] - h["first"] + 1 - h["turns"] for h in found]
        return pa.RecordBatch.from_arrays([pa.array([h["conv_id"] for h in found], kind), pa.array(gaps, pa.int64()), *(pa.array([h["counts"][k] for h in found], pa.int64()) for k in range(4)), pa.array(["".join(h["signature"]) for h in found], pa.string())], names=names)

    field = light.schema["conv_id"].dataType
    kind, names = to_arrow_type(field), ["conv_id", *STATS, "signature"]
    return light.mapInArrow(run, f"conv_id {field.simpleString()}, {', '.join(f'{s} long' for s in STATS)}, signature string")


def solve_node(symbol: str | None, after: list[tuple], end: list[tuple] | None = None) -> list[tuple]:
    """(cost to the end, edit, state that it leads to, whether it consumes the row) for each state of the grammar at a node.

    `after` has the same for the node behind `symbol`. Edits of a node differ in their letters, and all but Keep cost
    something, so among the cheapest the one with the least letter begins the ASCII-least audit. Inserts stay at the node:
    two of them lead back to where they began at a cost, so two rounds over the states settle them. At the end of the rows
    (`symbol` is None) `end` holds what follows there, if anything does."""
    best: list[tuple | None] = [None] * 4
    for state in range(4):
        options = []
        if symbol is None:
            if end is not None:
                options.append((end[state][0], "", state, True))
            elif state in (START, AFTER_A):
                options.append((0, "", state, True))
        else:
            options.append((DELETE + after[state][0], "D", state, True))
            if symbol != GONE:
                more, to = TRUNCATED * symbol.isupper(), FOLLOWING[state]
                options.append((REROLE + more + after[to][0], "R", to, True))
                if symbol.lower() == EXPECTED[state]:
                    options.append((KEEP + more + after[to][0], "K", to, True))
                elif symbol.lower() == "s" and state == START:
                    options.append((KEEP + more + after[AFTER_S][0], "K", AFTER_S, True))
        best[state] = min(options, key=lambda o: o[:2], default=None)
    for _ in range(4):
        for state in range(4):
            to = FOLLOWING[state]
            if best[to] is not None:
                by_insert = (INSERT + best[to][0], "I", to, False)
                if best[state] is None or by_insert[:2] < best[state][:2]:
                    best[state] = by_insert
    return best


def _walk(path: list[list[tuple]], state: int) -> tuple[str, int]:
    """The best audit from the first node of a path (the last of the list) on to its end, and the state there."""
    out, at = [], len(path) - 1
    while True:
        _, edit, state, consumed = path[at][state]
        out.append(edit)
        if consumed:
            if not at:
                return "".join(out), state
            at -= 1


def solved(pieces: DataFrame) -> DataFrame:
    """`pieces` (piece, tail, ends: costs at the tail for each state, null at the end of the conversations) with `best`: for each state the cost,
    the audit of the piece and the state behind it.

    Rows come to a task by ranges of tail and reversed piece. The path from the tail to the present piece stays; for the next
    piece only the nodes beyond the shared suffix are solved."""
    dealt = pieces.withColumn("reversed", F.reverse("piece")).repartitionByRange("tail", "reversed").sortWithinPartitions("tail", "reversed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tail, path = "", (), []
        for batch in batches:
            best = []
            for word, own, ends in zip(batch.column("reversed").to_pylist(), batch.column("tail").to_pylist(), batch.column("ends").to_pylist()):
                if own != tail:
                    path, before, tail = [solve_node(None, [], None if ends is None else [(c,) for c in ends])], "", own
                shared = 0
                while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                    shared += 1
                del path[shared + 1 :]
                for symbol in word[shared:]:
                    path.append(solve_node(symbol, path[-1]))
                before = word
                walks = [_walk(path, state) for state in range(4)]
                best.append([{"cost": path[-1][s][0], "audit": audit, "state": to} for s, (audit, to) in enumerate(walks)])
            kept = [batch.column(c) for c in ("piece", "tail")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, kind)], names=["piece", "tail", "best"])

    kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("state", pa.int32())]))
    return dealt.select("reversed", "piece", "tail", "ends").mapInArrow(run, "piece string, tail string, best array<struct<cost:long,audit:string,state:int>>")


def audits(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(signature, cost, audit) of every distinct signature.

    Signatures of up to PIECE symbols are one piece. Longer ones are cut from the end into pieces of PIECE, 2 PIECE,
    4 PIECE... symbols, which are solved one after the other, each over what lies behind it: conversations of any
    length take a number of rounds that is the logarithm of their length, and pieces with equal tails stay shared."""
    left = scratch(found.select("signature").distinct().select("signature", F.col("signature").alias("rest"), F.lit("").alias("tail"), F.lit(None).cast("array<struct<cost:long,audit:string>>").alias("so_far")), "left")
    done, size = [], PIECE
    while True:
        cut = left.select("*", F.expr(f"right(rest, {size})").alias("piece"), F.expr(f"left(rest, greatest(length(rest) - {size}, 0))").alias("before"), F.when(F.col("so_far").isNotNull(), F.transform("so_far", lambda x: x["cost"])).alias("ends"))
        made = scratch(solved(cut.groupBy("tail", "piece").agg(F.first("ends").alias("ends"))), "solved")
        joined = cut.join(made, ["tail", "piece"])
        behind = F.transform("best", lambda b: F.struct(b["cost"].alias("cost"), F.concat(b["audit"], F.coalesce(F.element_at(F.col("so_far"), b["state"] + 1)["audit"], F.lit(""))).alias("audit")))
        grown = scratch(joined.select("signature", F.col("before").alias("rest"), F.md5(F.concat("tail", F.lit("/"), "piece")).alias("tail"), behind.alias("so_far")), "left")
        done.append(grown.where("rest = ''").select("signature", F.col("so_far")[0]["cost"].alias("cost"), F.col("so_far")[0]["audit"].alias("audit")))
        left, size = grown.where("rest <> ''"), 2 * size
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` (a row per conversation, with its audit) with repaired_sha256.

    Each conversation's row goes before its live rows in the order of the signature; a task follows the audit along them
    and hashes line by line, so no conversation is ever held whole."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.struct(*found.columns).alias("head"))
    body = rows.where("live").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text", F.lit(None).cast(head.schema["head"].dataType).alias("head"))
    lined = head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("kind", "role", "text", "head")

    def inserts(now: dict) -> None:
        while now["audit"][now["at"] : now["at"] + 1] == "I":
            line(now, ROLES[EXPECTED[now["state"]]], "")
            now["state"] = FOLLOWING[now["state"]]
            now["at"] += 1

    def line(now: dict, role: str, text: str) -> None:
        now["sha"].update((("\n" if now["lines"] else "") + role + ":" + text).encode())
        now["lines"] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for batch in batches:
            heads, shas = [], []
            for kind, role, text, at in zip(batch.column("kind").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), range(len(batch))):
                if kind == 0:
                    if now is not None:
                        heads.append(now["head"])
                        shas.append(now["sha"].hexdigest())
                    held = batch.column("head").slice(at, 1)
                    now = {"head": held, "audit": held[0]["audit"].as_py(), "at": 0, "state": START, "lines": False, "sha": hashlib.sha256()}
                    inserts(now)
                    continue
                edit, now["at"] = now["audit"][now["at"]], now["at"] + 1
                if edit == "R":
                    line(now, ROLES[EXPECTED[now["state"]]], text)
                    now["state"] = FOLLOWING[now["state"]]
                elif edit == "K":
                    line(now, role, text)
                    now["state"] = AFTER_S if role[:1] == "s" else FOLLOWING[now["state"]]
                inserts(now)
            if heads:
                yield out(heads, shas)
        if now is not None:
            yield out([now["head"]], [now["sha"].hexdigest()])

    def out(heads: list[pa.Array], shas: list[str]) -> pa.RecordBatch:
        whole = pa.concat_arrays([h if isinstance(h, pa.Array) else h.combine_chunks() for h in heads])
        return pa.RecordBatch.from_arrays([*whole.flatten(), pa.array(shas)], names=[*kinds, "repaired_sha256"])

    return lined.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", repaired_sha256 string")


def repair(df: DataFrame) -> DataFrame:
    """A row for every conv_id of `df`, null among them: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and
    repaired_sha256 of the repaired conversation.

    Null roles and texts are one space: such a text is blank, such a role has to be rewritten. Rows of one turn go by role, then
    by the md5 of their text. Repeated rows are rows of their own, and so duplicates. A conversation that loses all its rows has
    zeros, an empty audit and the hash of nothing; an empty table gives no rows. Texts may be of any length, conversations
    too: a task streams the one it is at. Other columns are not read."""
    scratch = Scratch(df.sparkSession, "conversations")
    rows = damaged(df)
    found = scratch(signatures(ordered_light(rows)), "signatures")
    by_signature = audits(found, scratch)
    told = scratch(found.join(by_signature, "signature").select("conv_id", *STATS, "cost", "audit"), "told")
    scratch.drop("signatures", "left", "solved")
    return repaired(rows, told)
