"""Conversation repair against a plain search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import conversations as cv
from tests.conftest import SF

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Least (cost, audit) of edits that make the initials fit, with the lines that they leave, by uniform-cost search."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, made, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, lines
        key = (i, made[-1:] if made[-1:] != "s" or len(made) == 1 else "!")
        if key in seen:
            continue
        seen.add(key)
        moves = [(3, "I", i, r, r + ":") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            moves.append((4, "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                moves.append((more, "K", i + 1, role, f"{role}:{text}"))
                moves += [(3 + more, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for more, edit, j, role, line in moves:
            now = made + role[:1] if line is not None else made
            if line is not None and role == "":
                continue
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, audit + edit, j, now, lines + ((line,) if line is not None else ())))


def brute(rows):
    """conv_id -> the contract's columns, from rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        c = convs.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw:
            row = (turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
            c.extend([row] * (2 if draw == 3 else 1))
    out = {}
    for conv, c in convs.items():
        c.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in c:
            marks = SPACE.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in c if t is not None}
        cost, audit, lines = cheapest(faulty)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(faulty)]
        count = {f: sum(r[2] == f for r in faulty) for f in ("blank", "duplicate", "truncated")}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(spark_rows, rows):
    got = {r["conv_id"]: tuple(r[c] for c in (*cv.STATS, "cost", "audit", "repaired_sha256")) for r in spark_rows}
    assert len(got) == len(spark_rows)
    assert got == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    same(cv.repair(df).collect(), [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("piece", [256, 2])
def test_odd_rows(spark, monkeypatch, piece):
    """Nulls, odd roles, ties, repeated rows, long conversations; with small pieces signatures are cut often."""
    monkeypatch.setattr(cv, "PIECE", piece)
    rng = random.Random(piece)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "u", "Ü"], ["Yes.", "no", "", None, " \t\n", "a?\n", "Ünd!", "x" * 5000, "dup.", "　"]
    rows = [(conv if conv else None, rng.choice([None, *range(7)]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for conv in range(150) for _ in range(rng.randrange(1, 9))]
    rows += [(1000, t, rng.choice(roles[:3]), f"{t}{rng.choice('.,')}") for t in range(700)] + [(1001, t, rng.choice(roles[:3]), f"{t}.") for t in range(30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    same(cv.repair(df).collect(), rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cv.repair(df).count() == 0


def test_a_node_is_solved_once(spark, monkeypatch):
    """Signatures with one suffix share its nodes."""
    calls = []
    real = cv.solve_node
    monkeypatch.setattr(cv, "solve_node", lambda s, a, e=None: calls.append(s) or real(s, a, e))
    words = ["".join(w) for w in itertools.product("ua", repeat=6)]
    path, before = [cv.solve_node(None, [])], ""
    for word in sorted(words):
        shared = next((i for i, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
        del path[shared + 1 :]
        for symbol in word[shared:]:
            path.append(cv.solve_node(symbol, path[-1]))
        before = word
    assert len(calls) == 1 + sum(2**k for k in range(1, 7))
