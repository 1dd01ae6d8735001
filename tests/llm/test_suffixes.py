"""Removal of repeated byte strings against counting every string of 200 bytes."""

import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import suffixes
from tests.conftest import SF

N = suffixes.LENGTH


def brute(texts):
    """(n_bytes, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + N]) for d in data for i in range(len(d) - N + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - N + 1):
            if seen[hash(d[i : i + N])] > 1:
                gone[i : i + N] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone]))
        spans = [tuple(map(int, x)) for x in edges.reshape(-1, 2)]
        out.append((len(d), spans, bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def same(df, rows):
    got = sorted((str(r["doc_id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.dedupe(df).collect())
    assert got == sorted((str(i), *want) for (i, _), want in zip(rows, brute([t for _, t in rows])))


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    same(df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", range(3))
def test_planted(spark, seed):
    """Passages of about the threshold in many texts, at every alignment, shared to the left, to the right and in pieces; periods; copies."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passages = [word(k) for k in (150, 195, 198, 199, 200, 201, 205, 260, 400, 1200)]
    texts = []
    for _ in range(120):
        parts = [word(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, b = sorted(rng.choices(range(len(p) + 1), k=2)) if rng.random() < 0.6 else (0, len(p))
            parts += [p[a:b], word(rng.randrange(1, 60))]
        texts.append("".join(parts))
    texts += [texts[3]] * 3 + [texts[5][10:], "a" * 199, "a" * 200, "a" * 201, "a" * 1000, "ab" * 300, "ba" * 100 + "a", "abc" * 400 + word(30), None, "", "é" * 150, "é" * 99 + "x"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string").repartition(6)
    same(df, rows)


def test_blocks(spark, monkeypatch):
    """Runs of starts that go on from one block to the next, and small batches."""
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choices(range(3), k=3000)), np.uint8)
    ends = np.array([700, 850, 3000])
    at, first, last = suffixes.anchors(data, ends)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 18)
    for a, b in zip((at, first, last), suffixes.anchors(data, ends)):
        assert a.tolist() == b.tolist()
    starts = [p for f, e in zip(first.tolist(), last.tolist()) for p in range(f, e + 1)]
    assert starts == [p for s, e in ((0, 700), (700, 850), (850, 3000)) for p in range(s, e - N + 1)]


def test_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("xyz ", k=1_000_000))
    text = long[:500_000] + "!" + long[300_000:]
    got = suffixes.dedupe(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}
    assert spans[2] == [] and spans[1] == [(300_000, 500_000), (500_001, 700_001)]


def test_empty(spark):
    assert suffixes.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0
