"""The chunked search, played in plain Python over all pages of a small table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom.operators import chunking, search
from corpusloom.plans import searches
from corpusloom.plans.catalog import _outlines
from tests.conftest import SF


def words(text):
    return regex.findall(r"[\p{L}\p{Nl}\p{No}]{2,}", text.lower())


def best(scores, k):
    return sorted(scores, key=lambda x: (-round(scores[x], 9), x))[:k]


def bm25(chunks, query):
    bags = {k: Counter(words(t)) for k, t in chunks.items()}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for k, b in bags.items():
        s = sum(n * math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for w, n in Counter(words(query)).items() if b[w])
        if s > 0:
            out[k] = s
    return out


def merged(blocks):
    told = ""
    for b in (x.strip(" \t\r\n") for x in blocks):
        if told and b in told:
            continue
        if not told or told in b:
            told = b
            continue
        n = next((n for n in range(min(len(told), len(b), 500), 39, -1) if told.endswith(b[:n])), 0)
        told = told + b[n:] if n else told.rstrip() + "\n\n" + b
    return told


def told_once(text):
    out, last = [], None
    for p in (x.strip(" \t\r\n") for x in re.split(r"\n{2,}", text)):
        same = re.sub(r"\s+", " ", p).strip().lower()
        if p and same != last:
            out.append(p)
        last = same if p else last
    return "\n\n".join(out)


def span(full, chunk):
    for piece in (chunk, chunk.strip(" \t\r\n")[:200]):
        if piece and piece in full:
            return full.index(piece), full.index(piece) + len(piece)
    return None


def clusters(hits):
    """Lists of (span, idx, score, ...) that belong together, one hit after another."""
    out = []
    for h in sorted(hits, key=lambda h: (h[0] is None, h[0][0] if h[0] else 0, h[1], -h[2])):
        now = out[-1] if out else []
        ends = [x[0][1] for x in now if x[0]]
        if h[0] and ends:
            joins = h[0][0] <= max(ends) + 240
        else:
            joins = bool(now) and h[1] <= max(x[1] for x in now) + 1
        out[-1].append(h) if joins else out.append([h])
    return out


def test_chunk_search_equals_plain_python(spark):
    pages = {r["page_id"]: (r["text"] or "", r["url"]) for r in _outlines(spark, SF).collect()}
    asked = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] and any(r["embedding"])}
    cut = {(p, i): c[:2] for p, (t, u) in pages.items() for i, c in enumerate(chunking.chunks_of(t, u, "sliding", 800, 100))}
    patterns = [re.compile(p if p != "les (la" else re.escape(p), re.I | re.M) for p in searches.PAGE_PATTERNS]
    places = {k: [m.start() for m in (p.search(raw.strip(" \t\r\n")) for p in patterns) if m] for k, (raw, _) in cut.items()}
    ruled = sorted((k for k in cut if places[k]), key=lambda k: (-len(places[k]), min(places[k]), k))[:3]
    assert ruled
    want, several = {}, 0
    for qid, text in asked.items():
        lists = {"lexical": best(bm25({k: x for k, (_, x) in cut.items()}, text), 30)}
        if qid in vectors:
            q = vectors[qid]
            cos = {p: float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)) for p, v in vectors.items()}
            lists["dense"] = best({k: cos[k[0]] for k in cut if k[0] in cos}, 30)
        fused = defaultdict(float)
        for ranked in lists.values():
            for i, k in enumerate(ranked):
                fused[k] += 1 / (61 + i)
        scores = {k: fused[k] for k in best(fused, 20)}
        scores |= {k: 1.5 + min(0.6, 0.1 * (len(places[k]) - 1)) for k in ruled if k not in scores}
        methods = {k: {n for n, ranked in (lists | {"regex": ruled}).items() if k in ranked} for k in scores}
        by_page = defaultdict(list)
        for k, s in scores.items():
            full, raw = pages[k[0]][0], cut[k][0]
            at = span(full, raw)
            around = raw
            if at:
                a = full.rfind("\n\n", 0, at[0])
                e = full.find("\n\n", at[1])
                around = re.sub(r"\n{3,}", "\n\n", full[0 if a < 0 else a + 2 : len(full) if e < 0 else e]).strip(" \t\r\n") or raw
            by_page[k[0]].append((at, k[1], s, methods[k], around))
        rolled = {}
        for p, hits in by_page.items():
            groups = clusters(hits)
            several += len(groups) > 1
            used = set().union(*(h[3] for h in hits))
            score = max(h[2] for h in hits) + min(0.4, 0.08 * (len(hits) - 1)) + min(0.15, 0.05 * (len(used) - 1)) + min(0.15, 0.05 * (len(groups) - 1))
            excerpt = told_once("\n\n[...]\n\n".join(told_once(merged([h[4] for h in g])) for g in groups))
            rolled[p] = (score, len(hits), len(groups), ",".join(sorted(used)), excerpt)
        for i, p in enumerate(best({p: x[0] for p, x in rolled.items()}, 5)):
            want[qid, i + 1] = (p, pytest.approx(rolled[p][0], abs=1e-6), *rolled[p][1:4], len(rolled[p][4]), hashlib.md5(rolled[p][4].encode()).hexdigest())
    got = {(r["qid"], r["rank"]): (r["page_id"], r["score"], r["hit_count"], r["cluster_count"], r["methods"], r["n_chars"], r["digest"]) for r in __spark_entry__.queries()["chunk_search"](spark, SF).collect()}
    assert got == want and several


def test_hits_without_a_span(spark):
    """They follow those with one, and join by their numbers."""
    rows = [("a", 0, 0, 100), ("a", 1, 300, 400), ("a", 7, 900, 950), ("a", 8, None, None), ("a", 9, None, None), ("a", 11, None, None), ("b", 3, None, None), ("b", 4, None, None), ("b", 6, None, None), ("c", 5, 10, 20), ("c", 2, None, None)]
    hits = spark.createDataFrame([(1, *r, 1.0) for r in rows], "qid int, doc string, chunk_idx long, span_start int, span_end int, score double")
    got = {(r["doc"], r["chunk_idx"]): r["cluster"] for r in search.clustered(hits).collect()}
    want = {}
    for doc in "abc":
        for i, g in enumerate(clusters([((s, e) if s is not None else None, n, 1.0) for d, n, s, e in rows if d == doc])):
            want |= {(doc, h[1]): i + 1 for h in g}
    assert got == want and got["a", 11] == 3 and got["b", 6] == 2 and got["c", 2] == 1


def test_no_chunks_and_no_hits(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta\n\nbeta gamma")], "doc_id long, text string")
    assert search.chunk_index(docs.where("doc_id < 3")).count() == 0
    index = search.chunk_index(docs)
    none = spark.createDataFrame([], "qid int, key struct<doc:long,chunk_idx:long>, score double, rank int")
    assert search.documents(search.with_passages(search.merged_hits({"lexical": none}, none.drop("rank"), 5), index, docs), 5).count() == 0
    one = index.select(F.lit(1).alias("qid"), "key", F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    row = search.documents(search.with_passages(search.merged_hits({"lexical": one}, none.drop("rank"), 5), index, docs), 5).first()
    assert (row["doc"], row["score"], row["hit_count"], row["excerpt"], row["methods"]) == (3, pytest.approx(0.58), 2, "alpha beta\n\nbeta gamma", ["lexical"])  # the second chunk is the overlap
