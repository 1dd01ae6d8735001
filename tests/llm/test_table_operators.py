"""WARC, sharding, URL filters, mixing, near duplicates, and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from corpusloom.llm import hnsw, minhash, mixing, sharding, urls, warc
from corpusloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF) == ""


def test_warc_round_trip(spark):
    trap = "x" * 990 + "\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde"
    rows = [(1, "http://a.org/x?y#z", trap), (2, "http://b.org", trap), (3, "http://b.org/\r\nEvil: 1", "é" * 3), (4, None, None), (5, "u", "é" * 3), (6, "", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    out = {r["page_id"]: r for r in warc.captures(pages, with_payload=True).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6]
    for i, _, html in rows:
        body, r = (html or "").encode(), out[i]["response"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        if i != 1:
            assert r["record_type"] == "response" and r["digest_ok"] and bytes(r["payload"]) == body
        assert out[i]["request"] and out[i]["metadata"]
    assert out[1]["response"]["record_type"] == "revisit" and out[1]["refers_to_page"] == 2 and out[2]["refers_to_page"] is None
    assert out[3]["response"]["target_uri"] == "http://b.org/Evil: 1" and out[4]["response"]["target_uri"] is None
    assert warc.captures(pages.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (None, "c", "y"), (None, "d", None), (None, "e", trap), (None, "f", trap)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["response"]["payload_bytes"]) for r in warc.captures(again).collect())
    assert got == [("1", 1), ("1", 1), ("1", 1), ("None", 0), ("None", 1), ("None", len(trap)), ("None", len(trap))]


def test_warc_keeps_equal_rows(spark):
    big = "z" * 2000
    rows = [(1, "a", "x")] * 3 + [(None, None, None)] * 2 + [(None, "", ""), (2, None, "y"), (2, "", "y")] + [(5, "u", big)] * 2 + [(4, "u", big)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((str(r["page_id"]), r["response"]["payload_bytes"], r["response"]["record_type"], str(r["refers_to_page"])) for r in warc.captures(pages).collect())
    want = [(i, len(h or ""), "revisit" if i == 4 else "response", 5 if i == 4 else None) for i, _, h in rows]
    assert got == sorted((str(i), n, kind, str(to)) for i, n, kind, to in want)


def test_warc_parse_rejects_broken():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"nothing"))


def test_warc_parse_in_pieces():
    record = b"WARC/1.1\r\nA: 1\r\nContent-Length: 10\r\n\r\n\r\n\r\nWARC/\x00\r\n\r\n"
    data = record * 3
    whole = list(warc.parse(data))
    assert len(whole) == 3 and whole[0][1] == b"\r\n\r\nWARC/\x00" and whole[0][0]["a"] == "1"
    packed = gzip.compress(record) + gzip.compress(record * 2)
    for n in (1, 3, 7, 1000):
        assert list(warc.parse(data[i : i + n] for i in range(0, len(data), n))) == whole == list(warc.parse(warc._inflated(packed, n)))
    with pytest.raises(ValueError):
        list(warc.parse(warc._inflated(packed[:-9])))


def extendible(rows, limit):
    """Reference: split any bucket over the limit on its next bit."""
    out, todo = {}, [("", rows)]
    while todo:
        bits, own = todo.pop()
        total = sum(b for _, b, _ in own)
        if total <= limit or len(bits) == 60:
            out |= {k: (bits, total, len(own)) for k, _, _ in own}
            continue
        for bit in "01":
            part = [r for r in own if r[2][len(bits)] == bit]
            if part:
                todo.append((bits + bit, part))
    return out


def test_sharding_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(300)) for i in range(400)]
    h = lambda i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")
    for limit in (10**9, 3000, 310, 40):
        want = extendible([(i, len(t), h(i)) for i, t in rows if len(t) <= limit or True], limit)
        got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["bytes"] <= limit:
                assert (r["shard"], r["shard_bytes"], r["shard_rows"]) == want[r["doc_id"]]


def test_sharding_hot_keys(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(50)] + [(7, "same")] * 30 + [(None, None), (8, "é" * 200), (9, "")]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, bytes long, shard string")
    out = sharding.assign_shards(df, limit_bytes=40).collect()
    assert len(out) == len(rows)
    held = {}
    for r in out:
        held.setdefault(r["shard"], []).append(r["bytes"])
        assert r["shard_bytes"] <= 40 or r["shard_rows"] == 1
    assert all(sum(v) <= 40 or len(v) == 1 for v in held.values())
    assert sharding.assign_shards(df.limit(0)).count() == 0
    sharding.write_shards(df, f"{tmp_path}/shards", limit_bytes=40)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(str, rows))
    folders = {}
    for r in back.collect():
        folders.setdefault(str(r["shard_id"]), []).append(len((r["text"] or "").encode()))
    assert all(sum(v) <= 40 or len(v) == 1 for v in folders.values()) and len(folders) == len(held)


def test_sharding_long_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 2_000_000), (1, "b" * 2_000_000), (2, "c")], "doc_id long, text string")
    out = sharding.assign_shards(df).collect()
    assert sorted(r["bytes"] for r in out) == [1, 2_000_000, 2_000_000] and len({r["shard"] for r in out if r["bytes"] > 1}) == 2
    sharding.write_shards(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3


def test_url_rules_and_aliases(spark):
    rel = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://Example.COM/en/a", None), (2, "http://www.example.com/en/a#x", ""), (3, "https://x.net/es/1?q", ""), (4, "http://x.net/de/", ""), (5, "http://ample.com", ""),
        (6, "http://a.org/1", rel("http://x.net/fr/9")), (7, "http://b.org/1", '<meta http-equiv="refresh" content="0; url=http://a.org/1">'), (8, "http://c.org/1", rel("/2")),
        (9, "http://d.org/1", rel("http://x.net/es/2")), (10, None, rel("http://x.net/es/2")), (11, "no scheme", ""), (12, "http://c.org/2", ""), (13, "http://b.org/1", ""), (14, "http://xnet/es/", ""),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://d.org/1", "http://y.com/"), ("http://e.org/", None)], "src string, dst string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, redirects).collect()}
    assert out[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert out[2] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert out[3] == ("x.net", "/es/1", "net/es/", "block")
    assert out[4] == ("x.net", "/de/", None, "allow") and out[5] == ("ample.com", "", None, "allow") and out[14][2] is None
    assert [out[i][3] for i in (6, 7, 13)] == ["block"] * 3  # over a link, then over a refresh
    assert out[8][3] == out[12][3] == "allow"
    assert out[9][3] == "allow"  # y.com is explicitly allowed
    assert out[10] == ("", "", None, "allow") == out[11]
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_aliases_by_relative_links(spark):
    links = [("d/x.html", "../es/a"), ("d/x2", "./../es/b"), ("es2/y", "/es/c?a=1&amp;b=2"), ("z/q?id=1", "?id=2"), ("k/m", "n.html"), ("t", "&#x2F;es/d"), ("v/w", "//x.net/es/e?x&amp;y")]
    rows = [(i, f"http://x.net/{at}", f'<link rel="canonical" href="{to}">') for i, (at, to) in enumerate(links)]
    rows += [(10, "http://x.net/z/q?id=2", '<meta http-equiv="refresh" content="0; url=../es/f">'), (11, "http://x.net/k/n.html", '<link rel=canonical href="../fr/g">')]
    rows += [(12, "http://x.net/es/c?a=1&b=2", ""), (13, "http://x.net/de/h", '<link rel=canonical href="../de/i">')]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {r[0]: "allow" if r[0] == 13 else "block" for r in rows}


def test_url_aliases_against_sql(spark, tmp_path):
    """Chains, stars and cycles of absolute canonical links over pages of the given table: the query against its SQL."""
    rng = random.Random(8)
    pages = [r for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r["url"]]
    rows = [(r["page_id"], r["url"], r["html"] + f'<link rel="canonical" href="{rng.choice(pages)["url"]}">' * (rng.random() < 0.4)) for r in pages]
    rows += [(10**6 + i, f"http://chain.org/{i}", f'<link rel="canonical" href="http://chain.org/{i + 1}">') for i in range(30)]
    rows += [(2 * 10**6, "http://chain.org/30", '<link rel="canonical" href="http://x.net/fr/end">'), (2 * 10**6 + 1, "http://alone.org/", '<link rel="canonical" href="http://alone.org/">'), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert differences(spark, QUERIES["op7_url_filters"], ORACLES["op7_url_filters"], str(tmp_path)) == ""
    out = {r["page_id"]: r["verdict"] for r in QUERIES["op7_url_filters"](spark, str(tmp_path)).collect()}
    assert all(out[10**6 + i] == "block" for i in range(30))


def test_mixing_contract(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "a", "a", "b", "c", None]), 3) for i in range(600)] + [(900, None, "a", 1), (900, None, "a", 1), (None, "x y", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    size, took, goal = {}, {}, {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
    total = sum(size.values())
    assert abs(sum(goal.values()) - total) < 1e-6
    weights = dict(zip(["a", "b", "c", "z", None], (5, 2, 1, 5, 2)))
    capped = {s for s in size if goal[s] == 3 * size[s]}
    free = [s for s in size if s not in capped]
    level = {round(goal[s] / weights[s], 6) for s in free}
    assert len(level) == 1 and all(3 * size[s] <= level.copy().pop() * weights[s] + 1e-6 for s in capped)
    assert all(0 <= goal[s] - took[s] < 1 for s in size)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text is null")).count() == 2


def test_mixing_tiny_sources_beside_a_hot_one(spark):
    rows = [(i, "w " * 5000, "hot", 0) for i in range(80)] + [(1000 + i, "w " * (1 + i % 7), f"tiny{i % 40:02}", 0) for i in range(120)] + [(2000, "w " * 400_000, "long", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = mixing.mix(df).collect()
    took, goal, size = {}, {}, {}
    for r in out:
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
        goal[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(0 <= goal[s] - took[s] < 1 and goal[s] <= 3 * size[s] for s in goal) and sum(s.startswith("tiny") for s in goal) == 40
    goals = mixing.targets(mixing.sized(df))
    slots = mixing.schedule(goals).collect()
    held = {}
    for r in sorted(slots, key=lambda r: r["slot"]):
        own = held.setdefault(r["source"], [])
        assert r["block"] == len(own) and r["start"] == (own[-1]["end"] if own else 0)
        own.append(r)
    for s, own in held.items():
        lengths = {r["end"] - r["start"] for r in own}
        assert own[-1]["end"] == int(goal[s]) and max(lengths) - min(lengths) <= 1 and len(own) >= mixing.LEAST_SLOTS // 2


def brute_links(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_minhash_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "One two", "one TWO", "one two three", "à Å\xa0x à Å x"]
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(99)}"
            texts.append("  ".join(copy).upper())
    texts += texts[8:12]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, id int, set_a string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = brute_links(sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_links_in_crowded_buckets(spark):
    """Pairs whose common buckets are those of a passage that all texts have: near 0.77 to the partner, 0.73 to the others."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = words(250), []
    for _ in range(60):
        shared = words(8)
        texts += [" ".join(passage + shared + words(37)) for _ in range(2)]
    rng.shuffle(texts)
    want = brute_links({i: shingle_set(t) for i, t in enumerate(texts)})
    assert len(set(want.values())) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == want


def test_minhash_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (3, "a b c")], "doc_id long, text string")
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert out == {None: (None, True), 2: (2, True), 3: (2, False)}


def test_hnsw_search_finds_what_exact_search_does():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 24))
    v[100:300] = v[0] + 0.05 * rng.standard_normal((200, 24))
    v[2000:2200] = v[1000:1200] + 0.08 * rng.standard_normal((200, 24))
    v = hnsw._unit(v).astype(np.float32)
    order, layers = hnsw.build(v)
    want = v @ v.T >= 0.9
    for widest in (hnsw.WIDEST, 10**6):  # with and without an exact search beyond the widest beam
        hnsw.WIDEST, reached = widest, []
        found = np.concatenate([np.stack(x, 1) for x in hnsw.search(v[order], layers, v, 0.9, reached)])
        assert len(np.unique(found, axis=0)) == len(found) and want[found[:, 0], order[found[:, 1]]].all()
        assert len(found) >= 0.99 * want.sum() and reached[1] >= hnsw.AUDIT_RECALL * reached[0]
    hnsw.WIDEST = 192


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_small_shards_are_searched_through_their_graphs(monkeypatch, sf):
    """Every query walks the graph; beyond the audit nothing is searched exactly, and the links are those of exact search."""
    rows = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").column("embedding").to_pylist()
    v = hnsw._unit(np.unique(np.array(rows), axis=0)).astype(np.float32)
    walked, through = [], []
    beam, exact = hnsw.beam, hnsw.exact
    monkeypatch.setattr(hnsw, "beam", lambda *a: walked.append(len(a[2])) or beam(*a))
    monkeypatch.setattr(hnsw, "exact", lambda vs, qs, part, least: through.append(len(part)) or exact(vs, qs, part, least))
    found = wanted = 0
    for k in range(hnsw.LEAST_SHARDS):
        shard = v[k :: hnsw.LEAST_SHARDS]
        order, layers = hnsw.build(shard)
        walked.clear()
        through.clear()
        pairs = np.concatenate([np.stack(x, 1) for x in hnsw.search(shard[order], layers, v, 0.9)])
        assert sum(walked) >= len(v) and through == [min(hnsw.AUDITED, len(v))]
        found, wanted = found + len(pairs), wanted + int((v @ shard.T >= 0.9).sum())
    assert found >= 0.99 * wanted > 0


def test_embeddings_against_brute_force_over_shards(spark):
    """Many shards and blocks, clusters, copies, and the audit's report."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 8))
    v[100:180] = v[0] + 0.1 * rng.standard_normal((80, 8))
    v[300:310] = v[20]
    unit = hnsw._unit(v)
    want = unit @ unit.T >= 0.9
    np.fill_diagonal(want, False)
    near = np.abs(unit @ unit.T - 0.9) < 1e-9
    assert not near.any()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    before = hnsw.SHARD_BYTES, hnsw.BLOCK_ROWS
    hnsw.SHARD_BYTES, hnsw.BLOCK_ROWS = 8 * 4 * 100, 150
    out = {r["vec_id"]: r for r in hnsw.near_duplicates(df).collect()}
    found = hnsw.linked(df.selectExpr("vec_id AS id", "embedding AS vec", "1L AS copies")).where("wanted is not null").groupBy().sum("wanted", "met").first()
    hnsw.SHARD_BYTES, hnsw.BLOCK_ROWS = before
    root = list(range(600))
    for _ in range(600):
        after = [min([root[i], *(root[j] for j in np.flatnonzero(want[i]))]) for i in range(600)]
        if after == root:
            break
        root = after
    assert all(out[i]["n_links"] == want[i].sum() and out[i]["component_id"] == root[i] for i in range(600))
    assert found[1] >= hnsw.AUDIT_RECALL * found[0] > 0


def test_embeddings_odd_rows(spark):
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(1, a), (2, [2 * x for x in a]), (3, a), (4, b), (5, None), (6, [0.0] * 3), (7, [float("nan"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0]), (10, []), (11, a[:2]), (None, a), (12, a)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, id int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(df).collect()}
    assert {i: out[i] for i in (1, 2, 3, 12)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 12: (3, 1, False)}
    assert all(out[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and out[None] == (0, None, True)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_pipeline_stages_keep_odd_rows_in_shape(spark):
    prose = " ".join(f"word{i} the and of" for i in range(30))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, None, None, None, None), (None, prose.replace("word", "other"), "en", None, 5), (3, prose + " end", "en", "b", 2)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    left = {r["doc_id"] for r in docs.collect()}
    assert left <= {None, 1} and left
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
