"""The reference's operators: against their DuckDB SQL, and against hand-worked or plain-Python results."""

import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers as answers_of
from corpusloom.functions import labels, segments, text
from corpusloom.operators import alignment, chunking, evaluation, excerpts, graph, highlights, layout, lexical, maps, matching, retrieval, upkeep, variables
from corpusloom.operators.components import connected_components
from corpusloom.plans import answers, atlas, catalog, layouts, records, scores, texts  # noqa: F401  the others register their queries in the catalog
from corpusloom.sources import importers
from corpusloom.streaming import counters
from tests.conftest import SF
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


DOCS = [(1, "The cat sat on the mat"), (2, "The dog chased the cat, the cat ran"), (3, "Vögel singen; das Café öffnet"), (4, None), (5, "")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat cat dog"), (2, "Café"), (3, "zzz")], "qid long, query string")
    got = {(r["qid"], r["key"]): r["score"] for r in lexical.bm25(lexical.index(docs, asked)).collect()}
    size = {1: 6, 2: 8, 3: 5}
    avg = sum(size.values()) / 5

    def part(f, df, dl):
        return math.log(1 + (5 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))

    want = {(1, 1): 2 * part(1, 2, 6), (1, 2): 2 * part(2, 2, 8) + part(1, 1, 8), (2, 3): part(1, 1, 5)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert lexical.bm25(lexical.index(docs.limit(0), asked)).count() == 0


def test_regex_invalid_falls_back_to_literal(spark):
    docs = spark.createDataFrame([(1, "call f(x now"), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = retrieval.regex_search(docs, ["f(x", "CALL"]).collect()
    assert [(r["key"], round(r["score"], 6), r["matches"], r["first_pos"]) for r in out] == [(1, 1.6, 2, 0)]


def test_chunkers():
    text = "intro\n\n# A\n\none two\n\n## B\n\nthree\n\n# C\n\nfour"
    raw = lambda s, n=1000, o=0: [c[0] for c in chunking.chunks_of(text, "d/x.md", s, n, o)]
    assert raw("section") == [text]  # text before the first heading has level 0, which no heading ends
    parts = chunking.parts_of(text.split("\n\n", 1)[1], 1000)
    assert ["\n\n".join(p.text for p in g) for g in chunking.sections(parts)] == ["# A\n\none two\n\n## B\n\nthree", "# C\n\nfour"]
    assert raw("recursive") == ["intro", "# A\n\none two", "## B\n\nthree", "# C\n\nfour"]
    assert raw("sliding", 14) == ["intro\n\n# A", "one two", "## B\n\nthree", "# C\n\nfour"]
    last = list(chunking.chunks_of(text, "d/x.md", "recursive", 1000, 0))[2]
    assert last[1].startswith("[x.md › A › B]\n\n") and last[2] == ["A", "B"] and last[3] == "## B\n\nthree"
    overlapped = chunking.sliding(chunking.parts_of("aa\n\nbb\n\ncc\n\ndd", 99), 10, 3)
    assert [[p.text for p in w] for w in overlapped] == [["aa", "bb"], ["bb", "cc"], ["cc", "dd"], ["dd"]]
    assert chunking.cut("abc def ghij", 5) == ["abc", "def", "ghij"]


def test_fixed_size_drops_an_unaligned_tail(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, ""), (4, None)], "doc_id long, text string")
    out = [(r["doc_id"], r["chunk"]) for r in chunking.fixed_size(df, 4, 1).collect()]
    assert out == [(1, "abcd"), (1, "defg"), (1, "ghij"), (2, "abc")]
    assert [r["chunk"] for r in chunking.fixed_size(df.where("doc_id = 1"), 4, 0).collect()] == ["abcd", "efgh"]
    whole = lambda size, over: [r["chunk"] for r in chunking.fixed_size(df.where("doc_id = 1"), size, over, tail=True).collect()]
    assert whole(4, 0) == ["abcd", "efgh", "ij"] and whole(4, 1) == ["abcd", "defg", "ghij"] and whole(9, 2) == ["abcdefghi", "hij"]


def test_overlapping_chunks_merge_to_the_whole_text(spark):
    """Texts without a repeat of 40 characters come back whole, however their length falls on the windows."""
    texts = [" ".join(f"w{i * 7919 % 10007}" for i in range(n)) for n in (1, 150, 151, 400, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = chunking.fixed_size(df, 800, 100, tail=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))).alias("l"))
    got = {r["doc_id"]: r["t"] for r in c.select("doc_id", excerpts.merged_blocks(F.transform("l", lambda x: x["chunk"])).alias("t")).collect()}
    assert got == dict(enumerate(texts))


def test_rank_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (3, "x", 1)], "qid int, key string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "c"), (2, "z")], "qid int, key string")
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid int")
    out = {r["qid"]: r for r in evaluation.rank_metrics(ranked, expected, cases).collect()}
    r = out[1]
    assert (r["tp"], r["fp"], r["fn"], r["mrr"]) == (2, 1, 0, 0.5)
    assert abs(r["ap"] - (1 / 2 + 2 / 3) / 2) < 1e-12
    assert abs(r["ndcg"] - (1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3))) < 1e-12
    assert out[2]["recall"] == 0 and out[3]["recall"] == 0 and out[4]["recall"] == 1


def test_select_modes(spark):
    hits = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate([0.9, 0.5, 0.04])], "qid int, key int, score double, rank int")
    assert retrieval.select_hits(hits, "top_k", 2).count() == 2
    assert retrieval.select_hits(hits, "threshold", 1).count() == 2
    assert retrieval.select_hits(hits, "top_k_threshold", 1).count() == 1


def test_tracker_stops_at_strong_entailment(spark):
    rows = [(1, 0, 0.3, 0.6), (1, 1, 0.9, 0.1), (1, 2, 0.99, 0.99), (2, 0, 0.1, 0.4), (3, 0, 0.4, 0.2), (4, 0, 0.0, 0.0)]
    out = {r["claim_id"]: (r["status"], r["entailment"], r["units"]) for r in matching.track(spark.createDataFrame(rows, "claim_id int, seq long, entailment double, contradiction double")).collect()}
    assert out == {1: ("supported", 0.9, 2), 2: ("contradicted", 0.1, 1), 3: ("partial", 0.4, 1), 4: ("not_found", 0.0, 1)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (1100, 90)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 90 for i in range(1000, 1300)) and got[90] == 90
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cycles_and_issues(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "gone")], "src string, dst string")
    assert sorted(map(tuple, graph.on_cycles(edges).collect())) == [("b", "c"), ("c", "b")]
    assert graph.on_cycles(edges.where("src <> 'c'")).count() == 0
    nodes = spark.createDataFrame([(n, n.upper()) for n in "abcdx"] + [("e", " A ")], "node_id string, label string")
    got = {(r["code"], r["node_id"]) for r in graph.issues(nodes, edges).collect()}
    assert got == {("duplicate_label", "a"), ("dangling_edge", "gone"), ("isolated", "e")}
    parts = graph.sized_components(nodes, edges.where("dst <> 'gone'"))
    assert sorted(map(tuple, graph.bridges(parts).collect())) == [("a", "e"), ("e", "x")]


def test_sync(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "name string, content string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "")], "name string, content string")
    assert dict(map(tuple, upkeep.corpus_sync(a, b).collect())) == {"x": "same", "y": "changed", "z": "removed", "w": "added"}


def test_importers(spark, tmp_path):
    for name, body in {"a.md": "# Hi", "b.html": "<p>x</p>\n\n\n\n<b>y</b>", "c.py": "x = 1", "d.txt": "note"}.items():
        (tmp_path / name).write_text(body)
    out = {r["name"]: r["markdown"] for r in importers.as_markdown(importers.texts(spark, str(tmp_path))).collect()}
    assert out == {"a.md": "# Hi", "b.html": "x\n\ny", "c.py": "```py\nx = 1\n```", "d.txt": "# d.txt\n\nnote"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/t.csv").write_text("h1,h2\na|b,2\nc\n" + "z,9\n" * 600)
    lines = [r["text"] for r in importers.csv_markdown(spark, str(tmp_path / "t")).orderBy("line").collect()]
    assert lines[:4] == ["| h1 | h2 |", "| --- | --- |", "| a\\|b | 2 |", "| c |  |"] and len(lines) == 503 and "500" in lines[-1]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in importers.json_lines(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2]
    (tmp_path / "o").mkdir()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "o/a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "o/b.odt").write_text("broken")
    got = {r["path"][-6:]: (r["markdown"], bool(r["error"])) for r in importers.office(spark, str(tmp_path / "o")).collect()}
    assert got == {"a.docx": ("## T\n\nx", False), "/b.odt": (None, True)}
    for given, want in {"1-3, 7,x,2": [1, 2, 3, 7], "9-": [9, 10], "-3": [1, 2, 3], "all": None, "": None, "12": None, "5-4,10-99": [10]}.items():
        assert spark.range(1).select(importers.page_ranges(F.lit(given), F.lit(10)).alias("p")).first()["p"] == want


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = counters.daily_counts(counters.events_stream(spark, f"{tmp_path}/log", events.schema, 1))
    counters.run_to_table(stream, "daily", f"{tmp_path}/ck").awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, counters.daily_counts(events).collect()))


def test_index_stream_equals_batch(spark, tmp_path):
    """After each of three micro-batches of adds, changes and removals the log leaves what an index of the texts has; a batch that is run
    again changes nothing."""
    from corpusloom.streaming import index

    path, seen, texts = f"{tmp_path}/log", [], {}
    batches = [
        [(0, 1, "a cat, a cat", False), (0, 2, "dogs bark", False), (0, 3, None, False), (0, None, "lost", False), (0, 4, "", False)],
        [(1, 1, "the dog", False), (1, 2, None, True), (1, 5, "first words", False), (2, 5, "last words words", False), (1, 9, None, True)],
        [(3, 2, "dogs bark", False), (3, 5, "last words words", False), (3, 3, "no longer null", False), (3, 1, "x", True)],
    ]
    schema = "seq int, key long, text string, removed boolean"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index.keep_up(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/ck").awaitTermination()
        for _, key, text, removed in sorted(rows, key=lambda r: r[0]):
            texts.pop(key, None)
            if key is not None and not removed:
                texts[key] = text
        now = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        want = sorted(tuple(r) for r in lexical.postings(now).select("doc_id", "term", "tf", "dl").collect())
        got = index.postings(spark, path, "bigint")
        assert sorted(tuple(r) for r in got.where("term is not null").collect()) == want
        assert sorted(r["key"] for r in got.select("key").distinct().collect()) == sorted(texts)
        seen.append(want)
    index.apply_changes(spark.createDataFrame(batches[2], schema), 2, path)
    assert sorted(tuple(r) for r in index.postings(spark, path, "bigint").where("term is not null").collect()) == seen[-1]


def test_layout_by_hand(spark):
    pages = spark.createDataFrame([("b", i) for i in range(8)] + [("c", 1)], "book string, page int")
    header = dict(enumerate("AABAABBA"))
    lines = spark.createDataFrame([("b", i, "top", h, 10.0) for i, h in header.items()] + [("b", 0, "top", "once", 99.0), ("b", 7, "bottom", "f", 5.0), ("c", 1, "top", "A", 10.0)], "book string, page int, side string, key string, margin double")
    chosen = layout.choices(pages, lines)
    assert {(r["book"], r["page"]): (r["header"], r["top"], r["footer"]) for r in chosen.collect()} == {("b", i): (h, 10.0, None) for i, h in header.items()} | {("c", 1): (None, 0.0, None)}
    found = layout.pairs(chosen)
    assert sorted((r["book"], r["place"], r["header"], r["n"], r["selected"]) for r in found.where("book = 'b'").collect()) == [("b", 1, "A", 5, True), ("b", 2, "B", 3, True)]
    # page 2 is an island, but its own pair fits it by more than the margin that an island may have
    assert all(r["smooth"] == r["place"] for r in layout.smoothed(layout.assigned(chosen, found)).collect())
    near = spark.createDataFrame([("b", i, p, {1: 0.0, 2: 3.0} if p == 1 else {1: 3.0, 2: 0.0}) for i, p in enumerate([1, 2, 1, 2, 1, 1, 2, 2, 1, 2, 1])], "book string, page int, place int, distances map<int,double>")
    want, smooth = [1, 2, 1, 2, 1, 1, 2, 2, 1, 2, 1], None
    smooth = list(want)
    for i in range(1, len(want) - 1):
        if smooth[i - 1] == want[i + 1] != smooth[i]:
            smooth[i] = smooth[i - 1]
    assert [r["smooth"] for r in layout.smoothed(near).orderBy("page").collect()] == smooth


def test_reflow_and_page_ends_by_hand(spark):
    text = "A long line of words that goes on and\non to a second line that is as long\nand ends. Yes.\nNew para-\ngraph here -\n\nlast-"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n")], "id long, text string")
    got = [(r["id"], r["nth"], r["paragraph"]) for r in layout.reflowed(df, "id").orderBy("id", "nth").collect()]
    assert got == [(1, 1, "A long line of words that goes on and on to a second line that is as long and ends. Yes."), (1, 2, "New paragraph here"), (1, 3, "last")]
    pages = [("b", 1, "One.\n\nIt goes"), ("b", 2, "on"), ("b", 3, "and on"), ("b", 4, "still\n\nEnd."), ("b", 5, "# Head"), ("b", 6, "New."), ("b", 7, "small cut-"), ("b", 8, "ting"), ("b", 9, None), ("c", 1, "x")]
    got = {(r["book"], r["page"]): r["text"] for r in layout.merged_pages(spark.createDataFrame(pages, "book string, page int, text string")).collect()}
    assert got == {("b", 1): "One.\n\nIt goes on", ("b", 2): "", ("b", 3): "and on still", ("b", 4): "End.", ("b", 5): "# Head", ("b", 6): "New. small cut-", ("b", 7): "", ("b", 8): "ting", ("b", 9): "", ("c", 1): "x"}


def test_widest_cover_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    seg = sorted({(k, a, a + rng.randrange(1, 900)) for k in range(6) for a in rng.sample(range(5000), 30)})
    spans = [(rng.randrange(6), a, a + rng.choice([1, 7, 2000]), rng.choice("xy")) for a in rng.choices(range(5000), k=200)]
    got = matching.widest_cover(spark.createDataFrame(seg, "key int, seg_start int, seg_end int"), spark.createDataFrame(spans, "key int, span_start int, span_end int, name string")).collect()
    assert len(got) == len(seg)
    for r in got:
        over = [(a - b, a, b, n) for k, a, b, n in spans if k == r["key"] and a < r["seg_end"] and b > r["seg_start"]]
        assert (tuple(r["span"]) if r["span"] else None) == (min(over)[1:] if over else None)


def test_trees_by_hand(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("z", "y"), ("q", "q")], "src string, dst string")
    below = {}
    for r in graph.descendants(edges).collect():
        below.setdefault(r["node"], set()).add(r["below"])
    assert below == {"a": set("abcd"), "b": set("abcd"), "c": set("abcd"), "x": {"y"}, "z": {"y"}, "q": {"q"}}
    nodes = spark.createDataFrame([(n,) for n in "abcdxyzqw"], "node_id string")
    assert sorted(map(tuple, graph.single_root(nodes, edges).collect())) == sorted([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), *(("root", n) for n in "axzqw")])


def test_one_to_one_is_taking_turns(spark):
    """Rounds of proposals against each i taking the best that is left, with many ties."""
    import random

    rng = random.Random(2)
    rows = [(k, i, j, rng.randrange(4) / 4) for k in range(40) for i in range(rng.randrange(1, 9)) for j in range(8) if rng.random() < 0.5]
    want = set()
    for k in range(40):
        used = set()
        for i in range(9):
            free = [(-s, j) for kk, ii, j, s in rows if (kk, ii) == (k, i) and j not in used]
            if free:
                used.add(min(free)[1])
                want.add((k, i, min(free)[1]))
    got = alignment.one_to_one(spark.createDataFrame(rows, "k long, i int, j int, score double"), "k").collect()
    assert {(r["k"], r["i"], r["j"]) for r in got} == want and len(got) == len(want)


def test_excerpt(spark):
    text = "a" * 300 + " Needle " + "b" * 300
    out = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(matching.excerpt(F.col("t"), ["needle"], 100).alias("e")).collect()
    assert out[0]["e"].startswith("…") and "Needle" in out[0]["e"] and out[0]["e"].endswith("…") and len(out[0]["e"]) == 102
    assert out[1]["e"] == "short" and out[2]["e"] is None


def test_text_functions(spark):
    df = spark.createDataFrame([("Größere Vögel-Häuser",), (None,), ("",)], "t string")
    folded = df.select(text.ascii_fold("t").alias("f")).select("f", text.slug(F.col("f")).alias("s"), text.fingerprint(F.col("f")).alias("p")).collect()
    assert tuple(folded[0]) == ("grossere vogel-hauser", "grossere-vogel-hauser", ["gross" + "er", "haus", "vogel"]) and folded[2]["s"] == "node"
    stems = spark.createDataFrame([(w,) for w in ("running", "erns", "bees", "cat", "den")], "w string").select(text.light_stem(F.col("w")).alias("x"))
    assert [r["x"] for r in stems.collect()] == ["runn", "ern", "bee", "cat", "den"]
    normal = df.limit(1).select(text.match_normal(F.lit("A&amp;B<br> STRAßE\xad")).alias("m"), text.glossary_normal(F.lit(" C++ / (Foo)_bar ")).alias("g")).first()
    assert tuple(normal) == ("a&b strasse", "c foo bar")


def test_normalisers_and_splitters(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.match_normal(F.lit("A< BR / >b &amp; c"))) == "a b & c"
    assert one(text.plain_normal(F.lit("Don't\xad  stop, now_1!"))) == "don t stop now_1"
    assert one(text.clean_cell(F.lit(" `„<b>x</b>  y“` "))) in ("„ x y“", "x y")
    assert one(text.context_normal(F.lit("a\x07 \t b \r\n\r\n\r\n\r\nc"))) == "a b\n\nc"
    assert one(text.without_thoughts(F.lit("so</think>a <think>b</think>c<think>d"))) == "a c"
    body = F.lit("# Head\nOne is. Two\ngoes on! - x\n- item one\n2) item two\n| t |\n\nEnd")
    assert one(segments.sentences(body)) == ["One is.", "Two goes on!", "x", "item one", "item two", "End"]
    assert one(segments.line_facts(body)) == ["item one", "item two"]
    assert one(segments.claims(F.lit("A b c d e. A b c d e.\nno"))) == ["A b c d e."]
    assert one(segments.fact_limit(F.lit(None).cast("string"))) == 24 and one(segments.belongs(F.lit("the long river"), F.lit(None).cast("string"))) is False
    assert one(segments.belongs(F.lit("small rivers carry boats"), F.lit("Many boats that carry grain on small lakes")))


def test_depths_and_merges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in graph.depths(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 3}
    nodes = spark.createDataFrame([("a", "One"), ("b", "one "), ("c", "Two"), ("d", "")], "node_id string, label string")
    into, kept = graph.merge_equal_labels(nodes, edges, F.lower(F.trim("label")))
    assert dict(map(tuple, into.collect())) == {"a": "a", "b": "a", "c": "c"} and sorted(map(tuple, kept.collect())) == [("a", "c"), ("c", "a")]


def test_term_spans_and_anchors(spark):
    docs = spark.createDataFrame([(1, "aXa xax"), (2, None), (3, "")], "doc_id long, text string")
    spans = matching.term_spans(docs, ["xa", "a.b"])
    assert sorted(map(tuple, spans.collect())) == [(1, "xa", 1, 1, 3), (1, "xa", 2, 4, 6)]
    held = matching.anchors(spans.withColumnRenamed("key", "doc_id").join(docs, "doc_id"), 2).orderBy("nth").collect()
    assert [(r["prefix"], r["exact"], r["suffix"]) for r in held] == [("a", "Xa", " x"), ("a ", "xa", "x")]


def test_label_fingerprint_reads_all_lines(spark, tmp_path):
    spark.createDataFrame([(1, "Vögel\nHäuser\nrunning")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["label_fingerprint"](spark, str(tmp_path)).first()["stems"] == "haus runn vogel"


def test_facts_are_matched_one_to_one(spark):
    rows = [
        (1, ["The sky is blue today.", "Water boils at 100 degrees."], ["water boils at 100 degrees.", "The sky is blue today.", "Something else entirely."]),
        (2, ["Same fact here.", "Same fact here."], ["Same fact here."]),
        (3, [], ["A lone sentence."]),
        (4, None, None),
        (5, [""], [""]),
    ]
    d = spark.createDataFrame(rows, "id int, expected array<string>, observed array<string>")
    got = {i: [] for i in range(1, 6)}
    for r in sorted(alignment.one_to_one(alignment.scored_pairs(d, "id"), "id").collect()):
        got[r["id"]].append((r["i"], r["j"]))
    assert got == {1: [(0, 1), (1, 0)], 2: [(0, 0)], 3: [], 4: [], 5: []}
    m = {r["id"]: r for r in alignment.match_metrics(d.where("id < 4"), "id").collect()}
    assert (m[1]["matched"], m[1]["recall"], round(m[1]["precision"], 6)) == (2, 1.0, 0.666667)
    assert (m[2]["recall"], m[2]["precision"], m[3]["f1"]) == (0.5, 1.0, 0.0)


def test_fact_matching_against_all_pairs(spark):
    """The query's matches against the rule worked out in plain Python, every pair with its full ratio."""
    from difflib import SequenceMatcher

    pairs = catalog._pairs(spark, SF).select("case_id", segments.sentences(F.col("expected")).alias("e"), segments.sentences(F.col("actual")).alias("o"))
    rows = pairs.select("case_id", "e", "o", *(F.transform(c, f).alias(c + n) for c in "eo" for n, f in (("p", text.plain_normal), ("h", lambda x: text.collapsed(F.lower(x)))))).collect()
    got = {r["case_id"]: r["matched"] for r in catalog.QUERIES["fact_matching"](spark, SF).collect()}
    want = {}
    for r in rows:
        used = set()
        for i, a in enumerate(r["e"]):
            best, at = 0.0, None
            for j, b in enumerate(r["o"]):
                wa, wb = ({w for w in p.split() if len(w) >= 4} for p in (r["ep"][i], r["op"][j]))
                s = len(wa & wb) / min(len(wa), len(wb)) if wa and wb else 0.0
                s = max(s, 0.8 * SequenceMatcher(None, a.lower().strip(), b.lower().strip(), autojunk=False).ratio())
                s = 1.0 if r["eh"][i] in r["oh"][j] or r["oh"][j] in r["eh"][i] else s
                if j not in used and s > best:
                    best, at = s, j
            if at is not None and best >= 0.36:
                used.add(at)
        want[r["case_id"]] = len(used)
    assert got == want and sum(want.values()) > 0


def test_lines_are_compared(spark):
    d = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "a  \r\nb", "a\nb\n"), (3, "", "a"), (4, None, None)], "id int, x string, y string")
    got = {r["id"]: tuple(r["d"]) for r in d.select("id", alignment.compared_lines(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got == {1: (4 / 7, 1, 1, 0, 1), 2: (1.0, 2, 0, 0, 0), 3: (0.0, 0, 1, 0, 0), 4: (1.0, 0, 0, 0, 0)}


def test_labels_by_hand(spark):
    rows = [("## 1. Über die 'Häuser',", "house"), ("`- item one;`", "Items one"), ("format", "x"), ("der die das", ""), ("", None), (None, "nodes here")]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select(labels.clean(F.col("a")).alias("c"), labels.same(F.col("a"), F.col("b")).alias("s"), labels.stems_agree(F.col("a"), F.col("b")).alias("f"), labels.preferred(F.col("a"), F.col("b")).alias("p"), labels.names_form(F.col("b")).alias("m")).collect()
    assert [r["c"] for r in got[:5]] == ["Über die 'Häuser'", "item one", "", "", ""]
    assert [r["s"] for r in got] == [False, True, False, False, False, False]
    assert [r["f"] for r in got] == [False, True, False, False, False, False]
    assert [r["p"] for r in got[4:]] == ["", "nodes here"]
    assert [r["m"] for r in got] == [False, False, True, True, True, True]


def test_answers_by_hand(spark):
    rows = [('{"facts": ["a b", {"claim": "c d"}, 3]}',), ("x ```json\n[\"q\", {\"text\": \"r\"}]\n``` y",), ("nothing {",), ("",), (None,), ('&quot;just a string&quot;',)]
    got = [r["f"] for r in spark.createDataFrame(rows, "t string").select(answers_of.facts(answers_of.json_payload(F.col("t"))).alias("f")).collect()]
    assert got == [["a b", "c d"], ["q", "r"], [], [], [], []]
    said = [('{"winner": "Option B", "score": "80"}',), ('{"winner": "nobody"} the answer A is better',), ("Auswahl = a",), ("unclear",), (None,), ('{"choice": "left", "confidence": 250}',), ('So {"why": {"a": 1}, "pick": "b"}.',)]
    got = [tuple(r["j"]) for r in spark.createDataFrame(said, "t string").select(answers_of.judged(F.col("t")).alias("j")).collect()]
    assert got == [("B", 0.8, "json"), ("A", None, "regex"), ("A", None, "regex"), ("", None, "unparsed"), ("", None, "unparsed"), ("A", 1.0, "json"), ("B", None, "json")]


def test_blocks_are_merged(spark):
    words = "the quick brown fox jumps over one lazy dog and then it sleeps"
    rows = [(["", None, "start " + words, words + " till noon", "fox jumps", "new", "new and more"],), (["abc", "c and"],), ([],), (None,)]
    got = [r["t"] for r in spark.createDataFrame(rows, "l array<string>").select(excerpts.merged_blocks(F.col("l")).alias("t")).collect()]
    assert got == [f"start {words} till noon\n\nnew\n\nnew and more", "abc\n\nc and", "", None]


def _anchor(body, exact, prefix, suffix):
    """The place of an anchor worked out one place after another."""
    alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    at = [i for i in range(len(body)) if exact and body.startswith(exact, i)]
    if at:
        back = lambda i: body[max(0, i - len(prefix)) : i][::-1]
        s = max(at, key=lambda i: (alike(back(i), prefix[::-1]) + alike(body[i + len(exact) :], suffix), -i))
        return s, s + len(exact), False
    part = lambda c, cut: next((cut(n) for n in (len(c), 32, 24, 16, 12, 8) if 0 < n <= len(c) and cut(n) in body), None)
    head, tail = part(prefix, lambda n: prefix[-n:]), part(suffix, lambda n: suffix[:n])
    if head is None or tail is None:
        return None
    places = lambda x: [i for i in range(len(body)) if body.startswith(x, i)]
    pairs = [(b - a - len(head), a + len(head)) for a in places(head) for b in places(tail) if b >= a + len(head)]
    return (min(pairs)[1], sum(min(pairs)), True) if pairs else None


def test_anchors_against_plain_python(spark):
    rng = random.Random(7)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = {k: word(rng.randint(0, 120), "ab\n\U0001f600") for k in range(40)} | {40: "aaaa", 41: "", 42: r"x\Ey\Qz x\Ey"}
    rows = [(f"{k}:{i}", k, word(rng.randint(0, 5), "ab"), word(rng.randint(0, 14), "ab\n"), word(rng.randint(0, 14), "ab\n")) for k in texts for i in range(12)]
    rows += [(f"{k}:c{i}", k, "zz", b[i : i + 10], b[i + 13 : i + 24]) for k, b in texts.items() for i in range(0, max(0, len(b) - 30), 9)]
    rows += [("e", 42, r"x\Ey", r"\Qz ", ""), ("n", 3, None, None, None), ("gone", 99, "a", "b", "c"), ("wide", 40, "aa", "aa", "")]
    anchors = spark.createDataFrame(rows, "record_id string, key long, exact string, prefix string, suffix string")
    d = spark.createDataFrame([*texts.items(), (50, None)], "key long, text string")
    got = {r["record_id"]: (r["found_start"], r["found_end"], r["inferred"]) for r in highlights.found_anchors(anchors, d).collect()}
    want = {r: _anchor(texts[k], *(x or "" for x in rest)) for r, k, *rest in rows if texts.get(k)}
    assert got == {r: w for r, w in want.items() if w}
    assert sum(g[2] for g in got.values()) > 20 and got["e"] == (8, 12, False) and got["wide"] == (2, 4, False)


def test_terms_of_records(spark):
    d = spark.createDataFrame([(1, "Cat, cats; CAT\r\ncat_a Café+cat"), (2, "no\u2029such a.b a.b.c"), (3, None), (4, "")], "key long, text string")
    rows = [("own", 1, "cat", False, False), ("word", 1, "cat", False, True), ("case", 1, "CAT", True, True), ("all", None, "cat", False, False), ("dots", None, "A.B", False, True), ("odd", 2, "\\E", True, False), ("blank", 1, " ", True, False), ("null", None, None, True, True), ("lost", 9, "cat", True, True), ("line", 2, "no\nsuch", True, True)]
    terms = spark.createDataFrame(rows, "record_id string, key long, exact string, case_sensitive boolean, whole_word boolean")
    got = {}
    for r in highlights.found_terms(terms, d).orderBy("found_start").collect():
        got.setdefault((r["record_id"], r["key"]), []).append((r["found_start"], r["found_end"]))
    whole = [(0, 3), (11, 14), (26, 29)]
    assert got == {("own", 1): [(0, 3), (5, 8), (11, 14), (15, 18), (26, 29)], ("word", 1): whole, ("case", 1): [(11, 14)], ("all", 1): whole, ("dots", 2): [(8, 11), (12, 15)], ("line", 2): [(0, 7)]}


def test_records_follow_their_text(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven"), (2, "alpha omega12345 x"), (3, "")], "key long, text string")
    rows = [("kept", 1, "two", "one ", " three four five six seven", "anchor"), ("moved", 1, "two", "one ", " three", "anchor"), ("inferred", 1, "gone", "one two ", " four five", "anchor"), ("empty", 2, "gone", "alpha om", "ega12345", "anchor"), ("lost", 2, "gone", "", "", "anchor"), ("void", 3, "a", "b", "c", "anchor"), ("away", 8, "a", "b", "c", "anchor")]
    records = spark.createDataFrame(rows, "record_id string, key long, exact string, prefix string, suffix string, mode string")
    got = {r["record_id"]: (r["exact"], r["prefix"], r["suffix"], r["changed"]) for r in highlights.synced_anchors(records, d).collect()}
    rest = {n: (*r[:3], False) for n, _, *r in rows if n in ("kept", "lost", "void", "away")}
    assert got == rest | {"moved": ("two", "one ", " three four five six seven", True), "inferred": ("three", "one two ", " four five six seven", True)}
    shown = records.selectExpr("*", "case when record_id = 'kept' then 'glossary' else 'mark' end as kind", "true as case_sensitive", "true as whole_word")
    assert {r["record_id"] for r in highlights.resolve_matches(shown, d).collect()} == {"kept", "moved", "inferred"}
    assert {r["record_id"] for r in highlights.resolve_matches(shown, d, glossary=False).collect()} == {"moved", "inferred"}


def _cut(text, longest):
    """Segments worked out one after another."""
    white, out = " \t\r\n\f\x0b", []
    for block in re.split(r"\n[ \t\r\n\f\x0b]*\n", text.strip(white)):
        rest = block.strip(white)
        while len(rest) > longest:
            head = rest[:longest]
            at = max(head.rfind(s) for s in (". ", "; ", ", "))
            at = at if at >= longest // 2 else longest
            out.append(rest[:at].strip(white))
            rest = rest[at:].strip(white)
        out.append(rest)
    return [x for x in out if x]


def test_segments_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "é\U0001f600", " ", ". ", ", ", "; ", "\n", "\n\n", ".", "\n \n"]) for _ in range(rng.randint(0, 200))) for _ in range(150)] + ["", None, "x" * 200, " \n ", "a" * 39 + ". " + "b" * 39]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: r["s"] for r in d.select("i", maps.segments(F.col("text"), 40).alias("s")).collect()}
    assert got == {i: None if t is None else _cut(t, 40) for i, t in enumerate(texts)}


def test_maps_by_hand(spark):
    nodes = spark.createDataFrame([(1, "b", "water cycle", 2, 0), (1, "a", "river", 2, 0), (1, "root", "Earth", 1, 6), (1, "deep", "sea", 3, 0), (1, "void", "", 2, 0), (2, "x", "stone", 1, 1)], "key long, node_id string, label string, depth int, children int")
    asked = spark.createDataFrame([(1, "What is the water for?"), (3, "nothing")], "key long, query string")
    picks = maps.frontier_rounds(nodes, asked, 9)
    got = [tuple(r) for r in picks.orderBy("key", "round").select("key", "round", "node_id", "score").collect()]
    assert got == [(1, 1, "b", 13), (1, 2, "a", 10), (1, 3, "b", 9), (1, 4, "a", 6), (2, 1, "x", 12), (2, 2, "x", 8)]
    pieces = spark.createDataFrame([(1, 1, "Rain is water."), (1, 2, "The river bends. More."), (1, 3, "Old trees grow here, slowly. Yes."), (1, 4, "12 34"), (2, 1, "rocks")], "key long, nth int, segment string")
    found = maps.evidence(picks, pieces, asked)
    assert {(r["key"], r["round"], r["nth"], r["shared"]) for r in found.collect()} == {(1, 1, 1, 1), (1, 2, 1, 1), (1, 2, 2, 1), (1, 3, 1, 1), (1, 4, 1, 1), (1, 4, 2, 1)}
    got = [tuple(r) for r in maps.coverage(picks, found, pieces).orderBy("key", "round").collect()]
    assert got == [(1, 1, 1, 0.25), (1, 2, 2, 0.5), (1, 3, 2, 0.5), (1, 4, 2, 0.5), (2, 1, 0, 0.0), (2, 2, 0, 0.0)]
    got = [tuple(r) for r in maps.gaps(pieces, found, nodes).orderBy("key", "gap").collect()]
    assert got == [(1, 1, 3, "Old trees grow here, slowly", "a"), (1, 2, 4, "Luecke 2", "a"), (2, 1, 1, "rocks", "x")]
    seeds = spark.createDataFrame([(1, 1, "Tables table format chair the"), (1, 2, "chair sofa format format"), (2, 1, "a b")], "key long, nth int, segment string")
    assert [tuple(r) for r in maps.seed_concepts(seeds, 2).orderBy("place").collect()] == [(1, 1, "chair", 2), (1, 2, "tables", 1)]


def test_grounding_by_hand(spark):
    rows = [(1, "a", "Bridges"), (1, "b", "xeno"), (1, "c", "## Markup"), (2, "a", "graph format"), (2, "b", ""), (3, "a", "rowboats at s"), (3, "b", "sea"), (5, "a", "nothing of it"), (5, "b", 'said "a" und "b"')]
    texts = [(1, "The bridge by x", ""), (2, "text", None), (3, "Two rowboats at sea", None), (4, None, "q"), (5, "", "")]
    got = maps.grounding_report(spark.createDataFrame(rows, "key long, node_id string, label string"), spark.createDataFrame(texts, "key long, text string, query string"))
    got = {r["key"]: tuple(r)[1:] for r in got.collect()}
    assert got == {
        1: (3, 2, 0.6667, 1, 0.3333, True, "grounded"), 2: (2, 0, 0.0, 1, 0.5, False, "meta_labels_detected"), 3: (2, 2, 1.0, 0, 0.0, True, "grounded"),
        4: (0, 0, 0.0, 0, 0.0, False, "grounding_missing_spec"), 5: (2, 0, 0.0, 1, 0.5, False, "meta_labels_detected"),
    }


def _alike(x, y):
    from difflib import SequenceMatcher

    return 1.0 if x == y else 0.92 if x in y or y in x else SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_similar_terms_against_all_pairs(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 45))) for _ in range(120)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 1 + len(t) // 9)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        return "".join(t)

    left = [(i % 3, i, t) for i, t in enumerate(base + ["", "  ", None, "aa", "b", "Über-Maß", "aaaaaaaaaaaaaaaaaaaa"])]
    right = [(i % 3, i, changed(t)) for i, t in enumerate(base)] + [(k, 200 + i, t) for i, t in enumerate(["a", "aab", "über maß", "aaaaaaaaaaaaaaaaaaa", "", None, "bcd"]) for k in range(3)]
    schema = "k int, {} int, term string"
    a, b = spark.createDataFrame(left, schema.format("i")), spark.createDataFrame(right, schema.format("j"))
    told = [{(r["k"], r[at]): r["t"] for r in d.select("k", at, text.glossary_normal(F.col("term")).alias("t")).collect() if r["t"]} for d, at in ((a, "i"), (b, "j"))]
    want = {(k, i, j): round(s, 9) for (k, i), x in told[0].items() for (m, j), y in told[1].items() if k == m and (s := _alike(x, y)) >= 0.9}
    got = {(r["k"], r["i"], r["j"]): round(r["score"], 9) for r in alignment.similar_terms(a, b, "k").collect()}
    assert got == want and sum(0.9 <= s < 1 and s != 0.92 for s in want.values()) > 20
    m = {r["k"]: r for r in alignment.term_metrics(a, b.where("k < 2"), "k").collect()}
    assert m[2]["generated"] == 0 and m[2]["precision"] == 0.0 and m[0]["found"] == len({i for k, i, _ in want if k == 0})


def test_glossary_metrics_against_all_pairs(spark):
    a, b = (records_of(d, at) for d, at in zip(records._terms(spark, SF), "ij"))
    got = {r["case_id"]: r["found"] for r in catalog.QUERIES["glossary_metrics"](spark, SF).collect()}
    want = {k: sum(any(_alike(x, y) >= 0.9 for y in b.get(k, [])) for x in a.get(k, [])) for k in a.keys() | b.keys()}
    assert got == want and sum(want.values()) > 0


def records_of(d, at):
    out = {}
    for r in d.select("case_id", text.glossary_normal(F.col("term")).alias("t")).where("t <> ''").collect():
        out.setdefault(r["case_id"], []).append(r["t"])
    return out


def test_variables_by_hand(spark):
    known = spark.createDataFrame([(0, "Name", "N"), (1, " a-b ", "{{name}}"), (2, "NAME", "M"), (3, "void", None), (4, "", "x"), (5, "a_b", "second"), (6, "deep", "${Name}")], "place int, name string, value string")
    rows = [(1, "${Name} ${name} ${NAME} {{ name }}"), (2, "${A B}|{{deep}}|${deep}"), (3, "${ } ${none} {{none}} ${void}."), (4, "plain $ {x}"), (5, ""), (6, None), (7, "${A_B}${a-b}")]
    got = {r["key"]: (r["text"], r["used"], r["missing"]) for r in variables.substituted(spark.createDataFrame(rows, "key int, text string"), known).collect()}
    assert got == {
        1: ("N N M N", ["Name", "name", "NAME"], []), 2: ("N|${Name}|${Name}", ["A B", "deep", "name"], []),
        3: ("${ } ${none} {{none}} .", ["void"], ["none"]), 4: ("plain $ {x}", [], []), 5: ("", [], []), 6: ("", [], []),
        7: ("secondN", ["A_B", "a-b", "name"], []),
    }


def test_outlines_by_hand(spark):
    body = "  \nintro of it\n## Deep Sea \n1.2.3 the third part\nAll About Water\nNot about it\nAll Done.\n# 12\nÜber Alles It\n" + "Long " * 20
    pieces = spark.createDataFrame([(2, 1, "first words. more"), (2, 2, "12"), (3, 1, "x")], "key long, nth int, segment string")
    docs = spark.createDataFrame([(1, body), (2, "first words. more\n\n12"), (4, ""), (5, None)], "key long, text string")
    got = maps.outline(docs, pieces)
    assert [tuple(r) for r in got.orderBy("key", "nth").collect()] == [(1, 3, "Deep Sea", 2), (1, 4, "the third part", 3), (1, 5, "All About Water", 1), (1, 9, "Über Alles It", 1), (2, 1, "first words", 1)]
    asked = spark.createDataFrame([(1, "the water and the sea"), (2, ""), (3, "yonder")], "key long, query string")
    assert [tuple(r) for r in maps.focus_sections(got, asked, 3).orderBy("key", "rank").collect()] == [(1, 1, 3, 1), (1, 2, 5, 1), (1, 3, 4, 0), (2, 1, 1, 0)]
    assert [tuple(r) for r in maps.focus_segments(pieces, asked).orderBy("key", "rank").collect()] == [(2, 1, 1, 1), (2, 2, 2, 1)]


def test_glossaries_and_tabs_by_hand(spark):
    rows = [(1, " Cat ", ["x", "feline", None], " an animal "), (2, "CAT", ["Feline", "Tiger"], "again"), (3, None, None, None), (4, "dog", [], None)]
    got = highlights.glossary_records(spark.createDataFrame(rows, "place int, term string, aliases array<string>, definition string"))
    assert {(r["exact"], r["definition"]) for r in got.collect()} == {("Cat", "an animal"), ("feline", "an animal"), ("Tiger", "again"), ("dog", "")}
    d = spark.createDataFrame([(1, "mark", ["\U0001f512 a", " ", "b"], "x\n y" + "z" * 40), (2, "glossary", ["a"], "t"), (3, None, None, None)], "record_id int, kind string, tabs array<string>, exact string")
    assert [tuple(r) for r in highlights.jump_targets(d).orderBy("record_id").collect()] == [(1, "mark", ["a", "b"], "x y" + "z" * 34 + "..."), (3, None, [], "")]
    one, none, blank = (highlights.renamed_tabs(F.col("tabs"), a, b) for a, b in (("a", "b"), ("q", "b"), ("a", " ")))
    got = [tuple(r) for r in d.orderBy("record_id").select(one, none, blank).collect()]
    assert got == [(["b"], ["\U0001f512 a", " ", "b"], ["\U0001f512 a", " ", "b"]), (["b"], ["a"], ["a"]), (None, None, None)]
