"""What has to stay bounded as tables grow, held on small ones."""

import random
import tracemalloc
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusloom.operators import alignment, chunking, excerpts, lexical, maps, matching, retrieval, variables
from corpusloom.plans import answers, atlas, catalog, records, scores  # noqa: F401  the others register their queries in the catalog
from corpusloom.session import Scratch


def test_terms_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, write = {}, Scratch.__call__

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "__call__", noted)
    a, b = (spark.createDataFrame([(k, n, f"term {k} {n}") for k in range(3) for n in range(4)], f"k int, {at} int, term string") for at in "ij")
    assert alignment.term_metrics(a, b, "k").select("found").distinct().collect() == [(4,)]
    # only the counts of the runs, which are counted before, go to all tasks
    assert plans["alike"].count("BroadcastHashJoin") == 2


def test_index_log_is_not_larger_than_its_texts(spark, tmp_path):
    from corpusloom.streaming import index

    path = f"{tmp_path}/log"
    texts = spark.range(20).selectExpr("id as key", "concat_ws(' ', transform(sequence(1, 400), i -> substr(md5(concat(id, ':', i)), 1, 6))) as text", "false as removed", "0 as seq")
    texts = texts.withColumn("text", F.translate("text", "0123456789", "ghijklmnop"))
    for i in range(3):
        index.apply_changes(texts, i, path)
    # a change of a document is one row, and takes back nothing
    assert spark.read.parquet(path).count() == 60
    assert sorted(tuple(r) for r in index.term_table(spark, path, "bigint").collect()) == sorted(tuple(r) for r in lexical.term_stats(texts, "key").collect())


def test_chunks_leave_in_small_frames():
    text = "# One\n\n" + "\n\n".join(["## Two", *("some words of it " * 10 for _ in range(60))])
    frame = pd.DataFrame({"key": range(50), "text": [text] * 50, "name": ["n"] * 50})
    got = list(chunking._frames(frame, "recursive", 800, 100, 200_000))
    assert len(got) > 5 and all(f["parent_text"].str.len().sum() + f["raw_text"].str.len().sum() < 250_000 for f in got)
    want = [(k, i, *c) for k in range(50) for i, c in enumerate(chunking.chunks_of(text, "n", "recursive", 800, 100))]
    assert [tuple(r) for f in got for r in f.itertuples(index=False)] == want


def test_memory_of_a_block_does_not_grow_with_its_queries():
    made = np.random.default_rng(0)
    a, b = made.integers(1, 4, (3000, 4)).astype(float), made.integers(1, 4, (4000, 4)).astype(float)  # many ties
    tracemalloc.start()
    row, col, score = retrieval.best_of_block(a, b, 7)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # all pairs are 96 MB
    tracemalloc.stop()
    sims = (b / np.linalg.norm(b, axis=1)[:, None]) @ (a / np.linalg.norm(a, axis=1)[:, None]).T
    order = np.argsort(-sims.round(12), axis=1, kind="stable")[:, :7]
    assert (row == np.repeat(np.arange(4000), 7)).all() and (col == order.ravel()).all() and np.allclose(score, np.take_along_axis(sims, order, 1).ravel())


def test_frequent_names_are_no_task_of_their_own(spark, monkeypatch):
    plans, write = {}, Scratch.__call__

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "__call__", noted)
    monkeypatch.setattr(variables, "MOST_NAMES", 10)
    texts = spark.createDataFrame([(i, "${a} and {{b}}") for i in range(9)], "key long, text string")
    known = spark.createDataFrame([(0, "A", "x"), (1, "b", "y")], "place int, name string, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = variables.substituted(texts, known)
        assert {tuple(r) for r in out.select("text", F.array_join("used", ",")).collect()} == {("x and y", "a,b")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [name" in plans["first"]


def test_words_of_maps_are_dealt_out_once_and_not_as_postings(spark):
    pieces = spark.createDataFrame([(1, 1, "bridge over water bridge"), (1, 2, ""), (2, 1, "a b")], "key long, nth int, segment string")
    shuffles = lambda d: [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    seeds = maps.seed_concepts(pieces, 2)
    assert [tuple(r)[:3] for r in seeds.orderBy("place").collect()] == [(1, 1, "bridge"), (1, 2, "over")]
    assert not any("word" in x for x in shuffles(maps.seed_concepts(pieces, 2)))
    picks = spark.createDataFrame([(1, 1, "water over"), (1, 2, "bridge")], "key long, round int, label string")
    asked = spark.createDataFrame([(1, None)], "key long, query string")
    found = maps.evidence(picks, pieces, asked)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 1, 2), (1, 2, 1, 1)]
    assert not any("word" in x for x in shuffles(maps.evidence(picks, pieces, asked)))


def test_postings_are_a_row_a_document_and_scores_stay_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "ASKED", 2)
    monkeypatch.setattr(lexical, "CELLS", 8)
    words = "alpha beta gamma delta omega".split()
    rows = [(i, " ".join(words[(i * j) % 5] for j in range(i % 7))) for i in range(40)] + [(3, "beta beta"), (3, "omega alpha"), (5, None), (None, "alpha beta"), (None, "beta omega")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(words[i : i + 2])) for i in range(5)], "qid long, query string")
    held = lexical.index(docs, asked)
    assert held.rows.count() == len(set(rows))
    plain = lambda d: sorted((r["qid"], -1 if r["key"] is None else r["key"], round(r["score"], 9), r["rank"]) for r in d.collect())
    for score in (lexical.bm25, lexical.tfidf):
        best = score(held, most=4)
        assert "key#" in best._jdf.queryExecution().executedPlan().toString() and "HashAggregate" not in best._jdf.queryExecution().executedPlan().toString()
        assert plain(lexical.top_k(best, 4)) == plain(lexical.top_k(score(held), 4))
    monkeypatch.setattr(lexical, "MOST_TERMS", 0)
    assert lexical.index(docs, asked).rows is None


def test_facts_are_found_where_sources_are_read(spark, monkeypatch):
    facts = spark.createDataFrame([(1, "One  two three"), (2, "one two THREE"), (3, "short"), (4, "two three"), (5, "absent words here")], "fact_id long, fact string")
    docs = spark.createDataFrame([(1, "so one\ttwo three, one two three"), (1, "two three"), (2, None), (None, "zone two threes")], "key long, text string")
    found = matching.evidence_containment(facts, docs)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, found.collect())) == sorted(f"Row(fact_id={f}, key={k})" for f, k in [(1, 1), (2, 1), (4, 1), (4, 1), (1, None), (2, None), (4, None)])
    monkeypatch.setattr(matching, "MOST_FACTS", 0)
    assert set(map(str, matching.evidence_containment(facts, docs.dropna()).collect())) == set(map(str, found.dropna().collect()))


def test_parts_of_a_text_are_made_once(spark):
    d = spark.createDataFrame([("a\n\nA \n b\nc c\nC  c\nb",), (None,), ("",)], "t string")
    out = d.select(matching.without_repeats(F.col("t"), r"\n+").alias("l"))
    assert [r["l"] for r in out.collect()] == [["a", "b", "c c", "b"], None, []]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_overlaps_are_found_at_the_edge_of_blocks_only(spark):
    run, odd = "x" * 45, "abcdefgh" * 6
    merge = lambda *blocks: spark.createDataFrame([(list(blocks),)], "l array<string>").select(excerpts.merged_blocks(F.col("l")).alias("t")).first()["t"]
    # what a block says twice, parted by the mark, is no overlap with the next one
    assert merge(f"one {run}{excerpts.PART}{run} two", "three " * 9) == f"one {run}{excerpts.PART}{run} two\n\n" + ("three " * 9).strip()
    # the block's first characters stand at two places, and only from the second does it go on alike
    assert merge(f"{odd}!{odd}yes", f"{odd}yes and more") == f"{odd}!{odd}yes and more"
    assert merge(f"so {odd}", f"{odd} and more") == f"so {odd} and more"


def test_labels_and_blocks_are_made_in_steps_of_their_own(spark):
    for name in ("label_grounded", "overlap_merge"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(array(" in plan, name
    # segments and headings are read from tables, not cut again
    plan = catalog.QUERIES["source_focus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_characters_are_compared_once_and_no_further_than_needed(spark, monkeypatch):
    rows = [(1, ["The sky is blue today.", "Water boils."], ["water boils at 100 degrees.", "The sky was blue."]), (2, ["x"], None)]
    d = spark.createDataFrame(rows, "id int, expected array<string>, observed array<string>")
    plan = alignment.scored_pairs(d, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("array_intersect") == 1
    # lists are read from a table, not made again for each side
    assert "transform(" not in alignment.match_metrics(d.withColumn("expected", F.transform("expected", F.lower)), "id")._jdf.queryExecution().optimizedPlan().toString()
    made = random.Random(0)
    for n in range(3000):
        a, b = ("".join(made.choices(("ab", "abcde ", "etaoin shr", "aé漢𝄞 ")[n % 4], k=made.randrange(30))) for _ in range(2))
        b = a[: made.randrange(20)] + b + a[made.randrange(5, 30) :] if n % 3 == 0 else b
        held = SequenceMatcher(None, a, b, autojunk=False)
        same, ratio = sum(x.size for x in held.get_matching_blocks()), held.ratio()
        assert [alignment.agreeing(a, b, x) for x in (0, same, same + 1)] == [same, same, 0], (a, b)
        assert [alignment.likeness(a, b, x) for x in (0, ratio)] == [ratio, ratio], (a, b)
    monkeypatch.setattr(alignment, "LONGEST", 5)
    assert alignment.likeness("a longer one", "one longer") == SequenceMatcher(None, "a longer one", "one longer", autojunk=False).ratio()
    assert alignment.likeness("a longer one", "xyz", 0.9) == 0


def test_sentences_are_scored_where_they_are_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical, "CELLS", 8)
    words = "alpha beta gamma delta omega".split()
    rows = [(i, ". ".join(" ".join(words[(i * j + s) % 5] for j in range(1 + i % 6)) for s in range(1 + i % 3))) for i in range(40)]
    rows += [(3, "beta beta. alpha"), (3, "omega alpha"), (5, None), (None, "alpha beta"), (None, "beta omega. gamma"), (77, "")]
    asked = [(i, " ".join(words[i : i + 3])) for i in range(5)] + [(7, "absent"), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # a key's rows are one document, whose parts add up
    met = {}
    for doc, text in rows:
        for i, part in enumerate(x for x in (text or "").split(". ") if x):
            for q, said in asked:
                if shared := len(set(said.split()) & set(part.split())):
                    met[q, doc, i + 1] = met.get((q, doc, i + 1), 0) + shared / len(set(said.split()))
    want = []
    for q, _ in asked:
        best = sorted(((-round(s, 9), -1 if d is None else d, c) for (k, d, c), s in met.items() if k == q))[:8]
        want += [(q, d, c, round(-s, 6), r + 1) for r, (s, d, c) in enumerate(best)]
    out = catalog.QUERIES["source_search"](spark, str(tmp_path))
    assert sorted((r["qid"], -1 if r["doc_id"] is None else r["doc_id"], r["chunk"], r["score"], r["rank"]) for r in out.collect()) == sorted(want)
    # no sentence of a document with an id of its own is dealt out, and no pair of query and sentence is a row
    plan = catalog.QUERIES["source_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(key" not in plan and "HashAggregate" not in plan


def test_terms_of_a_key_meet_in_one_task_and_not_by_their_runs(spark, monkeypatch):
    held, write = {}, Scratch.__call__

    def noted(self, df, name):
        out = write(self, df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "__call__", noted)
    monkeypatch.setattr(alignment, "FRAME", 3)
    made = random.Random(3)
    terms = lambda n: ["".join(made.choices("abc ", k=made.randint(1, 14))) for _ in range(n)]
    rows = [(k, i, t) for k in range(30) for i, t in enumerate(terms(12))] + [(1, 0, "again a"), (None, 0, "a b"), (3, 40, None), (50, 0, "alone")]
    others = [(k, i, t[:3] + "x"[: i % 2] + t[3:]) for k, i, t in rows if t] + [(k, 20 + i, t) for k in range(25) for i, t in enumerate(terms(3))]
    a, b = (spark.createDataFrame(x, f"k int, {at} int, term string").repartition(3) for x, at in ((rows, "i"), (others, "j")))
    plain = lambda d: sorted(tuple(r) for r in d.collect())
    # all keys are few here: not one run is written, where each term had all of its own
    few, metrics = plain(alignment.similar_terms(a, b, "k")), plain(alignment.term_metrics(a, b, "k").na.fill(-1, ["k"]))
    assert held["a"] == held["b"] == held["often"] == 0 and held["alike"] == len(few) > 100
    # keys of many terms meet by their runs, some or all, and that gives the same
    for most in (13, 0):
        monkeypatch.setattr(alignment, "MOST_LISTED", most)
        assert plain(alignment.similar_terms(a, b, "k")) == few and held["a"] > 0
        assert plain(alignment.term_metrics(a, b, "k").na.fill(-1, ["k"])) == metrics


def test_alike_terms_equal_all_pairs():
    made = random.Random(5)
    for n in range(600):
        letters = ("ab", "abc ", "abcdefgh ", "aé漢𝄞 ")[n % 4]
        xs = {"".join(made.choices(letters, k=made.randint(1, (8, 24, 60)[n % 3]))) for _ in range(6)}
        ys = {x[:at] + made.choice(["", "x", "a"]) + x[at + made.randint(0, 1) :] for x in xs for at in (made.randint(0, len(x)), 0)} - {""}
        within = (0.92, 0.5)[n % 5 == 0]
        want = {(x, y): 1.0 if x == y else within if x in y or y in x else SequenceMatcher(None, x, y, autojunk=False).ratio() for x in xs for y in ys}
        got = [*alignment.alike(xs, ys, within)]
        assert {(x, y): s for x, y, s in got} == {p: s for p, s in want.items() if s >= 0.9} and len(got) == len(set(got))


def test_lists_of_terms_meet_in_their_row(spark, monkeypatch):
    made = random.Random(4)
    terms = lambda n: [*dict.fromkeys("".join(made.choices("abc ", k=made.randint(1, 14))) for _ in range(n))]
    rows = [(k, xs := terms(8), terms(5) + [x[:4] + "b" + x[4:] for x in xs[::2]]) for k in range(30)]
    rows += [(40, ["a", "b c", ""], None), (41, None, ["x"]), (42, None, None), (43, [], []), (44, ["--", None, "same it"], ["same it", "- "]), (45, terms(60), terms(50))]
    odd = [(3, ["again a"], terms(4)), (None, ["a b"], ["a b"]), (None, ["c"], None), (50, ["alone"], ["alone"]), (50, ["alone"], ["alone"])]
    plain = lambda d: sorted(tuple(r) for r in d.na.fill(-1, ["k"]).collect())
    dealt, term_metrics = [], alignment.term_metrics
    monkeypatch.setattr(alignment, "term_metrics", lambda *a: dealt.append(a[0].select("k").distinct().count()) or term_metrics(*a))
    for more, most, keys in ((odd, 20, [4]), (odd, 1000, [3]), ([], 1000, [])):
        d = spark.createDataFrame(rows + more, "k long, expected array<string>, generated array<string>").repartition(3)
        monkeypatch.setattr(alignment, "MOST_BESIDE", most)
        got = plain(alignment.listed_term_metrics(d, "k"))
        assert dealt == keys
        dealt.clear()
        assert got == plain(term_metrics(*(d.select("k", F.posexplode(c).alias(at, "term")) for c, at in (("expected", "i"), ("generated", "j"))), "k"))
        assert len(got) == (37 if more else 34) and sum(r[3] for r in got) > 60
    # terms are not written, nor dealt out by their key
    held, write = {}, Scratch.__call__
    monkeypatch.setattr(Scratch, "__call__", lambda self, df, name: held.setdefault(name, df.columns) and write(self, df, name))
    assert catalog.QUERIES["glossary_metrics"](spark, "/root/testdata/sf0.001").count() > 0
    assert held == {"again": ["case_id"], "told": ["case_id", "expected", "generated", "found"], "rest": ["case_id"]}
