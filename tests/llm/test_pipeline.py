"""The pipeline's stages on a whole small table, each against plain Python over the rows that it got."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import language
from tests.conftest import SF
from tests.llm.test_table_operators import brute_links, shingle_set

LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave, as lists of rows."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        made = stage(spark, docs, SF).collect()
        seen.append((name, given, made))
        docs = spark.createDataFrame(made, docs.schema) if name != "tokens" else None
    return {name: (given, made) for name, given, made in seen}


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def grams(text):
    out = []
    for word in text.lower().split():
        s = "\0" + "".join(c if c.isalpha() else "\0" for c in word) + "\0"
        out += [s[i - 1 : i + 2] for i in range(1, len(s) - 1) if s[i] != "\0"]
    return out


def test_language(stages):
    given, made = stages["language"]
    counts = {}
    for r in given:
        if r["text"] is not None and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    known = set().union(*counts.values())
    alphabet = len(set().union(*known))
    kept = ids(made)
    for r in given:
        g = Counter(grams(r["text"] or ""))
        if not g:
            assert r["doc_id"] not in kept
            continue
        best = max(sum(n * math.log((c[x] + 0.5) / (c.total() + 0.5 * (len(known) + 1))) for x, n in g.items()) for c in counts.values())
        # a mixture explains a text at least as well as its best language does
        if best > -3 * math.log(alphabet) * g.total():
            assert kept[r["doc_id"]]


def repeated(words, size):
    """Which words lie in a run of `size` words that occurs twice or more."""
    places = {}
    for i in range(len(words) - size + 1):
        places.setdefault(tuple(words[i : i + size]), []).append(i)
    hit = set()
    for at in places.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + size))
    return len(hit)


def test_quality(stages):
    given, made = stages["quality"]
    want = Counter()
    for r in given:
        words = WORD.findall(r["text"] or "")
        n = len(words)
        fine = n >= 20 and 100 * repeated(words, 8) <= 30 * n and repeated(words, 4) <= 0.5 * n and not repeated(words, 101)
        want[r["doc_id"]] += fine
    assert ids(made) == +want and len(made) < len(given)


def test_near_duplicates(stages):
    given, made = stages["near_duplicates"]
    root = brute_links({r["doc_id"]: shingle_set(r["text"]) for r in given})
    assert ids(made) == Counter(i for i, x in root.items() if i == x) and len(made) < len(given)
    texts = {r["doc_id"]: r["text"] for r in given}
    assert all(texts[r["doc_id"]] == r["text"] for r in made)


def test_mixing(stages):
    given, made = stages["mixing"]
    by_source = {}
    for r in given:
        h = int(hashlib.md5(f"0/{r['doc_id']}".encode()).hexdigest()[:8], 16)
        by_source.setdefault(r["source"], []).append((h, r["doc_id"], len(WORD.findall(r["text"] or ""))))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(n for *_, n in by_source[s]) for s in order}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    want = Counter()
    for s in order:
        takes, start = int(3 * size[s] if s in capped else level * weight[s]), 0
        for _, i, n in sorted(by_source[s]):
            taken = sum(max(0, min(start + k * size[s] + n, takes) - (start + k * size[s])) for k in range(3))
            want[i] += math.floor(taken / max(n, 1) + 0.5)
            start += n
    got = ids(made)
    assert got == +want


def test_tokens(stages):
    given, made = stages["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in given)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in made) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in made)


def test_long_texts_ties_and_repeated_rows(spark):
    """A text of a million characters, equal rows, rows of one id, and nulls pass through all stages."""
    long_text = " ".join(f"the word{i} of and" for i in range(60_000))
    short = " ".join(f"of the word{i} and" for i in range(12))
    rows = [(1, long_text, "en", "a", 1), (2, short, "en", "a", 1), (2, short, "en", "a", 1), (3, short, "en", "b", None), (4, short + " end", None, None, 2), (5, None, "en", "a", 0), (6, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name == "near_duplicates":
            assert ids(docs.collect()) == Counter({1: 1, 2: 1})
    out = docs.collect()
    assert {r["doc_id"] for r in out} <= {1, 2} and all(r["round_trip"] for r in out)


def test_language_drops_texts_of_no_learned_language(spark):
    """Planted texts in other scripts and of random letters go; labelled texts that the model never saw stay. The model is
    of some 600 documents: one of about 130, of the smallest table, keeps random letters of the plain alphabet."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(120)) for _ in range(5)]
    consonants = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(120)) for _ in range(5)]
    coded = [base64.b64encode(rng.randbytes(900)).decode() for _ in range(5)]
    russian = ["Съешь же ещё этих мягких французских булок, да выпей чаю на берегу реки вечером. " * 5, "Однажды весною, в час небывало жаркого заката, в Москве появились два гражданина. " * 5]
    greek = ["Ο ήλιος ανατέλλει κάθε πρωί πάνω από τη θάλασσα και τα βουνά της πατρίδας μας. " * 5]
    planted = noise + consonants + coded + russian + greek
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where("text is not null and lang is not null")
    rows = [r.asDict() for r in docs.collect()]
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    unseen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    model = language.fit(spark.createDataFrame(learned, docs.schema))
    asked = [(10**6 + i, t) for i, t in enumerate(planted)] + [(r["doc_id"], r["text"]) for r in unseen]
    fits = {r["doc_id"]: r["fits"] for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model, keep=("doc_id",)).collect()}
    assert len(fits) == len(asked)
    assert not [planted[i - 10**6][:40] for i, ok in fits.items() if ok and i >= 10**6]
    # those that go are not prose: too few letters to tell a language from chance
    gone = [r["text"] for r in unseen if not fits[r["doc_id"]]]
    assert len(unseen) > 200 and not [t for t in gone if sum(map(str.isalpha, t)) >= 100]


def test_language_stage_drops_planted_texts(spark):
    """The stage itself, over the whole table with texts of random letters among its rows."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    odd = [r.asDict() | {"doc_id": 10**6 + i, "lang": None, "text": " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxzq", k=6)) for _ in range(80))} for i, r in enumerate(docs.limit(10).collect())]
    kept = ids(corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(odd, docs.schema)), SF).collect())
    assert not [i for i in kept if i >= 10**6]
    assert sum(kept.values()) == sum(ids(corpus_pipeline.identify_language(spark, docs, SF).collect()).values())
