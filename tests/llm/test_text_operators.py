"""BPE, language, quality, extraction: per-document operators against brute force and libraries."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe, extraction, language, quality
from corpusloom.llm.queries import QUERIES, vocabulary

ODD = [
    "", " ", "<|endoftext|>a<|endoftext|>  b", "a \n b\n\n  c\t d", "\x1c x\x85y 　z", " " * 50, "a" * 5000, "don't you'll I'VE  'd", "日本語テキスト😀😀 é́",
    "\x00\x01 12345 ½ ٣", "ab" * 3000 + "  ", "à Å \xa0 x", "﻿x", "'''s 's'S",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(vocabulary())


def test_bpe_odd_texts(library, codec):
    for text in ODD:
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abehinorst \n'#1é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_any_text(text):
    lib, own = test_bpe_any_text.lib, test_bpe_any_text.own
    assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


test_bpe_any_text.lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
test_bpe_any_text.own = bpe.Codec(vocabulary())


def test_bpe_table(spark, library):
    rows = [(1, None, 7), (1, "a b", 8), (1, "a b", 8), (None, "x", 9), (4, "w " * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.round_trip(df, vocabulary()).collect()
    assert len(out) == 5
    for r in out:
        text = {None: "x", 4: rows[4][1]}.get(r["doc_id"], r["decoded"])
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["decoded"] == text
    assert bpe.round_trip(df.limit(0), vocabulary()).count() == 0


def brute_repeats(words, least):
    n, longest = len(words), 0
    covered = [False] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered[i : i + k] = covered[j : j + k] = [True] * k
    return sum(covered), longest


def test_quality_against_brute_force():
    rng = random.Random(1)
    texts = ["", "one", "a b " * 40, "à Å x\xa0y à Å x\xa0y"]
    for n in (5, 30, 80, 150):
        for alphabet in (1, 2, 5, 40):
            words = [f"w{rng.randrange(alphabet)}" for _ in range(n)]
            texts.append(" \n".join(words) + " " + " ".join(words[: rng.randrange(n)]))
    for window, least in ((8, 4), (4, 4), (3, 8)):
        got = [c.to_pylist() for c in quality.measure(pa.array(texts), window, least)]
        for i, t in enumerate(texts):
            words = t.encode().split()
            assert got[0][i] == len(words)
            assert got[1][i] == sum(len(w.decode()) for w in words)
            assert got[4][i] == brute_repeats(words, window)[0]
            assert (got[6][i], got[5][i]) == brute_repeats(words, least)
            assert sum(s["end"] - s["start"] for s in got[7][i]) == got[6][i]


def test_quality_counts_and_verdicts(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "x # y\nx # y\n\n \nx # y"), (4, prose), (5, prose + " " + prose), (6, "hum " * 100), (7, "été <b>|$% " + prose)]
    out = {r["doc_id"]: r for r in quality.judged(quality.measured(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int"))).collect()}
    assert (out[1]["n_words"], out[1]["kept"], out[1]["repeat_spans"]) == (0, False, [])
    assert (out[3]["n_symbols"], out[3]["n_dup_lines"], out[3]["n_words"]) == (3, 2, 9)
    assert out[4]["kept"] and not out[4]["base_failed"]
    assert out[5]["base_failed"] and out[5]["longest_repeat"] == 60
    assert not out[6]["kept"] and out[6]["covered_words"] == 100
    assert out[7]["n_symbols"] == 5 and out[7]["word_chars"] == sum(map(len, rows[6][1].split()))


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in QUERIES["op3_language_id"](spark, sf).collect() if r["held_out"]]
    assert np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.98


def test_language_mixtures_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    pure = language.identify(docs, model, keep=("lang", "text")).where("score > 0.99 and length(text) between 2000 and 6000 and text not like '%|%'")
    one = {r["lang"]: r["text"] for r in pure.collect()}
    cut = lambda lang, n: " ".join(one[lang].split()[:n])
    rows = [(1, cut("de", 150) + " " + cut("fr", 50)), (2, None), (3, "123 ### \n"), (4, ""), (5, cut("es", 200)), (5, cut("es", 200))]
    out = [(r["doc_id"], r) for r in language.identify(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double"), model).collect()]
    by = dict(out)
    assert len(out) == 6 and by[1]["lang_pred"] == "de" and by[1]["languages"] == ["de", "fr"] and abs(by[1]["score"] - 0.75) < 0.08
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4))
    assert by[5]["lang_pred"] == "es" and by[5]["score"] > 0.95
    empty = docs.limit(0)
    assert language.fit(empty) is None
    assert language.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def plain_em(like, langs):
    """Proportions and log-likelihood by textbook EM, word by word."""
    share = {k: 1 / len(langs) for k in langs}
    for _ in range(3000):
        total = dict.fromkeys(langs, 0.0)
        for row in like:
            z = sum(share[k] * row[k] for k in langs)
            for k in langs:
                total[k] += share[k] * row[k] / z
        before, share = share, {k: v / len(like) for k, v in total.items()}
        if max(abs(share[k] - before[k]) for k in langs) < 1e-6:
            break
    return share, sum(math.log(sum(share[k] * row[k] for k in langs)) for row in like)


def test_language_sets_against_plain_em_over_all_subsets():
    rng = np.random.default_rng(2)
    cases = [(1.0,), (0.7, 0.3), (0.5, 0.3, 0.2), (0.3, 0.2, 0.2, 0.15, 0.15), (0.9, 0.1)]
    docs, logs, want = [], [], []
    for d, mix in enumerate(cases):
        spoken = rng.choice(len(mix), 60, p=mix)
        log = rng.normal(-9, 1, (60, 5))
        log[np.arange(60), spoken] += 4
        docs += [d] * 60
        logs.append(log)
        sets = [s for k in range(1, 6) for s in itertools.combinations(range(5), k)]
        fits = {s: plain_em(np.exp(log), s) for s in sets}
        best = max(sets, key=lambda s: fits[s][1] - len(s) * 0.5 * math.log(60))
        want.append((best, fits[best]))
    share, like = language.select(np.array(docs), np.concatenate(logs))
    for d, (best, (parts, total)) in enumerate(want):
        assert tuple(np.flatnonzero(share[d])) == best and abs(like[d] - total) < 0.01
        assert all(abs(share[d, k] - parts[k]) < 0.005 for k in best)


def test_trigram_counts_against_brute_force(spark):
    df = spark.createDataFrame([("x", "Ab ab. c"), ("y", "ab"), ("y", None)], "lang string, text string").selectExpr("1L AS doc_id", "lang", "text")
    model = language.fit(df)
    want = {}
    for lang, words in (("x", ["ab", "ab", "c"]), ("y", ["ab"])):
        want[lang] = Counter(f"\0{w}\0"[i : i + 3] for w in words for i in range(len(w)))
    total = {k: sum(v.values()) + language.SMOOTHING * (len(model.codes) + 1) for k, v in want.items()}
    for row, code in enumerate(model.codes):
        gram = "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0))
        for k, lang in enumerate(model.languages):
            assert np.isclose(model.log[row, k], np.log((want[lang][gram] + language.SMOOTHING) / total[lang]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for you and for all of the others who come to it from the other sites</div>
<aside><p>The news of the week, and the other things that are in the world for you to read, and to think of, when you have the time for it</p></aside>
<main><article><h2>Title</h2><p>It was the best of times &amp; it was the worst of times, and this is a paragraph that is
 long enough to be decided by the rules of the first pass, since it holds many of the words that any prose in the language holds.<p><b>Short</b>&nbsp;one.
<form><input><button>Send</button></form><!-- <p>no</p> --><p>Last.</article>
<section id="comments"><p>I think that this is a very good article, and I would like to read more of it in the future, if that is possible for you to do.</p></section></main>
<footer>&copy; x</footer></body></html>"""


def test_extraction():
    text = extraction.main_text(PAGE).split("\n\n")
    assert text[0] == "Title" and text[1].startswith("It was the best of times & it") and text[1].endswith("language holds.")
    assert text[2:] == ["Short one.", "Last."]
    assert extraction.main_text("<p>Hello</p>") == "Hello"
    assert extraction.main_text("plain &lt; text <b") == "plain < text <b"
    assert extraction.main_text("<div class=ad>x</div>") == "" == extraction.main_text("")
    long_text = "This is the text of the page, and it is one of the longest that there are in the world. " * 20000
    assert extraction.main_text(f"<body><p>{long_text}</p>") == long_text.strip()


def test_extraction_in_other_languages():
    """Pages of two long paragraphs in languages without stop words here keep both, and only both."""
    texts = {
        "ru": ["Весной река поднялась выше обычного, и старый мост пришлось закрыть на несколько недель. ", "Рабочие привезли новые балки, а жители соседних деревень переправлялись на лодках. "],
        "it": ["Quando arrivarono sulla collina videro finalmente tutta quella valle coperta dalla neve appena caduta. ", "Nessuno parlava, perché ciascuno ricordava quanto fosse stato faticoso salire fino lassù. "],
        "zh": ["春天河水上涨，旧桥不得不关闭了几个星期，附近村庄的居民只能乘船过河。", "工人们运来了新的横梁，孩子们每天放学以后都跑到岸边观看施工的进展。"],
        "en": ["When the river rose in the spring the old bridge had to be closed for some weeks. ", "The workers brought new beams and the people of the villages crossed in boats. "],
    }
    for parts in texts.values():
        parts = [(p * 6).strip() for p in parts]
        page = f"<html><body><div class='menu'><a href=/>x</a></div><div>{parts[0]}</div><div>{parts[1]}</div><div><a href=/a>{parts[0]}</a></div></body></html>"
        assert extraction.main_text(page) == "\n\n".join(parts)


def test_extraction_keeps_article_text_with_hinting_names():
    one, two = ("It was the best of times and it was the worst of times for all of the people that were in the city. " * 4).strip(), "This is the second of the paragraphs, and it is as long as it has to be for the rules of the first pass."
    page = f'<article><p id="share-prices">{one}</p><section class="social"><p>{two}</p></section><div class="share">Share this</div><div class="cookie-notice">{two}</div><p class="ad">{two}</p></article>'
    assert extraction.main_text(page) == f"{one}\n\n{two}"


PROSE = "The harbour lies in the north of the town and was built for the ships that came with the grain of the islands. "
RUSSIAN = "Гавань лежит на севере города и была построена для судов. Они привозили зерно с островов, и город жил этим много лет. "


@pytest.mark.parametrize(
    "piece,text",
    [
        ('<p>It is named after <a href="/x">the old lighthouse.</a> that stood on a rock in front of the town and is gone.</p>',) * 2,
        ('<p>See <a href="/x">the first report of it</a> and <a href="/y">the second one</a>.</p>',) * 2,
        ('<ul><li><a href="/1">Smith, On harbours, 1911</a></li></ul>', "Smith, On harbours, 1911"),
        (f'<p class="notice">{PROSE}</p>',) * 2,
        (f'<blockquote class="comment">{PROSE}</blockquote>',) * 2,
        (f'<section id="login-flow"><p>{PROSE * 2}</p></section>',) * 2,
        (f'<div class="dialog">{PROSE * 2}</div>',) * 2,
        ('<header class="entry-header"><h1>The harbour</h1></header>',) * 2,
        (f"<p>{RUSSIAN * 3}</p>",) * 2,
    ],
)
def test_extraction_keeps_all_of_an_article(piece, text):
    import re

    text = " ".join(re.sub("<[^>]*>", "", text).split())
    page = f'<body><nav><a href="/">Home</a></nav><header><h2>Site</h2></header><article><p>{PROSE * 3}</p>{piece}<p>{PROSE * 3}</p></article><footer>&copy; x</footer>'
    assert extraction.main_text(page) == "\n\n".join([(PROSE * 3).strip(), text, (PROSE * 3).strip()])


@pytest.mark.parametrize("piece", ['<div class="comments"><p>{}</p></div>', '<div class="comment">{}</div>', '<div class="cookie-notice">{}</div>', '<p class="ad">short one</p>', '<aside>{}</aside>', '<form><p>{}</p></form>', '<nav>{}</nav>', '<ol class="commentlist"><li>{}</li></ol>'])
def test_extraction_still_drops_what_is_not_of_the_article(piece):
    page = f"<body><article><p>{PROSE * 3}</p>{piece.format(PROSE * 2)}</article>"
    assert extraction.main_text(page) == (PROSE * 3).strip()


def test_extraction_without_article():
    pre = "x = harbour.ships(1911)[:20] + harbour.ships(1912)[:20] + harbour.ships(1913)[:20]"
    parts = ["It is the oldest harbour of the islands.", (PROSE * 3).strip(), pre, (PROSE * 3).strip(), (RUSSIAN * 3).strip(), "It was closed in the spring of 1911."]
    body = "".join(f"<pre>{t}</pre>" if t == pre else f"<p>{t}</p>" for t in parts)
    page = f'<body><div class="nav"><a href="/">Home</a> <a href="/a">About the town</a></div><div>{body}</div><div><a href="/p">Privacy</a> <a href="/i">Imprint</a></div>'
    assert extraction.main_text(page) == "\n\n".join(parts)


def test_extraction_of_the_generated_pages(spark):
    """The pages' articles are known by their markup: the text has just their blocks, whole and in order."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extraction.extract(pages, keep=("page_id", "html")).collect():
        inner = re.search("(?s)<article>(.*)</article>", r["html"] or "")
        pieces = [" ".join(html.unescape(re.sub("(?i)<br[^>]*>", " ", re.sub(r"(?i)</?(?:b|i|em|strong|a)\b[^>]*>", "", p))).split()) for p in re.split(r"(?i)</?(?:p|h\d|ul|ol|li|div|table|tr|td|blockquote|pre)\b[^>]*>", inner[1] if inner else "")]
        assert r["text"] == "\n\n".join(p for p in pieces if p), r["page_id"]


def test_extraction_table(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", PAGE, 2), (None, None, "", 3)], "page_id long, url string, html string, n_chars long")
    out = extraction.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in out.collect())[:2] == [0, 0]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    import html
    import re

    for r in pages:
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
