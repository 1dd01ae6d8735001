"""Language identification by mixture inference: each document's language proportions by expectation-maximisation over
character n-gram likelihoods, its set of languages by penalised likelihood."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import per_text, slices
from corpusloom.llm.words import numbered

# documents of each language that the model is fitted on, about: a hash of the id draws them where there are more
TRAINING_DOCS = 5000
SMOOTHING = 0.5
# EM ends when no proportion of a document moves by more than this; the rounds are a guard against endless ones
SETTLED, ROUNDS = 1e-4, 2000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document and word number of every word of a column of texts, and the distinct lower-case words."""
    doc, word, distinct = numbered([t.lower().encode() if t else b"" for t in texts.to_pylist()])
    return doc, word, [w.decode() for w in distinct]


def trigrams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, code) of a trigram round every letter; what isn't a letter is a boundary."""
    codes = np.frombuffer(("\0" + "\0".join(distinct) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.cumsum(codes == 0) - 1
    codes = np.where(letters()[codes], codes, 0)
    at = np.flatnonzero(codes[1:-1]) + 1
    return owner[at], codes[at - 1] << 42 | codes[at] << 21 | codes[at + 1]


class Model:
    """Log-probabilities of trigrams in each language, with additive smoothing."""

    def __init__(self, languages: list[str], rows: list):
        self.languages = languages
        number = {x: i for i, x in enumerate(languages)}
        of = np.array([number[r["lang"]] for r in rows], np.int64)
        code, n = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
        self.codes, inverse = np.unique(code, return_inverse=True)
        counts = np.zeros((len(self.codes) + 1, len(languages)))
        np.add.at(counts, (inverse, of), n)
        # log-probability of a trigram whose characters are drawn at random from those of the labelled texts
        self.random = -3 * np.log(len(np.unique([self.codes >> k & 0x1FFFFF for k in (0, 21, 42)])) or 1)
        self.log = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * len(counts))

    def of_words(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each distinct word in each language, and its number of letters."""
        owner, code = trigrams(distinct)
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        log = self.log[np.where(known, at, len(self.codes))]
        size = np.bincount(owner, minlength=len(distinct))
        return np.stack([np.bincount(owner, log[:, k], len(distinct)) for k in range(len(self.languages))], 1), size


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, 0)


def _starts(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])


def mixture(doc: np.ndarray, like: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each document, and its log-likelihood, by EM over its words until they
    settle. doc: sorted, without gaps; like: words x languages; allowed: documents x languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    going = np.arange(len(allowed))
    at, own = doc, like
    for _ in range(ROUNDS):
        starts = _starts(at)
        part = share[going][at] * own
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
        after = _sums(part, starts) / np.diff(np.r_[starts, len(at)])[:, None]
        moving = np.abs(after - share[going]).max(1) > SETTLED
        share[going] = after
        if not moving.any():
            break
        if not moving.all():
            words = moving[at]
            at, own, going = (np.cumsum(moving) - 1)[at[words]], own[words], going[moving]
    mixed = np.maximum((share[doc] * like).sum(1), 1e-300)
    return share, _sums(np.log(mixed), _starts(doc))


def select(doc: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages of each document (those outside its set: 0), and the log-likelihood. The set begins
    with the best language by itself and takes in others while the likelihood less half a log(words) for each language
    grows.

    The likelihood is concave in the proportions, so that its slope in the direction of a language bounds what that can
    add: only languages whose slope is over the penalty are fitted at all, the steepest first, and nothing is lost."""
    starts = _starts(doc)
    n = np.diff(np.r_[starts, len(doc)])
    top = log.max(1)
    like = np.exp(np.maximum(log - top[:, None], -700))
    single = _sums(log, starts)
    first = single.argmax(1)
    held = np.arange(log.shape[1]) == first[:, None]
    share = held.astype(float)
    best = single.max(1) - _sums(top, starts)
    penalty = 0.5 * np.log(np.maximum(n, 2))
    open_to = ~held
    going = np.arange(len(n))
    at, own = doc, like
    while len(going):
        mixed = np.maximum((share[going][at] * own).sum(1, keepdims=True), 1e-300)
        slope = _sums(own / mixed, _starts(at)) - n[going, None]
        slope[~open_to[going]] = -np.inf
        steepest = slope.argmax(1)
        hopeful = slope[np.arange(len(going)), steepest] > penalty[going]
        words = hopeful[at]
        at, own, going, steepest = (np.cumsum(hopeful) - 1)[at[words]], own[words], going[hopeful], steepest[hopeful]
        if not len(going):
            break
        allowed = held[going].copy()
        allowed[np.arange(len(going)), steepest] = True
        fitted, gain = mixture(at, own, allowed)
        open_to[going, steepest] = False
        better = gain - penalty[going] > best[going]
        won = going[better]
        held[won, steepest[better]], share[won], best[won] = True, fitted[better], gain[better] - penalty[won]
    return share, _sums(top + np.log(np.maximum((share[doc] * like).sum(1), 1e-300)), starts)


def infer(texts: pa.Array, model: Model | None) -> tuple[list[str], list[float], list[list[str]], list[list[float]], list[bool]]:
    """lang_pred, score, languages, proportions and fits of each text.

    The prediction is the largest part of the text's mixture, ties to the first by name, and the score that part's
    proportion. fits: whether the mixture explains the letters better than characters drawn at random do. Texts without a
    letter: `und`, 0, no languages, and they don't fit."""
    count = len(texts)
    pred, score, sets, parts, fits = [UNKNOWN] * count, [0.0] * count, [[] for _ in range(count)], [[] for _ in range(count)], [False] * count
    if not model or not model.languages or not count:
        return pred, score, sets, parts, fits
    doc, word, distinct = words(texts)
    by_word, size = model.of_words(distinct)
    voiced = size[word] > 0
    doc, word = doc[voiced], word[voiced]
    if not len(doc):
        return pred, score, sets, parts, fits
    present, doc = np.unique(doc, return_inverse=True)
    share, like = select(doc, by_word[word])
    letters_in = np.bincount(doc, size[word])
    explained = like > model.random * letters_in
    top = share.argmax(1)
    for i, d in enumerate(present):
        pred[d], score[d], fits[d] = model.languages[top[i]], min(1.0, float(share[i, top[i]])), bool(explained[i])
        own = [k for k in np.argsort(-share[i], kind="stable") if share[i, k] > 0]
        sets[d], parts[d] = [model.languages[k] for k in own], [float(share[i, k]) for k in own]
    return pred, score, sets, parts, fits


def held_out() -> object:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, training_docs: int = TRAINING_DOCS) -> Model | None:
    """The model of documents with a text and a lang, of about `training_docs` of each language: where there are more, a
    hash of doc_id draws them. Only counts of distinct trigrams reach the driver, which that bound limits. None if there
    is nothing to learn from."""
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    bound = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(1e6 * min(1, training_docs / n)))))
    drawn = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("lang")), F.lit(1_000_000)) < bound[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = part.column("lang").dictionary_encode()
                doc, word, distinct = words(part.column("text"))
                lang = held.indices.to_numpy()[doc].astype(np.int64)
                pair, n = np.unique(lang * len(distinct) + word, return_counts=True)
                owner, code = trigrams(distinct)
                start = np.searchsorted(owner, np.arange(len(distinct) + 1))
                of = pair % len(distinct) if len(distinct) else pair
                size = (start[1:] - start[:-1])[of]
                at = np.repeat(start[:-1][of] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                rows, inverse = np.unique(np.stack([np.repeat(pair // max(len(distinct), 1), size), code[at]], 1), axis=0, return_inverse=True)
                total = np.bincount(inverse.ravel(), np.repeat(n, size), len(rows)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([held.dictionary.take(pa.array(rows[:, 0])), pa.array(rows[:, 1]), pa.array(total)], ["lang", "code", "n"])

    counted = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return Model(sorted(sizes), counted.collect())


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred, score, languages and proportions (both by falling proportion), and fits, of each
    whole text. Null texts and those without a letter: `und`, 0, empty lists, false; so is every text if there is no model.
    Repeated rows are told each. Other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        pred, score, sets, parts, fits = infer(texts, shared.value)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(fits, pa.bool_())]

    return per_text(df, text, keep, "lang_pred string, score double, languages array<string>, proportions array<double>, fits boolean", make, chars=1_500_000)
