"""Languages of documents and of their mixed-language cells, by character language models.

One interpolated Kneser-Ney model of character n-grams per language is trained on a bounded sample
of labelled documents, then again without the cells whose label it doubts. All models live in one
sorted hash array per order, with a column per language. A text is scored word by word (with
borders), so the score of a word is computed once per worker; the language with the lowest cross
entropy per character wins, and a text is rejected (no language) if even that one is higher than
texts of its language have.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from . import kmers

#: The languages, with the codes and English names that stand for them (fixed values).
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pl": ("pl", "pol", "polish"),
    "ru": ("ru", "rus", "russian"),
}
LANGUAGES = tuple(NAMES)
#: Longest n-gram; labelled documents sampled per language at most; discount of absolute discounting.
ORDER, SAMPLE, DISCOUNT = 5, 400, 0.75
#: Markdown characters of a sampled document at most; longer documents are not sampled. With SAMPLE it bounds what comes to the driver.
SAMPLED_CHARACTERS = 100_000
#: Distinct characters a model gives its floor to; standard errors above the usual cross entropy that reject.
ALPHABET, REJECT = 400, 8.0
#: Words whose scores a worker keeps; the memo is emptied when full.
WORDS_HELD = 500_000
#: Words; a run of more than 200 letters counts as several.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,199}")


def named_language(label: Column) -> Column:
    """The language a label names: a two- or three-letter code in any case, with or without a region, or an English name; else null."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9-_]+)?$", 1))
    known = F.create_map(*[F.lit(x) for k, names in NAMES.items() for n in names for x in (n, k)])
    return F.try_element_at(known, base)


def markdown_cells(text: str) -> list[tuple[int, str]]:
    """(number, content) of the markdown cells of a document; cells count from 1."""
    cells = ("\n" + text).split("\n# %% [")[1:]
    return [(i, c.partition("\n")[2]) for i, c in enumerate(cells, 1) if c.startswith("markdown]")]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` code points that end at each place, by rows of equally long words; n = 0 gives one value."""
    h = np.full(points.shape[0] if points.ndim == 1 else points.shape, n + 1, np.uint64)
    for k in range(n):
        shifted = np.zeros(points.shape, np.uint64)
        shifted[..., k:] = points[..., : points.shape[-1] - k] if k else points
        h = (h ^ (shifted + np.uint64(1))) * np.uint64(kmers.BASE_A)
        h ^= h >> np.uint64(31)
    return h


class Models:
    """All models: per order a sorted array of n-gram hashes with discounted shares, and one of contexts with what they leave to the order below."""

    def __init__(self, counts: dict[str, Counter]):
        self.shares, self.left = [], []
        for order in range(1, ORDER + 1):
            seen: dict[str, np.ndarray] = {}
            for k, lang in enumerate(LANGUAGES):
                for gram, n in self._counts(counts[lang], order).items():
                    seen.setdefault(gram, np.zeros(len(LANGUAGES)))[k] = n
            texts = list(seen)
            n = np.array([seen[t] for t in texts]) if texts else np.zeros((0, len(LANGUAGES)))
            context = pd.factorize(np.array([t[:-1] for t in texts], object))
            total, kinds = np.zeros((len(context[1]), len(LANGUAGES))), np.zeros((len(context[1]), len(LANGUAGES)))
            np.add.at(total, context[0], n)
            np.add.at(kinds, context[0], n > 0)
            known = total > 0
            share = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[context[0]]
            rest = np.where(known, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            self.shares.append(self._sorted(texts, share))
            self.left.append(self._sorted(list(context[1]), rest))

    @staticmethod
    def _counts(of: Counter, order: int) -> Counter:
        """Counts of the n-grams at the highest order; below, of the different characters that precede them."""
        out: Counter = Counter()
        if order == ORDER:
            for word, n in of.items():
                padded = "\x02" * (ORDER - 1) + word + "\x03"
                for i in range(len(padded) - order + 1):
                    out[padded[i : i + order]] += n
            return out
        longer = set()
        for word in of:
            padded = "\x02" * (ORDER - 1) + word + "\x03"
            longer.update(padded[i : i + order + 1] for i in range(ORDER - 2 - order + 1 if order < ORDER - 1 else 0, len(padded) - order))
        for gram in longer:
            if gram[-1] != "\x02":
                out[gram[1:]] += 1
        return out

    @staticmethod
    def _sorted(texts: list[str], values: np.ndarray):
        h = np.array([grams(np.array([ord(c) for c in t], np.uint64), len(t))[-1] if t else np.uint64(1) for t in texts], np.uint64)
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _found(table, h: np.ndarray, default: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full((len(h), values.shape[1]), default, np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], values[at], np.float32(default))

    def score(self, batch: list[str]) -> np.ndarray:
        """Log probability of each word (with its end) under each language."""
        lengths = np.array([len(w) + 1 for w in batch])
        wide = np.full((len(batch), ORDER - 1 + int(lengths.max())), 3, np.uint64)
        wide[:, : ORDER - 1] = 2
        flat = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(batch)), lengths - 1)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths - 1) - (lengths - 1), lengths - 1)
        wide[row, col + ORDER - 1] = flat
        real = np.arange(wide.shape[1])[None, :] < (ORDER - 1 + lengths)[:, None]
        real[:, : ORDER - 1] = False
        at = np.nonzero(real)
        before = np.zeros_like(wide)
        before[:, 1:] = wide[:, :-1]
        p = np.full((len(at[0]), len(LANGUAGES)), 1.0 / ALPHABET)
        for order in range(1, ORDER + 1):
            context = grams(before, order - 1)[at] if order > 1 else np.full(len(at[0]), 1, np.uint64)
            p = self._found(self.shares[order - 1], grams(wide, order)[at], 0.0) + self._found(self.left[order - 1], context, 1.0) * p
        out = np.zeros((len(batch), len(LANGUAGES)))
        np.add.at(out, at[0], np.log(p))
        return out

    def calibrate(self, scored: list[tuple[str, np.ndarray, int]]) -> None:
        """Usual cross entropy per character of each language and its spread for one word, from labelled cells."""
        self.usual, self.spread = np.full(len(LANGUAGES), np.inf), np.ones(len(LANGUAGES))
        for k, lang in enumerate(LANGUAGES):
            own = [(-s[k] / c, c) for name, s, c in scored if name == lang and c]
            if own:
                ce, n = np.array(own).T
                self.usual[k] = np.average(ce, weights=n)
                self.spread[k] = max(np.sqrt(np.average((ce - self.usual[k]) ** 2 * n)), 0.5)


class Scorer:
    """Scores texts with a memo of words; one per Python worker."""

    def __init__(self, models: Models):
        self.models, self.known = models, {}
        self.table = np.zeros((0, len(LANGUAGES)))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities of each text, and its characters in words (with one border per word)."""
        found = [words(t) for t in texts]
        flat = [w for f in found for w in f]
        if len(self.known) > WORDS_HELD:
            self.known.clear()
            self.table = self.table[:0]
        known = self.known
        new = [w for w in dict.fromkeys(flat) if w not in known]
        parts = [self.table]
        for i in range(0, len(new), 2000):
            parts.append(self.models.score(new[i : i + 2000]))
        base = len(self.table)
        for i, w in enumerate(new):
            known[w] = base + i
        self.table = np.concatenate(parts)
        n = np.array([len(f) for f in found], np.int64)
        rows = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        size = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        owner = np.repeat(np.arange(len(texts)), n)
        out = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(out, owner, self.table[rows])
        return out, np.bincount(owner, size, len(texts))


def decide(scores: np.ndarray, characters: np.ndarray, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each text (-1: rejected) and its confidence, the share of the best against all others."""
    best = scores.argmax(1)
    # Neighbouring characters are not independent: the log odds are tempered by the length of a context.
    odds = np.exp(np.clip((scores - scores.max(1, keepdims=True)) / ORDER, -50, 0))
    confidence = 1 / odds.sum(1)
    ce = -scores[np.arange(len(best)), best] / np.maximum(characters, 1)
    limit = models.usual[best] + REJECT * models.spread[best] / np.sqrt(np.maximum(characters, 1))
    ok = (characters > 0) & ((ce <= limit) | ~np.isfinite(limit)) & (confidence >= 0.6)
    return np.where(ok, best, -1), np.where(ok, confidence, 0.0)


def train(documents: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from at most ``sample`` labelled documents per language, chosen by the hash of their id.

    Only the fit uses the sample; its size is bounded by the parameter and by ``SAMPLED_CHARACTERS``, so its markdown cells may
    come to the driver. Wrong labels are outvoted: the models of a first pass drop cells they give
    to another language before the second.
    """
    labelled = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), named_language(F.col("lang")).alias("named")).where(F.col("named").isNotNull())
    order = Window.partitionBy("named").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "named")

    def run(batches):
        for batch in batches:
            cells = ["\n".join(c for _, c in markdown_cells(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([c if len(c) <= SAMPLED_CHARACTERS else "" for c in cells], pa.string())], names=["named", "cells"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("named", "text")
    texts = [(r[0], r[1]) for r in rows.mapInArrow(run, "named string, cells string").collect() if r[1]]
    texts.sort()
    models = None
    for _ in range(2):
        counts = {lang: Counter() for lang in LANGUAGES}
        for lang, text in texts:
            counts[lang].update(words(text))
        models = Models(counts)
        if texts:
            scores, characters = Scorer(models).score([t for _, t in texts])
            models.calibrate([(lang, s, c) for (lang, _), s, c in zip(texts, scores, characters)])
            texts = [x for x, s in zip(texts, scores) if LANGUAGES[s.argmax()] == x[0]]
        else:
            models.calibrate([])
    return models


_scorers: list[Scorer] = []


def worker_scorer(models: Models) -> Scorer:
    """The scorer of this Python worker, with its memo, built once for the models sent."""
    if not _scorers or _scorers[0].models is not models:
        _scorers[:] = [Scorer(models)]
    return _scorers[0]


def identify(documents: DataFrame, sample: int = SAMPLE, bare: bool = False) -> DataFrame:
    """(doc_id, cell_no, lang, confidence, characters, named, main) of documents and markdown cells.

    ``cell_no`` 0 is the document: the language with the most characters in its markdown cells, with
    the mean confidence of the cells that have it; ``named`` is the language its label names and ``main`` that of the document, on all its rows. Other
    rows are its markdown cells; a rejected cell has a null language. Documents without markdown
    cells (null, empty and blank texts among them) give no rows, or with ``bare`` one of cell 0 without language and confidence;
    if all cells are rejected the document's language is null.
    """
    models = documents.sparkSession.sparkContext.broadcast(train(documents, sample))
    kind = "doc_id bigint, cell_no int, lang string, confidence double, characters bigint, named string, main string"

    def run(batches):
        scorer = worker_scorer(models.value)
        for batch in batches:
            found = [markdown_cells(t) if t else [] for t in batch.column(1).to_pylist()]
            cells = [c for f in found for c in f]
            if cells:
                lang, confidence = decide(*scorer.score([c for _, c in cells]), models.value)
            elif bare:
                lang, confidence = np.zeros(0, np.int64), np.zeros(0)
            else:
                continue
            size = np.array([len(c) for _, c in cells], np.int64)
            doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
            number = np.array([i for i, _ in cells], np.int64)
            some = np.arange(len(found)) if bare else np.unique(doc)
            without = np.concatenate([np.bincount(doc, minlength=len(found))[some] == 0, np.zeros(len(doc), bool)])
            weight = np.zeros((len(found), len(LANGUAGES)))
            sure = np.zeros_like(weight)
            ok = lang >= 0
            np.add.at(weight, (doc[ok], lang[ok]), size[ok])
            np.add.at(sure, (doc[ok], lang[ok]), size[ok] * confidence[ok])
            main = np.where(weight.max(1) > 0, weight.argmax(1), -1)
            at = np.arange(len(found))
            main_confidence = sure[at, main] / np.maximum(weight[at, main], 1)
            which = np.concatenate([some, doc])
            code = np.concatenate([main[some], lang])
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(which)),
                    pa.array(np.concatenate([np.zeros(len(some), np.int32), number]), pa.int32()),
                    pa.array(np.array(LANGUAGES, object)[code], pa.string(), mask=code < 0),
                    pa.array(np.concatenate([np.where(main[some] >= 0, main_confidence[some], 0.0), confidence]), mask=without),
                    pa.array(np.concatenate([np.bincount(doc, size, len(found))[some], size]).astype(np.int64)),
                    batch.column(2).take(pa.array(which)),
                    pa.array(np.array(LANGUAGES, object)[main[which]], pa.string(), mask=main[which] < 0),
                ],
                names=[c.split()[0] for c in kind.split(", ")],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), named_language(F.col("lang")).alias("named"))
    return spread(rows).mapInArrow(run, kind)


def all_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, cell_no, lang, confidence) of every document (cell 0) and every markdown cell.

    A rejected cell, or a document of such cells alone, has a null language and its confidence; a document without
    markdown cells has a single row of cell 0 with both null.
    """
    return identify(documents, sample, True).select("doc_id", "cell_no", "lang", "confidence")


def main_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, confidence, named) of the documents with markdown cells."""
    return identify(documents, sample).where(F.col("cell_no") == 0).select("doc_id", "lang", "confidence", "named")


def corrections(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, cell_no, lang, confidence): documents whose label is missing or wrong (cell 0), and cells of another language than the document's."""
    rows = identify(documents, sample)
    return rows.where(F.col("lang").isNotNull() & F.when(F.col("cell_no") == 0, ~F.col("named").eqNullSafe(F.col("lang"))).otherwise(F.col("lang") != F.col("main"))).select("doc_id", "cell_no", "lang", "confidence")
