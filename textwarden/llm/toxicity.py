"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences.  Each sentence has a probability p of being
offensive, the logistic of a sum of weights of its words and word beginnings, and the
document's is the noisy-or 1 - product(1 - p).  Weights are fitted to document labels
alone; afterwards the same sentence probabilities say where the offence stands.

The model is fitted on at most ``MOST_DOCS`` labelled documents of ``MOST_CHARS``
characters in all, taken by a hash of doc_id, and holds at most ``MOST_FEATURES``
weights, so what is gathered and broadcast is bounded.  Every document is scored, and
every sentence of it.

Defined results: a null or empty text has no sentence and the score of the empty
noisy-or, 0; without any usable label, or with one class only, no weight is learned
and all scores are the prior of the labels seen (0 without any); repeated rows are
scored each; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import corpus, labelled_sample, table

MOST_DOCS, MOST_CHARS, MOST_FEATURES, LEAST_DOCS = 12_000, 64_000_000, 20_000, 4
STEPS, RATE, SHRINK = 150, 0.15, 2e-4
REMEMBERED = 600_000
FLAGGED = 0.3
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 letters."""
    return [word, *["^" + word[:k] for k in (4, 5, 6) if len(word) > k]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    prior: float = 0.0
    fitted: bool = False

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold any weighted word."""
        out, at = [], 0
        for cut in [*SENTENCE.finditer(text), None]:
            end = cut.start() if cut else len(text)
            if p := self.sentence(text[at:end]):
                out.append((at, end, p))
            at = cut.end() if cut else end
        return out

    def sentence(self, sentence: str) -> float:
        z = self.logit(sentence)
        return 1 / (1 + math.exp(-max(z, -60))) if z > self.bias else 0.0

    def logit(self, sentence: str) -> float:
        return self.bias + sum({w: self.word(w) for w in WORD.findall(sentence.lower())}.values())

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return self.prior
        known, hits = self.known, []
        words = WORD.findall((text or "").lower())
        got = list(map(known.get, words))
        if None in got:
            got = [self.word(w) for w in words]
        if not any(got):
            return 0.0
        clean = 1.0
        for _, _, p in self.sentences(text):
            clean *= 1 - p
        return 1 - clean


def fit(docs: Iterable[tuple[str, int]]) -> Model:
    """Fits the sentence weights to document labels by gradient steps on the noisy-or likelihood.

    Texts are taken one by one and kept as numbers: of each sentence its distinct words.
    """
    vocabulary: dict[str, int] = {}
    ids, sentence, labels = [], [], []
    for text, label in docs:
        words, at = [], []
        for k, part in enumerate(SENTENCE.split(text)):
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(WORD.findall(part.lower()))]
            words += found
            at += [k] * len(found)
        ids.append(np.array(words, "u4"))
        sentence.append(np.array(at, "u4"))
        labels.append(label)
    labels = np.array(labels, "f8")
    prior = float(labels.mean()) if len(labels) else 0.0
    if not 0 < prior < 1:
        return Model(prior=prior)
    names: dict[str, int] = {}
    of_word = np.full((len(vocabulary), 4), -1, "i4")
    for word, i in vocabulary.items():
        for j, f in enumerate(features(word)):
            of_word[i, j] = names.setdefault(f, len(names))
    seen, toxic = np.zeros(len(names)), np.zeros(len(names))
    for words, label in zip(ids, labels, strict=True):
        there = np.unique(of_word[np.unique(words)])
        there = there[there >= 0]
        seen[there] += 1
        toxic[there] += label
    score = (toxic - seen * prior) / np.sqrt(np.maximum(seen, 1) * prior * (1 - prior))
    score[(toxic < LEAST_DOCS) | (score <= 3)] = 0
    chosen = np.argsort(-score, kind="stable")[: min(MOST_FEATURES, int((score > 0).sum()))]
    column = np.full(len(names) + 1, -1, "i4")
    column[chosen] = np.arange(len(chosen))
    row_of, col_of, bag_of, n = [], [], [], 0
    for b, (words, at) in enumerate(zip(ids, sentence, strict=True)):
        cols = column[of_word[words]]
        i, j = np.nonzero(cols >= 0)
        parts, where = np.unique(at[i], return_inverse=True)
        row_of.append(where + n)
        col_of.append(cols[i, j])
        bag_of += [b] * len(parts)
        n += len(parts)
    row, col, bag = np.concatenate(row_of).astype("i8"), np.concatenate(col_of).astype("i8"), np.array(bag_of, "i8")
    p, size = labels.sum(), len(labels)
    w, bias = np.full(len(chosen), 0.5), -4.0
    moment, spread = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], n) + bias
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(bag, np.log1p(-np.minimum(q, 1 - 1e-9)), size))
        pull = np.where(labels > 0, clean / np.maximum(1 - clean, 1e-6), -1.0)
        g = np.clip(pull[bag] * q, -1, 1) * np.where(labels[bag] > 0, 1.0, p / max(1.0, size - p) * 4)
        grad = np.append(np.bincount(col, g[row], len(chosen)), g.sum()) / max(1.0, p)
        grad[:-1] -= SHRINK * w
        grad[-1] -= SHRINK * (bias + 4)
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(w + move[:-1], 0), min(bias + move[-1], -2.0)
    known = list(names)
    keep = {known[f]: float(w[k]) for k, f in enumerate(chosen.tolist()) if w[k] > 0.05}
    return Model(weights=keep, bias=float(bias), prior=prior, fitted=True)


def train(docs: DataFrame, labels: DataFrame, fold=None) -> Model:
    """A model from ``labels.toxic``; ``fold`` says which labels may be learned."""
    rows = labelled_sample(docs, labels, "toxic", F.lit(True) if fold is None else fold, MOST_DOCS, MOST_CHARS)
    return fit((r["text"], r["label"]) for r in rows.orderBy("doc_id").toLocalIterator())


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score``, the document's probability of being toxic."""
    parts = (model.weights, model.bias, model.prior, model.fitted)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Model(*shared.value)
        for texts in batches:
            yield texts.map(one.score).astype("f8")

    return docs.withColumn("score", run(F.coalesce(F.col(text_col), F.lit(""))))


def offending_sentences(docs: DataFrame, model: Model, least: float = FLAGGED) -> DataFrame:
    """(doc_id, start, end, sentence, score): where the offence stands."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior, model.fitted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Model(*shared.value)
        for batch in batches:
            rows = [
                (d, a, b, t[a:b], p)
                for d, t in zip(batch["doc_id"], batch["text"], strict=True)
                if t and one.fitted
                for a, b, p in one.sentences(t)
                if p >= least
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "sentence", "score"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, sentence string, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of one crc32 class in four are never learned."""
    docs, labels = corpus(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    scored = score(docs.select("doc_id", "text"), train(docs, labels, ~held))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= FLAGGED).cast("int").alias("predicted")
    )
