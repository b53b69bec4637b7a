"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its trigrams of character classes (lower case, capitals, digits,
kinds of punctuation) and a few terms of repetition: words that repeat the one before,
words seen before, lines seen before.  Term weights are square roots of shares times
an inverse document frequency; a singular value decomposition of the labelled
documents gives the latent axes.  The labelled vectors, at most ``MOST_DOCS`` of
``AXES`` numbers, are broadcast; every document gets exact cosine products with all of
them, in blocks, and its ``NEAREST`` nearest vote with weights that rise with
similarity.

The model is fitted on at most ``MOST_DOCS`` labelled documents of ``MOST_CHARS``
characters in all, taken by a hash of doc_id.  Every document is scored on its whole
text.

Defined results: a null or empty text has a zero vector, no neighbour, and the score of
the prior; without any usable label the score is 1, so nothing is rejected; repeated
rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import corpus, labelled_sample, table

MOST_DOCS, MOST_CHARS, AXES, NEAREST = 4_000, 32_000_000, 32, 15
GOOD = 0.5
SHARPNESS = 8
ROWS = 512

#: Class of each byte: other, lower case, capital, digit, blank, line end, then punctuation.
CLASSES = 16
KINDS = {b".": 6, b",;:": 7, b"!": 8, b"?": 9, b"|": 10, b"#$%&*": 11, b"\"'`": 12, b"-_": 13, b"()[]{}<>/\\=+~^@": 14}


def class_table() -> np.ndarray:
    out = np.zeros(256, "u2")
    out[ord("a") : ord("z") + 1] = out[0x80:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[[ord(" "), ord("\t")]] = 4
    out[[ord("\n"), ord("\r")]] = 5
    for signs, kind in KINDS.items():
        out[list(signs)] = kind
    return out


CLASS = class_table()
TRIGRAMS = CLASSES**3
TERMS = TRIGRAMS + 3


def terms(text: str) -> np.ndarray:
    """Shares of a text's terms, as square roots."""
    out = np.zeros(TERMS, "f4")
    if not text:
        return out
    c = CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")]
    if len(c) >= 3:
        out[:TRIGRAMS] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=TRIGRAMS) / (len(c) - 2)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    if len(words) > 1:
        out[TRIGRAMS] = sum(map(eq, words, words[1:])) / (len(words) - 1)
        out[TRIGRAMS + 1] = max(0.0, 1 - len(set(words)) / len(words) - 0.5)
    if len(lines) > 1:
        out[TRIGRAMS + 2] = 1 - len(set(lines)) / len(lines)
    return np.sqrt(out)


def hashes_of(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], "u8")


class Model:
    """Latent axes, and the labelled vectors with the hashes of their texts.

    A text never votes on itself: labelled vectors of the very same text are left out.
    """

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, hashes: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels, self.prior, self.hashes = idf, axes, vectors, labels, prior, hashes

    def project(self, texts: list[str]) -> np.ndarray:
        x = np.stack([terms(t) for t in texts]) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        k = min(NEAREST, len(self.vectors))
        for at in range(0, len(texts) if k else 0, ROWS):
            z = self.project(texts[at : at + ROWS])
            cosine = z @ self.vectors.T
            cosine[hashes_of(texts[at : at + ROWS])[:, None] == self.hashes] = -1
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype("f8") ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + ROWS] = np.where((total > 1e-12) & z.any(axis=1), vote, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: list[tuple[str, int]]) -> Model:
    """Latent axes and labelled vectors."""
    docs = [d for d in docs if d[0]]
    labels = np.array([y for _, y in docs], "f8")
    if not docs:
        none = np.zeros((0, 0), "f4")
        return Model(np.ones(TERMS, "f4"), none, none, labels, 1.0, np.zeros(0, "u8"))
    x = np.stack([terms(t) for t, _ in docs])
    share = (x > 0).mean(axis=0)
    idf = (1 + np.log(1 / np.maximum(share, 1 / len(docs)))).astype("f4")
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    # the right singular vectors, from the smaller of the two Gram matrices' side
    seen = np.flatnonzero(share > 0)
    values, vectors = np.linalg.eigh(x[:, seen].T.astype("f8") @ x[:, seen])
    axes = np.zeros((TERMS, min(AXES, len(seen))), "f4")
    axes[seen] = vectors[:, ::-1][:, : axes.shape[1]]
    model = Model(idf, axes, np.zeros((0, 0), "f4"), labels, float(labels.mean()), hashes_of([t for t, _ in docs]))
    model.vectors = np.concatenate([model.project([t for t, _ in docs[at : at + ROWS]]) for at in range(0, len(docs), ROWS)])
    return model


def train(docs: DataFrame, labels: DataFrame, fold=None) -> Model:
    """A model from ``labels.quality``; ``fold`` says which labels may be learned."""
    rows = labelled_sample(docs, labels, "quality", F.lit(True) if fold is None else fold, MOST_DOCS, MOST_CHARS)
    return fit([(r["text"], r["label"]) for r in rows.orderBy("doc_id").toLocalIterator()])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score``: how far a document's neighbours are good ones."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels, model.prior, model.hashes))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Model(*shared.value)
        for texts in batches:
            yield pd.Series(one.scores(texts.tolist()), dtype="f8")

    return docs.withColumn("score", run(F.coalesce(F.col(text_col), F.lit(""))))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of one crc32 class in three are never learned."""
    docs, labels = corpus(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels, ~held_out()))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
