"""Winnowing fingerprints of texts, and how alike two texts are by them.

Every run of GRAM code points is hashed by a rolling hash.  Of each WINDOW consecutive
hashes the least is taken, the rightmost of several; a hash taken for several windows
counts once, with its place.  So two texts that share GRAM + WINDOW - 1 code points in a
row share a fingerprint at least, and two consecutive places are at most WINDOW apart.

A fingerprint is an array of (place, hash).  As a string it is hexadecimal, 14 digits for
each: two for the distance to the place before, twelve for the upper 48 bits of the hash.
Texts shorter than GRAM have one fingerprint, that of the whole text; empty texts have
none, and an empty string.

Likeness is that of the bags of hashes: twice the common part over both sizes.  Equal
fingerprints are alike by 1, also if both are empty.

Neighbours: documents are in descending order of doc_id, null last; rows of equal doc_id are
in the order of a hash of their text.  They are dealt by ranges of that order, and the first
of a range goes to the range before too, so every document meets the next one without a join.
The bounds of the ranges are drawn from at most SAMPLE documents, and only make the ranges
even; whole copies of one row are in one range.

Defined results: a null text is an empty one; the only document is its own next one; repeated rows
are documents of their own; an empty table has no rows.  Other columns don't take part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import corpus
from textwarden.llm.near_dedup import POWERS, mixed

GRAM, WINDOW = 12, 16
CHUNK = 1 << 20
#: Documents that the bounds of ranges are drawn from, and bytes of text for each range.
SAMPLE, RANGE = 20_000, 16 << 20
OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ITEM = 7  # bytes of a fingerprint: one of distance, six of hash


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all runs of ``gram`` code points, from running sums; of the whole if it is shorter."""
    if not len(points):
        return np.empty(0, "u8")
    gram = min(gram, len(points))
    up, down = POWERS.to(len(points) + 1)
    upto = np.zeros(len(points) + 1, "u8")
    np.cumsum((points.astype("u8") + np.uint64(1)) * up[: len(points)], out=upto[1:])
    return mixed((upto[gram:] - upto[:-gram]) * down[: len(upto) - gram])


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the hashes that are taken: of each window the least, the rightmost of equal ones."""
    if not len(hashes):
        return np.empty(0, "i8")
    window = min(window, len(hashes))
    best = hashes[: len(hashes) - window + 1].copy()
    at = np.arange(len(best))
    for k in range(1, window):
        other = hashes[k : k + len(best)]
        later = other <= best
        best[later] = other[later]
        at[later] = np.flatnonzero(later) + k
    return np.unique(at)


def fingerprints(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text, a piece of CHUNK windows at a time."""
    points = code_points(text or "")
    places, hashes = [np.empty(0, "i8")], [np.empty(0, "u8")]
    for at in range(0, max(1, len(points) - GRAM - WINDOW + 2), CHUNK):
        some = gram_hashes(points[at : at + CHUNK + GRAM + WINDOW - 2])
        taken = winnow(some)
        new = taken + at > places[-1][-1] if len(places[-1]) else np.ones(len(taken), bool)
        places.append(taken[new] + at)
        hashes.append(some[taken[new]])
    return np.concatenate(places), np.concatenate(hashes)


def written_out(places: np.ndarray, hashes: np.ndarray) -> str:
    items = np.empty((len(places), ITEM), "u1")
    items[:, 0] = np.diff(places, prepend=0)
    items[:, 1:] = hashes.astype(">u8").view("u1").reshape(-1, 8)[:, :6]
    return items.tobytes().hex()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, upper 48 bits of the hashes) of a fingerprint's string."""
    items = np.frombuffer(bytes.fromhex(fingerprint), "u1").reshape(-1, ITEM)
    wide = np.zeros((len(items), 8), "u1")
    wide[:, 2:] = items[:, 1:]
    return np.cumsum(items[:, 0].astype("i8")), wide.view(">u8").ravel().astype("u8")


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes >> np.uint64(16), return_counts=True)


def likeness(one: tuple, two: tuple) -> float:
    """Twice the common part of two bags (hashes, counts) over both sizes; 1 if both are empty."""
    both = int(one[1].sum() + two[1].sum())
    if not both:
        return 1.0
    _, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    return 2 * int(np.minimum(one[1][a], two[1][b]).sum()) / both


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``fingerprints``: array of (place, hash) of the whole text."""

    @F.pandas_udf("array<struct<place:long,hash:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"place": p, "hash": h} for p, h in zip(*(x.view("i8").tolist() for x in fingerprints(t)), strict=True)])

    return docs.withColumn("fingerprints", run(F.col(text_col)))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """(part, again, key, doc_id, text) and the number of parts: rows by ranges of the order.

    ``key`` is the order: null ids last, descending ids, a hash of the text.  The first row of
    a range comes once more, as ``again``, in the range before, and that of the first range in
    the last.  There are at most four ranges for each shuffle partition; their bounds and
    first keys are all that reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down")
    rows = rows.select(F.struct(F.isnull("doc_id").alias("null"), down, F.xxhash64("text").alias("h")).alias("key"), "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE)))
    bounds = []
    if n > 1:
        drawn = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
        keys = sorted(tuple(r["key"]) for r in drawn.collect())
        bounds = sorted({keys[len(keys) * k // n] for k in range(1, n)})
    rows = rows.withColumn("part", F.size(F.filter(keys_of(bounds), lambda b: b <= F.col("key"))))
    firsts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    before = {p: firsts[k - 1][0] for k, (p, _) in enumerate(firsts)}
    heads = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map().cast("map<int,int>")
    first = F.array_contains(keys_of([tuple(k) for _, k in firsts]), F.col("key"))
    homes = F.when(first, F.array(F.struct("part", F.lit(False).alias("again")), F.struct(heads[F.col("part")].alias("part"), F.lit(True).alias("again"))))
    homes = F.coalesce(homes, F.array(F.struct("part", F.lit(False).alias("again"))))
    return rows.select(F.explode(homes).alias("home"), "key", "doc_id", "text").select("home.*", "key", "doc_id", "text"), n


def keys_of(keys: list[tuple]) -> Column:
    """Keys as a constant array."""
    rows = [{"null": z, "down": d, "h": h} for z, d, h in keys]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<null:boolean,down:long,h:long>>")


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each document."""

    def measured(text: str) -> tuple[str, str, tuple]:
        places, hashes = fingerprints(text)
        return text, written_out(places, hashes), bag(hashes)

    def row(doc, own: tuple, following: tuple) -> tuple:
        text = edited(own[0], following[0])
        changed = measured(text)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(own[0]), sha, own[1], changed[1], likeness(own[2], changed[2]), likeness(own[2], following[2])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, out, held = None, [], 0
        for batch in batches:
            for again, doc, text in zip(*(batch[c].tolist() for c in ("again", "doc_id", "text")), strict=True):
                if again and last is None:
                    continue  # a copy of the row that followed the range's last document already
                now = measured(text)
                if last is not None:
                    out.append(row(*last, now))
                    held += len(text)
                last = None if again else (doc if doc is None else int(doc), now)
                if len(out) >= 512 or held >= 1 << 22:
                    yield frame(out)
                    out, held = [], 0
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(OUT, zip(*out) if out else [[]] * len(OUT), strict=True)})
        return df.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    rows, n = in_order(docs)
    placed = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "again", "key")
    # as text, a null among the ids doesn't turn the others into floats
    return placed.select("again", F.col("doc_id").cast("string"), "text").mapInPandas(run, SCHEMA)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, and their likeness."""
    return beside_next(corpus(spark, sf_dir, "documents"))
