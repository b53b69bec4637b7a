"""Winnowing against a plain version, its guarantees, neighbours over ranges, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import winnowing

SCHEMA = "doc_id long, text string"


def plain_places(text):
    """Places by the definition: of each window the least hash, the rightmost of equal ones."""
    hashes = [h for k in range(max(1, len(text) - winnowing.GRAM + 1)) for h in winnowing.gram_hashes(winnowing.code_points(text[k : k + winnowing.GRAM])).tolist()]
    w = min(winnowing.WINDOW, len(hashes))
    return sorted({max((-h, k) for k, h in enumerate(hashes[at : at + w], at))[1] for at in range(len(hashes) - w + 1)}), hashes


@pytest.mark.parametrize("text", ["", "a", "short text", "a" * 90, "abab" * 40, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich 🙂 " * 3])
def test_places_equal_plain(text):
    places, hashes = winnowing.fingerprints(text)
    want, every = plain_places(text) if text else ([], [])
    assert places.tolist() == want
    assert hashes.tolist() == [every[k] for k in want]
    again, short = winnowing.parse(winnowing.written_out(places, hashes))
    assert again.tolist() == want and short.tolist() == [every[k] >> 16 for k in want]


def test_shared_passage_is_found():
    """Texts that share GRAM + WINDOW - 1 code points share a fingerprint."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    for _ in range(200):
        common = word(winnowing.GRAM + winnowing.WINDOW - 1)
        a, b = (set(winnowing.fingerprints(word(r.randint(0, 80)) + common + word(r.randint(0, 80)))[1].tolist()) for _ in range(2))
        assert a & b


def test_chunks_make_no_difference():
    r = np.random.default_rng(1)
    text = "".join(map(chr, r.integers(97, 101, winnowing.CHUNK + 5000)))
    places, hashes = winnowing.fingerprints(text)
    every = winnowing.gram_hashes(winnowing.code_points(text))
    want = winnowing.winnow(every)
    assert np.array_equal(places, want) and np.array_equal(hashes, every[want])


def likeness(a, b):
    from collections import Counter

    x, y = (Counter(h >> 16 for h in winnowing.fingerprints(t)[1].tolist()) for t in (a, b))
    n = x.total() + y.total()
    return 2 * (x & y).total() / n if n else 1.0


def plain(docs):
    rows = [(d, t or "") for d, t in docs]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        print_ = lambda x: winnowing.written_out(*winnowing.fingerprints(x))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), print_(t), print_(e), likeness(t, e), likeness(t, nxt)))
    return sorted(out, key=repr)


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]) + str(r.randint(0, 99)) for _ in range(n))


def run(df):
    return sorted(map(tuple, winnowing.beside_next(df).collect()), key=repr)


def test_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE", 2000)
    r = random.Random(8)
    docs = [(i, r.choice([None, "", "x", words(r, r.randint(1, 200)), words(r, 30)])) for i in r.sample(range(-50, 5000), 300)]
    rows = spark.createDataFrame(docs, SCHEMA).repartition(7)
    assert winnowing.in_order(rows)[1] > 3
    assert run(rows) == plain(docs)


def test_edits_are_near_and_others_are_not(spark):
    r = random.Random(2)
    got = run(spark.createDataFrame([(i, words(r, 150)) for i in range(40)], SCHEMA))
    assert min(row[5] for row in got) > 0.5 > 0.3 > max(row[6] for row in got)


def test_odd_rows(spark, monkeypatch):
    """Null ids come last, clashing columns don't matter, long texts are whole, one document is its own next one."""
    long_ = "".join(map(chr, np.random.default_rng(0).integers(97, 123, 1_500_000)))
    docs = [(None, "without an id"), (3, None), (-(2**63), "least"), (2**63 - 1, "greatest " * 9), (5, long_)]
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("key", "part", "again", "home", "h", "down", "fingerprint"):
        df = df.withColumn(name, F.lit("x"))
    assert run(df) == plain(docs)
    assert run(spark.createDataFrame([(1, "alone")], SCHEMA)) == plain([(1, "alone")])
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_repeated_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE", 50)
    docs = [(1, "same text of some length"), (1, "same text of some length"), (1, "another text of id one"), (None, "n"), (None, "n")] * 4
    got = run(spark.createDataFrame(docs, SCHEMA))
    assert len(got) == len(docs)
    assert sorted((g[0] is None, g[1]) for g in got) == sorted((d is None, len(t)) for d, t in docs)
    for text in {t for _, t in docs}:
        assert len({g[3] for g in got if g[1] == len(text)}) == 1
