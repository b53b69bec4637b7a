"""The Merkle manifest against a plain tree, and its odd rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from textwarden.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    row = (doc[0], doc[3], doc[2], doc[4], text)
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(nodes):
    """All levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][at : at + 16]) for at in range(0, len(out[-1]), 16)])
    return out


def route(levels, at):
    """For each level the siblings on the left and on the right."""
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def plain(docs):
    groups = {}
    for doc in docs:
        groups.setdefault(doc[3], []).append((-1 if doc[0] is None else doc[0], leaf(doc, doc[1]), doc))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for at, (_, own, doc) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            text = doc[1]
            if doc[0] is not None and text is not None and zlib.crc32(str(doc[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now, path = leaf(doc, text), route(trees[s], at) + route(top, k)
            for left, right in path:
                now = digest([*left, now, *right])
            proof = digest(x for left, right in path for x in left + right)
            out.append((doc[0], own, trees[s][-1][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def run(spark, docs, extra=False):
    rows = spark.createDataFrame(docs, SCHEMA)
    if extra:
        for name in ("pos", "n", "tree", "leaf", "digest", "block", "path", "root", "row_", "part_"):
            rows = rows.withColumn(name, F.lit("x"))
    return sorted(map(tuple, merkle.manifest(merkle.leaves_of(rows)).collect()), key=repr)


def test_manifest_equals_plain_trees(spark):
    """One source of more than two blocks, some small ones, one of a single row, and more than sixteen sources."""
    r = random.Random(3)
    docs = [(i, f"Text {r.random()}", "en", "big", 7) for i in range(0, 1700, 3)]
    docs += [(10_000 + i, f"Word Ä {i}", r.choice(["de", None]), f"s{i % 21}", i) for i in range(60)]
    docs += [(99_999, "alone", "en", "zz", 5)]
    r.shuffle(docs)
    got = run(spark, docs)
    assert got == plain(docs)
    assert {True, False} == {row[-1] for row in got}


def test_odd_rows(spark):
    docs = [(None, None, None, None, None), (1, None, "en", None, None), (1, "", "en", "a", 0), (2, "Same", "en", "a", 4), (2, "Same", "en", "a", 4)]
    docs += [(None, "No Id", "en", "a", 5), (7, "Long " * 200_000, "en", "é", 10**6), (8, "x", "en", "", 1), (2**63 - 1, "big id", "en", "a", 6)]
    assert run(spark, docs, extra=True) == plain(docs)


def test_one_row_and_none(spark):
    one = [(5, "Only", "en", "a", 4)]
    assert run(spark, one) == plain(one)
    assert run(spark, []) == []


def test_parent_folds_from_its_midstate():
    children = [hashlib.sha256(bytes([k])).hexdigest().encode() for k in range(16)]
    parent = merkle.Parent(children)
    for slot in (0, 7, 15):
        changed = [*children[:slot], b"f" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"f" * 64) == hashlib.sha256(b"".join(changed)).hexdigest().encode()
        assert parent.fold(slot, children[slot]) == parent.digest
