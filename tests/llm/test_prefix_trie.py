"""The trie of conversations against a plain one, long conversations, and odd rows."""

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from textwarden.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            same = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append(((turn is not None, turn or 0, same), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, total = {}, {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, who in members.items():
        saved = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves, sum_ = total.get(path[:d], (0, 0))
            total[path[:d]] = leaves + (path not in kids), sum_ + saved
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if built[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), kids.get(path, 0), *total[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("pos", "n", "t", "w", "key", "block", "h", "a", "b", "depth", "lead", "anchor"):
            df = df.withColumn(name, F.lit("x"))
    turns, convs = prefix_trie.rebuilt(prefix_trie.turns_of(df))
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, convs).collect()), key=repr)


def corpus(seed, n, longest):
    r = random.Random(seed)
    texts = ["", "yes", "no", "tell me more", "one two\tthree\nfour", "é à"]
    rows = []
    for c in r.sample(range(-40, 6 * n), n):
        turns = [(r.choice(["user", "bot", ""]), r.choice(texts[: r.randint(1, 6)])) for _ in range(r.choice([1, 2, 3, 9, longest]))]
        rows += [(c, k * 2, *t) for k, t in enumerate(turns)]
    r.shuffle(rows)
    return rows


def test_nodes_equal_plain_trie(spark):
    rows = corpus(4, 120, 30)
    assert run(spark, rows) == plain(rows)


def test_long_conversations_and_crowded_nodes(spark, monkeypatch):
    """Windows of two blocks, and nodes crowded from three children on."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    monkeypatch.setattr(prefix_trie, "CROWD", 2)
    rows = corpus(9, 40, 90)
    common = [(k, "user", f"turn {k}") for k in range(70)]
    for c in (5000, 5001, 5003, 5005, 5060, 5071):
        rows += [(c, *t) for t in common] + [(c, 70 + k, "bot", f"{c} {k}") for k in range(c % 3)]
    assert run(spark, rows) == plain(rows)


def test_many_equal_conversations(spark):
    rows = [(c, k, "user", f"say {k}") for c in range(0, 900) for k in range(2)]
    got = run(spark, rows)
    assert got == plain(rows)


def test_odd_rows(spark):
    """Null turns first, equal turns, repeated rows, null role and text, no conv_id, turnless conversations, long texts."""
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, "", ""), (2, 1, "user", "x"), (2, 1, "user", "x")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (2**62, 1, "u", "big"), (30, 5, "u", "alone"), (41, 0, "u", "w " * 300_000)]
    rows += [(c, 0, "u", "one turn") for c in range(100, 140)]  # those whose h is over 0 and that have no anchor lose it
    assert run(spark, rows, clash=True) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "lost")]) == []
