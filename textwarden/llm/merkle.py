"""A Merkle manifest of a dataset: per source a tree over its rows, and one over the sources.

A leaf is the SHA-256 of a row's fields.  Every FAN consecutive nodes have a parent, whose
digest is the SHA-256 of theirs; a tree ends in one node.  The trees of the sources hang,
by source, under one more tree, whose top is the root of the dataset.

Midstates: while a parent is hashed, a copy of the hash's state is kept before each child's
slot.  To see what a changed child makes of the parent, the copy of its slot goes on with
the replacement and the siblings to its right; what is left of it is not hashed again.

The work is done in blocks of FAN ** LEVELS consecutive nodes of one tree, each a small
group.  Going up, a round turns every block into its top node, so the rounds grow with the
logarithm of the largest tree.  Going down, each block's top brings its path along: for each
level above it the slot, and the siblings on the left and on the right.  The last step, in the
leaves' blocks, gives every leaf's proof and folds its replacement up to the root.

Defined results: a null field is ``-``, an empty text ``0:``.  A null source is a source of its
own, the first.  Rows of one source are in ascending order of doc_id, null first; rows of equal
doc_id by their leaf, so repeated rows are leaves of equal digest.  A null doc_id is never
tampered with.  An empty table has no rows.  Other columns don't take part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import ascii_lower, corpus, numbered, written

FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<slot:int,left:string,right:string>"
NODES = "tree long, pos long, n long, digest string"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its length in bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


class Parent:
    """A parent's digest, and the state of its hash before each child's slot."""

    def __init__(self, children: list[bytes]):
        self.children, self.states, state = children, [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def left(self, slot: int) -> bytes:
        return b"".join(self.children[:slot])

    def right(self, slot: int) -> bytes:
        return b"".join(self.children[slot + 1 :])

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The parent's digest with another child in a slot."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(self.right(slot))
        return state.hexdigest().encode()


def levels_of(digests: list[bytes], n: int) -> list[list[Parent]]:
    """Parents of a block, level by level: LEVELS of them, or fewer where a tree of n nodes ends before."""
    out: list[list[Parent]] = []
    while n > 1 and len(out) < LEVELS:
        out.append([Parent(digests[at : at + FAN]) for at in range(0, len(digests), FAN)])
        digests, n = [p.digest for p in out[-1]], -(-n // FAN)
    return out


def block_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) of the top nodes of blocks; n is the number of a tree's nodes on their level."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        digests = [d.encode() for d in group.sort_values("pos")["digest"]]
        tree, n, block = (int(group[c].iloc[0]) for c in ("tree", "n", "block"))
        levels = levels_of(digests, n)
        top = levels[-1][0].digest if levels else digests[0]
        return pd.DataFrame({"tree": [tree], "pos": [block], "n": [-(-n // BLOCK)], "digest": [top.decode()]})

    return block_of(nodes.select("tree", "pos", "n", "digest")).groupBy("tree", "block").applyInPandas(run, NODES)


def path_in(levels: list[list[Parent]], at: int) -> list[tuple[int, bytes, bytes]]:
    """(slot, left siblings, right siblings) of a block's node ``at``, from its own level up."""
    out = []
    for level in levels:
        at, slot = divmod(at, FAN)
        out.append((slot, level[at].left(slot), level[at].right(slot)))
    return out


def with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, pos, digest, path, root): the path of every node from its own level to the root.

    ``above``: (tree, pos, path, root) of the top nodes of the nodes' blocks.
    """

    def run(group: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = levels_of([d.encode() for d in group["digest"]], int(group["n"].iloc[0]))
        rest, root = list(top["path"].iloc[0]), top["root"].iloc[0]
        own = [[{"slot": s, "left": a.decode(), "right": b.decode()} for s, a, b in path_in(levels, k)] + rest for k in range(len(group))]
        return pd.DataFrame({"tree": group["tree"], "pos": group["pos"], "digest": group["digest"], "path": own, "root": root})

    tops = above.select("tree", F.col("pos").alias("block"), "path", "root")
    one = block_of(nodes.select("tree", "pos", "n", "digest")).groupBy("tree", "block")
    return one.cogroup(tops.groupBy("tree", "block")).applyInPandas(run, f"tree long, pos long, digest string, path array<{STEP}>, root string")


def climbed(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes and the rounds of block tops above them, the last with one node a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 1) > 1:
        rounds.append(written(parents(rounds[-1]), name))
    return rounds


def descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the nodes of ``rounds[0]``; ``tops``: (tree, pos, path, root) of the trees' last nodes."""
    for nodes in reversed(rounds):
        tops = written(with_paths(nodes, tops), "paths")
    return tops


def folded(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``leaves``: (tree, pos, n, doc_id, digest, tampered); ``above``: (tree, pos, path, subroot,
    root) of the tops of their blocks.
    """

    def run(group: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = levels_of([d.encode() for d in group["digest"]], int(group["n"].iloc[0]))
        steps, proof, folds = [], hashlib.sha256, []
        for step in top["path"].iloc[0]:
            left, right = step["left"].encode(), step["right"].encode()
            steps.append((hashlib.sha256(left), right))  # one midstate a level serves the whole block
            folds.append(left + right)
        rest, proofs, roots = b"".join(folds), [], []
        for at, now in enumerate(group["tampered"]):
            own, now = proof(), now.encode()
            for level in levels:
                at, slot = divmod(at, FAN)
                parent = level[at]
                own.update(parent.left(slot))
                own.update(parent.right(slot))
                now = parent.fold(slot, now)
            own.update(rest)
            for before, right in steps:
                state = before.copy()
                state.update(now)
                state.update(right)
                now = state.hexdigest().encode()
            proofs.append(own.hexdigest())
            roots.append(now.decode())
        root = top["root"].iloc[0]
        return pd.DataFrame({
            "doc_id": group["doc_id"], "leaf": group["digest"], "subroot": top["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": roots, "verified": [r == root for r in roots],
        })

    tops = above.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    # ids go through as text: a null among them would turn the others into floats
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    own = block_of(leaves.withColumn("doc_id", F.col("doc_id").cast("string"))).groupBy("tree", "block")
    found = own.cogroup(tops.groupBy("tree", "block")).applyInPandas(run, out)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(leaves: DataFrame) -> DataFrame:
    """Of (source, doc_id, leaf, tampered): each leaf with its source's top, the root, its proof and the folded root.

    ``tampered`` is the digest that stands in the leaf's place when it is folded.
    """
    placed = numbered(leaves, "source", F.col("doc_id").asc_nulls_first(), F.col("leaf"), name="leaves")
    one = F.lit(0).alias("all")
    sources = numbered(placed.where("pos = 0").select(one, "source"), "all", F.col("source").asc_nulls_first(), name="sources")
    sources = sources.select(F.col("source").alias("s"), F.col("pos").alias("tree"))
    known = placed.join(sources, placed["source"].eqNullSafe(sources["s"]))
    rows = written(known.select("tree", "pos", "n", "doc_id", F.col("leaf").alias("digest"), "tampered"), "placed")
    rounds = climbed(rows, "nodes")
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(0).alias("n"), "digest")
    n = subroots.count()
    tree = climbed(subroots.withColumn("n", F.lit(n).cast("long")), "source_nodes")
    root = tree[-1].select("tree", "pos", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))
    paths = descended(tree, root).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path", "root")
    above = paths
    for nodes in reversed(rounds[1:]):
        found = with_paths(nodes, above)
        above = written(found.join(paths.select("tree", "subroot"), "tree"), "tops")
    return folded(rows, above)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered): rows' digests, and those with A-Z of the text lower-cased where 5 divides the id's CRC-32."""
    whole = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf_of([*whole[:-1], ascii_lower(F.col("text"))])
    leaf = leaf_of(whole)
    return docs.select("source", F.col("doc_id").cast("long"), leaf.alias("leaf"), F.when(hit, changed).otherwise(leaf).alias("tampered"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``, and what tampering with a fifth of them does to the root."""
    return manifest(leaves_of(corpus(spark, sf_dir, "documents")))


def crc32_sql(text: str) -> str:
    """SQL: unsigned CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_prepend(xor(acc, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, one: xor(c >> 1, 3988292384 * (c & one)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, b: {byte}), 4294967295)"


def field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')"


def oracle(deep: int = 6, wide: int = 4) -> str:
    """SQL of the manifest for at most 16 ** deep rows a source and 16 ** wide sources."""
    fields = " || ".join(field_sql(f"{c}::VARCHAR") for c in FIELDS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN other ELSE leaf END AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, source, sha256({fields} || {field_sql("text")}) AS leaf, sha256({fields} || {field_sql(lower)}) AS other FROM documents)),
a0 AS (SELECT source AS tree, pos, leaf AS digest FROM leaves)"""]

    def levels(of: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{of}g{k} AS (SELECT tree, pos // 16 AS up, any_value(n) AS n, list(digest ORDER BY pos) AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {of}{k}) GROUP BY tree, pos // 16)""")
            parts.append(f"{of}{k + 1} AS (SELECT tree, up AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(d, '')) ELSE d[1] END AS digest FROM {of}g{k})")

    levels("a", deep)
    parts.append(f"b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, digest, tree AS source FROM a{deep})")
    levels("b", wide)
    parts.append("f0 AS (SELECT l.*, b0.pos AS spos, b0.digest AS subroot, '' AS proof FROM leaves l JOIN b0 ON l.source IS NOT DISTINCT FROM b0.source)")
    step = 0
    for of, count, tree, at in (("a", deep, "f.source", "pos"), ("b", wide, "0", "spos")):
        for k in range(count):
            slot = f"(f.{at} // {16**k}) % 16"
            parts.append(f"""f{step + 1} AS (SELECT f.* EXCLUDE (now, proof),
    CASE WHEN n = 1 THEN now ELSE sha256(array_to_string(d[1:{slot}], '') || now || array_to_string(d[{slot} + 2:], '')) END AS now,
    CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(d[1:{slot}], '') || array_to_string(d[{slot} + 2:], '') END AS proof
  FROM f{step} f JOIN {of}g{k} g ON g.tree IS NOT DISTINCT FROM {tree} AND g.up = f.{at} // {16 ** (k + 1)})""")
            step += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.digest AS verified
FROM f{step}, (SELECT digest FROM b{wide}) root"""


ORACLE = oracle()
