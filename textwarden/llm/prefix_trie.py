"""The trie of conversations' common beginnings, by ROLLUP over columns of turn ids.

A turn's id is a 128-bit digest of its role and text.  Conversations are cut into blocks of
WIDTH turns, a row of columns t1 ... t8 each, keyed by the node that the blocks before it lead
to.  ``GROUP BY block, node, ROLLUP(t1, ..., t8)`` aggregates all prefixes together;
grouping_id() says how long a group's prefix is.

A node is known by its depth and two 64-bit sums, over the turns that lead to it, of hashes of
place and turn id.  Sums need no turn before another, so the keys of all blocks are found
at once, however long a conversation is, and one ROLLUP does for all blocks.

What is summed over a subtree needs no walk either.  A node's value is laid upon its smallest
member; along that conversation's turns the values are summed from the end, and a second
ROLLUP adds up, at each node, the sums of the conversations that go through it.

Digests of members' ids are SHA-256, which goes through its input in order.  The ids of a node
are dealt by ranges; each task joins its share to pieces of text, and only pieces meet in the
task that hashes them, one after the other.

Defined results: turns of a conversation are in the order of turn, null first, equal ones by
the digest of role and text.  Turns without a conv_id belong to no conversation and are left out.
An empty table has no nodes, not even a root.  Other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.common import numbered, table, written
from textwarden.llm.merkle import crc32_sql
from textwarden.plans.common import spread

WIDTH = 8
#: Blocks of one conversation that one window goes over.
STRETCH = 1024
#: Code points of ids joined to one piece.
PIECE = 1 << 16
#: Children from which on a node is crowded, and crowded nodes that are broadcast at most.
CROWD, MOST_BROADCAST = 1_000, 200_000
SEEDS = (11, 29)
PLACES = range(1, WIDTH + 1)
SUM = "decimal(38,0)"


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of role and text; the length of the role keeps them apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, t, w): turns in order from 0, the number of a conversation's turns, ids and words."""
    named = conversations.where("conv_id is not null")
    rows = named.select(F.col("conv_id").cast("long"), "turn", turn_id(F.col("role"), F.col("text")).alias("t"), word_count(F.col("text")).alias("w"))
    placed = numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("t"), name="turns")
    return written(placed.select("conv_id", "pos", "n", F.unhex("t").alias("t"), "w"), "placed")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, t, w) of the rebuilt conversations, their conv_ids).

    The first h turns of conversation c - c % 20 come before c's own turns after its first
    h, where h is the CRC-32 of c's digits mod 4.  The remainder is SQL's, with c's own sign.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h")
    convs = turns.where("pos = 0").select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % 20).alias("anchor"), "n")
    anchors = turns.where("pos < 3 and conv_id % 20 = 0").groupBy(F.col("conv_id").alias("anchor"))
    anchors = anchors.agg(F.array_sort(F.collect_list(F.struct("pos", "t", "w"))).alias("lead"))
    convs = convs.join(anchors, "anchor", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:long,t:binary,w:long>>"))
    convs = written(convs.select("conv_id", "h", lead.alias("lead")), "leads")
    first = convs.select("conv_id", F.explode("lead").alias("x")).select("conv_id", "x.pos", "x.t", "x.w")
    shift = F.size("lead") - F.col("h")
    shifts = convs.select("conv_id", "h", shift.alias("shift"))
    own = turns.where(F.col("pos") >= F.crc32(F.col("conv_id").cast("string")) % 4).join(shifts, "conv_id")
    return first.unionByName(own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "t", "w")), convs.select("conv_id")


def in_stretches(rows: DataFrame, sums: list[str], down: bool) -> DataFrame:
    """Replaces each of ``sums`` in rows (conv_id, block, ...) by the total of the blocks before (``down``: after) it.

    A window covers STRETCH blocks at most; totals of the further stretches of a long
    conversation are added by a join, which is empty where no conversation is that long.
    """
    stretch = F.floor(F.col("block") / STRETCH)
    rows = rows.withColumn("stretch", stretch)
    far = (Window.unboundedPreceding, -1)
    order = lambda c: F.col(c).desc() if down else F.col(c)
    inner = Window.partitionBy("conv_id", "stretch").orderBy(order("block")).rowsBetween(*far)
    outer = Window.partitionBy("conv_id").orderBy(order("stretch")).rowsBetween(*far)
    totals = rows.where(f"block >= {STRETCH}").select("conv_id").distinct().join(rows, "conv_id").groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(c) for c in sums])
    over = totals.select("conv_id", "stretch", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).cast(SUM).alias("far_" + c) for c in sums])
    out = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).cast(SUM).alias("near_" + c) for c in sums])
    out = out.join(over, ["conv_id", "stretch"], "left")
    kept = [c for c in rows.columns if c not in (*sums, "stretch")]
    return out.select(*kept, *[(F.col("near_" + c) + F.coalesce("far_" + c, F.lit(0).cast(SUM))).cast(SUM).alias(c) for c in sums])


def placed_hash(seed: int, depth: Column, t: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth, t).cast(SUM)


def node_key(depth: Column, a: Column, b: Column) -> Column:
    """A node's key of 16 bytes; equal for equal beginnings."""
    text = F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string"))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


ROOT = (0, 0, 0)


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv_id, block, a, b, turns): blocks of WIDTH turns with the two sums of all turns before them."""
    block = F.floor(F.col("pos") / WIDTH).alias("block")
    depth = F.col("pos") + 1
    sums = [F.sum(placed_hash(s, depth, F.col("t"))).cast(SUM).alias(c) for s, c in zip(SEEDS, "ab", strict=True)]
    rows = turns.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("pos", "t", "w"))).alias("turns"), *sums)
    found = in_stretches(rows, ["a", "b"], down=False)
    return written(found.select("conv_id", "block", "a", "b", F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("turns")), "blocks")


def rolled(blocks: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """One row for each node below the root: (depth, key, parent, w, aggregates), by one ROLLUP over all blocks.

    ``aggregates`` are SQL; ``{v}k`` columns of ``blocks`` are aggregated for the place k
    where a group's prefix ends if an aggregate holds ``{k}``.
    """
    t = [f"t{k}" for k in PLACES]
    wide = blocks.select("*", *[F.get("turns", F.lit(k - 1)).alias(f"t{k}") for k in PLACES])
    long_ = {name: [sql.format(k=k) for k in PLACES] if "{k}" in sql else [sql] for name, sql in aggregates.items()}
    picked = ", ".join(f"{sql} AS {name}{k}" for name, many in long_.items() for k, sql in enumerate(many, 1))
    query = f"SELECT block, a, b, {', '.join(t)}, {WIDTH} - bit_count(grouping_id()) AS upto, {picked} FROM {{wide}} GROUP BY block, a, b, ROLLUP({', '.join(t)})"
    rows = blocks.sparkSession.sql(query, wide=wide)
    # a null turn in a group's prefix: conversations that ended before it
    own = F.element_at(F.array(*t), F.greatest(F.col("upto"), F.lit(1)))
    rows = rows.withColumn("own", own).where("upto > 0 and own is not null")
    depth = F.col("block") * WIDTH + F.col("upto")

    def key(less: int) -> Column:
        """The key of the group's node, or of the one before it."""
        total = []
        for seed, c in zip(SEEDS, "ab", strict=True):
            parts = [F.when(F.col("upto") - less >= k, placed_hash(seed, F.col("block") * WIDTH + k, F.col(f"t{k}.t"))).otherwise(F.lit(0).cast(SUM)) for k in PLACES]
            total.append(sum(parts, F.col(c)).cast(SUM))
        return node_key(depth - less, *total)

    out = [F.element_at(F.array(*[f"{name}{k}" for k in range(1, len(many) + 1)]), F.col("upto") if len(many) > 1 else F.lit(1)).alias(name) for name, many in long_.items()]
    return rows.select(depth.cast("long").alias("depth"), key(0).alias("key"), key(1).alias("parent"), F.col("own.w").alias("w"), *out)


def pieces_of(ends: DataFrame) -> DataFrame:
    """(key, first, piece): the conv_ids of a node in ascending order, joined by commas, in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for k, i in zip(batch["key"].tolist(), batch["conv_id"].tolist(), strict=True):
                if ids and (k != key or size >= PIECE):
                    out.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, i
                ids.append(str(i))
                size += len(ids[-1]) + 1
            yield pd.DataFrame(out, columns=["key", "first", "piece"])
            out = []
        if ids:
            yield pd.DataFrame([(key, first, ",".join(ids))], columns=["key", "first", "piece"])

    order = ("key", "conv_id")
    return ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "key binary, first long, piece string")


def ends_sha256(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations (key, conv_id) end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, piece in zip(batch["key"].tolist(), batch["piece"].tolist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    return pieces_of(ends).repartition("key").sortWithinPartitions("key", "first").mapInPandas(run, "key binary, ends_sha256 string")


def parent_ids(nodes: DataFrame, children: DataFrame, root: int) -> DataFrame:
    """(conv_id, top, above): for each conversation that is some node's smallest member the depth of the
    topmost such node below the root, and the smallest member of the node above that.

    Deeper nodes of a conversation have itself as their parent's smallest member.  Nodes with
    a great many children are broadcast, as many tasks look them up.
    """
    tops = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "parent")).alias("t")).select("conv_id", F.col("t.depth").alias("top"), F.col("t.parent").alias("key"))
    first, deeper = tops.where("top = 1").select("conv_id", "top", F.lit(root).alias("above")), tops.where("top > 1")
    members = nodes.select("key", F.col("conv_id").alias("above"))
    crowded = written(members.join(children.where(F.col("n_children") > CROWD).select("key"), "key"), "crowded")
    if crowded.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        found = deeper.join(members, "key")
    else:
        few = deeper.join(F.broadcast(crowded.select("key")), "key", "left_anti").join(members, "key")
        found = deeper.join(F.broadcast(crowded), "key").unionByName(few)
    return first.unionByName(found.select("conv_id", "top", "above"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, pos, t, w) of the conversations ``convs`` (conv_id)."""
    spark = turns.sparkSession
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    if not root["n_convs"]:
        return spark.createDataFrame([], OUT)
    blocks = blocks_of(turns)
    nodes = written(rolled(blocks, {"n_convs": "count(*)", "conv_id": "min(conv_id)"}), "nodes")
    children = written(nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    nodes = written(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "with_children")

    # values of the nodes, laid upon their smallest members, summed from the end of a conversation
    block = F.floor((F.col("depth") - 1) / WIDTH).alias("block")
    place = (F.col("depth") - 1) % WIDTH + 1
    here = {"saved": (F.col("n_convs") - 1) * F.col("w"), "leaf": (F.col("n_children") == 0).cast("long")}
    laid = nodes.groupBy("conv_id", block).agg(*[F.sum(F.when(place == k, v)).alias(f"{c}{k}") for c, v in here.items() for k in PLACES])
    spread_ = blocks.join(laid, ["conv_id", "block"], "left").fillna(0)
    totals = [sum((F.col(f"{c}{k}") for k in PLACES), F.lit(0)).cast(SUM).alias(c) for c in here]
    after = in_stretches(spread_.select("*", *totals), list(here), down=True)
    from_end = [(sum((F.col(f"{c}{j}") for j in PLACES if j >= k), F.lit(0)) + F.col(c)).cast("long").alias(f"{c}{k}") for c in here for k in PLACES]
    after = after.select("block", "a", "b", "turns", *from_end).where("saved1 <> 0 or leaf1 <> 0")
    below = rolled(after, {"saved_tokens": "sum(saved{k})", "n_leaves": "sum(leaf{k})"}).select("key", "saved_tokens", "n_leaves")

    last = turns.groupBy("conv_id").agg(
        F.count("*").alias("depth"), *[F.sum(placed_hash(s, F.col("pos") + 1, F.col("t"))).cast(SUM).alias(c) for s, c in zip(SEEDS, "ab", strict=True)]
    )
    zero = F.lit(0).cast(SUM)
    ends = convs.join(last, "conv_id", "left").select(node_key(F.coalesce("depth", F.lit(0)), F.coalesce("a", zero), F.coalesce("b", zero)).alias("key"), "conv_id")
    ended = written(ends_sha256(ends), "ends")

    top = nodes.where("depth = 1").join(below, "key").agg(F.count("*").alias("n"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    key = node_key(F.lit(0), zero, zero)
    first = [root["conv_id"], 0, None, root["n_convs"], top["n"], (top[1] or 0) or 1, top[2] or 0]
    root_row = spark.createDataFrame([first], ROOT_ROW).withColumn("key", key)
    parents = parent_ids(nodes, children, root["conv_id"])
    full = nodes.join(below, "key", "left").join(parents, "conv_id")
    parent = F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id"))
    full = full.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "key")
    none = hashlib.sha256(b"").hexdigest()
    return full.unionByName(root_row).join(ended, "key", "left").drop("key").fillna(none, ["ends_sha256"])


ROOT_ROW = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
OUT = ROOT_ROW + ", ends_sha256 string"


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt ``conversations``."""
    turns = turns_of(spread(table(spark, sf_dir, "conversations"), "conv_id"))
    rows, convs = rebuilt(turns)
    return prefix_trie(written(rows, "rebuilt"), convs)


ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos, id, w FROM (
    SELECT conv_id, turn, substr(sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h, list(id || ':' || w ORDER BY pos) AS turns FROM t GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(coalesce(a.turns, [])[1:o.h], o.turns[o.h + 1:]) AS path FROM own o LEFT JOIN own a ON a.conv_id = o.conv_id - o.conv_id % 20),
steps AS (SELECT conv_id, len(path) AS n, path, unnest(range(0, len(path) + 1)) AS depth FROM built),
keyed AS (SELECT conv_id, n, depth, array_to_string(path[1:depth], ',') AS key, CASE WHEN depth > 0 THEN array_to_string(path[1:depth - 1], ',') END AS parent,
                 CASE WHEN depth > 0 THEN string_split(path[depth], ':')[2]::BIGINT ELSE 0 END AS w FROM steps),
node AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth),
child AS (SELECT parent, count(*) AS n FROM node WHERE depth > 0 GROUP BY parent),
full_ AS (SELECT node.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM node
  LEFT JOIN node p ON p.key = node.parent AND p.depth = node.depth - 1 LEFT JOIN child c ON c.parent = node.key),
below AS (
  SELECT k.key, k.depth, sum((f.n_children = 0)::INTEGER) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM full_ f JOIN keyed k ON k.conv_id = f.conv_id AND k.depth <= f.depth GROUP BY k.key, k.depth)
SELECT conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_ f JOIN below USING (key, depth)
"""
