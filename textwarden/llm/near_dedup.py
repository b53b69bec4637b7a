"""Near-duplicates by circulant MinHash, confirmed by exact Jaccard similarity.

Two permutations make every coordinate of a signature.  The first, sigma, scatters
shingles over Z mod 2^32; the second, pi, is shifted circularly by k for coordinate
k, so coordinate k is the least pi(sigma(shingle) - k).  Bands of ``ROWS``
coordinates are hashed to buckets, and documents that share one are candidates.

The steps, each a Spark job whose work follows the input:

1. One pass over the texts gives for each document the size of its shingle set, a
   128-bit key of that set and its band buckets.  Documents of equal key hold equal
   sets; the least doc_id stands for all of them from here on.
2. In each bucket every document is paired with the least one.  Such a star has as
   many pairs as documents, however large the group.  Pairs are confirmed on full
   sets, and connected components are taken of the confirmed links.  In buckets that
   stay apart, the documents outside the largest component are paired with ``HUBS``
   further members, again a bounded number for each.
3. What is still apart is compared in full, in blocks: the documents outside a bucket's
   largest component (strays) meet all its members in groups of at most 2 * ``BLOCK``
   rows.  A first round compares sketches only and says which documents have any
   partner left at all; a second confirms links between those on full sets and emits
   at most one link for each two components.  So no link is lost, and neither tasks
   nor row counts grow with the square of a group.
4. Components again, over all links between representatives; copies follow theirs.

A sketch holds one byte of each coordinate.  Pairs whose sketches agree in fewer than
``LEAST_SHARE`` of the bytes, five and a half standard deviations below what the
threshold makes likely, aren't fetched for the exact test (chance of losing a link at
the threshold: 2e-8).

Chance of missing a pair of similarity s: (1 - s^ROWS)^BANDS, under 1e-6 at 0.85 and
7e-5 at 0.8, where the pipeline runs.

Defined results: rows with a null or blank text have an empty set (n_shingles 0),
link with nothing and are kept.  Rows with a null doc_id can't be linked either; they
come back with a null component_id and are kept.  Rows of one doc_id are one document and
come back as often as they came in; if their texts differ, the greatest text is the
document's.  Other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import corpus, written

BANDS, ROWS = 24, 5
BLOCK, HUBS = 512, 6
COORDINATES = BANDS * ROWS
#: Ids that are broadcast at most to pick texts.  A broadcast table passes through the driver several times over, so
#: what is broadcast stays at some 2 MB, whatever the input.
MOST_BROADCAST = 50_000
#: Parts of the bitmap that stands for more ids, and bits in each (those that bitmap_construct_agg() has).
PARTS, BITS = 512, 32_768
#: Rows of a bucket summary that are broadcast at most; pairs or rows from which on a centre or bucket is crowded; shares it is dealt in.
MOST_SUMMARIES, CROWD, SALTS = 50_000, 500, 32
#: A summary's row with hubs is so many times as wide as one without.
HUBS_WIDTH = 8
#: Odd multiplier of the polynomial hash over a shingle's bytes, and its inverse mod 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SIGNED = "doc_id long, n_shingles long, set_key binary, sketch binary, buckets array<long>"


class Powers:
    """Powers of the multiplier and of its inverse, as far as the longest text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "u8")

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 65536)
            for name, m in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, m, "u8")
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype="u8"))
        return self.up, self.down


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words.

    A-Z are lower-cased, words are runs without ASCII white space.  A text with
    fewer words, but some, has its whole word sequence as its one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    joined = np.frombuffer(b" ".join(words), "u1")
    up, down = POWERS.to(len(joined) + 1)
    upto = np.zeros(len(joined) + 1, "u8")
    np.cumsum((joined.astype("u8") + np.uint64(1)) * up[: len(joined)], out=upto[1:])
    ends = np.append(np.flatnonzero(joined == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    k = min(width, len(words))
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(mixed((upto[b] - upto[a]) * down[a]))


def signature(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Coordinates of the circulant MinHash of a non-empty set."""
    scattered = (shingles >> np.uint64(32)).astype("u4")  # sigma: the hash, seen mod 2^32
    shifts = np.arange(size, dtype="u4")[:, None]
    least = np.full(size, 0xFFFFFFFF, "u4")
    for at in range(0, len(scattered), 512):
        x = scattered[None, at : at + 512] - shifts
        x ^= x >> np.uint32(16)  # pi: a permutation of Z mod 2^32
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype("u8")
    h = np.arange(1, BANDS + 1, dtype="u8") * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        h = mixed((h ^ rows[:, r]) * np.uint64(0x9FB21C651E98DF25))
    return h.view("i8")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, width)
                if len(s):
                    sig = signature(s)
                    rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.astype("u1").tobytes(), bands(sig)))
                else:
                    rows.append((doc, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "sketch", "buckets"])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SIGNED)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles array<long>) of the documents whose ids are in ``wanted``.

    The ids are broadcast up to ``MOST_BROADCAST``.  Of more, a bitmap of constant size is,
    and only the texts that it lets pass are shuffled, to be told by their ids.
    """

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: shingle_set(t, width).view("i8"))

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    small = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    kept = rows.join(F.broadcast(wanted), "doc_id", "left_semi") if small else likely_wanted(rows, wanted).join(wanted, "doc_id", "left_semi")
    return kept.select("doc_id", run("text").alias("shingles"))


def likely_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ids are in ``wanted``, and a few more: those whose bit in a bitmap of the wanted ids' hashes is set."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS * BITS))
    placed = lambda df: df.withColumn("part", F.floor(place / BITS)).withColumn("bit", place % BITS)
    bitmap = placed(wanted.select("doc_id")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return placed(rows).join(F.broadcast(bitmap), "part").where(is_set).select(*rows.columns)


def least_share(percent: int) -> float:
    p = percent / 100
    return p - 5.5 * (p * (1 - p) / COORDINATES) ** 0.5


def alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""
    side = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias("n" + c), F.col("sketch").alias("s" + c))

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(v), "u1").reshape(-1, COORDINATES) for v in (x, y))
        return pd.Series((one == two).mean(axis=1))

    both = on_centre(pairs.where("a <> b"), side("a")).join(side("b"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.where(share("sa", "sb") >= least_share(percent)).select("a", "b")


def by_bucket(rows: DataFrame, summary: DataFrame, how: str = "inner", key: str = "bucket", width: int = 1) -> DataFrame:
    """``rows`` joined with a table of one row for each bucket (or ``key``); no task gets all rows of a large one.

    The summary's column ``size`` is the number of a bucket's rows, and is left out.  A table
    of up to MOST_SUMMARIES rows (of ``width`` times the common one) is broadcast.  Of a
    longer one the crowded buckets are, and the others are joined by a shuffle; if even those
    are too many, all are joined in SALTS copies, with each bucket's rows dealt over them.
    """
    most = MOST_SUMMARIES // width
    few = lambda df: df.limit(most + 1).count() <= most
    plain = summary.drop("size")
    if few(summary):
        return rows.join(F.broadcast(plain), key, how)
    crowded = summary.where(F.col("size") > CROWD)
    if few(crowded):
        mark = F.broadcast(crowded.drop("size"))
        rest = rows.join(F.broadcast(crowded.select(key)), key, "left_anti")
        return rest.join(summary.where(F.col("size") <= CROWD).drop("size"), key, how).unionByName(rows.join(mark, key, how))
    dealt_ = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = plain.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt_.join(copies, [key, "salt"], how).drop("salt")


def on_centre(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) joined with ``side`` on a, where a star's centre may be in a great many pairs.

    The pairs of a crowded centre are dealt over SALTS copies of its row.  ``pairs`` and
    ``side`` are named several times, so they should be stored tables.
    """
    crowded = written(pairs.groupBy("a").count().where(F.col("count") > CROWD).select("a"), "crowded")
    n = crowded.limit(MOST_SUMMARIES + 1).count()
    if not n:
        return pairs.join(side, "a")
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if n > MOST_SUMMARIES:
        return salted(pairs).join(copies(side), ["a", "salt"]).drop("salt")
    mark = F.broadcast(crowded)
    hot = salted(pairs.join(mark, "a", "left_semi")).join(copies(side.join(mark, "a", "left_semi")), ["a", "salt"]).drop("salt")
    return pairs.join(mark, "a", "left_anti").join(side, "a").unionByName(hot)


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every document has one larger end of an edge (a > b) at most, and none is both a larger and a smaller one."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """Edges (a, b) from every document in ``links`` (a, b) to the least id reachable, if that is another one.

    Large-star and small-star steps in turn; each at least halves the depth of the
    trees, so the rounds grow with the logarithm of the longest path.  They end as soon
    as the edges are a forest of stars, which further steps would leave as it is.
    """
    turned = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(turned.distinct(), "edges")
    while not is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: all smaller neighbours, and the node, point to the least one; large edges go from larger to smaller
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct(), "edges")
    return edges


def placed_by(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in a forest of stars."""
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in ``links`` (a, b): the least id reachable."""
    return placed_by(stars(links))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, on full sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = (F.size("sa") + F.size("sb")).cast("long")
    return on_centre(pairs, one).join(two, "b").where(100 * common >= percent * (both - common)).select("a", "b")


def dealt(open_members: DataFrame) -> DataFrame:
    """Rows (bucket, i, j, stray, doc_id, component): strays of block i meet members of block j.

    ``open_members``: (bucket, doc_id, component).  Strays are outside the bucket's
    largest component.
    """
    parts = open_members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
    sizes = sizes.where("all > top.n").select(
        "bucket",
        F.col("all").alias("size"),
        F.col("top.component").alias("main"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("mb"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("sb"),
    )
    rows = written(by_bucket(open_members, written(sizes, "sizes")), "open_rows")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = rows.where("component <> main").select("*", block("sb").alias("i"), every("mb").alias("j"), F.lit(True).alias("stray"))
    members = rows.select("*", every("sb").alias("i"), block("mb").alias("j"), F.lit(False).alias("stray"))
    out = strays.unionByName(members)
    return out.select("bucket", "i", "j", "stray", "doc_id", "component", (F.col("component") == F.col("main")).alias("in_main"))


def with_partners(open_members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The members that have, by sketch and size, any possible partner outside their component."""
    least = least_share(percent) * COORDINATES

    def run(group: pd.DataFrame) -> pd.DataFrame:
        stray = group["stray"].to_numpy(bool)
        ids, comp, size = (group[c].to_numpy() for c in ("doc_id", "component", "n_shingles"))
        sketch = np.frombuffer(b"".join(group["sketch"]), "u1").reshape(-1, COORDINATES)
        x, y = np.flatnonzero(stray), np.flatnonzero(~stray)
        hit = np.zeros(len(ids), bool)
        for at in range(0, len(x), 64):
            some = x[at : at + 64]
            same = (sketch[some][:, None, :] == sketch[y][None, :, :]).sum(axis=2)
            low, high = np.minimum.outer(size[some], size[y]), np.maximum.outer(size[some], size[y])
            ok = (same >= least) & (comp[some][:, None] != comp[y]) & (100 * low >= percent * high)
            hit[some] |= ok.any(axis=1)
            hit[y] |= ok.any(axis=0)
        return group.loc[hit, ["bucket", "doc_id", "component"]]

    rows = dealt(open_members).join(sketches, "doc_id")
    return rows.groupBy("bucket", "i", "j").applyInPandas(run, "bucket long, doc_id long, component long").distinct()


def between_components(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between documents of different components in one bucket."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        stray, main = group["stray"].tolist(), group["in_main"].tolist()
        comp, ids = group["component"].tolist(), group["doc_id"].tolist()
        sets_ = [np.asarray(s, "i8") for s in group["shingles"]]
        top = {c: c for c in comp}

        def find(c: int) -> int:
            while top[c] != c:
                c = top[c]
            return c

        out = []
        members = [y for y in range(len(ids)) if not stray[y]]
        for x in (x for x in range(len(ids)) if stray[x]):
            for y in members:
                if not main[y] and ids[x] >= ids[y]:
                    continue  # two strays meet once
                if (p := find(comp[x])) == (q := find(comp[y])):
                    continue
                n, m = len(sets_[x]), len(sets_[y])
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                common = len(np.intersect1d(sets_[x], sets_[y], assume_unique=True))
                if 100 * common >= percent * (n + m - common):
                    top[p] = q
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = dealt(open_members).join(sets, "doc_id")
    return rows.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long")


def unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, doc_id, component) of the buckets that hold pairs in different components not yet tested.

    Pairs with the least member were; so a bucket counts if its other members differ.
    """
    placed = members.where("doc_id <> first").join(found, "doc_id", "left")
    placed = written(placed.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    apart = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return by_bucket(placed, written(apart.select("bucket", "size"), "apart"), "left_semi")


def hub_pairs(open_members: DataFrame) -> DataFrame:
    """Pairs of members outside a bucket's largest component with HUBS members of other components."""
    draw = [F.min(F.struct(F.xxhash64(F.lit(r), "doc_id").alias("h"), "doc_id", "component")) for r in range(HUBS)]
    hubs = open_members.groupBy("bucket").agg(F.array_distinct(F.array(*draw)).alias("hubs"))
    parts = open_members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"))
    rows = by_bucket(open_members, written(main.join(hubs, "bucket"), "hubs"), width=HUBS_WIDTH).where("component <> top.component")
    pairs = rows.select("doc_id", "component", F.explode("hubs").alias("hub")).where("component <> hub.component")
    return pairs.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()


def confirmed_of(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs that are links.  Each step is stored, as plans that name a step several times are the driver's largest load."""
    likely = written(alike(written(pairs, name + "_pairs"), sketches, percent), name + "_likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return written(confirmed(likely, written(sets_of(docs, ids, width), name + "_sets"), percent), name + "_links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = written(signatures(docs, width), "signatures")
    texts = docs
    if not signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # rows of one doc_id are one document: its set and its signature come from the same, the greatest, text
        rows, nameless = signed.where("doc_id is not null").select("doc_id"), signed.where("doc_id is null")
        texts = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
        again = written(signatures(texts, width), "signatures")
        signed = written(rows.join(again, "doc_id").unionByName(nameless), "rows")
    full = signed.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # equal sets have equal buckets, so the least row of a key brings its buckets along
    copies = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "buckets")).alias("r"), F.count("*").alias("n"))
    reps = copies.select("set_key", "r.*")
    sketches = reps.select("doc_id", "n_shingles", "sketch")
    buckets = reps.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("size"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")
    )
    # buckets of equal members need but one test
    distinct = shared.where("size > 1").groupBy("first", "size", "who").agg(F.min("bucket").alias("bucket"))
    members = written(by_bucket(buckets, written(distinct.select("bucket", "first", "size"), "shared")).select("bucket", "doc_id", "first"), "members")
    sketches = written(sketches.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "sketches")

    pairs = members.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = stars(confirmed_of(texts, pairs, sketches, width, percent, "star"))
    still = written(unsettled(members, placed_by(edges)), "unsettled")
    if not still.isEmpty():
        more = confirmed_of(texts, hub_pairs(still), sketches, width, percent, "hub")
        # the stars found so far hold together what their links did
        edges = stars(edges.unionByName(more))
        again = written(unsettled(members, placed_by(edges)), "unsettled")
        left = written(with_partners(again, sketches, percent), "partners")
        sets = sets_of(texts, left.select("doc_id").distinct(), width)
        edges = stars(edges.unionByName(written(between_components(left, sets, percent), "last_links")))
    # components are those of the representatives; copies get theirs by their key, however many they are
    final = written(placed_by(edges), "components")
    several = copies.where("n > 1").select("set_key", F.col("r.doc_id").alias("rep"), F.col("n").alias("size"))
    several = several.join(final.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    several = written(several.select("set_key", "rep", "size", F.coalesce("component", "rep").alias("component")), "copied")
    copied = by_bucket(full.select("set_key", "doc_id"), several.select("set_key", "component", "size"), key="set_key").select("doc_id", "component")
    single = final.join(several.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "component")
    return (
        signed.select("doc_id", "n_shingles")
        .join(copied.distinct().unionByName(single), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all ``documents``."""
    return near_duplicates(corpus(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 2], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
  WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
