"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows of ``WINDOW`` consecutive words are the sets to be contained.  Their
shingles (here of two words; of one where an item has one word) are ordered by how
often they occur in all documents.  Containment of a whole window needs every shingle
of it, so its prefix is one shingle: the rarest.  Documents are joined on the rarest
shingles alone.  An occurrence at word ``pos`` of a document and at word ``at`` of an
item fixes where the item would begin; positional and length bounds drop what would
hang over either end of the text, and the windows around it are then verified word by
word.  All windows of one item that the same occurrence proves are merged into one
interval of document words.

The join side made from the benchmark is broadcast only up to ``MOST_BROADCAST`` rows,
counted beforehand; beyond it Spark shuffles both sides on the shingle.  Documents are
dealt to rows of ``CHUNK`` words with the words a window may reach, so that what
travels with a word is of a fixed size, however long the text.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters.  Defined
results: a null or wordless text has n_words 0 and no hit; null or wordless items have
no window; rows of equal doc_id and text share their hits and come back as often as
they came in, a null doc_id included; an item_id that is null counts as an item but
isn't named in the digest; other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import ascii_lower, corpus, table, written

WINDOW = 10
#: Rows, and bytes of their words or names, that are broadcast at most.
MOST_BROADCAST, MOST_BYTES = 200_000, 64 << 20
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a document that are joined together with their surroundings, as one row.
CHUNK = 48


def words_of(text: Column) -> Column:
    """The words of a text, not yet lower-cased; null for a null text."""
    return F.array_remove(F.split(text, BETWEEN), "")


def lowered(word: Column) -> Column:
    """Lower-cases A-Z only; plain ASCII, by far the most, takes the short way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(ascii_lower(word))


def shingle(first: Column, second: Column | None = None) -> Column:
    return F.xxhash64(F.lit(1), lowered(first)) if second is None else F.xxhash64(lowered(first), lowered(second))


def chunks(docs: DataFrame, window: int) -> DataFrame:
    """(key, begin, own, context): a document's words dealt to rows of CHUNK words.

    ``context`` adds the words that windows over the chunk's own words may reach;
    its first word is the document's word number ``begin``, and the chunk's own words
    begin at ``own`` in it.
    """
    piece = lambda i: F.struct(
        F.greatest(i - window, F.lit(0)).alias("begin"),
        F.least(i, F.lit(window)).alias("own"),
        F.slice("words", F.greatest(i - window, F.lit(0)) + 1, CHUNK + window + F.least(i, F.lit(window))).alias("context"),
    )
    dealt = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK)), piece)
    rows = docs.select("key", words_of(F.col("text")).alias("words"))
    return rows.select("key", F.explode_outer(dealt).alias("c")).select("key", "c.begin", "c.own", "c.context")


def tokens(rows: DataFrame, single: bool) -> DataFrame:
    """One row for each own word of a chunk: ``pos`` in the context, and its shingle."""
    own = lambda k: F.slice("context", F.col("own") + 1 + k, CHUNK)
    if single:
        out = rows.select("*", F.posexplode_outer(own(0)).alias("at_own", "w")).withColumn("shingle", shingle(F.col("w")))
    else:
        both = F.posexplode_outer(F.arrays_zip(own(0).alias("w"), own(1).alias("x"))).alias("at_own", "p")
        out = rows.select("*", both).withColumn("shingle", shingle(F.col("p.w"), F.col("p.x")))
        out = out.where("p.w is not null and p.x is not null")
    return out.select(*rows.columns, (F.col("own") + F.col("at_own")).alias("pos"), "shingle")


def bounded_broadcast(df: DataFrame, most: int = MOST_BROADCAST, *, size: Column | None = None, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``most`` rows and ``size`` adds up to at most ``most_bytes`` over them."""
    some = df.select((F.lit(8) if size is None else size).cast("long").alias("size")).limit(most + 1)
    n, held = some.agg(F.count("*"), F.sum("size")).first()
    small = n <= most and (held or 0) <= most_bytes
    return (F.broadcast(df) if small else df), small


def prefixes(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(shingle, item, m, at, near): for each window its rarest shingle, once for each place.

    ``at`` is the place of the shingle in the item of ``m`` words, ``item`` the item's
    row number key; ``near`` are the item's words that windows over that place can hold,
    so a row is as long as two windows, however long the item is.
    """
    m = F.size("words")
    word = lambda i: F.get("words", i)
    place = lambda i: F.struct(i.alias("pos"), word(i).alias("w"), word(i + 1).alias("x"), F.slice("words", near_from(i, window) + 1, 2 * window).alias("near"))
    places = items.select("item", m.alias("m"), F.explode(F.transform(F.sequence(F.lit(0), m - 1), place)).alias("p"))
    pair = F.when(F.col("m") == 1, shingle(F.col("p.w"))).otherwise(shingle(F.col("p.w"), F.col("p.x")))
    places = places.where("m = 1 or p.x is not null").select("item", "m", "p.pos", "p.near", pair.alias("shingle"))
    places = written(places, "places")
    counts = None
    for single in (False, True):
        wanted = places.where(F.col("m") == 1 if single else F.col("m") > 1).select("shingle").distinct()
        if single and wanted.isEmpty():
            continue  # the documents need not be read for one-word items
        own, _ = bounded_broadcast(wanted)
        seen = tokens(chunks(docs, window), single).select("shingle").join(own, "shingle", "left_semi")
        n = seen.groupBy("shingle").agg(F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    ranked = places.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # windows begin at 0 .. m - window; a place is within those that begin at pos - window + 2 .. pos
    last = F.greatest(F.col("m") - F.lit(window), F.lit(0))
    span = F.when(F.col("m") == 1, F.lit(1)).otherwise(F.least(F.col("m"), F.lit(window)) - 1)
    begins = F.explode(F.sequence(F.greatest(F.col("pos") - span + 1, F.lit(0)), F.least(F.col("pos"), last)))
    rarest = (
        ranked.where(F.greatest(F.col("pos") - span + 1, F.lit(0)) <= F.least(F.col("pos"), last))
        .withColumn("begin", begins)
        .groupBy("item", "begin")
        .agg(F.min(F.struct("n", "shingle", "pos", "m", "near")).alias("r"))
        .select("item", F.col("r.shingle").alias("shingle"), F.col("r.pos").alias("at"), "r.m", "r.near")
        .distinct()
    )
    return written(rarest, "prefixes")


def near_from(at: Column, window: int) -> Column:
    """The item's word that ``near`` begins with."""
    return F.greatest(at - (window - 1), F.lit(0))


def verified(candidates: DataFrame, window: int) -> DataFrame:
    """(key, item, lo, hi): the document words that the windows around a candidate cover.

    Needs begin, context, pos, m, near, at; keeps rows with at least one window.
    """
    base, m = F.col("pos") - F.col("at"), F.col("m")
    size = F.least(m, F.lit(window))
    overlap = F.when(m == 1, F.lit(0)).otherwise(F.lit(1))
    first = F.greatest(F.col("at") + overlap - size + 1, F.lit(0), -base)
    final = F.least(F.col("at"), m - size, F.size("context") - size - base)
    rows = candidates.where(first <= final)
    same = lambda t: F.transform(F.slice("context", base + t + 1, size), lowered) == F.slice("near", t - near_from(F.col("at"), window) + 1, size)
    rows = rows.withColumn("there", F.filter(F.sequence(first, final), same)).where(F.size("there") > 0)
    lo = F.col("begin") + base + F.array_min("there")
    return rows.select("key", "item", lo.alias("lo"), (F.col("begin") + base + F.array_max("there") + size - 1).alias("hi"))


def occurrences(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(key, item, lo, hi): intervals of document words that windows of ``item`` cover."""
    prefix = prefixes(docs, items, window)
    out = None
    for single in (False, True):
        side = prefix.where("m = 1" if single else "m > 1")
        if single and side.isEmpty():
            continue
        near, _ = bounded_broadcast(side, size=F.octet_length(F.array_join("near", " ")))
        found = verified(tokens(chunks(docs, window), single).join(near, "shingle"), window)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash), a row for each document.

    A row is told by its doc_id and the hash of its text together, either of which may
    be null or repeated.
    """
    keyed = docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    lower = F.transform(words_of(F.col("text")), lowered)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), lower.alias("words"))
    items = items.where(F.size("words") > 0).distinct()
    items = written(items.withColumn("item", F.xxhash64("item_id", "words")), "items")
    hits = occurrences(keyed, items.select("item", "words").dropDuplicates(["item"]), window)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"]))))
    names = items.select("item", "item_id")
    named, _ = bounded_broadcast(names, size=F.coalesce(F.octet_length("item_id"), F.lit(1)))
    per_doc = (
        hits.distinct()
        .join(named, "item")
        .groupBy("key")
        .agg(
            F.collect_set(F.struct("lo", "hi")).alias("spans"),
            F.collect_set("item_id").alias("ids"),
            F.count_distinct(F.coalesce("item_id", F.lit("\0"))).alias("n_items"),
        )
        .select("key", F.size(covered).cast("long").alias("n_hit"), "n_items", "ids")
    )
    sizes = keyed.select("doc_id", "key", F.col("key.h").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = sizes.join(per_doc, sizes["key"].eqNullSafe(per_doc["key"]), "left")
    ids = F.coalesce(F.array_join(F.array_sort("ids"), ","), F.lit(""))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "utf-8"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "text_hash",
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all ``documents`` stand in passages of ``benchmark``."""
    return decontaminate(corpus(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM iw WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, (SELECT DISTINCT k FROM wins))),
hits AS (SELECT doc_id, s, wins.k, item_id FROM spots JOIN wins USING (win, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
