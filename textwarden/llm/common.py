"""What the operators of this subpackage share: tables, scratch space, samples."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.plans.common import shared_folder, spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt over all cores where its files make too few tasks for them."""
    return spread(table(spark, sf_dir, name), {"documents": "doc_id", "pages": "page_id"}[name])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset, and all of
    Spark runs in one process of this machine, a folder of the local machine serves.
    """
    return shared_folder(spark)


@contextmanager
def uncollected():
    """No cyclic garbage arises while texts are encoded; the collector would only walk the tables over and over."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` in the shared folder and reads it back.

    A lost executor costs no recomputation beyond the tasks it ran.  Each call has
    a folder of its own under the application's, which may be removed once the
    application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textwarden-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, fold: Column, limit: int, max_chars: int
) -> DataFrame:
    """At most ``limit`` labelled documents of at most ``max_chars`` characters in all.

    ``fold`` is a condition on ``doc_id`` that says which labels may be learned.
    Only labels of documents that can be learned from count toward ``limit``: those
    with a text of 1 to ``max_chars`` characters.  They are taken in the order of a
    hash of ``doc_id``, so the sample is the same on every run and doesn't depend on
    partitioning.  If they are too long together, those of more than ten times the
    mean length that the bounds allow wait until the others are in, the longest last,
    so a long text never keeps shorter ones out.  Both limits are proven bounds of
    what reaches the driver.  Returns (doc_id, text, label int).
    """
    docs = documents.select("doc_id", "text").where(F.length("text").between(1, max_chars))
    ids = (
        labels.where(fold & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = docs.join(F.broadcast(written(ids, "sampled_ids")), "doc_id")
    # ids are at most ``limit``, so this window sorts at most so many rows
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    share = F.lit(max(1, max_chars * 10 // limit))
    order = Window.orderBy(F.greatest("n", share), F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.select("doc_id", F.length("text").alias("n")).withColumn("upto", F.sum("n").over(order))
    return rows.join(F.broadcast(sized.where(F.col("upto") <= max_chars).select("doc_id")), "doc_id")


ROW_BITS = 33  # monotonically_increasing_id() counts rows in the lower bits, tasks above them


def numbered(rows: DataFrame, by: str, *order: Column, name: str) -> DataFrame:
    """``rows`` with ``pos``, a row's place from 0 among those of equal ``by`` in the given order, and ``n``, their number.

    Rows are dealt by ranges of (by, order), so a value of ``by`` that a great many rows
    have is spread over as many tasks as it needs; the places come from the counts of the
    ranges.  Null is a value of ``by`` like others, and comes first.  Rows equal in
    ``order`` are put in any order.
    """
    keys = (F.col(by).asc_nulls_first(), *order)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = written(ranged.withColumn("row_", F.monotonically_increasing_id()), name)
    part = F.shiftright("row_", ROW_BITS).alias("part_")
    runs = marked.groupBy(by, part).agg(F.count("*").alias("k_"), F.min("row_").alias("first_"))
    own = Window.partitionBy(by)
    before = F.coalesce(F.sum("k_").over(own.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(by).alias("by_"), "part_", (before - F.col("first_")).alias("shift_"), F.sum("k_").over(own).alias("n"))
    same = F.col(by).eqNullSafe(F.col("by_")) & (F.shiftright("row_", ROW_BITS) == F.col("part_"))
    return marked.join(runs, same).select(*rows.columns, (F.col("row_") + F.col("shift_")).alias("pos"), "n")
