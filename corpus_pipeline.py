"""From raw documents to token ids: quality, near-duplicates, contamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  Stages work on whole texts and on every document their
predecessor kept; rows whose text is null or empty stay until a stage rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import bpe, decontaminate, near_dedup, pii, quality
from textwarden.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose labelled neighbours are mostly poor."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.GOOD).select(*COLUMNS)


def row_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) of the distinct rows, with keys that rise with doc_id; null ids come last."""
    order = (F.col("doc_id").asc_nulls_last(), F.col("text").asc())
    ranged = docs.select("doc_id", "text").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "row_keys")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least doc_id of each class of near-duplicates (5 words, similarity 0.8).

    Where ids are null or repeated, rows are told apart by id and text together: each
    distinct text is a document of its own, whatever its id, and exact copies of a row
    are one.  Rows without words are linked with nothing and stay.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        classes = near_dedup.near_duplicates(docs, width=5, percent=80)
        return docs.join(classes.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    keys = row_keys(docs)
    classes = near_dedup.near_duplicates(keys.select(F.col("key").alias("doc_id"), "text"), width=5, percent=80)
    gone = written(keys.join(classes.where("not kept").select(F.col("doc_id").alias("key")), "key", "left_semi").select(F.col("doc_id").alias("i"), F.col("text").alias("t")), "gone")
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["i"]) & docs["text"].eqNullSafe(gone["t"]), "left_anti")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return kept.where(blank).unionByName(kept.where(~blank).dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item.

    A row goes by its own text: rows are told by id and text together, so one without
    an id goes too, and a clean row that shares an id stays.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    found = found.where("contaminated").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).distinct()
    rows = docs.withColumn("text_hash_", F.xxhash64("text"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["i"]) & rows["text_hash_"].eqNullSafe(found["h"]), "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the new text."""
    masked = pii.mask_pii(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: ids, their digest, and whether the text came back."""
    both = bpe.codec(docs.select("doc_id", "lang", "source", "text"), keep=("doc_id", "lang", "source", "text"))
    return both.select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", bpe_stage),
]
ORACLE_SQL = None  # a learned stage and BPE are beyond SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
