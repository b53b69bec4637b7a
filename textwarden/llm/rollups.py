"""Token counts as delta-maintained rollups.

A change to the corpus is a batch of signed rows: +1 with its count for a document
that came, -1 for one that went, both for one whose count was revised.  A batch is
summed by source, language and tokenizer version before anything is shuffled, and its
sums are committed as one partition of a ledger.  A batch that is committed again
replaces its own partition, so retries and replays change nothing; a marker row lets a
batch that has become empty replace its old rows too.  Totals are the sums over the
ledger; they are additive, and ``compacted`` folds old batches into one and remembers
their numbers: what is committed again under such a number is skipped, and a number
never seen at or below the last folded one is refused.

A ledger is two tables in a folder: ``sums``, partitioned by batch, and ``folded``.

Defined results: a null text counts no token but is a document; null sources and
languages form groups of their own; repeated rows count as often as they occur; groups
whose documents and tokens cancel to nothing don't appear in totals; other columns
don't take part.  Empty tables give empty totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.bpe import VOCABULARY
from textwarden.llm.common import corpus, shared_dir, uncollected, written
from textwarden.llm.token_files import library_encoder

KEYS = ("source", "lang", "tokenizer")
COUNTED = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
LEDGER = "source string, lang string, tokenizer string, docs long, tokens long, batch_id long"
FOLDED = "batch_id long"
WORDS, BPE = "words-v1", "byte_bpe_50k-v1"


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) under both tokenizer versions."""
    where = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("long")
    def bpe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = library_encoder(where)
        for texts in batches:
            with uncollected():
                sizes = [len(one.encode(text)) // 4 for text in texts]
            yield pd.Series(sizes, dtype="i8")

    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    both = F.explode(F.map_from_arrays(F.array(F.lit(WORDS), F.lit(BPE)), F.array("words", "bpe"))).alias("tokenizer", "n_tokens")
    sized = docs.select(F.col("doc_id").cast("long"), "source", "lang", words.alias("words"), bpe(text).alias("bpe"))
    return sized.select("doc_id", "source", "lang", both)


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("sign"), "n_tokens")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that turn the counts ``before`` into those ``after``."""
    old = before.select("doc_id", *KEYS, "n_tokens", F.lit(-1).cast("long").alias("sign"))
    new = after.select("doc_id", *KEYS, "n_tokens", F.lit(1).cast("long").alias("sign"))
    net = old.unionByName(new).groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("sign"))
    return net.where("sign <> 0").select(*KEYS, "sign", "n_tokens")


def batch_sums(signed: DataFrame) -> DataFrame:
    """Sums of signed rows, by batch if they have a ``batch_id``."""
    by = [c for c in ("batch_id", *KEYS) if c in signed.columns]
    return signed.groupBy(*by).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))


def opened(spark: SparkSession, ledger: str) -> DataFrame:
    """The numbers of folded batches, each a row; makes the tables of a new ledger."""
    spark.createDataFrame([], FOLDED).write.mode("ignore").parquet(f"{ledger}/folded")
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("batch_id").parquet(f"{ledger}/sums")
    return spark.read.schema(FOLDED).parquet(f"{ledger}/folded")


def commit(signed: DataFrame, ledger: str, batches: list[int] | None = None) -> None:
    """Commits batches: rows (batch_id, source, lang, tokenizer, sign, n_tokens).

    Each batch_id is one partition of the ledger, replaced whole.  ``batches`` names
    the batches that are committed even if no row is left in them.
    """
    spark = signed.sparkSession
    folded = opened(spark, ledger)
    mark = folded.agg(F.max("batch_id")).first()[0]
    sums = batch_sums(signed).select("source", "lang", "tokenizer", "docs", "tokens", "batch_id")
    empty = spark.createDataFrame([(None, None, None, 0, 0, b) for b in batches or ()], LEDGER)
    rows = sums.unionByName(empty)
    if mark is not None:
        rows = rows.join(F.broadcast(folded.distinct().withColumn("done", F.lit(True))), "batch_id", "left").where("done is null")
        late = F.raise_error(F.concat(F.lit("batches are folded beyond number "), F.col("batch_id").cast("string"))).cast("long")
        rows = rows.withColumn("batch_id", F.when(F.col("batch_id") <= mark, late).otherwise(F.col("batch_id"))).drop("done")
    writer = rows.select("source", "lang", "tokenizer", "docs", "tokens", "batch_id").repartition("batch_id").write
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{ledger}/sums")


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
    rows = spark.read.schema(LEDGER).parquet(f"{ledger}/sums")
    out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    return out.where("n_docs <> 0 OR n_tokens <> 0")


def compacted(spark: SparkSession, ledger: str, into: str, upto: int) -> None:
    """Writes a ledger whose batches up to ``upto`` are one, under that number, and are closed."""
    rows = spark.read.schema(LEDGER).parquet(f"{ledger}/sums")
    old = rows.where(F.col("batch_id") <= upto)
    numbers = old.select("batch_id").unionByName(opened(spark, ledger)).unionByName(spark.createDataFrame([(upto,)], FOLDED))
    numbers.distinct().write.mode("overwrite").parquet(f"{into}/folded")
    sums = old.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    kept = sums.withColumn("batch_id", F.lit(upto).cast("long")).unionByName(rows.where(F.col("batch_id") > upto))
    kept.write.mode("overwrite").partitionBy("batch_id").parquet(f"{into}/sums")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all ``documents``, as a ledger arrives at them by inserts, revisions and deletes.

    Batches 1 to 4 insert every document, a third of them with an estimate for a count
    and a fifth of them twice; batch 5 revises the estimates to the counts, batch 6
    deletes the second copies.  Batch 2 is then committed again, batches 1 to 3 are
    folded, and batch 3 is committed once more; neither changes anything.
    """
    ledger = f"{shared_dir(spark)}/textwarden-{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex[:12]}"
    docs = corpus(spark, sf_dir, "documents")
    rest = lambda n: F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(0))
    exact = written(token_counts(docs).withColumn("batch_id", rest(4) + 1), "token_counts")
    estimated = exact.withColumn("n_tokens", F.when(rest(3) == 0, F.floor(F.col("n_tokens") / 10) * 10).otherwise(F.col("n_tokens")))
    signed = lambda df, sign: df.withColumn("sign", F.lit(sign).cast("long")).select(*KEYS, "sign", "n_tokens", F.col("batch_id").cast("long"))
    twice = exact.where(rest(5) == 0)
    loads = signed(estimated.unionByName(twice), 1)
    commit(loads, ledger)
    commit(changed(estimated, exact).withColumn("batch_id", F.lit(5).cast("long")), ledger, [5])
    commit(signed(twice.withColumn("batch_id", F.lit(6)), -1), ledger, [6])
    commit(loads.where("batch_id = 2"), ledger, [2])
    compacted(spark, ledger, f"{ledger}-folded", 3)
    commit(loads.where("batch_id = 3"), f"{ledger}-folded", [3])
    return totals(spark, f"{ledger}-folded")
