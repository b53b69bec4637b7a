"""What plan modules share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without one, a folder of this machine, which is set as such."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/textwarden")
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what names it several times computes it once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textwarden-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` dealt over all cores if its files make fewer tasks than there are cores.

    One file of one row group is one task, however costly the work on its rows is.  A
    large input has more splits than cores and is left as it is, without a shuffle.
    Without a key rows are dealt in turn: a union of tables that are each dealt by a key
    claims to be dealt by it as well (Spark 4.1.2), yet isn't, and a grouping by the key
    would then see a group in several tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def sql_text(value: object) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(rows, *names: str) -> str:
    """A SQL VALUES list as a derived table's body."""
    lines = ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows)
    return f"(VALUES {lines}) AS v({', '.join(names)})"
