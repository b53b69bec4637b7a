"""Reading, validating, storing and purging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textwarden.constants import LANGUAGE_HINTS


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text", schema: str | None = None) -> DataFrame:
    """Rows of any file format as requests (request_id, tenant_id, text, language_hints)."""
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(path)
    pick = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    hints = F.col("language_hints") if "language_hints" in rows.columns else F.array(F.col("lang")) if "lang" in rows.columns else F.lit(None).cast("array<string>")
    return rows.select(F.col(id_col).cast("string").alias("request_id"), F.coalesce(pick("tenant_id", "string"), F.lit("default")).alias("tenant_id"), F.col(text_col).alias("text"), hints.alias("language_hints"))


def reasons_of(max_len: int) -> Column:
    text = F.coalesce(F.trim("text"), F.lit(""))
    return F.array_compact(
        F.array(
            F.when(text == "", "empty"), F.when(F.length(text) > max_len, "too_long"), F.when(~F.coalesce(F.col("tenant_id").rlike("^[a-zA-Z0-9_-]+$"), F.lit(False)), "tenant"),
            F.when(F.size(F.array_except(F.coalesce("language_hints", F.array().cast("array<string>")), F.array(*map(F.lit, LANGUAGE_HINTS)))) > 0, "language_hints"),
        )
    )


def validate_requests(requests: DataFrame, max_len: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(valid with stripped text, rejects with reasons)."""
    rows = requests.withColumn("reasons", reasons_of(max_len))
    valid = rows.where("size(reasons) = 0").withColumn("text", F.trim("text")).drop("reasons")
    return valid, rows.where("size(reasons) > 0").select("request_id", "reasons")


#: How much of the calendar a folder of audit files holds, and its name.
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def write_audit(audit: DataFrame, path: str, period: str = "day") -> None:
    """Appends audit envelopes as JSON lines, one folder for each day, month or year; a path keeps to one of them.

    A folder and a file cost the file system the same for one line as for a million, so days of a few entries
    each go by month or year; a day's lines then lie together.  Rows of one folder are gathered first, or
    each task would write a file of its own for it; a folder of more than one task's share is several files.
    """
    by, rows = ("event_date", audit) if period == "day" else ("event_period", audit.withColumn("event_period", F.date_format("event_date", PERIODS[period])))
    rows.hint("rebalance", by).sortWithinPartitions(*dict.fromkeys((by, "event_date"))).write.mode("append").partitionBy(by).json(path)


def read_audit(spark: SparkSession, path: str, schema: StructType, day: str | None = None) -> DataFrame:
    """Audit envelopes of all days, or of one; for one day, no other folder of dated entries is read."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("event_period", StringType())])).json(path)
    if day:
        rows = rows.where(F.coalesce(F.lit(day).startswith(F.col("event_period")), F.lit(True))).where(F.col("event_date") == F.lit(day).cast("date"))
    return rows.drop("event_period")


def find_decision(audit: DataFrame, request_id: str, date: str | None = None) -> DataFrame:
    rows = audit.where(F.col("event_date") == F.lit(date).cast("date")) if date else audit
    return rows.where((F.col("event_type") == "policy_decision") & (F.col("details.request_id") == request_id))


def write_table(df: DataFrame, path: str, partition_by: list[str], mode: str = "append") -> None:
    """Stores rows; in overwrite mode only the partitions that the rows belong to are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def purge_expired(df: DataFrame, ts_col: str, retention_days: int, as_of: str) -> DataFrame:
    """What stays: rows not older than the retention at ``as_of``."""
    return df.where(F.col(ts_col) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {retention_days} DAYS"))


def scan_feedback(feedback: DataFrame, tenant: str | None = None, start: str | None = None, end: str | None = None, limit: int = 1000) -> DataFrame:
    """The newest rows of a tenant and period."""
    rows = feedback.where(F.col("tenant") == tenant) if tenant else feedback
    rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else rows
    rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp")) if end else rows
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
