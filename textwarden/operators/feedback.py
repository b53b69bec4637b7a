"""Feedback on decisions, the human review queue, and the analytics of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.constants import CATEGORIES, DECISIONS

PRIORITIES = ("low", "medium", "high", "critical")


def validate_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reasons)."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("final_label").isin(*DECISIONS), F.lit(False)), "final_label"),
            F.when(F.exists("actual_categories", lambda c: ~c.isin(*CATEGORIES)), "actual_categories"),
            F.when(F.coalesce(F.trim("request_id"), F.lit("")) == "", "request_id"),
        )
    )
    rows = feedback.withColumn("reasons", reasons)
    return rows.where("size(reasons) = 0").drop("reasons"), rows.where("size(reasons) > 0")


def correlate_feedback(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """Feedback with the decision it is about; unmatched rows keep nulls."""
    d = decisions.select("request_id", F.col("decision").alias("original_decision"), F.col("confidence").alias("confidence_score"))
    return feedback.join(d, "request_id", "left")


def within(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= end))


def correction():
    return ~F.col("final_label").eqNullSafe(F.col("original_decision"))


def feedback_analytics(feedback: DataFrame, days: int, as_of: str, by: list[str]) -> DataFrame:
    """(by, n, corrections, correction_rate, signed_confidence)."""
    rows = within(feedback, "ts", as_of, days)
    wrong = correction()
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("corrections"), F.avg(wrong.cast("double")).alias("correction_rate"),
        F.avg(F.when(wrong, -F.col("confidence_score")).otherwise(F.col("confidence_score"))).alias("signed_confidence"),
    )


def feedback_trend(feedback: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(day, n, corrections) of the last days, days without feedback included."""
    spark = feedback.sparkSession
    last = F.to_date(F.lit(as_of).cast("timestamp"))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    per = feedback.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(correction().cast("long")).alias("corrections"))
    return calendar.join(per, "day", "left").fillna(0, ["n", "corrections"])


def uncertainty_metrics(decisions: DataFrame) -> DataFrame:
    """Adds four rule-based uncertainties and their mean; decisions: decision, confidence, n_categories, language_confidence."""
    c = F.col("confidence")
    boundary = F.when((c >= 0.4) & (c <= 0.6), 0.8).when((c >= 0.3) & (c <= 0.7), 0.5).otherwise(0.2)
    category = F.when(F.col("n_categories") == 0, 0.6).when(F.col("n_categories") > 2, 0.7).otherwise(0.3)
    rows = (
        decisions.withColumn("confidence_uncertainty", 1 - c).withColumn("boundary_uncertainty", boundary)
        .withColumn("category_uncertainty", category).withColumn("language_uncertainty", 1 - F.col("language_confidence"))
    )
    parts = ("confidence_uncertainty", "boundary_uncertainty", "category_uncertainty", "language_uncertainty")
    return rows.withColumn("uncertainty", sum((F.col(p) for p in parts), F.lit(0.0)) / 4)


def select_for_review(decisions: DataFrame, conf: float = 0.7, unc: float = 0.3) -> DataFrame:
    c, d = F.col("confidence"), F.col("decision")
    u = F.round("uncertainty", 9)
    return decisions.where((c < conf) | (u > unc) | ((d == "block") & (c < 0.8)) | ((d == "review") & (F.col("n_categories") == 0)))


def review_priority(selected: DataFrame) -> DataFrame:
    """Adds ``priority`` and the status of a fresh queue item."""
    c, d, u = F.col("confidence"), F.col("decision"), F.round("uncertainty", 9)
    p = F.when((d == "block") & (c < 0.6), "critical").when(u > 0.7, "high").when((u > 0.4) | (d == "review"), "medium").otherwise("low")
    return selected.withColumn("priority", p).withColumn("status", F.lit("pending"))


def priority_rank():
    return F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))


def pending_reviews(items: DataFrame, limit: int = 50, priority: str | None = None) -> DataFrame:
    rows = items.where("status = 'pending'")
    rows = rows.where(F.col("priority") == priority) if priority else rows
    return rows.orderBy(priority_rank().desc(), "created_at", "review_id").limit(limit)


def apply_reviews(items: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, feedback): the latest update (review_id, ts, status, final_label) of each item, and a row for each completed one."""
    last = updates.groupBy("review_id").agg(F.max(F.struct("ts", "status", "final_label")).alias("u"))
    rows = items.join(last, "review_id", "left")
    out = rows.withColumn("status", F.coalesce("u.status", "status")).withColumn("reviewed_at", F.when(F.col("u.status") == "completed", F.col("u.ts")))
    feedback = out.where("u.status = 'completed'").select("review_id", "request_id", F.col("u.ts").alias("ts"), F.col("u.final_label").alias("final_label"))
    return out.drop("u"), feedback


def review_statistics(items: DataFrame) -> DataFrame:
    """(status, priority, n, avg_minutes) by status and by priority, as two grouping sets."""
    minutes = (F.unix_timestamp("reviewed_at") - F.unix_timestamp("created_at")) / 60.0
    return items.groupingSets([["status"], ["priority"]], "status", "priority").agg(F.count("*").alias("n"), F.avg(minutes).alias("avg_minutes"))


def queue_dashboard(items: DataFrame) -> DataFrame:
    c = lambda cond: F.sum(cond.cast("long"))
    return items.agg(
        F.count("*").alias("n_items"), c(F.col("status") == "pending").alias("n_pending"), c(F.col("status") == "completed").alias("n_completed"),
        *[c((F.col("status") == "pending") & (F.col("priority") == p)).alias(f"pending_{p}") for p in PRIORITIES],
    )
