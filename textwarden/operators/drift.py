"""Drift by tenant as one table of alerts, the report on it, and the ledger of retraining jobs.

Alerts: (tenant, drift_type, metric, current, baseline, score, severity).  ``recent`` is a
condition on a log's rows; the baseline is all of them, the recent ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALERT = ("tenant", "drift_type", "metric", "current", "baseline", "score", "severity")
STATES = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "cancelled")}


def graded(score: Column, medium: float, high: float, critical: float) -> Column:
    return F.when(score > critical, "critical").when(score > high, "high").when(score > medium, "medium").otherwise("low")


def alerts_of(rows: DataFrame, kind: str, metric: str, score: Column, severity: Column, when: Column) -> DataFrame:
    out = rows.withColumn("score", F.round(score, 9)).where(when)
    return out.select("tenant", F.lit(kind).alias("drift_type"), F.lit(metric).alias("metric"), "current", "baseline", "score", severity.alias("severity"))


def confidence_alerts(log: DataFrame, recent: Column, bins: int = 5, alpha: float = 0.05) -> DataFrame:
    """Recent confidences against all, as histograms: two-sample Kolmogorov-Smirnov, graded by the shift of the means.

    A tenant's histogram has ``bins`` rows, whose midpoints stand for the values.
    """
    x = (F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)) + 0.5) / bins
    tot = log.groupBy("tenant", x.alias("x")).agg(F.sum(recent.cast("long")).alias("a"), F.count("*").alias("b"))
    own = Window.partitionBy("tenant")
    upto = own.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("a").over(upto) / F.nullif(F.sum("a").over(own), F.lit(0)) - F.sum("b").over(upto) / F.sum("b").over(own))
    mean = lambda n: F.sum(F.col("x") * F.col(n)) / F.nullif(F.sum(n), F.lit(0))
    rows = tot.withColumn("gap", gap).groupBy("tenant").agg(F.max("gap").alias("d"), F.sum("a").alias("na"), F.sum("b").alias("nb"), mean("a").alias("current"), mean("b").alias("baseline"))
    e = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("d")
    p = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * e * e) for k in range(1, 30)), F.lit(0.0))
    met = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) < alpha) & (F.col("na") >= 10) & (F.col("nb") >= 10)
    return alerts_of(rows, "prediction_drift", "confidence_distribution", F.abs(F.col("current") - F.col("baseline")), graded(F.col("score"), 0.1, 0.15, 0.2), met)


def decision_alerts(log: DataFrame, recent: Column, kind: str = "decision", threshold: float = 0.15, least: int = 100) -> DataFrame:
    """L1 distance of the shares of decisions, with at least so many decisions on either side."""
    per = log.groupBy("tenant", F.col(kind).alias("k")).agg(F.sum(recent.cast("long")).alias("a"), F.count("*").alias("b"))
    own = Window.partitionBy("tenant")
    gap = F.abs(F.col("a") / F.nullif(F.sum("a").over(own), F.lit(0)) - F.col("b") / F.sum("b").over(own))
    rows = per.withColumn("gap", gap).groupBy("tenant").agg(F.sum("gap").alias("current"), F.sum("a").alias("na"), F.sum("b").alias("nb")).withColumn("baseline", F.lit(0.0))
    met = (F.col("score") > threshold) & (F.col("na") >= least) & (F.col("nb") >= least)
    return alerts_of(rows, "prediction_drift", "decision_distribution", F.col("current"), graded(F.col("score"), 0.2, 0.25, 0.3), met)


def performance_alerts(performance: DataFrame, recent: Column, col: str = "f1", threshold: float = 0.05) -> DataFrame:
    rows = performance.groupBy("tenant").agg(F.avg(F.when(recent, F.col(col))).alias("current"), F.avg(col).alias("baseline"))
    return alerts_of(rows, "performance_drift", col, F.col("baseline") - F.col("current"), graded(F.col("score"), 0.075, 0.1, 0.15), F.col("score") > threshold)


def feedback_alerts(feedback: DataFrame, recent: Column, threshold: float = 0.2, least: int = 10) -> DataFrame:
    """Rise of the share of feedback (tenant, corrected) that corrects a decision."""
    c = F.col("corrected").cast("double")
    rows = feedback.groupBy("tenant").agg(F.avg(F.when(recent, c)).alias("current"), F.avg(c).alias("baseline"), F.sum(recent.cast("long")).alias("n"))
    met = (F.col("score") > threshold) & (F.col("n") >= least)
    return alerts_of(rows, "concept_drift", "feedback_correction_rate", F.col("current") - F.col("baseline"), graded(F.col("score"), 0.25, 0.3, 0.4), met)


def drift_report(alerts: DataFrame, history: DataFrame, recent: Column, least: tuple[int, int] = (5, 10)) -> DataFrame:
    """(tenant, status, n_alerts, critical, high, medium, low, recommendations) for each tenant of ``history`` (tenant, one row a measurement).

    With fewer than ``least`` recent or overall measurements there is no verdict, and no alert counts.
    """
    n = history.groupBy("tenant").agg(F.sum(recent.cast("long")).alias("n_recent"), F.count("*").alias("n_all"))
    count = lambda c: F.sum(c.cast("long"))
    is_ = lambda s, t=None: (F.col("severity") == s) & (F.col("drift_type") == t if t else F.lit(True))
    sums = alerts.groupBy("tenant").agg(
        F.count("*").alias("n_alerts"), *[count(is_(s)).alias(s) for s in ("critical", "high", "medium", "low")],
        count(is_("critical", "performance_drift")).alias("_p"), count(is_("high", "concept_drift")).alias("_c"), count(is_("high", "prediction_drift")).alias("_d"),
    )
    enough = (F.col("n_recent") >= least[0]) & (F.col("n_all") >= least[1])
    counts = ["n_alerts", "critical", "high", "medium", "low", "_p", "_c", "_d"]
    rows = n.join(sums, "tenant", "left").select("tenant", enough.alias("enough"), *[F.when(enough, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in counts])
    said = F.array_compact(F.array(
        F.when(F.col("critical") > 0, "Critical drift detected - immediate model retraining recommended"),
        F.when(F.col("_p") > 0, "Significant performance degradation - review training data quality"),
        F.when(F.col("_c") > 0, "Concept drift detected - update training data with recent examples"),
        F.when(F.col("_d") > 0, "Prediction patterns have changed - consider model recalibration"),
    ))
    none = F.array(F.lit("No significant drift detected - continue monitoring"))
    said = F.when(~F.col("enough"), F.array().cast("array<string>")).when(F.size(said) == 0, none).otherwise(said)
    return rows.select("tenant", F.when(F.col("enough"), "completed").otherwise("insufficient_data").alias("status"), *counts[:5], said.alias("recommendations"))


def new_jobs(report: DataFrame, feedback_counts: DataFrame, jobs: DataFrame, as_of: str, rest_days: int = 1, feedback: int = 100) -> DataFrame:
    """Jobs (job_id, tenant, trigger, status, created_at) that the report calls for.

    A tenant with an open job gets none, nor one whose last job began less than
    ``rest_days`` ago; a job's id follows from tenant, trigger and day, so a replay of a
    day finds the job there and emits no second one.
    """
    rows = report.where("status = 'completed'").join(feedback_counts.select("tenant", "n_feedback"), "tenant", "left").fillna(0, ["n_feedback"])
    trigger = F.when(F.col("critical") >= 1, "drift_detected").when(F.col("high") >= 3, "performance_degradation").when(F.col("n_feedback") >= feedback, "feedback_threshold")
    now = F.lit(as_of).cast("timestamp")
    busy = jobs.where(F.col("status").isin("pending", "running") | (F.col("created_at") > now - F.expr(f"INTERVAL {rest_days} DAYS"))).select("tenant").distinct()
    rows = rows.select("tenant", trigger.alias("trigger")).where("trigger is not null").join(busy, "tenant", "left_anti")
    job_id = F.substring(F.sha2(F.concat_ws("|", "tenant", "trigger", F.date_format(now, "yyyy-MM-dd")), 256), 1, 16)
    return rows.select(job_id.alias("job_id"), "tenant", "trigger", F.lit("pending").alias("status"), now.alias("created_at"))


def advanced_jobs(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs after reports (job_id, ts, state), taken in order of time; one that a job's state doesn't allow is passed over, as is a repeated one."""
    log = reports.groupBy("job_id").agg(F.array_sort(F.collect_set(F.struct("ts", "state"))).alias("log"))  # a job's few reports
    allowed = F.create_map(*[x for s, to in STATES.items() for x in (F.lit(s), F.array(*map(F.lit, to)))])
    step = lambda state, r: F.when(F.coalesce(F.array_contains(allowed[state], r["state"]), F.lit(False)), r["state"]).otherwise(state)
    rows = jobs.join(log, "job_id", "left")
    status = F.when(F.col("log").isNotNull(), F.aggregate("log", F.col("status"), step)).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*jobs.columns)


def retraining_status(jobs: DataFrame, most: int = 10) -> DataFrame:
    """(tenant, recent_jobs, total_jobs, pending_jobs, running_jobs) over each tenant's last ``most`` jobs, newest first."""
    order = Window.partitionBy("tenant").orderBy(F.desc("created_at"), "job_id")
    last = jobs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(f"{s}_jobs")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "job_id", "trigger", "status", "created_at"))), lambda x: F.struct(x["job_id"].alias("job_id"), x["trigger"].alias("trigger"), x["status"].alias("status"), x["created_at"].alias("created_at")))
    return last.groupBy("tenant").agg(listed.alias("recent_jobs"), F.count("*").alias("total_jobs"), n("pending"), n("running"))


def windows_by_key(log: DataFrame, win: Column, probabilities: str = "probabilities", language: str = "language") -> DataFrame:
    """(tenant, win, by_category, languages): mean probability by category and rows by language, as maps.

    A row's map is taken apart, sums are merged by key before anything is shuffled, and a
    window's few sums become a map again.
    """
    rows = log.withColumn("win", win)
    parts = rows.select("tenant", "win", F.explode(probabilities).alias("key", "p")).groupBy("tenant", "win", "key").agg(F.avg("p").alias("v"))
    counts = rows.groupBy("tenant", "win", F.col(language).alias("key")).agg(F.count("*").alias("v")).where("key is not null")
    map_of = lambda df, name: df.groupBy("tenant", "win").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias(name))
    return map_of(parts, "by_category").join(map_of(counts, "languages"), ["tenant", "win"], "full")


def category_baseline(windows: DataFrame, n: int = 5) -> DataFrame:
    """(tenant, category, mean, std): of the first n windows' means."""
    first = windows.withColumn("k", F.row_number().over(Window.partitionBy("tenant").orderBy("win"))).where(F.col("k") <= n)
    return first.select("tenant", F.explode("by_category").alias("category", "v")).groupBy("tenant", "category").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def category_drift(windows: DataFrame, baseline: DataFrame, threshold: float = 0.05, n: int = 5) -> DataFrame:
    """(tenant, win, category, score, severity): later windows' means against the baseline."""
    later = windows.withColumn("k", F.row_number().over(Window.partitionBy("tenant").orderBy("win"))).where(F.col("k") > n)
    rows = later.select("tenant", "win", F.explode("by_category").alias("category", "v")).join(baseline, ["tenant", "category"])
    s = F.round(F.abs(F.col("v") - F.col("mean")) / (F.col("std") + 1e-8), 6)
    return rows.select("tenant", "win", "category", s.alias("score"), graded(s, 1, 2, 3).alias("severity")).where(F.col("score") > threshold)
