"""Windows of predictions, drift statistics, retraining triggers and operational figures.

Statistics are aggregates over whole tables; p-values are computed on the one row that
is left, in native expressions or a small function.  Every operator takes an explicit
``as_of`` instead of the clock.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.operators.matching import bounded

#: Seconds of the slices inside which predictions are numbered; ranges of values that K6 is dealt to.
SLICE, RANGES = 60, 64


def prediction_windows(log: DataFrame, seconds: int | None = 3600, n: int | None = None) -> DataFrame:
    """(by tenant) windows of a prediction log (event_id, ts, tenant, confidence, processing_ms).

    Time windows if ``seconds`` is given, else windows of n consecutive predictions.  Those
    are numbered inside short slices of time, from the totals of a tenant's slices before,
    so no task sorts a tenant's whole log.
    """
    if seconds:
        key = F.window("ts", f"{seconds} seconds")["start"]
    else:
        log = log.withColumn("_s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (SLICE * 1_000_000)))
        before = Window.partitionBy("tenant").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        sizes = log.groupBy("tenant", "_s").agg(F.count("*").alias("_n"))
        bases = sizes.select(F.col("tenant").alias("_t"), F.col("_s").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        w = Window.partitionBy("tenant", "_s").orderBy("ts", "event_id")
        log = log.withColumn("_i", F.row_number().over(w)).join(bases, F.col("tenant").eqNullSafe(F.col("_t")) & F.col("_s").eqNullSafe(F.col("_b")))
        key = F.floor((F.col("_base") + F.col("_i") - 1) / n)
    return log.groupBy("tenant", key.alias("win")).agg(
        F.count("*").alias("total"), F.min("ts").alias("first_ts"), F.avg("confidence").alias("avg_confidence"), F.avg("processing_ms").alias("avg_processing"),
    )


def numbered(windows: DataFrame) -> DataFrame:
    return windows.withColumn("k", F.row_number().over(Window.partitionBy("tenant").orderBy("win")))


def window_baseline(windows: DataFrame, n: int = 5) -> DataFrame:
    first = numbered(windows).where(F.col("k") <= n)
    return first.groupBy("tenant").agg(*[f(c).alias(f"{c}_{name}") for c in ("avg_confidence", "avg_processing") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def zscore_drift(windows: DataFrame, baseline: DataFrame, threshold: float = 0.05, n: int = 5) -> DataFrame:
    """(tenant, win, metric, score, severity): later windows against the baseline of the first."""
    rows = numbered(windows).where(F.col("k") > n).join(bounded(baseline), "tenant")
    z = lambda c: F.abs(F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + 1e-8)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), z(c).alias("score")) for c in ("avg_confidence", "avg_processing")])).alias("x")
    s = F.round("x.score", 6)
    grade = F.when(s > 3, "critical").when(s > 2, "high").when(s > 1, "medium").otherwise("low")
    return rows.select("tenant", "win", parts).where(s > threshold).select("tenant", "win", "x.metric", s.alias("score"), grade.alias("severity"))


def recent_windows_summary(windows: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("tenant").orderBy(F.desc("win"))
    rows = windows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return rows.groupBy("tenant").agg(F.sum("total").alias("total"), F.avg("avg_confidence").alias("mean_confidence"), F.stddev_pop("avg_confidence").alias("std_confidence"))


def t_and_p(spark_df: DataFrame) -> DataFrame:
    """Adds pooled t and its two-sided p to a row of n1, m1, v1, n2, m2, v2."""
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / n1 + 1 / n2))
    df = n1 + n2 - 2
    return spark_df.withColumn("t", t).withColumn("p", beta_p(df / (df + F.col("t") * F.col("t")), df / 2, F.lit(0.5)))


def beta_p(x: Column, a: Column, b: Column) -> Column:
    """Regularized incomplete beta function, by continued fraction, on few rows."""
    def one(x: float, a: float, b: float) -> float | None:
        if x is None or x != x:
            return None
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        if x > (a + 1) / (a + b + 2):
            return 1 - one(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if 1 - (a + b) * x / (a + 1) > 0 else 1e300
        out = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return front * out

    @F.pandas_udf("double")
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(*v) for v in zip(x, a, b, strict=True)], dtype="f8")

    return run(x, a.cast("double"), b.cast("double"))


def two_samples(rows: DataFrame, group: Column, value: str) -> DataFrame:
    """One row n1, m1, v1, n2, m2, v2 of the values where ``group`` is true and where not."""
    x = F.when(group, F.col(value))
    y = F.when(~group, F.col(value))
    return rows.agg(
        F.count(x).alias("n1"), F.avg(x).alias("m1"), F.var_samp(x).alias("v1"), F.count(y).alias("n2"), F.avg(y).alias("m2"), F.var_samp(y).alias("v2")
    )


def half_split_ttest(windows: DataFrame, metric: str = "avg_confidence") -> DataFrame:
    """Early against recent half of all windows, by time."""
    rows = windows.groupBy("win").agg(F.avg(metric).alias("x"))
    rows = rows.withColumn("half", F.ntile(2).over(Window.orderBy("win")))  # one row for each window of the whole log
    return t_and_p(two_samples(rows, F.col("half") == 1, "x"))


def mean_drift(baseline: DataFrame, current: DataFrame, col: str) -> DataFrame:
    rows = baseline.select(F.col(col).alias("x"), F.lit(True).alias("old")).unionByName(current.select(F.col(col).alias("x"), F.lit(False).alias("old")))
    return t_and_p(two_samples(rows, F.col("old"), "x"))


def variance_drift(baseline: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """f: the larger sample variance over the smaller, and p = 2 (1 - CDF), at most 1; no row if a variance is zero."""
    rows = baseline.select(F.col(col).alias("x"), F.lit(True).alias("old")).unionByName(current.select(F.col(col).alias("x"), F.lit(False).alias("old")))
    m = two_samples(rows, F.col("old"), "x").where("v1 > 0 AND v2 > 0")
    first = F.col("v1") >= F.col("v2")
    f = F.greatest("v1", "v2") / F.least("v1", "v2")
    d1, d2 = F.when(first, F.col("n1") - 1).otherwise(F.col("n2") - 1), F.when(first, F.col("n2") - 1).otherwise(F.col("n1") - 1)
    m = m.withColumn("f", f)
    return m.withColumn("p", F.least(F.lit(1.0), 2 * beta_p(d2 / (d2 + d1 * F.col("f")), d2 / 2, d1 / 2)))


def ks_drift(baseline: DataFrame, current: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """(statistic, p, drift): two-sample Kolmogorov-Smirnov, on distinct values with their counts.

    Running counts are kept by ranges of the value that hold about as many rows each: a
    range begins at the totals of those before it, so no task sees all values.
    """
    rows = baseline.select(F.col(col).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(F.col(col).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = rows.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    bounds = sorted(set(rows.agg(F.percentile_approx("x", shares, 10_000)).first()[0] or []))
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("x"))
    cut = per.withColumn("r", F.size(below) if bounds else F.lit(0))
    sums = cut.groupBy("r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = sums.select("r", F.coalesce(F.sum("ra").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("pb"), F.sum("ra").over(everything).alias("na"), F.sum("rb").over(everything).alias("nb"))
    upto = Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("pa") + F.sum("a").over(upto)) / F.col("na") - (F.col("pb") + F.sum("b").over(upto)) / F.col("nb"))
    d = cut.join(bases, "r").select(gap.alias("gap"), "na", "nb").agg(F.max("gap").alias("statistic"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    e = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("statistic")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * e * e) for k in range(1, 30)), F.lit(0.0))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return d.select("statistic", p.alias("p"), ((p < alpha) & (F.col("na") >= 10) & (F.col("nb") >= 10)).alias("drift"))


def confidence_drift(bins: DataFrame, recent: Column) -> DataFrame:
    """(statistic, mean_shift) of weighted histogram bins (x, n): recent ones against all."""
    tot = bins.groupBy("x").agg(F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("b"))
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # one row for each bin of a histogram
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(every) - F.sum("b").over(upto) / F.sum("b").over(every))
    rows = tot.select(gap.alias("gap"), "x", "a", "b")
    shift = F.abs(F.sum(F.col("x") * F.col("a")) / F.sum("a") - F.sum(F.col("x") * F.col("b")) / F.sum("b"))
    return rows.agg(F.max("gap").alias("statistic"), shift.alias("mean_shift"))


def decision_drift(log: DataFrame, recent: Column, kind: str, threshold: float = 0.15) -> DataFrame:
    """(distance, drift): L1 distance of the shares of ``kind`` in recent rows and in all."""
    per = log.groupBy(kind).agg(F.sum(recent.cast("long")).alias("a"), F.count("*").alias("b"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row for each kind
    gap = F.abs(F.col("a") / F.sum("a").over(every) - F.col("b") / F.sum("b").over(every))
    out = per.select(gap.alias("gap"), F.sum("a").over(every).alias("na"), F.sum("b").over(every).alias("nb"))
    out = out.agg(F.sum("gap").alias("distance"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return out.select("distance", ((F.round("distance", 9) > threshold) & (F.col("na") >= 100) & (F.col("nb") >= 100)).alias("drift"))


def performance_drift(performance: DataFrame, recent: Column, col: str = "f1", threshold: float = 0.05) -> DataFrame:
    rows = performance.groupBy("tenant").agg(F.avg(F.when(recent, F.col(col))).alias("now"), F.avg(col).alias("usual"))
    drop = F.round(F.col("usual") - F.col("now"), 9)
    grade = F.when(drop > 0.15, "critical").when(drop > 0.1, "high").when(drop > 0.075, "medium").otherwise("low")
    return rows.where(drop > threshold).select("tenant", drop.alias("drop"), grade.alias("severity"))


def drift_report(alerts: DataFrame) -> DataFrame:
    c = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(s)
    return alerts.groupBy("tenant").agg(F.count("*").alias("n_alerts"), *[c(s) for s in ("critical", "high", "medium", "low")])


def recent_alerts(alerts: DataFrame, hours: int, as_of: str) -> DataFrame:
    return alerts.where(F.col("win") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def retraining_triggers(report: DataFrame, feedback_counts: DataFrame) -> DataFrame:
    """(tenant, trigger) from alert counts and feedback of the last week."""
    rows = report.join(feedback_counts, "tenant", "full").fillna(0)
    t = F.when(F.col("critical") >= 1, "drift_detected").when(F.col("high") >= 3, "performance_degradation").when(F.col("n_feedback") >= 100, "feedback_threshold")
    return rows.select("tenant", t.alias("trigger")).where("trigger is not null")


def decision_kpis(decisions: DataFrame, dims: list[str], cube: bool = False) -> DataFrame:
    grouped = decisions.cube(*dims) if cube else decisions.groupBy(*dims)
    return grouped.agg(F.count("*").alias("n"))


def histograms(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """(by, le, n): cumulative counts, one conditional sum for each edge."""
    sums = df.groupBy(*by).agg(*[F.sum((F.col(value) <= e).cast("long")).alias(f"e{k}") for k, e in enumerate(edges)])
    parts = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"e{k}").alias("n")) for k, e in enumerate(edges)])).alias("x")
    return sums.select(*by, parts).select(*by, "x.le", "x.n")


def latency_percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.avg(value).alias("mean"))


def ranged_percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share, mean): exact percentiles, interpolated between neighbours, without a group's values in one task.

    Distinct values are counted, and running counts are kept by ranges of the value that hold
    about as many rows each, as in ``ks_drift``.
    """
    rows = df.where(F.col(value).isNotNull())
    per = rows.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    cuts = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    bounds = sorted(set(rows.agg(F.percentile_approx(value, cuts, 10_000)).first()[0] or []))
    cut = per.withColumn("r", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("x"))) if bounds else F.lit(0))
    sums = cut.groupBy(*by, "r").agg(F.sum("n").alias("rn"))
    own = Window.partitionBy(*by)
    bases = sums.select(*[F.col(c).alias(f"_{c}") for c in [*by, "r"]], F.coalesce(F.sum("rn").over(own.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("rn").over(own).alias("all"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "r"]]
    upto = F.sum("n").over(Window.partitionBy(*by, "r").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.join(bases, same).select(*by, "r", "x", "n", "base", "all").withColumn("first", F.col("base") + F.coalesce(upto, F.lit(0)))
    held = lambda rank: (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))
    at = {name: share * (F.col("all") - 1) for name, share in shares.items()}
    found = placed.groupBy(*by).agg(
        *[F.max(F.when(held(f(p)), F.col("x"))).alias(f"{name}_{k}") for name, p in at.items() for k, f in (("lo", F.floor), ("hi", F.ceil))],
        F.max("all").alias("all"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    between = lambda name, p: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (p - F.floor(p))
    return found.select(*by, *[between(name, p).alias(name) for name, p in at.items()], "mean")


def percentile_sketches(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, sketch, n, total): KLL sketches, which can be stored and merged over any coarser grouping."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"), F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))


def merged_percentiles(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share, mean, n) of sketches of finer groups; a quantile's rank is off by 1.7 % or less in 99 of 100 cases."""
    rows = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    return rows.select(*by, *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()], "mean", "n")


def precision_recall(predicted: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) from (predicted, label) as 0 or 1."""
    p, y = F.col("predicted") == 1, F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    rows = predicted.groupBy(*by).agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"))
    share = lambda a, b: F.coalesce(a / F.nullif(a + b, F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return rows.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def rate_limit_violations(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Events whose tenant offered more than ``limit`` in the trailing seconds, themselves included.

    A tenant's log is cut into slices as long as the limit's time; each event also stands
    in the next slice, where it is only counted.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = seconds * 1_000_000
    lags = F.when(F.col("ts").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = events.select("*", at.alias("_at"), F.explode(lags).alias("_lag")).withColumn("_s", F.floor(F.col("_at") / span) + F.col("_lag"))
    w = Window.partitionBy("tenant", "_s").orderBy("_at").rangeBetween(-span, 0)
    counted = rows.withColumn("offered", F.count("*").over(w)).where("_lag = 0")
    return counted.where(F.col("offered") > limit).drop("_at", "_lag", "_s")


def health_rollup(checks: DataFrame, degraded: int = 2, unhealthy: int = 3) -> DataFrame:
    """(component, status, failures in a row at the end, success rate) from (component, ts, check_id, ok)."""
    at = F.struct("ts", "check_id")
    last = checks.groupBy("component").agg(F.max(F.when(F.col("ok"), at)).alias("good"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.count("*").alias("n"))
    later = checks.where("NOT ok").join(bounded(last.select("component", "good")), "component").where(F.col("good").isNull() | (at > F.col("good")))
    tail = later.groupBy("component").agg(F.count("*").alias("failures"))
    out = last.join(tail, "component", "left").fillna(0, ["failures"])
    status = F.when(F.col("failures") >= unhealthy, "unhealthy").when(F.col("failures") >= degraded, "degraded").otherwise("healthy")
    return out.select("component", "failures", "success_rate", "n", status.alias("status"))


def error_rates(events: DataFrame, by: list[str], alert: float = 0.05) -> DataFrame:
    rows = events.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    share = F.round(F.col("errors") / F.col("n"), 6)
    return rows.select(*by, "n", "errors", share.alias("share"), (share > alert).alias("alert"))
