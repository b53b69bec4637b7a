"""Queries of sources, monitoring, drift and operational figures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textwarden import sources
from textwarden.operators import drift, matching, monitoring
from textwarden.plans.common import shared_folder, table
from textwarden.plans.decision_queries import rounded
from textwarden.plans.match_queries import SCORES, docs, terms
from textwarden.plans.policy_queries import AUDIT, BASE, FLAGS, audit, base

Q: dict = {}


def log(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "ts", "event_type", "value", F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant"), (F.col("value") / 500).alias("confidence"), (F.col("value") * 2).alias("processing_ms"))


LOG = "lg AS (SELECT event_id, ts, event_type, value, 't' || (user_id % 5) AS tenant, value / 500 AS confidence, value * 2 AS processing_ms FROM events)"
WIN = f"{LOG}, win AS (SELECT tenant, time_bucket(INTERVAL 1 DAY, ts) AS win, count(*) AS total, avg(confidence) AS c, avg(processing_ms) AS m FROM lg GROUP BY ALL)"
windows = lambda s, d: monitoring.prediction_windows(log(s, d), 86400)

Q["a1_read_corpus"] = (
    lambda s, d: sources.read_corpus(s, f"{d}/documents.parquet").select("request_id", "tenant_id", F.length("text").alias("n"), F.array_join("language_hints", ",").alias("hints")),
    "SELECT doc_id::VARCHAR AS request_id, 'default' AS tenant_id, length(text)::INTEGER AS n, lang AS hints FROM documents",
)
Q["a2_validate_requests"] = (
    lambda s, d: sources.validate_requests(sources.read_corpus(s, f"{d}/documents.parquet"))[1].select("request_id", F.array_join("reasons", ",").alias("reasons")),
    """SELECT doc_id::VARCHAR AS request_id, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(trim(text)) > 10000 THEN 'too_long' END, CASE WHEN lang NOT IN ('en', 'hi', 'hi-Latn', 'bn', 'te', 'ta', 'mr', 'gu', 'kn', 'ml', 'pa', 'or') THEN 'language_hints' END) AS reasons
FROM documents WHERE trim(text) = '' OR length(trim(text)) > 10000 OR lang NOT IN ('en', 'hi', 'hi-Latn', 'bn', 'te', 'ta', 'mr', 'gu', 'kn', 'ml', 'pa', 'or')""",
)


def shared(s):
    return shared_folder(s)


def a6(s, d):
    path = f"{shared(s)}/textwarden-{s.sparkContext.applicationId}/audit-{uuid.uuid4().hex[:12]}"
    rows = audit(s, d)
    sources.write_audit(rows, path, "month")  # the entries are an hour apart, so days are small
    return sources.read_audit(s, path, rows.schema).select("entry_id", F.col("event_date").cast("string").alias("event_date"), F.array_join("compliance_flags", ",").alias("flags"))


Q["a6_audit_round_trip"] = (a6, f"WITH {AUDIT} SELECT 'dec-' || doc_id AS entry_id, ts::DATE::VARCHAR AS event_date, {FLAGS} AS flags FROM audit")
Q["a7_find_decision"] = (
    lambda s, d: sources.find_decision(audit(s, d), "28").select("entry_id", F.col("details.final_decision").alias("final_decision")),
    f"WITH {AUDIT} SELECT 'dec-' || doc_id AS entry_id, policy_decision AS final_decision FROM audit WHERE doc_id = 28",
)


def a8(s, d):
    path = f"{shared(s)}/textwarden-{s.sparkContext.applicationId}/table-{uuid.uuid4().hex[:12]}"
    rows = log(s, d).withColumn("day", F.to_date("ts").cast("string"))
    sources.write_table(rows, path, ["day"])
    sources.write_table(rows.where("day = '2024-01-05'"), path, ["day"], "overwrite")
    return sources.read_table(s, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


Q["a8_store_tables"] = (a8, f"WITH {LOG} SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM lg GROUP BY 1")
Q["a9_purge_expired"] = (
    lambda s, d: sources.purge_expired(log(s, d), "ts", 10, "2024-01-31 00:00:00").select("event_id"),
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY",
)
Q["a10_scan_feedback"] = (
    lambda s, d: sources.scan_feedback(log(s, d), "t2", "2024-01-10 00:00:00", "2024-01-20 00:00:00", 100).select("event_id", "tenant"),
    f"WITH {LOG} SELECT event_id, tenant FROM lg WHERE tenant = 't2' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100",
)
Q["k1_prediction_windows"] = (
    lambda s, d: rounded(monitoring.prediction_windows(log(s, d), 3600).drop("first_ts"), "avg_confidence", "avg_processing"),
    f"WITH {LOG} SELECT tenant, time_bucket(INTERVAL 1 HOUR, ts) AS win, count(*) AS total, round(avg(confidence), 6) AS avg_confidence, round(avg(processing_ms), 6) AS avg_processing FROM lg GROUP BY ALL",
)
Q["k1_count_windows"] = (
    lambda s, d: rounded(monitoring.prediction_windows(log(s, d), None, 100).drop("first_ts"), "avg_confidence", "avg_processing"),
    f"WITH {LOG} SELECT tenant, k AS win, count(*) AS total, round(avg(confidence), 6) AS avg_confidence, round(avg(processing_ms), 6) AS avg_processing FROM (SELECT *, (row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) - 1) // 100 AS k FROM lg) GROUP BY tenant, k",
)
BASELINE = f"""{WIN}, num AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY win) AS k FROM win),
bl AS (SELECT tenant, avg(c) AS cm, stddev_pop(c) AS cs, avg(m) AS mm, stddev_pop(m) AS ms FROM num WHERE k <= 5 GROUP BY tenant),
z AS (SELECT tenant, win, unnest(['avg_confidence', 'avg_processing']) AS metric, round(unnest([abs(c - cm) / (cs + 1e-8), abs(m - mm) / (ms + 1e-8)]), 6) AS score FROM num JOIN bl USING (tenant) WHERE k > 5),
alerts AS (SELECT *, CASE WHEN score > 3 THEN 'critical' WHEN score > 2 THEN 'high' WHEN score > 1 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE score > 0.05)"""
Q["k2_window_baseline"] = (
    lambda s, d: rounded(monitoring.window_baseline(windows(s, d)), *[f"{c}_{x}" for c in ("avg_confidence", "avg_processing") for x in ("mean", "std")]),
    f"WITH {BASELINE} SELECT tenant, round(cm, 6) AS avg_confidence_mean, round(cs, 6) AS avg_confidence_std, round(mm, 6) AS avg_processing_mean, round(ms, 6) AS avg_processing_std FROM bl",
)
alerts = lambda s, d: monitoring.zscore_drift(windows(s, d), monitoring.window_baseline(windows(s, d)))
Q["k3_zscore_drift"] = (alerts, f"WITH {BASELINE} SELECT tenant, win, metric, score, severity FROM alerts")
Q["k4_recent_windows_summary"] = (
    lambda s, d: rounded(monitoring.recent_windows_summary(windows(s, d)), "mean_confidence", "std_confidence"),
    f"WITH {WIN} SELECT tenant, sum(total)::BIGINT AS total, round(avg(c), 6) AS mean_confidence, round(stddev_pop(c), 6) AS std_confidence FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY win DESC) AS k FROM win) WHERE k <= 10 GROUP BY tenant",
)
TT = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))"
TWO = "count(x) FILTER (g) AS n1, avg(x) FILTER (g) AS m1, var_samp(x) FILTER (g) AS v1, count(x) FILTER (NOT g) AS n2, avg(x) FILTER (NOT g) AS m2, var_samp(x) FILTER (NOT g) AS v2"
Q["k5_half_split_ttest"] = (
    lambda s, d: monitoring.half_split_ttest(windows(s, d)).select(F.round("t", 5).alias("t")),
    f"WITH {WIN}, h AS (SELECT win, avg(c) AS x, ntile(2) OVER (ORDER BY win) = 1 AS g FROM win GROUP BY win), two AS (SELECT {TWO} FROM h) SELECT round({TT}, 5) AS t FROM two",
)
old = lambda s, d: log(s, d).where("ts < timestamp '2024-01-15 00:00:00'")
new = lambda s, d: log(s, d).where("ts >= timestamp '2024-01-15 00:00:00'")
SPLIT = f"{LOG}, sp AS (SELECT value AS x, ts < TIMESTAMP '2024-01-15' AS g FROM lg), two AS (SELECT {TWO} FROM sp)"
Q["k6_ks_drift"] = (
    lambda s, d: rounded(monitoring.ks_drift(old(s, d), new(s, d), "value").select("statistic"), "statistic"),
    f"""WITH {SPLIT}, v AS (SELECT x, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM sp GROUP BY x)
SELECT round(max(abs(fa - fb)), 6) AS statistic FROM (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM v WINDOW w AS (ORDER BY x))""",
)
Q["k7_mean_drift"] = (lambda s, d: rounded(monitoring.mean_drift(old(s, d), new(s, d), "value").select("t"), "t"), f"WITH {SPLIT} SELECT round({TT}, 6) AS t FROM two")
Q["k8_variance_drift"] = (
    lambda s, d: rounded(monitoring.variance_drift(old(s, d), new(s, d), "value").select("f"), "f"),
    f"WITH {SPLIT} SELECT round(greatest(v1, v2) / least(v1, v2), 6) AS f FROM two",
)


def late():
    return F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp")


BINS = f"{LOG}, bins AS (SELECT floor(confidence * 10) / 10 + 0.05 AS x, ts >= TIMESTAMP '2024-01-24' AS recent FROM lg)"
Q["k9_confidence_drift"] = (
    lambda s, d: rounded(monitoring.confidence_drift(log(s, d).select((F.floor(F.col("confidence") * 10) / 10 + 0.05).alias("x"), late().alias("recent"), F.lit(1).alias("n")), F.col("recent")), "statistic", "mean_shift"),
    f"""WITH {BINS}, v AS (SELECT x, count(*) FILTER (recent) AS a, count(*) AS b FROM bins GROUP BY x),
g AS (SELECT x, a, b, abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap FROM v WINDOW w AS (ORDER BY x))
SELECT round(max(gap), 6) AS statistic, round(abs(sum(x * a) / sum(a) - sum(x * b) / sum(b)), 6) AS mean_shift FROM g""",
)
Q["k10_decision_drift"] = (
    lambda s, d: rounded(monitoring.decision_drift(log(s, d), late(), "event_type"), "distance"),
    f"""WITH {LOG}, v AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS a, count(*) AS b FROM lg GROUP BY 1),
t AS (SELECT sum(abs(a / ta - b / tb)) AS distance, max(ta) AS ta, max(tb) AS tb FROM (SELECT a, b, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v))
SELECT round(distance, 6) AS distance, round(distance, 9) > 0.15 AND ta >= 100 AND tb >= 100 AS drift FROM t""",
)
Q["k11_performance_drift"] = (
    lambda s, d: rounded(monitoring.performance_drift(log(s, d).withColumn("f1", (F.col("event_type") == "view").cast("double")), late(), threshold=0.001), "drop"),
    f"""WITH {LOG}, p AS (SELECT tenant, avg((event_type = 'view')::INT) FILTER (ts >= TIMESTAMP '2024-01-24') AS now, avg((event_type = 'view')::INT) AS usual FROM lg GROUP BY tenant)
SELECT tenant, round(usual - now, 6) AS drop, CASE WHEN round(usual - now, 9) > 0.15 THEN 'critical' WHEN round(usual - now, 9) > 0.1 THEN 'high' WHEN round(usual - now, 9) > 0.075 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE round(usual - now, 9) > 0.001""",
)
Q["k12_feedback_drift"] = (
    lambda s, d: rounded(log(s, d).groupBy("tenant").agg((F.avg(F.when(late(), (F.col("event_type") == "error").cast("double"))) - F.avg((F.col("event_type") == "error").cast("double"))).alias("rise")), "rise"),
    f"WITH {LOG} SELECT tenant, round(avg((event_type = 'error')::INT) FILTER (ts >= TIMESTAMP '2024-01-24') - avg((event_type = 'error')::INT), 6) AS rise FROM lg GROUP BY tenant",
)
SEV = ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ("critical", "high", "medium", "low"))
Q["k13_drift_report"] = (lambda s, d: monitoring.drift_report(alerts(s, d)), f"WITH {BASELINE} SELECT tenant, count(*) AS n_alerts, {SEV} FROM alerts GROUP BY tenant")
Q["k14_recent_alerts"] = (
    lambda s, d: monitoring.recent_alerts(alerts(s, d), 72, "2024-01-31 00:00:00"),
    f"WITH {BASELINE} SELECT tenant, win, metric, score, severity FROM alerts WHERE win >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR",
)
fed = lambda s, d: log(s, d).where("event_type = 'click'").groupBy("tenant").agg(F.count("*").alias("n_feedback"))
TRIG = f"""{BASELINE}, rep AS (SELECT tenant, {SEV} FROM alerts GROUP BY tenant), fed AS (SELECT tenant, count(*) AS n FROM lg WHERE event_type = 'click' GROUP BY tenant),
trig AS (SELECT coalesce(rep.tenant, fed.tenant) AS tenant, CASE WHEN coalesce(critical, 0) >= 1 THEN 'drift_detected' WHEN coalesce(high, 0) >= 3 THEN 'performance_degradation' WHEN coalesce(n, 0) >= 100 THEN 'feedback_threshold' END AS trigger FROM rep FULL JOIN fed USING (tenant))"""
jobs = lambda s, d: monitoring.retraining_triggers(monitoring.drift_report(alerts(s, d)), fed(s, d))
Q["k15_retraining_triggers"] = (jobs, f"WITH {TRIG} SELECT tenant, trigger FROM trig WHERE trigger IS NOT NULL")
Q["k16_retraining_status"] = (lambda s, d: jobs(s, d).groupBy("trigger").agg(F.count("*").alias("n")), f"WITH {TRIG} SELECT trigger, count(*) AS n FROM trig WHERE trigger IS NOT NULL GROUP BY trigger")


def spoken(s, d):
    return base(s, d).join(docs(s, d).select("doc_id", "lang"), "doc_id").select("decision", "lang", "tenant")


Q["k17_decision_kpis"] = (lambda s, d: monitoring.decision_kpis(spoken(s, d), ["decision", "lang", "tenant"], cube=True), f"WITH {BASE} SELECT decision, lang, tenant, count(*) AS n FROM base JOIN documents USING (doc_id) GROUP BY CUBE (decision, lang, tenant)")
EDGES = [10.0, 25.0, 50.0, 100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0]
Q["k18_histograms"] = (
    lambda s, d: monitoring.histograms(log(s, d), "value", EDGES, ["event_type"]),
    "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES " + ", ".join(f"({e}::DOUBLE)" for e in EDGES) + ") v(le) GROUP BY ALL",
)
Q["k19_latency_percentiles"] = (
    lambda s, d: rounded(monitoring.latency_percentiles(log(s, d), "value", ["event_type"]), "p50", "p95", "mean"),
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1",
)


Q["k19_ranged_percentiles"] = (
    lambda s, d: rounded(monitoring.ranged_percentiles(log(s, d), "value", ["event_type"], {"p50": 0.5, "p95": 0.95}), "p50", "p95", "mean"),
    Q["k19_latency_percentiles"][1],
)


def judged(s, d):
    hit = terms(s, d).where("category = 'insult/harassment'").select("doc_id").distinct().withColumn("predicted", F.lit(1))
    rows = table(s, d, "labels").select("doc_id", F.col("toxic").alias("label")).join(docs(s, d).select("doc_id", "lang"), "doc_id").join(hit, "doc_id", "left")
    return rows.fillna(0, ["predicted"])


PR = f"""{SCORES}, j AS (SELECT lang, toxic = 1 AS y, doc_id IN (SELECT doc_id FROM scores WHERE category = 'insult/harassment') AS p FROM labels JOIN documents USING (doc_id)),
n AS (SELECT lang, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM j GROUP BY lang),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM n)"""
Q["k20_precision_recall"] = (
    lambda s, d: rounded(monitoring.precision_recall(judged(s, d), ["lang"]), "precision", "recall", "f1"),
    f"WITH {PR} SELECT lang, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM pr",
)


def k21(s, d):
    path = f"{shared(s)}/textwarden-{s.sparkContext.applicationId}/performance-{uuid.uuid4().hex[:12]}"
    rows = log(s, d).groupBy("tenant", F.to_date("ts").alias("day")).agg(F.avg((F.col("event_type") != "error").cast("double")).alias("accuracy"))
    rows.write.mode("append").parquet(path)
    return rounded(s.read.schema(rows.schema).parquet(path).where("day >= date '2024-01-24'").withColumn("day", F.col("day").cast("string")), "accuracy")


Q["k21_performance_history"] = (k21, f"WITH {LOG} SELECT tenant, ts::DATE::VARCHAR AS day, round(avg((event_type <> 'error')::INT), 6) AS accuracy FROM lg WHERE ts::DATE >= DATE '2024-01-24' GROUP BY ALL")
Q["k22_rate_limit_violations"] = (
    lambda s, d: monitoring.rate_limit_violations(log(s, d), 3, 1800).select("event_id", "tenant", "offered"),
    f"WITH {LOG} SELECT event_id, tenant, offered FROM (SELECT *, count(*) OVER (PARTITION BY tenant ORDER BY epoch_us(ts) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS offered FROM lg) WHERE offered > 3",
)


def checks(s, d):
    return log(s, d).select(F.col("tenant").alias("component"), "ts", F.col("event_id").alias("check_id"), (F.col("event_type") != "error").alias("ok"))


Q["k23_health_rollup"] = (
    lambda s, d: rounded(monitoring.health_rollup(checks(s, d)), "success_rate"),
    f"""WITH {LOG}, r AS (SELECT tenant AS component, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, event_id DESC) AS k FROM lg),
f AS (SELECT component, coalesce(min(k) FILTER (ok) - 1, count(*)) AS failures, round(avg(ok::INT), 6) AS success_rate, count(*) AS n FROM r GROUP BY component)
SELECT component, failures, success_rate, n, CASE WHEN failures >= 3 THEN 'unhealthy' WHEN failures >= 2 THEN 'degraded' ELSE 'healthy' END AS status FROM f""",
)
Q["k24_error_rates"] = (
    lambda s, d: monitoring.error_rates(log(s, d), ["tenant"]),
    f"WITH {LOG}, e AS (SELECT tenant, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM lg GROUP BY tenant) SELECT tenant, n, errors, round(errors / n, 6) AS share, round(errors / n, 6) > 0.05 AS alert FROM e",
)
GRADE = "CASE WHEN score > {2} THEN 'critical' WHEN score > {1} THEN 'high' WHEN score > {0} THEN 'medium' ELSE 'low' END"
RECENT = "ts >= TIMESTAMP '2024-01-24'"
#: By tenant, with thresholds low enough for the log of the tables to have alerts of every kind.
EVERY_ALERT = f"""{LOG},
cb AS (SELECT tenant, (least(floor(confidence * 5), 4) + 0.5) / 5 AS x, count(*) FILTER ({RECENT}) AS a, count(*) AS b FROM lg GROUP BY ALL),
cg AS (SELECT *, abs(sum(a) OVER w / nullif(sum(a) OVER t, 0) - sum(b) OVER w / sum(b) OVER t) AS gap FROM cb WINDOW w AS (PARTITION BY tenant ORDER BY x ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY tenant)),
cs AS (SELECT tenant, sum(x * a) / nullif(sum(a), 0) AS current, sum(x * b) / sum(b) AS baseline, sqrt(sum(a) * sum(b) / (sum(a) + sum(b))) * max(gap) AS e, sum(a) AS na, sum(b) AS nb FROM cg GROUP BY tenant),
c1 AS (SELECT *, round(abs(current - baseline), 9) AS score FROM cs WHERE na >= 10 AND nb >= 10 AND greatest(0, least(1, list_sum(list_transform(range(1, 30), lambda k: 2.0 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * e * e))))) < 0.9),
dk AS (SELECT tenant, event_type, count(*) FILTER ({RECENT}) AS a, count(*) AS b FROM lg GROUP BY ALL),
dg AS (SELECT *, abs(a / nullif(sum(a) OVER t, 0) - b / sum(b) OVER t) AS gap FROM dk WINDOW t AS (PARTITION BY tenant)),
d1 AS (SELECT tenant, sum(gap) AS current, 0.0::DOUBLE AS baseline, round(sum(gap), 9) AS score FROM dg GROUP BY tenant HAVING round(sum(gap), 9) > 0.01 AND sum(a) >= 10 AND sum(b) >= 10),
p1 AS (SELECT *, round(baseline - current, 9) AS score FROM (SELECT tenant, avg((event_type = 'view')::INT) FILTER ({RECENT}) AS current, avg((event_type = 'view')::INT) AS baseline FROM lg GROUP BY tenant) WHERE round(baseline - current, 9) > 0.001),
f1 AS (SELECT * EXCLUDE (n), round(current - baseline, 9) AS score FROM (SELECT tenant, avg((event_type = 'error')::INT) FILTER ({RECENT}) AS current, avg((event_type = 'error')::INT) AS baseline, count(*) FILTER ({RECENT}) AS n FROM lg GROUP BY tenant) WHERE n >= 10 AND round(current - baseline, 9) > 0.001),
every AS (SELECT tenant, 'prediction_drift' AS drift_type, 'confidence_distribution' AS metric, current, baseline, score, {GRADE.format(0.1, 0.15, 0.2)} AS severity FROM c1
  UNION ALL SELECT tenant, 'prediction_drift', 'decision_distribution', current, baseline, score, {GRADE.format(0.2, 0.25, 0.3)} FROM d1
  UNION ALL SELECT tenant, 'performance_drift', 'f1', current, baseline, score, {GRADE.format(0.075, 0.1, 0.15)} FROM p1
  UNION ALL SELECT tenant, 'concept_drift', 'feedback_correction_rate', current, baseline, score, {GRADE.format(0.25, 0.3, 0.4)} FROM f1)"""


def every_alert(s, d):
    rows = log(s, d)
    of = rows.withColumn("f1", (F.col("event_type") == "view").cast("double")).withColumn("corrected", F.col("event_type") == "error")
    found = [drift.confidence_alerts(rows, late(), alpha=0.9), drift.decision_alerts(rows, late(), "event_type", 0.01, 10), drift.performance_alerts(of, late(), threshold=0.001), drift.feedback_alerts(of, late(), 0.001)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


Q["k13_every_alert"] = (lambda s, d: rounded(every_alert(s, d), "current", "baseline", "score"), f"WITH {EVERY_ALERT} SELECT tenant, drift_type, metric, round(current, 6) AS current, round(baseline, 6) AS baseline, round(score, 6) AS score, severity FROM every")
REPORT = f"""{EVERY_ALERT}, report AS (SELECT tenant, CASE WHEN n_recent >= 5 AND n_all >= 10 THEN 'completed' ELSE 'insufficient_data' END AS status, coalesce(n_alerts, 0) AS n_alerts, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
  FROM (SELECT tenant, count(*) FILTER ({RECENT}) AS n_recent, count(*) AS n_all FROM lg GROUP BY tenant) LEFT JOIN (SELECT tenant, count(*) AS n_alerts, {SEV} FROM every GROUP BY tenant) USING (tenant))"""
report = lambda s, d: drift.drift_report(every_alert(s, d), log(s, d), late())
Q["k13_full_report"] = (
    lambda s, d: report(s, d).select("tenant", "status", "n_alerts", "critical", "high", "medium", "low"),
    f"WITH {REPORT} SELECT * FROM report",
)


def ledger(s, d):
    """Jobs so far: those that errors of the log called for, by tenant and day, moved on by what clicks report."""
    e = log(s, d).where("event_type = 'error'").groupBy("tenant", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    job = F.concat_ws("-", "tenant", F.col("day").cast("string"))
    jobs_ = e.select(job.alias("job_id"), "tenant", F.lit("drift_detected").alias("trigger"), F.lit("pending").alias("status"), F.col("day").cast("timestamp").alias("created_at"))
    state = F.when(F.col("value") < 100, "running").when(F.col("value") < 300, "completed").otherwise("failed")
    told = log(s, d).where("event_type = 'click'").select(F.concat_ws("-", "tenant", F.to_date("ts").cast("string")).alias("job_id"), "ts", state.alias("state"))
    return drift.advanced_jobs(jobs_, told)


FOLD = "list_reduce(list_prepend(['pending'], list_transform(l, lambda x: [x.state])), lambda a, x: CASE WHEN a[1] = 'pending' AND x[1] = 'running' THEN x WHEN a[1] = 'running' AND x[1] IN ('completed', 'failed') THEN x ELSE a END)[1]"
LEDGER = f"""{LOG}, told AS (SELECT tenant || '-' || ts::DATE::VARCHAR AS job_id, list_sort(list(DISTINCT {{'ts': ts, 'state': CASE WHEN value < 100 THEN 'running' WHEN value < 300 THEN 'completed' ELSE 'failed' END}})) AS l FROM lg WHERE event_type = 'click' GROUP BY 1),
jobs AS (SELECT job_id, tenant, created_at, CASE WHEN l IS NULL THEN 'pending' ELSE {FOLD} END AS status FROM (SELECT DISTINCT tenant || '-' || ts::DATE::VARCHAR AS job_id, tenant, ts::DATE AS created_at FROM lg WHERE event_type = 'error') LEFT JOIN told USING (job_id))"""
Q["k15_job_ledger"] = (lambda s, d: ledger(s, d).select("job_id", "tenant", "status"), f"WITH {LEDGER} SELECT job_id, tenant, status FROM jobs")
Q["k15_new_jobs"] = (
    lambda s, d: drift.new_jobs(report(s, d), fed(s, d), ledger(s, d).where("created_at < timestamp '2024-01-20 00:00:00' and status in ('completed', 'failed')"), "2024-01-31 00:00:00", feedback=20).select("tenant", "trigger", "status"),
    f"""WITH {REPORT}, fed AS (SELECT tenant, count(*) AS n FROM lg WHERE event_type = 'click' GROUP BY tenant), t AS (SELECT tenant, CASE WHEN critical >= 1 THEN 'drift_detected' WHEN high >= 3 THEN 'performance_degradation' WHEN coalesce(n, 0) >= 20 THEN 'feedback_threshold' END AS trigger FROM report LEFT JOIN fed USING (tenant) WHERE status = 'completed')
SELECT tenant, trigger, 'pending' AS status FROM t WHERE trigger IS NOT NULL""",
)
Q["k16_job_status"] = (
    lambda s, d: drift.retraining_status(ledger(s, d)).select("tenant", F.array_join(F.col("recent_jobs.job_id"), ",").alias("jobs"), "total_jobs", "pending_jobs", "running_jobs"),
    f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, job_id) AS k FROM jobs)
SELECT tenant, string_agg(job_id, ',' ORDER BY k) AS jobs, count(*) AS total_jobs, count(*) FILTER (status = 'pending') AS pending_jobs, count(*) FILTER (status = 'running') AS running_jobs FROM r WHERE k <= 10 GROUP BY tenant""",
)


def keyed_windows(s, d):
    p = F.create_map(F.lit("spam/scam"), F.col("confidence"), F.lit("threat/violence"), 1 - F.col("confidence") / 2, F.lit("sexual content"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 1000))
    rows = log(s, d).withColumn("probabilities", p).withColumn("language", F.element_at(F.array(*map(F.lit, ("en", "hi", "bn"))), (F.col("event_id") % 3 + 1).cast("int")))
    return drift.windows_by_key(rows, F.window("ts", "1 day")["start"])


KEYED = f"""{LOG}, pr AS (SELECT tenant, time_bucket(INTERVAL 1 DAY, ts) AS win, event_id, unnest(['spam/scam', 'threat/violence', 'sexual content']) AS category, unnest([confidence, 1 - confidence / 2, CASE WHEN event_id % 2 = 0 THEN value / 1000 END]) AS p FROM lg),
cw AS (SELECT tenant, win, category, avg(p) AS v FROM pr GROUP BY ALL), kn AS (SELECT *, dense_rank() OVER (PARTITION BY tenant ORDER BY win) AS k FROM cw),
kb AS (SELECT tenant, category, avg(v) AS mean, stddev_pop(v) AS std FROM kn WHERE k <= 5 GROUP BY ALL)"""
Q["k1_windows_by_category"] = (
    lambda s, d: rounded(keyed_windows(s, d).select("tenant", "win", F.explode("by_category").alias("category", "mean")), "mean"),
    f"WITH {KEYED} SELECT tenant, win, category, round(v, 6) AS mean FROM cw",
)
Q["k1_windows_by_language"] = (
    lambda s, d: keyed_windows(s, d).select("tenant", "win", F.explode("languages").alias("language", "n")),
    f"WITH {LOG} SELECT tenant, time_bucket(INTERVAL 1 DAY, ts) AS win, (['en', 'hi', 'bn'])[event_id % 3 + 1] AS language, count(*) AS n FROM lg GROUP BY ALL",
)
Q["k2_category_baseline"] = (
    lambda s, d: rounded(drift.category_baseline(keyed_windows(s, d)), "mean", "std"),
    f"WITH {KEYED} SELECT tenant, category, round(mean, 6) AS mean, round(std, 6) AS std FROM kb",
)
Q["k3_category_drift"] = (
    lambda s, d: drift.category_drift(keyed_windows(s, d), drift.category_baseline(keyed_windows(s, d))),
    f"""WITH {KEYED}, z AS (SELECT tenant, win, category, round(abs(v - mean) / (std + 1e-8), 6) AS score FROM kn JOIN kb USING (tenant, category) WHERE k > 5)
SELECT tenant, win, category, score, {GRADE.format(1, 2, 3)} AS severity FROM z WHERE score > 0.05""",
)
__all__ = ["Q", "matching"]
