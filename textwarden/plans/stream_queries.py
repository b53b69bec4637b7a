"""Streaming queries over the tables as file sources, run until everything there is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textwarden import streaming
from textwarden.plans.common import spread
from textwarden.plans.decision_queries import Q as DECISIONS
from textwarden.plans.decision_queries import H22_ROUNDED, rounded
from textwarden.plans.moderate import moderate_corpus
from textwarden.plans.monitor_queries import LOG, shared

Q: dict = {}
FLAGSHIP_SQL = DECISIONS["h22_moderate_corpus"][1]


def place(s):
    return f"{shared(s)}/textwarden-{s.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"


def events(s, d):
    e = streaming.read_stream(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "ts", "event_type", "value", F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant"), (F.col("value") / 500).alias("confidence"), (F.col("value") * 2).alias("processing_ms"))


def m1(s, d):
    path = place(s)
    docs = streaming.read_stream(s, f"{d}/documents.parquet")
    streaming.stream_moderate(docs, lambda batch: rounded(moderate_corpus(s, spread(batch)), *H22_ROUNDED), path).awaitTermination()
    return s.read.parquet(f"{path}/out").drop("batch")


Q["m1_stream_moderate"] = (m1, FLAGSHIP_SQL)  # a stream of the corpus is decided as the corpus is
CLOSED = f"""{LOG}, last AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM lg),
w AS (SELECT tenant, time_bucket(INTERVAL 1 HOUR, ts) AS win, count(*) AS total, avg(confidence) AS c, avg(processing_ms) AS m FROM lg GROUP BY ALL),
closed AS (SELECT w.* FROM w, last WHERE win + INTERVAL 1 HOUR <= mark)"""
Q["m2_stream_windows"] = (
    lambda s, d: rounded(streaming.run_to_end(streaming.stream_windows(events(s, d)), place(s)).withColumn("win", F.col("win").cast("string")), "avg_confidence", "avg_processing"),
    f"WITH {CLOSED} SELECT tenant, strftime(win, '%Y-%m-%d %H:%M:%S') AS win, total, round(c, 6) AS avg_confidence, round(m, 6) AS avg_processing FROM closed",
)


def m3(s, d):
    path = place(s)
    streaming.run_to_end(streaming.stream_windows(events(s, d)), f"{path}/windows")
    windows = s.readStream.schema("tenant string, win timestamp, total long, avg_confidence double, avg_processing double").parquet(f"{path}/windows/out")
    return rounded(streaming.run_to_end(streaming.stream_drift(windows), f"{path}/drift"), "score")


Q["m3_stream_drift"] = (
    m3,
    f"""WITH {CLOSED}, k AS (SELECT tenant, win, c, row_number() OVER (PARTITION BY tenant ORDER BY win) AS k FROM closed),
b AS (SELECT tenant, avg(c) AS m, stddev_pop(c) AS s FROM k WHERE k <= 5 GROUP BY tenant)
SELECT tenant, epoch_us(win) AS win_us, round(abs(c - m) / (s + 1e-8), 6) AS score FROM k JOIN b USING (tenant) WHERE k > 5 AND abs(c - m) / (s + 1e-8) > 0.05""",
)
RECENT_ADMITTED = "list_filter(a.kept, lambda t: t > x.us - 1800000000)"
Q["m4_stream_rate_limit"] = (
    lambda s, d: streaming.run_to_end(streaming.stream_rate_limit(events(s, d), 3, 1800), place(s)),
    f"""WITH {LOG}, e AS (SELECT tenant, list_sort(list({{'us': epoch_us(ts), 'id': event_id, 'kept': []::BIGINT[], 'done': []::STRUCT(event_id BIGINT, us BIGINT, admitted BOOLEAN)[]}})) AS l FROM lg GROUP BY tenant),
r AS (SELECT tenant, list_reduce(list_prepend({{'us': 0::BIGINT, 'id': 0::BIGINT, 'kept': []::BIGINT[], 'done': []::STRUCT(event_id BIGINT, us BIGINT, admitted BOOLEAN)[]}}, l), lambda a, x: {{
  'us': x.us, 'id': x.id, 'kept': CASE WHEN len({RECENT_ADMITTED}) < 3 THEN list_append({RECENT_ADMITTED}, x.us) ELSE {RECENT_ADMITTED} END,
  'done': list_append(a.done, {{'event_id': x.id, 'us': x.us, 'admitted': len({RECENT_ADMITTED}) < 3}})}}) AS r FROM e)
SELECT tenant, d.event_id, d.us, d.admitted FROM (SELECT tenant, unnest(r.done) AS d FROM r)""",
)


def m5(s, d):
    e = events(s, d)
    given = e.where("event_type = 'click'").select((F.col("event_id") / 7).cast("long").alias("request_id"), F.col("ts").alias("fts"))
    made = events(s, d).where("event_type = 'view'").select((F.col("event_id") / 7).cast("long").alias("request_id"), F.col("ts").alias("dts"), F.lit("allow").alias("decision"))
    out = streaming.run_to_end(streaming.stream_correlate_feedback(given, made), place(s))
    return out.where("decision is not null").groupBy("request_id").agg(F.count("*").alias("n"))


Q["m5_stream_correlate_feedback"] = (
    m5,
    f"""WITH {LOG} SELECT f.event_id // 7 AS request_id, count(*) AS n FROM lg f JOIN lg d ON f.event_type = 'click' AND d.event_type = 'view' AND f.event_id // 7 = d.event_id // 7
AND f.ts >= d.ts AND f.ts <= d.ts + INTERVAL 7 DAY GROUP BY 1""",
)


def m6(s, d):
    measured = events(s, d).select(
        F.col("event_id").alias("request_id"), "ts", F.when(F.col("event_type") == "error", "block").otherwise("allow").alias("decision"), "confidence",
        (F.col("event_id") % 4).alias("n_categories"), F.lit(0.9).alias("language_confidence"),
    )
    return streaming.run_to_end(streaming.stream_review_queue(measured), place(s)).select("request_id", "priority")


Q["m6_stream_review_queue"] = (
    m6,
    f"""WITH {LOG}, x AS (SELECT event_id AS request_id, CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS decision, confidence AS c, event_id % 4 AS k FROM lg),
u AS (SELECT *, round(((1 - c) + CASE WHEN c BETWEEN 0.4 AND 0.6 THEN 0.8 WHEN c BETWEEN 0.3 AND 0.7 THEN 0.5 ELSE 0.2 END + CASE WHEN k = 0 THEN 0.6 WHEN k > 2 THEN 0.7 ELSE 0.3 END + 0.1) / 4, 9) AS u FROM x)
SELECT request_id, CASE WHEN decision = 'block' AND c < 0.6 THEN 'critical' WHEN u > 0.7 THEN 'high' WHEN u > 0.4 THEN 'medium' ELSE 'low' END AS priority FROM u WHERE c < 0.7 OR u > 0.3 OR (decision = 'block' AND c < 0.8)""",
)


def m7(s, d):
    kind = F.element_at(F.array(*[F.lit(c) for c in ("lpe", "classifier", "intent")]), (F.col("event_id") % 3 + 1).cast("int"))
    outcomes = events(s, d).select(F.col("event_id").alias("outcome_id"), kind.alias("component"), "ts", (F.col("event_type") != "error").alias("correct"), "confidence")
    out = streaming.updates_to_end(streaming.stream_adaptive_weights(outcomes), place(s))
    last = out.groupBy("component").agg(F.max(F.struct("seen", "performance", "weight")).alias("l"))
    return rounded(last.select("component", "l.seen", "l.performance", "l.weight"), "performance", "weight")


Q["m7_stream_adaptive_weights"] = (
    m7,
    """WITH o AS (SELECT event_id, (['lpe', 'classifier', 'intent'])[event_id % 3 + 1] AS component, ts, CASE WHEN event_type <> 'error' THEN value / 500 ELSE 1 - value / 500 END AS x FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER () AS seen FROM o),
p AS (SELECT component, max(seen) AS seen, avg(x) AS s FROM r WHERE k <= 100 GROUP BY component),
w AS (SELECT *, greatest(0.05, CASE component WHEN 'lpe' THEN 0.4 WHEN 'classifier' THEN 0.5 ELSE 0.1 END * (0.8 + 0.4 * s / avg(s) OVER ())) AS w FROM p)
SELECT component, seen, round(s, 6) AS performance, round(w / sum(w) OVER (), 6) AS weight FROM w""",
)


def m8(s, d):
    path = place(s)
    streaming.stream_audit(events(s, d).select("event_id", "ts", "tenant", "event_type"), path).awaitTermination()
    rows = s.read.schema("event_id long, ts timestamp, tenant string, event_type string, event_date date").json(f"{path}/out")
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date"), "tenant").agg(F.count("*").alias("n"))


Q["m8_stream_audit"] = (m8, f"WITH {LOG} SELECT ts::DATE::VARCHAR AS event_date, tenant, count(*) AS n FROM lg GROUP BY ALL")
