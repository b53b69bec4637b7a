"""Spans, context, decisions, policies and monitoring: defined cases and properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textwarden.operators import context, decide, feedback, matching, monitoring
from textwarden.plans.moderate import moderate_corpus

DOCS = "doc_id long, text string, lang string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)


def test_term_offsets_count_code_points(spark):
    text = "😀😀 idiot and IDIOT"
    rows = matching.match_terms(docs(spark, text), matching.load_lexicon(spark)).orderBy("start").collect()
    assert [text[r.start : r.end] for r in rows if r.category == "insult/harassment"] == ["idiot", "IDIOT"]


def test_whole_word(spark):
    rows = matching.match_terms(docs(spark, "skill to kill"), matching.load_lexicon(spark), whole_word=True).collect()
    assert [(r.start, r.end) for r in rows] == [(9, 13)]


def test_deduped_spans_do_not_overlap(spark):
    spans = matching.match_terms(docs(spark, "fucking shitkill diediot sexual nude"), matching.load_lexicon(spark))
    kept = sorted((r.start, r.end) for r in matching.dedupe_spans(spans).collect())
    assert kept and all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))


def test_consolidated_disjoint_spans_are_unchanged(spark):
    rows = [(1, 0, 4, "abcd", "spam/scam", 0.5), (1, 10, 14, "wxyz", "spam/scam", 0.7)]
    spans = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, category string, confidence double")
    out = decide.consolidate_spans(spans).orderBy("start").collect()
    assert [(r.start, r.end, r.confidence) for r in out] == [(0, 4, 0.5), (10, 14, 0.7)]


def test_consolidation_merges_overlap(spark):
    rows = [(1, 0, 10, "aaaaaaaaaa", "spam/scam", 0.4), (1, 5, 12, "bbbbbbb", "threat/violence", 0.8)]
    spans = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, category string, confidence double")
    (r,) = decide.consolidate_spans(spans).collect()
    assert (r.start, r.end, r.category, r.text) == (0, 12, "threat/violence", "aaaaaaaaaa") and r.confidence == pytest.approx(0.6)


def test_negation_scope_ends_at_punctuation(spark):
    d = docs(spark, "I do not hate you, idiot")
    (r,) = context.negation_scopes(context.negation_cues(d, morphological=False)).collect()
    assert "I do not hate you, idiot"[r.scope_start : r.scope_end] == "not hate you"


def test_quotes_are_resolved_by_confidence(spark):
    d = docs(spark, 'He said "you idiot" and left.')
    quotes = context.direct_quotes(d).unionByName(context.indirect_quotes(d))
    kept = context.resolve_quotes(quotes).collect()
    assert [(r.quote_type, r.start, r.end) for r in kept] == [("direct", 8, 19)]


def test_moderation_decides_and_context_softens(spark):
    d = docs(spark, "you are scum and I will murder you", "I would not murder you", "a fine day", "", None)
    rows = {r.doc_id: r for r in moderate_corpus(spark, d.where("text is not null")).collect()}
    assert rows[0].decision == "block" and rows[2].decision == "allow" and rows[3].decision == "allow"
    assert rows[1].max_score < rows[0].max_score and all(0 <= r.confidence <= 1 for r in rows.values())


def test_decide_zones(spark):
    scores = spark.createDataFrame([(1, "spam/scam", 0.9), (2, "spam/scam", 0.75), (3, "spam/scam", 0.1)], "doc_id long, category string, score double")
    out = {r.doc_id: (r.decision, round(r.confidence, 6)) for r in decide.decide_static(scores).collect()}
    assert out == {1: ("block", 1.0), 2: ("review", 0.9), 3: ("allow", round(0.6 / 0.7, 6))}


def test_reviews_take_the_latest_update(spark):
    at = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, 10, "low", "pending", at), (2, 20, "high", "pending", at)], "review_id long, request_id long, priority string, status string, created_at timestamp")
    rows = [(1, at, "in_progress", None), (1, at + dt.timedelta(hours=1), "completed", "block")]
    done, given = feedback.apply_reviews(items, spark.createDataFrame(rows, "review_id long, ts timestamp, status string, final_label string"))
    assert {r.review_id: r.status for r in done.collect()} == {1: "completed", 2: "pending"}
    assert [(r.request_id, r.final_label) for r in given.collect()] == [(10, "block")]


def test_ks_finds_a_shift_and_no_shift(spark):
    same = spark.range(1000).selectExpr("cast(id % 100 AS double) AS x")
    moved = spark.range(1000).selectExpr("cast(id % 100 + 30 AS double) AS x")
    assert monitoring.ks_drift(same, same, "x").first().statistic == 0
    r = monitoring.ks_drift(same, moved, "x").first()
    assert r.statistic == pytest.approx(0.3) and r.p < 1e-6 and r.drift


def test_p_values(spark):
    one = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "x double")
    two = spark.createDataFrame([(float(v),) for v in (2, 3, 4, 5, 6)], "x double")
    r = monitoring.mean_drift(one, two, "x").first()
    assert r.t == pytest.approx(-1.0) and r.p == pytest.approx(0.346594, abs=1e-5)  # two-sided, 8 degrees of freedom
    assert monitoring.variance_drift(one, two, "x").first().p == pytest.approx(1.0)


def test_health_counts_failures_at_the_end(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(minutes=k), k, ok) for k, ok in enumerate([True, False, False, False])] + [("b", at, 9, True)]
    out = {r.component: (r.failures, r.status) for r in monitoring.health_rollup(spark.createDataFrame(rows, "component string, ts timestamp, check_id long, ok boolean")).collect()}
    assert out == {"a": (3, "unhealthy"), "b": (0, "healthy")}


def test_slices_of_hot_tenants_equal_whole_windows(spark):
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import Window

    rng, begin = random.Random(4), datetime(2024, 1, 1)
    ts = [None if i % 97 == 0 else begin + timedelta(seconds=rng.randrange(900)) for i in range(600)]
    rows = [(i, t, "hot" if i % 3 else "cold", rng.random(), 1.0) for i, t in enumerate(ts)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, tenant string, confidence double, processing_ms double")
    whole = Window.partitionBy("tenant").orderBy("ts", "event_id")
    want = log.withColumn("win", F.floor((F.row_number().over(whole) - 1) / 50)).groupBy("tenant", "win").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    got = monitoring.prediction_windows(log, None, 50).select("tenant", "win", F.col("total").alias("n"), "first_ts")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    at = Window.partitionBy("tenant").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)
    want = log.withColumn("offered", F.count("*").over(at)).where("offered > 20").select("event_id", "offered")
    got = monitoring.rate_limit_violations(log, 20).select("event_id", "offered")
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ks_of_values_within_one(spark):
    import bisect
    import random

    rng = random.Random(7)
    a, b = [rng.random() for _ in range(700)] + [0.5] * 300, [rng.random() ** 1.3 for _ in range(800)]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    share = lambda v, x: bisect.bisect_right(v, x) / len(v)
    sa, sb = sorted(a), sorted(b)
    want = max(abs(share(sa, x) - share(sb, x)) for x in a + b)
    assert abs(monitoring.ks_drift(frame(a), frame(b), "x").first().statistic - want) < 1e-12
