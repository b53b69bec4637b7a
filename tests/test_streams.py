"""State of the streaming forms, and percentiles by ranges and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from textwarden import streaming
from textwarden.operators import monitoring


def add(spark, path, rows):
    df = spark.createDataFrame(rows, "event_id long, tenant string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_rate_limit_goes_on_over_batches_and_its_state_empties(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/run"
    run = lambda: streaming.run_to_end(streaming.stream_rate_limit(spark.readStream.schema("event_id long, tenant string, ts timestamp").parquet(src), 2, 60), out)
    add(spark, src, [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:10"), (3, "a", "2024-01-01 00:00:20"), (4, "b", "2024-01-01 00:00:00")])
    assert {(r.event_id, r.admitted) for r in run().collect()} == {(1, True), (2, True), (3, False), (4, True)}
    # what was refused doesn't count; what was admitted in the batch before does
    add(spark, src, [(5, "a", "2024-01-01 00:00:59"), (6, "a", "2024-01-01 00:01:05"), (7, "a", "2024-01-01 00:01:06")])
    assert {(r.event_id, r.admitted) for r in run().collect() if r.event_id > 4} == {(5, False), (6, True), (7, False)}
    add(spark, src, [(8, "c", "2024-01-01 09:00:00")])
    run()
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(f"{out}/state").select("key.*").distinct()
    assert {r[0] for r in kept.collect()} <= {"c"}


def test_weights_follow_the_last_outcomes_of_all_batches(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/run"
    schema = "outcome_id long, component string, correct boolean, confidence double, ts timestamp"
    run = lambda: streaming.updates_to_end(streaming.stream_adaptive_weights(spark.readStream.schema(schema).parquet(src), n=3), out)
    for start in (0, 10):
        rows = [(start + k, c, c == "lpe", 0.9, f"2024-01-01 00:00:{start + k:02d}") for k in range(5) for c in ("lpe", "intent")]
        df = spark.createDataFrame(rows, "outcome_id long, component string, correct boolean, confidence double, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        got = {(r.seen, r.component): r for r in run().collect()}
    assert {k[0] for k in got} == {10, 20}
    last = {c: got[20, c] for c in ("lpe", "intent")}
    assert last["lpe"].performance == pytest.approx(0.9) and last["intent"].performance == pytest.approx(0.1)
    raw = {"lpe": 0.4 * (0.8 + 0.4 * 0.9 / 0.5), "intent": max(0.05, 0.1 * (0.8 + 0.4 * 0.1 / 0.5))}
    assert last["lpe"].weight == pytest.approx(raw["lpe"] / sum(raw.values()))


def test_percentiles_by_ranges_and_sketches(spark):
    r = random.Random(3)
    values = [("a", r.randint(0, 40) / 4) for _ in range(3000)] + [("b", r.gauss(0, 1)) for _ in range(2001)] + [(None, 5.0), ("c", None)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    shares = {"p50": 0.5, "p95": 0.95}
    exact = {x.g: x for x in monitoring.ranged_percentiles(df, "v", ["g"], shares).collect()}
    plain = {x.g: x for x in df.where("v is not null").groupBy("g").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.95).alias("p95"), F.avg("v").alias("mean")).collect()}
    assert set(exact) == set(plain) == {"a", "b", None}
    for g in plain:
        assert (exact[g].p50, exact[g].p95, exact[g].mean) == pytest.approx((plain[g].p50, plain[g].p95, plain[g].mean))
    parts = monitoring.percentile_sketches(df.withColumn("hour", F.pmod(F.xxhash64("v"), F.lit(7))), "v", ["g", "hour"])
    for x in monitoring.merged_percentiles(parts, ["g"], shares).where("g is not null and n > 0").collect():
        own = sorted(v for g, v in values if g == x.g and v is not None)
        for name, p in shares.items():
            below, upto = sum(v < x[name] for v in own) / len(own), sum(v <= x[name] for v in own) / len(own)
            assert below - 0.017 <= p <= upto + 0.017
