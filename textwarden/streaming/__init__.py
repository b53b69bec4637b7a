"""Streaming forms of the operators: Structured Streaming queries and their state."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textwarden.operators import decide, feedback, monitoring


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files under a path, with the schema they have now.

    The pattern lets the path be a single file too, which a file source takes only so.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Processes what is there and ends; the sink's rows, read back.  Exactly once by checkpoint and file sink."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def updates_to_end(stream: DataFrame, path: str) -> DataFrame:
    """As ``run_to_end`` for a stream of updates: each batch replaces its own folder, so a replay changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def stream_moderate(stream: DataFrame, moderate, path: str):
    """Each micro-batch goes through ``moderate`` and replaces its own folder, so replays change nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        moderate(batch).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def stream_windows(stream: DataFrame, size: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Tumbling windows by tenant; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy("tenant", F.window("ts", size))
        .agg(F.count("*").alias("total"), F.avg("confidence").alias("avg_confidence"), F.avg("processing_ms").alias("avg_processing"))
        .select("tenant", F.col("window.start").alias("win"), "total", "avg_confidence", "avg_processing")
    )


def stream_correlate_feedback(given: DataFrame, decisions: DataFrame, within: str = "7 days") -> DataFrame:
    """Feedback (request_id, fts) with decisions (request_id, dts) of the time before; unmatched rows when the watermark has passed."""
    f = given.withWatermark("fts", "1 hour").alias("f")
    d = decisions.withWatermark("dts", "1 hour").alias("d")
    on = F.expr(f"f.request_id = d.request_id AND f.fts >= d.dts AND f.fts <= d.dts + INTERVAL {within}")
    return f.join(d, on, "leftOuter").select("f.request_id", "f.fts", "d.decision", "d.dts")


def stream_review_queue(decisions: DataFrame) -> DataFrame:
    """Review items of a stream of measured decisions, one for each request."""
    fresh = decisions.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["request_id"])
    return feedback.review_priority(feedback.select_for_review(feedback.uncertainty_metrics(fresh)))


def stream_audit(decisions: DataFrame, path: str):
    """Audit rows to daily folders of JSON lines, exactly once."""
    rows = decisions.withColumn("event_date", F.to_date("ts"))
    return rows.writeStream.format("json").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").partitionBy("event_date").trigger(availableNow=True).start()


def in_order(rows: Iterator[Row]) -> Iterator[tuple[int, int]]:
    """(us, event_id) of a batch's rows in order: 16 bytes are held for a row, and as many for its place."""
    us, ids = array("q"), array("q")
    for r in rows:
        us.append(r["us"])
        ids.append(r["event_id"])
    for k in np.lexsort((np.frombuffer(ids, "i8"), np.frombuffer(us, "i8"))) if us else ():
        yield us[k], ids[k]


class RateLimit(StatefulProcessor):
    """Admits up to ``limit`` events of a tenant in the trailing span; the state is the times of those, and goes when they are over."""

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [t[0] for t in self.kept.get()]
        for us, event in in_order(rows):
            kept = [t for t in kept if t > us - self.span]
            if ok := len(kept) < self.limit:
                kept.append(us)
            yield Row(tenant=key[0], event_id=event, us=us, admitted=ok)
        self.kept.clear()
        if kept:
            self.kept.put([(t,) for t in kept])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # behind the watermark already if the batch was late; then the state goes with the next batch
            self.handle.registerTimer(max((kept[-1] + self.span) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(stream: DataFrame, limit: int, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """(tenant, event_id, us, admitted): only admitted events count in the trailing seconds.

    State of a tenant: the times of its admitted events in that span, at most ``limit``; an
    event-time timer empties it when the watermark has passed the last one's span.  Events of
    one batch are taken in order of time.
    """
    rows = stream.withWatermark("ts", watermark).select("tenant", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    processor = RateLimit(limit, seconds * 1_000_000)
    return stateful(rows).groupBy("tenant").transformWithState(processor, "tenant string, event_id long, us long, admitted boolean", "Append", "EventTime")


def stateful(stream: DataFrame) -> DataFrame:
    """The stream, on a session whose state store can hold lists and timers."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream


class Baseline(StatefulProcessor):
    """A tenant's first n closed windows are its baseline: their count and the sums of values and squares; later ones are scored once."""

    def __init__(self, n: int, threshold: float):
        self.n, self.threshold = n, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "k int, total double, squares double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        k, total, squares = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        for win, x in sorted((r["win_us"], r["avg_confidence"]) for r in rows):
            if k < self.n:
                k, total, squares = k + 1, total + x, squares + x * x
                continue
            mean = total / self.n
            score = abs(x - mean) / (max(squares / self.n - mean * mean, 0.0) ** 0.5 + 1e-8)
            if score > self.threshold:
                yield Row(tenant=key[0], win_us=win, score=score)
        self.sums.update((k, total, squares))

    def close(self) -> None:
        pass


def stream_drift(windows: DataFrame, n: int = 5, threshold: float = 0.05) -> DataFrame:
    """(tenant, win_us, score): each tenant's first n closed windows are its baseline, later ones are scored once."""
    rows = windows.select("tenant", "avg_confidence", F.unix_micros(F.col("win").cast("timestamp")).alias("win_us"))
    return stateful(rows).groupBy("tenant").transformWithState(Baseline(n, threshold), "tenant string, win_us long, score double", "Append", "None")


def newest_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of (component, outcome_id, score, us) each component's last n; ``stands_for`` of a component sums to its rows."""
    newest: dict[str | None, pa.Table] = {}
    seen: dict[str | None, int] = {}
    for batch in batches:
        coded = pc.dictionary_encode(batch.column("component"), null_encoding="encode")
        for k, component in enumerate(coded.dictionary.to_pylist()):
            own = pa.Table.from_batches([batch.filter(pc.equal(coded.indices, k))])
            seen[component] = seen.get(component, 0) + own.num_rows
            own = pa.concat_tables([newest[component], own]) if component in newest else own
            newest[component] = own.sort_by([("us", "descending"), ("outcome_id", "descending"), ("score", "descending")]).slice(0, n)
    for component, own in newest.items():
        counts = pa.array([seen[component], *[0] * (own.num_rows - 1)], pa.int64())
        yield from own.append_column("stands_for", counts).combine_chunks().to_batches()


class Weights(StatefulProcessor):
    """The last n outcome scores of each component, and the weights that follow from them."""

    def __init__(self, base: dict[str, float], n: int):
        self.base, self.n = base, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "component string", "scores array<double>")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # of a batch only the last n of a component can stay, so no more are held
        newest: dict[str, list] = {}
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for r in rows:
            heap, item = newest.setdefault(r["component"], []), (r["us"], r["outcome_id"], r["score"])
            (heapq.heappush if len(heap) < self.n else heapq.heappushpop)(heap, item)
            seen += r["stands_for"]
        self.seen.update((seen,))
        for component, heap in newest.items():
            before = list(self.last.getValue((component,))[0]) if self.last.containsKey((component,)) else []
            self.last.updateValue((component,), ((before + [x[2] for x in sorted(heap)])[-self.n :],))
        means = {k[0]: sum(v[0]) / len(v[0]) for k, v in self.last.iterator()}
        usual = sum(means.values()) / len(means)
        raw = {c: max(0.05, self.base.get(c, 0.0) * (0.8 + 0.4 * m / usual if usual else 0.8)) for c, m in means.items()}
        for c, w in raw.items():
            yield Row(component=c, seen=seen, performance=means[c], weight=w / sum(raw.values()))

    def close(self) -> None:
        pass


def stream_adaptive_weights(outcomes: DataFrame, base: dict[str, float] | None = None, n: int = 100) -> DataFrame:
    """(component, seen, performance, weight) of every component, emitted at every trigger.

    Weights are relative to each other, so the few components' last n scores are one key's
    state.  Each task of a batch passes on but each component's last n of its rows, with how many
    there were, and a heap reduces those of all tasks.
    """
    score = F.when(F.col("correct"), F.col("confidence")).otherwise(1 - F.col("confidence")).alias("score")
    rows = outcomes.select("component", F.col("outcome_id").cast("long"), score, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kinds = "component string, outcome_id long, score double, us long, stands_for long"
    rows = rows.mapInArrow(lambda batches: newest_of(batches, n), kinds).withColumn("all", F.lit(0))
    out = "component string, seen long, performance double, weight double"
    return stateful(rows).groupBy("all").transformWithState(Weights(base or decide.WEIGHTS, n), out, "Update", "None")


__all__ = [name for name in dir() if name.startswith(("stream_", "run_", "read_", "updates_"))] + ["monitoring"]
