"""From component scores to decisions with severity, spans and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.sweep import swept

WEIGHTS = {"lpe": 0.4, "classifier": 0.5, "intent": 0.1}
REVIEW, BLOCK, FLOOR = 0.7, 0.85, 0.6
INTENT = {"block": 0.8, "review": 0.5, "allow": 0.0}


def mapped(values: dict, key: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def component_scores(docs: DataFrame, lpe: DataFrame, classifier: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """(doc_id, component, category, score) for every document, category and given component; missing ones are 0."""
    grid = docs.select("doc_id", F.explode(F.array(*map(F.lit, K.CATEGORIES))).alias("category"))
    out = None
    for name, part in (("lpe", lpe), ("classifier", classifier)):
        if part is not None:
            rows = grid.join(part.select("doc_id", "category", "score"), ["doc_id", "category"], "left")
            rows = rows.select("doc_id", F.lit(name).alias("component"), "category", F.coalesce("score", F.lit(0.0)).alias("score"))
            out = rows if out is None else out.unionByName(rows)
    if actions is not None:
        rows = grid.join(actions.select("doc_id", mapped(INTENT, F.col("action")).alias("score")), "doc_id", "left")
        out = out.unionByName(rows.select("doc_id", F.lit("intent").alias("component"), "category", F.coalesce("score", F.lit(0.0)).alias("score")))
    return out


def apply_modifiers(scores: DataFrame, modifiers: DataFrame, safe_categories: list[str] | None = None) -> DataFrame:
    rows = scores.join(modifiers.select("doc_id", "category", "modifier"), ["doc_id", "category"], "left")
    safe = F.when(F.col("category").isin(safe_categories), 0.3).otherwise(1.0) if safe_categories else F.lit(1.0)
    s = F.col("score") * F.coalesce("modifier", F.lit(1.0)) * safe
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).drop("modifier")


def combine_scores(scores: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc_id, category, score): weighted mean over the components that are there."""
    w = mapped(weights, F.col("component"))
    return scores.groupBy("doc_id", "category").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))


def features_of(text: Column) -> list[Column]:
    """length, code_mixed and obfuscated of a text."""
    mixed = text.rlike("[A-Za-z]") & text.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    return [F.length(text).alias("length"), mixed.alias("code_mixed"), text.rlike(r"[A-Za-z][@!$+0134578]+[A-Za-z]").alias("obfuscated")]


def decision_features(docs: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """(doc_id, length, language_confidence, code_mixed, obfuscated)."""
    out = docs.select("doc_id", *features_of(F.col("text")))
    if languages is None:
        return out.withColumn("language_confidence", F.lit(1.0))
    return out.join(languages.select("doc_id", F.col("confidence").alias("language_confidence")), "doc_id", "left").fillna(0.5, ["language_confidence"])


def adapted_of(score: Column) -> Column:
    """A score under the features language_confidence, obfuscated and code_mixed of its row."""
    c = F.col("language_confidence")
    factor = F.when(c < 0.8, 1 - (0.8 - c) * 0.2).otherwise(1.0) * F.when(F.col("obfuscated"), 1.1).otherwise(1.0) * F.when(F.col("code_mixed"), 0.95).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * factor))


def adapt_scores(scores: DataFrame, features: DataFrame) -> DataFrame:
    return scores.join(features, "doc_id").select("doc_id", "category", adapted_of(F.col("score")).alias("score"))


def adapt_thresholds(features: DataFrame, review: float = REVIEW, block: float = BLOCK) -> DataFrame:
    """Adds block_at and review_at, which follow the row's language_confidence and length."""
    c, n = F.col("language_confidence"), F.col("length")
    low = F.when(c < 0.8, (0.8 - c) * 0.1).otherwise(0.0)
    b = block - low + F.when(n < 50, 0.05).when(n > 500, -0.03).otherwise(0.0)
    r = review - low + F.when(n < 50, 0.03).when(n > 500, -0.02).otherwise(0.0)
    return features.withColumn("block_at", b).withColumn("review_at", r)


def decision_of(m: Column) -> list[Column]:
    """decision and confidence of a largest score, under the thresholds and features of its row."""
    b, r = F.round("block_at", 9), F.round("review_at", 9)
    decision = F.when(m >= b, "block").when(m >= r, "review").otherwise("allow")
    base = F.when(m >= b, F.least(F.lit(1.0), 0.7 + (m - b) * 2)).when(m >= r, 0.5 + (m - r) / (b - r) * 0.3).otherwise(F.least(F.lit(1.0), 0.6 + (r - m) * 1.5))
    lower = F.when(F.col("language_confidence") < 0.8, 0.9).otherwise(1.0) * F.when(F.col("obfuscated"), 0.95).otherwise(1.0) * F.when(F.col("code_mixed"), 0.92).otherwise(1.0)
    return [decision.alias("decision"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), base * lower)).alias("confidence")]


def decide(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(doc_id, decision, confidence, max_score) under thresholds that follow each document."""
    top = scores.groupBy("doc_id").agg(F.round(F.max("score"), 9).alias("m"))
    return top.join(thresholds, "doc_id").select("doc_id", *decision_of(F.col("m")), F.col("m").alias("max_score"))


def decide_static(scores: DataFrame, review: float = REVIEW, block: float = BLOCK, floor: float = FLOOR) -> DataFrame:
    top = scores.groupBy("doc_id").agg(F.round(F.max("score"), 9).alias("m"))
    m = F.col("m")
    decision = F.when(m >= block, "block").when(m >= review, "review").otherwise("allow")
    near = F.least(F.abs(m - review), F.abs(m - block))
    c = F.when(m >= block, F.least(F.lit(1.0), m / block)).when(m >= review, F.greatest(F.lit(0.5), 1 - near * 2)).otherwise(F.least(F.lit(1.0), (review - m) / review))
    return top.select("doc_id", decision.alias("decision"), F.greatest(F.lit(floor), c).alias("confidence"))


def grade_of(score: Column, category: Column) -> Column:
    return (
        F.when((score >= 0.9) | (category.isin(*K.CRITICAL_CATEGORIES) & (score >= 0.7)), "critical")
        .when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")
    )


def severity(scores: DataFrame) -> DataFrame:
    """(doc_id, top_category, severity); of equal scores the alphabetically last category counts."""
    top = scores.groupBy("doc_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), "category")).alias("t"))
    return top.select("doc_id", F.col("t.category").alias("top_category"), grade_of(F.col("t.score"), F.col("t.category")).alias("severity"))


def consolidate_spans(spans: DataFrame, overlap: float = 0.3, most: int = 10) -> DataFrame:
    """Merges spans, in order of start, into the running one while they overlap enough; the ``most`` surest stay."""
    item = F.struct("start", "end", "text", "category", "confidence")
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def step(live: Column, s: Column) -> Column:
        last = F.get(live, F.lit(0))
        common = F.least(last["end"], s["end"]) - F.greatest(last["start"], s["start"])
        share = common / F.least(last["end"] - last["start"], s["end"] - s["start"])
        stronger = s["confidence"] > last["confidence"]
        merged = F.struct(
            F.least(last["start"], s["start"]).alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
            F.when(F.length(s["text"]) > F.length(last["text"]), s["text"]).otherwise(last["text"]).alias("text"),
            F.when(stronger, s["category"]).otherwise(last["category"]).alias("category"),
            ((last["confidence"] + s["confidence"]) / 2).alias("confidence"),
        )
        joined = (F.size(live) > 0) & (share >= overlap)
        return F.struct(F.when(joined, F.array(merged)).otherwise(F.array(s)).alias("live"), F.when(joined, F.slice(live, 1, 0)).otherwise(live).alias("out"))

    merged = swept(F.col("all"), F.slice("all", 1, 0), per_doc.schema["all"].dataType.simpleString(), step)
    best = F.slice(F.array_sort(F.transform(merged, lambda s: F.struct((-s["confidence"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["category"].alias("category")))), 1, most)
    return per_doc.select("doc_id", F.explode(best).alias("s")).select("doc_id", "s.start", "s.end", "s.text", "s.category", (-F.col("s.k")).alias("confidence"))


def rank_spans(spans: DataFrame, lengths: DataFrame, method: str = "confidence_weighted") -> DataFrame:
    """Adds ``rank`` within each document; lengths: (doc_id, length)."""
    rows = spans.join(lengths, "doc_id")
    w = mapped({c: v[2] for c, v in K.CATEGORY_HEAD.items()}, F.col("category"), 0.5)
    early = 1 - F.col("start") / F.nullif("length", F.lit(0))
    c = F.col("confidence")
    score = {
        "confidence_weighted": c,
        "severity_weighted": c * w,
        "position_weighted": c * (1 + 0.1 * early),
        "hybrid": c * (0.7 + 0.3 * w) * (1 + 0.05 * early) * F.least(F.lit(1.2), 1 + (F.col("end") - F.col("start") - 5) * 0.01) * F.when(F.contains(F.lower("rule_source"), F.lit("classifier")), 1.05).otherwise(1.0),
    }[method]
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.coalesce(score, c), 9)), "start", "end", "rule_source")
    return rows.withColumn("rank", F.row_number().over(order)).drop("length")


def recent(rows: DataFrame, by: str, ts: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(ts), F.desc("outcome_id"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def adaptive_weights(outcomes: DataFrame, base: dict[str, float] = WEIGHTS, n: int = 100) -> DataFrame:
    """(component, weight) from the last n outcomes (outcome_id, component, ts, correct, confidence)."""
    s = F.when(F.col("correct"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    perf = recent(outcomes, "component", "ts", n).groupBy("component").agg(F.avg(s).alias("s"))
    one = Window.partitionBy(F.lit(1))
    rows = perf.withColumn("w", F.greatest(F.lit(0.05), mapped(base, F.col("component")) * (0.8 + 0.4 * F.col("s") / F.avg("s").over(one))))
    return rows.select("component", (F.col("w") / F.sum("w").over(one)).alias("weight"))


def component_performance(outcomes: DataFrame, n: int = 1000) -> DataFrame:
    rows = recent(outcomes, "component", "ts", n)
    return rows.groupBy("component").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("avg_confidence"), F.count("*").alias("n"))


def component_contributions(scores: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc_id, component, weight, confidence, categories)."""
    over = F.when(F.col("score") > 0.3, F.col("category"))
    return scores.groupBy("doc_id", "component").agg(
        F.first(mapped(weights, F.col("component"))).alias("weight"), F.max("score").alias("confidence"), F.array_join(F.array_sort(F.collect_list(over)), ",").alias("categories")
    )


def attribution_report(contributions: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id")
    part = F.col("weight") * F.col("confidence")
    rows = contributions.withColumn("part", part).withColumn("t", F.sum("part").over(w)).withColumn("n", F.count("*").over(w))
    return rows.select("doc_id", "component", F.when(F.col("t") > 0, F.col("part") / F.col("t")).otherwise(1 / F.col("n")).alias("share"))


def explain(decisions: DataFrame, contributions: DataFrame) -> DataFrame:
    """(doc_id, lines): the decision, then a line for each component that contributed."""
    line = F.format_string("%s: weight %.2f, confidence %.2f, %s", "component", "weight", "confidence", F.when(F.col("categories") == "", "no category").otherwise(F.col("categories")))
    parts = contributions.select("doc_id", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("parts"))
    head = F.format_string("Decision %s at confidence %.2f, severity %s", "decision", "confidence", "severity")
    return decisions.join(parts, "doc_id", "left").select("doc_id", F.concat(F.array(head), F.coalesce("parts", F.array().cast("array<string>"))).alias("lines"))


def degrade_missing_components(docs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, component_errors): the components that gave a document no row."""
    out, errors = docs.select("doc_id"), []
    for name, part in parts.items():
        out = out.join(part.select("doc_id", F.lit(True).alias(f"has_{name}")).distinct(), "doc_id", "left")
        errors.append(F.when(F.col(f"has_{name}").isNull(), name))
    return out.select("doc_id", F.array_compact(F.array(*errors)).alias("component_errors"))


def build_response(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, decision, confidence, severity, categories): categories above 0.5, named and sorted."""
    over = scores.where("score > 0.5").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"))
    return decisions.join(over, "doc_id", "left").select("doc_id", "decision", "confidence", "severity", F.coalesce("categories", F.lit("")).alias("categories"))
