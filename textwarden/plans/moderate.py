"""The flagship: a corpus in, a decision for each document out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import align, context, decide, language, matching, policy
from textwarden.operators.engine import with_spans
from textwarden.operators.normalize import let

#: What the pass that places spans finds too.
FOUND_TOO = [("cues", language.CUES, language.cues), ("contexts", align.CONTEXTS, align.contexts_of), ("own_context", "string", align.policy_contexts_of)]
SCORES = "array<struct<category:string,score:double>>"


def score_in(scores: Column, category: Column) -> Column:
    """A category's score in an array of (category, score); 0 if it isn't there."""
    return F.coalesce(F.get(F.filter(scores, lambda s: s["category"] == category), F.lit(0))["score"], F.lit(0.0))


def moderate_corpus(
    spark: SparkSession, docs: DataFrame, lexicon: DataFrame | None = None, classifier: DataFrame | None = None,
    emoji: DataFrame | None = None, policies: DataFrame | None = None, details: bool = False,
) -> DataFrame:
    """(doc_id, decision, confidence, severity, top_category, max_score, language, policy_decision, policy_confidence, n_rules), one row for each row of ``docs``.

    Lexicon terms, patterns and signs, in the text and in its matchable form, give category
    scores; negation, quotation and legitimate contexts modify them; a classifier's (doc_id,
    category, score) are weighed in if given; text length, script mixing, disguised spelling
    and how sure the language is set the thresholds; the tenant's policy has the last word.  What its
    thresholds for a whole document meet is the largest score, not how sure an ``allow`` is.

    ``docs``: (doc_id, text), and tenant, department and context if there are any; ``policies``:
    ``policy.policy_rows``, the built-in ones if not given.  A document's spans, scores and
    policy are columns of its own row: the corpus is read once and, without a classifier,
    nothing is shuffled.  ``details`` adds the raw spans.  A null text has no spans, scores 0
    and has no top category.
    """
    optional = [c for c in ("tenant", "department", "context") if c in docs.columns]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *optional)
    for c in ("tenant", "department", "context"):
        rows = rows if c in optional else rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.select("doc_id", "text", F.lower("text").alias("low"), "tenant", "department", "context", *decide.features_of(F.col("text")))
    rows = with_spans(rows, lexicon, emoji, FOUND_TOO)
    rows = language.languages_from(rows, "cues").withColumn("language", F.get("languages", F.lit(0)))
    around = [let(context.sure_of(F.col("contexts")), context.safe_of).alias("safe"), F.coalesce("context", "own_context").alias("context")]
    language_ = [F.col("language.code").alias("language"), F.col("language.confidence").alias("language_confidence")]
    rows = rows.select("doc_id", "tenant", "department", *around, *language_, "length", "code_mixed", "obfuscated", "spans", "negation", "quotation", "most")
    rows = rows.withColumn("lpe", matching.category_scores_of(F.col("spans")))
    parts = ["lpe"]
    if classifier is not None:
        own = classifier.groupBy("doc_id").agg(F.collect_list(F.struct("category", "score")).alias("classifier"))
        rows = rows.join(own, "doc_id", "left")
        parts.append("classifier")
    weight = sum(decide.WEIGHTS[p] for p in parts)

    def one(category: Column) -> Column:
        modifier = context.modifier_of(category, *map(F.col, ("negation", "quotation", "most", "safe")))
        kept = F.when(F.exists("lpe", lambda s: s["category"] == category), modifier).otherwise(1.0)
        of = {"lpe": F.col("lpe"), "classifier": F.coalesce("classifier", F.array().cast(SCORES)) if classifier is not None else None}
        total = reduce(Column.__add__, [F.least(F.lit(1.0), score_in(of[p], category) * kept) * decide.WEIGHTS[p] for p in parts])
        return F.struct(F.round(decide.adapted_of(total / weight), 9).alias("score"), category.alias("category"))

    nothing = F.transform(F.array(*map(F.lit, K.CATEGORIES)), lambda c: F.struct(F.lit(0.0).alias("score"), c.alias("category")))
    every = F.transform(F.array(*map(F.lit, K.CATEGORIES)), one)
    if classifier is None:
        every = F.when(F.size("lpe") > 0, every).otherwise(nothing)
    rows = rows.withColumn("scores", every).withColumn("top", F.array_max("scores"))
    rows = decide.adapt_thresholds(rows)
    score, category = F.col("top.score"), F.when(F.col("top.score") > 0, F.col("top.category"))
    decided = rows.select(
        "doc_id", "tenant", "department", "context", "scores", "language", "spans", *decide.decision_of(score), score.alias("max_score"), category.alias("top_category"),
        decide.grade_of(score, F.coalesce(category, F.lit(""))).alias("severity"),
    )
    ruled = policy.with_policy(decided, policies if policies is not None else policy.builtin_policies(), risk="max_score")
    shown = ["doc_id", "decision", "confidence", "max_score", "top_category", "severity", "language", "policy_decision", "policy_confidence", F.size("applied_rules").alias("n_rules")]
    more = ["tenant", "department", "scores", "applied_rules", "override_reason", "spans"] if details else []
    return ruled.select(*shown, *more)
