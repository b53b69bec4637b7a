"""What is done to classifier scores: heads, calibration, uncertainty, fitting.

Logits are arrays; scores are long tables (doc_id, head, class, p).  Fits work on
labelled long tables by aggregation over a grid, so their cost is one pass and a
reduction, however many rows there are.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.matching import bounded

HEADS = {"category": K.CATEGORIES, "decision": K.DECISIONS, "severity": K.SEVERITIES}


def train_classifier(docs: DataFrame, labels: DataFrame, label: str = "toxic", features: int = 1 << 18) -> PipelineModel:
    """TF-IDF and logistic regression on labelled documents."""
    rows = docs.join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id").where("text is not null and label is not null")
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=2),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features, binary=True),
        IDF(inputCol="tf", outputCol="features", minDocFreq=3),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_corpus(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """(doc_id, p)."""
    out = model.transform(docs.where("text is not null"))
    return out.select("doc_id", vector_to_array("probability")[1].alias("p"))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def logits_from_vectors(vectors: DataFrame) -> DataFrame:
    """(doc_id, category, decision, severity arrays): dimensions 1-8, 9-11 and 12-15 of each vector."""
    part = lambda at, n: F.transform(F.slice("embedding", at, n), lambda v: v.cast("double"))
    return vectors.select(F.col("vec_id").alias("doc_id"), part(1, 8).alias("category"), part(9, 3).alias("decision"), part(12, 4).alias("severity"))


def long(logits: DataFrame, of=None) -> DataFrame:
    """(doc_id, head, class, p) from one array for each head."""
    heads = []
    for head, classes in HEADS.items():
        p = of(head, F.col(head)) if of else F.col(head)
        names = F.array(*map(F.lit, classes))
        heads.append(zipped(head, names, p))
    return logits.select("doc_id", F.explode(F.flatten(F.array(*heads))).alias("s")).select("doc_id", "s.*")


def zipped(head: str, names: Column, p: Column) -> Column:
    return F.zip_with(names, p, lambda n, v: F.struct(F.lit(head).alias("head"), n.alias("class"), v.alias("p")))


def softmax_heads(logits: DataFrame) -> DataFrame:
    return long(logits, lambda head, x: softmax(x))


def multi_head_scores(logits: DataFrame) -> DataFrame:
    """Categories: logistic times class weight, at most 1; decisions and severities: weighted softmax, renormalized."""

    def weights(values) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def of(head: str, x: Column) -> Column:
        if head == "category":
            w = weights(v[1] for v in K.CATEGORY_HEAD.values())
            return F.zip_with(x, w, lambda a, b: F.least(F.lit(1.0), b / (1 + F.exp(-a))))
        table = K.DECISION_HEAD if head == "decision" else K.SEVERITY_HEAD
        w = weights(v[1] * (v[2] if head == "severity" else 1.0) for v in table.values())
        raw = F.zip_with(softmax(x), w, lambda a, b: a * b)
        return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))

    return long(logits, of)


def head_confidence(scores: DataFrame) -> DataFrame:
    """(doc_id, category, decision, severity, overall): the largest score of each head, and their mean."""
    top = [F.max(F.when(F.col("head") == h, F.col("p"))).alias(h) for h in HEADS]
    return scores.groupBy("doc_id").agg(*top).withColumn("overall", (F.col("category") + F.col("decision") + F.col("severity")) / 3)


def predict_labels(scores: DataFrame) -> DataFrame:
    """(doc_id, categories, decision, severity)."""
    limits = F.create_map(*[F.lit(x) for c, v in [*K.CATEGORY_HEAD.items(), *K.SEVERITY_HEAD.items()] for x in (c, v[0])])
    over = F.col("p") >= limits[F.col("class")]
    return scores.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("head") == "category") & over, F.col("class")))), ",").alias("categories"),
        F.max_by("class", F.when(F.col("head") == "decision", F.col("p"))).alias("decision"),
        F.coalesce(F.max_by("class", F.when((F.col("head") == "severity") & over, F.col("p"))), F.lit("low")).alias("severity"),
    )


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), p))


def temperature_scale(scores: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    """Logits by head divided by a temperature and softened again."""
    t = F.create_map(*[F.lit(x) for kv in temperatures.items() for x in kv])[F.col("head")]
    z = F.log(clipped(F.col("p")) / (1 - clipped(F.col("p")))) / t
    w = Window.partitionBy("doc_id", "head")
    rows = scores.withColumn("z", z)
    e = F.exp(F.col("z") - F.max("z").over(w))
    return rows.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("z", "e")


def language_calibration_factor(languages: DataFrame, factors: DataFrame) -> DataFrame:
    """(doc_id, head, factor): mean factor of a document's languages (doc_id, code) in (code, head, factor)."""
    return languages.join(bounded(factors), "code").groupBy("doc_id", "head").agg(F.avg("factor").alias("factor"))


def entropy_share(by: list[str], scores: DataFrame) -> DataFrame:
    """By group the largest p, the normalized entropy, the variance and the count."""
    total = F.sum("p").over(Window.partitionBy(*by))
    q = F.col("p") / total
    rows = scores.withColumn("q", q)
    h = -F.sum(F.col("q") * F.log(F.col("q") + 1e-10)) / F.log(F.count("*").cast("double"))
    return rows.groupBy(*by).agg(F.max("p").alias("top"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), h)).alias("entropy"), F.var_pop("p").alias("variance"))


def confidence_from_distribution(scores: DataFrame) -> DataFrame:
    rows = entropy_share(["doc_id", "head"], scores)
    return rows.select("doc_id", "head", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top") * (1 - F.col("entropy")))).alias("confidence"))


def reliability_and_shift(raw: DataFrame, calibrated: DataFrame, temperature: float) -> DataFrame:
    both = raw.join(calibrated.withColumnRenamed("p", "q"), ["doc_id", "head", "class"])
    return both.groupBy("doc_id", "head").agg(
        ((F.exp(F.lit(-abs(temperature - 1))) + F.least(F.lit(1.0), 4 * F.var_pop("p"))) / 2).alias("reliability"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("shift")
    )


def uncertainty(scores: DataFrame) -> DataFrame:
    rows = entropy_share(["doc_id", "head"], scores)
    a = F.least(F.lit(1.0), F.col("variance") / 0.25)
    total = F.least(F.lit(1.0), F.sqrt(F.col("entropy") ** 2 + a**2))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return rows.select(
        "doc_id", "head", F.col("entropy").alias("epistemic"), a.alias("aleatoric"), total.alias("total"),
        clip(F.col("top") - total / 2).alias("lo"), clip(F.col("top") + total / 2).alias("hi"),
    )


def fit_temperature(labelled: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """(by, temperature, loss): the grid temperature of least mean log loss on (p, label)."""
    z = F.log(clipped(F.col("p")) / (1 - clipped(F.col("p"))))
    rows = labelled.select(*by, "label", z.alias("z"), F.explode(F.array(*map(F.lit, grid))).alias("temperature"))
    q = clipped(1 / (1 + F.exp(-F.col("z") / F.col("temperature"))))
    loss = -F.avg(F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q)))
    fits = rows.groupBy(*by, "temperature").agg(F.round(loss, 9).alias("loss"))
    best = F.min(F.struct("loss", "temperature")).alias("b")
    return fits.groupBy(*by).agg(best).select(*by, "b.temperature", "b.loss")


def tune_thresholds(labelled: DataFrame, by: list[str], grid: list[float]) -> DataFrame:
    """(by, threshold, f1): the grid threshold of best F1."""
    rows = labelled.select(*by, "label", "p", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    hit, true = F.col("p") >= F.col("threshold"), F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    fits = rows.groupBy(*by, "threshold").agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    f1 = F.coalesce(F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 9), F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("low"))).alias("b")
    return fits.groupBy(*by).agg(best).select(*by, (-F.col("b.low")).alias("threshold"), "b.f1")


def fit_weights(labelled: DataFrame) -> DataFrame:
    """(component, weight): positive correlation with the label, normalized; equal if none is positive."""
    rows = labelled.groupBy("component").agg(F.greatest(F.lit(0.0), F.coalesce(F.corr("p", F.col("label").cast("double")), F.lit(0.0))).alias("c"))
    total, n = F.sum("c").over(Window.partitionBy(F.lit(1))), F.count("*").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("t", total).withColumn("n", n).select("component", F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(1 / F.col("n")).alias("weight"))
