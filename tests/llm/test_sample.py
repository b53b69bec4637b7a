"""The labelled sample takes as many usable documents as its bounds allow."""

from pyspark.sql import functions as F

from textwarden.llm import quality, toxicity
from textwarden.llm.common import labelled_sample


def sample(spark, docs, labels, limit, max_chars):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), limit, max_chars).collect()
    assert len(rows) <= limit and sum(len(r.text) for r in rows) <= max_chars
    return {r.doc_id for r in rows}


def test_labels_of_unusable_documents_take_no_place(spark):
    docs = [(i, f"text {i}") for i in range(20)] + [(i, None) for i in range(20, 100)] + [(i, "x" * 2000) for i in range(100, 200)] + [(i, "") for i in range(200, 300)]
    labels = [(i, i % 2) for i in range(2000)]
    assert sample(spark, docs, labels, 20, 1000) == set(range(20))


def test_a_long_text_keeps_no_shorter_one_out(spark):
    for long_ in range(0, 100, 7):  # somewhere in the order of the hash
        docs = [(i, "x" * (9_500 if i == long_ else 50)) for i in range(100)]
        got = sample(spark, docs, [(i, 1) for i in range(100)], 100, 10_000)
        assert got == set(range(100)) - {long_}


def test_long_texts_are_taken_where_there_is_room(spark):
    docs = [(i, "x" * (2_000 if i < 2 else 50)) for i in range(100)]
    assert sample(spark, docs, [(i, 1) for i in range(100)], 100, 10_000) == set(range(100))


def test_models_learn_past_missing_documents(spark):
    good = [(i, f"A plain line of text, number {i}. It goes on and on, quietly.") for i in range(30)]
    poor = [(30 + i, f"BUY!!! NOW!!! {i} $$$ ### !!!" * 3) for i in range(30)]
    docs = spark.createDataFrame([*good, *poor], "doc_id long, text string")
    absent = spark.range(1000, 60_000).selectExpr("id AS doc_id", "0 AS toxic", "1 AS quality")
    labels = absent.unionByName(spark.createDataFrame([(i, int(i >= 30), int(i < 30)) for i in range(60)], "doc_id long, toxic int, quality int"))
    model = quality.train(docs, labels)
    assert len(model.vectors) == 60 and model.scores([poor[0][1]])[0] < 0.5
    assert toxicity.train(docs, labels).prior == 0.5
