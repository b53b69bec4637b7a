"""The pipeline's stages on whole tables against brute force."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_filters import brute
from tests.llm.test_search import classes, contamination
from textwarden.llm import pii, quality
from textwarden.llm.common import table


def test_run_equals_brute_force(spark, sf):
    docs = [r.asDict() for r in table(spark, sf, "documents").collect()]
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scores = model.scores([d["text"] for d in docs])
    kept = [d for d, s in zip(docs, scores, strict=True) if s >= quality.GOOD]
    component, _ = classes([(d["doc_id"], d["text"]) for d in kept], 5, 80)
    kept = [d for d in kept if component[d["doc_id"]] == d["doc_id"]]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    dirty = contamination([(d["doc_id"], d["text"]) for d in kept], items)
    kept = [d for d in kept if not dirty[d["doc_id"]][-1]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in kept:
        assert [s[:3] for s in pii.spans_of(d["text"]) if s[0] in pii.BASE] == brute(d["text"])
        text, done, out = d["text"], 0, []
        for kind, a, b, _ in pii.spans_of(d["text"]):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        ids = np.array(library.encode("".join([*out, text[done:]]), add_special_tokens=False).ids, "<u4").tobytes()
        want[d["doc_id"]] = hashlib.sha256(ids).hexdigest()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids_sha256 for r in rows} == want and len(rows) == len(want)
    assert all(r.exact and len(r.ids) == 4 * r.n_tokens for r in rows)


def test_stages_take_odd_and_empty_documents(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A line of words, plainly. " * 6, "en", "s", 9), (3, "A line of words, plainly. " * 6, "en", "s", 9), (4, "x " * 50_000, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = list(corpus_pipeline.COLUMNS)
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf).select(*names)
            assert docs.columns == names
            docs = spark.createDataFrame(docs.collect(), df.schema)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids))


def test_stages_tell_rows_without_or_with_equal_ids_by_their_texts(spark, sf):
    passage = max((r.text for r in table(spark, sf, "benchmark").collect()), key=lambda t: len(t.split()))
    copy = "a line that stands twice in this corpus under one id and another, word for word"
    rows = [(None, passage), (1, passage + " x"), (1, "clean words under the same id"), (2, copy), (2, "a different text of the same id"), (None, copy), (3, copy), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.decontamination_stage(spark, df, sf).collect())
    assert left == sorted(str(r) for r in rows[2:])
    left = sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.dedup_stage(spark, df, sf).collect())
    assert left == sorted(str(r) for r in [*rows[1:5], *rows[7:]])
