"""Registered queries cover every row, whatever part of it their SQL covers."""

import math
import re

import duckdb
import pytest

from textwarden import constants as K
from textwarden.plans import registry


def saved(spark, tmp_path, rows, columns="doc_id long, text string, lang string, source string"):
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def by_sql(name, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return c.sql(registry.ORACLES[name])


def ngram_scores(text):
    t = f"<{text.lower()}>"
    grams = [t[i : i + n] for n in (2, 3, 4, 5) for i in range(len(t) - n + 1)]
    raw = {lang: sum(math.log(own[g] + 1e-10) for g in grams if g in own) / len(grams) for lang, own in K.NGRAMS.items()}
    total = sum(map(math.exp, raw.values()))
    return {lang: math.exp(x) / total for lang, x in raw.items()}


def test_ngram_scores_of_long_texts(spark, sf, tmp_path):
    every = "".join(g for grams in K.NGRAMS.values() for g in grams)
    texts = ["The end of anananana. " * 400, every * 30, "aaaaaaaaaaa" * 100, "short but whole", "\u0939\u0948 yaar " * 200, "x" * 299]
    got = {(r.doc_id, r.lang): r.score for r in registry.QUERIES["c2_ngram_language_scores"](spark, saved(spark, tmp_path, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    want = {(i, lang): x for i, t in enumerate(texts) for lang, x in ngram_scores(t).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_flagship_reads_once_and_shuffles_nothing(spark, sf):
    """On a larger table and with other partition counts too; by plan, no join and at most two scans."""
    from textwarden.plans.match_queries import docs
    from textwarden.plans.moderate import moderate_corpus

    df = moderate_corpus(spark, docs(spark, "/root/testdata/sf0.01"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") <= 2 and plan.count("Exchange") <= 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert df.count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_lexicons_are_joined_by_their_first_letters(spark, sf, monkeypatch):
    from textwarden.operators import matching
    from textwarden.plans.match_queries import docs

    d, lexicon = docs(spark, sf), matching.load_lexicon(spark)
    want = sorted(map(str, matching.match_terms(d, lexicon).collect()))
    monkeypatch.setattr(matching, "MOST_INLINE", 3)
    assert want and sorted(map(str, matching.match_terms(d, lexicon).collect())) == want


def test_ngram_scores_of_the_corpus(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.lang): r.score for r in registry.QUERIES["c2_ngram_language_scores"](spark, sf).collect()}
    assert {k for k, _ in got} == {k for k, t in docs.items() if len(t.strip(" ")) >= 10}
    part = {r[:2]: r[2] for r in by_sql("c2_ngram_language_scores", sf).fetchall()}
    assert part and all(got[k] == pytest.approx(x, abs=2e-6) for k, x in part.items())


def variants(term):
    out = {(term, "same")}
    for i, c in enumerate(term):
        out |= {(term[:i] + s + term[i + 1 :], "leet") for s in K.VARIANT_LEET.get(c, "")}
        if c in K.VARIANT_ELONGATED:
            out |= {(term[: i + 1] + c * n + term[i + 1 :], "elongated") for n in (2, 3, 4)}
    return out | {(term.replace(a, b), "phonetic") for a, b in K.VARIANT_PHONETIC.items() if a in term}


def test_variants_of_terms_of_all_lengths(spark, tmp_path):
    terms = "a", "of", "the", "quick", "phonetic", "kindnesses", "aaaaaaa", "z" * 40
    sf = saved(spark, tmp_path, [(1, " ".join(terms), "en", "s"), (2, "  the -- of", "en", "s"), (3, None, None, None), (4, "", "en", "s")])
    rows = registry.QUERIES["b16_expand_lexicon_variants"](spark, sf).collect()
    want = {(t, *v) for t in terms for v in variants(t)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert {tuple(r) for r in rows} == set(by_sql("b16_expand_lexicon_variants", sf).fetchall())


def test_token_offsets_of_long_texts(spark, sf, tmp_path):
    texts = ["the end, they \U0001f600 then \u0939 the. " * 3000, "a aa aaa", "x" * 2000, "", None, "1 2 3"]
    rows = registry.QUERIES["c9_token_offsets"](spark, saved(spark, tmp_path, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    want = []
    for i, text in enumerate(texts):
        at = 0
        for pos, token in enumerate(re.findall("[A-Za-z]+", text or "")):
            start = text.find(token, at)
            at = start + len(token)
            want.append((i, pos, start, at))
    assert sorted(map(tuple, rows)) == want
    part = set(by_sql("c9_token_offsets", sf).fetchall())
    assert part and part <= {tuple(r) for r in registry.QUERIES["c9_token_offsets"](spark, sf).collect()}
