"""Personal data, toxicity, quality and URLs on cases, odd rows and held-out labels."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm import pii, quality, toxicity, url_filter

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The base spans by the contract's own patterns."""
    out = []
    for kind, pattern in RULES.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(RULES).index(s[0])))


def base(text):
    return [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-_ +()0123456789é"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_corpus_spans_equal_the_patterns(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert base(r.text) == brute(r.text)


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 THE END") == ["iban"]
    assert "iban" not in kinds("IBAN DE89 3704 0044 0532 0130 01")
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == []
    low, high = pii.spans_of("x 10.0.0.1")[0][3], pii.spans_of("server 10.0.0.1")[0][3]
    assert low < high


def test_pii_query_on_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "😀 a@b.co " * 3, 0), (3, "😀 a@b.co " * 3, 0), (None, "9" * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    out = pii.digests(df).collect()
    assert sorted(r.n_email for r in out) == [0, 0, 0, 3, 3]
    r = next(r for r in out if r.doc_id == 3)
    assert r.spans == "email:2:8,email:11:17,email:20:26" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert pii.digests(df.limit(0)).count() == 0


def test_masking_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "to a@b.co, +1 (555) 555-0100!"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert [r.text for r in pii.mask_pii(df).orderBy("doc_id").collect()] == ["to [EMAIL], [PHONE]!", "clean", None]


DOC = "doc_id long, text string, score string"
LABEL = "doc_id long, toxic int, quality int"


def labelled(spark):
    bad = [(i, f"word{i} fine here. you filthy scoundrel {i}. the end", "clash") for i in range(40)]
    good = [(100 + i, f"word{i} fine here. a nice day number {i}. the end", "clash") for i in range(200)]
    docs = spark.createDataFrame([*bad, *good, (900, None, ""), (901, "", ""), (902, "x. " * 20_000, ""), (None, "filthy scoundrel", "")], DOC)
    rows = [(i, 1, 1) for i, *_ in bad] + [(i, 0, 1) for i, *_ in good] + [(5, 1, 1), (None, 1, None)]
    return docs, spark.createDataFrame(rows, LABEL)


def test_toxicity_learns_and_locates(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.s for r in toxicity.score(docs.drop("score"), model).selectExpr("doc_id", "score AS s").collect()}
    assert all(scores[i] > 0.5 for i in range(40)) and all(scores[100 + i] < 0.3 for i in range(200))
    assert scores[900] == scores[901] == 0 and scores[902] < 0.3 and scores[None] > 0.5
    spots = toxicity.offending_sentences(docs, model).where("doc_id = 7").collect()
    assert [s.sentence.strip() for s in spots] == ["you filthy scoundrel 7"]


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    assert toxicity.train(docs, labels.limit(0)).score("anything") == 0
    assert toxicity.train(docs, labels.where("toxic = 1")).score("anything") == 1
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def auc(rows):
    """Share of (toxic, clean) pairs in which the toxic one scores higher; ties count half."""
    good, bad = ([s for s, y in rows if y == label] for label in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_noisy_or_of_sentences(spark):
    """A document's score is one minus the product of its sentences' complements, and a sentence's is the logistic of its words' weights."""
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)

    def plain(text):
        clean = 1.0
        for sentence in toxicity.SENTENCE.split(text):
            words = set(toxicity.WORD.findall(sentence.lower()))
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
            clean *= 1 - (1 / (1 + math.exp(-max(z, -60))) if z > model.bias else 0.0)
        return 1 - clean

    texts = ["you filthy scoundrel 7", "A calm day. you filthy scoundrel 3. And another.\nyou filthy scoundrel 9!", "nothing at all", "", "filthy filthy filthy. scoundrel"]
    for text in texts:
        assert model.score(text) == pytest.approx(plain(text), abs=1e-9)


def test_votes_of_the_nearest(spark):
    """A score is the mean label of the nearest labelled texts, weighted by a power of their cosines, a text's own left out."""
    r = random.Random(5)
    made = [(f"{r.choice(['Good', 'BAD', 'fine'])} {' '.join(r.choice(['calm words here', '!!! $$$', 'Plain text, really.', '###']) for _ in range(r.randint(3, 20)))} {k}", r.randint(0, 1)) for k in range(120)]
    model = quality.fit(made)
    texts = [t for t, _ in made[:15]] + ["Something new, quite plain.", "$$$ ### !!!"]
    got = model.scores(texts)
    z, every = (np.asarray(x, "f8") for x in (model.project(texts), model.vectors))
    for text, vector, score in zip(texts, z, got, strict=True):
        ranked = sorted(((float(vector @ v), y) for v, (t, y) in zip(every, made, strict=True) if t != text), key=lambda x: -x[0])
        if ranked[quality.NEAREST - 1][0] - ranked[quality.NEAREST][0] > 1e-5:  # else either may be among the nearest
            near = [(max(c, 0.0) ** quality.SHARPNESS, y) for c, y in ranked[: quality.NEAREST]]
            assert score == pytest.approx(sum(w * y for w, y in near) / sum(w for w, _ in near), abs=1e-4)


def test_url_features_equal_plain(spark):
    urls = ["http://a.b-c.example.net/x/y/z1?q=1&r=&s=3#f", "https://h", "", "mailto:x", "ftp://é.org/ü?x", "http://" + "a" * 5000 + ".com/" + "b/" * 2000]
    df = url_filter.lexical(url_filter.parted(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")))
    for row in df.collect():
        url, n = urls[row.page_id], len(urls[row.page_id])
        counts = [url.count(c) / n for c in set(url)]
        host, path = row.host, row.path
        assert row.url_length == n and row.host_length == len(host) and row.path_length == len(path)
        assert row.host_labels == len([x for x in host.split(".") if x]) and row.path_depth == path.count("/") and row.hyphens == url.count("-")
        assert row.digit_ratio == pytest.approx(sum(c in "0123456789" for c in url) / max(n, 1))
        assert row.entropy == pytest.approx(-sum(x * math.log2(x) for x in counts))
        assert row.parameters == len(re.findall("[?&][^?&#]", url)) and row.secure == url.startswith("https")
        assert row.suffix == ".".join(host.split(".")[-2:])


def test_held_out_toxicity_and_quality(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold out a handful of toxic documents only
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tox = toxicity.op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in tox)
    assert auc([(r.score, r.toxic) for r in tox]) > 0.93
    assert hits / sum(r.toxic for r in tox) > 0.85 and hits / sum(r.predicted for r in tox) > 0.85
    good = quality.op7_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in good) / len(good) > 0.95


def test_quality_votes(spark):
    good = [(i, f"A plain line of text, number {i}. It goes on and on, quietly.", "x") for i in range(30)]
    poor = [(100 + i, f"BUY!!! NOW!!! {i} $$$ ### !!!" * 3, "x") for i in range(30)]
    docs = spark.createDataFrame([*good, *poor, (900, None, ""), (901, "", "")], DOC)
    labels = spark.createDataFrame([(i, 0, 1) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)], LABEL)
    scores = {r.doc_id: r.s for r in quality.score(docs.drop("score"), quality.train(docs, labels)).selectExpr("doc_id", "score AS s").collect()}
    assert all(scores[i] > 0.5 for i in range(30)) and all(scores[100 + i] < 0.5 for i in range(30))
    assert scores[900] == scores[901] == pytest.approx(0.5)
    none = quality.train(docs, labels.limit(0))
    assert none.scores(["x"])[0] == 1.0 and quality.score(docs.limit(0), none).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q=1"), (2, "https://example.com/de/"), (3, "http://example.com/dex"), (4, "http://www.site.org/fr/1#t"),
        (5, "http://a.net"), (6, "mailto:x"), (7, None), (8, "http://fexample.com/de/1"), (9, "x://b.net/p"), (9, "x://b.net/p"), (10, "http://h?x=1#/y"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' AS host", "'c' AS rule")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge(df).collect())
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.com", "/de/", "example.com/de/", "block"), (3, "example.com", "/dex", None, None),
        (4, "www.site.org", "/fr/1", "org/fr/", "allow"), (5, "a.net", "", None, None), (6, "", "", None, None), (7, "", "", None, None),
        (8, "fexample.com", "/de/1", None, None), (9, "b.net", "/p", "net/", "block"), (9, "b.net", "/p", "net/", "block"), (10, "h", "", None, None),
    ]
    assert all(r.verdict in ("allow", "block") for r in url_filter.judge(df).collect())


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(df).collect()] == ["allow", "allow"]
    assert url_filter.judge(df.limit(0)).count() == 0
