"""Normalization, personal data and tokens, on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from textwarden.operators import language, normalize, pii


def one(spark, operator, text, col="text"):
    return operator(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()[col]


@pytest.mark.parametrize(
    ("operator", "text", "expected"),
    [
        (normalize.strip_zero_width, "id​i‍ot", "idiot"),
        (normalize.fold_homoglyphs, "раураl ＡＢｃ 𝐚", "paypal ABc a"),
        (normalize.normalize_punctuation, "“a” – b… c", '"a" - b... c'),
        (normalize.compress_repeats, "soooooo goood!!!!!", "sooo goood!!!"),
        (normalize.clean_whitespace, "  a \t\n b　c ", "a b c"),
        (normalize.replace_leet_patterns, "F*CK and M0r0n", "fuck and moron"),
        (normalize.replace_leet_chars, "h3ll0 w0r1d", "hello worid"),
        (normalize.normalize_phonetic, "phone quick fox", "fone kwik foks"),
        (normalize.normalize_elongation, "noooo", "noo"),
        (normalize.normalize_substitutions, "|-|()w", "how"),
        (normalize.fold_diacritics, "Æsop naïve ş", "AEsop naive s"),
        (normalize.unicode_normalize, "ﬁ", "fi"),
    ],
)
def test_steps(spark, operator, text, expected):
    assert one(spark, operator, text) == expected


def test_nulls_and_empty(spark):
    for operator in (normalize.strip_zero_width, normalize.fold_diacritics, normalize.compress_repeats, normalize.normalize_phonetic):
        assert one(spark, operator, None) is None
        assert one(spark, operator, "") == ""


def test_obfuscation_map(spark):
    found = one(spark, normalize.obfuscation_map, "th1s phone", "obfuscation_map")
    assert found == {"1": "i", "ph": "f"}


def test_masking_order_and_idempotence(spark):
    text = "mail a.b@c.org or call (555) 123-4567; 4532-1234-5678-9012; 10.0.0.1; 123-45-6789"
    rows = pii.mask_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    masked = rows.first()["masked"]
    assert masked == "mail [EMAIL] or call [PHONE]; [CARD]; [IP]; [ID]"
    again = pii.mask_pii(rows.select("doc_id", F.col("masked").alias("text"))).first()
    assert again["masked"] == masked and not again["pii_found"]


def test_partial_masks_keep_length(spark):
    out = one(spark, pii.mask_partial, "write john@site.org from 10.1.2.3")
    assert out == "write j***@site.org from ********"


def test_mask_nested(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 'x@y.org', 'b', array('10.0.0.1', 'z')) AS row, map('k', 'q@w.net') AS m")
    row = pii.mask_nested(df).first()
    assert row["row"]["a"] == "[EMAIL]" and row["row"]["b"] == ["[IP]", "z"] and row["m"] == {"k": "[EMAIL]"} and row["id"] == 1


def test_tokens_have_offsets(spark):
    text = "Don't pay 3.50 now 😀😀!"
    rows = language.tokenize_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.token, r.token_type) for r in rows] == [("Don't", "word"), ("pay", "word"), ("3.50", "number"), ("now", "word"), ("😀😀", "emoji"), ("!", "punctuation")]
    assert all(text[r.start : r.end] == r.token for r in rows)


def test_log_masks_of_every_kind(spark):
    cases = {
        "a b@c.io": "a *@c.io",
        "call +91-987-654-3210 now": "call +91" + "*" * 11 + "10 now",
        "id 123-45-6789.": "id " + "*" * 11 + ".",
        "pan ABCDE1234F": "pan " + "*" * 10,
        "aadhaar 1234 5678 9012": "aadhaar " + "*" * 14,
        "see https://a.b/c?d=1 there": "see " + "*" * 17 + " there",
        "k " + "a1" * 16: "k " + "*" * 32,
    }
    for text, want in cases.items():
        assert one(spark, pii.mask_partial, text) == want
