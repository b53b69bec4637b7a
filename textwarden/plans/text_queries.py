"""Queries of text normalization, language and personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import language, normalize, pii
from textwarden.plans.common import spread, sql_text, table, values

Q: dict = {}


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def step(name, operator, expression):
    Q[name] = (
        lambda spark, sf: operator(docs(spark, sf)).select("doc_id", "text"),
        f"SELECT doc_id, {expression} AS text FROM documents" if expression else None,
    )


def sql_replaced(text, pairs):
    return reduce(lambda t, p: f"replace({t}, {sql_text(p[0])}, {sql_text(p[1])})", pairs.items(), text)


def sql_translate(text, old, new):
    return f"translate({text}, {sql_text(old)}, {sql_text(new)})"


SQL_HOMOGLYPHS = sql_replaced(
    sql_translate("text", K.HOMOGLYPHS_FROM + K.FULLWIDTH_FROM, K.HOMOGLYPHS_TO + K.FULLWIDTH_TO), K.ASTRAL_HOMOGLYPHS
)
SQL_PUNCTUATION = sql_translate(f"replace(text, '{K.ELLIPSIS}', '...')", K.PUNCTUATION_FROM, K.PUNCTUATION_TO)
SQL_SPACES = r"regexp_replace(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')"

step("b1_unicode_normalize", lambda d: normalize.unicode_normalize(d, "text", "NFC"), "nfc_normalize(text)")
step("b2_strip_zero_width", normalize.strip_zero_width, sql_translate("text", K.ZERO_WIDTH, ""))
step("b3_fold_homoglyphs", normalize.fold_homoglyphs, SQL_HOMOGLYPHS)
step("b4_fold_diacritics", normalize.fold_diacritics, None)
step("b5_normalize_punctuation", normalize.normalize_punctuation, SQL_PUNCTUATION)
step("b6_compress_repeats", normalize.compress_repeats, None)
step("b7_clean_whitespace", normalize.clean_whitespace, SQL_SPACES)
step("b9_replace_leet_patterns", normalize.replace_leet_patterns, reduce(
    lambda t, p: f"regexp_replace({t}, {sql_text('\\Q' + p[0] + '\\E')}, {sql_text(p[1])}, 'gi')", K.LEET_PATTERNS.items(), "text"))
step("b10_replace_leet_chars", normalize.replace_leet_chars, sql_translate("text", "".join(K.LEET_CHARS), "".join(K.LEET_CHARS.values())))
step("b11_normalize_phonetic", normalize.normalize_phonetic, sql_replaced("text", K.PHONETIC))
step("b12_normalize_elongation", normalize.normalize_elongation, None)
step("b13_normalize_substitutions", normalize.normalize_substitutions, sql_replaced("text", K.SUBSTITUTIONS))
Q["b8_normalize_corpus"] = (lambda spark, sf: normalize.normalize_corpus(docs(spark, sf)).select("doc_id", "normalized"), None)
Q["b14_obfuscation_map"] = (
    lambda spark, sf: normalize.obfuscation_map(docs(spark, sf)).select("doc_id", F.explode("obfuscation_map").alias("fragment", "replacement")),
    None,
)


Q["b15_obfuscation_prevalence"] = (
    lambda spark, sf: normalize.obfuscation_prevalence(docs(spark, sf), ["lang"]),
    """
SELECT lang, technique, count(*) AS n_docs FROM (
  SELECT lang, 'leet_speak' AS technique FROM documents WHERE regexp_matches(text, '[@!$+0135478]')
  UNION ALL SELECT lang, 'character_substitution' FROM documents WHERE regexp_matches(text, '[@!$+0135478]')
  UNION ALL SELECT lang, 'phonetic' FROM documents WHERE regexp_matches(lower(text), 'ph|ck|qu|x')
  UNION ALL SELECT lang, 'elongation' FROM (SELECT lang, string_split(text, '') AS l FROM documents)
    WHERE len(list_filter(range(1, len(l) - 1), lambda i: l[i] = l[i + 1] AND l[i] = l[i + 2] AND l[i] NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)))) > 0)
GROUP BY ALL""",
)


def words_of_labels(spark, sf):
    """All distinct runs of a-z in the texts, as a lexicon to expand."""
    words = docs(spark, sf).select(F.explode(F.split("text", r"[^a-z]+")).alias("term"))
    return words.where("term <> ''").distinct()


SQL_LEET = " UNION ALL ".join(
    f"SELECT term, substring(term, 1, i - 1) || '{s}' || substring(term, i + 1) AS variant, 'leet' AS kind FROM p WHERE lower(substring(term, i, 1)) = '{c}'"
    for c, signs in K.VARIANT_LEET.items() for s in signs
)
SQL_SOUND = " UNION ALL ".join(
    f"SELECT term, replace(lower(term), '{a}', '{b}'), 'phonetic' FROM t WHERE contains(lower(term), '{a}')" for a, b in K.VARIANT_PHONETIC.items()
)
Q["b16_expand_lexicon_variants"] = (
    lambda spark, sf: normalize.expand_lexicon_variants(words_of_labels(spark, sf)),
    f"""
WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(text, '[^a-z]+')) AS term FROM documents) WHERE term <> ''),
p AS (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM t)
SELECT DISTINCT * FROM (
  SELECT term, term AS variant, 'same' AS kind FROM t
  UNION ALL {SQL_LEET}
  UNION ALL SELECT term, substring(term, 1, i) || repeat(lower(substring(term, i, 1)), n) || substring(term, i + 1), 'elongated'
    FROM p, (VALUES (2), (3), (4)) v(n) WHERE contains('{K.VARIANT_ELONGATED}', lower(substring(term, i, 1)))
  UNION ALL {SQL_SOUND})""",
)

SQL_SHARES = ", ".join(
    f"length(regexp_replace(k, '[^\\x{{{lo:x}}}-\\x{{{hi:x}}}]', '', 'g'))::DOUBLE / length(k) AS {s}" for s, (lo, hi) in K.SCRIPTS.items()
)


def c1(spark, sf):
    rows = language.script_shares(docs(spark, sf))
    return rows.select("doc_id", *[F.round(F.coalesce(F.col("scripts")[s], F.lit(0.0)), 6).alias(s) for s in ("latin", "devanagari")])


Q["c1_script_shares"] = (
    c1,
    rf"""
WITH k AS (SELECT doc_id, regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g') AS k FROM documents)
SELECT doc_id, coalesce(round(latin, 6), 0.0) AS latin, coalesce(round(devanagari, 6), 0.0) AS devanagari
FROM (SELECT doc_id, {SQL_SHARES} FROM k WHERE length(k) > 0)""",
)
SQL_HITS = " + ".join(f"len(regexp_extract_all(low, '{p}'))" for p in K.HINGLISH)
SQL_ROMAN = " + ".join(f"len(regexp_extract_all(low, '{p}'))" for p in K.ROMANIZED)
Q["c3_hinglish_score"] = (
    lambda spark, sf: language.hinglish_score(docs(spark, sf)).select("doc_id", F.round("hinglish", 6).alias("hinglish")),
    rf"""
WITH d AS (SELECT doc_id, lower(text) AS low, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words
           FROM documents),
s AS (SELECT doc_id, least(({SQL_HITS} + ({SQL_ROMAN}) * 0.1) / words, 1.0) AS raw FROM d)
SELECT doc_id, round(CASE WHEN raw > 0.1 THEN raw ELSE 0.0 END, 6) AS hinglish FROM s""",
)


def c6(spark, sf):
    rows = language.script_shares(docs(spark, sf)).withColumn("confidence", F.coalesce(F.col("scripts")["latin"], F.lit(0.0)))
    return language.language_mix_report(rows, ["source"], "lang", "confidence")


Q["c6_language_mix_report"] = (
    c6,
    r"""
WITH k AS (SELECT source, lang, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS k FROM documents),
c AS (SELECT source, lang, CASE WHEN length(k) = 0 THEN 0 ELSE length(regexp_replace(k, '[^\x{20}-\x{7f}]', '', 'g'))::DOUBLE / length(k) END AS c FROM k)
SELECT source, lang AS code, CASE WHEN c >= .9 THEN 'very_high' WHEN c >= .7 THEN 'high' WHEN c >= .5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n
FROM c GROUP BY ALL""",
)
Q["c7_tokenize_corpus"] = (
    lambda spark, sf: language.tokenize_corpus(docs(spark, sf)).groupBy("doc_id", "token_type").agg(F.count("*").alias("n"), F.max("end").alias("last_end")),
    None,
)
Q["c8_regex_tokenize"] = (
    lambda spark, sf: language.regex_tokenize(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_distinct")),
    f"""
SELECT doc_id, count(*) AS n, count(DISTINCT token) AS n_distinct
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {sql_text(language.TOKEN)})) AS token FROM documents) GROUP BY doc_id""",
)
SQL_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(token, '^{'[A-Za-z]' if s == 'latin' else language.script_class(s, False)}') THEN '{s}'" for s in K.SCRIPTS) + " ELSE 'other' END"
Q["c10_tokens_by_script"] = (
    lambda spark, sf: language.tokens_by_script(language.regex_tokenize(docs(spark, sf)), ["doc_id"]),
    f"""
SELECT doc_id, {SQL_SCRIPT} AS script, count(*) AS n, count(DISTINCT token) AS distinct_tokens
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {sql_text(language.TOKEN)})) AS token FROM documents) GROUP BY ALL""",
)

SQL_MASKED = reduce(lambda t, p: f"regexp_replace({t}, {sql_text(p[2])}, {sql_text(p[1])}, 'g')", K.PII_PATTERNS, "text")
Q["d1_mask_pii"] = (
    lambda spark, sf: pii.mask_pii(docs(spark, sf)).select("doc_id", "masked", "pii_found"),
    f"SELECT doc_id, masked, masked <> text AS pii_found FROM (SELECT doc_id, text, {SQL_MASKED} AS masked FROM documents)",
)


def any_of(kind):
    return " OR ".join(f"regexp_matches(text, {sql_text(p)})" for k, _, p in K.PII_PATTERNS if k == kind)


Q["d2_detect_pii_types"] = (
    lambda spark, sf: pii.detect_pii_types(docs(spark, sf)).select("doc_id", F.array_join("pii_types", ",").alias("pii_types")),
    "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {any_of(k)} THEN '{k}' END" for k in pii.KINDS) + ") AS pii_types FROM documents",
)


def count_sql(kind):
    return " + ".join(f"len(regexp_extract_all(text, {sql_text(p)}))" for k, _, p in K.PII_PATTERNS if k == kind)


Q["d3_pii_counts"] = (
    lambda spark, sf: pii.pii_counts(docs(spark, sf), ["source"]),
    "SELECT source, " + ", ".join(f"sum({count_sql(k)})::BIGINT AS {k}" for k in pii.KINDS) + " FROM documents GROUP BY source",
)


def d4_sql():
    text, parts = "text", []
    for kind, mask, pattern in K.PII_PATTERNS:
        parts.append(f"SELECT doc_id, '{kind}' AS pii_type, unnest(regexp_extract_all({text}, {sql_text(pattern)})) AS value FROM documents")
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(mask)}, 'g')"
    return " UNION ALL ".join(parts)


Q["d4_extract_pii"] = (lambda spark, sf: pii.extract_pii(docs(spark, sf)), d4_sql())
Q["d5_mask_partial"] = (lambda spark, sf: pii.mask_partial(docs(spark, sf)).select("doc_id", "text"), None)
Q["d6_mask_nested"] = (
    lambda spark, sf: pii.mask_nested(docs(spark, sf).select("doc_id", F.struct("text", F.array("source", "text").alias("parts")).alias("row"))),
    None,
)
Q["d7_hash_text"] = (
    lambda spark, sf: pii.hash_text(docs(spark, sf)).select("doc_id", "text_hash", F.substring("text_hash", 1, 16).alias("short_hash")),
    "SELECT doc_id, sha256(text) AS text_hash, left(sha256(text), 16) AS short_hash FROM documents",
)
__all__ = ["Q", "values"]
