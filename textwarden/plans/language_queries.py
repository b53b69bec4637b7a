"""Queries of language detection, transliteration, emoji context and explanations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import context, language, matching, policy, preprocess
from textwarden.plans.common import sql_text, table, values
from textwarden.plans.decision_queries import rounded
from textwarden.plans.match_queries import ACTION, EMOJI_DOCS, LEX, MODIFIERS, SPANS, SQL_EMOJI, contexts, docs, located, over_spoken, with_emoji
from textwarden.plans.policy_queries import BASE, applied

Q: dict = {}


def b17(s, d):
    return rounded(preprocess.preprocessing_stats(preprocess.preprocess_corpus(docs(s, d)), ["source"]), "mean_shrink")


Q["b17_preprocess_corpus"] = (b17, None)
GRAMS = values([(lang, g, math.log(w + 1e-10)) for lang, grams in K.NGRAMS.items() for g, w in grams.items()], "lang", "g", "w")
Q["c2_ngram_language_scores"] = (
    lambda s, d: rounded(language.ngram_language_scores(docs(s, d)), "score"),
    f"""WITH t AS (SELECT doc_id, '<' || lower(text) || '>' AS t FROM documents WHERE length(trim(text)) >= 10),
p AS (SELECT doc_id, substring(t, i, n) AS g FROM (SELECT doc_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM t, (VALUES (2), (3), (4), (5)) v(n))),
tot AS (SELECT doc_id, count(*) AS total FROM p GROUP BY doc_id),
grams AS (SELECT * FROM {GRAMS}), langs AS (SELECT DISTINCT lang FROM grams),
hit AS (SELECT doc_id, lang, sum(w) AS s FROM p JOIN grams USING (g) GROUP BY ALL),
raw AS (SELECT doc_id, lang, coalesce(s, 0) / total AS raw FROM tot CROSS JOIN langs LEFT JOIN hit USING (doc_id, lang))
SELECT doc_id, lang, round(exp(raw) / sum(exp(raw)) OVER (PARTITION BY doc_id), 6) AS score FROM raw""",
)
Q["c4_detect_languages"] = (
    lambda s, d: language.detect_languages(docs(s, d)).select("doc_id", F.element_at("languages", 1)["code"].alias("code"), F.size("languages").alias("n")),
    None,
)
Q["c5_detect_per_segment"] = (lambda s, d: language.detect_per_segment(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_segments")), None)
Q["c9_token_offsets"] = (
    lambda s, d: language.token_offsets(docs(s, d).withColumn("tokens", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))), "tokens"),
    f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS pos, start, "end" FROM {located('[A-Za-z]+')}""",
)


def hindi(s, d):
    """The corpus with words of the dictionaries put into some texts by rule."""
    word = F.element_at(F.array(*map(F.lit, ("yaar main", "kutta", "bhai saala", "है और", "nothing"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return docs(s, d).select("doc_id", "lang", F.concat(F.lit(""), word, F.lit(" "), "text").alias("text"))


HINDI = "hd AS (SELECT doc_id, (['yaar main', 'kutta', 'bhai saala', 'है और', 'nothing'])[doc_id % 5 + 1] || ' ' || text AS text FROM documents)"
DICT = values([(k, r, n) for k, (r, n) in enumerate(K.TRANSLITERATION["hi"].items())], "ord", "roman", "native")
NATIVE = f"{HINDI}, dict AS (SELECT * FROM {DICT}), nat AS (SELECT doc_id, roman, native, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0b]+')) AS roman FROM hd) JOIN dict USING (roman) GROUP BY ALL)"
Q["c11_transliterate_to_native"] = (lambda s, d: language.transliterate_to_native(hindi(s, d)), f"WITH {NATIVE} SELECT * FROM nat")
Q["c12_transliterate_to_roman"] = (
    lambda s, d: language.transliterate_to_roman(hindi(s, d)),
    f"""WITH {HINDI}, dict AS (SELECT * FROM {DICT}), f AS (SELECT native, arg_min(roman, ord) AS roman FROM dict GROUP BY native)
SELECT doc_id, native, roman, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{{900}}-\\x{{97F}}]+')) AS native FROM hd) JOIN f USING (native) GROUP BY ALL""",
)
SPELT = " UNION ALL ".join(f"SELECT term, replace(term, '{a}', '{b}') AS variant FROM w" for a, b in K.SPELLING_VARIANTS.items())
Q["c13_transliteration_variants"] = (
    lambda s, d: language.transliteration_variants(docs(s, d).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))),
    f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) SELECT DISTINCT term, variant FROM (SELECT term, term AS variant FROM w UNION ALL {SPELT})",
)


def placed(s, d):
    rows = with_emoji(s, d)
    hits = matching.match_kaomoji(rows, matching.load_emoji_lexicon(s)).select("doc_id", "start", (F.col("start") + F.length("sign")).alias("end"))
    return matching.emoji_context(hits, rows)


NEAR = "substring(lower(text), greatest(start - 10, 0) + 1, e + 10 - greatest(start - 10, 0))"
Q["e7_emoji_context"] = (
    placed,
    f"""WITH {EMOJI_DOCS}, em AS (SELECT * FROM {SQL_EMOJI}), h AS (SELECT doc_id, text, (strpos(text, sign) - 1)::INTEGER AS start, (strpos(text, sign) - 1 + length(sign))::INTEGER AS e FROM ed JOIN em ON kind = 'kaomoji' AND contains(text, sign)),
f AS (SELECT doc_id, start, e, """ + ", ".join(f"regexp_matches({NEAR}, '{'|'.join(w)}') AS {k}" for k, w in K.EMOJI_CONTEXT.items()) + """ FROM h)
SELECT doc_id, start, e AS "end", profanity, violence, sexual, harassment, (profanity::INT + violence::INT + sexual::INT + harassment::INT) / 4 AS risk_score FROM f""",
)
Q["e10_match_transliterated"] = (
    lambda s, d: matching.match_transliterated(language.transliterate_to_native(hindi(s, d)), matching.load_lexicon(s)),
    f"""WITH {NATIVE}, lex AS (SELECT * FROM {LEX}) SELECT doc_id, roman, term, category, severity, weight AS confidence, 'lexicon:' || lang || ':' || term || ':transliterated:' || roman AS rule_source
FROM nat JOIN lex ON contains(native, term)""",
)


def e17(s, d):
    own = docs(s, d).select(
        F.concat(F.lit("t"), F.col("doc_id") % 3).alias("tenant"), F.lit("en").alias("lang"), F.lit("term").alias("kind"), F.lower(F.substring_index("text", " ", 1)).alias("term"),
        F.lit("spam/scam").alias("category"), F.lit("low").alias("severity"), F.lit(0.5).alias("weight"), F.lit(None).cast("string").alias("script"), F.lit(False).alias("context_required"),
    )
    return matching.overlay_lexicon(matching.load_lexicon(s), own).groupBy("tenant", "category").agg(F.count("*").alias("n"))


Q["e17_overlay_lexicon"] = (
    e17,
    f"""WITH lex AS (SELECT * FROM {LEX}), own AS (SELECT DISTINCT 't' || (doc_id % 3) AS tenant, 'en' AS lang, lower(split_part(text, ' ', 1)) AS term, 'spam/scam' AS category FROM documents),
every AS (SELECT DISTINCT tenant, lex.lang, lex.term, lex.category FROM (SELECT DISTINCT tenant FROM own), lex UNION SELECT * FROM own)
SELECT tenant, category, count(*) AS n FROM every GROUP BY ALL""",
)


def f18(s, d):
    return context.explained_in(contexts(s, d)).select("doc_id", F.array_join("lines", "|").alias("lines"))


LINES = ", ".join([f"CASE WHEN {f} THEN {sql_text(t)} END" for f, t in K.CONTEXT_SENTENCES.items()] + [f"CASE WHEN action = {sql_text(a)} THEN {sql_text(t)} END" for a, t in K.ACTION_SENTENCES.items()])
Q["f18_context_explanations"] = (
    f18,
    over_spoken(
        f"WITH {MODIFIERS}, act AS (SELECT doc_id, {ACTION} AS action FROM (SELECT doc_id, round(avg(modifier), 9) AS m, round(max(score), 9) AS s FROM modifiers GROUP BY doc_id)), "
        "fl AS (SELECT d.doc_id, neg.neg IS NOT NULL AS has_negation, d.doc_id IN (SELECT doc_id FROM quotes) AS has_quotation, "
        + ", ".join(f"coalesce(bool_or(context_type = '{t}'), false) AS {t}" for t in K.SAFE_CONTEXTS)
        + f" FROM documents d LEFT JOIN neg USING (doc_id) LEFT JOIN safe USING (doc_id) GROUP BY d.doc_id, neg.neg) SELECT doc_id, concat_ws('|', {LINES}) AS lines FROM fl LEFT JOIN act USING (doc_id)"
    ),
)
Q["h19_policy_trace_text"] = (
    lambda s, d: policy.policy_trace_text(applied(s, d)).select("doc_id", F.array_join("lines", "|").alias("lines")),
    f"""WITH {BASE} SELECT doc_id, concat_ws('|', 'Applied Policies:', '- ' || tenant, CASE WHEN hard_rule IS NOT NULL THEN '- hard rule ' || hard_rule END,
 CASE WHEN adjustment <> 0 THEN 'Threshold Adjustments:' END, CASE WHEN adjustment <> 0 THEN format('- {{}} by {{:.2f}}', CASE WHEN adjustment > 0 THEN 'increased' ELSE 'decreased' END, abs(adjustment)::DOUBLE) END) AS lines FROM applied""",
)
__all__ = ["Q", "SPANS", "sql_text", "table"]
