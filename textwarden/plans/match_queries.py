"""Queries of lexicon matching, spans and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import context, engine, matching
from textwarden.plans.common import spread, sql_text, table, values

Q: dict = {}
LEX = values(matching.lexicon_rows(), "lang", "kind", "term", "category", "severity", "weight", "script", "context_required")


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def terms(spark, sf, texts=docs):
    return matching.match_terms(texts(spark, sf), matching.load_lexicon(spark))


#: Sentences with what the corpus has none of, one put at the end of each text in turn.
SPOKEN = (
    '. He said "you idiot" and left', ". According to them it was fuuck and shiiit, a b!tch", ". This training material on a harassment complaint is not for a stupid fool",
    ". A press release on the court filing and the policy review: 'die', she told us", ". कभी नहीं stupid", ". The legal brief is no incident report, moron",
)


def spoken(spark, sf):
    put = F.element_at(F.array(*map(F.lit, SPOKEN)), (F.pmod("doc_id", F.lit(len(SPOKEN))) + 1).cast("int"))
    return docs(spark, sf).withColumn("text", F.concat("text", put))


def over_spoken(sql: str) -> str:
    """SQL of a query, over those texts."""
    texts = f"SELECT * REPLACE (text || ([{', '.join(map(sql_text, SPOKEN))}])[doc_id % {len(SPOKEN)} + 1] AS text) FROM documents"
    body = sql.strip().removeprefix("WITH ").replace(" documents", " texts").replace("(documents", "(texts")
    return f"WITH texts AS ({texts})" + (", " if sql.strip().startswith("WITH ") else " ") + body


def located(pattern: str, of: str = "documents") -> str:
    """SQL: (doc_id, m, gap, start, "end") of a pattern's matches, by running sums over matches and the gaps before them."""
    p = sql_text(pattern)
    return f"""(SELECT doc_id, m, g AS gap, (upto - length(m))::INTEGER AS start, upto::INTEGER AS "end" FROM (
  SELECT doc_id, m, g, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (
    SELECT doc_id, unnest(a) AS m, unnest(p[1:len(a)]) AS g, unnest(range(1, len(a) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, {p}) AS a, string_split_regex(text, {p}) AS p FROM {of}))))"""


#: The same spans in SQL, as a common table expression.
SPANS = f"""
lex AS (SELECT * FROM {LEX}),
hit AS (SELECT doc_id, text, lex.lang AS term_lang, term, category, severity, weight, string_split(lower(text), term) AS parts
        FROM documents JOIN lex ON contains(lower(text), term)),
spans AS (
  SELECT doc_id, s AS start, s + length(term) AS "end", substring(text, s + 1, length(term)) AS text, category, severity, weight AS confidence,
         'lexicon:' || term_lang || ':' || term AS rule_source
  FROM (SELECT *, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(term))::INTEGER AS s
        FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM hit)))"""

Q["a4_load_lexicon"] = (
    lambda spark, sf: table(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("term"))
    .groupBy("term").agg(F.count("*").alias("n_docs")).join(matching.bounded(matching.load_lexicon(spark)), "term").select("term", "lang", "category", "severity", "weight", "n_docs"),
    f"""
WITH lex AS (SELECT * FROM {LEX}),
w AS (SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct(string_split_regex(lower(text), '[^a-z]+'))) AS term FROM documents) GROUP BY term)
SELECT term, lang, category, severity, weight, n_docs FROM w JOIN lex USING (term)""",
)
Q["e1_match_terms"] = (terms, f"WITH {SPANS} SELECT * FROM spans")
Q["e1_match_terms_whole_word"] = (
    lambda spark, sf: matching.match_terms(docs(spark, sf), matching.load_lexicon(spark), whole_word=True, lang_scoped=True).groupBy("doc_id", "category").agg(F.count("*").alias("n")),
    f"""
WITH lex AS (SELECT * FROM {LEX})
SELECT doc_id, category, count(*) AS n FROM (
  SELECT doc_id, category, unnest(regexp_extract_all(' ' || regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g') || ' ', '[^\\p{{L}}\\p{{N}}]' || term || '[^\\p{{L}}\\p{{N}}]'))
  FROM documents d JOIN lex ON contains(lower(text), term) AND d.lang = lex.lang)
GROUP BY ALL""",
)
SQL_PATTERNS = " UNION ALL ".join(
    f"SELECT doc_id, {sql_text(p)} AS pattern, {sql_text(c)} AS category, {sql_text(s)} AS severity, {w}::DOUBLE AS weight, len(regexp_extract_all(text, {sql_text('(?i)' + p)})) AS n FROM documents"
    for _, p, c, s, w in K.LEXICON_PATTERNS
)
Q["e2_match_patterns"] = (lambda spark, sf: matching.pattern_counts(spoken(spark, sf)), over_spoken(f"SELECT * FROM ({SQL_PATTERNS}) WHERE n > 0"))
Q["e2_pattern_spans"] = (
    lambda spark, sf: matching.match_patterns(spoken(spark, sf)).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars")),
    over_spoken(
        "SELECT category, count(*) AS n, sum(length(m))::BIGINT AS chars FROM ("
        + " UNION ALL ".join(f"SELECT {sql_text(c)} AS category, unnest(regexp_extract_all(text, {sql_text('(?i)' + p)})) AS m FROM documents" for _, p, c, _, _ in K.LEXICON_PATTERNS)
        + ") GROUP BY category"
    ),
)
Q["e3_match_fuzzy"] = (
    lambda spark, sf: matching.match_fuzzy(docs(spark, sf), matching.load_lexicon(spark)).select("doc_id", "word", "term", F.round("similarity", 6).alias("similarity"), "n"),
    f"""
WITH lex AS (SELECT term, list_distinct(list_filter(regexp_extract_all(term, '.'), lambda x: x <> '')) AS b FROM {LEX} WHERE length(term) >= 3),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS word FROM documents) WHERE length(word) >= 3 GROUP BY ALL),
u AS (SELECT word, list_distinct(regexp_extract_all(word, '.')) AS a FROM (SELECT DISTINCT word FROM w)),
s AS (SELECT word, term, (len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))
             + least(length(word), length(term))::DOUBLE / greatest(length(word), length(term))) / 2 AS similarity
      FROM u JOIN lex ON length(word) BETWEEN length(term) * 0.6 - 1e-9 AND length(term) / 0.6 + 1e-9)
SELECT doc_id, word, term, round(similarity, 6) AS similarity, n FROM w JOIN s USING (word) WHERE similarity >= 0.8 AND word <> term""",
)


#: SQL's levenshtein counts bytes, so a letter beyond ASCII becomes one sign that no ASCII term has; Hindi terms share no letter with the corpus.
for distance in (1, 2):
    Q[f"e3_match_edited_{distance}"] = (
        lambda spark, sf, distance=distance: matching.match_edited(docs(spark, sf), matching.load_lexicon(spark), distance).select("doc_id", "word", "term", "category", "distance", F.round("similarity", 6).alias("similarity"), "n"),
        f"""
WITH lex AS (SELECT DISTINCT term, category FROM {LEX} WHERE length(term) >= 3),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS word FROM documents) WHERE length(word) >= 3 GROUP BY ALL),
s AS (SELECT word, term, category, levenshtein(regexp_replace(word, '[^\x00-\x7F]', '#', 'g'), term)::INTEGER AS distance FROM (SELECT DISTINCT word FROM w), lex WHERE regexp_full_match(term, '[\x00-\x7F]*') AND abs(length(word) - length(term)) <= {distance})
SELECT doc_id, word, term, category, distance, round(1 - distance / greatest(length(word), length(term)), 6) AS similarity, n FROM w JOIN s USING (word) WHERE distance <= {distance} AND word <> term""",
    )


def with_emoji(spark, sf):
    """The corpus with signs put into some texts by rule, as it has none of its own."""
    sign = F.element_at(F.array(*[F.lit(s) for s in ("🖕", "kill 💀", "🍆 🍑", "凸", "ಠ_ಠ", "😡")]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    return docs(spark, sf).select("doc_id", "lang", "source", F.concat("text", F.lit(" "), sign, F.lit(" you")).alias("text"))


EMOJI_DOCS = "ed AS (SELECT doc_id, lang, source, text || ' ' || (['🖕', 'kill 💀', '🍆 🍑', '凸', 'ಠ_ಠ', '😡'])[doc_id % 6 + 1] || ' you' AS text FROM documents)"
SQL_EMOJI = values([r[:5] for r in K.EMOJI], "kind", "sign", "category", "severity", "weight")
EMOJI_MATCHES = f"""{EMOJI_DOCS}, em AS (SELECT * FROM {SQL_EMOJI}),
m AS (SELECT doc_id, emoji, kind, category, severity, weight AS confidence, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]+')) AS emoji FROM ed) JOIN em ON sign = emoji AND kind IN ('offensive', 'anger') GROUP BY ALL)"""


def a5(spark, sf):
    """Signs of the emoji lexicon with the texts that hold them."""
    signs = matching.load_emoji_lexicon(spark).where("kind <> 'combination'")
    lexicon = signs.select(F.col("kind").alias("lang"), F.col("sign").alias("term"), "category", "severity", "weight")
    found = matching.match_terms(with_emoji(spark, sf), lexicon).groupBy("text").agg(F.count_distinct("doc_id").alias("n_docs"))
    return found.join(matching.bounded(signs), found["text"] == signs["sign"]).select("kind", "sign", "category", "severity", "weight", "n_docs")


Q["a5_load_emoji_lexicon"] = (
    a5,
    f"WITH {EMOJI_DOCS}, em AS (SELECT * FROM {SQL_EMOJI}) SELECT kind, sign, category, severity, weight, count(*) AS n_docs FROM ed JOIN em ON kind <> 'combination' AND contains(text, sign) GROUP BY ALL",
)
Q["e4_match_emoji"] = (lambda spark, sf: matching.match_emoji(with_emoji(spark, sf), matching.load_emoji_lexicon(spark)), f"WITH {EMOJI_MATCHES} SELECT * FROM m")
Q["e5_match_kaomoji"] = (
    lambda spark, sf: matching.match_kaomoji(with_emoji(spark, sf), matching.load_emoji_lexicon(spark)),
    f"WITH {EMOJI_DOCS}, em AS (SELECT * FROM {SQL_EMOJI}) SELECT doc_id, sign, category, severity, weight AS confidence, (strpos(text, sign) - 1)::INTEGER AS start FROM ed JOIN em ON kind = 'kaomoji' AND contains(text, sign)",
)
Q["e6_match_emoji_combinations"] = (
    lambda spark, sf: matching.match_emoji_combinations(with_emoji(spark, sf)).select("doc_id", "pattern", "category", "weight"),
    f"WITH {EMOJI_DOCS}, em AS (SELECT * FROM {SQL_EMOJI}) SELECT doc_id, sign AS pattern, category, weight FROM ed JOIN em ON kind = 'combination' AND regexp_matches(text, '(?i)' || sign)",
)
DEDUPED = f"""{SPANS}, listed AS (SELECT doc_id, list({{'start': start, 'fin': "end", 'lighter': -confidence, 'text': text, 'category': category, 'severity': severity, 'rule_source': rule_source}}) AS l FROM spans GROUP BY doc_id),
deduped AS (SELECT doc_id, unnest(list_reduce(list_transform(list_sort(l), lambda x: [x]), lambda acc, x: CASE
  WHEN len(list_filter(acc, lambda k: k.start < x[1].fin AND x[1].start < k.fin)) = 0 THEN acc || x
  WHEN x[1].lighter < list_filter(acc, lambda k: k.start < x[1].fin AND x[1].start < k.fin)[1].lighter
  THEN list_transform(acc, lambda k: CASE WHEN k = list_filter(acc, lambda j: j.start < x[1].fin AND x[1].start < j.fin)[1] THEN x[1] ELSE k END) ELSE acc END)) AS s FROM listed)"""
Q["e8_dedupe_spans"] = (
    lambda spark, sf: matching.dedupe_spans(terms(spark, sf)),
    f"""WITH {DEDUPED} SELECT doc_id, s.start, s.fin AS "end", s.text, s.category, s.severity, -s.lighter AS confidence, s.rule_source FROM deduped""",
)
Q["e9_dedupe_exact_spans"] = (
    lambda spark, sf: matching.dedupe_exact_spans(terms(spark, sf)),
    f"""WITH {SPANS} SELECT doc_id, start, "end", text, category, severity, confidence, rule_source FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY confidence DESC, category, rule_source) AS r FROM spans) WHERE r = 1""",
)
SCORES = f"{SPANS}, scores AS (SELECT doc_id, category, least(avg(confidence), 1.0) AS score FROM spans GROUP BY ALL)"
Q["e11_lpe_category_scores"] = (
    lambda spark, sf: matching.lpe_category_scores(terms(spark, sf)).withColumn("score", F.round("score", 6)),
    f"WITH {SCORES} SELECT doc_id, category, round(score, 6) AS score FROM scores",
)
Q["e12_rule_traces"] = (
    lambda spark, sf: matching.rule_traces(terms(spark, sf)).select("doc_id", F.array_join("traces", "\n").alias("traces")),
    f"""WITH {SPANS} SELECT doc_id, string_agg(t, chr(10) ORDER BY t) AS traces FROM (
  SELECT DISTINCT doc_id, 'Rule: ' || rule_source || ' -> Category: ' || category || ' -> Weight: ' || format('{{:.2f}}', confidence) AS t FROM spans) GROUP BY doc_id""",
)


Q["e14_search_lexicon"] = (
    lambda spark, sf: terms(spark, sf).join(matching.bounded(matching.search_lexicon(matching.load_lexicon(spark), category="threat/violence", langs=["en"])), "category", "left_semi")
    .groupBy("category", "severity").agg(F.count_distinct("doc_id").alias("n_docs")),
    f"WITH {SPANS} SELECT category, severity, count(DISTINCT doc_id) AS n_docs FROM spans WHERE category = 'threat/violence' GROUP BY ALL",
)
Q["e15_lexicon_statistics"] = (
    lambda spark, sf: matching.lexicon_statistics(terms(spark, sf).select(F.split_part("rule_source", F.lit(":"), F.lit(2)).alias("lang"), "category", F.col("confidence").alias("weight")))
    .withColumn("avg_weight", F.round("avg_weight", 6)),
    f"WITH {SPANS} SELECT split_part(rule_source, ':', 2) AS lang, count(*) AS terms, count(DISTINCT category) AS categories, round(avg(confidence), 6) AS avg_weight FROM spans GROUP BY 1",
)
Q["e16_emoji_statistics"] = (
    lambda spark, sf: matching.emoji_statistics(matching.match_emoji(with_emoji(spark, sf), matching.load_emoji_lexicon(spark)), ["category"]),
    f"WITH {EMOJI_MATCHES} SELECT category, sum(n)::BIGINT AS total, sum(n) FILTER (kind = 'offensive')::BIGINT AS offensive, 0::BIGINT + coalesce(sum(n) FILTER (kind = 'anger'), 0)::BIGINT AS anger, coalesce(sum(n) FILTER (severity = 'high'), 0)::BIGINT AS high FROM m GROUP BY category".replace("sum(n) FILTER (kind = 'offensive')::BIGINT", "coalesce(sum(n) FILTER (kind = 'offensive'), 0)::BIGINT"),
)

NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"
WORDS = f"(SELECT *, lead(m) OVER w AS next, lead(gap) OVER w AS next_gap, lead(\"end\") OVER w AS next_end FROM {located(context.WORD + '+')} WINDOW w AS (PARTITION BY doc_id ORDER BY start))"
one_of = lambda words: "(" + ", ".join(sql_text(w) for w in words if " " not in w) + ")"
#: Cues by the words of a text; the Hindi phrases of several words are left to the tests.
CUES = f"""
words AS {WORDS},
cues AS (
  SELECT doc_id, 'english' AS kind, m AS cue, start, "end", 0.9::DOUBLE AS confidence FROM words WHERE lower(m) IN {one_of(K.NEGATIONS)}
  UNION ALL SELECT doc_id, 'hindi', m, start, "end", 0.9::DOUBLE FROM words WHERE lower(m) IN {one_of(K.HINDI_NEGATIONS)}
  UNION ALL SELECT doc_id, 'contraction', m || next_gap || next, start, next_end, 0.95::DOUBLE FROM words WHERE length(m) > 1 AND lower(m) LIKE '%n' AND next_gap = {sql_text("'")} AND lower(next) = 't'
  UNION ALL SELECT doc_id, 'prefix', m, start, "end", 0.7::DOUBLE FROM words WHERE regexp_matches(m, '^(?i)(?:{'|'.join(K.NEGATION_PREFIXES)})(?s:.)+$')
  UNION ALL SELECT doc_id, 'suffix', m, start, "end", 0.7::DOUBLE FROM words WHERE regexp_matches(m, '^(?i)(?s:.)+(?:{'|'.join(K.NEGATION_SUFFIXES)})$'))"""
PARTS = f"""{CUES},
scope AS (SELECT doc_id, kind, cue, start AS scope_start, ("end" + least(length(regexp_extract(substring(text, "end" + 1), '^(?:{NOT_WORD}*{context.WORD}+){{0,8}}')),
          length(regexp_extract(substring(text, "end" + 1), '^[^.!?;,]*'))))::INTEGER AS scope_end, confidence FROM cues JOIN documents USING (doc_id))"""
TOUCHED = f"""negated AS (SELECT s.doc_id, s.start, s."end", max(c.confidence) AS negation FROM (SELECT DISTINCT doc_id, start, "end" FROM spans) s JOIN scope c ON s.doc_id = c.doc_id AND start <= scope_end AND "end" >= scope_start GROUP BY ALL),
neg AS (SELECT doc_id, max(negation) AS neg FROM negated GROUP BY doc_id)"""


def scopes(spark, sf):
    return context.negation_scopes(context.negation_cues(docs(spark, sf)))


Q["f1_negation_cues"] = (
    lambda spark, sf: context.negation_cues(docs(spark, sf)).groupBy("doc_id", "kind", F.lower("cue").alias("cue")).agg(F.count("*").alias("n")),
    f"WITH {CUES} SELECT doc_id, kind, lower(cue) AS cue, count(*) AS n FROM cues GROUP BY ALL",
)
Q["f2_negation_scopes"] = (
    lambda spark, sf: scopes(spark, sf).select("doc_id", "kind", "cue", "scope_start", "scope_end"),
    f"WITH {PARTS} SELECT doc_id, kind, cue, scope_start, scope_end FROM scope",
)
Q["f3_negated_spans"] = (
    lambda spark, sf: context.negated_spans(terms(spark, sf), scopes(spark, sf)),
    f'WITH {SPANS}, {PARTS}, {TOUCHED} SELECT doc_id, start, "end", negation FROM negated',
)
QUOTES = ("\"[^\"]*\"", "'[^']*'", "«[^»]*»", "“[^”]*”")
Q["f4_direct_quotes"] = (
    lambda spark, sf: context.direct_quotes(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars")),
    "SELECT doc_id, count(*) AS n, sum(length(q))::BIGINT AS chars FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, {sql_text('(?s)' + q)})) AS q FROM documents" for q in QUOTES)
    + ") GROUP BY doc_id",
)
REPORTS = r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(K.REPORTING) + r")(?:[^\p{L}\p{N}_]|$)"
Q["f5_indirect_quotes"] = (
    lambda spark, sf: context.indirect_quotes(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n")),
    f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+')) AS s FROM documents) WHERE regexp_matches(s, {sql_text(REPORTS)}) GROUP BY doc_id",
)
Q["f6_third_party_references"] = (
    lambda spark, sf: context.third_party_references(spoken(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n")),
    over_spoken(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+')) AS s FROM documents) WHERE regexp_matches(s, {sql_text('(?i)' + '|'.join(K.THIRD_PARTY))}) GROUP BY doc_id"),
)


def quotes(spark, sf):
    return context.exploded_quotes(spoken(spark, sf), context.all_quotes_of)


def sql_quotes(of: str) -> str:
    """All quotes of a table of texts, and those that stay when two overlap, folded in order of start."""
    found = [f"SELECT doc_id, start, \"end\", 'direct' AS quote_type, 0.95::DOUBLE AS confidence FROM {located('(?s)' + q, of)}" for q in QUOTES]
    for pattern, kind, c in ((REPORTS, "indirect", 0.7), ("(?i)" + "|".join(K.THIRD_PARTY), "reported", 0.6)):
        found.append(f"SELECT doc_id, start, \"end\", '{kind}', {c}::DOUBLE FROM {located('[^.!?]+', of)} WHERE trim(m) <> '' AND regexp_matches(m, {sql_text(pattern)})")
    return f"""quotes AS ({' UNION ALL '.join(found)}),
sorted AS (SELECT doc_id, list(DISTINCT {{'start': start, 'less': -confidence, 'fin': "end", 'quote_type': quote_type}}) AS l FROM quotes GROUP BY doc_id),
resolved AS (SELECT doc_id, q.start, q.fin AS "end", q.quote_type, -q.less AS confidence FROM (
  SELECT doc_id, unnest(list_reduce(list_transform(list_sort(l), lambda x: [x]), lambda acc, x: CASE
    WHEN x[1].start >= acc[-1].fin THEN acc || x WHEN x[1].less < acc[-1].less THEN acc[:-2] || x ELSE acc END)) AS q FROM sorted))"""


QUOTED = """quoted AS (SELECT doc_id, start, "end", max((quotation, -qs, quote_type)) AS b FROM (
  SELECT s.doc_id, s.start, s."end", q.start AS qs, q.quote_type, q.confidence * CASE WHEN s.start >= q.start AND s."end" <= q."end" THEN 1 ELSE 0.8 END AS quotation
  FROM spans s JOIN resolved q ON s.doc_id = q.doc_id AND s.start < q."end" AND q.start < s."end") GROUP BY ALL)"""
Q["f7_resolve_quotes"] = (lambda spark, sf: context.resolve_quotes(quotes(spark, sf)), over_spoken(f'WITH {sql_quotes("documents")} SELECT doc_id, start, "end", quote_type, confidence FROM resolved'))


def with_quotes(spark, sf):
    """The corpus with a quoted lexicon term put at the end of each text, as it holds hardly any of its own."""
    return docs(spark, sf).withColumn("text", F.concat("text", F.lit('. He said "you idiot" and left.')))


def f8(spark, sf):
    d = with_quotes(spark, sf)
    every = context.exploded_quotes(d, context.all_quotes_of)
    return context.quoted_spans(matching.match_terms(d, matching.load_lexicon(spark)), context.resolve_quotes(every))


Q["f8_quoted_spans"] = (
    f8,
    f"""WITH qd AS (SELECT * REPLACE (text || '. He said "you idiot" and left.' AS text) FROM documents), {SPANS.replace('FROM documents', 'FROM qd')}, {sql_quotes('qd')}, {QUOTED}
SELECT doc_id, start, "end", round(b[1], 9) AS quotation, b[3] AS quote_type FROM quoted""",
)


def vocabulary(t):
    words = "|".join(sorted(dict.fromkeys(K.SAFE_CONTEXTS[t]), key=lambda w: (-len(w), w)))
    return f"[^\\p{{L}}\\p{{N}}_](?:{words})(?:[^\\p{{L}}\\p{{N}}_])"


SAFE = "doubled AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || ' ' AS low0 FROM documents)"
SQL_SAFE = "safe AS (SELECT doc_id, t AS context_type, hits, least(0.9, 0.3 + 0.2 * hits) AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS t, len(regexp_extract_all(low0, {sql_text(vocabulary(t).replace(' ', '  '))})) AS hits FROM doubled" for t in K.SAFE_CONTEXTS
) + ") WHERE hits > 0)"
Q["f9_safe_contexts"] = (
    lambda spark, sf: context.safe_contexts(spoken(spark, sf)).withColumn("confidence", F.round("confidence", 6)),
    over_spoken(f"WITH {SAFE}, {SQL_SAFE} SELECT doc_id, context_type, hits, round(confidence, 6)::DOUBLE AS confidence FROM safe"),
)
W = "CASE context_type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in K.SAFE_WEIGHTS.items()) + " END"
SQL_SAFE_DOC = f"safe_doc AS (SELECT doc_id, sum(confidence * {W}) / sum({W}) AS safe FROM safe GROUP BY doc_id)"
Q["f10_safe_context_modifiers"] = (
    lambda spark, sf: context.safe_context_modifiers(context.safe_contexts(spoken(spark, sf))).withColumn("safe", F.round("safe", 6)),
    over_spoken(f"WITH {SAFE}, {SQL_SAFE}, {SQL_SAFE_DOC} SELECT doc_id, round(safe, 6) AS safe FROM safe_doc"),
)


def contexts(spark, sf):
    return engine.document_contexts(spoken(spark, sf), matching.load_lexicon(spark))


SHARE = "CASE b[3] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in context.QUOTE_SHARE.items()) + " END"
MODIFIERS = f"""{SCORES}, {PARTS}, {SAFE}, {SQL_SAFE}, {SQL_SAFE_DOC}, {sql_quotes('documents')}, {QUOTED}, {TOUCHED},
quote_doc AS (SELECT doc_id, max(b[1]) AS quotation, max({SHARE}) AS most FROM quoted GROUP BY doc_id),
modifiers AS (SELECT doc_id, category, score, greatest(0.1, (1 - 0.7 * coalesce(neg, 0)) * (1 - coalesce(most, 0) * coalesce(quotation, 0)) * (1 - 0.8 * CASE WHEN category <> 'spam/scam' THEN coalesce(safe, 0) ELSE 0 END)) AS modifier
              FROM scores LEFT JOIN neg USING (doc_id) LEFT JOIN quote_doc USING (doc_id) LEFT JOIN safe_doc USING (doc_id))"""
Q["f11_context_modifiers"] = (
    lambda spark, sf: context.modifiers_of(contexts(spark, sf)).select("doc_id", "category", F.round("modifier", 6).alias("modifier")),
    over_spoken(f"WITH {MODIFIERS} SELECT doc_id, category, round(modifier, 6) AS modifier FROM modifiers"),
)
Q["f12_context_flags"] = (
    lambda spark, sf: context.flags_of(contexts(spark, sf)).select("doc_id", "has_negation", "has_quotation", "is_safe_context", *K.SAFE_CONTEXTS),
    over_spoken(
        f"WITH {MODIFIERS} SELECT d.doc_id, neg.neg IS NOT NULL AS has_negation, d.doc_id IN (SELECT doc_id FROM quotes) AS has_quotation, coalesce(max(confidence) >= 0.5, false) AS is_safe_context, "
        + ", ".join(f"coalesce(bool_or(context_type = '{t}'), false) AS {t}" for t in K.SAFE_CONTEXTS)
        + " FROM documents d LEFT JOIN neg USING (doc_id) LEFT JOIN safe USING (doc_id) GROUP BY d.doc_id, neg.neg"
    ),
)
ACTION = "CASE WHEN m < 0.3 THEN 'allow' WHEN m < 0.7 THEN 'review' WHEN s > 0.8 THEN 'block' WHEN s > 0.5 THEN 'review' ELSE 'allow' END"
Q["f13_recommended_action"] = (
    lambda spark, sf: context.recommended_in(contexts(spark, sf)),
    over_spoken(f"WITH {MODIFIERS} SELECT doc_id, {ACTION} AS action FROM (SELECT doc_id, round(avg(modifier), 9) AS m, round(max(score), 9) AS s FROM modifiers GROUP BY doc_id)"),
)


def adjusted(spark, sf):
    return context.adjusted_in(contexts(spark, sf))


N, Q_, S = K.DEFAULT_SENSITIVITY
SENS = values([(c, *v) for c, v in K.SENSITIVITY.items()], "category", "sn", "sq", "ss")
ADJUSTED = f"""{MODIFIERS}, sens AS (SELECT * FROM {SENS}),
c AS (SELECT doc_id, category, score, score * (1 - coalesce(neg, 0) * coalesce(sn, {N})) * (1 - coalesce(quotation, 0) * coalesce(sq, {Q_})) * (1 - coalesce(safe, 0) * coalesce(ss, {S})) AS c
      FROM scores LEFT JOIN sens USING (category) LEFT JOIN neg USING (doc_id) LEFT JOIN quote_doc USING (doc_id) LEFT JOIN safe_doc USING (doc_id)),
adj AS (SELECT doc_id, category, score AS original, least(1, greatest(0, CASE WHEN c < 0.1 THEN c * 1.1 WHEN c > 0.9 THEN c * 0.95 ELSE 1 / (1 + exp(-5 * (c - 0.5))) END)) AS adjusted FROM c)"""
Q["f14_adjust_confidence"] = (
    lambda spark, sf: adjusted(spark, sf).select("doc_id", "category", F.round("adjusted", 6).alias("adjusted"), F.round("factor", 6).alias("factor")),
    over_spoken(f"WITH {ADJUSTED} SELECT doc_id, category, round(adjusted, 6) AS adjusted, round(CASE WHEN original > 0 THEN adjusted / original ELSE 1 END, 6) AS factor FROM adj"),
)
SHIFT = values([(c, float(a), float(b)) for c, (a, b) in context.ACTION_SHIFTS.items()], "category", "b", "r")
ACTIONS = f"""{ADJUSTED}, act AS (SELECT doc_id, category, adjusted, CASE WHEN adjusted >= 0.8 + coalesce(b, 0) THEN 'block' WHEN adjusted >= 0.5 + coalesce(r, 0) THEN 'review' ELSE 'allow' END AS action
  FROM adj LEFT JOIN (SELECT * FROM {SHIFT}) USING (category))"""
Q["f15_category_actions"] = (
    lambda spark, sf: context.category_actions(adjusted(spark, sf)).select("doc_id", "category", "action"),
    over_spoken(f"WITH {ACTIONS} SELECT doc_id, category, action FROM act"),
)
Q["f16_contextual_decision"] = (
    lambda spark, sf: context.contextual_decision(context.category_actions(adjusted(spark, sf))).select("doc_id", "decision", F.round("confidence", 6).alias("confidence")),
    over_spoken(f"WITH {ACTIONS} SELECT doc_id, max_by(action, (round(adjusted, 12), category)) AS decision, round(max(adjusted), 6) AS confidence FROM act GROUP BY doc_id"),
)
Q["f17_adjustment_summary"] = (
    lambda spark, sf: context.adjustment_summary(adjusted(spark, sf)).select("category", "n", "n_adjusted", *[F.round(c, 6).alias(c) for c in ("mean_factor", "min_factor", "max_factor")]),
    over_spoken(f"""WITH {ADJUSTED}, f AS (SELECT *, CASE WHEN original > 0 THEN adjusted / original ELSE 1 END AS factor FROM adj)
SELECT category, count(*) AS n, count(*) FILTER (abs(adjusted - original) > 0.01) AS n_adjusted, round(avg(factor), 6) AS mean_factor, round(min(factor), 6) AS min_factor, round(max(factor), 6) AS max_factor FROM f GROUP BY category"""),
)
