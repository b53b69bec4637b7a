"""Queries of classifier scores, calibration, ensemble decisions and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import align, decide, matching, policy, scores
from textwarden.operators.language import script_class
from textwarden.plans.common import sql_text, table, values
from textwarden.operators.context import QUOTE_SHARE
from textwarden.plans.match_queries import PARTS as CUE_PARTS
from textwarden.plans.match_queries import DEDUPED, QUOTED, SAFE, SCORES, SPANS, SQL_SAFE, SQL_SAFE_DOC, TOUCHED, docs, located, sql_quotes, terms
from textwarden.operators.engine import FIELDS, engine_terms, scanned_documents
from textwarden.plans.moderate import moderate_corpus
from textwarden.plans.text_queries import SQL_HITS, SQL_ROMAN

Q: dict = {}


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def logits(spark, sf):
    return scores.logits_from_vectors(table(spark, sf, "embeddings"))


NAMES = {h: "[" + ", ".join(map(sql_text, c)) + "]" for h, c in scores.HEADS.items()}
LOGITS = f"""e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
lg AS (SELECT doc_id, 'category' AS head, unnest({NAMES['category']}) AS class, unnest(e[1:8]) AS x FROM e
  UNION ALL SELECT doc_id, 'decision', unnest({NAMES['decision']}), unnest(e[9:11]) FROM e
  UNION ALL SELECT doc_id, 'severity', unnest({NAMES['severity']}), unnest(e[12:15]) FROM e),
soft AS (SELECT doc_id, head, class, x, exp(x) / sum(exp(x)) OVER (PARTITION BY doc_id, head) AS p FROM lg)"""
HEADW = values(
    [("category", c, v[1]) for c, v in K.CATEGORY_HEAD.items()]
    + [("decision", c, v[1]) for c, v in K.DECISION_HEAD.items()]
    + [("severity", c, v[1] * v[2]) for c, v in K.SEVERITY_HEAD.items()],
    "head", "class", "w",
)
MULTI = f"""{LOGITS}, hw AS (SELECT * FROM {HEADW}),
multi AS (SELECT doc_id, head, class, CASE WHEN head = 'category' THEN least(1.0, w / (1 + exp(-x)))
          ELSE p * w / sum(p * w) OVER (PARTITION BY doc_id, head) END AS p FROM soft JOIN hw USING (head, class))"""
Q["g2_softmax_heads"] = (lambda s, d: rounded(scores.softmax_heads(logits(s, d)), "p"), f"WITH {LOGITS} SELECT doc_id, head, class, round(p, 6) AS p FROM soft")
Q["g3_multi_head_scores"] = (lambda s, d: rounded(scores.multi_head_scores(logits(s, d)), "p"), f"WITH {MULTI} SELECT doc_id, head, class, round(p, 6) AS p FROM multi")
Q["g4_head_confidence"] = (
    lambda s, d: rounded(scores.head_confidence(scores.multi_head_scores(logits(s, d))), "category", "decision", "severity", "overall"),
    f"""WITH {MULTI}, t AS (SELECT doc_id, max(p) FILTER (head = 'category') AS category, max(p) FILTER (head = 'decision') AS decision, max(p) FILTER (head = 'severity') AS severity FROM multi GROUP BY doc_id)
SELECT doc_id, round(category, 6) AS category, round(decision, 6) AS decision, round(severity, 6) AS severity, round((category + decision + severity) / 3, 6) AS overall FROM t""",
)
LIMITS = values([(c, v[0]) for c, v in [*K.CATEGORY_HEAD.items(), *K.SEVERITY_HEAD.items()]], "class", "floor_")
Q["g5_predict_labels"] = (
    lambda s, d: scores.predict_labels(scores.multi_head_scores(logits(s, d))),
    f"""WITH {MULTI}, lim AS (SELECT * FROM {LIMITS})
SELECT doc_id, coalesce(string_agg(class, ',' ORDER BY class) FILTER (head = 'category' AND p >= floor_), '') AS categories,
  max_by(class, p) FILTER (head = 'decision') AS decision, coalesce(max_by(class, p) FILTER (head = 'severity' AND p >= floor_), 'low') AS severity
FROM multi LEFT JOIN lim USING (class) GROUP BY doc_id""",
)
T = {"category": 1.2, "decision": 1.1, "severity": 1.3}
CLIP = "greatest(1e-8, least(1 - 1e-8, p))"
TEMP = f"""z AS (SELECT *, ln({CLIP} / (1 - {CLIP})) / CASE head WHEN 'category' THEN 1.2 WHEN 'decision' THEN 1.1 ELSE 1.3 END AS z FROM soft),
cal AS (SELECT doc_id, head, class, exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id, head) AS q FROM z)"""
Q["g6_temperature_scale"] = (
    lambda s, d: rounded(scores.temperature_scale(scores.softmax_heads(logits(s, d)), T), "p"),
    f"WITH {LOGITS}, {TEMP} SELECT doc_id, head, class, round(q, 6) AS p FROM cal",
)
FACTORS = [(c, h, f) for c, fs in (("en", (1.0, 1.0, 1.0)), ("fr", (0.95, 0.97, 0.96)), ("de", (0.9, 0.92, 0.93)), ("es", (0.94, 0.96, 0.95))) for h, f in zip(scores.HEADS, fs, strict=True)]
Q["g7_language_calibration_factor"] = (
    lambda s, d: rounded(scores.language_calibration_factor(docs(s, d).select("doc_id", F.col("lang").alias("code")), s.createDataFrame(FACTORS, "code string, head string, factor double")), "factor"),
    f"SELECT doc_id, head, round(avg(factor), 6) AS factor FROM documents JOIN (SELECT * FROM {values(FACTORS, 'code', 'head', 'factor')}) f ON code = lang GROUP BY ALL",
)
ENT = """ent AS (SELECT doc_id, head, max(p) AS top, greatest(0, least(1, -sum(p * ln(p + 1e-10)) / ln(count(*)))) AS entropy, var_pop(p) AS variance FROM soft GROUP BY ALL)"""
Q["g8_confidence_from_distribution"] = (
    lambda s, d: rounded(scores.confidence_from_distribution(scores.softmax_heads(logits(s, d))), "confidence"),
    f"WITH {LOGITS}, {ENT} SELECT doc_id, head, round(greatest(0, least(1, top * (1 - entropy))), 6) AS confidence FROM ent",
)
Q["g9_reliability_and_shift"] = (
    lambda s, d: rounded(scores.reliability_and_shift(scores.softmax_heads(logits(s, d)), scores.temperature_scale(scores.softmax_heads(logits(s, d)), T), 1.2), "reliability", "shift"),
    f"WITH {LOGITS}, {TEMP} SELECT doc_id, head, round((exp(-0.2) + least(1, 4 * var_pop(p))) / 2, 6) AS reliability, round(avg(abs(p - q)), 6) AS shift FROM soft JOIN cal USING (doc_id, head, class) GROUP BY ALL",
)
Q["g10_uncertainty"] = (
    lambda s, d: rounded(scores.uncertainty(scores.softmax_heads(logits(s, d))), "epistemic", "aleatoric", "total", "lo", "hi"),
    f"""WITH {LOGITS}, {ENT}, u AS (SELECT *, least(1, variance / 0.25) AS a FROM ent), t AS (SELECT *, least(1, sqrt(entropy * entropy + a * a)) AS total FROM u)
SELECT doc_id, head, round(entropy, 6) AS epistemic, round(a, 6) AS aleatoric, round(total, 6) AS total, round(greatest(0, least(1, top - total / 2)), 6) AS lo, round(greatest(0, least(1, top + total / 2)), 6) AS hi FROM t""",
)


def labelled(s, d):
    """Labels beside two made-up component scores that follow from the documents' ids."""
    lab = table(s, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    one = F.least(F.lit(0.95), 0.1 + F.col("label") * 0.5 + (F.col("doc_id") % 40) / 100)
    two = 0.2 + (F.col("doc_id") % 7) / 10 - F.col("label") * 0.1
    parts = F.explode(F.array(F.struct(F.lit("lpe").alias("component"), one.alias("p")), F.struct(F.lit("classifier").alias("component"), two.alias("p")))).alias("x")
    return lab.select("doc_id", "label", parts).select("doc_id", "label", "x.component", "x.p")


LABELLED = """lab AS (SELECT doc_id, toxic AS label, 'lpe' AS component, least(0.95, 0.1 + toxic * 0.5 + (doc_id % 40) / 100) AS p FROM labels
  UNION ALL SELECT doc_id, toxic, 'classifier', 0.2 + (doc_id % 7) / 10 - toxic * 0.1 FROM labels)"""


def grid_sql(grid):
    return "(VALUES " + ", ".join(f"({g!r}::DOUBLE)" for g in grid) + ") g(t)"


GRID = [round(0.1 * k, 1) for k in range(1, 31)]
FINE = [round(0.1 + 0.05 * k, 2) for k in range(99)]


def fit_sql(by, grid):
    c = "greatest(1e-8, least(1 - 1e-8, {}))"
    p, q = c.format("p"), c.format("1 / (1 + exp(-z / t))")
    key = f"{by}, " if by else ""
    return f"""WITH {LABELLED}, z AS (SELECT *, ln({p} / (1 - {p})) AS z FROM lab),
f AS (SELECT {key}t, round(-avg(CASE WHEN label = 1 THEN ln({q}) ELSE ln(1 - {q}) END), 9) AS loss FROM z, {grid_sql(grid)} GROUP BY ALL)
SELECT {key}arg_min(t, (loss, t)) AS temperature, round(min(loss), 6) AS loss FROM f""" + (f" GROUP BY {by}" if by else "")


Q["g11_fit_temperature_nll"] = (lambda s, d: rounded(scores.fit_temperature(labelled(s, d), ["component"], FINE), "loss"), fit_sql("component", FINE))
Q["g12_fit_temperature_grid"] = (lambda s, d: rounded(scores.fit_temperature(labelled(s, d), ["component"], GRID), "loss"), fit_sql("component", GRID))
CUTS = [round(0.05 * k, 2) for k in range(1, 20)]
Q["g13_tune_thresholds"] = (
    lambda s, d: rounded(scores.tune_thresholds(labelled(s, d), ["component"], CUTS), "f1"),
    f"""WITH {LABELLED}, f AS (SELECT component, t, count(*) FILTER (p >= t AND label = 1) AS tp, count(*) FILTER (p >= t AND label = 0) AS fp, count(*) FILTER (p < t AND label = 1) AS fn FROM lab, {grid_sql(CUTS)} GROUP BY ALL),
r AS (SELECT component, t, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1 FROM f)
SELECT component, arg_max(t, (f1, -t)) AS threshold, round(max(f1), 6) AS f1 FROM r GROUP BY component""",
)
CORR = f"""{LABELLED}, c AS (SELECT component, greatest(0, coalesce(corr(p, label), 0)) AS c FROM lab GROUP BY component)"""
Q["h14_fit_weights"] = (
    lambda s, d: rounded(scores.fit_weights(labelled(s, d)), "weight"),
    f"WITH {CORR} SELECT component, round(CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER () ELSE 1 / count(*) OVER () END, 6) AS weight FROM c",
)
Q["h15_train_calibration"] = (
    lambda s, d: scores.fit_temperature(labelled(s, d), ["component"], GRID).select("component", "temperature").join(rounded(scores.fit_weights(labelled(s, d)), "weight"), "component"),
    f"SELECT component, temperature, weight FROM ({fit_sql('component', GRID)}) JOIN (WITH {CORR} SELECT component, round(c / sum(c) OVER (), 6) AS weight FROM c) USING (component)",
)
def g1(spark, sf):
    d, labels = docs(spark, sf), table(spark, sf, "labels")
    return rounded(scores.score_corpus(scores.train_classifier(d, labels), d), "p")


Q["g1_score_corpus"] = (g1, None)


def lpe(s, d):
    return matching.lpe_category_scores(terms(s, d))


def classifier(s, d):
    return scores.softmax_heads(logits(s, d)).where("head = 'category'").select("doc_id", F.col("class").alias("category"), F.col("p").alias("score"))


def parts(s, d):
    return decide.component_scores(docs(s, d), lpe(s, d), classifier(s, d))


PARTS = f"""{SCORES}, {LOGITS}, grid AS (SELECT doc_id, unnest({NAMES['category']}) AS category FROM documents),
parts AS (SELECT doc_id, 'lpe' AS component, category, coalesce(score, 0) AS score FROM grid LEFT JOIN scores USING (doc_id, category)
  UNION ALL SELECT g.doc_id, 'classifier', category, coalesce(p, 0) FROM grid g LEFT JOIN soft ON soft.doc_id = g.doc_id AND head = 'category' AND class = category)"""
Q["h1_component_scores"] = (lambda s, d: rounded(parts(s, d), "score"), f"WITH {PARTS} SELECT doc_id, component, category, round(score, 6) AS score FROM parts")
Q["h2_apply_modifiers"] = (
    lambda s, d: rounded(decide.apply_modifiers(parts(s, d), lpe(s, d).select("doc_id", "category", (1 - F.col("score") / 2).alias("modifier")), ["threat/violence"]), "score").select("doc_id", "component", "category", "score"),
    f"""WITH {PARTS} SELECT p.doc_id, component, p.category, round(greatest(0, least(1, p.score * coalesce(1 - s.score / 2, 1) * CASE WHEN p.category = 'threat/violence' THEN 0.3 ELSE 1 END)), 6) AS score
FROM parts p LEFT JOIN scores s ON s.doc_id = p.doc_id AND s.category = p.category""",
)
COMBINED = f"{PARTS}, comb AS (SELECT doc_id, category, sum(score * CASE component WHEN 'lpe' THEN 0.4 ELSE 0.5 END) / 0.9 AS score FROM parts GROUP BY ALL)"
combined = lambda s, d: decide.combine_scores(parts(s, d))
Q["h3_combine_scores"] = (lambda s, d: rounded(combined(s, d), "score"), f"WITH {COMBINED} SELECT doc_id, category, round(score, 6) AS score FROM comb")


def features(s, d):
    conf = docs(s, d).select("doc_id", F.when(F.col("lang") == "en", 0.9).otherwise(0.6).alias("confidence"))
    return decide.decision_features(docs(s, d), conf)


FEATURES = r"""feat AS (SELECT doc_id, length(text) AS length, regexp_matches(text, '[A-Za-z]') AND regexp_matches(regexp_replace(text, '\p{Latin}', '', 'g'), '\p{L}') AS code_mixed,
  regexp_matches(text, '[A-Za-z][@!$+0134578]+[A-Za-z]') AS obfuscated, CASE WHEN lang = 'en' THEN 0.9 ELSE 0.6 END AS lc FROM documents),
thr AS (SELECT *, 0.85 - CASE WHEN lc < 0.8 THEN (0.8 - lc) * 0.1 ELSE 0 END + CASE WHEN length < 50 THEN 0.05 WHEN length > 500 THEN -0.03 ELSE 0 END AS b,
  0.7 - CASE WHEN lc < 0.8 THEN (0.8 - lc) * 0.1 ELSE 0 END + CASE WHEN length < 50 THEN 0.03 WHEN length > 500 THEN -0.02 ELSE 0 END AS r FROM feat)"""
Q["h4_decision_features"] = (
    lambda s, d: features(s, d).select("doc_id", "length", "code_mixed", "obfuscated"),
    f"WITH {FEATURES} SELECT doc_id, length::INTEGER AS length, code_mixed, obfuscated FROM feat",
)
ADAPTED = f"""{COMBINED}, {FEATURES}, adapted AS (SELECT doc_id, category, greatest(0, least(1, score * CASE WHEN lc < 0.8 THEN 1 - (0.8 - lc) * 0.2 ELSE 1 END * CASE WHEN obfuscated THEN 1.1 ELSE 1 END * CASE WHEN code_mixed THEN 0.95 ELSE 1 END)) AS score FROM comb JOIN feat USING (doc_id))"""
adapted = lambda s, d: decide.adapt_scores(combined(s, d), features(s, d))
Q["h5_adapt_scores"] = (lambda s, d: rounded(adapted(s, d), "score"), f"WITH {ADAPTED} SELECT doc_id, category, round(score, 6) AS score FROM adapted")
Q["h6_adapt_thresholds"] = (
    lambda s, d: rounded(decide.adapt_thresholds(features(s, d)).select("doc_id", "block_at", "review_at"), "block_at", "review_at"),
    f"WITH {FEATURES} SELECT doc_id, round(b, 6)::DOUBLE AS block_at, round(r, 6)::DOUBLE AS review_at FROM thr",
)


def lexical(s, d):
    """Lexicon scores alone, for documents of all zones of the thresholds."""
    return lpe(s, d)


ZONE = """CASE WHEN m >= b THEN least(1, 0.7 + (m - b) * 2) WHEN m >= r THEN 0.5 + (m - r) / (b - r) * 0.3 ELSE least(1, 0.6 + (r - m) * 1.5) END"""
DECIDED = f"""{SCORES}, {FEATURES}, top AS (SELECT doc_id, round(max(score), 9) AS m FROM scores GROUP BY doc_id),
dec AS (SELECT doc_id, m, CASE WHEN m >= round(b, 9) THEN 'block' WHEN m >= round(r, 9) THEN 'review' ELSE 'allow' END AS decision,
  greatest(0.1, least(1, ({ZONE}) * CASE WHEN lc < 0.8 THEN 0.9 ELSE 1 END * CASE WHEN obfuscated THEN 0.95 ELSE 1 END * CASE WHEN code_mixed THEN 0.92 ELSE 1 END)) AS confidence FROM top JOIN thr USING (doc_id))"""
decided = lambda s, d: decide.decide(lexical(s, d), decide.adapt_thresholds(features(s, d)))
Q["h7_decide"] = (lambda s, d: rounded(decided(s, d), "confidence", "max_score"), f"WITH {DECIDED} SELECT doc_id, decision, round(confidence, 6) AS confidence, round(m, 6) AS max_score FROM dec")
Q["h8_decide_static"] = (
    lambda s, d: rounded(decide.decide_static(lexical(s, d)), "confidence"),
    f"""WITH {SCORES}, top AS (SELECT doc_id, round(max(score), 9) AS m FROM scores GROUP BY doc_id)
SELECT doc_id, CASE WHEN m >= 0.85 THEN 'block' WHEN m >= 0.7 THEN 'review' ELSE 'allow' END AS decision,
  round(greatest(0.6, CASE WHEN m >= 0.85 THEN least(1, m / 0.85) WHEN m >= 0.7 THEN greatest(0.5, 1 - least(abs(m - 0.7), abs(m - 0.85)) * 2) ELSE least(1, (0.7 - m) / 0.7) END), 6) AS confidence FROM top""",
)
SEVERITY = f"""sev AS (SELECT doc_id, c AS top_category, CASE WHEN s >= 0.9 OR (c IN ({', '.join(map(sql_text, K.CRITICAL_CATEGORIES))}) AND s >= 0.7) THEN 'critical' WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT doc_id, max(round(score, 9)) AS s, arg_max(category, (round(score, 9), category)) AS c FROM scores GROUP BY doc_id))"""
Q["h9_severity"] = (lambda s, d: decide.severity(lexical(s, d)), f"WITH {SCORES}, {SEVERITY} SELECT * FROM sev")
MERGED = f"""{SPANS}, folded AS (SELECT doc_id, unnest(list_reduce(list_transform(list_sort(l), lambda x: [x]), lambda acc, x: CASE
  WHEN (least(acc[-1].fin, x[1].fin) - greatest(acc[-1].start, x[1].start))::DOUBLE / least(acc[-1].fin - acc[-1].start, x[1].fin - x[1].start) >= 0.3
  THEN acc[:-2] || [{{'start': least(acc[-1].start, x[1].start), 'fin': greatest(acc[-1].fin, x[1].fin), 'text': CASE WHEN length(x[1].text) > length(acc[-1].text) THEN x[1].text ELSE acc[-1].text END,
    'category': CASE WHEN x[1].confidence > acc[-1].confidence THEN x[1].category ELSE acc[-1].category END, 'confidence': (acc[-1].confidence + x[1].confidence) / 2}}]
  ELSE acc || x END)) AS s FROM (SELECT doc_id, list({{'start': start, 'fin': "end", 'text': text, 'category': category, 'confidence': confidence}}) AS l FROM spans GROUP BY doc_id))"""
Q["h10_consolidate_spans"] = (
    lambda s, d: rounded(decide.consolidate_spans(terms(s, d)), "confidence"),
    f"""WITH {MERGED} SELECT doc_id, s.start, s.fin AS "end", s.text, s.category, round(s.confidence, 6) AS confidence FROM folded
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s.confidence DESC, s.start, s.fin, s.text, s.category) <= 10""",
)
lengths = lambda s, d: docs(s, d).select("doc_id", F.length("text").alias("length"))
HYBRID = "confidence * (0.7 + 0.3 * coalesce(w, 0.5)) * (1 + 0.05 * (1 - start / nullif(length(d.text), 0))) * least(1.2, 1 + (\"end\" - start - 5) * 0.01)"
CATW = values([(c, v[2]) for c, v in K.CATEGORY_HEAD.items()], "category", "w")
Q["h11_rank_spans"] = (
    lambda s, d: decide.rank_spans(terms(s, d), lengths(s, d), "hybrid").select("doc_id", "start", "end", "rule_source", "rank"),
    f"""WITH {SPANS} SELECT doc_id, start, "end", rule_source, rank FROM (SELECT s.doc_id, start, "end", rule_source, row_number() OVER (PARTITION BY s.doc_id ORDER BY round({HYBRID}, 9) DESC, start, "end", rule_source)::INTEGER AS rank
FROM spans s JOIN documents d USING (doc_id) LEFT JOIN (SELECT * FROM {CATW}) USING (category))""",
)


def outcomes(s, d):
    kind = F.element_at(F.array(*[F.lit(c) for c in decide.WEIGHTS]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(s, d, "events").select(F.col("event_id").alias("outcome_id"), kind.alias("component"), "ts", (F.col("event_type") != "error").alias("correct"), (F.col("value") / 500).alias("confidence"))


OUT = """o AS (SELECT event_id AS outcome_id, (['lpe', 'classifier', 'intent'])[event_id % 3 + 1] AS component, ts, event_type <> 'error' AS correct, value / 500 AS confidence FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, outcome_id DESC) AS rn FROM o)"""
Q["h12_adaptive_weights"] = (
    lambda s, d: rounded(decide.adaptive_weights(outcomes(s, d)), "weight"),
    f"""WITH {OUT}, p AS (SELECT component, avg(CASE WHEN correct THEN confidence ELSE 1 - confidence END) AS s FROM ranked WHERE rn <= 100 GROUP BY component),
w AS (SELECT component, greatest(0.05, CASE component WHEN 'lpe' THEN 0.4 WHEN 'classifier' THEN 0.5 ELSE 0.1 END * (0.8 + 0.4 * s / avg(s) OVER ())) AS w FROM p)
SELECT component, round(w / sum(w) OVER (), 6) AS weight FROM w""",
)
Q["h13_component_performance"] = (
    lambda s, d: rounded(decide.component_performance(outcomes(s, d)), "accuracy", "avg_confidence"),
    f"WITH {OUT} SELECT component, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS avg_confidence, count(*) AS n FROM ranked WHERE rn <= 1000 GROUP BY component",
)
CONTRIB = f"""{PARTS}, contrib AS (SELECT doc_id, component, CASE component WHEN 'lpe' THEN 0.4 ELSE 0.5 END AS weight, max(score) AS confidence,
  coalesce(string_agg(category, ',' ORDER BY category) FILTER (score > 0.3), '') AS categories FROM parts GROUP BY ALL)"""
Q["h16_component_contributions"] = (
    lambda s, d: rounded(decide.component_contributions(parts(s, d)), "confidence"),
    f"WITH {CONTRIB} SELECT doc_id, component, weight::DOUBLE AS weight, round(confidence, 6) AS confidence, categories FROM contrib",
)


def h17(s, d):
    full = decided(s, d).join(decide.severity(lexical(s, d)), "doc_id")
    return decide.explain(full, decide.component_contributions(parts(s, d))).select("doc_id", F.size("lines").alias("n_lines"), F.element_at("lines", 1).alias("head"))


Q["h17_explain"] = (
    h17,
    f"""WITH {DECIDED}, {SEVERITY} SELECT doc_id, 3 AS n_lines, format('Decision {{}} at confidence {{:.2f}}, severity {{}}', decision, confidence, severity) AS head FROM dec JOIN sev USING (doc_id)""",
)
Q["h18_attribution_report"] = (
    lambda s, d: rounded(decide.attribution_report(decide.component_contributions(parts(s, d))), "share"),
    f"""WITH {CONTRIB}, t AS (SELECT *, sum(weight * confidence) OVER (PARTITION BY doc_id) AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM contrib)
SELECT doc_id, component, round(CASE WHEN t > 0 THEN weight * confidence / t ELSE 1.0 / n END, 6) AS share FROM t""",
)
Q["h20_degrade_missing_components"] = (
    lambda s, d: decide.degrade_missing_components(docs(s, d), {"lpe": lpe(s, d), "classifier": classifier(s, d)}).select("doc_id", F.array_join("component_errors", ",").alias("component_errors")),
    f"""WITH {SCORES} SELECT doc_id, concat_ws(',', CASE WHEN doc_id NOT IN (SELECT doc_id FROM scores) THEN 'lpe' END, CASE WHEN doc_id NOT IN (SELECT vec_id FROM embeddings) THEN 'classifier' END) AS component_errors FROM documents""",
)


def h21(s, d):
    full = decided(s, d).join(decide.severity(lexical(s, d)), "doc_id")
    return rounded(decide.build_response(full, lexical(s, d)), "confidence")


Q["h21_build_response"] = (
    h21,
    f"""WITH {DECIDED}, {SEVERITY}, c AS (SELECT doc_id, string_agg(category, ',' ORDER BY category) AS categories FROM scores WHERE score > 0.5 GROUP BY doc_id)
SELECT doc_id, decision, round(confidence, 6) AS confidence, severity, coalesce(categories, '') AS categories FROM dec JOIN sev USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
#: What makes texts hold disguises and signs, as the corpus has none of its own; one for each document in turn.
DISGUISED = ("you 1d1ot", "an id​iot", "idiоt and idiiiiot", "f*ck this", "phuck |-|ell", "\U0001f595 you", "kill \U0001f480", "saala", "455 a55hole", "not a stüpid one", "ಠ_ಠ", "nothing")
WORDS_ = [dict(zip(FIELDS, (r[0], *r[2:6]), strict=True)) for r in matching.lexicon_rows()]
SIGNS_ = [dict(zip(FIELDS, r[:5], strict=True)) for r in K.EMOJI if r[0] != "combination"]
ENGINE_TERMS = values([(t["term"], align.form_of(t["term"]), t["category"], t["severity"], t["weight"], f"{t['source']}:{t['term']}") for t in engine_terms(WORDS_, SIGNS_)], "term", "form", "category", "severity", "weight", "source")
ENGINE_PATTERNS = [*K.LEXICON_PATTERNS, *[("emoji", *r[1:5]) for r in K.EMOJI if r[0] == "combination"]]


def nested(text, pairs):
    for old, new in pairs:
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    return text


HIDDEN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in K.ZERO_WIDTH) + r"\x{300}-\x{36f}]"
DRAWN = "|".join(f"{chr(c)}{{3,}}" for c in range(97, 123))
MARKS = {s: chr(0xE000 + k) for k, s in enumerate(align.SOUNDS)}  # in whose place the sounds' outcomes are put at the end
SOUND_ALTERNATIVES = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in align.SOUNDS)
FOLDED = nested(f"lower(translate(translate(bared, {sql_text(K.HOMOGLYPHS_FROM + K.FULLWIDTH_FROM)}, {sql_text(K.HOMOGLYPHS_TO + K.FULLWIDTH_TO)}), {sql_text(K.DIACRITICS_FROM)}, {sql_text(K.DIACRITICS_TO)}))", K.LEET_PATTERNS.items())
FOLDED = f"translate({FOLDED}, {sql_text(''.join(K.LEET_CHARS))}, {sql_text(''.join(K.LEET_CHARS.values()))})"
SOUNDED = nested(nested("text", MARKS.items()), [(m, align.SOUNDS[s]) for s, m in MARKS.items()])


def edits_sql(of: str, pattern: str, length: str) -> str:
    """SQL: a step's edits, by running sums of how much they shift what follows."""
    return f"""(SELECT doc_id, start AS old, "end" AS old_end, "end" + shift - n AS new, "end" + shift AS new_end FROM (
      SELECT *, sum(n - length(m)) OVER (PARTITION BY doc_id ORDER BY start) AS shift FROM (SELECT *, ({length}) AS n FROM {located(pattern, of)})))"""


def back_sql(of: str, edits: str) -> str:
    """SQL: ranges of a step's new text as ranges of its old one, by the last edit before each end."""
    return f"""(SELECT r.* EXCLUDE (s, e), CASE WHEN a.new IS NULL THEN s WHEN s < a.new_end THEN a.old ELSE s - a.new_end + a.old_end END AS s,
      CASE WHEN b.new IS NULL THEN e WHEN e - 1 < b.new_end THEN b.old_end ELSE e - b.new_end + b.old_end END AS e
    FROM {of} r ASOF LEFT JOIN {edits} a ON a.doc_id = r.doc_id AND r.s >= a.new ASOF LEFT JOIN {edits} b ON b.doc_id = r.doc_id AND r.e - 1 >= b.new)"""


def form_sql(k: int) -> str:
    """SQL: terms found in one of the matchable forms, with the raw places."""
    text = "text"
    for c in map(chr, range(97, 123)):
        text = f"regexp_replace({text}, '{c}{{3,}}', '{c * k}', 'g')"
    sound_n = "CASE m " + " ".join(f"WHEN {sql_text(s)} THEN {len(v)}" for s, v in align.SOUNDS.items()) + " END"
    return f"""short{k} AS MATERIALIZED (SELECT doc_id, {text} AS text FROM folded{"" if k == 2 else f" WHERE regexp_matches(text, '{DRAWN}')"}),
form{k} AS MATERIALIZED (SELECT doc_id, {SOUNDED} AS text FROM short{k}),
sound{k} AS MATERIALIZED {edits_sql(f"short{k}", SOUND_ALTERNATIVES, sound_n)},
drawn{k} AS MATERIALIZED {edits_sql("folded", DRAWN, str(k))},
at{k} AS (SELECT doc_id, category, severity, weight, source, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(form))::INTEGER AS s, length(form) AS n FROM (
  SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, form, category, severity, weight, source, string_split(text, form) AS parts FROM form{k} JOIN eng ON contains(text, form)))),
back{k} AS (SELECT doc_id, s AS start, e AS "end", category, severity, weight AS confidence, source FROM {back_sql(back_sql(back_sql(f"(SELECT * EXCLUDE (n), s + n AS e FROM at{k})", f"sound{k}"), f"drawn{k}"), "hidden")})"""


SHARE = "CASE b[3] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTE_SHARE.items()) + " END"
LANGUAGE_PARTS = [(code, f"coalesce(length(regexp_replace(k, '{script_class(script)}', '', 'g'))::DOUBLE / nullif(length(k), 0), 0) * {weight} * 0.7") for script, codes in K.SCRIPT_LANGUAGES.items() for code, weight in codes]
LATIN = f"coalesce(length(regexp_replace(k, '{script_class('latin')}', '', 'g'))::DOUBLE / nullif(length(k), 0), 0) > 0.05"
LANGUAGES = rf"""
hing AS (SELECT doc_id, CASE WHEN raw > 0.1 THEN raw ELSE 0.0 END AS h FROM (SELECT doc_id, least(({SQL_HITS} + ({SQL_ROMAN}) * 0.1) / words, 1.0) AS raw
  FROM (SELECT doc_id, lower(text) AS low, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words FROM documents))),
k AS (SELECT doc_id, h, regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g') AS k FROM documents JOIN hing USING (doc_id)),
cand AS ({' UNION ALL '.join(f"SELECT doc_id, '{code}' AS code, {c} AS c FROM k" for code, c in LANGUAGE_PARTS)}
  UNION ALL SELECT doc_id, 'hi-Latn', CASE WHEN {LATIN} AND h > 0.15 THEN least(0.9, 0.3 + h) * 0.8 ELSE 0 END FROM k UNION ALL SELECT doc_id, 'en', CASE WHEN {LATIN} AND h <= 0.15 THEN 0.9 * 0.8 ELSE 0 END FROM k),
lang AS (SELECT doc_id, coalesce(arg_min(code, (-least(0.95, c), code)) FILTER (c > 0.1), 'en') AS language, coalesce(max(least(0.95, c)) FILTER (c > 0.1), 0.5) AS lc FROM cand GROUP BY doc_id)"""
#: Every step of the flagship, as joins of long tables: forms and places, terms and patterns, cues, quotes, contexts, languages, scores, thresholds.
ENGINE_SPANS = rf"""eng AS (SELECT * FROM {ENGINE_TERMS}),
bared AS (SELECT doc_id, {nested(f"regexp_replace(text, '{HIDDEN}', '', 'g')", K.LIGATURES.items())} AS bared FROM documents),
folded AS MATERIALIZED (SELECT doc_id, {FOLDED} AS text FROM bared),
hidden AS MATERIALIZED {edits_sql("documents", HIDDEN + "+|" + "|".join(K.LIGATURES), f"CASE WHEN m IN ({', '.join(map(sql_text, K.LIGATURES))}) THEN 2 ELSE 0 END")},
{form_sql(2)}, {form_sql(1)},
plain AS (SELECT doc_id, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(term))::INTEGER AS s, term, category, severity, weight, source FROM (
  SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, term, category, severity, weight, source, string_split(lower(text), term) AS parts FROM documents JOIN eng ON contains(lower(text), term)))),
placed AS (SELECT doc_id, s::BIGINT AS start, (s + length(term))::BIGINT AS "end", category, severity, weight AS confidence, source FROM plain
  UNION ALL SELECT b.doc_id, b.start::BIGINT, b."end"::BIGINT, category, severity, confidence, source FROM (SELECT * FROM back2 UNION ALL SELECT * FROM back1) b JOIN documents d ON d.doc_id = b.doc_id WHERE regexp_matches(substring(text, b.start::INTEGER + 1, (b."end" - b.start)::INTEGER), '\p{{L}}')
  {"".join(f" UNION ALL SELECT doc_id, start, \"end\", {sql_text(c)}, {sql_text(v)}, {w}::DOUBLE, {sql_text(f'pattern:{g}:{p}')} FROM {located('(?i)' + p)}" for g, p, c, v, w in ENGINE_PATTERNS)}),
spans AS (SELECT DISTINCT p.doc_id, start::INTEGER AS start, "end"::INTEGER AS "end", substring(text, start::INTEGER + 1, ("end" - start)::INTEGER) AS text, category, severity, confidence, source AS rule_source FROM placed p JOIN documents d ON d.doc_id = p.doc_id)"""
MODERATED = rf"""{LANGUAGES}, {ENGINE_SPANS},
scores AS (SELECT doc_id, category, least(avg(confidence), 1.0) AS score FROM spans GROUP BY doc_id, category),
{CUE_PARTS}, {TOUCHED}, {sql_quotes('documents')}, {QUOTED}, {SAFE}, {SQL_SAFE}, {SQL_SAFE_DOC},
quote_doc AS (SELECT doc_id, max(b[1]) AS quotation, max({SHARE}) AS most FROM quoted GROUP BY doc_id),
kept AS (SELECT doc_id, category, score * greatest(0.1, (1 - 0.7 * coalesce(neg, 0)) * (1 - coalesce(most, 0) * coalesce(quotation, 0)) * (1 - 0.8 * CASE WHEN category <> 'spam/scam' THEN coalesce(safe, 0) ELSE 0 END)) AS score
  FROM scores LEFT JOIN neg USING (doc_id) LEFT JOIN quote_doc USING (doc_id) LEFT JOIN safe_doc USING (doc_id)),
grid AS (SELECT doc_id, unnest({NAMES['category']}) AS category FROM documents),
{FEATURES.replace("CASE WHEN lang = 'en' THEN 0.9 ELSE 0.6 END AS lc FROM documents", "lc FROM documents JOIN lang USING (doc_id)")},
cat AS (SELECT doc_id, category, round(greatest(0, least(1, least(1, coalesce(score, 0)) * CASE WHEN lc < 0.8 THEN 1 - (0.8 - lc) * 0.2 ELSE 1 END * CASE WHEN obfuscated THEN 1.1 ELSE 1 END * CASE WHEN code_mixed THEN 0.95 ELSE 1 END)), 9) AS score
  FROM grid LEFT JOIN kept USING (doc_id, category) JOIN feat USING (doc_id)),
top AS (SELECT doc_id, max(score) AS m, arg_max(category, (score, category)) AS c FROM cat GROUP BY doc_id),
graded AS (SELECT doc_id, m, CASE WHEN m > 0 THEN c END AS c, CASE WHEN m >= round(b, 9) THEN 'block' WHEN m >= round(r, 9) THEN 'review' ELSE 'allow' END AS decision,
  greatest(0.1, least(1, ({ZONE}) * CASE WHEN lc < 0.8 THEN 0.9 ELSE 1 END * CASE WHEN obfuscated THEN 0.95 ELSE 1 END * CASE WHEN code_mixed THEN 0.92 ELSE 1 END)) AS confidence,
  CASE WHEN m >= 0.9 OR (c IN ({', '.join(map(sql_text, K.CRITICAL_CATEGORIES))}) AND m >= 0.7) THEN 'critical' WHEN m >= 0.8 THEN 'high' WHEN m >= 0.6 THEN 'medium' ELSE 'low' END AS severity FROM top JOIN thr USING (doc_id))"""
BASE_POLICY = policy.builtin_policies()["*"]
CONTEXTS = "CASE " + " ".join(f"WHEN regexp_matches(text, {sql_text('(?i)' + '|'.join(p))}) THEN '{n}'" for n, p in K.POLICY_CONTEXT_PATTERNS.items()) + " END"
LEVELS = "CASE {} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"
RULED = f"""bthr AS (SELECT * FROM {values([(*k.split('|'), v) for k, v in BASE_POLICY['thresholds'].items()], 'category', 'severity', 'lim')}),
brule AS (SELECT * FROM {values([(r['category'], r['severity']) for r in BASE_POLICY['hard_rules']], 'category', 'least_')}),
eased AS (SELECT doc_id, CASE WHEN {CONTEXTS} IS NOT NULL THEN -0.2 ELSE 0 END AS adj FROM documents),
hardened AS (SELECT DISTINCT doc_id FROM graded JOIN cat USING (doc_id) JOIN brule USING (category) WHERE score > 0.5 AND {LEVELS.format('severity')} >= {LEVELS.format('least_')}),
met AS (SELECT doc_id, coalesce(lim, 0.9) AS lim FROM graded JOIN eased USING (doc_id) JOIN cat USING (doc_id) LEFT JOIN bthr USING (category, severity) WHERE round(greatest(0, least(1, score + adj)), 9) >= coalesce(lim, 0.9)),
met_doc AS (SELECT doc_id, max(CASE WHEN lim <= 0.5 THEN 2 ELSE 1 END) AS hit, count(*) AS n FROM met GROUP BY doc_id),
ruled AS (SELECT doc_id, h.doc_id IS NOT NULL AS hard, coalesce(hit, 0) AS hit, coalesce(n, 0) AS n, adj, CASE WHEN round(m + adj, 9) >= 0.9 THEN 2 WHEN round(m + adj, 9) >= 0.7 THEN 1 ELSE 0 END AS lvl
  FROM graded JOIN eased USING (doc_id) LEFT JOIN met_doc USING (doc_id) LEFT JOIN hardened h USING (doc_id))"""


def moderated_sql(texts: str) -> str:
    """SQL of the flagship over a table of (doc_id, text), given as a query."""
    body = f"""{MODERATED}, {RULED}
SELECT doc_id, decision, round(confidence, 6) AS confidence, round(m, 6) AS max_score, c AS top_category, severity, language,
  CASE WHEN hard THEN 'block' ELSE (['allow', 'review', 'block'])[greatest(hit, lvl) + 1] END AS policy_decision,
  round(CASE WHEN hard THEN confidence ELSE greatest(0, least(1, confidence + adj)) END, 6) AS policy_confidence,
  (CASE WHEN hard THEN 1 ELSE n + CASE WHEN adj < 0 THEN 1 ELSE 0 END + CASE WHEN lvl = 2 OR (lvl = 1 AND hit = 0) THEN 1 ELSE 0 END END)::INTEGER AS n_rules
FROM graded JOIN lang USING (doc_id) JOIN ruled USING (doc_id)"""
    return f"WITH texts AS ({texts}),{body.replace(' documents', ' texts')}"


def disguised(s, d):
    put = F.element_at(F.array(*map(F.lit, DISGUISED)), (F.pmod("doc_id", F.lit(len(DISGUISED))) + 1).cast("int"))
    return docs(s, d).withColumn("text", F.concat("text", F.lit(". "), put))


def e13(s, d):
    """All three results of the engine, a row for each document that has any."""
    found = scanned_documents(disguised(s, d)).where("doc_id is not null")
    chars = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    lines = F.transform("scores", lambda x: F.format_string("%s=%.6f", x["category"], F.round(x["score"], 6)))
    return found.select("doc_id", F.size("kept").cast("long").alias("n_spans"), chars.alias("chars"), F.array_join(F.array_sort(lines), ",").alias("scores"), F.array_join("traces", "\n").alias("traces"))


DISGUISED_TEXTS = f"SELECT doc_id, text || '. ' || ([{', '.join(map(sql_text, DISGUISED))}])[doc_id % {len(DISGUISED)} + 1] AS text FROM documents"
Q["e13_scan_lexicon_engine"] = (
    e13,
    f"WITH texts AS ({DISGUISED_TEXTS})," + f"""{ENGINE_SPANS}, {DEDUPED.split(', listed AS', 1)[1].join([' listed AS', ''])}, a AS (SELECT doc_id, count(*) AS n_spans, sum(s.fin - s.start)::BIGINT AS chars FROM deduped GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(l, ',' ORDER BY l) AS scores FROM (SELECT doc_id, category || '=' || format('{{:.6f}}', round(least(avg(confidence), 1.0), 6)) AS l FROM spans GROUP BY doc_id, category) GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY t) AS traces FROM (
  SELECT DISTINCT doc_id, 'Rule: ' || rule_source || ' -> Category: ' || category || ' -> Weight: ' || format('{{:.2f}}', confidence) AS t FROM spans) GROUP BY doc_id)
SELECT * FROM a JOIN b USING (doc_id) JOIN c USING (doc_id)""".replace(" documents", " texts"),
)
H22_ROUNDED = ("confidence", "max_score", "policy_confidence")
Q["h22_moderate_corpus"] = (lambda s, d: rounded(moderate_corpus(s, docs(s, d)), *H22_ROUNDED), moderated_sql("SELECT doc_id, text FROM documents"))
Q["h22_moderate_disguised"] = (
    lambda s, d: rounded(moderate_corpus(s, disguised(s, d)), *H22_ROUNDED),
    moderated_sql(DISGUISED_TEXTS),
)
