"""Queries of policies, audit, feedback and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import align, decide, feedback, matching, policy
from textwarden.operators.matching import bounded
from textwarden.plans.common import sql_text, stored, table, values
from textwarden.plans.match_queries import over_spoken, spoken
from textwarden.plans.decision_queries import DECIDED, SEVERITY, docs, lpe, rounded

Q: dict = {}
DEPARTMENTS = ("hr", "legal", "security", "engineering", "sales")


def judged(s, d, *more):
    """Decision, severity, context and lexicon scores of the documents that hold a term, all in a document's own row."""
    rows, terms_ = docs(s, d), matching.inline_rows(matching.load_lexicon(s))
    sure = F.when(F.col("lang") == "en", 0.9).otherwise(0.6).alias("language_confidence")
    rows = align.with_hits(rows.select("doc_id", sure, "text", F.lower("text").alias("low")), terms_)
    rows = rows.select("doc_id", "language_confidence", policy.context_of(F.col("text")).alias("context"), *decide.features_of(F.col("text")), "hits", *more)
    scores = F.transform(matching.category_scores_of(F.col("hits")), lambda c: F.struct(c["score"].alias("score"), c["category"].alias("category")))
    rows = decide.adapt_thresholds(rows.withColumn("scores", scores))
    top = F.array_max(F.transform("scores", lambda c: F.struct(F.round(c["score"], 9).alias("score"), c["category"].alias("category"))))
    rows = rows.withColumn("top", top).select("*", *decide.decision_of(F.col("top.score")), decide.grade_of(F.col("top.score"), F.col("top.category")).alias("severity"))
    dept = F.element_at(F.array(*map(F.lit, DEPARTMENTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    tenant = F.when(F.col("doc_id") % 2 == 0, "tech_corp").otherwise("acme")
    known = [c for c in rows.columns if c == "content_hash"]
    return rows.select("doc_id", "decision", F.round("confidence", 9).alias("confidence"), "severity", tenant.alias("tenant"), dept.alias("department"), "context", "scores", *known)


def base(s, d):
    return judged(s, d).select("doc_id", "decision", "confidence", "severity", "tenant", "department")


def gathered(s, d):
    """(decisions, scores, contexts, policies), of one scan of the texts."""
    rows = stored(judged(s, d).where("doc_id is not null"), "judged")
    scores = rows.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.category", "s.score")
    own = policy.resolve_policy(rows.select("tenant").distinct(), policy.policy_tables(s))
    return rows.drop("context", "scores"), scores, rows.select("doc_id", "context").where("context is not null"), own


def shifts(s, d):
    decisions, scores, contexts, own = gathered(s, d)
    return policy.department_overrides(decisions, scores, own["departments"], contexts)


def i5(s, d):
    decisions, scores, contexts, own = gathered(s, d)
    return policy.threshold_rules(decisions, scores, own["thresholds"], policy.department_overrides(decisions, scores, own["departments"], contexts))


def i2(s, d):
    decisions, scores, _, own = gathered(s, d)
    return policy.hard_rules(decisions, scores, own["hard_rules"])


def policies(s, d):
    return policy.resolve_policy(base(s, d).select("tenant").distinct(), policy.policy_tables(s))


TENANTS = ("acme", "tech_corp")


def resolved():
    """The same overlay in Python, as rows for SQL."""
    thr, rules, dept, ctx = [], [], [], []
    for t in TENANTS:
        for c, xs in (K.POLICY_THRESHOLDS["*"] | K.POLICY_THRESHOLDS.get(t, {})).items():
            thr += [(t, c, s, x) for s, x in zip(("medium", "high", "critical"), xs, strict=True)]
        own = [(i, r) for i, r in enumerate(K.POLICY_HARD_RULES) if r[0] == t]
        have = {r[1:3] for _, r in own}
        rules += [(t, i, r[1], r[2]) for i, r in own] + [(t, i, r[1], r[2]) for i, r in enumerate(K.POLICY_HARD_RULES) if r[0] == "*" and r[1:3] not in have]
        mine = {r[1]: r for r in K.POLICY_DEPARTMENTS if r[0] == "*"} | {r[1]: r for r in K.POLICY_DEPARTMENTS if r[0] == t}
        dept += [(t, n, "|".join(r[2]), float(r[3])) for n, r in mine.items()]
        ctx += [(t, c) for c in dict.fromkeys((*K.POLICY_SAFE_CONTEXTS["*"], *K.POLICY_SAFE_CONTEXTS.get(t, ())))]
    return thr, rules, dept, ctx


THR, RULES, DEPT, CTX = resolved()
RANK = "CASE {} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"
DEPTS = "[" + ", ".join(map(sql_text, DEPARTMENTS)) + "]"
CONTEXT_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, {sql_text('(?i)' + '|'.join(p))}) THEN '{n}'" for n, p in K.POLICY_CONTEXT_PATTERNS.items()) + " END"
BASE = f"""{DECIDED}, {SEVERITY},
base AS (SELECT doc_id, decision, round(confidence, 9) AS confidence, severity, CASE WHEN doc_id % 2 = 0 THEN 'tech_corp' ELSE 'acme' END AS tenant, ({DEPTS})[doc_id % 5 + 1] AS department FROM dec JOIN sev USING (doc_id)),
pthr AS (SELECT * FROM {values(THR, 'tenant', 'category', 'severity', 'threshold')}),
prule AS (SELECT * FROM {values(RULES, 'tenant', 'ord', 'category', 'least_')}),
pdept AS (SELECT * FROM {values(DEPT, 'tenant', 'department', 'flags', 'shift')}),
hard AS (SELECT doc_id, arg_min(category || ':' || least_, ord) AS rule FROM base JOIN scores USING (doc_id) JOIN prule USING (tenant, category)
         WHERE score > 0.5 AND {RANK.format('severity')} >= {RANK.format('least_')} GROUP BY doc_id),
ctx AS (SELECT doc_id, {CONTEXT_CASE} AS context FROM documents),
cats AS (SELECT doc_id, bool_or(category IN ('sexual content', 'insult/harassment')) AS sensitive, bool_or(category = 'threat/violence') AS threat FROM scores WHERE score > 0.5 GROUP BY doc_id),
adj0 AS (SELECT doc_id, shift + CASE WHEN contains(flags, 'allow_sensitive_discussions') AND coalesce(sensitive, false) THEN -0.15 ELSE 0 END
   + CASE WHEN contains(flags, 'allow_policy_examples') AND coalesce(context IN ('legal_documentation', 'policy_discussion'), false) THEN -0.2 ELSE 0 END
   + CASE WHEN contains(flags, 'allow_threat_analysis') AND coalesce(threat, false) THEN -0.25 ELSE 0 END AS adjustment
   FROM base JOIN pdept USING (tenant, department) LEFT JOIN cats USING (doc_id) LEFT JOIN ctx USING (doc_id)),
adj AS (SELECT base.doc_id, coalesce(adjustment, 0) + CASE WHEN context IS NOT NULL THEN -0.2 ELSE 0 END AS adjustment FROM base LEFT JOIN adj0 USING (doc_id) LEFT JOIN ctx USING (doc_id)),
thr1 AS (SELECT doc_id, round(greatest(0, least(1, score + adjustment)), 9) >= coalesce(threshold, 0.9) AS over_, coalesce(threshold, 0.9) AS lim, round(confidence + adjustment, 9) AS overall
   FROM base JOIN adj USING (doc_id) JOIN scores USING (doc_id) LEFT JOIN pthr USING (tenant, category, severity)),
thr2 AS (SELECT doc_id, greatest(max(CASE WHEN over_ AND lim <= 0.5 THEN 2 WHEN over_ THEN 1 ELSE 0 END), max(CASE WHEN overall >= 0.9 THEN 2 WHEN overall >= 0.7 THEN 1 ELSE 0 END)) AS lvl, count(*) FILTER (over_) AS n_rules FROM thr1 GROUP BY doc_id),
applied AS (SELECT base.*, CASE WHEN rule IS NOT NULL THEN 'block' ELSE (['allow', 'review', 'block'])[lvl + 1] END AS policy_decision,
   CASE WHEN rule IS NOT NULL THEN confidence ELSE greatest(0, least(1, confidence + adjustment)) END AS policy_confidence, adjustment, rule AS hard_rule
   FROM base JOIN adj USING (doc_id) LEFT JOIN thr2 USING (doc_id) LEFT JOIN hard USING (doc_id))"""


def i1(s, d):
    decisions, scores, _, own = gathered(s, d)
    rows = decisions.select("doc_id", "tenant").join(scores, "doc_id").join(bounded(own["thresholds"]), ["tenant", "category"])
    return rows.groupBy("tenant", "category", "severity", "threshold").agg(F.sum((F.round("score", 9) >= F.col("threshold")).cast("long")).alias("n_over"))


Q["i1_resolve_policy"] = (
    i1,
    f"WITH {BASE} SELECT b.tenant, s.category, p.severity, threshold, count(*) FILTER (round(score, 9) >= threshold) AS n_over FROM base b JOIN scores s USING (doc_id) JOIN pthr p ON p.tenant = b.tenant AND p.category = s.category GROUP BY ALL",
)
Q["i2_hard_rules"] = (i2, f"WITH {BASE} SELECT doc_id, rule FROM hard")
Q["i3_policy_safe_context"] = (lambda s, d: policy.policy_safe_context(spoken(s, d)), over_spoken(f"SELECT * FROM (SELECT doc_id, {CONTEXT_CASE} AS context FROM documents) WHERE context IS NOT NULL"))
Q["i4_department_overrides"] = (
    lambda s, d: rounded(shifts(s, d), "adjustment"),
    f"WITH {BASE} SELECT doc_id, round(adjustment, 6) AS adjustment FROM adj0",
)
Q["i5_threshold_rules"] = (
    i5,
    f"WITH {BASE} SELECT doc_id, (['allow', 'review', 'block'])[lvl + 1] AS decision, n_rules FROM thr2",
)


def applied(s, d, *more):
    """``judged`` with the policy's decision."""
    return policy.with_policy(judged(s, d, *more), policy.builtin_policies()).drop("context", "scores")


SHOWN = ("doc_id", "decision", "confidence", "severity", "tenant", "department", "policy_decision", "policy_confidence", "adjustment", "hard_rule")
Q["i6_apply_policy"] = (
    lambda s, d: rounded(applied(s, d).select(*SHOWN, F.size("applied_rules").alias("n_rules")), "confidence", "policy_confidence", "adjustment"),
    f"""WITH {BASE}, eased AS (SELECT base.doc_id, CASE WHEN context IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN contains(coalesce(flags, ''), 'allow_sensitive_discussions') AND coalesce(sensitive, false) THEN 1 ELSE 0 END
   + CASE WHEN contains(coalesce(flags, ''), 'allow_policy_examples') AND coalesce(context IN ('legal_documentation', 'policy_discussion'), false) THEN 1 ELSE 0 END
   + CASE WHEN contains(coalesce(flags, ''), 'allow_threat_analysis') AND coalesce(threat, false) THEN 1 ELSE 0 END AS n
   FROM base LEFT JOIN pdept USING (tenant, department) LEFT JOIN cats USING (doc_id) LEFT JOIN ctx USING (doc_id)),
hits AS (SELECT doc_id, max(CASE WHEN over_ AND lim <= 0.5 THEN 2 WHEN over_ THEN 1 ELSE 0 END) AS hit, max(CASE WHEN overall >= 0.9 THEN 2 WHEN overall >= 0.7 THEN 1 ELSE 0 END) AS lvl FROM thr1 GROUP BY doc_id)
SELECT a.doc_id, decision, round(confidence, 6) AS confidence, severity, tenant, department, policy_decision, round(policy_confidence, 6) AS policy_confidence, round(adjustment, 6) AS adjustment, hard_rule,
  (CASE WHEN hard_rule IS NOT NULL THEN 1 ELSE eased.n + n_rules + CASE WHEN hits.lvl = 2 OR (hits.lvl = 1 AND hit = 0) THEN 1 ELSE 0 END END)::INTEGER AS n_rules
FROM applied a JOIN eased USING (doc_id) JOIN hits USING (doc_id) JOIN thr2 USING (doc_id)""",
)
CNT = ", ".join([f"count(*) FILTER (decision = '{x}') AS before_{x}" for x in K.DECISIONS] + [f"count(*) FILTER (policy_decision = '{x}') AS after_{x}" for x in K.DECISIONS])
Q["i7_policy_impact"] = (
    lambda s, d: policy.policy_impact(applied(s, d), ["tenant", "department"]),
    f"WITH {BASE} SELECT tenant, department, {CNT}, count(*) FILTER (decision <> policy_decision) AS changed FROM applied GROUP BY ALL",
)
#: A threshold and a shift that validation objects to, put into one tenant's policy.
ODD_THRESHOLD, ODD_SHIFT = ("acme", "threat/violence", "high", 0.9), ("acme", "sales", 0.5)


def odd_policies(s, d):
    tables = policy.policy_tables(s)
    tables["thresholds"] = tables["thresholds"].unionByName(s.createDataFrame([ODD_THRESHOLD], tables["thresholds"].schema))
    tables["departments"] = tables["departments"].unionByName(s.createDataFrame([(*ODD_SHIFT[:2], [], ODD_SHIFT[2])], tables["departments"].schema))
    return policy.resolve_policy(base(s, d).select("tenant").distinct(), tables)


Q["i8_validate_policies"] = (
    lambda s, d: policy.validate_policies(odd_policies(s, d)),
    f"""WITH {BASE}, odd AS (SELECT tenant, category, severity, CASE WHEN tenant = '{ODD_THRESHOLD[0]}' AND category = '{ODD_THRESHOLD[1]}' AND severity = '{ODD_THRESHOLD[2]}' THEN {ODD_THRESHOLD[3]} ELSE threshold END AS threshold FROM pthr),
p AS (SELECT tenant, category, max(threshold) FILTER (severity = 'medium') m, max(threshold) FILTER (severity = 'high') h, max(threshold) FILTER (severity = 'critical') c FROM odd GROUP BY ALL)
SELECT tenant, 'thresholds out of order: ' || category AS warning FROM p WHERE NOT (c <= h AND h <= m) AND tenant IN (SELECT tenant FROM base)
UNION ALL SELECT tenant, 'shift out of range: ' || department FROM (SELECT tenant, department, shift FROM pdept UNION ALL VALUES ('{ODD_SHIFT[0]}', '{ODD_SHIFT[1]}', {ODD_SHIFT[2]})) WHERE (shift > 0.3 OR shift < -0.5) AND tenant IN (SELECT tenant FROM base)""",
)
Q["i9_policy_summary"] = (
    lambda s, d: policy.policy_summary(policies(s, d)).join(base(s, d).groupBy("tenant").agg(F.count("*").alias("n_docs")), "tenant"),
    f"""WITH {BASE}, c AS (SELECT * FROM {values(CTX, 'tenant', 'context')})
SELECT tenant, (SELECT count(*) FROM pthr p WHERE p.tenant = b.tenant) AS n_thresholds, (SELECT count(*) FROM c WHERE c.tenant = b.tenant) AS n_safe_contexts,
 (SELECT count(*) FROM pdept p WHERE p.tenant = b.tenant) AS n_departments, (SELECT count(*) FROM prule p WHERE p.tenant = b.tenant) AS n_hard_rules, count(*) AS n_docs FROM base b GROUP BY tenant""",
)


def audit(s, d):
    hashed = applied(s, d, policy.content_hash_of(F.col("text")).alias("content_hash"))
    return policy.audit_decisions(hashed, docs(s, d), F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id AS INT))"))


AUDIT = f"""{BASE}, audit AS (SELECT a.*, left(sha256(text), 16) AS content_hash, TIMESTAMP '2024-01-01' + to_hours(a.doc_id) AS ts FROM applied a JOIN documents USING (doc_id))"""
FLAGS = """concat_ws(',', CASE WHEN policy_decision = 'block' THEN 'content_blocked' END, CASE WHEN hard_rule IS NOT NULL THEN 'hard_rule_triggered' END,
 CASE WHEN decision <> policy_decision THEN 'policy_override' END, CASE WHEN decision <> policy_decision AND confidence > 0.8 THEN 'high_confidence_override' END)"""
Q["i10_audit_decisions"] = (
    lambda s, d: audit(s, d).select("entry_id", "tenant_id", "content_hash", F.array_join("compliance_flags", ",").alias("flags"), F.col("details.final_decision").alias("final_decision")),
    f"WITH {AUDIT} SELECT 'dec-' || doc_id AS entry_id, tenant AS tenant_id, content_hash, {FLAGS} AS flags, policy_decision AS final_decision FROM audit",
)


def versions(s, d):
    e = table(s, d, "events").where("event_type = 'signup'")
    conf = F.create_map(F.lit("limit"), F.floor(F.col("value") / 50).cast("string"), F.lit("mode"), (F.col("event_id") % 3).cast("string"))
    return e.select(F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant"), F.col("event_id").alias("version"), conf.alias("config"))


Q["i11_audit_policy_changes"] = (
    lambda s, d: policy.audit_policy_changes(versions(s, d)).select("tenant", "version", "new_hash", F.array_join("changed", ",").alias("changed")),
    """WITH v AS (SELECT 't' || (user_id % 5) AS tenant, event_id AS version, floor(value / 50)::BIGINT::VARCHAR AS l, (event_id % 3)::VARCHAR AS m FROM events WHERE event_type = 'signup'),
b AS (SELECT *, lag(l) OVER w AS bl, lag(m) OVER w AS bm FROM v WINDOW w AS (PARTITION BY tenant ORDER BY version))
SELECT tenant, version, sha256('{"limit":"' || l || '","mode":"' || m || '"}') AS new_hash, concat_ws(',', CASE WHEN l <> bl THEN 'limit' END, CASE WHEN m <> bm THEN 'mode' END) AS changed FROM b WHERE bl IS NOT NULL""",
)


def overrides(s, d):
    e = table(s, d, "events").where("event_type = 'purchase'")
    pick = lambda k: F.element_at(F.array(*map(F.lit, K.DECISIONS)), (F.pmod(F.col("event_id"), F.lit(k)) % 3 + 1).cast("int"))
    return e.select(F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant"), "user_id", "ts", pick(7).alias("original"), pick(5).alias("replaced"))


Q["i12_audit_overrides"] = (
    lambda s, d: policy.audit_overrides(overrides(s, d)).groupBy("tenant_id", F.array_join("compliance_flags", ",").alias("flags")).agg(F.count("*").alias("n")),
    """WITH o AS (SELECT 't' || (user_id % 5) AS tenant_id, (['allow', 'review', 'block'])[event_id % 7 % 3 + 1] AS o, (['allow', 'review', 'block'])[event_id % 5 % 3 + 1] AS r FROM events WHERE event_type = 'purchase')
SELECT tenant_id, concat_ws(',', 'manual_override', CASE WHEN o = 'block' AND r = 'allow' THEN 'block_overridden' END) AS flags, count(*) AS n FROM o GROUP BY ALL""",
)
Q["i13_compliance_report"] = (
    lambda s, d: policy.compliance_report(audit(s, d)).withColumn("event_date", F.col("event_date").cast("string")),
    f"""WITH {AUDIT} SELECT tenant AS tenant_id, ts::DATE::VARCHAR AS event_date, count(*) AS n, count(*) FILTER (policy_decision = 'block') AS content_blocked, count(*) FILTER (decision <> policy_decision) AS policy_override,
 count(*) FILTER (hard_rule IS NOT NULL) AS hard_rule_triggered, count(*) FILTER (decision <> policy_decision AND confidence > 0.8) AS high_confidence_override FROM audit GROUP BY ROLLUP (tenant, ts::DATE)""",
)


def requests(s, d):
    return base(s, d).select(F.col("doc_id").alias("request_id"), "decision", "confidence", "tenant")


def given(s, d):
    lab = table(s, d, "labels")
    ts = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id AS INT))")
    return lab.select(F.col("doc_id").alias("request_id"), ts.alias("ts"), F.when(F.col("toxic") == 1, "block").otherwise("allow").alias("final_label"))


FEED = f"""{BASE}, fb AS (SELECT l.doc_id AS request_id, TIMESTAMP '2024-01-01' + to_hours(l.doc_id) AS ts, CASE WHEN toxic = 1 THEN 'block' ELSE 'allow' END AS final_label, decision AS original_decision, confidence AS confidence_score, tenant
  FROM labels l LEFT JOIN base b ON b.doc_id = l.doc_id)"""
linked = lambda s, d: feedback.correlate_feedback(given(s, d), requests(s, d))
Q["j1_correlate_feedback"] = (
    lambda s, d: rounded(linked(s, d).select("request_id", "final_label", "original_decision", "confidence_score"), "confidence_score"),
    f"WITH {FEED} SELECT request_id, final_label, original_decision, round(confidence_score, 6) AS confidence_score FROM fb",
)
Q["a3_validate_feedback"] = (
    lambda s, d: feedback.validate_feedback(given(s, d).select(F.col("request_id").cast("string").alias("request_id"), F.when(F.col("request_id") % 10 == 0, "maybe").otherwise(F.col("final_label")).alias("final_label"), F.array(F.lit("spam/scam")).alias("actual_categories")))[1]
    .select("request_id", F.array_join("reasons", ",").alias("reasons")),
    "SELECT doc_id::VARCHAR AS request_id, 'final_label' AS reasons FROM labels WHERE doc_id % 10 = 0",
)
AS_OF = "2024-02-11 00:00:00"
Q["j2_feedback_analytics"] = (
    lambda s, d: rounded(feedback.feedback_analytics(linked(s, d), 30, AS_OF, ["final_label"]), "correction_rate", "signed_confidence"),
    f"""WITH {FEED} SELECT final_label, count(*) AS n, count(*) FILTER (final_label IS DISTINCT FROM original_decision) AS corrections, round(avg((final_label IS DISTINCT FROM original_decision)::INT), 6) AS correction_rate,
 round(avg(CASE WHEN final_label IS DISTINCT FROM original_decision THEN -confidence_score ELSE confidence_score END), 6) AS signed_confidence
FROM fb WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}' GROUP BY final_label""",
)
Q["j3_feedback_trend"] = (
    lambda s, d: feedback.feedback_trend(linked(s, d), AS_OF).withColumn("day", F.col("day").cast("string")),
    f"""WITH {FEED}, cal AS (SELECT unnest(generate_series(DATE '2024-02-05', DATE '2024-02-11', INTERVAL 1 DAY))::DATE AS day)
SELECT day::VARCHAR AS day, count(request_id) AS n, count(request_id) FILTER (final_label IS DISTINCT FROM original_decision) AS corrections FROM cal LEFT JOIN fb ON ts::DATE = day GROUP BY day""",
)


def measured(s, d):
    n = lpe(s, d).groupBy("doc_id").agg(F.count("*").alias("n_categories"))
    lang = docs(s, d).select("doc_id", F.when(F.col("lang") == "en", 0.9).otherwise(0.6).alias("language_confidence"))
    return feedback.uncertainty_metrics(base(s, d).join(n, "doc_id").join(lang, "doc_id"))


UNC = f"""{BASE}, unc0 AS (SELECT b.doc_id, decision, confidence, n.n AS n_categories, CASE WHEN lang = 'en' THEN 0.9 ELSE 0.6 END AS lcf FROM base b JOIN (SELECT doc_id, count(*) AS n FROM scores GROUP BY 1) n USING (doc_id) JOIN documents USING (doc_id)),
unc AS (SELECT *, round(((1 - confidence) + CASE WHEN confidence BETWEEN 0.4 AND 0.6 THEN 0.8 WHEN confidence BETWEEN 0.3 AND 0.7 THEN 0.5 ELSE 0.2 END + CASE WHEN n_categories = 0 THEN 0.6 WHEN n_categories > 2 THEN 0.7 ELSE 0.3 END + (1 - lcf)) / 4, 9) AS u FROM unc0),
sel AS (SELECT *, CASE WHEN decision = 'block' AND confidence < 0.6 THEN 'critical' WHEN u > 0.7 THEN 'high' WHEN u > 0.4 OR decision = 'review' THEN 'medium' ELSE 'low' END AS priority
  FROM unc WHERE confidence < 0.7 OR u > 0.3 OR (decision = 'block' AND confidence < 0.8) OR (decision = 'review' AND n_categories = 0))"""
Q["j4_uncertainty_metrics"] = (lambda s, d: rounded(measured(s, d).select("doc_id", "uncertainty"), "uncertainty"), f"WITH {UNC} SELECT doc_id, round(u, 6) AS uncertainty FROM unc")
Q["j5_select_for_review"] = (lambda s, d: feedback.select_for_review(measured(s, d)).select("doc_id"), f"WITH {UNC} SELECT doc_id FROM sel")
queue = lambda s, d: feedback.review_priority(feedback.select_for_review(measured(s, d)))
Q["j6_review_priority"] = (lambda s, d: queue(s, d).select("doc_id", "priority", "status"), f"WITH {UNC} SELECT doc_id, priority, 'pending' AS status FROM sel")


def items(s, d):
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id AS INT))")
    return queue(s, d).select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("request_id"), "priority", "status", at.alias("created_at"))


Q["j7_pending_reviews"] = (
    lambda s, d: feedback.pending_reviews(items(s, d), 20).select("review_id", "priority"),
    f"WITH {UNC} SELECT doc_id AS review_id, priority FROM sel ORDER BY CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, doc_id LIMIT 20",
)


def updates(s, d):
    lab = table(s, d, "labels")
    at = F.expr("timestamp '2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id AS INT))")
    return lab.select(F.col("doc_id").alias("review_id"), at.alias("ts"), F.when(F.col("doc_id") % 3 == 0, "in_progress").otherwise("completed").alias("status"), F.when(F.col("toxic") == 1, "block").otherwise("allow").alias("final_label"))


DONE = f"""{UNC}, items AS (SELECT s.doc_id AS review_id, priority, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.doc_id % 3 = 0 THEN 'in_progress' ELSE 'completed' END AS status,
  CASE WHEN l.doc_id % 3 <> 0 THEN 1440.0 END AS minutes FROM sel s LEFT JOIN labels l USING (doc_id))"""
reviewed = lambda s, d: feedback.apply_reviews(items(s, d), updates(s, d))[0]
Q["j8_apply_reviews"] = (lambda s, d: reviewed(s, d).select("review_id", "priority", "status"), f"WITH {DONE} SELECT review_id, priority, status FROM items")
Q["j9_review_statistics"] = (
    lambda s, d: rounded(feedback.review_statistics(reviewed(s, d)), "avg_minutes"),
    f"WITH {DONE} SELECT status, priority, count(*) AS n, round(avg(minutes), 6)::DOUBLE AS avg_minutes FROM items GROUP BY GROUPING SETS ((status), (priority))",
)
Q["j10_queue_dashboard"] = (
    lambda s, d: feedback.queue_dashboard(reviewed(s, d)),
    f"WITH {DONE} SELECT count(*) AS n_items, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'completed') AS n_completed, "
    + ", ".join(f"count(*) FILTER (status = 'pending' AND priority = '{p}') AS pending_{p}" for p in feedback.PRIORITIES)
    + " FROM items",
)
