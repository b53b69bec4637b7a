"""Tenant policies over decisions, and the audit trail they leave.

Policies are dimension tables: thresholds (tenant, category, severity, threshold), safe
contexts, department overrides and hard rules.  ``*`` is the base every tenant inherits.
Decisions: (doc_id, tenant, department, decision, confidence, severity).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.matching import bounded

CONTEXT_SHIFT = -0.2
REVIEW_ALL, BLOCK_ALL, LOW_THRESHOLD = 0.7, 0.9, 0.9


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, K.SEVERITIES)), severity).cast("int")


def policy_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in policies as tables."""
    thresholds = [(t, c, s, x) for t, rows in K.POLICY_THRESHOLDS.items() for c, xs in rows.items() for s, x in zip(("medium", "high", "critical"), xs, strict=True)]
    contexts = [(t, i, c) for t, names in K.POLICY_SAFE_CONTEXTS.items() for i, c in enumerate(names)]
    rules = [(t, i, *r) for i, (t, *r) in enumerate(K.POLICY_HARD_RULES)]
    return {
        "thresholds": spark.createDataFrame(thresholds, "tenant string, category string, severity string, threshold double"),
        "safe_contexts": spark.createDataFrame(contexts, "tenant string, ord int, context string"),
        "departments": spark.createDataFrame([(t, d, list(f), s) for t, d, f, s in K.POLICY_DEPARTMENTS], "tenant string, department string, flags array<string>, shift double"),
        "hard_rules": spark.createDataFrame(rules, "tenant string, ord int, category string, severity string, action string, override_allowed boolean"),
    }


def resolve_policy(tenants: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each tenant's own policy: thresholds and departments replaced one by one, contexts and rules united."""

    def overlay(table: DataFrame, keys: list[str]) -> DataFrame:
        base = tenants.select("tenant").distinct().join(bounded(table.where("tenant = '*'").drop("tenant")), F.lit(True))
        own = tenants.select("tenant").distinct().join(bounded(table.where("tenant <> '*'")), "tenant")
        return own.unionByName(base.join(own.select("tenant", *keys), ["tenant", *keys], "left_anti"))

    return {
        "thresholds": overlay(tables["thresholds"], ["category", "severity"]),
        "safe_contexts": overlay(tables["safe_contexts"], ["context"]),
        "departments": overlay(tables["departments"], ["department"]),
        "hard_rules": overlay(tables["hard_rules"], ["category", "severity"]),
    }


def hard_rules(decisions: DataFrame, scores: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule): the first rule whose category scores above 0.5 and whose severity the document reaches."""
    rows = decisions.select("doc_id", "tenant", "severity").join(scores.where("score > 0.5"), "doc_id")
    on = ["tenant", "category"]
    r = rules.select("tenant", "category", F.col("severity").alias("least"), "ord")
    hit = rows.join(bounded(r), on).where(rank_of(F.col("severity")) >= rank_of(F.col("least")))
    name = F.concat("category", F.lit(":"), "least")
    return hit.groupBy("doc_id").agg(F.min(F.struct("ord", name.alias("rule"))).alias("m")).select("doc_id", "m.rule")


def policy_safe_context(docs: DataFrame) -> DataFrame:
    """(doc_id, context): the first context, in the policy's order, whose patterns match the text."""
    return docs.select("doc_id", context_of(F.col("text")).alias("context")).where("context is not null")


def department_overrides(decisions: DataFrame, scores: DataFrame, departments: DataFrame, contexts: DataFrame) -> DataFrame:
    """(doc_id, adjustment): the department's shift and what its flags add."""
    top = scores.where("score > 0.5").groupBy("doc_id").agg(F.collect_set("category").alias("cats"))
    rows = decisions.select("doc_id", "tenant", "department").join(bounded(departments), ["tenant", "department"]).join(top, "doc_id", "left").join(contexts, "doc_id", "left")
    flag = lambda f: F.array_contains("flags", f)
    sensitive = F.coalesce(F.arrays_overlap("cats", F.array(F.lit("sexual content"), F.lit("insult/harassment"))), F.lit(False))
    threat = F.coalesce(F.array_contains("cats", "threat/violence"), F.lit(False))
    legal = F.coalesce(F.col("context").isin("legal_documentation", "policy_discussion"), F.lit(False))
    a = (
        F.col("shift") + F.when(flag("allow_sensitive_discussions") & sensitive, -0.15).otherwise(0.0)
        + F.when(flag("allow_policy_examples") & legal, -0.2).otherwise(0.0) + F.when(flag("allow_threat_analysis") & threat, -0.25).otherwise(0.0)
    )
    return rows.select("doc_id", a.alias("adjustment"))


def threshold_rules(decisions: DataFrame, scores: DataFrame, thresholds: DataFrame, adjustments: DataFrame) -> DataFrame:
    """(doc_id, decision, n_rules) from adjusted category scores against the tenant's thresholds for the severity."""
    rows = decisions.select("doc_id", "tenant", "severity", "confidence").join(adjustments, "doc_id", "left").fillna(0.0, ["adjustment"])
    rows = rows.join(scores.select("doc_id", "category", "score"), "doc_id").join(bounded(thresholds), ["tenant", "category", "severity"], "left")
    s = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("adjustment"))), 9)
    at = F.coalesce("threshold", F.lit(LOW_THRESHOLD))
    over = s >= at
    overall = F.round(F.col("confidence") + F.col("adjustment"), 9)
    hit = F.when(over & (at <= 0.5), 2).when(over, 1).otherwise(0)
    per = rows.groupBy("doc_id").agg(F.max(hit).alias("hit"), F.sum(over.cast("long")).alias("n_rules"), F.max(overall).alias("overall"))
    level = F.greatest("hit", F.when(F.col("overall") >= BLOCK_ALL, 2).when(F.col("overall") >= REVIEW_ALL, 1).otherwise(0))
    return per.select("doc_id", F.element_at(F.array(*map(F.lit, K.DECISIONS)), (level + 1).cast("int")).alias("decision"), "n_rules")


#: A tenant's whole policy as one value; thresholds are by category and severity, joined by a bar.
POLICY = "struct<thresholds:map<string,double>,departments:map<string,struct<flags:array<string>,shift:double>>,hard_rules:array<struct<ord:int,category:string,severity:string,action:string>>>"
MOST_TENANTS = 1_000


def policy_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(tenant, policy): one row for each tenant that the tables name, and ``*`` for all others."""
    own = {k: t.select("tenant") for k, t in tables.items()}
    tenants = own["thresholds"].unionByName(own["departments"]).unionByName(own["hard_rules"]).distinct()
    t = resolve_policy(tenants, tables)
    pairs = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))
    thresholds = t["thresholds"].groupBy("tenant").agg(pairs(F.concat_ws("|", "category", "severity"), F.col("threshold")).alias("thresholds"))
    departments = t["departments"].groupBy("tenant").agg(pairs(F.col("department"), F.struct("flags", "shift")).alias("departments"))
    rules = t["hard_rules"].groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("ord", "category", "severity", "action"))).alias("hard_rules"))
    rows = tenants.join(thresholds, "tenant", "left").join(departments, "tenant", "left").join(rules, "tenant", "left")
    return rows.select("tenant", F.struct("thresholds", "departments", "hard_rules").alias("policy"))


def builtin_policies() -> dict[str, dict]:
    """The built-in policies, by tenant."""
    out = {}
    for t in {"*", *K.POLICY_THRESHOLDS, *[r[0] for r in (*K.POLICY_DEPARTMENTS, *K.POLICY_HARD_RULES)]}:
        levels = K.POLICY_THRESHOLDS["*"] | K.POLICY_THRESHOLDS.get(t, {})
        thresholds = {f"{c}|{s}": x for c, xs in levels.items() for s, x in zip(("medium", "high", "critical"), xs, strict=True)}
        departments = {d: {"flags": list(f), "shift": s} for who in ("*", t) for w, d, f, s in K.POLICY_DEPARTMENTS if w == who}
        rules = {r[1:3]: {"ord": k, "category": r[1], "severity": r[2], "action": r[3]} for who in ("*", t) for k, r in enumerate(K.POLICY_HARD_RULES) if r[0] == who}
        out[t] = {"thresholds": thresholds, "departments": departments, "hard_rules": sorted(rules.values(), key=lambda r: r["ord"])}
    return out


def with_own_policy(rows: DataFrame, policies: DataFrame | dict) -> DataFrame:
    """Adds ``policy``: that of the row's tenant, or of ``*``.

    Policies of up to MOST_TENANTS tenants are a constant of the plan; more of them are joined.
    """
    few = [] if isinstance(policies, dict) else policies.limit(MOST_TENANTS + 1).select("tenant", F.to_json("policy").alias("p")).collect()
    if len(few) <= MOST_TENANTS:
        known = policies if isinstance(policies, dict) else {r["tenant"]: json.loads(r["p"]) for r in few}
        by_tenant = F.from_json(F.lit(json.dumps(known)), f"map<string,{POLICY}>")
        return rows.withColumn("policy", F.coalesce(by_tenant[F.col("tenant")], by_tenant["*"]))
    every = policies.where("tenant = '*'").select(F.col("policy").alias("base_policy"))
    joined = rows.join(bounded(policies), "tenant", "left").crossJoin(F.broadcast(every))  # one row
    return joined.withColumn("policy", F.coalesce("policy", "base_policy")).drop("base_policy")


def context_of(text: Column) -> Column:
    """The first context, in the policies' order, whose patterns match a text."""
    out = None
    for name, patterns in K.POLICY_CONTEXT_PATTERNS.items():
        hit = text.rlike("(?i)" + "|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def with_policy(rows: DataFrame, policies: DataFrame | dict, risk: str = "confidence") -> DataFrame:
    """Adds policy_decision, policy_confidence, adjustment, hard_rule, override_reason and applied_rules to decisions.

    ``rows``: decision, confidence, severity, tenant, department, context and ``scores``, an
    array of (category, score), which may be null; ``policies``: ``policy_rows`` or
    ``builtin_policies``.  Everything
    is an expression on the row.  A hard rule ends the matter; otherwise the department's shift and
    the context move the scores, which meet the thresholds of the severity; ``risk`` meets the
    thresholds for a whole document.
    """
    had = rows.columns
    scores = F.coalesce("scores", F.array().cast("array<struct<score:double,category:string>>"))
    strong = F.transform(F.filter(scores, lambda s: s["score"] > 0.5), lambda s: s["category"])
    rows = with_own_policy(rows, policies).withColumn("strong", strong)
    reached = lambda r: F.array_contains("strong", r["category"]) & (rank_of(F.col("severity")) >= rank_of(r["severity"]))
    own = F.col("policy.departments")[F.col("department")]
    rows = rows.select("*", F.get(F.filter("policy.hard_rules", reached), F.lit(0)).alias("hard"), own.alias("own"))
    flag = lambda f: F.coalesce(F.array_contains("own.flags", f), F.lit(False))
    sensitive = flag("allow_sensitive_discussions") & F.arrays_overlap("strong", F.array(F.lit("sexual content"), F.lit("insult/harassment")))
    legal = flag("allow_policy_examples") & F.coalesce(F.col("context").isin("legal_documentation", "policy_discussion"), F.lit(False))
    threat = flag("allow_threat_analysis") & F.array_contains("strong", "threat/violence")
    rows = rows.select("*", sensitive.alias("sensitive"), legal.alias("legal"), threat.alias("threat"))
    eased = lambda c, by: F.when(F.col(c), by).otherwise(0.0)
    shift = F.coalesce("own.shift", F.lit(0.0)) + eased("sensitive", -0.15) + eased("legal", -0.2) + eased("threat", -0.25)
    rows = rows.withColumn("adjustment", shift + F.when(F.col("context").isNotNull(), CONTEXT_SHIFT).otherwise(0.0))

    def met(s: Column) -> Column:
        moved = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["score"] + F.col("adjustment"))), 9)
        at = F.coalesce(F.col("policy.thresholds")[F.concat(s["category"], F.lit("|"), F.col("severity"))], F.lit(LOW_THRESHOLD))
        return F.struct(s["category"].alias("category"), moved.alias("score"), at.alias("at"))

    over = F.filter(F.transform(scores, met), lambda s: s["score"] >= s["at"])
    rows = rows.select("*", over.alias("over"), F.round(F.col(risk) + F.col("adjustment"), 9).alias("overall"))
    level = F.when(F.col("overall") >= BLOCK_ALL, 2).when(F.col("overall") >= REVIEW_ALL, 1).otherwise(0)
    hit = F.coalesce(F.array_max(F.transform("over", lambda s: F.when(s["at"] <= 0.5, 2).otherwise(1))), F.lit(0))
    hard = F.col("hard").isNotNull()
    ruled = F.element_at(F.array(*map(F.lit, K.DECISIONS)), (F.greatest(hit, level) + 1).cast("int"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.col("adjustment")))
    exceeded = lambda s: F.format_string("%s threshold exceeded: %s (%.3f >= %s)", F.when(s["at"] <= 0.5, "Block").otherwise("Review"), s["category"], s["score"], s["at"].cast("string"))
    allows = lambda c, what: F.when(F.col(c), F.concat(F.lit("Department override: "), "department", F.lit(f" allows {what}")))
    lines = F.array(
        F.concat(F.lit("Safe context detected: "), "context"), allows("sensitive", "sensitive discussions"),
        allows("legal", "policy examples"), allows("threat", "threat analysis"),
    )
    total = F.when(level == 2, F.format_string("Overall confidence threshold exceeded (%.3f >= 0.9)", "overall"))
    total = total.when((level == 1) & (hit == 0), F.format_string("Overall confidence review threshold exceeded (%.3f >= 0.7)", "overall"))
    soft = F.array_compact(F.concat(lines, F.transform("over", exceeded), F.array(total)))
    named = F.array(F.concat(F.lit("Hard rule: "), "hard.category", F.lit(" at "), "hard.severity", F.lit(" severity -> "), "hard.action"))
    reason = F.when(hard, "Hard rule violation - cannot be overridden").when(F.col("threat"), "Security department threat analysis allowance").when(F.col("legal"), "Legal department policy example allowance")
    return rows.select(
        *had, F.when(hard, "block").otherwise(ruled).alias("policy_decision"), F.when(hard, F.col("confidence")).otherwise(confidence).alias("policy_confidence"),
        "adjustment", F.when(hard, F.concat_ws(":", "hard.category", "hard.severity")).alias("hard_rule"), reason.alias("override_reason"), F.when(hard, named).otherwise(soft).alias("applied_rules"),
    )


def apply_policy(docs: DataFrame, decisions: DataFrame, scores: DataFrame, policies: dict[str, DataFrame]) -> DataFrame:
    """``with_policy`` for decisions and long tables of scores and texts, which are gathered by document first."""
    per_doc = scores.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("score", "category"))).alias("scores"))
    rows = decisions.join(per_doc, "doc_id", "left").join(policy_safe_context(docs), "doc_id", "left")
    return with_policy(rows, policy_rows(policies)).drop("scores", "context")


def policy_impact(applied: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    cols = [n(F.col("decision") == d).alias(f"before_{d}") for d in K.DECISIONS] + [n(F.col("policy_decision") == d).alias(f"after_{d}") for d in K.DECISIONS]
    return applied.groupBy(*by).agg(*cols, n(F.col("decision") != F.col("policy_decision")).alias("changed"))


def validate_policies(policies: dict[str, DataFrame]) -> DataFrame:
    """(tenant, warning): thresholds out of order, shifts out of range."""
    t = policies["thresholds"].groupBy("tenant", "category").pivot("severity", ["medium", "high", "critical"]).agg(F.first("threshold"))
    order = t.where("NOT (critical <= high AND high <= medium)").select("tenant", F.concat(F.lit("thresholds out of order: "), "category").alias("warning"))
    shift = policies["departments"].where("shift > 0.3 OR shift < -0.5").select("tenant", F.concat(F.lit("shift out of range: "), "department").alias("warning"))
    return order.unionByName(shift)


def policy_summary(policies: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in policies.items():
        n = t.groupBy("tenant").agg(F.count("*").alias(f"n_{name}"))
        out = n if out is None else out.join(n, "tenant", "full")
    return out


def content_hash_of(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def audit_decisions(applied: DataFrame, docs: DataFrame, ts: Column) -> DataFrame:
    """Audit envelopes: what was decided, by what, about which content, with compliance flags.

    ``applied`` may have each document's ``content_hash``; else ``docs`` are joined for it.
    """
    hard, override = F.col("hard_rule").isNotNull(), F.col("decision") != F.col("policy_decision")
    flags = F.array_compact(
        F.array(
            F.when(F.col("policy_decision") == "block", "content_blocked"), F.when(hard, "hard_rule_triggered"), F.when(override, "policy_override"),
            F.when(override & (F.col("confidence") > 0.8), "high_confidence_override"),
        )
    )
    details = F.struct(
        F.col("doc_id").cast("string").alias("request_id"), F.col("decision").alias("original_decision"), F.col("policy_decision").alias("final_decision"),
        (F.col("policy_confidence") - F.col("confidence")).alias("confidence_change"), "department", override.alias("override_applied"), hard.alias("hard_rule_triggered"),
        F.col("severity").alias("severity_level"),
    )
    known = "content_hash" in applied.columns
    rows = applied.where("doc_id is not null") if known else applied.join(docs.select("doc_id", content_hash_of(F.col("text")).alias("content_hash")), "doc_id")
    rows = rows.withColumn("timestamp", ts)
    return rows.select(
        F.concat(F.lit("dec-"), "doc_id").alias("entry_id"), "timestamp", F.to_date("timestamp").alias("event_date"), F.lit("policy_decision").alias("event_type"),
        F.col("tenant").alias("tenant_id"), details.alias("details"), "content_hash", flags.alias("compliance_flags"),
    )


def audit_overrides(overrides: DataFrame) -> DataFrame:
    """Manual overrides (request_id, tenant, user_id, ts, original, replaced) as audit rows."""
    return overrides.select(
        F.concat(F.lit("ovr-"), "request_id").alias("entry_id"), F.col("ts").alias("timestamp"), F.lit("manual_override").alias("event_type"), F.col("tenant").alias("tenant_id"), "user_id",
        F.struct("original", "replaced").alias("details"), F.array_compact(F.array(F.lit("manual_override"), F.when((F.col("original") == "block") & (F.col("replaced") == "allow"), "block_overridden"))).alias("compliance_flags"),
    )


def audit_policy_changes(versions: DataFrame) -> DataFrame:
    """(tenant, version, old_hash, new_hash, changed): each version of (tenant, version, config map) against the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("tenant").orderBy("version")
    rows = versions.withColumn("before", F.lag("config").over(w)).withColumn("text", F.to_json("config"))
    rows = rows.withColumn("old", F.lag("text").over(w)).where("before is not null")
    keys = F.array_union(F.map_keys("config"), F.map_keys("before"))
    changed = F.array_sort(F.filter(keys, lambda k: ~F.col("config")[k].eqNullSafe(F.col("before")[k])))
    return rows.select("tenant", "version", F.sha2("old", 256).alias("old_hash"), F.sha2("text", 256).alias("new_hash"), changed.alias("changed"))


def compliance_report(audit: DataFrame, tenant: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Totals by tenant and day, with subtotals, of decisions, blocks, overrides and hard rules."""
    rows = audit.where(F.col("tenant_id") == tenant) if tenant else audit
    rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp")) if start else rows
    rows = rows.where(F.col("timestamp") < F.lit(end).cast("timestamp")) if end else rows
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    flag = lambda f: n(F.array_contains("compliance_flags", f)).alias(f)
    return rows.rollup("tenant_id", "event_date").agg(F.count("*").alias("n"), *[flag(f) for f in ("content_blocked", "policy_override", "hard_rule_triggered", "high_confidence_override")])


def policy_trace_text(applied: DataFrame) -> DataFrame:
    """(doc_id, lines): the policy applied, a hard rule, and the signed shift."""
    shift = F.when(F.col("adjustment") > 0, "increased").otherwise("decreased")
    lines = F.array_compact(
        F.array(
            F.lit("Applied Policies:"), F.concat(F.lit("- "), "tenant"), F.when(F.col("hard_rule").isNotNull(), F.concat(F.lit("- hard rule "), "hard_rule")),
            F.when(F.col("adjustment") != 0, F.lit("Threshold Adjustments:")), F.when(F.col("adjustment") != 0, F.format_string("- %s by %.2f", shift, F.abs("adjustment"))),
        )
    )
    return applied.select("doc_id", lines.alias("lines"))
