"""Negation, quotation and legitimate contexts around spans, and what they do to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.matching import FOUND, found_in
from textwarden.operators.normalize import let
from textwarden.operators.sweep import counts_upto, distinct_of, running, swept, touched

WORD = r"[\p{L}\p{M}\p{N}_]"


def whole(body: str) -> str:
    """A pattern that holds where no word goes on before or after it."""
    return f"(?i)(?<!{WORD})(?:{body})(?!{WORD})"


CUES = {
    "english": (whole("|".join(K.NEGATIONS)), 0.9),
    "hindi": (whole("|".join(K.HINDI_NEGATIONS)), 0.9),
    "contraction": (whole(f"{WORD}+n't"), 0.95),
    "prefix": (whole(f"(?:{'|'.join(K.NEGATION_PREFIXES)}){WORD}+"), 0.7),
    "suffix": (whole(f"{WORD}+(?:{'|'.join(K.NEGATION_SUFFIXES)})"), 0.7),
}
SCOPE_WORDS = 8
DIRECT = (r'(?s)"[^"]*"', r"(?s)'[^']*'", r"(?s)«[^»]*»", r"(?s)“[^”]*”")
INDIRECT = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(K.REPORTING) + r")(?![\p{L}\p{N}_])"
THIRD = "(?i)" + "|".join(K.THIRD_PARTY)
QUOTES = "array<struct<start:int,end:int,quote_type:string,confidence:double>>"


#: What a scope is made of: words and what may stand between them.
STEP = rf"[^\p{{L}}\p{{M}}\p{{N}}_.!?;,]*{WORD}+"
#: After a cue: so many words, or all up to one of .!?;, or as many words as there are.
SCOPE = "((?:{step}){{{n}}}|[^.!?;,]*(?=[.!?;,])|(?:{step})*)"


def cues_of(text: Column, morphological: bool = True, max_words: int = SCOPE_WORDS) -> Column:
    """Array of (kind, cue, start, end, confidence, scope_end) of one text, in time linear in its length.

    A scope goes from the cue to the eighth word after it, or to .!?;, if one comes first; it
    is found along with the cue, by looking ahead.
    """
    kinds = [(k, *v) for k, v in CUES.items() if morphological or k not in ("prefix", "suffix")]
    scope = SCOPE.format(step=STEP, n=max_words)

    def of(kind: str, pattern: str, c: float) -> Column:
        def placed(all_: Column) -> Column:
            tails = F.regexp_extract_all(text, F.lit(f"{pattern}(?={scope})"), F.lit(1))
            gaps = F.slice(F.split(text, pattern, -1), 1, F.size(all_))
            ends = running(F.zip_with(all_, gaps, lambda m, g: F.length(g) + F.length(m)))
            cue = lambda m, e, n: F.struct(F.lit(kind).alias("kind"), m.alias("cue"), (e - F.length(m)).alias("start"), e.alias("end"), F.lit(c).alias("confidence"), (e + n).alias("scope_end"))
            both = F.zip_with(all_, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e")))
            return F.zip_with(both, tails, lambda b, t: cue(b["m"], b["e"], F.length(t)))

        found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
        return F.when(text.rlike(pattern), found).otherwise(F.array().cast(CUE))

    return F.concat(*[of(*k) for k in kinds])


CUE = "array<struct<kind:string,cue:string,start:int,end:int,confidence:double,scope_end:int>>"


def negation_of(text: Column, spans: Column, morphological: bool = True) -> Column:
    """Of one text: the confidence of the surest cue whose scope a span touches, else null."""
    scopes = F.transform(cues_of(text, morphological), lambda c: F.struct(c["start"].alias("start"), c["scope_end"].alias("end"), c["confidence"].alias("confidence")))
    return let(scopes, lambda x: touched(spans, x))


def negation_cues(docs: DataFrame, morphological: bool = True, max_words: int = SCOPE_WORDS) -> DataFrame:
    """(doc_id, kind, cue, start, end, confidence, scope_end)."""
    return docs.select("doc_id", F.explode(cues_of(F.col("text"), morphological, max_words)).alias("c")).select("doc_id", "c.*")


def negation_scopes(cues: DataFrame) -> DataFrame:
    """Adds scope_start: a scope goes from its cue to scope_end."""
    return cues.withColumn("scope_start", F.col("start"))


def negated_spans(spans: DataFrame, scopes: DataFrame) -> DataFrame:
    """(doc_id, start, end, negation): spans that touch a scope, with the most confident cue.

    Spans and scopes of a document meet in its row, one span's scopes by two counts: of
    those that begin up to its end, as many as end before its start don't touch it.
    """
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    s = scopes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("scope_start").alias("start"), F.col("scope_end").alias("end"), "confidence"))).alias("scopes"))
    both = per_doc.join(s, "doc_id")
    levels = sorted({c for _, c in CUES.values()}, reverse=True)

    def touching(level: float) -> Column:
        """For each span whether a scope of this confidence touches it."""
        own = F.filter("scopes", lambda x: x["confidence"] == level)
        begun = counts_upto(F.transform(own, lambda x: x["start"]), F.transform("spans", lambda x: x["end"]))
        gone = counts_upto(F.transform(own, lambda x: x["end"] + 1), F.transform("spans", lambda x: x["start"]))
        return F.zip_with(begun, gone, lambda a, b: F.when(a > b, F.lit(level)))

    best = F.arrays_zip(*[touching(v).alias(f"l{k}") for k, v in enumerate(levels)])
    surest = F.transform(best, lambda x: F.coalesce(*[x[f"l{k}"] for k in range(len(levels))]))
    found = both.select("doc_id", F.explode(F.zip_with("spans", surest, lambda x, c: F.struct(x["start"].alias("start"), x["end"].alias("end"), c.alias("negation")))).alias("x"))
    return found.select("doc_id", "x.*").where("negation is not null")


def quote(kind: str, confidence: float):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("quote_type"), F.lit(confidence).alias("confidence"))


def direct_quotes_of(text: Column) -> Column:
    return F.concat(*[F.transform(found_in(text, p), quote("direct", 0.95)) for p in DIRECT])


def sentences_of(text: Column, holding: str) -> Column:
    """What stands between sentence ends and holds a pattern; texts without it aren't cut up."""
    found = found_in(text, r"[^.!?]+", lambda m: m.rlike(holding) & (F.trim(m) != ""))
    return F.when(text.rlike(holding), found).otherwise(F.array().cast(FOUND))


def indirect_quotes_of(text: Column) -> Column:
    return F.transform(sentences_of(text, INDIRECT), quote("indirect", 0.7))


def third_party_references_of(text: Column) -> Column:
    return F.transform(sentences_of(text, THIRD), quote("reported", 0.6))


def exploded_quotes(docs: DataFrame, of) -> DataFrame:
    return docs.select("doc_id", F.explode(of(F.col("text"))).alias("q")).select("doc_id", "q.start", "q.end", "q.quote_type", "q.confidence")


def direct_quotes(docs: DataFrame) -> DataFrame:
    return exploded_quotes(docs, direct_quotes_of)


def indirect_quotes(docs: DataFrame) -> DataFrame:
    return exploded_quotes(docs, indirect_quotes_of)


def third_party_references(docs: DataFrame) -> DataFrame:
    return exploded_quotes(docs, third_party_references_of)


def all_quotes_of(text: Column) -> Column:
    return F.concat(direct_quotes_of(text), indirect_quotes_of(text), third_party_references_of(text))


def resolved_of(quotes: Column) -> Column:
    """Greedy by start: of two that overlap the more confident stays.  Array of (start, less, end, quote_type), less = -confidence."""
    item = lambda q: F.struct(q["start"].alias("start"), (-q["confidence"]).alias("less"), q["end"].alias("end"), q["quote_type"].alias("quote_type"))

    def step(live: Column, q: Column) -> Column:
        last = F.get(live, F.lit(0))
        apart = (F.size(live) == 0) | (q["start"] >= last["end"])
        better = apart | (q["less"] < last["less"])
        return F.struct(F.when(better, F.array(q)).otherwise(live).alias("live"), F.when(apart, live).otherwise(F.slice(live, 1, 0)).alias("out"))

    return let(distinct_of(F.transform(quotes, item)), lambda every: swept(every, F.slice(every, 1, 0), RESOLVED, step))


RESOLVED = "array<struct<start:int,less:double,end:int,quote_type:string>>"


def resolve_quotes(quotes: DataFrame) -> DataFrame:
    """(doc_id, start, end, quote_type, confidence) of the quotes that stay."""
    per_doc = quotes.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "quote_type", "confidence")).alias("all"))
    kept = per_doc.select("doc_id", F.explode(resolved_of(F.col("all"))).alias("q"))
    return kept.select("doc_id", "q.start", "q.end", "q.quote_type", (-F.col("q.less")).alias("confidence"))


def quotation_of(text: Column, spans: Column) -> Column:
    """Of one text: (quotation, most) of the spans in quotes: the surest, and the greatest share of a quote type; null without one.

    Of several quotes around one span the surest counts, then the earliest.
    """

    share = weighted(QUOTE_SHARE)
    totals = lambda b: F.struct(F.array_max(F.transform(b, lambda x: x["quotation"])).alias("quotation"), F.array_max(F.transform(b, lambda x: share[x["quote_type"]])).alias("most"))
    found = lambda quotes: F.when((F.size(spans) > 0) & (F.size(quotes) > 0), F.filter(best_quotes(spans, quotes), lambda b: b.isNotNull()))
    return let(resolved_of(all_quotes_of(text)), lambda quotes: let(found(quotes), lambda b: F.when(F.size(b) > 0, totals(b))))


def best_quotes(spans: Column, quotes: Column) -> Column:
    """For each span (quotation, early, quote_type) of the quote around it, or null.

    Quotes come by their start and don't overlap, so the ones that a span overlaps stand
    together: after those that end up to its start, before those that start at its end.
    """
    gone = counts_upto(F.transform(quotes, lambda q: q["end"]), F.transform(spans, lambda s: s["start"]))
    begun = counts_upto(F.transform(quotes, lambda q: q["start"]), F.transform(spans, lambda s: s["end"] - 1))

    def around(s: Column, a: Column, b: Column) -> Column:
        sure = lambda q: F.when((s["start"] >= q["start"]) & (s["end"] <= q["end"]), -q["less"]).otherwise(-q["less"] * 0.8)
        rated = lambda q: F.struct(sure(q).alias("quotation"), (-q["start"]).alias("early"), q["quote_type"].alias("quote_type"))
        return F.when(b > a, F.array_max(F.transform(F.slice(quotes, a + 1, F.greatest(b - a, F.lit(0))), rated)))

    placed = F.zip_with(gone, begun, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(spans, placed, lambda s, x: around(s, x["a"], x["b"]))


def quoted_spans(spans: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, start, end, quotation, quote_type): inside a quote its confidence, partly inside 0.8 of it.

    ``quotes`` don't overlap (``resolve_quotes``).
    """
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    item = F.struct("start", (-F.col("confidence")).alias("less"), "end", "quote_type")
    q = quotes.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("quotes"))
    rows = per_doc.join(q, "doc_id").select("doc_id", F.explode(F.zip_with("spans", best_quotes(F.col("spans"), F.col("quotes")), lambda s, b: F.struct(s.alias("s"), b.alias("b")))).alias("x"))
    return rows.where("x.b is not null").select("doc_id", "x.s.start", "x.s.end", "x.b.quotation", "x.b.quote_type")


def words_pattern(words) -> str:
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}_])"


def safe_contexts_of(low: Column, vocab: dict = K.SAFE_CONTEXTS) -> Column:
    """Array of (context_type, hits, confidence) of a lower-cased text: 0.3 and 0.2 a hit, at most 0.9."""
    everything = words_pattern(dict.fromkeys(w for words in vocab.values() for w in words))
    found = F.array(*[F.struct(F.lit(t).alias("context_type"), F.regexp_count(low, F.lit(words_pattern(w))).alias("hits")) for t, w in vocab.items()])
    return F.when(low.rlike(everything), sure_of(F.filter(found, lambda f: f["hits"] > 0)))


def sure_of(found: Column) -> Column:
    """Adds confidence to an array of (context_type, hits)."""
    return F.transform(found, lambda f: F.struct(f["context_type"].alias("context_type"), f["hits"].alias("hits"), F.least(F.lit(0.9), 0.3 + 0.2 * f["hits"]).alias("confidence")))


def safe_of(contexts: Column) -> Column:
    """Of one text's contexts: mean confidence weighted by how much each context counts; null without any."""
    total = lambda f: F.aggregate(contexts, F.lit(0.0), lambda a, c: a + f(c))
    w = lambda c: weighted(K.SAFE_WEIGHTS)[c["context_type"]]
    return F.when(F.size(contexts) > 0, total(lambda c: c["confidence"] * w(c)) / total(w))


def safe_contexts(docs: DataFrame, vocab: dict = K.SAFE_CONTEXTS) -> DataFrame:
    """(doc_id, context_type, hits, confidence): contexts whose words occur; 0.3 and 0.2 a hit, at most 0.9."""
    rows = docs.select("doc_id", F.lower("text").alias("low"))
    return rows.select("doc_id", F.explode(safe_contexts_of(F.col("low"), vocab)).alias("f")).select("doc_id", "f.*")


def weighted(names: dict[str, float]):
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def safe_context_modifiers(contexts: DataFrame) -> DataFrame:
    """(doc_id, safe): mean confidence weighted by how much each context counts."""
    w = weighted(K.SAFE_WEIGHTS)[F.col("context_type")]
    return contexts.groupBy("doc_id").agg((F.sum(F.col("confidence") * w) / F.sum(w)).alias("safe"))


QUOTE_SHARE = {"direct": 0.6, "indirect": 0.4, "reported": 0.5}


def modifier_of(category: Column, negation: Column, quotation: Column, most: Column, safe: Column) -> Column:
    """What negation, quotation and context leave of a category's score: at least 0.1."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    safe_ = F.when(category != "spam/scam", zero(safe)).otherwise(0.0)
    return F.greatest(F.lit(0.1), (1 - 0.7 * zero(negation)) * (1 - zero(most) * zero(quotation)) * (1 - 0.8 * safe_))


def modifiers_of(contexts: DataFrame) -> DataFrame:
    """(doc_id, category, score, modifier) from ``engine.document_contexts``."""
    rows = contexts.select("doc_id", F.explode("scores").alias("s"), "negation", "quotation", "most", "safe")
    return rows.select("doc_id", "s.category", "s.score", modifier_of(F.col("s.category"), *map(F.col, ("negation", "quotation", "most", "safe"))).alias("modifier"))


def flags_of(contexts: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, has_negation, has_quotation, is_safe_context, each context) from ``engine.document_contexts``."""
    known = F.col("doc_id").isNotNull()
    holds = lambda test: known & F.exists("contexts", test)
    kind = lambda t: holds(lambda c: c["context_type"] == t)
    kinds = [kind(t).alias(t) for t in K.SAFE_CONTEXTS]
    return contexts.select("doc_id", F.col("negation").isNotNull().alias("has_negation"), (known & F.col("quoted")).alias("has_quotation"), holds(lambda c: c["confidence"] >= 0.5).alias("is_safe_context"), *kinds, *more)


def context_modifiers(scores: DataFrame, spans: DataFrame, negated: DataFrame, quoted: DataFrame, safe: DataFrame) -> DataFrame:
    """(doc_id, category, modifier), at least 0.1: what negation, quotation and context leave of a score."""
    per_neg = negated.groupBy("doc_id").agg(F.max("negation").alias("neg"))
    share = weighted(QUOTE_SHARE)[F.col("quote_type")]
    per_quote = quoted.groupBy("doc_id").agg(F.max("quotation").alias("quote"), F.max(share).alias("most"))
    rows = scores.select("doc_id", "category").join(per_neg, "doc_id", "left").join(per_quote, "doc_id", "left").join(safe, "doc_id", "left")
    return rows.select("doc_id", "category", modifier_of(*map(F.col, ("category", "neg", "quote", "most", "safe"))).alias("modifier"))


def context_flags(docs: DataFrame, negated: DataFrame, quoted: DataFrame, contexts: DataFrame) -> DataFrame:
    has = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    kinds = contexts.groupBy("doc_id").agg(
        (F.max("confidence") >= 0.5).alias("is_safe_context"), *[F.max(F.col("context_type") == t).alias(t) for t in K.SAFE_CONTEXTS]
    )
    out = docs.select("doc_id").join(has(negated, "has_negation"), "doc_id", "left").join(has(quoted, "has_quotation"), "doc_id", "left").join(kinds, "doc_id", "left")
    return out.fillna(False)


def recommended_action(modifiers: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, action): mean modifier first, else the largest score."""
    m = modifiers.groupBy("doc_id").agg(F.round(F.avg("modifier"), 9).alias("m"))
    s = scores.groupBy("doc_id").agg(F.round(F.max("score"), 9).alias("s"))
    return s.join(m, "doc_id", "left").select("doc_id", action_of(F.col("m"), F.col("s")).alias("action"))


def action_of(m: Column, s: Column) -> Column:
    return F.when(m < 0.3, "allow").when(m < 0.7, "review").when(s > 0.8, "block").when(s > 0.5, "review").otherwise("allow")


def recommended_in(contexts: DataFrame) -> DataFrame:
    """(doc_id, action) of the documents with scores, from ``engine.document_contexts``."""
    return contexts.select("doc_id", recommended_of().alias("action")).where("action is not null")


def recommended_of() -> Column:
    """The action by a document's mean modifier and largest score, in its own row; null without scores."""
    modifier = lambda s: modifier_of(s["category"], *map(F.col, ("negation", "quotation", "most", "safe")))
    total = F.aggregate(F.transform("scores", modifier), F.lit(0.0), lambda a, x: a + x)
    m, s = F.round(total / F.size("scores"), 9), F.round(F.array_max(F.transform("scores", lambda x: x["score"])), 9)
    return F.when(F.size("scores") > 0, action_of(m, s))


def explained_in(contexts: DataFrame) -> DataFrame:
    """(doc_id, lines) from ``engine.document_contexts``: flags and action in a document's own row."""
    rows = flags_of(contexts, recommended_of().alias("action"))
    return rows.select("doc_id", F.array_compact(F.array(*sentences_said())).alias("lines"))


def adjust_confidence(scores: DataFrame, flags: DataFrame, language_factor: float = 1.0) -> DataFrame:
    """(doc_id, category, original, adjusted, factor) from (doc_id, negation, quotation, safe) by category sensitivities."""
    return adjusted_rows(scores.join(flags, "doc_id", "left"), language_factor)


def adjusted_in(contexts: DataFrame, language_factor: float = 1.0) -> DataFrame:
    """The same of ``engine.document_contexts``."""
    rows = contexts.select("doc_id", F.explode("scores").alias("s"), "negation", "quotation", "safe")
    return adjusted_rows(rows.select("doc_id", "s.category", "s.score", "negation", "quotation", "safe"), language_factor)


def adjusted_rows(rows: DataFrame, language_factor: float) -> DataFrame:
    pick = lambda k: F.coalesce(weighted({c: v[k] for c, v in K.SENSITIVITY.items()})[F.col("category")], F.lit(K.DEFAULT_SENSITIVITY[k]))
    rows = rows.fillna(0.0, ["negation", "quotation", "safe"])
    c = F.col("score") * (1 - F.col("negation") * pick(0)) * (1 - F.col("quotation") * pick(1)) * (1 - F.col("safe") * pick(2)) * language_factor
    rows = rows.withColumn("c", c)
    k = F.when(F.col("c") < 0.1, 1.1).when(F.col("c") > 0.9, 0.95).otherwise(1 / (1 + F.exp(-5 * (F.col("c") - 0.5))) / F.col("c"))
    adjusted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") * k))
    factor = F.when(F.col("score") > 0, adjusted / F.col("score")).otherwise(1.0)
    return rows.select("doc_id", "category", F.col("score").alias("original"), adjusted.alias("adjusted"), factor.alias("factor"))


ACTION_SHIFTS = {"threat/violence": (-0.1, -0.1), "self-harm encouragement": (-0.1, -0.1), "obscenity/profanity": (0.1, 0.05)}


def category_actions(adjusted: DataFrame, block: float = 0.8, review: float = 0.5) -> DataFrame:
    shift = lambda k: F.coalesce(weighted({c: float(v[k]) for c, v in ACTION_SHIFTS.items()})[F.col("category")], F.lit(0.0))
    action = F.when(F.col("adjusted") >= block + shift(0), "block").when(F.col("adjusted") >= review + shift(1), "review").otherwise("allow")
    return adjusted.withColumn("action", action)


def contextual_decision(actions: DataFrame) -> DataFrame:
    best = F.max(F.struct("adjusted", "category", "action")).alias("b")
    return actions.groupBy("doc_id").agg(best).select("doc_id", "b.category", F.col("b.adjusted").alias("confidence"), F.col("b.action").alias("decision"))


def adjustment_summary(adjusted: DataFrame) -> DataFrame:
    changed = F.abs(F.col("adjusted") - F.col("original")) > 0.01
    return adjusted.groupBy("category").agg(
        F.count("*").alias("n"), F.sum(changed.cast("long")).alias("n_adjusted"), F.avg("factor").alias("mean_factor"),
        F.min("factor").alias("min_factor"), F.max("factor").alias("max_factor"),
    )


def context_explanations(flags: DataFrame, actions: DataFrame) -> DataFrame:
    """(doc_id, lines): fixed sentences for flags and for the action."""
    return flags.join(actions, "doc_id", "left").select("doc_id", F.array_compact(F.array(*sentences_said())).alias("lines"))


def sentences_said() -> list[Column]:
    return [F.when(F.col(f), text) for f, text in K.CONTEXT_SENTENCES.items()] + [F.when(F.col("action") == a, text) for a, text in K.ACTION_SENTENCES.items()]
