"""Lexicon, pattern and emoji matching over a corpus, and folding of the spans found.

Lexicons are dimension tables of bounded size: they are built from the fixed values or
from tables the caller gives, and joined by broadcast only up to ``MOST_BROADCAST`` rows;
up to ``MOST_INLINE`` terms are a constant of the plan and need no join.
Spans are long tables (doc_id, start, end, text, category, confidence, rule_source).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.normalize import let
from textwarden.operators.sweep import cut, pieces_of, running, swept

MOST_BROADCAST = 50_000
#: Terms that are tried on each text one by one; a longer lexicon is joined by its terms' first letters.
MOST_INLINE = 1_000
FIRST = 3
FOUND = "array<struct<m:string,start:int,end:int>>"
SPANS = "array<struct<start:int,end:int,text:string,category:string,severity:string,confidence:double,rule_source:string>>"
SPAN = ("doc_id", "start", "end", "text", "category", "severity", "confidence", "rule_source")


def bounded(dimension: DataFrame) -> DataFrame:
    """A broadcast hint if the dimension is small."""
    return F.broadcast(dimension) if dimension.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else dimension


def lexicon_rows() -> list[tuple]:
    return [
        (lang, "term", t.lower(), category, severity, weight, script, context)
        for lang, category, severity, weight, script, context, terms in K.LEXICON
        for t in dict.fromkeys(terms)
    ]


def load_lexicon(spark: SparkSession, paths: list[str] | None = None) -> DataFrame:
    """(lang, kind, term, category, severity, weight, script, context_required).

    Without paths the built-in lexicon; otherwise JSON files of one object for each
    entry: lang, category, severity, weight, script, context_required, terms[].
    """
    names = "lang string, kind string, term string, category string, severity string, weight double, script string, context_required boolean"
    if not paths:
        return spark.createDataFrame(lexicon_rows(), names)
    entry = "lang string, category string, severity string, weight double, script string, context_required boolean, terms array<string>"
    rows = spark.read.schema(entry).json(paths)
    return rows.select(
        "lang", F.lit("term").alias("kind"), F.explode(F.array_distinct("terms")).alias("t"), "category", "severity", "weight", "script", "context_required"
    ).select("lang", "kind", F.lower("t").alias("term"), "category", "severity", F.coalesce("weight", F.lit(0.8)).alias("weight"), "script", F.coalesce("context_required", F.lit(False)).alias("context_required"))


def load_emoji_lexicon(spark: SparkSession, paths: list[str] | None = None) -> DataFrame:
    """(kind, sign, category, severity, weight, context_required): the built-in signs, or those of JSON files of one object for each."""
    names = "kind string, sign string, category string, severity string, weight double, context_required boolean"
    if not paths:
        return spark.createDataFrame(list(K.EMOJI), names)
    rows = spark.read.schema(names).json(paths).where("kind is not null and sign <> ''")
    return rows.select("kind", "sign", "category", "severity", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("context_required", F.lit(False)).alias("context_required")).distinct()


def load_patterns(spark: SparkSession, paths: list[str] | None = None) -> DataFrame:
    """(lang, pattern, category, severity, weight): the built-in patterns, or those of JSON files of one object for each."""
    names = "lang string, pattern string, category string, severity string, weight double"
    if not paths:
        return spark.createDataFrame(list(K.LEXICON_PATTERNS), names)
    rows = spark.read.schema(names).json(paths).where("pattern <> ''")
    return rows.withColumn("weight", F.coalesce("weight", F.lit(0.8))).distinct()


def starts_of(text: Column, term: Column) -> Column:
    """Code-point offsets of all non-overlapping occurrences of a literal in a text."""
    parts = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), F.lit(-1))
    ends = lambda ps: running(F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda p: F.length(p) + F.length(term)))
    return let(parts, lambda ps: F.transform(ends(ps), lambda e: e - F.length(term)))


def found_in(text: Column, pattern: str, keep=None) -> Column:
    """Array of (m, start, end): a text's matches of a pattern with their code-point offsets.

    The offsets are running sums of the lengths of matches and of the gaps between them;
    ``keep`` says of a match whether it is wanted.
    """

    def placed(all_: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(all_))
        ends = running(F.zip_with(all_, gaps, lambda m, g: F.length(g) + F.length(m)))
        found = F.zip_with(all_, ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("start"), e.alias("end")))
        return F.when(F.size(all_) > 0, found if keep is None else F.filter(found, lambda f: keep(f["m"]))).otherwise(F.array().cast(FOUND))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def span_of(start: Column, end: Column, text: Column, category: Column, severity: Column, confidence: Column, rule_source: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip(SPAN[1:], (start, end, text, category, severity, confidence, rule_source), strict=True)])


def inline_struct(start: Column, end: Column, text: Column, term: Column) -> Column:
    """The span of a term (lang, term, category, severity, weight)."""
    source = F.concat(F.lit("lexicon:"), term["lang"], F.lit(":"), term["term"])
    return span_of(start, end, text, term["category"], term["severity"], term["weight"], source)


def inline_rows(lexicon: DataFrame) -> list[dict] | None:
    """The terms of a lexicon, or null if it has more than MOST_INLINE."""
    rows = lexicon.select("lang", "term", "category", "severity", "weight").where("term <> ''").limit(MOST_INLINE + 1).collect()
    return None if len(rows) > MOST_INLINE else [r.asDict() for r in rows]


def inline_terms(lexicon: DataFrame) -> Column | None:
    """The lexicon as a constant array, or null if it has more than MOST_INLINE terms."""
    rows = inline_rows(lexicon)
    return None if rows is None else F.from_json(F.lit(json.dumps(rows)), "array<struct<lang:string,term:string,category:string,severity:string,weight:double>>")


def term_spans_of(text: Column, low: Column, terms: Column, lang: Column | None = None, whole_word: bool = False) -> Column:
    """Array of spans of one text (``low``: lower-cased) for every term it holds."""
    held = lambda low: F.filter(terms, lambda t: F.contains(low, t["term"]) if lang is None else (t["lang"] == lang) & F.contains(low, t["term"]))

    def starts(t: Column, near: Column) -> Column:
        every = starts_of(low, t["term"])
        if not whole_word:
            return every
        before = lambda s: cut(low, near, s - 1, F.lit(1))
        after = lambda s: cut(low, near, s + F.length(t["term"]), F.lit(1))
        word = r"[\p{L}\p{N}]"
        return F.filter(every, lambda s: ~((s > 0) & before(s).rlike(word)) & ~F.coalesce(after(s).rlike(word), F.lit(False)))

    def spans(pieces: Column, near: Column):
        def of(t: Column) -> Column:
            n = F.length(t["term"])
            return F.transform(starts(t, near), lambda s: inline_struct(s, s + n, cut(text, pieces, s, n), t))

        return of

    def every(ts: Column) -> Column:
        texts = F.struct(pieces_of(text).alias("p"), pieces_of(low if whole_word else F.lit("")).alias("near"))
        found = let(texts, lambda x: F.flatten(F.transform(ts, spans(x["p"], x["near"]))))
        return F.when(F.size(ts) > 0, found).otherwise(F.array().cast(SPANS))

    return let(let(low, held), every)


def first_letters(low: Column, sizes: list[int]) -> Column:
    """Every run of so many characters in a text, once."""
    runs = [F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def term_candidates(docs: DataFrame, low: Column, lexicon: DataFrame) -> DataFrame:
    """(docs' columns, low, terms): the terms whose first letters occur in a text, by an equi-join.

    The work for a text follows its own length and the terms that begin as it does
    somewhere, not the length of the lexicon.
    """
    terms = lexicon.where("term <> ''").select("lang", "term", "category", "severity", "weight", F.substring("term", 1, FIRST).alias("first"))
    sizes = sorted(r[0] for r in terms.select(F.length("first")).distinct().collect())  # at most FIRST rows
    t = F.struct("lang", "term", "category", "severity", "weight").alias("t")
    per_key = terms.groupBy("first").agg(F.collect_list(t).alias("ts"))
    rows = docs.withColumn("low", low)
    rows = rows.select("*", F.explode(first_letters(F.col("low"), sizes)).alias("first")).join(bounded(per_key), "first")
    held = F.filter("ts", lambda x: F.contains(F.col("low"), x["term"])).alias("terms")
    return rows.select(*docs.columns, "low", held).where("size(terms) > 0")


def match_terms(docs: DataFrame, lexicon: DataFrame, whole_word: bool = False, lang_scoped: bool = False) -> DataFrame:
    """Every occurrence of every term as a case-insensitive substring, as spans."""
    rows, low = docs.select("doc_id", "lang", "text"), F.lower("text")
    terms = inline_terms(lexicon)
    if terms is None:
        rows = term_candidates(rows, low, lexicon)
        terms = F.col("terms")
    else:
        rows = rows.withColumn("low", low)
    found = term_spans_of(F.col("text"), F.col("low"), terms, F.col("lang") if lang_scoped else None, whole_word)
    return rows.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


def pattern_counts(docs: DataFrame, patterns: tuple = K.LEXICON_PATTERNS) -> DataFrame:
    """(doc_id, pattern, category, severity, weight, n) for patterns that match, ignoring case."""
    found = [
        F.struct(
            F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(w).alias("weight"),
            F.regexp_count("text", F.lit("(?i)" + p)).alias("n"),
        )
        for _, p, c, s, w in patterns
    ]
    rows = docs.where(F.col("text").rlike("(?i)" + "|".join(p for _, p, *_ in patterns)))
    return rows.select("doc_id", F.explode(F.array(*found)).alias("f")).select("doc_id", "f.*").where("n > 0")


def pattern_spans_of(text: Column, patterns: tuple = K.LEXICON_PATTERNS) -> Column:
    """Array of spans of one text for every match of every pattern; offsets follow the matches through the text."""
    span = lambda lang, p, c, s, w: lambda m: span_of(m["start"], m["end"], m["m"], F.lit(c), F.lit(s), F.lit(w), F.lit(f"pattern:{lang}:{p}"))
    return F.concat(*[F.transform(found_in(text, "(?i)" + p), span(lang, p, c, s, w)) for lang, p, c, s, w in patterns])


def match_patterns(docs: DataFrame, patterns: tuple = K.LEXICON_PATTERNS) -> DataFrame:
    """Every match of every pattern as a span."""
    rows = docs.where(F.col("text").rlike("(?i)" + "|".join(p for _, p, *_ in patterns)))
    return rows.select("doc_id", F.explode(pattern_spans_of(F.col("text"), patterns)).alias("s")).select("doc_id", "s.*")


def category_scores_of(spans: Column) -> Column:
    """Array of (category, score): mean weight of a category's spans, at most 1."""

    def one(c: Column) -> Column:
        own = F.filter(spans, lambda s: s["category"] == c)
        total = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["confidence"])
        return F.struct(c.alias("category"), F.least(total / F.size(own), F.lit(1.0)).alias("score"))

    return F.transform(F.array_distinct(F.transform(spans, lambda s: s["category"])), one)


def match_fuzzy(docs: DataFrame, lexicon: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, word, term, category, severity, similarity, confidence, n): words that look like a term.

    Similarity is the mean of the Jaccard similarity of the letters and the ratio of
    lengths.  Distinct words alone meet the terms, joined by compatible lengths.
    """
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) >= 3")
    per_doc = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    letters = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)))
    # (jaccard + ratio) / 2 >= t needs a ratio of at least 2t - 1
    ratio = 2 * threshold - 1
    terms = lexicon.where("length(term) >= 3").select("term", "category", "severity", "weight", F.length("term").alias("m"), letters("term").alias("b"))
    lengths = F.explode(F.sequence(F.ceil(F.col("m") * ratio - 1e-9).cast("int"), F.floor(F.col("m") / ratio + 1e-9).cast("int")))
    terms = terms.withColumn("len", lengths)
    # letters are found once for a word and once for a term; a pair costs one intersection
    unique = per_doc.select("word").distinct().select("word", F.length("word").alias("len"), letters("word").alias("a"))
    both = unique.join(bounded(terms), "len").withColumn("common", F.size(F.array_intersect("a", "b")))
    jaccard = F.col("common") / (F.size("a") + F.size("b") - F.col("common"))
    both = both.withColumn("similarity", (jaccard + F.least("len", "m") / F.greatest("len", "m")) / 2)
    near = both.where((F.col("similarity") >= threshold) & (F.col("word") != F.col("term")))
    out = per_doc.join(near, "word")
    return out.select("doc_id", "word", "term", "category", "severity", "similarity", (F.col("weight") * F.col("similarity")).alias("confidence"), "n")


def deletions(word: Column, most: int) -> Column:
    """A word and what is left of it without up to ``most`` of its letters, each once."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.when(F.length(w) > 0, less(w)).otherwise(F.array(w)))))
        out = F.concat(out, last)
    return F.array_distinct(out)


def match_edited(docs: DataFrame, lexicon: DataFrame, distance: int = 1) -> DataFrame:
    """(doc_id, word, term, category, severity, distance, similarity, confidence, n): words up to ``distance`` edits away from a term.

    Two words that near have a deletion neighbourhood in common: without up to ``distance``
    letters of each something equal is left.  So distinct words and terms meet by an
    equi-join on what is left, and only those pairs are measured.  Words that are longer than
    all terms by more than the distance aren't taken apart.
    """
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) >= 3")
    per_doc = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    terms = lexicon.where("length(term) >= 3").select("term", "category", "severity", "weight").distinct()
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0
    unique = per_doc.select("word").distinct().where(F.length("word") <= longest + distance)
    left = unique.select("word", F.explode(deletions(F.col("word"), distance)).alias("rest"))
    right = terms.select("term").distinct().select("term", F.explode(deletions(F.col("term"), distance)).alias("rest"))
    pairs = left.join(bounded(right), "rest").select("word", "term").distinct().withColumn("distance", F.levenshtein("word", "term"))
    near = pairs.where((F.col("distance") <= distance) & (F.col("word") != F.col("term"))).join(bounded(terms), "term")
    similarity = 1 - F.col("distance") / F.greatest(F.length("word"), F.length("term"))
    out = per_doc.join(near.withColumn("similarity", similarity), "word")
    return out.select("doc_id", "word", "term", "category", "severity", "distance", "similarity", (F.col("weight") * F.col("similarity")).alias("confidence"), "n")


EMOJI_RUN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"


def match_emoji(docs: DataFrame, emoji: DataFrame, split_runs: bool = False) -> DataFrame:
    """(doc_id, emoji, kind, category, severity, confidence, n) of emoji runs in the offensive, then the anger table."""
    pattern = EMOJI_RUN.rstrip("+") if split_runs else EMOJI_RUN
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("emoji"))
    signs = emoji.where("kind IN ('offensive', 'anger')").select(F.col("sign").alias("emoji"), "kind", "category", "severity", F.col("weight").alias("confidence"))
    return runs.join(bounded(signs), "emoji").groupBy("doc_id", "emoji", "kind", "category", "severity", "confidence").agg(F.count("*").alias("n"))


def match_kaomoji(docs: DataFrame, emoji: DataFrame) -> DataFrame:
    """(doc_id, sign, category, severity, confidence, start) of every kaomoji of the table, matched as literal terms."""
    signs = emoji.where("kind = 'kaomoji'").select(F.lit("kaomoji").alias("lang"), F.col("sign").alias("term"), "category", "severity", "weight")
    rows, terms, text = docs.select("doc_id", "text"), inline_terms(signs), F.col("text")
    if terms is None:
        rows = term_candidates(rows, text, signs)
        terms = F.col("terms")
    found = rows.select("doc_id", F.explode(term_spans_of(text, text, terms)).alias("s"))
    return found.select("doc_id", F.col("s.text").alias("sign"), "s.category", "s.severity", "s.confidence", "s.start")


def match_emoji_combinations(docs: DataFrame) -> DataFrame:
    rows = [(None, s, c, v, w) for kind, s, c, v, w, _ in K.EMOJI if kind == "combination"]
    return pattern_counts(docs, tuple(rows))


def dedupe_exact_spans(spans: DataFrame) -> DataFrame:
    """Of spans with the same ends the heaviest stays."""
    w = Window.partitionBy("doc_id", "start", "end").orderBy(F.desc("confidence"), "category", "rule_source")
    return spans.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """Greedy over (start, end, heavier first): an overlapping span replaces the first kept one it overlaps if heavier."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*SPAN[1:])).alias("spans"))
    return with_kept(per_doc).select("doc_id", F.explode("kept").alias("s")).select("doc_id", *[f"s.{c}" for c in SPAN[1:]])


def with_kept(per_doc: DataFrame) -> DataFrame:
    """Adds ``kept``, what stays of a document's ``spans``."""
    rest = [c for c in SPAN[1:] if c not in ("start", "end")]
    item = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (-s["confidence"]).alias("lighter"), *[s[c].alias(c) for c in rest])
    per_doc = per_doc.withColumn("all", F.array_sort(F.transform("spans", item)))

    def step(live: Column, s: Column) -> Column:
        # spans come by their start, so one that ends before it is settled
        done, open_ = F.filter(live, lambda k: k["end"] <= s["start"]), F.filter(live, lambda k: k["end"] > s["start"])

        def placed(kept: Column) -> Column:
            clash = F.array_position(F.transform(kept, lambda k: k["start"] < s["end"]), F.lit(True)).cast("int")
            swapped = lambda at: F.transform(kept, lambda k, i: F.when(i == at - 1, s).otherwise(k))
            lighter = lambda at: F.get(kept, at - 1)["lighter"]
            return let(clash, lambda at: F.when(at == 0, F.concat(kept, F.array(s))).when(s["lighter"] < lighter(at), swapped(at)).otherwise(kept))

        return F.struct(let(open_, placed).alias("live"), done.alias("out"))

    kind = per_doc.schema["all"].dataType.simpleString()
    return per_doc.withColumn("kept", swept(F.col("all"), F.slice("all", 1, 0), kind, step)).drop("all")


def lpe_category_scores(matches: DataFrame) -> DataFrame:
    """(doc_id, category, score): mean weight, at most 1, before any de-duplication."""
    return matches.groupBy("doc_id", "category").agg(F.least(F.avg("confidence"), F.lit(1.0)).alias("score"))


def trace_of(rule_source: Column, category: Column, confidence: Column) -> Column:
    return F.concat(F.lit("Rule: "), rule_source, F.lit(" -> Category: "), category, F.lit(" -> Weight: "), F.format_string("%.2f", confidence))


def rule_traces(matches: DataFrame) -> DataFrame:
    line = trace_of(*map(F.col, ("rule_source", "category", "confidence")))
    return matches.select("doc_id", line.alias("trace")).groupBy("doc_id").agg(F.array_sort(F.collect_set("trace")).alias("traces"))


def traces_of(spans: Column) -> Column:
    """The traces of one document's spans, each once."""
    named = F.array_distinct(F.transform(spans, lambda s: F.struct(s["rule_source"].alias("r"), s["category"].alias("c"), s["confidence"].alias("w"))))
    return F.array_sort(F.array_distinct(F.transform(named, lambda s: trace_of(s["r"], s["c"], s["w"]))))


def search_lexicon(lexicon: DataFrame, term: str | None = None, category: str | None = None, severity: str | None = None, langs: list[str] | None = None) -> DataFrame:
    out = lexicon
    for name, value in (("term", term and term.lower()), ("category", category), ("severity", severity)):
        out = out.where(F.col(name) == value) if value else out
    return out.where(F.col("lang").isin(langs)) if langs else out


def lexicon_statistics(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("lang").agg(F.count("*").alias("terms"), F.count_distinct("category").alias("categories"), F.avg("weight").alias("avg_weight"))


def overlay_lexicon(lexicon: DataFrame, tenant_terms: DataFrame) -> DataFrame:
    """The base lexicon for every tenant, with each tenant's own terms (tenant + lexicon columns) added."""
    tenants = tenant_terms.select("tenant").distinct()
    base = tenants.join(bounded(lexicon), F.lit(True)).select("tenant", *lexicon.columns)
    return base.unionByName(tenant_terms.select("tenant", *lexicon.columns)).dropDuplicates(["tenant", "lang", "term", "category"])


def emoji_statistics(matches: DataFrame, by: list[str]) -> DataFrame:
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return matches.groupBy(*by).agg(F.sum("n").alias("total"), n(F.col("kind") == "offensive")("offensive"), n(F.col("kind") == "anger")("anger"), n(F.col("severity") == "high")("high"))


def emoji_context(matches: DataFrame, docs: DataFrame, window: int = 10) -> DataFrame:
    """Adds to (doc_id, start, end) the kinds of words within ``window`` characters, and their share as ``risk_score``."""
    rows = matches.join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    near = F.expr(f"substring(low, greatest(start - {window}, 0) + 1, end + {window} - greatest(start - {window}, 0))")
    rows = rows.withColumn("near", near)
    kinds = {k: F.col("near").rlike("|".join(words)) for k, words in K.EMOJI_CONTEXT.items()}
    risk = sum((c.cast("double") for c in kinds.values()), F.lit(0.0)) / len(kinds)
    return rows.select(*matches.columns, *[c.alias(k) for k, c in kinds.items()], risk.alias("risk_score"))


def match_transliterated(native: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, roman, term, category, severity, confidence, rule_source): lexicon terms in transliterated words (doc_id, roman, native)."""
    rows, terms = native.select("doc_id", "roman", "native"), inline_terms(lexicon)
    if terms is None:
        rows = term_candidates(rows, F.col("native"), lexicon)
        terms = F.col("terms")
    held = F.filter(terms, lambda t: F.contains(F.col("native"), t["term"]))
    hits = rows.select("doc_id", "roman", F.explode(held).alias("t")).select("doc_id", "roman", F.col("t.lang").alias("term_lang"), "t.term", "t.category", "t.severity", F.col("t.weight").alias("confidence"))
    source = F.concat(F.lit("lexicon:"), "term_lang", F.lit(":"), "term", F.lit(":transliterated:"), "roman")
    return hits.select("doc_id", "roman", "term", "category", "severity", "confidence", source.alias("rule_source"))
