"""The whole lexicon engine: everything that a text is matched with, in one scan of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators import align, context, matching


def engine_terms(lexicon: list[dict], signs: list[dict]) -> list[dict]:
    """All that is matched literally, with ``source``: lexicon terms, words that sound like a term of another script, emoji and kaomoji."""
    out = [r | {"source": f"lexicon:{r['lang']}"} for r in lexicon]
    for lang, words in K.TRANSLITERATION.items():
        for roman, native in words.items():
            out += [r | {"term": roman, "source": f"lexicon:{lang}:{r['term']}:transliterated"} for r in lexicon if r["lang"] == lang and r["term"] in native]
    return out + [r | {"source": r["lang"]} for r in signs]


FIELDS = ("lang", "term", "category", "severity", "weight")


def with_spans(rows: DataFrame, lexicon: DataFrame | None, emoji: DataFrame | None, more: list[tuple] = ()) -> DataFrame:
    """Replaces ``text`` and ``low`` by spans, negation, quotation and most, and what ``align.placed`` adds; the other columns stay.

    A lexicon of the caller's that is too long for a constant is matched as a table, in the
    texts as they are, and gathered by document; signs and patterns are placed as always.
    """
    terms = [dict(zip(FIELDS, (r[0], *r[2:6]), strict=True)) for r in matching.lexicon_rows()] if lexicon is None else matching.inline_rows(lexicon)
    signs = [dict(zip(FIELDS, r[:5], strict=True)) for r in K.EMOJI if r[0] != "combination"]
    if emoji is not None:
        named = emoji.where("kind <> 'combination'").select(F.col("kind").alias("lang"), F.col("sign").alias("term"), "category", "severity", "weight")
        signs = matching.inline_rows(named) or []
    far = terms is None
    if far:
        found = matching.match_terms(rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang")), lexicon)
        found = found.groupBy("doc_id").agg(F.collect_list(F.struct(*matching.SPAN[1:])).alias("by_term"))
        rows = rows.join(found, "doc_id", "left")
    words = engine_terms(terms or [], signs)
    patterns = [*K.LEXICON_PATTERNS, *[("emoji", *r[1:5]) for r in K.EMOJI if r[0] == "combination"]]
    rows = align.placed(rows, words, patterns, more)
    return rows.withColumn("spans", F.concat("spans", F.coalesce("by_term", F.slice("spans", 1, 0)))).drop("by_term") if far else rows


def document_contexts(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, scores, negation, quotation, most, safe, contexts, quoted) of the documents, their texts scanned once.

    ``scores``: array of (category, score) of the lexicon's terms as they are; ``quoted``: whether
    there is any quote.  No text is shuffled, only what was found in it: rows of the same id
    are one document, each text judged by itself; without an id there are but scores, as a join on the
    id gives nothing else.
    """
    rows, terms = docs.select("doc_id", "text", F.lower("text").alias("low")), matching.inline_rows(lexicon)
    if terms is None:
        found = matching.match_terms(rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang")), lexicon)
        found = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "category", "confidence")).alias("found"))
        rows = rows.join(found, "doc_id", "left")
    each = align.surrounded(rows, terms or [])
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "contexts")]
    per_doc = each.groupBy("doc_id").agg(*lists, *[F.max(c).alias(c) for c in ("negation", "quotation", "most", "quoted")])
    sure = lambda c: F.struct(c["context_type"].alias("context_type"), c["hits"].alias("hits"), F.least(F.lit(0.9), 0.3 + 0.2 * c["hits"]).alias("confidence"))
    per_doc = per_doc.withColumn("contexts", F.transform("contexts", sure))
    known = lambda name, c: F.when(F.col("doc_id").isNotNull(), c).alias(name)
    near = [known(c, F.col(c)) for c in ("negation", "quotation", "most")]
    return per_doc.select("doc_id", matching.category_scores_of(F.col("spans")).alias("scores"), *near, known("safe", context.safe_of(F.col("contexts"))), "contexts", "quoted")


def scanned_documents(docs: DataFrame, lexicon: DataFrame | None = None, emoji: DataFrame | None = None, fuzzy: int | None = None) -> DataFrame:
    """(doc_id, spans, kept, scores, traces) of the documents (doc_id, text) in which anything matches, their texts scanned once.

    Lexicon terms and words that sound like them, in the text and in its matchable form,
    patterns, emoji, kaomoji and their combinations; with ``fuzzy`` also whole words
    at most so many edits away from a term.  Scores and traces are of all matches (``spans``); ``kept``
    are those that stay when some overlap.  No text is shuffled, only what was found in it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_spans(rows.withColumn("low", F.lower("text")), lexicon, emoji).select("doc_id", "spans").where("size(spans) > 0")
    if fuzzy:
        terms = lexicon if lexicon is not None else matching.load_lexicon(docs.sparkSession)
        near = matching.match_edited(rows, terms, fuzzy).groupBy("word", "category").agg(F.max(F.struct("confidence", "severity", "term")).alias("m"))
        near = near.select(F.concat(F.lit("fuzzy:"), "m.term").alias("lang"), F.col("word").alias("term"), "category", "m.severity", F.col("m.confidence").alias("weight"))
        more = matching.match_terms(rows.withColumn("lang", F.lit(None).cast("string")), near, whole_word=True)
        found = found.unionByName(more.select("doc_id", F.array(F.struct(*matching.SPAN[1:])).alias("spans")))
    per_doc = found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = F.col("spans")
    return matching.with_kept(per_doc).select("doc_id", "spans", "kept", matching.category_scores_of(spans).alias("scores"), matching.traces_of(spans).alias("traces"))


def scan_lexicon_engine(
    docs: DataFrame, lexicon: DataFrame | None = None, emoji: DataFrame | None = None, fuzzy: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, scores, traces) of ``scanned_documents`` as long tables; one that wants several of them scans but once with that."""
    per_doc = scanned_documents(docs, lexicon, emoji, fuzzy)
    spans = per_doc.select("doc_id", F.explode("kept").alias("s")).select("doc_id", *[f"s.{c}" for c in matching.SPAN[1:]])
    return spans, per_doc.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*"), per_doc.select("doc_id", "traces")
