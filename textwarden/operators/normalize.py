"""Text normalization and de-obfuscation of a whole column.

Each operator takes (df, col) and replaces the column; ``*_of`` forms work on columns
and are what composed pipelines use, so that a chain of steps is one projection.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import constants as K


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def strip_zero_width_of(text: Column) -> Column:
    return F.translate(text, K.ZERO_WIDTH, "")


def fold_homoglyphs_of(text: Column) -> Column:
    flat = F.translate(text, K.HOMOGLYPHS_FROM + K.FULLWIDTH_FROM, K.HOMOGLYPHS_TO + K.FULLWIDTH_TO)
    return replaced(flat, K.ASTRAL_HOMOGLYPHS)


def fold_diacritics_table_of(text: Column) -> Column:
    """The table part of diacritic folding; other marks need ``without_marks``."""
    return F.translate(replaced(text, K.LIGATURES), K.DIACRITICS_FROM, K.DIACRITICS_TO)


def normalize_punctuation_of(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit(K.ELLIPSIS), F.lit("...")), K.PUNCTUATION_FROM, K.PUNCTUATION_TO)


def compress_repeats_of(text: Column, most: int = 3) -> Column:
    return F.regexp_replace(text, rf"(?s)(.)\1{{{most - 1},}}", "$1" * most)


def clean_whitespace_of(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


#: Texts of a batch that are Python objects at a time.
TEXTS = 64


def in_unicode(text: str, form: str | None, marks: bool) -> str:
    if text.isascii():
        return text
    if form:
        text = unicodedata.normalize(form, text)
    if marks:
        text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))
    return text


def unicode_parts(texts: pa.Array, form: str | None, marks: bool) -> Iterator[pa.Array]:
    """The texts in a normal form, a few at a time, however many a batch has; ASCII has only one form."""
    for begin in range(0, len(texts), TEXTS):
        part = texts.slice(begin, TEXTS).to_pylist()
        yield pa.array([None if t is None else in_unicode(t, form, marks) for t in part], pa.string())


def unicode_pass(form: str | None, marks: bool):
    """Arrow pass for what Spark has no function for: normal forms, and dropping marks."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays(unicode_parts(texts, form, marks)) if len(texts) else pa.array([], pa.string())

    return run


def replace_leet_patterns_of(text: Column) -> Column:
    for leet, plain in K.LEET_PATTERNS.items():
        text = F.regexp_replace(text, rf"(?i)\Q{leet}\E", plain)
    return text


def replace_leet_chars_of(text: Column) -> Column:
    return F.translate(text, "".join(K.LEET_CHARS), "".join(K.LEET_CHARS.values()))


def normalize_phonetic_of(text: Column) -> Column:
    return replaced(text, K.PHONETIC)


def normalize_elongation_of(text: Column, least: int = 3, keep: int = 2) -> Column:
    return F.regexp_replace(text, rf"(?s)(.)\1{{{least - 1},}}", "$1" * keep)


def normalize_substitutions_of(text: Column) -> Column:
    return replaced(text, K.SUBSTITUTIONS)


def on_column(step):
    def run(df: DataFrame, col: str = "text", *args) -> DataFrame:
        return df.withColumn(col, step(F.col(col), *args))

    run.__name__ = step.__name__.removesuffix("_of")
    run.__doc__ = step.__doc__
    return run


strip_zero_width = on_column(strip_zero_width_of)
fold_homoglyphs = on_column(fold_homoglyphs_of)
normalize_punctuation = on_column(normalize_punctuation_of)
compress_repeats = on_column(compress_repeats_of)
clean_whitespace = on_column(clean_whitespace_of)
replace_leet_patterns = on_column(replace_leet_patterns_of)
replace_leet_chars = on_column(replace_leet_chars_of)
normalize_phonetic = on_column(normalize_phonetic_of)
normalize_elongation = on_column(normalize_elongation_of)
normalize_substitutions = on_column(normalize_substitutions_of)


def unicode_normalize(df: DataFrame, col: str = "text", form: str = "NFKC") -> DataFrame:
    return df.withColumn(col, unicode_pass(form, False)(F.col(col)))


def fold_diacritics(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, unicode_pass(None, True)(fold_diacritics_table_of(F.col(col))))


def normalize_corpus(df: DataFrame, col: str = "text", form: str = "NFKC", diacritics: bool = True, into: str = "normalized") -> DataFrame:
    """Adds ``normalized``: all steps in order, in one projection around two Arrow passes at most."""
    text = unicode_pass(form, False)(F.col(col)) if form else F.col(col)
    text = fold_homoglyphs_of(strip_zero_width_of(text))
    if diacritics:
        text = unicode_pass(None, True)(fold_diacritics_table_of(text))
    return df.withColumn(into, clean_whitespace_of(compress_repeats_of(normalize_punctuation_of(text))))


def deobfuscate_of(text: Column) -> Column:
    """Leet patterns, leet characters, phonetic spellings, elongation and look-alike strings, in this order."""
    text = normalize_phonetic_of(replace_leet_chars_of(replace_leet_patterns_of(text)))
    return normalize_substitutions_of(normalize_elongation_of(text))


def obfuscation_map(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds ``obfuscation_map``: each fragment that a step replaces, and by what; later steps win."""
    steps = [
        (K.LEET_PATTERNS, replace_leet_patterns_of),
        (K.LEET_CHARS, replace_leet_chars_of),
        (K.PHONETIC, lambda t: normalize_elongation_of(normalize_phonetic_of(t))),
        (K.SUBSTITUTIONS, normalize_substitutions_of),
    ]

    def keys(k: int, text: Column) -> Column:
        """The fragments that step k and later ones find in ``text``."""
        pairs, step = steps[k]
        seen = F.lower(text) if pairs is K.LEET_PATTERNS else text
        here = F.array_compact(F.array(*[F.when(F.contains(seen, F.lit(old)), F.lit(old)) for old in pairs]))
        return F.concat(here, let(step(text), lambda t: keys(k + 1, t))) if k + 1 < len(steps) else here

    merged = {old: new for pairs, _ in steps for old, new in pairs.items()}
    names = F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])
    entry = lambda k: F.struct(k.alias("key"), names[k].alias("value"))
    found = F.transform(F.array_distinct(let(F.col(col), lambda t: keys(0, t))), entry)
    return df.withColumn("obfuscation_map", F.map_from_entries(found))


def techniques_of(text: Column) -> Column:
    signs = "[" + "".join("\\" + c if c in "$+!@" else c for c in K.LEET_SIGNS) + "]"
    return F.array_compact(
        F.array(
            F.when(text.rlike(signs), "leet_speak"),
            F.when(text.rlike(r"(.)\1{2,}"), "elongation"),
            F.when(F.lower(text).rlike("|".join(K.PHONETIC)), "phonetic"),
            F.when(text.rlike(signs), "character_substitution"),
        )
    )


def detect_obfuscation(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("techniques", techniques_of(F.col(col)))


def obfuscation_prevalence(df: DataFrame, by: list[str], col: str = "text") -> DataFrame:
    """(by, technique, n_docs)."""
    rows = detect_obfuscation(df, col).select(*by, F.explode("techniques").alias("technique"))
    return rows.groupBy(*by, "technique").agg(F.count("*").alias("n_docs"))


def expand_lexicon_variants(lexicon: DataFrame, term: str = "term") -> DataFrame:
    """(term, variant, kind): spellings that dodge a word filter.

    Variants are made within the row of a distinct term, so only terms are shuffled.
    """
    words = lexicon.select(F.col(term).alias("term")).distinct()
    t, none = F.col("term"), F.array().cast("array<string>")
    places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
    upto = lambda i: F.substr(t, F.lit(1), i)
    after = lambda i: F.substr(t, i + 1)
    letter = lambda i: F.lower(F.substr(t, i, F.lit(1)))
    signs = F.create_map(*[x for k, v in K.VARIANT_LEET.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    leet = F.flatten(F.transform(places, lambda i: F.transform(F.coalesce(signs[letter(i)], none), lambda s: F.concat(upto(i - 1), s, after(i)))))
    drawn = F.filter(places, lambda i: F.contains(F.lit(K.VARIANT_ELONGATED), letter(i)))
    long_ = F.flatten(F.transform(drawn, lambda i: F.array(*[F.concat(upto(i), F.repeat(letter(i), F.lit(n)), after(i)) for n in (2, 3, 4)])))
    low = F.lower(t)
    sound = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b))) for a, b in K.VARIANT_PHONETIC.items()]))
    kinds = {"same": F.array(t), "leet": leet, "elongated": long_, "phonetic": sound}
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(v).alias("variants")) for k, v in kinds.items()])
    return words.select("term", F.explode(made).alias("m")).select("term", F.explode("m.variants").alias("variant"), "m.kind")
