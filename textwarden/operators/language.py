"""Scripts, language scores and tokens of whole corpora."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.operators.normalize import let

LETTERS_AND_DIGITS = r"[^\p{L}\p{N}]"


def script_class(script: str, outside: bool = True) -> str:
    lo, hi = K.SCRIPTS[script]
    return f"[{'^' if outside else ''}\\x{{{lo:x}}}-\\x{{{hi:x}}}]"


def script_shares(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds ``scripts``: script to its share of the letters and digits; absent scripts aren't listed.

    A text without letters and digits has none.
    """
    lo, hi = min(a for a, _ in K.SCRIPTS.values() if a > 0x7F), max(b for _, b in K.SCRIPTS.values())
    kept = F.regexp_replace(F.col(col), LETTERS_AND_DIGITS, "")
    rows = df.select("*", kept.alias("_kept"), F.col(col).rlike(f"[\\x{{{lo:x}}}-\\x{{{hi:x}}}]").alias("_exotic"))  # most texts have none of these scripts
    here = lambda s: F.col("_kept").rlike(script_class(s, False)) if s == "latin" else F.col("_exotic") & F.col("_kept").rlike(script_class(s, False))
    share = lambda s: F.length(F.regexp_replace("_kept", script_class(s), "")) / F.nullif(F.length("_kept"), F.lit(0))
    entries = [F.when(here(s), F.struct(F.lit(s).alias("key"), share(s).alias("value"))) for s in K.SCRIPTS]
    return rows.withColumn("scripts", F.map_from_entries(F.array_compact(F.array(*entries)))).drop("_kept", "_exotic")


#: A word boundary between ASCII word characters and others, whatever the Java version makes of \\b.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def hinglish_score(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds ``hinglish``: cues of Hindi in Latin letters for each word, at most 1; 0 up to 0.1."""
    rows = df.withColumn("_low", F.lower(col)).withColumn("_words", F.regexp_count("_low", F.lit(r"\S+")))
    text, low, (*lists, verb, praise) = F.col(col), F.col("_low"), K.HINGLISH
    words = F.col("_words")
    # the lists have no word in common, so their words are counted together
    listed = F.regexp_count(low, F.lit(r"(?<!\w)(?:" + "|".join(p.strip(r"\b").strip("()") for p in lists) + r")(?!\w)"))
    hits = listed + F.regexp_count(low, F.lit(verb.replace(r"\b\w+", r"\w", 1).replace(r"\b", r"(?!\w)")))
    praised = praise.replace(r"\b", BOUNDARY)
    hits = hits + F.when(low.rlike("achha|sahi|galat|bura"), F.regexp_count(low, F.lit(praised))).otherwise(0)
    mixed = text.rlike("[A-Yy\\[-`a-x]") & text.rlike("[\\x{900}-\\x{97e}]")
    # a word with the letters anywhere in it is found from those letters on
    roman = sum((F.regexp_count(low, F.lit(p.replace(r"\b\w*", "", 1).replace(r"\w*\b", r"\w*"))) for p in K.ROMANIZED), F.lit(0))
    tenths = hits * 10 + F.when(mixed, words * 3).otherwise(0) + roman  # whole numbers, so that a text at the limit isn't beyond it by rounding
    raw = tenths / 10 / F.nullif(words, F.lit(0))
    rows = rows.withColumn("_raw", F.least(raw, F.lit(1.0)))
    return rows.withColumn("hinglish", F.when(F.col("_raw") > 0.1, F.col("_raw")).otherwise(0.0)).drop("_low", "_raw", "_words")


CUES = "struct<kept:int,scripts:array<int>,words:int,tenths:int>"
SPACE = "[\\t\\n\\x0B\\f\\r ]"
LISTED = r"\b(?:" + "|".join(p.strip(r"\b").strip("()") for p in K.HINGLISH[:-2]) + r")\b"
VERB, PRAISE = (p.replace(r"\s", SPACE) for p in (K.HINGLISH[-2].replace(r"\b\w+", r"\w", 1), K.HINGLISH[-1]))
MIXED = (r"[A-Yy\[-`a-x]", r"[\x{900}-\x{97e}]")


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """For each code point 0 if it is no letter or digit, else the place of its script, or one after the last."""
    out = np.zeros(0x110000, "u1")
    for o in range(len(out)):
        if unicodedata.category(chr(o))[0] in "LN":
            out[o] = len(K.SCRIPTS) + 1
    for k, (lo, hi) in enumerate(K.SCRIPTS.values(), 1):
        out[lo : hi + 1][out[lo : hi + 1] > 0] = k
    return out


def byte_kinds() -> np.ndarray:
    """For each byte of UTF-8 a bit each: of a word, space, vowel, k or g, t or d, h; of ASCII alone, as in a column function."""
    out = np.zeros(256, "u1")
    for bit, of in enumerate((r"\w", r"\s", "[aeiou]", "[kg]", "[td]", "h")):
        out[[o for o in range(128) if re.match(of, chr(o), re.A) and o not in range(0x1C, 0x20)]] |= 1 << bit
    return out


BYTES = byte_kinds()


def cues(text: pa.Array, low: pa.Array) -> pa.Array:
    """``CUES`` of texts and their lower case: letters and digits in all and by script, words, and tenths of cues of Hindi in Latin letters.

    What ``script_shares`` and ``hinglish_score`` find by patterns: letters are counted by arrays of
    code points, lists of words by automata, and of letter pairs the words that hold one.
    """
    n, text, low = len(text), pc.fill_null(text, ""), pc.fill_null(low, "")
    classes, k = letter_classes(), len(K.SCRIPTS) + 2
    codes = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(n, dtype="i4") * k, pc.utf8_length(text).to_numpy())
    letters = np.bincount(row + classes[codes], minlength=n * k).reshape(n, k).astype("i4")
    data = BYTES[np.frombuffer(("\n" + "\n".join(low.to_pylist())).encode(), "u1")]
    starts = np.append(1, 1 + np.cumsum(pc.binary_length(low).to_numpy().astype("i8") + 1))[:n]
    per_text = lambda at: np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=n)
    space, inside = data & 2 > 0, data & 1 > 0
    words = per_text(np.flatnonzero(space[:-1] & ~space[1:]) + 1)
    number, roman = np.cumsum(inside[1:] & ~inside[:-1]), np.zeros(n, "i8")
    for a, b in ((4, 4), (8, 32), (16, 32)):
        at = np.flatnonzero((data[:-1] & a > 0) & (data[1:] & b > 0))
        own = number[at - 1]
        roman += per_text(at[np.append(True, own[1:] != own[:-1])[: len(at)]])
    hits = sum(pc.count_substring_regex(low, p).to_numpy().astype("i8") for p in (LISTED, VERB, PRAISE))
    mixed = pc.and_(*[pc.match_substring_regex(text, p) for p in MIXED]).to_numpy(zero_copy_only=False)
    tenths = hits * 10 + np.where(mixed, words * 3, 0) + roman
    scripts = pa.FixedSizeListArray.from_arrays(pa.array(letters[:, 1:-1].ravel()), k - 2).cast(pa.list_(pa.int32()))
    numbers = [pa.array(x.astype("i4")) for x in (letters[:, 1:].sum(axis=1), words, tenths)]
    return pa.StructArray.from_arrays([numbers[0], scripts, *numbers[1:]], ["kept", "scripts", "words", "tenths"])


def cues_in(text: pa.Array, low: pa.Array) -> pa.Array:
    """``cues`` of few texts at a time."""
    parts = [cues(text.slice(at, 256), low.slice(at, 256)) for at in range(0, max(len(text), 1), 256)]
    return pa.concat_arrays(parts)


def language_mix_report(df: DataFrame, by: list[str], code: str = "code", confidence: str = "confidence") -> DataFrame:
    """(by, code, bucket, n): documents by detected language and confidence bucket."""
    c = F.col(confidence)
    bucket = F.when(c >= 0.9, "very_high").when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low")
    return df.groupBy(*by, F.col(code).alias("code"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


TOKEN = (
    r"[\x{900}-\x{97F}]+|[\x{980}-\x{9FF}]+|[\x{A00}-\x{D7F}]+|[A-Za-z]+(?:['-][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*"
    r"|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]|[^\sA-Za-z0-9_]"
)


def regex_tokenize(df: DataFrame, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token) by one ordered alternation of script runs, numbers, emoji and single signs."""
    return df.select(id_col, F.posexplode(F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))


def kind_of(c: str) -> str:
    o = ord(c)
    if 0x1F300 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF:
        return "emoji"
    if c.isdigit():
        return "number"
    if c.isalnum() or 0x0900 <= o <= 0x0D7F:
        return "word"
    return "space" if c.isspace() else "punctuation" if c.isprintable() else "other"


#: A letter for each code point: its kind's first, but q for ' and -, d for . and , and E for an emoji that is a digit.
class Kinds(dict):
    def __missing__(self, o: int) -> str:
        c = chr(o)
        kind = "q" if c in "'-" else "d" if c in ".," else kind_of(c)[0]
        return self.setdefault(o, "E" if kind == "e" and c.isdigit() else kind)


KINDS = Kinds()
TYPED = re.compile("(?P<word>w[wnq]*)|(?P<number>n(?:[nE]|d(?=[nE]))*)|(?P<emoji>[eE]+)|(?P<punctuation>[pqd])|(?P<other>o)")


def typed_tokens(text: str) -> Iterator[tuple[str, int, int, str]]:
    for m in TYPED.finditer(text.translate(KINDS)):
        yield text[m.start() : m.end()], m.start(), m.end(), m.lastgroup


def tokenize_corpus(df: DataFrame, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token, start, end, token_type) with code-point offsets."""
    rows = df.select(F.col(id_col).alias("id"), F.col(col).alias("text"))
    out = rows.mapInArrow(token_batches, f"id {rows.schema['id'].dataType.simpleString()}, pos int, token string, start int, end int, token_type string")
    return out.withColumnRenamed("id", id_col)


#: Tokens that leave the Arrow pass together.
MOST_TOKENS = 20_000
TOKEN_TYPES = {"pos": pa.int32(), "token": pa.string(), "start": pa.int32(), "end": pa.int32(), "token_type": pa.string()}


def token_batch(ids: pa.Array, row: list[int], tokens: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*tokens, strict=True), TOKEN_TYPES.values(), strict=True)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *columns], ["id", *TOKEN_TYPES])


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of (id, text), ``MOST_TOKENS`` at a time, however many a batch or a text has."""
    for batch in batches:
        ids, texts, row, tokens = batch.column(0), batch.column(1), [], []
        for r in range(batch.num_rows):
            for k, t in enumerate(typed_tokens(texts[r].as_py() or "")):
                row.append(r)
                tokens.append((k, *t))
                if len(row) == MOST_TOKENS:
                    yield token_batch(ids, row, tokens)
                    row, tokens = [], []
        if row:
            yield token_batch(ids, row, tokens)


def dominant_script(token: Column) -> Column:
    """The script of a token's first letter, or ``other``."""
    out = None
    for s, (lo, hi) in K.SCRIPTS.items():
        pattern = "^[A-Za-z]" if s == "latin" else f"^[\\x{{{lo:x}}}-\\x{{{hi:x}}}]"
        out = F.when(token.rlike(pattern), s) if out is None else out.when(token.rlike(pattern), s)
    return out.otherwise("other")


def tokens_by_script(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, script, n, distinct_tokens)."""
    rows = tokens.withColumn("script", dominant_script(F.col("token")))
    return rows.groupBy(*by, "script").agg(F.count("*").alias("n"), F.count_distinct("token").alias("distinct_tokens"))


def ngram_language_scores(df: DataFrame, col: str = "text", id_col: str = "doc_id", corrected: bool = False) -> DataFrame:
    """(id, lang, score): softmax over the profiled languages of sums over character 2- to 5-grams.

    Only n-grams of a profile are counted, each by the number of its occurrences, so
    nothing is exploded by position; the number of all n-grams follows from the length.
    The plain form adds share * ln(usual share); ``corrected`` adds share * usual share.
    """
    t = F.concat(F.lit("<"), F.lower(col), F.lit(">"))
    n = F.length(t)
    total = sum((F.greatest(n - k + 1, F.lit(0)) for k in (2, 3, 4, 5)), F.lit(0))
    rows = df.where(F.length(F.trim(col)) >= 10).select(F.col(id_col).alias("id"), t.alias("t"), total.alias("total"))
    n_of_t = F.length("t")

    def count(gram: str) -> Column:
        if any(gram[:k] == gram[-k:] for k in range(1, len(gram))):  # occurrences may overlap
            return F.size(F.regexp_extract_all("t", F.lit(f"(?=(\\Q{gram}\\E))"), F.lit(1)))
        left = F.length(F.replace("t", F.lit(gram), F.lit("")))
        return ((n_of_t - left) / len(gram)).cast("int")

    def weight(share: float) -> float:
        return share if corrected else math.log(share + 1e-10)

    sums = {lang: sum((count(g) * weight(s) for g, s in grams.items()), F.lit(0.0)) / F.col("total") for lang, grams in K.NGRAMS.items()}
    entries = F.array(*[F.struct(F.lit(lang).alias("lang"), s.alias("raw")) for lang, s in sums.items()])
    out = rows.select("id", F.explode(entries).alias("e")).select(F.col("id").alias(id_col), "e.lang", "e.raw")
    w = Window.partitionBy(id_col)
    out = out.withColumn("x", F.exp(F.col("raw") - F.max("raw").over(w)))
    return out.select(id_col, "lang", (F.col("x") / F.sum("x").over(w)).alias("score"))


def detect_languages(df: DataFrame, col: str = "text", hints_col: str | None = None, threshold: float = 0.7, english: float = 0.5) -> DataFrame:
    """Adds ``languages``: array of (code, confidence, percentage), surest first.

    Shares of scripts give their languages; Latin text is Hinglish or English, the latter
    with ``english`` as the n-gram evidence.  Hints raise what was found by a fifth.
    """
    found_in = F.arrow_udf(cues_in, CUES)
    return languages_from(df.withColumn("_cues", found_in(F.col(col), F.lower(col))), "_cues", hints_col, threshold, english).drop("_cues")


def languages_from(rows: DataFrame, counted: str, hints_col: str | None = None, threshold: float = 0.7, english: float = 0.5) -> DataFrame:
    """Adds ``languages`` to rows with ``CUES``."""
    c = F.col(counted)
    raw = F.least(c["tenths"] / 10 / F.nullif(c["words"], F.lit(0)), F.lit(1.0))
    rows = rows.withColumn("_raw", raw).withColumn("hinglish", F.when(F.col("_raw") > 0.1, F.col("_raw")).otherwise(0.0))
    place = {s: k for k, s in enumerate(K.SCRIPTS)}
    share = lambda s: F.coalesce(F.get(c["scripts"], F.lit(place[s])) / F.nullif(c["kept"], F.lit(0)), F.lit(0.0))
    found = []
    for script, languages in K.SCRIPT_LANGUAGES.items():
        for code, weight in languages:
            part = share(script) * weight
            found.append(F.struct(F.lit(code).alias("code"), (part * 0.7).alias("c"), part.alias("p")))
    latin = share("latin")
    mixed = F.struct(F.lit("hi-Latn").alias("code"), F.when((latin > 0.05) & (F.col("hinglish") > 0.15), F.least(F.lit(0.9), 0.3 + F.col("hinglish")) * 0.8).otherwise(0.0).alias("c"), latin.alias("p"))
    plain = F.struct(F.lit("en").alias("code"), F.when((latin > 0.05) & (F.col("hinglish") <= 0.15), F.lit(min(0.9, 0.5 + english) * 0.8)).otherwise(0.0).alias("c"), latin.alias("p"))
    every = F.array(*found, mixed, plain)
    if hints_col:
        boost = lambda x: F.when(F.array_contains(F.coalesce(hints_col, F.array().cast("array<string>")), x["code"]), x["c"] * 1.2).otherwise(x["c"])
        every = F.transform(every, lambda x: F.struct(x["code"].alias("code"), boost(x).alias("c"), x["p"].alias("p")))
    default = F.array(F.struct(F.lit("en").alias("code"), F.lit(0.5).alias("confidence"), F.lit(100.0).alias("percentage")))

    rows = rows.withColumn("_kept", F.filter(every, lambda x: x["c"] > 0.1))
    rows = rows.withColumn("_total", F.aggregate("_kept", F.lit(0.0), lambda a, x: a + x["p"]))
    row = lambda x: F.struct((-F.least(F.lit(0.95), x["c"])).alias("k"), x["code"].alias("code"), (x["p"] / F.col("_total") * 100).alias("percentage"))
    back = lambda x: F.struct(x["code"].alias("code"), (-x["k"]).alias("confidence"), x["percentage"].alias("percentage"))
    rows = rows.withColumn("_kept", F.transform(F.array_sort(F.transform("_kept", row)), back))
    rows = rows.withColumn("_sure", F.filter("_kept", lambda x: x["confidence"] >= threshold))
    final = F.when(F.size("_kept") == 0, default).when(F.size("_sure") == 0, F.slice("_kept", 1, 1)).otherwise(F.col("_sure"))
    return rows.withColumn("languages", final).drop("hinglish", "_raw", "_kept", "_total", "_sure")


def detect_per_segment(df: DataFrame, col: str = "text", id_col: str = "doc_id", segment_length: int = 50) -> DataFrame:
    """(id, seg, text, languages) of windows of words that overlap by half; short ends are skipped."""
    words = F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")
    step = max(1, segment_length // 2)
    rows = df.select(F.col(id_col).alias("id"), F.col(col).alias("whole"), words.alias("w"))
    begins = F.when(F.size("w") <= segment_length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)))
    rows = rows.select("id", "whole", "w", F.posexplode(begins).alias("seg", "at"))
    part = F.slice("w", F.col("at") + 1, segment_length)
    rows = rows.where((F.size("w") <= segment_length) | (F.size(part) >= 3))
    text = F.when(F.size("w") <= segment_length, F.col("whole")).otherwise(F.array_join(part, " "))
    out = detect_languages(rows.select("id", "seg", text.alias("text")))
    # a filter on the detected languages would be pushed below and compute them anew for each use
    sure = F.filter(F.array("languages"), lambda x: (F.col("seg") == 0) | (F.element_at(x, 1)["confidence"] > 0.3))
    out = out.select(F.col("id").alias(id_col), "seg", "text", F.explode_outer(sure).alias("languages"))
    return out.where("languages is not null")


def token_offsets(df: DataFrame, tokens_col: str, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, start, end): each token sought from where the one before ended; start -1 if it isn't there.

    One pass over a text; few rows of a batch are Python objects at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                row, pos, start, end = [], [], [], []
                for r, (text, tokens) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    at = 0
                    for k, token in enumerate(tokens or ()):
                        found = -1 if text is None or token is None else text.find(token, at)
                        at = found + len(token) if found >= 0 else at
                        row.append(r)
                        pos.append(k)
                        start.append(found)
                        end.append(at if found >= 0 else -1)
                numbers = [pa.array(x, pa.int32()) for x in (pos, start, end)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *numbers], ["id", "pos", "start", "end"])

    rows = df.select(F.col(id_col).alias("id"), F.col(col).alias("text"), F.col(tokens_col).alias("tokens"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pos int, start int, end int")
    return out.withColumnRenamed("id", id_col)


def dictionary(df: DataFrame, lang: str) -> DataFrame:
    rows = [(k, r, n) for k, (r, n) in enumerate(K.TRANSLITERATION[lang].items())]
    return df.sparkSession.createDataFrame(rows, "ord int, roman string, native string")


def transliterate_to_native(df: DataFrame, col: str = "text", lang: str = "hi", id_col: str = "doc_id") -> DataFrame:
    """(id, roman, native, n) of the words that the dictionary has."""
    words = df.select(id_col, F.explode(F.split(F.lower(col), r"\s+")).alias("roman"))
    return words.join(F.broadcast(dictionary(df, lang)), "roman").groupBy(id_col, "roman", "native").agg(F.count("*").alias("n"))


def transliterate_to_roman(df: DataFrame, col: str = "text", lang: str = "hi", id_col: str = "doc_id") -> DataFrame:
    """(id, native, roman, n): runs of Devanagari whose first dictionary spelling is known."""
    first = dictionary(df, lang).groupBy("native").agg(F.min_by("roman", "ord").alias("roman"))
    runs = df.select(id_col, F.explode(F.regexp_extract_all(col, F.lit("[\\x{900}-\\x{97F}]+"), F.lit(0))).alias("native"))
    return runs.join(F.broadcast(first), "native").groupBy(id_col, "native", "roman").agg(F.count("*").alias("n"))


def transliteration_variants(lexicon: DataFrame, term: str = "term") -> DataFrame:
    """(term, variant): the term and each spelling that one substitution makes."""
    made = F.array(F.col(term), *[F.replace(F.col(term), F.lit(a), F.lit(b)) for a, b in K.SPELLING_VARIANTS.items()])
    return lexicon.select(F.col(term).alias("term")).distinct().select("term", F.explode(F.array_distinct(made.alias("x"))).alias("variant")) if term == "term" else transliteration_variants(lexicon.withColumnRenamed(term, "term"))
