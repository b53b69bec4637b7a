"""Masking, finding and counting personal data in a whole column, by native expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.constants import LOG_PATTERNS, PII_PATTERNS

KINDS = tuple(dict.fromkeys(kind for kind, _, _ in PII_PATTERNS))
SWITCHES = {"emails": "emails", "phones": "phones", "ids": "ids"}


def mask_pii(df: DataFrame, col: str = "text", emails: bool = True, phones: bool = True, ids: bool = True) -> DataFrame:
    """Adds ``masked`` and ``pii_found``; patterns apply one after the other, so order decides."""
    off = {k for k, on in (("emails", emails), ("phones", phones), ("ids", ids)) if not on}
    text = F.col(col)
    for kind, mask, pattern in PII_PATTERNS:
        if kind not in off:
            text = F.regexp_replace(text, pattern, mask)
    return df.withColumn("masked", text).withColumn("pii_found", F.col("masked") != F.col(col))


def detect_pii_types(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds ``pii_types``: the kinds that any pattern finds in the raw text."""
    hits = [
        F.when(F.col(col).rlike("|".join(f"(?:{p})" for k, _, p in PII_PATTERNS if k == kind)), kind) for kind in KINDS
    ]
    return df.withColumn("pii_types", F.array_compact(F.array(*hits)))


def counts_of(text: Column) -> dict[str, Column]:
    """Matches of each kind; patterns count independently on the raw text."""
    out: dict[str, Column] = {}
    for kind, _, pattern in PII_PATTERNS:
        n = F.regexp_count(text, F.lit(pattern))
        out[kind] = out[kind] + n if kind in out else n
    return out


def pii_counts(df: DataFrame, by: list[str], col: str = "text") -> DataFrame:
    """Sums of matches of each kind by group."""
    rows = df.select(*by, *[n.alias(kind) for kind, n in counts_of(F.col(col)).items()])
    return rows.groupBy(*by).agg(*[F.sum(k).cast("long").alias(k) for k in KINDS])


def labelled(kind: str):
    return lambda value: F.struct(F.lit(kind).alias("pii_type"), value.alias("value"))


def extract_pii(df: DataFrame, col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pii_type, value) of what masking takes out, each found in the text as it is at that step."""
    text, found = F.col(col), []
    for kind, mask, pattern in PII_PATTERNS:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found.append(F.transform(values, labelled(kind)))
        text = F.regexp_replace(text, pattern, mask)
    # what no pattern matches stays as it is at every step, so most texts are done with here
    any_ = reduce(Column.__or__, [F.col(col).rlike(p) for _, _, p in PII_PATTERNS])
    return df.where(any_).select(id_col, F.explode(F.flatten(F.array(*found))).alias("f")).select(id_col, "f.pii_type", "f.value")


def hash_text(df: DataFrame, col: str = "text", prefix: int | None = None) -> DataFrame:
    digest = F.sha2(F.col(col), 256)
    return df.withColumn("text_hash", F.substring(digest, 1, prefix) if prefix else digest)


def mask_partial(df: DataFrame, col: str = "text", patterns: dict[str, str] | None = None, mask_char: str = "*", preserve_length: bool = True) -> DataFrame:
    """Log-style masks that keep a little: an address's first letter and domain, a phone number's ends.

    ``patterns`` adds to the ten of ``LOG_PATTERNS``, or replaces those of the same name.
    Without ``preserve_length`` a covered part is four signs, whatever its length, and
    shows no first letter.
    """
    rules = LOG_PATTERNS | (patterns or {})

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import re

        def stars(n: int) -> str:
            return mask_char * (n if preserve_length or not n else 4)

        def cover(name: str, s: str) -> str:
            if name == "email":
                local, _, domain = s.partition("@")
                shown = 1 if preserve_length and len(local) > 1 else 0
                return local[:shown] + stars(len(local) - shown) + "@" + domain
            if name in ("phone", "indian_phone") and len(s) > 6:
                return s[:3] + stars(len(s) - 5) + s[-2:]
            return stars(len(s))

        compiled = [(name, re.compile(p)) for name, p in rules.items()]

        def one(t: str | None) -> str | None:
            for name, p in compiled:
                t = t and p.sub(lambda m, name=name: cover(name, m[0]), t)
            return t

        return texts.map(one)

    return df.withColumn(col, run(F.col(col)))


def mask_nested(df: DataFrame) -> DataFrame:
    """Native masks over every string of a row, however deep in structs, arrays and maps."""

    def text(c: Column) -> Column:
        for _, mask, pattern in PII_PATTERNS:
            c = F.regexp_replace(c, pattern, mask)
        return c

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return text(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: of(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: of(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[of(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
