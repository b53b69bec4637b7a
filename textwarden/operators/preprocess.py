"""The whole preparation of a corpus, as one chain of column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.operators import language, normalize, pii


def preprocess_corpus(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds languages, masked, pii_found, normalized, deobfuscated and techniques.

    Personal data is masked on the raw text, before digits and signs are replaced.
    """
    rows = language.detect_languages(pii.mask_pii(df, col), col)
    rows = normalize.normalize_corpus(rows, "masked")
    rows = rows.withColumn("deobfuscated", normalize.deobfuscate_of(F.col("normalized")))
    return normalize.detect_obfuscation(rows, col)


def preprocessing_stats(processed: DataFrame, by: list[str], col: str = "text") -> DataFrame:
    """(by, n, n_pii, n_obfuscated, mean_shrink)."""
    n = lambda c: F.sum(c.cast("long"))
    return processed.groupBy(*by).agg(
        F.count("*").alias("n"), n(F.col("pii_found")).alias("n_pii"), n(F.size("techniques") > 0).alias("n_obfuscated"),
        F.avg(F.length("normalized") / F.nullif(F.length(col), F.lit(0))).alias("mean_shrink"),
    )
