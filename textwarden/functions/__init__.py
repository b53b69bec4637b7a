"""Column functions that stand on their own: Column in, Column out."""

from textwarden.operators.normalize import (
    clean_whitespace_of,
    compress_repeats_of,
    deobfuscate_of,
    fold_diacritics_table_of,
    fold_homoglyphs_of,
    let,
    normalize_elongation_of,
    normalize_phonetic_of,
    normalize_punctuation_of,
    normalize_substitutions_of,
    replace_leet_chars_of,
    replace_leet_patterns_of,
    replaced,
    strip_zero_width_of,
    techniques_of,
)

__all__ = [
    "clean_whitespace_of",
    "compress_repeats_of",
    "deobfuscate_of",
    "fold_diacritics_table_of",
    "fold_homoglyphs_of",
    "let",
    "normalize_elongation_of",
    "normalize_phonetic_of",
    "normalize_punctuation_of",
    "normalize_substitutions_of",
    "replace_leet_chars_of",
    "replace_leet_patterns_of",
    "replaced",
    "strip_zero_width_of",
    "techniques_of",
]
