"""Personal data: patterns propose spans, checksums confirm them, context weighs them.

Base kinds (email, ip, card, phone) follow the contract: leftmost matches that don't
overlap within a kind; a match that fails its check is dropped without a retry.  The
method adds kinds that need more evidence: ``iban`` (mod-97 must hold) and ``ssn``
(three groups of digits that only count beside a telling word).  A span's score is
its kind's prior, raised where a telling word stands within ``WINDOW`` characters;
added spans below ``LEAST`` are left out.  Base spans always stay.

Offsets are code points, end exclusive.  Defined results: a null or empty text has no
spans; rows are handled one by one, so repeated rows repeat; other columns, whatever
their names, don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import corpus

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
WINDOW = 40
LEAST = 0.5
#: kind: (prior score, telling words)
CONTEXT = {
    "email": (0.9, r"mail|contact|write"),
    "ip": (0.6, r"\bip\b|address|host|server|login"),
    "card": (0.8, r"card|visa|credit|payment"),
    "phone": (0.7, r"phone|call|tel|mobile|fax"),
    "iban": (0.8, r"iban|bank|account|konto"),
    "ssn": (0.3, r"ssn|social security|insurance number"),
}
TELLING = {kind: re.compile(words, re.I) for kind, (_, words) in CONTEXT.items()}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
# [0-9]+ can't give a digit back and still meet what follows, so possessive forms match alike
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the email pattern, found from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def fits_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(fits_byte, m[0].split("."))):
                yield "ip", *m.span()
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                yield "card", *m.span()
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    yield "phone", *m.span()
        for m in IBAN.finditer(text):
            s = m[0]
            while len(s) >= 15 and not (15 <= len(t := s.replace(" ", "")) <= 34 and mod97(t)):
                s = s.rpartition(" ")[0]  # capitals that follow may not belong to it
            if len(s) >= 15:
                yield "iban", m.start(), m.start() + len(s)
        for m in SSN.finditer(text):
            yield "ssn", *m.span()


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    out = []
    for kind, start, end in proposals(text):
        prior = CONTEXT[kind][0]
        near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
        score = 1 - (1 - prior) * (0.4 if TELLING[kind].search(near) else 1)
        if kind in BASE or score >= LEAST:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii``: array of (kind, start, end, score), ordered by start, then kind."""

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(t)])

    return docs.withColumn("pii", spans.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; overlapping spans become one mask."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            out, done = [], 0
            for kind, start, end, _ in spans_of(text):
                if start >= done:
                    out += [text[done:start], f"[{kind.upper()}]"]
                done = max(done, end)
            return "".join([*out, text[done:]]) if out else text

        for texts in batches:
            yield texts.map(one)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def joined(spans: Column) -> Column:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, line))


def digests(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.3f", s["score"])), ",").alias("scores"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds personal data in every whole text of ``documents``."""
    return digests(corpus(spark, sf_dir, "documents"))
