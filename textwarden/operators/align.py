"""Matching in a cleaned text, with spans placed in the raw one, and what stands around the spans.

The matchable form of a text is what is left of its disguises: no zero-width signs and
combining marks, look-alike, full-width and accented letters folded, leet spellings and
drawn-out letters undone, sounds and drawn letters written one way.  One Arrow pass screens many
texts at once: automata without back-tracking (RE2, by pyarrow) say which hold a term or a pattern
as they are, and the form is made by arrays of code points.  Texts in which
nothing was seen are done with then.  Where the form of another holds a term, each step keeps, for
every code point of its result, where in the raw text it begins and ends, so a find is a span
of the raw text.  The same pass looks for negations and quotes around the spans, by sweeps over
sorted places; its time is linear in the length of a text, but for sorting.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from textwarden import constants as K
from textwarden.operators import context, normalize

#: Sounds and letters drawn by signs; longer ones first, so that none is taken for part of another.
SOUNDS = dict(sorted((K.PHONETIC | {k: v for k, v in K.SUBSTITUTIONS.items() if len(k) > 1}).items(), key=lambda kv: (-len(kv[0]), kv[0])))
#: How many of a drawn-out letter stay: two for words that have them doubled, one for the others.
KEPT = (2, 1)
PLACED = "spans array<struct<start:int,end:int,text:string,category:string,severity:string,confidence:double,rule_source:string>>, negation double, quotation double, most double"


#: Texts, and bytes of texts, that are Python objects at a time.
TEXTS, BYTES = 256, 4 << 20


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to TEXTS rows that hold up to BYTES of a column, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right"))
        end = min(max(end, at + 1), at + TEXTS)
        yield batch.slice(at, end - at)
        at = end


def holding(texts: pa.Array, words: Iterable[str]) -> np.ndarray:
    """Which texts hold any of the words, by one automaton."""
    return matching(texts, "|".join(map(re.escape, words)))


def matching(texts: pa.Array, pattern: str) -> np.ndarray:
    """Which texts an RE2 pattern matches somewhere; nulls don't."""
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


class Aligned:
    """A text with, for each code point, where in the raw text it begins and ends."""

    def __init__(self, text: str, begins: np.ndarray, ends: np.ndarray):
        self.text, self.begins, self.ends = text, begins, ends

    def replaced(self, found: list[tuple[int, int, str]]) -> Aligned:
        """Places (start, end) in order replaced by what is given with them, of any length; it stands for the whole place."""
        if not found:
            return self
        a, b = (np.array([f[k] for f in found]) for k in (0, 1))
        n = np.array([len(f[2]) for f in found])
        # code points outside of the matches count once; of a match all count at its first place
        times = np.ones(len(self.text), "i8")
        inside = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange(int((b - a).sum()))
        times[inside] = 0
        times[a] = n
        ends = self.ends.copy()
        ends[a] = self.ends[b - 1]
        parts, at = [], 0
        for start, end, put in found:
            parts += [self.text[at:start], put]
            at = end
        return Aligned("".join([*parts, self.text[at:]]), np.repeat(self.begins, times), np.repeat(ends, times))

    def shortened(self, keep: int) -> Aligned:
        """Of a letter drawn out ``keep`` stay, which stand for all of them."""
        codes = codes_of(self.text)
        third = thirds(codes)
        if not third.any():
            return self
        run = third | np.append(third[1:], False) | np.append(third[2:], [False, False])[: len(third)]
        first = run & ~np.append(False, run[:-1] & (codes[1:] == codes[:-1]))
        last = run & ~np.append(run[1:] & (codes[1:] == codes[:-1]), False)
        own = np.cumsum(first) - 1
        begins, ends = self.begins.copy(), self.ends.copy()
        begins[run], ends[run] = self.begins[first][own[run]], self.ends[last][own[run]]
        stays = ~dropped(third, keep)
        return Aligned(text_of(codes[stays]), begins[stays], ends[stays])

    def same_length(self, text: str) -> Aligned:
        return Aligned(text, self.begins, self.ends)

    def raw(self, start: int, end: int) -> tuple[int, int]:
        return int(self.begins[start]), int(self.ends[end - 1])


#: The first step: what can't be seen goes, ligatures are spelled out.
UNSEEN = re.compile(f"[{''.join(K.ZERO_WIDTH)}̀-ͯ]|{'|'.join(K.LIGATURES)}")
SOUND = re.compile("|".join(map(re.escape, SOUNDS)))
LETTER = regex.compile(r"\p{L}")


def letters() -> np.ndarray:
    """For each code point what the second step makes of it: lower case, look-alikes, accents, leet."""
    out = np.arange(sys.maxunicode + 1, dtype="<u4")
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isupper() and len(low := c.lower()) == 1:
            out[ord(c)] = ord(low)
    plain = str.maketrans(K.HOMOGLYPHS_FROM + K.FULLWIDTH_FROM, K.HOMOGLYPHS_TO + K.FULLWIDTH_TO) | str.maketrans(K.ASTRAL_HOMOGLYPHS) | str.maketrans(K.DIACRITICS_FROM, K.DIACRITICS_TO)
    for c, to in plain.items():
        out[c] = out[to if isinstance(to, int) else ord(to)]
    for c, to in K.LEET_CHARS.items():
        out[ord(c)] = ord(to)
    return out


LETTERS = letters()


def sounded(m: re.Match) -> str:
    return SOUNDS[m[0]]


def form_of(term: str) -> str:
    """A lexicon term in the matchable form."""
    return SOUND.sub(sounded, term)


def lowered(text: str) -> str:
    """Lower case of the same length: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


#: Leet patterns, as the letters make them, that still aren't plain.
SIGNED = {flat: plain for leet, plain in K.LEET_PATTERNS.items() if (flat := "".join(chr(LETTERS[ord(c)]) for c in leet)) != plain}


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def text_of(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def folded(text: str) -> str:
    """The second step, letter by letter; of the leet patterns only signs that stand for no letter are left to do."""
    flat = text_of(LETTERS[codes_of(text)])
    for leet, plain in SIGNED.items():
        flat = flat.replace(leet, plain)
    return flat


def marked(pattern: str) -> np.ndarray:
    """For each code point whether it is of a class of characters."""
    every, out = "".join(map(chr, range(sys.maxunicode + 1))), np.zeros(sys.maxunicode + 1, "?")
    for m in re.finditer(f"{pattern}+", every):
        out[m.start() : m.end()] = True
    return out


DRAWABLE, HIDDEN = marked(r"[^\W\d_]"), marked(f"[{''.join(K.ZERO_WIDTH)}\u0300-\u036f{''.join(K.LIGATURES)}]")
#: Letters before signs: no sound is made of what a sign draws.
LETTER_SOUNDS, SIGN_SOUNDS = ([k for k in SOUNDS if k.isalpha() is yes] for yes in (True, False))
SIGNS = "".join(sorted({c for k in SIGN_SOUNDS for c in k}))
#: Two signs that have a character in common; which one is drawn depends on the first then.
JOINED = [a + b[n:] for a in SIGN_SOUNDS for b in SIGN_SOUNDS for n in range(1, min(len(a), len(b))) if a != b and a[-n:] == b[:n]]


def sounds_of(flat: str) -> str:
    """``SOUND`` replaced, one literal after the other where that is the same."""
    if any(j in flat for j in JOINED):
        return SOUND.sub(sounded, flat)
    for k in (*LETTER_SOUNDS, *SIGN_SOUNDS):
        flat = flat.replace(k, SOUNDS[k])
    return flat


def thirds(codes: np.ndarray) -> np.ndarray:
    """Which letters are the third of equal ones, or a later one."""
    third = np.append([False, False], (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]))[: len(codes)]
    at = np.flatnonzero(third)
    third[at] = DRAWABLE[codes[at]]
    return third


def dropped(third: np.ndarray, keep: int) -> np.ndarray:
    """Which letters go so that ``keep`` of each run of three or more stay."""
    return third if keep == 2 else third | np.append(third[1:], False)


def forms(text: str) -> Iterator[tuple[str, int]]:
    """The matchable forms of a text, with how many of a drawn-out letter stay; the second only if there is one."""
    if not text.isascii() and HIDDEN[codes_of(text)].any():
        text = UNSEEN.sub(lambda m: K.LIGATURES.get(m[0], ""), text)
    flat = folded(text)
    codes = codes_of(flat)
    third = thirds(codes)
    if not third.any():
        yield sounds_of(flat), KEPT[0]
        return
    for keep in KEPT:
        yield sounds_of(text_of(codes[~dropped(third, keep)])), keep


def aligned(text: str, keep: int) -> Aligned:
    """A matchable form again, with the places of its code points in the raw text."""
    n = np.arange(len(text))
    bared = Aligned(text, n, n + 1)
    if not text.isascii():
        bared = bared.replaced([(*m.span(), K.LIGATURES.get(m[0], "")) for m in UNSEEN.finditer(text)])
    flat = bared.same_length(folded(bared.text)).shortened(keep)
    return flat.replaced(sounds_in(flat.text))


def sounds_in(flat: str) -> list[tuple[int, int, str]]:
    """(start, end, letters) of what ``sounds_of`` replaces."""
    if any(j in flat for j in JOINED):
        return [(*m.span(), sounded(m)) for m in SOUND.finditer(flat)]
    found, end = [], 0
    for at, less, k in sorted((at, -len(k), k) for k in SOUNDS for at in occurrences(flat, k)):
        if at >= end:
            found.append((at, at - less, SOUNDS[k]))
            end = at - less
    return found


def occurrences(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + len(word))


CUES = [(regex.compile(pattern), confidence) for pattern, confidence in context.CUES.values()]
SCOPE = regex.compile(context.SCOPE.format(step=context.STEP, n=context.SCOPE_WORDS))
CLAUSE_END = re.compile("[.!?;,]")
DIRECT = [re.compile(p) for p in context.DIRECT]
SENTENCE_END = re.compile("[.!?]")
#: Letters, digits and _ are what \w stands for here.
SAID = [(re.compile(p.replace(r"[\p{L}\p{N}_]", r"\w")), kind, c) for p, kind, c in ((context.INDIRECT, "indirect", 0.7), (context.THIRD, "reported", 0.6))]


def negation_of(text: str, spans: list[tuple]) -> float | None:
    """The confidence of the surest cue whose scope a span touches.

    A scope never passes .!?;, so cues are looked for in the clauses at the spans alone.  Spans
    are in order; a scope is touched if of those that begin up to its end one reaches its
    start.
    """
    starts, reach, found = [s[0] for s in spans], list(accumulate((s[1] for s in spans), max)), None
    cuts = [-1, *(m.start() for m in CLAUSE_END.finditer(text)), len(text)]
    near: set[int] = set()
    for start, end, *_ in spans:
        near.update(range(max(bisect_right(cuts, start - 1), 1), min(bisect_left(cuts, end), len(cuts) - 1) + 1))
    for k in sorted(near):
        a, b = cuts[k - 1] + 1, cuts[k]
        for pattern, confidence in CUES:
            if found is not None and found >= confidence:
                continue
            for m in pattern.finditer(text, a, b):
                n = bisect_right(starts, SCOPE.match(text, m.end()).end())
                if n and reach[n - 1] >= m.start():
                    found = confidence
                    break
    return found


def reporting(text: str) -> list[tuple[int, int]]:
    """The sentences that hold a word of reporting, wherever in it; all patterns of ``SAID`` need one."""
    low = lowered(text)
    places = {at for word in K.REPORTING for at in occurrences(low, word)}
    if not places:
        return []
    cuts = [-1, *(m.start() for m in SENTENCE_END.finditer(text)), len(text)]
    return [(cuts[k - 1] + 1, cuts[k]) for k in sorted({bisect_left(cuts, at) for at in places})]


def quotes_of(text: str) -> list[tuple]:
    """(start, -confidence, end, kind) of the quotes that stay, greedily by their start."""
    every = {(*m.span(), "direct", 0.95) for p in DIRECT for m in p.finditer(text)}
    for start, end in reporting(text):
        every |= {(start, end, kind, c) for pattern, kind, c in SAID if pattern.search(text[start:end])}
    kept: list[tuple] = []
    for q in sorted((a, -c, b, kind) for a, b, kind, c in every):
        if not kept or q[0] >= kept[-1][2]:
            kept.append(q)
        elif q[1] < kept[-1][1]:
            kept[-1] = q
    return kept


def quotation_of(text: str, spans: list[tuple]) -> tuple[float | None, float | None]:
    """(surest quotation, greatest share of a quote's kind) around the spans; of a span's quotes the surest counts, then the earliest."""
    return quotation_in(quotes_of(text), spans)


def quotation_in(quotes: list[tuple], spans: list[tuple]) -> tuple[float | None, float | None]:
    starts, ends, best = [q[0] for q in quotes], [q[2] for q in quotes], []
    for start, end, *_ in spans:
        near = quotes[bisect_right(ends, start) : bisect_left(starts, end)]
        if near:
            best.append(max((-q[1] if start >= q[0] and end <= q[2] else -q[1] * 0.8, -q[0], q[3]) for q in near))
    return (max(b[0] for b in best), max(context.QUOTE_SHARE[b[2]] for b in best)) if best else (None, None)


SAFE = [(t, words, re.compile(context.words_pattern(words).replace(r"[\p{L}\p{N}_]", r"\w"))) for t, words in K.SAFE_CONTEXTS.items()]
CONTEXTS = "array<struct<context_type:string,hits:int>>"


def contexts_in(low: str) -> list[dict]:
    """The legitimate contexts whose words a lower-cased text has, with how often."""
    return [{"context_type": t, "hits": n} for t, words, p in SAFE if any(w in low for w in words) and (n := len(p.findall(low)))]


def contexts_of(text: pa.Array, low: pa.Array) -> pa.Array:
    """``CONTEXTS`` of many texts in lower case; null for those that hold none of the words."""
    held = holding(low, [w for _, words, _ in SAFE for w in words])
    return pa.array([contexts_in(low[k].as_py()) if h else None for k, h in enumerate(held.tolist())], pa.list_(pa.struct([("context_type", pa.string()), ("hits", pa.int32())])))


POLICY_CONTEXTS = [(name, re.compile("(?ai)" + "|".join(patterns))) for name, patterns in K.POLICY_CONTEXT_PATTERNS.items()]
POLICY_SCREEN = "(?i)" + "|".join(p.replace(r"\s", r"[\s\x0B]") for patterns in K.POLICY_CONTEXT_PATTERNS.values() for p in patterns)


def policy_contexts_of(text: pa.Array, low: pa.Array) -> pa.Array:
    """What ``policy.context_of`` gives, of many texts."""
    first = lambda t: next((name for name, p in POLICY_CONTEXTS if p.search(t)), None)
    return pa.array([first(text[k].as_py()) if m else None for k, m in enumerate(matching(text, POLICY_SCREEN).tolist())], pa.string())


AROUND = "spans array<struct<category:string,confidence:double>>, negation double, quotation double, most double, contexts array<struct<context_type:string,hits:int>>, quoted boolean"


def surrounded(rows: DataFrame, terms: list[dict]) -> DataFrame:
    """Of (doc_id, text, low) or (doc_id, text, low, found): (doc_id, spans, negation, quotation, most, contexts, quoted), a row for each.

    ``low``: the text in lower case, where the terms are looked for; ``found``: spans found before.
    """
    category = pa.list_(pa.struct([("category", pa.string()), ("confidence", pa.float64())]))
    hits = pa.list_(pa.struct([("context_type", pa.string()), ("hits", pa.int32())]))
    kinds = (category, pa.float64(), pa.float64(), pa.float64(), hits, pa.bool_())

    def around(text: str, low: str, found: list[dict]) -> tuple:
        spans = [(f["start"], f["end"], f["category"], f["confidence"]) for f in found]
        for t in terms:
            spans += [(at, at + len(t["term"]), t["category"], t["weight"]) for at in occurrences(low, t["term"])]
        spans.sort()
        quotes = quotes_of(text)
        negation, quotation = (negation_of(text, spans), quotation_in(quotes, spans)) if spans else (None, (None, None))
        return [{"category": c, "confidence": w} for *_, c, w in spans], negation, *quotation, contexts_in(low), bool(quotes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):  # few texts are Python objects at a time
                batch = whole.slice(begin, 256)
                text, low, *found = (batch.column(c).to_pylist() for c in range(1, batch.num_columns))
                new = [around(t or "", w or "", f or []) for t, w, f in zip(text, low, found[0] if found else [None] * len(text), strict=True)]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*new, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "spans", "negation", "quotation", "most", "contexts", "quoted"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *StructType.fromDDL(AROUND)]))


HITS = "array<struct<category:string,confidence:double>>"


def with_hits(rows: DataFrame, terms: list[dict]) -> DataFrame:
    """The rows whose ``low``, a text in lower case, holds a term, with ``hits`` in its place: category and weight of every occurrence of every term."""
    kept = [c for c in rows.columns if c != "low"]
    kind = pa.list_(pa.struct([("category", pa.string()), ("confidence", pa.float64())]))
    words = [t["term"] for t in terms]

    def hits(low: str) -> list[dict]:
        return [{"category": t["category"], "confidence": t["weight"]} for t in terms if t["term"] in low for _ in range(low.count(t["term"]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = whole.filter(pa.array(holding(whole.column("low"), words)))
            for batch in slices(held, "low"):
                found = pa.array([hits(low) for low in batch.column("low").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "hits"])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL(f"hits {HITS}")]))


def spanner(terms: list[dict], patterns: list[tuple]):
    """Of a text and the numbers of the terms and patterns that it holds as it is: all its spans, in order.

    A find in the form that has no letter in the raw text is none: digits and signs alone
    spell nothing.
    """
    shapes = [form_of(t["term"]) for t in terms]
    compiled = [(re.compile("(?i)" + p), lang, p, c, s, w) for lang, p, c, s, w in patterns]

    def spans_of(text: str, plain: list[int], matched: list[int]) -> list[tuple]:
        found = set()

        def add(start: int, end: int, t: dict) -> None:
            found.add((start, end, text[start:end], t["category"], t["severity"], t["weight"], f"{t['source']}:{t['term']}"))

        low = lowered(text) if plain else ""
        for k in plain:
            for at in occurrences(low, terms[k]["term"]):
                add(at, at + len(terms[k]["term"]), terms[k])
        for form, keep in forms(text):
            if formed := [k for k, shape in enumerate(shapes) if shape in form]:
                places = aligned(text, keep)
                for k in formed:
                    for at in occurrences(form, shapes[k]):
                        start, end = places.raw(at, at + len(shapes[k]))
                        if LETTER.search(text, start, end):
                            add(start, end, terms[k])
        for k in matched:
            pattern, lang, p, c, s, w = compiled[k]
            found.update((*m.span(), m[0], c, s, w, f"pattern:{lang}:{p}") for m in pattern.finditer(text))
        return sorted(found)

    return spans_of


def formed_in(texts: list[str], shapes: list[str]) -> set[int]:
    """Which texts hold a shape in one of their matchable forms."""
    made = [(k, form) for k, text in enumerate(texts) for form, _ in forms(text)]
    return {made[k][0] for k in np.flatnonzero(holding(pa.array([form for _, form in made], pa.large_string()), shapes))}


def placed(rows: DataFrame, terms: list[dict], patterns: list[tuple], more: list[tuple[str, str, Callable]] = ()) -> DataFrame:
    """Replaces the columns text and low by spans, negation, quotation and most; the others go through as they are.

    ``low``: the text in lower case; ``more``: (name, type, function of text and low) of columns
    that the same pass over the texts adds, as Arrow arrays.
    """
    kept = [c for c in rows.columns if c not in ("text", "low")]
    names = ("start", "end", "text", "category", "severity", "confidence", "rule_source")
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
    span = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    out = [*kept, *(name for name, *_ in more), "spans", "negation", "quotation", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of, shapes = spanner(terms, patterns), list(dict.fromkeys(form_of(t["term"]) for t in terms))
        words = [t["term"] for t in terms]
        exact = [re.compile("(?ai)" + p) for _, p, *_ in patterns]  # letters of ASCII alone have two cases here, as in a column function
        any_of = "(?i)" + "|".join(f"(?:{p})" for _, p, *_ in patterns)
        for whole in batches:
            text, low = pc.fill_null(whole.column("text"), ""), pc.fill_null(whole.column("low"), "")
            plainly = holding(low, words) if words else np.zeros(whole.num_rows, "?")
            matched = matching(text, any_of) if patterns else np.zeros(whole.num_rows, "?")
            both = pa.RecordBatch.from_arrays([text, low, *(whole.column(c) for c in kept)], ["text", "low", *kept])
            at = 0
            for batch in slices(both, "text"):
                texts = batch.column("text").to_pylist()
                spans, around = [[]] * len(texts), [(None, None, None)] * len(texts)
                near = formed_in(texts, shapes) if shapes else set()
                for k in range(len(texts)):
                    if k not in near and not plainly[at + k] and not matched[at + k]:
                        continue
                    lower = batch.column("low")[k].as_py() if plainly[at + k] else ""
                    plain = [i for i, w in enumerate(words) if w in lower] if lower else []
                    if own := spans_of(texts[k], plain, [i for i, p in enumerate(exact) if p.search(texts[k])] if matched[at + k] else []):
                        spans[k] = [dict(zip(names, s, strict=True)) for s in own]
                        around[k] = (negation_of(texts[k], own), *quotation_of(texts[k], own))
                at += len(texts)
                added = [of(batch.column("text"), batch.column("low")) for *_, of in more]
                new = [*added, pa.array(spans, span), *(pa.array(list(x), pa.float64()) for x in zip(*around, strict=True))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], out)

    schema = StructType([*(rows.schema[c] for c in kept), *(StructType.fromDDL(f"{name} {kind}")[0] for name, kind, _ in more), *StructType.fromDDL(PLACED)])
    return rows.mapInArrow(run, schema)
