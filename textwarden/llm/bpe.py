"""Byte-level BPE: encoding by a priority queue of merges, decoding by vocabulary.

``codec`` encodes a text column and decodes the ids again, ``decode`` takes ids alone.  A text is cut at blanks that
stand before a non-blank character; such a place always ends a pre-token, so a piece
between two of them has the same ids in every text, and pieces are remembered in a
table of bounded size.  A piece seen for the first time is split into pre-tokens and
each of those is merged: its symbols form a doubly linked list, a heap holds the
ranks of mergeable neighbours, and entries whose symbols have changed since are
skipped when they come up.

Defined results: a null text is encoded as an empty one; rows are handled one by
one, so repeated rows give repeated results; extra columns pass through untouched.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import corpus, uncollected

VOCABULARY = "byte_bpe_50k.json"
#: Pieces, and pre-tokens, that a Python worker remembers at most.
REMEMBERED = 300_000
#: Bits that hold an id in the key of a pair, and a place in an entry of the heap.
ID_BITS, PLACE_BITS = 32, 40
#: Rows that leave a Python worker at once; ids and texts of more needn't be held together.
ROWS = 256
CODED = "ids binary, n_tokens long, decoded string"


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BLANK_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")


def split_pieces(text: str) -> list[str]:
    """Cuts before each blank that a non-space character follows.

    The blank stays with what follows it.  No pre-token holds a blank before a
    non-space character except as its own first character, so these cuts never
    fall inside one.
    """
    parts = text.split(" ")
    if not BLANK_BEFORE_SPACE.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out if out[0] else out[1:]


def pretoken_pattern(letters: str, numbers: str) -> re.Pattern:
    """The pre-token pattern with its letters and numbers spelt out.

    No contraction begins with a letter or a blank, so words, the most frequent, are
    looked for first.
    """
    return re.compile(rf" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: For texts below U+0100, and below U+0180; the first is the faster one.
LATIN_1, LATIN = pretoken_pattern(LETTERS, NUMBERS), pretoken_pattern(LETTERS + r"\u0100-\u017f", NUMBERS)
#: What Python takes for a space and the tokenizer does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def latin_pretokens(text: str) -> list[str] | None:
    """The pre-tokens of a text that stays below U+0180 and has no odd spaces, else None."""
    if any(s in text for s in ODD_SPACES):
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return LATIN.findall(text) if max(text) < "\u0180" else None
    return LATIN_1.findall(text)


class Encoder:
    """The vocabulary and merge ranks of one tokenizer file, and what was encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_char = byte_alphabet()
        self.to_byte = {c: b for b, c in to_char.items()}
        self.first = [vocab[to_char[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << ID_BITS | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(self.to_byte[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.pieces: dict[str, bytes] = {}
        #: Ids of pre-tokens, and of those of the generation before.
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self._pretokenizer = None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token.

        ``rank[i]`` is the rank of the pair that begins at symbol i, or -1.  A heap
        entry holds a rank and the place where it stood; it is stale if the place
        has another rank by now.
        """
        sym = [self.first[b] for b in word]
        n = len(sym)
        find = self.ranks.get
        rank = [find(a << ID_BITS | b, -1) for a, b in zip(sym, sym[1:], strict=False)]
        heap = [r << PLACE_BITS | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return sym
        heapq.heapify(heap)
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, merged, mask = heapq.heappop, heapq.heappush, self.merged, (1 << PLACE_BITS) - 1
        while heap:
            entry = pop(heap)
            i = entry & mask
            r = entry >> PLACE_BITS
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            whole = sym[i] = merged[r]
            sym[j] = rank[j] = -1
            if k < n:
                before[k] = i
                r = rank[i] = find(whole << ID_BITS | sym[k], -1)
                if r >= 0:
                    push(heap, r << PLACE_BITS | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                r = rank[h] = find(sym[h] << ID_BITS | whole, -1)
                if r >= 0:
                    push(heap, r << PLACE_BITS | h)
        return [s for s in sym if s >= 0]

    def pretokens(self, piece: str) -> list[bytes]:
        words = latin_pretokens(piece)
        if words is not None:
            return [w.encode() for w in words]
        if self._pretokenizer is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._pretokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
        return [bytes(map(self.to_byte.__getitem__, w)) for w, _ in self._pretokenizer.pre_tokenize_str(piece)]

    def piece(self, piece: str) -> bytes:
        out = []
        for word in self.pretokens(piece):
            ids = self.words.get(word)
            if ids is None:
                ids = self.old_words.get(word) or little_endian(self.merge(word))
                if len(word) < 64:
                    if len(self.words) >= REMEMBERED:
                        self.words, self.old_words = {}, self.words
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        known, cut = self.pieces, split_pieces(text)
        out = list(map(known.get, cut))
        if None in out:
            if len(known) >= REMEMBERED:
                known.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    p = cut[i]
                    ids = out[i] = known.get(p) or self.piece(p)
                    if len(p) < 64:
                        known[p] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.at_special.split(text)
        return b"".join(
            np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in parts if p
        )

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def codec(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", path: str | None = None, decoded: bool = True) -> DataFrame:
    """Columns ``keep`` and (ids binary, n_tokens long, decoded string) of every row.

    ids are little-endian unsigned 32-bit integers; ``decoded`` is put together from
    the ids' vocabulary strings alone, or null if not asked for.
    """
    where = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = [f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = encoder(where)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.iloc[at : at + ROWS]
                with uncollected():
                    ids = [one.encode(t) for t in some["text"]]
                    back = [one.decode(i) for i in ids] if decoded else None
                out = some.drop(columns="text")
                out["ids"], out["n_tokens"], out["decoded"] = ids, [len(i) // 4 for i in ids], back
                yield out

    out = rows.mapInPandas(run, ", ".join([*kept, CODED]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "n_tokens", "decoded")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``decoded``: the vocabulary strings of the ids, put together, as text."""
    where = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(where)
        for ids in batches:
            yield ids.map(lambda b: one.decode(b or b""))

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def digests(docs: DataFrame) -> DataFrame:
    return codec(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    return digests(corpus(spark, sf_dir, "documents"))
