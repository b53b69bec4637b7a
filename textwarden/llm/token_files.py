"""Token ids in files of patched frame-of-reference blocks.

Texts are encoded with the tokenizers library where they are read, with the end id
after each; the ids are dealt to ranges of doc_id whose bounds are known beforehand and
sorted, and each task of that shuffle writes segments of about ``SEGMENT`` ids.  A segment is one binary value in a row of a
Parquet file in the shared folder, beside the ids and lengths of its documents, so
Spark's own commit protocol covers lost executors and any store that Spark reaches
will do.  Its layout, all little-endian:

    header     magic "PFR1", block size, ids, blocks, exceptions   5 x u32
    starts     first 64-bit word of each block, and the end        u32 each
    patches    first exception of each block, and the end          u32 each
    minima     least id of each block                              u32 each
    values     an exception's id less the minimum                  u32 each
    widths     bits of each packed id                              u8 each
    places     an exception's place in its block                   u8 each
    padding to a multiple of 8, then the packed words              u64 each

In each block of 128 ids the minimum is subtracted and the rest is packed at the width
that ``PERCENTILE`` of the ids need; the ids that need more are in the exception list.
``starts`` gives random access to blocks, which ``fetch_documents`` uses.

Defined results: a null text counts as an empty one, which has the end id alone; rows
of equal doc_id follow each other in the order of their ids; null ids come first;
other columns don't take part.  An empty table gives no segment and no row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.bpe import VOCABULARY, byte_alphabet, latin_pretokens, little_endian, split_pieces
from textwarden.llm.common import corpus, uncollected, written

BLOCK, SEGMENT, PERCENTILE, END = 128, 1 << 20, 98, 0
MAGIC = 0x31524650
#: Pre-tokens of one generation that a Python worker remembers; segments whose places are broadcast at most.
REMEMBERED, MOST_BROADCAST = 250_000, 1_000_000
#: Bytes of text that one range of documents is to hold.
RANGE = 16 << 20
SEGMENTS = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, segment binary"


class Remembered(dict):
    """Ids of strings that come again and again; ``ask`` gives those that aren't known.

    What is asked for again outlives a full table by a generation; long strings aren't kept.
    """

    def __init__(self, ask: Callable[[str], bytes], before: dict[str, bytes]):
        self.ask, self.before = ask, before

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.ask(key)
        if len(key) < 64:
            self[key] = ids
        return ids

    def renewed(self) -> Remembered:
        """This table, or the next generation's if it is full."""
        return self if len(self) < REMEMBERED else Remembered(self.ask, dict(self))


class LibraryEncoder:
    """The tokenizers library, asked once for each pre-token that comes again and again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The printable character that stands for each byte, by the byte.
        self.printable = byte_alphabet()
        self.words, self.pieces = Remembered(self.ask_word, {}), Remembered(self.ask_piece, {})

    def ask_word(self, word: str) -> bytes:
        """Ids of a whole pre-token, which the library's model merges without looking for pre-tokens again."""
        return little_endian([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.printable))])

    def ask_piece(self, piece: str) -> bytes:
        return little_endian(self.library.encode_batch_fast([piece], add_special_tokens=False)[0].ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self.ask_piece(text)  # the library itself finds the special tokens of the text
        words = latin_pretokens(text)
        if words is None:
            self.pieces = self.pieces.renewed()
            return b"".join(map(self.pieces.__getitem__, split_pieces(text)))
        self.words = self.words.renewed()
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def pack(ids: np.ndarray) -> bytes:
    """One segment of ids (unsigned 32-bit)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, "u4")
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    rows = full.reshape(blocks, BLOCK)
    minima = rows.min(axis=1) if blocks else np.empty(0, "u4")
    rest = rows - minima[:, None]
    need = np.frexp(rest.astype("f8"))[1].astype("u1")  # bits of each value
    at = -(-BLOCK * PERCENTILE // 100) - 1
    widths = np.partition(need, at, axis=1)[:, at] if blocks else np.empty(0, "u1")
    over = need > widths[:, None]
    block_of, places = np.nonzero(over)
    values = rest[over]
    patches = np.append(0, np.cumsum(over.sum(axis=1))).astype("u4")
    starts = np.append(0, np.cumsum(widths.astype("u4") * (BLOCK // 64))).astype("u4")
    words = np.zeros(int(starts[-1]), "u8")
    for w in np.unique(widths).tolist():
        if not w:
            continue
        which = np.flatnonzero(widths == w)
        columns = np.ascontiguousarray((rest[which] & np.uint32((1 << w) - 1)).T).astype("u8")
        out = np.zeros((BLOCK // 64 * w, len(which)), "u8")
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            out[word] |= columns[j] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= columns[j] >> np.uint64(64 - shift)
        words[starts[which][:, None] + np.arange(BLOCK // 64 * w, dtype="u4")] = out.T
    head = np.array([MAGIC, BLOCK, n, blocks, len(values)], "<u4")
    body = b"".join(
        [a.astype(t).tobytes() for a, t in ((head, "<u4"), (starts, "<u4"), (patches, "<u4"), (minima, "<u4"), (values, "<u4"), (widths, "u1"), (places, "u1"))]
    )
    return body + b"\0" * (-len(body) % 8) + words.astype("<u8").tobytes()


def unpack(segment: bytes, at: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids of a segment from the one at place ``at`` on; all, unless told otherwise.

    The index of block starts leads to the blocks that hold them; no other is touched.
    """
    magic, size, n, blocks, patched = np.frombuffer(segment, "<u4", 5).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    count = n - at if count is None else count
    if at < 0 or count < 0 or at + count > n:
        raise IndexError("the segment does not hold these ids")
    low, high = at // size, -(-(at + count) // size)
    here = 20

    def take(kind: str, total: int, a: int, b: int) -> np.ndarray:
        nonlocal here
        item = np.dtype(kind).itemsize
        out = np.frombuffer(segment, kind, b - a, here + item * a)
        here += item * total
        return out

    starts, patches = take("<u4", blocks + 1, low, high + 1), take("<u4", blocks + 1, low, high + 1)
    minima = take("<u4", blocks, low, high)
    first, last = (int(patches[0]), int(patches[-1])) if len(patches) else (0, 0)
    values, widths, places = take("<u4", patched, first, last), take("u1", blocks, low, high), take("u1", patched, first, last)
    base = int(starts[0]) if len(starts) else 0
    words = np.frombuffer(segment, "<u8", int(starts[-1]) - base if len(starts) else 0, here + -here % 8 + 8 * base)
    rest = np.zeros((high - low, size), "u4")
    for w in np.unique(widths).tolist():
        if not w:
            continue
        which = np.flatnonzero(widths == w)
        packed = np.ascontiguousarray(words[starts[:-1][which][:, None] - np.uint32(base) + np.arange(size // 64 * w, dtype="u4")].T)
        out = np.empty((size, len(which)), "u4")
        mask = np.uint64((1 << w) - 1)
        for j in range(size):
            word, shift = divmod(j * w, 64)
            v = packed[word] >> np.uint64(shift)
            if shift + w > 64:
                v = v | packed[word + 1] << np.uint64(64 - shift)
            out[j] = v & mask
        rest[which] = out.T
    rest[np.repeat(np.arange(high - low), np.diff(patches.astype("i8"))), places] = values
    return (rest + minima[:, None]).reshape(-1)[at - low * size : at - low * size + count]


def encoded(docs: DataFrame, where: str, end_id: int) -> DataFrame:
    """(part, doc_id, ids): each text's ids and the end id, one partition for each range of doc_ids.

    Ids are 16 bits wide if the vocabulary allows it, so that what is shuffled later is
    small; ``pack`` reads either.
    """
    kind = id_type(where, end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, tail = library_encoder(where), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 256):
                with uncollected():
                    ids = [np.frombuffer(got + tail, "<u4").astype(kind).tobytes() for got in map(one.encode, texts[at : at + 256])]
                some = batch.iloc[at : at + 256]
                yield pd.DataFrame({"part": some["part"], "doc_id": some["doc_id"], "ids": ids})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, n = in_ranges(rows)
    return ranged.mapInPandas(run, "part int, doc_id long, ids binary").repartitionById(n, F.col("part"))


def in_ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their range, and how many ranges there are.  Adds ``part``: the number of the range of doc_ids, of about RANGE bytes of text each, that a row is in.

    The bounds come from one aggregation over the table, so the texts needn't be
    encoded, or shuffled, to find them; there are at most four ranges for each shuffle
    partition.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(most, -(-size // RANGE)))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    bounds = (rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []) if n > 1 else []
    below = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<long>")
    part = F.size(F.filter(below, lambda b: b < F.col("doc_id"))) if len(bounds) else F.lit(0)
    return rows.select(F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int").alias("part"), "doc_id", "text"), n


def id_type(where: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(where).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def write_segments(docs: DataFrame, path: str | None = None, end_id: int = END) -> DataFrame:
    """Encodes texts, puts them in ascending order of doc_id and writes the files; returns them, read back.

    Texts are encoded where they are read; what is shuffled, once, is ids.  A segment
    holds ids of one range of documents, whichever task gets that range.
    """
    where = path or public_tokenizers.path(VOCABULARY)
    kind = id_type(where, end_id)
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, docs_, lengths, held, part, seq = [], [], [], 0, None, 0

        def segment() -> pd.DataFrame:
            packed = pack(np.frombuffer(b"".join(ids), kind).astype("u4"))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [held], "doc_ids": [docs_], "lengths": [lengths], "segment": [packed]})

        for batch in batches:
            for own, doc, got in zip(batch["part"], batch["doc_id"], batch["ids"], strict=True):
                if own != part or held >= SEGMENT:
                    if docs_:
                        yield segment()
                    seq = seq + 1 if own == part else 0
                    ids, docs_, lengths, held, part = [], [], [], 0, own
                ids.append(got)
                docs_.append(None if pd.isna(doc) else int(doc))
                lengths.append(len(got) // width)
                held += lengths[-1]
        if docs_:
            yield segment()

    placed = encoded(docs, where, end_id).sortWithinPartitions("part", "doc_id", "ids")
    return written(placed.mapInPandas(run, SEGMENTS), "token_segments")


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds ``start``: how many ids all segments before one hold.

    Totals of the write tasks are summed in one small window, a row for each task;
    inside a task's own segments a window by task goes on from there.
    """
    sizes = segments.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("own")).join(bases, "part")
    starts = offsets.select("part", "seq", (F.col("base") + F.col("own")).alias("start"))
    small = sizes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST  # else the segments are shuffled
    return segments.join(F.broadcast(starts) if small else starts, ["part", "seq"])


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                ids, ends = unpack(s.segment), np.cumsum(s.lengths)
                cut = [ids[e - n : e].astype("<u4").tobytes() for n, e in zip(s.lengths, ends, strict=True)]
                docs = pd.array([None if d is None or d != d else int(d) for d in s.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": docs, "start": s.start + ends - s.lengths, "n_tokens": s.lengths, "ids": cut})

    return with_starts(segments).select("doc_ids", "lengths", "start", "segment").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def fetch_documents(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose ids are in ``wanted`` (doc_id), by the block index.

    Only places of documents are looked through; of a segment only the blocks that hold
    a wanted document are unpacked.  Repeated rows of a doc_id come back each.
    """

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                n = np.asarray(s.lengths, "i8")
                docs = pd.array([None if d is None or d != d else int(d) for d in s.doc_ids], "Int64")
                yield pd.DataFrame({"part": s.part, "seq": s.seq, "doc_id": docs, "at": np.cumsum(n) - n, "n": n})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                ids = [unpack(s.segment, p["at"], p["n"]).astype("<u4").tobytes() for p in s.found]
                yield pd.DataFrame({"doc_id": [p["doc_id"] for p in s.found], "ids": ids})

    every = segments.select("part", "seq", "doc_ids", "lengths").mapInPandas(places, "part int, seq int, doc_id long, at long, n long")
    found = every.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    by_segment = found.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("found"))
    return segments.select("part", "seq", "segment").join(by_segment, ["part", "seq"]).select("segment", "found").mapInPandas(read, "doc_id long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all ``documents`` and says where each document's ids are in the files."""
    back = read_documents(write_segments(corpus(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
