"""BPE, token files and rollups against the tokenizers library and plain counting."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textwarden.llm import bpe, rollups, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  ", "a", "Hello  world\n\n x ", "it's 3.5€ déjà-vu ünï", "a  <|endoftext|> b", "<|endoftext|>", "न मत 😀😀 \t\r\n", "x" * 3000, "  lead", "trail  ", "\x1c\x85 a", "a" + "\u00a0b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def truth(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text_as_the_library(library, text):
    one = bpe.encoder(PATH)
    ids, decoded = truth(library, text)
    assert np.frombuffer(one.encode(text), "<u4").tolist() == ids
    assert one.decode(one.encode(text)) == decoded


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cdé' \n\t.1²ßKĀ\x1c\x85\xa0-!<|>"), max_size=60))
def test_any_text(text):
    one, lib = bpe.encoder(PATH), token_files.library_encoder(PATH)
    ids = lib.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(one.encode(text), "<u4").tolist() == ids
    assert np.frombuffer(lib.encode(text), "<u4").tolist() == ids


def test_query_on_odd_rows(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "a", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.digests(df).collect())
    want = []
    for i, t, _ in rows:
        ids, text = truth(library, t or "")
        want.append((i is not None, i or 0, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(ids)))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=400))
def test_packing_round_trip(values):
    ids = np.array(values, "u4")
    assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_token_files_by_brute_force(spark, library):
    rows = [(i * 7 % 31, t, 5) for i, t in enumerate(TEXTS)] + [(2, None, 5), (2, "again", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    segments = token_files.write_segments(df)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read_documents(segments).orderBy("start").collect()]
    at, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*truth(library, text or "")[0], 0], "<u4").tobytes()
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert token_files.read_documents(token_files.write_segments(df.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), min_size=1, max_size=900), st.data())
def test_reading_some_ids_of_a_segment(values, data):
    ids = np.array(values, "u4")
    at = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - at))
    assert (token_files.unpack(token_files.pack(ids), at, n) == ids[at : at + n]).all()


def test_files_of_several_ranges(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 400)
    monkeypatch.setattr(token_files, "SEGMENT", 60)
    rows = [(i * 37 % 101, f"text number {i} of many") for i in range(150)] + [(None, "x"), (None, None), (5, "again")]
    segments = token_files.write_segments(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    assert segments.select("part").distinct().count() > 4 and segments.where("seq > 0").count()
    got = [(r.doc_id, r.start, zlib.crc32(r.ids)) for r in token_files.read_documents(segments).orderBy("start").collect()]
    at, want = 0, []
    own = [(-1 if i is None else i, np.array([*truth(library, t or "")[0], 0], "<u2").tobytes()) for i, t in rows]
    for doc, ids in sorted(own):
        want.append((None if doc < 0 else doc, at, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())))
        at += len(ids) // 2
    assert got == want
    segments.unpersist()


def test_documents_by_the_block_index(spark, library, monkeypatch):
    rows = [(i % 40, f"{t} {i}") for i, t in enumerate(TEXTS * 3)] + [(None, "no id")]
    segments = token_files.write_segments(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = spark.createDataFrame([(3,), (3,), (17,), (999,), (None,)], "doc_id long")
    got = sorted((r.doc_id, bytes(r.ids)) for r in token_files.fetch_documents(segments, wanted).collect())
    want = [(i, np.array([*truth(library, t)[0], 0], "<u4").tobytes()) for i, t in rows if i in (3, 17)]
    assert got == sorted(want)
    monkeypatch.setattr(token_files, "MOST_BROADCAST", 0)  # starts are shuffled then
    again = token_files.read_documents(segments).select("doc_id", "start").collect()
    monkeypatch.undo()
    assert sorted(map(str, again)) == sorted(map(str, token_files.read_documents(segments).select("doc_id", "start").collect()))


def test_pretokens_outlive_a_full_table(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    one = token_files.LibraryEncoder(PATH)
    for k in range(30):
        for text in [*TEXTS, f"word{k} again, and 'twas \u00e9t\u00e9-{k}!\n\nso"]:
            assert np.frombuffer(one.encode(text), "<u4").tolist() == truth(library, text)[0]


def sums(spark, ledger):
    return sorted((r.n_docs, r.n_tokens) for r in rollups.totals(spark, ledger).collect())


def test_replays_after_folding_and_empty_batches(spark, tmp_path):
    ledger, small = str(tmp_path / "ledger"), str(tmp_path / "small")
    batch = lambda b, n: spark.createDataFrame([("s", "en", "t", 1, n, b)], "source string, lang string, tokenizer string, sign long, n_tokens long, batch_id long")
    rollups.commit(batch(1, 10), ledger)
    rollups.commit(batch(2, 100), ledger)
    rollups.compacted(spark, ledger, small, 2)
    for b, n in ((2, 100), (1, 10)):
        rollups.commit(batch(b, n), small)
        assert sums(spark, small) == [(2, 110)]
    with pytest.raises(Exception, match="folded beyond"):
        rollups.commit(batch(0, 7), small)
    rollups.commit(batch(3, 5), small)
    assert sums(spark, small) == [(3, 115)]
    rollups.commit(batch(2, 100).where("false"), ledger, [2])
    assert sums(spark, ledger) == [(1, 10)]


def test_rollups_follow_signed_batches(spark, library, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = [(1, "a b", "s", "en"), (2, "c", None, "en"), (3, None, "s", None), (3, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    counts = rollups.token_counts(docs)
    first = rollups.inserted(counts).withColumn("batch_id", F.lit(1).cast("long"))
    rollups.commit(first, ledger)
    rollups.commit(first, ledger)  # a replay changes nothing
    one = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollups.totals(spark, ledger).collect()}
    assert one["s", "en", rollups.WORDS] == (1, 2) and one[None, "en", rollups.WORDS] == (1, 1) and one["s", None, rollups.BPE] == (2, 0)
    assert one["s", "en", rollups.BPE] == (1, len(truth(library, "a b")[0]))
    after = rollups.token_counts(docs.where("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 1, "a b c").otherwise(F.col("text"))))
    rollups.commit(rollups.changed(counts, after).withColumn("batch_id", F.lit(2).cast("long")), ledger)
    two = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollups.totals(spark, ledger).collect()}
    want = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in after.groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).collect()}
    assert two == want
    rollups.compacted(spark, ledger, str(tmp_path / "small"), 1)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollups.totals(spark, str(tmp_path / "small")).collect()} == want
    assert rollups.token_counts(docs.limit(0)).count() == 0


def test_op8_counts_all_documents(spark, sf, library):
    got = {(r.source, r.lang): r.n_tokens for r in rollups.op8_token_counts(spark, sf).where(F.col("tokenizer") == rollups.BPE).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r.source, r.lang] = want.get((r.source, r.lang), 0) + len(library.encode(r.text, add_special_tokens=False).ids)
    assert got == want
