"""What larger tables showed: bounded batches, limits met exactly, one scan for a text's context."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from textwarden import streaming
from textwarden.operators import align, context, engine, language, matching, normalize, pii
from textwarden.plans import stream_queries
from textwarden.plans.moderate import moderate_corpus
from textwarden.streaming import in_order


def test_tokens_leave_in_bounded_batches():
    texts = ["a1 b, " * 9_000, None, "", "end 😀"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array(texts)], ["id", "text"])
    parts = list(language.token_batches(iter([batch])))
    assert len(parts) == 2 and max(p.num_rows for p in parts) <= language.MOST_TOKENS
    rows = [r for p in parts for r in p.to_pylist()]
    assert len(rows) == 27_002 and [r["pos"] for r in rows[:27_000]] == list(range(27_000))
    assert [(r["id"], r["pos"], r["token"], r["start"], r["token_type"]) for r in rows[-2:]] == [(4, 0, "end", 0, "word"), (4, 1, "😀", 4, "emoji")]


def test_hinglish_at_the_limit_is_not_beyond_it(spark):
    rows = language.hinglish_score(spark.createDataFrame([(1, "tea see sea"), (2, "tea see tea sea khoon")], "doc_id long, text string")).orderBy("doc_id")
    assert [r.hinglish for r in rows.collect()] == [0.0, 0.12]


def test_typed_tokens_of_odd_characters():
    want = [("3❷,❸.4", "number"), (",", "punctuation"), ("❶😀", "emoji"), ("O'Neil-", "word"), ("'", "punctuation"), ("हि", "word"), ("\u200b", "other"), ("x٣", "word")]
    found = [(t, kind) for t, _, _, kind in language.typed_tokens("3❷,❸.4, ❶😀 O'Neil-  ' हि\u200b x٣")]
    assert found == [*want[:4], *want[4:]]


def test_contexts_of_a_document_from_one_scan(spark):
    texts = [(1, 'He said "you idiot" and left. Not a stupid fool.'), (2, "nothing here"), (3, None), (4, "A harassment complaint: moron"), (None, "you are not an idiot")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en"))
    lexicon = matching.load_lexicon(spark)
    found = engine.document_contexts(docs, lexicon)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    spans, contexts = matching.match_terms(docs, lexicon), context.safe_contexts(docs)
    negated = context.negated_spans(spans, context.negation_scopes(context.negation_cues(docs)))
    quoted = context.quoted_spans(spans, context.resolve_quotes(context.exploded_quotes(docs, context.all_quotes_of)))
    want = context.context_modifiers(matching.lpe_category_scores(spans), spans, negated, quoted, context.safe_context_modifiers(contexts))
    rounded = lambda df: sorted((r.doc_id or 0, r.category, round(r.modifier, 9)) for r in df.collect())
    assert rounded(context.modifiers_of(found)) == rounded(want) != []
    assert {r.doc_id: (r.has_negation, r.has_quotation) for r in context.flags_of(found).collect()}[1] == (True, True)


def test_reporting_sentences_are_found_by_their_words():
    text = "They told us. Sad! He SAID so? said.according to me"
    assert [text[a:b] for a, b in align.reporting(text)] == ["They told us", " He SAID so", " said", "according to me"]


def test_unicode_passes_take_few_texts_at_a_time():
    texts = pa.array(["plain", "e\u0301te\u0301 \u0928\u093c", None, ""] * 50)
    parts = list(normalize.unicode_parts(texts, "NFC", False))
    assert max(map(len, parts)) <= normalize.TEXTS and sum(map(len, parts)) == 200
    assert pa.concat_arrays(parts).to_pylist()[-4:] == ["plain", "\u00e9t\u00e9 \u0929", None, ""]
    assert pa.concat_arrays(normalize.unicode_parts(texts, None, True)).to_pylist()[1] == "ete \u0928"


def test_events_of_a_batch_come_in_order():
    rows = [{"us": us, "event_id": k} for us, k in ((5, 2), (-1, 9), (5, 1), (2**40, 3))]
    assert list(in_order(iter(rows))) == [(-1, 9), (5, 1), (5, 2), (2**40, 3)] and list(in_order(iter(()))) == []


def test_texts_without_personal_data_are_left_out_first(spark):
    found = pii.extract_pii(spark.createDataFrame([(1, "a b@c.io, 9876543210"), (2, "nothing")], "doc_id long, text string"))
    assert "RLIKE" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.value) for r in found.collect()] == [(1, "b@c.io"), (1, "9876543210")]


ODD = ["id|_|-|iot q|_|ick", "cckqu xph phck ><x ()", "fuuuuck ​shíiiit", "aaabbbccc 111 ___ ### AAAa", "æÆss f*ck F*CK", "", "móron 1d1ot \\/\\/\\/", "aaaa‍aa 🖕🖕🖕"]


def test_forms_by_arrays_are_those_by_patterns():
    unseen = lambda t: align.UNSEEN.sub(lambda m: align.K.LIGATURES.get(m[0], ""), t)
    for text in ODD:
        for form, keep in align.forms(text):
            drawn = re.sub(r"([^\W\d_])\1{2,}", lambda m, keep=keep: m[1] * keep, align.folded(unseen(text)))
            assert form == align.SOUND.sub(align.sounded, drawn)
            placed = align.aligned(text, keep)
            assert placed.text == form and len(placed.begins) == len(placed.ends) == len(form)
    assert [align.aligned("fuuuuck!", 1).raw(0, 3), align.aligned("fuuuuck!", 1).raw(1, 2)] == [(0, 7), (1, 5)]
    assert align.formed_in([*ODD, "such a m0r0n", "plain"], ["moron", "fuk"]) == {2, 4, 6, 8}


def test_cues_of_languages_by_arrays_are_those_by_patterns(spark):
    texts = [*ODD, "very achha xachhay, kya hai yaar the end", "नमस्ते yyy kya\x0bhai", " ", "tea see tea sea khoon", "ghar\x1chai ٣ ß İI", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r for r in language.hinglish_score(language.script_shares(docs)).collect()}
    low = [r.low for r in docs.orderBy("doc_id").select(F.lower("text").alias("low")).collect()]
    for k, c in enumerate(language.cues_in(pa.array(texts), pa.array(low)).to_pylist()):
        shares = {s: n / c["kept"] for s, n in zip(language.K.SCRIPTS, c["scripts"], strict=True) if n}
        assert shares == want[k].scripts
        score = min(c["tenths"] / 10 / c["words"], 1.0) if c["words"] else 1.0
        assert (score if score > 0.1 else 0.0) == want[k].hinglish, texts[k]


def test_the_flagship_and_the_engine_scan_once(spark):
    docs = spark.createDataFrame([(1, "you 1d1ot, IDIOT and moron"), (1, "a moron"), (2, "fine"), (3, None)], "doc_id long, text string")
    found = engine.scanned_documents(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    (row,) = found.collect()
    assert [(s.start, s.text) for s in row.kept] == [(2, "moron"), (11, "IDIOT"), (21, "moron")]
    assert len(row.spans) == 4 and {t.split(" ->")[0] for t in row.traces} == {"Rule: lexicon:en:idiot", "Rule: lexicon:en:moron"}
    plan = moderate_corpus(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "RLIKE" in plan and "regexp_count" not in plan


def test_parts_of_a_batch_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(align, "BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 25, "", None, "abc", "d" * 8, "ee"] + [""] * 300)], ["text"])
    parts = list(align.slices(batch, "text"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) <= align.TEXTS
    assert parts[0].num_rows == 1 and all(p.num_rows == 1 or sum(map(len, filter(None, p.column(0).to_pylist()))) <= 10 for p in parts)


def test_policy_queries_scan_the_texts_once(spark, sf):
    from textwarden.plans import policy_queries

    for df in (policy_queries.audit(spark, sf), policy_queries.applied(spark, sf), policy_queries.base(spark, sf)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("documents.parquet") + df._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    decisions, scores, contexts, own = policy_queries.gathered(spark, sf)
    for df in (decisions, scores, contexts, own["thresholds"]):
        assert not any("documents.parquet" in f for f in df.inputFiles())


def test_hits_of_terms_are_their_occurrences(spark):
    rows = spark.createDataFrame([(1, "idiot idiotidiot fool"), (2, "nothing"), (3, None), (4, "a fool")], "doc_id long, low string")
    terms = [{"term": "idiot", "category": "c", "weight": 0.5}, {"term": "fool", "category": "d", "weight": 0.25}]
    found = {r.doc_id: [(h.category, h.confidence) for h in r.hits] for r in align.with_hits(rows, terms).collect()}
    assert found == {1: [("c", 0.5)] * 3 + [("d", 0.25)], 4: [("d", 0.25)]}


def test_tasks_pass_on_the_newest_outcomes_alone():
    names = ["component", "outcome_id", "score", "us"]
    rows = [("a" if k % 3 else None, k, k / 100, k * 7 % 50) for k in range(100)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], pa.schema([("component", pa.string()), ("outcome_id", pa.int64()), ("score", pa.float64()), ("us", pa.int64())])) for part in (rows[:60], rows[60:])]
    out = [r for b in streaming.newest_of(iter(batches), 5) for r in b.to_pylist()]
    for component in ("a", None):
        want = sorted(((r[3], r[1], r[2]) for r in rows if r[0] == component), reverse=True)[:5]
        own = [r for r in out if r["component"] == component]
        assert [(r["us"], r["outcome_id"], r["score"]) for r in own] == want
        assert sum(r["stands_for"] for r in own) == sum(r[0] == component for r in rows)
    assert list(streaming.newest_of(iter(()), 5)) == []


def test_a_streamed_file_is_dealt_over_the_cores(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(stream_queries, "moderate_corpus", lambda s, batch: seen.append(batch.rdd.getNumPartitions()) or batch.selectExpr("doc_id", "1.0D AS confidence", "0.0D AS max_score"))
    assert stream_queries.m1(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert seen and min(seen) >= spark.sparkContext.defaultParallelism


def test_audits_of_sparse_days_are_gathered_by_month(spark, tmp_path):
    from textwarden import sources

    rows = spark.range(0, 400, 1, 8).selectExpr("concat('dec-', id) AS entry_id", "date_add(DATE '2024-01-01', cast(id % 100 AS int)) AS event_date")
    rows = rows.unionByName(spark.sql("SELECT 'dec-none' AS entry_id, CAST(NULL AS date) AS event_date"))
    for period, n in (("day", 101), ("month", 5), ("year", 2)):
        path = f"file://{tmp_path}/{period}"
        sources.write_audit(rows, path, period)
        folders = [f for f in (tmp_path / period).iterdir() if f.is_dir()]
        assert len(folders) == n and all(len(list(f.glob("*.json"))) == 1 for f in folders)
        back = sources.read_audit(spark, path, rows.schema)
        assert sorted(back.collect(), key=str) == sorted(rows.select(*back.columns).collect(), key=str)
        one = sources.read_audit(spark, path, rows.schema, "2024-02-03")
        assert sorted(r.entry_id for r in one.collect()) == ["dec-133", "dec-233", "dec-33", "dec-333"]
        assert "PartitionFilters: []" not in one._jdf.queryExecution().executedPlan().toString()
        sources.write_audit(rows.where("entry_id = 'dec-33'"), path, period)
        assert sources.read_audit(spark, path, rows.schema, "2024-02-03").count() == 5


def test_the_audit_round_trip_has_a_file_for_each_month(spark, sf):
    from textwarden.plans import monitor_queries

    back = monitor_queries.a6(spark, sf)
    days = {r.event_date for r in back.select("event_date").distinct().collect()}
    assert len(days) > 1 and len(back.inputFiles()) == len({d[:7] for d in days})
