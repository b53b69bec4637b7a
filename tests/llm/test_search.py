"""Near-duplicates, decontamination and nearest neighbours against brute force."""

import hashlib
import math
import random
import re

import numpy as np

from textwarden.llm import ann, decontaminate, near_dedup


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def classes(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            same = rows[x][0] == rows[y][0] or (sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]))
            if same:
                a, b = find(x), find(y)
                top[a] = b
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return {i: least[find(x)] for x, (i, _) in enumerate(rows)}, {i: len(s) for (i, _), s in zip(rows, sets, strict=True)}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 8)):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    # a chain: each differs from the next by a little, the ends by a lot
    chain = [r.choice(vocabulary) for _ in range(100)]
    for k in range(25):
        chain[k * 4 % 100] = f"new{k}"
        rows.append((i, " ".join(chain)))
        i += 1
    r.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    for seed, width, percent in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, bucket string, n_shingles int")
        got = near_dedup.near_duplicates(df, width, percent).collect()
        component, sizes = classes(rows, width, percent)
        assert {r.doc_id: r.component_id for r in got} == component
        assert {r.doc_id: r.n_shingles for r in got} == sizes
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_find_what_stars_miss(spark):
    """A star around the least member alone would lose these links; blocks of few rows find them."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1, i, i) for i, _ in rows], "bucket long, doc_id long, component long")
    signed = near_dedup.signatures(df, 3)
    sketches = signed.select("doc_id", "n_shingles", "sketch").where("sketch is not null")
    sets = near_dedup.sets_of(df, ids.select("doc_id"), 3)
    size = near_dedup.BLOCK
    try:
        near_dedup.BLOCK = 7
        left = near_dedup.with_partners(ids, sketches, 85)
        links = near_dedup.between_components(left, sets, 85).collect()
    finally:
        near_dedup.BLOCK = size
    component, _ = classes(rows, 3, 85)
    linked = spark.createDataFrame([(min(r.a, r.b), max(r.a, r.b)) for r in links], "a long, b long")
    found = {r.doc_id: r.component for r in near_dedup.components(linked).collect()}
    assert {i: found.get(i, i) for i in component} == component


def test_components_take_few_jobs(spark):
    """Components equal those of brute force; a forest of stars needs no further round, so the driver keeps few jobs and tasks."""
    r = random.Random(5)
    paths = [(i, i + 1) for i in range(100, 140)] + [(i + 1, i) for i in range(200, 230)]
    some = [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(45)]
    leaves = [(1, i) for i in range(2, 60)] + [(i, 60) for i in range(61, 90)]
    for links, jobs in (([*paths, *some, *some[:9], (7, 7), *leaves], None), (leaves, 8), ([(7, 7)], 8)):
        top = {i: i for pair in links for i in pair if pair[0] != pair[1]}
        for _ in top:
            for a, b in ((a, b) for a, b in links if a != b):
                top[a] = top[b] = min(top[a], top[b])
        group = f"components-{len(links)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            found = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
            ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows = [(x.doc_id, x.component) for x in found.collect()]
        assert dict(rows) == top and len(rows) == len(top)
        assert jobs is None or 0 < ran <= jobs


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c " * 20_000), (8, "A b c " * 20_000), (4, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 3, 85).collect())
    assert got == sorted([(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 3, 7, True), (8, 3, 7, False)], key=lambda r: r)
    assert near_dedup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_large_group_of_copies(spark):
    df = spark.range(600).selectExpr("id AS doc_id", "concat('the same words stand here again and again ', CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END) AS text")
    got = {r.component_id for r in near_dedup.near_duplicates(df, 3, 70).collect()}
    assert got == {0}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        windows += [(i, tuple(w[s : s + k])) for s in range(len(w) - k + 1) if k]
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, win in set(windows):
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids.add(i)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(12)] + ["É", "é", "A", "b2"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 25, 30, 12])] + [(50, None), (51, "..."), (52, "zz"), (11, "v1")]
    docs = []
    for d in range(40):
        text = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if d % 2:
            piece = (r.choice(items)[1] or "").split()
            at = r.randint(0, len(text))
            text[at:at] = piece[r.randint(0, 2) :]
        docs.append((d, r.choice([" ", ", ", "--"]).join(text)))
    docs += [(100, None), (101, ""), (102, "  .. "), (103, (items[8][1] + " x ") * 300)]
    df = spark.createDataFrame([(*x, "clash", "k") for x in docs], "doc_id long, text string, words string, key string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.decontaminate(df, bench).collect()}
    assert got == contamination(docs, items)
    assert decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    twice = df.where("doc_id = 103").unionAll(df.where("doc_id = 103"))
    assert decontaminate.decontaminate(twice, bench).count() == 2


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.bounded_broadcast, "__defaults__", (0,))
    docs, items = [(1, "a b c d e f g h i j k"), (2, "a b c"), (3, "q")], [(7, "b c d e f g h i j k l"), (8, "q")]
    got = {x.doc_id: x.n_hit for x in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: 10, 2: 0, 3: 1}


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "TILE", 16)
    monkeypatch.setattr(ann, "FAN", 2)
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 12))
    x[50:90] = x[50]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 12), (1300, [float("nan")] * 12), (1400, [1.0] * 11 + [None]), (None, [1.0] * 12), (1500, [float("inf")] * 12), (10, x[10].tolist())]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, rank string")
    got = {}
    for g in ann.nearest(df.where("vec_id % 10 = 0"), df, 10).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g.vec_id, g.score))
    assert sorted(got) == list(range(0, 300, 10))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((round(float(d[j]), 9), j) for j in range(300) if j != q)[:10]
        assert [(round(s, 9), j) for j, s in found] == want
    assert ann.nearest(df.limit(0), df, 10).count() == 0
    few = df.where("vec_id IN (0, 1)")
    assert [(g.query_id, g.vec_id) for g in ann.nearest(few.where("vec_id = 0"), few, 10).collect()] == [(0, 1)]


def test_one_id_with_several_texts(spark):
    text = "some words that stand in this order and no other one at all"
    rows = [(1, text), (2, text + " " * 3), (2, "a text that is less"), (3, "a text that is less"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, None)}


def test_crowded_buckets_and_centres(spark, monkeypatch):
    """Every way of joining large buckets and centres gives the classes of brute force."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base.replace(f"w{i % 50} ", f"x{i} ")) for i in range(80)] + [(100 + i, f"other text {i} with words of its own {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = classes(rows, 3, 85)
    for summaries, crowd in ((200_000, 5), (0, 5), (0, 10**9)):
        monkeypatch.setattr(near_dedup, "MOST_SUMMARIES", summaries)
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()} == want


def test_what_is_broadcast_does_not_grow_with_the_input(spark, monkeypatch):
    """Ids and bucket summaries beyond some 2 MB stay away from the driver, and the joins give the same rows."""
    sent, broadcast = [], near_dedup.F.broadcast
    monkeypatch.setattr(near_dedup.F, "broadcast", lambda df: sent.append(len(df.columns) * df.count()) or broadcast(df))
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(-30, 60)] + [(10**12, "x"), (None, "x")], "doc_id long, text string")
    many = spark.range(0, 240_000, 2).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.shingles for r in near_dedup.sets_of(docs, many, 3).collect()}
    assert got == {i: near_dedup.shingle_set(f"text {i % 7}", 3).view("i8").tolist() for i in range(0, 60, 2)}
    assert sent and max(sent) <= 2 * 50_000
    likely = {r.doc_id for r in near_dedup.likely_wanted(docs.where("doc_id is not null"), many).collect()}
    assert likely >= set(range(0, 60, 2)) and len(likely) < 60
    summary = spark.range(60_000).selectExpr("id AS bucket", "id + 1 AS first", "CASE WHEN id = 3 THEN 900 ELSE 1 END AS size")
    rows = spark.range(1_800).selectExpr("id AS doc_id", "CASE WHEN id < 900 THEN 3 ELSE id * 50 END AS bucket")
    want = {(i, 3 if i < 900 else i * 50) for i in range(1_800) if i < 900 or i * 50 < 60_000}
    for how in ("inner", "left_semi"):
        joined = near_dedup.by_bucket(rows, summary, how)
        assert joined.columns == ["bucket", "doc_id", "first"][: 3 if how == "inner" else 2]
        found = joined.collect()
        assert {(r.doc_id, r.bucket) for r in found} == want and len(found) == len(want)
        assert how != "inner" or all(r.first == r.bucket + 1 for r in found)
    assert max(sent) <= 2 * 50_000
    wide = near_dedup.by_bucket(rows, summary.limit(20_000), width=near_dedup.HUBS_WIDTH)
    assert wide.count() > 0 and max(sent) <= 2 * 50_000


def test_plans_name_a_step_once(spark, monkeypatch):
    """What is named several times is stored first: the driver's heap grows with its largest plans."""
    plans, written = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "CROWD", 5)
    monkeypatch.setattr(near_dedup, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString().count("Join")}) or written(df, name))
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('the same words stand here again and again ', id % 3) AS text")
    pairs = spark.range(1, 40).selectExpr("0L AS a", "id AS b")
    for k in range(12):
        pairs = pairs.join(spark.range(100 + k).withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    sketches = near_dedup.signatures(docs, 3).select("doc_id", "n_shingles", "sketch")
    found = near_dedup.confirmed_of(docs, pairs, written(sketches, "sketches"), 3, 70, "x").collect()
    assert {(r.a, r.b) for r in found} == {(0, i) for i in range(1, 40)}
    assert plans["x_likely"] <= 8 and plans["x_links"] <= 8, plans


def test_a_very_long_item(spark):
    """Rows of a window's surroundings are as long as two windows, however long the item."""
    words = [f"w{i}" for i in range(20_000)]
    items = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    docs = [(1, "before " + " ".join(words[7_000:7_040]) + " after"), (2, " ".join(words[-9:])), (3, " ".join(words[-10:])), (4, "w1 " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(df, items).collect()}
    assert got == {1: (40, 1), 2: (0, 0), 3: (10, 1), 4: (0, 0)}


def test_repeated_ids_count_once_whatever_their_lengths(spark):
    """Of rows that repeat an id the smallest vector counts, before anything is dealt by length."""
    rows = [(100, [0.0, 1.0]), (1, [0.5, 0.5, 0.5]), (1, [0.25, 0.5]), (2, [0.0, 2.0]), (200, [1.0, 1.0, 1.0]), (3, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df.where("vec_id % 100 = 0"), df, 10).collect()}
    assert got == {(100, 1), (100, 2), (200, 3)}


def test_vectors_of_any_magnitude(spark):
    """Squares that would overflow or vanish lose no neighbour."""
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * s).tolist()) for i, s in enumerate([1e160, 1e-170, 1.0, 1e300, 1e-5] * 8)]
    rows = [(i * 50, v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id) for x in ann.nearest(df.where("vec_id % 100 = 0"), df, 5).collect())
    want = []
    for i, q in rows:
        if i % 100 == 0:
            far = sorted((math.dist(q, v), j) for j, v in rows if j != i)
            want += [(i, k + 1, j) for k, (_, j) in enumerate(far[:5])]
    assert got == sorted(want)


def test_pipeline_settings_lose_no_link(spark):
    """Five words and 0.8, as the pipeline has them, against exact similarities over the whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, width=5, percent=80).collect()}
    rows = [tuple(x) for x in docs.collect()]
    sets = {i: shingles(t, 5) for i, t in rows}
    holders, common = {}, {}
    for i, s in sets.items():
        for x in s:
            for j in holders.setdefault(x, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[x].append(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = [p for p, n in common.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    assert len(links) > 50
    assert got == {i: find(i) for i in sets}
