import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postcheck.llm import components, minhash, topk, vector_dedup


def _roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 300)] + [(5, 5), (9, 8), (8, 9), (None, 3)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _roots({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_by_new_edges(spark):
    """Equal to all edges at once; edges inside known components cost no further round."""
    draw = random.Random(8)
    edges = [(draw.randrange(90), draw.randrange(90)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    read = lambda df: {r["id"]: r["component"] for r in df.collect()}
    first = components.connected_components(frame(edges[:30]))
    second = components.connected_components(frame(edges[30:] + [(1, None), (5, 5)]), known=first)
    assert read(second) == read(components.connected_components(frame(edges)))
    assert components.connected_components(frame(edges), known=second) is second


def test_components_take_few_tasks(spark):
    """With many partitions a round's tasks, most of them empty, outweigh its rows."""
    chain, before = spark.createDataFrame([(n, n + 1) for n in range(64)], "a long, b long"), spark.conf.get("spark.sql.shuffle.partitions")
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert components.connected_components(chain).where("component <> 0").isEmpty()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    done = [x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x]
    assert sum(done) < 1500


def _sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _documents(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    docs, hot = [], [word() for _ in range(60)]
    for base in range(12):
        text = [word() for _ in range(draw.randint(20, 80))]
        for _ in range(draw.randint(1, 25)):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(hot + [word() for _ in range(draw.randint(5, 40))]) for _ in range(60)]
    docs += ["one two", "ONE\ttwo", "one two three", None, "", " \n", "É a b c d", "é a b c d", "word " * 20000, "word " * 19000]
    rows = list(enumerate(docs, 10))
    draw.shuffle(rows)
    return rows


def _check_documents(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    sets = {i: _sets(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _roots(ids, pairs)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_equal_brute_force(spark):
    _check_documents(spark, _documents(1))


def test_dense_regions_go_deeper_and_split(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 12)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    _check_documents(spark, _documents(2))


@pytest.mark.parametrize("block", [5, 64])
def test_cuts_of_dense_regions_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "REGION", 12)
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(200)], []
    rows.append((0, " ".join(base)))
    for i in range(1, 151):  # copies right at the threshold to the original, far from each other
        copy = list(base)
        for at in draw.sample(range(5, 195), 5):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    _check_documents(spark, rows + [(i + 1000, t) for i, t in _documents(2)[:80]])


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert sorted(r["doc_id"] or -1 for r in minhash.keep_one(df).collect()) == [-1, -1, 2]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def _vectors(seed, n=400, d=24):
    draw = np.random.default_rng(seed)
    rows = [draw.normal(size=d) for _ in range(n)]
    for _ in range(15):
        base = draw.normal(size=d)
        rows += [base + draw.normal(size=d) * draw.uniform(0.02, 0.35) for _ in range(int(draw.integers(2, 30)))]
    rows += [rows[0]] * 40 + [rows[1] * 3]
    return [[float(np.float32(x)) for x in v] for v in rows]


def _check_vectors(spark, vectors):
    rows = list(enumerate(vectors))
    out = vector_dedup.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, links int")).collect()
    m = np.array(vectors)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    want = _roots(range(len(rows)), zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))))
    total = int(linked.sum())
    assert sum(r["n_links"] for r in out) >= 0.999 * total
    assert sum(r["n_links"] == linked[r["vec_id"]].sum() for r in out) >= 0.99 * len(out)
    assert sum(r["component_id"] == want[r["vec_id"]] for r in out) >= 0.99 * len(out)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_near_vectors_equal_brute_force(spark):
    _check_vectors(spark, _vectors(1))


def test_near_vectors_in_many_regions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "REGION", 32)
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    _check_vectors(spark, _vectors(2))


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [1e38, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(-1, 0, -1, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 3, 1, False)]
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_plan_reaches_its_recall():
    for n in (10, 10_000, 10**9):
        bits, repeats = vector_dedup.plan(n, 0.95)
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - same) ** repeats >= vector_dedup.RECALL - 1e-9


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=8) * 0.3]) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 360)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (500, [0.0] * 8), (None, [1.0] * 8), (20, rows[20][1]), *[(301, rows[20][1])] * 3, (303, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    asked = {i: v for i, v in whole if i % 20 == 0}
    assert set(got) == set(asked)
    for q, found in got.items():
        want = sorted((-int(asked[q] @ v), i) for i, v in whole if i != q)[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 512 * 1024), (2, 2, -1024 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_threshold_search_stops_early():
    draw = np.random.default_rng(0)
    block = np.floor(draw.normal(size=(5000, 3)) * 1000)
    block[7] = [9000, 9000, 9000]
    lists = np.argsort(block, axis=0, kind="stable")
    query, ids = np.array([5.0, 4.0, 3.0]), np.arange(5000)
    rows, _, scored = topk.threshold_search(query, ids, block, lists, -1, 1)
    assert rows.tolist() == [7] and scored < 500
    # A floor above the first frontiers leaves the block unread, one that only the best reaches ends it early.
    assert topk.threshold_search(query, ids, block, lists, -1, 1, 200_000.0)[2] == 0
    rows, _, scored = topk.threshold_search(query, ids, block, lists, -1, 10, 50_000.0)
    assert rows[0] == 7 and scored < 500


def test_scores_beyond_doubles_stay_exact(spark):
    big = float(2**28)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 2.0]), (3, [big - 1, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, k=3, scale=1).orderBy("rank").collect()]
    assert got == [(1, 2**56 + 3), (2, 2**56 + 2), (3, 2**56 - 2**28)]
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(df, F.col("vec_id") == 0, k=3, scale=1024).collect()


def test_windows_on_sorted_lists_equal_distances():
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(40, 5)).astype(np.float32), draw.normal(size=(70, 5)).astype(np.float32)
    half = np.float32(0.4)
    want = ((b[None] >= (a - half)[:, None]) & (b[None] <= (a + half)[:, None])).sum(axis=2)
    assert np.array_equal(vector_dedup._collisions(a, b, half), want)


def test_variants_of_one_original_join_at_its_centre(spark, monkeypatch):
    """Hundreds of texts that link with one original only: the centre rounds join them, so no region is left for the second round."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    docs = [(5000, " ".join(base)), (5001, " ".join(word() for _ in range(40)))]
    for i in range(400):
        words = list(base)
        for place in draw.sample(range(40), 5):
            words[5 * place] = word()
        docs.append((i, " ".join(words)))
    seen = []
    monkeypatch.setattr(minhash, "CENTRE_LEAST", 3)
    adapted = minhash.adapted
    monkeypatch.setattr(minhash, "adapted", lambda placed, classes: seen.append(minhash._mixed_regions(placed).count()) or adapted(placed, classes))
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: 5001 if i == 5001 else 0 for i, _ in docs}
    assert seen == [0]
