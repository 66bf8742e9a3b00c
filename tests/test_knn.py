import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators.knn import KnnSizes, knn_topk

SPLIT = KnnSizes(broadcast_bytes=0, block_rows=30, pack_rows=25)
PATHS = {
    "scan": KnnSizes(),
    "cells": SPLIT,
    "one pack": KnnSizes(broadcast_bytes=0, block_rows=40),
    "no cells": KnnSizes(broadcast_bytes=0, block_rows=30, pack_rows=25, max_cells=0),
    "few cells": KnnSizes(broadcast_bytes=0, block_rows=20, max_pivots=3),
}


def brute(queries, corpus, k, exclude_self=False):
    """(qid, group) -> [(rank, id, score)] by sorting every pair."""

    def unit(v):
        v = np.asarray(v, dtype=np.float32).astype(float)
        n = np.linalg.norm(v)
        return v / n if n else v

    out = []
    for qid, qg, qv in queries:
        scored = [
            (-(round(float(unit(qv) @ unit(cv)), 9) + 0.0), cid)
            for cid, cg, cv in corpus
            if cg == qg and not (exclude_self and cid == qid)
        ]
        out += [(qid, qg, r + 1, cid, round(-s, 6) + 0.0) for r, (s, cid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, queries, corpus, k, sizes, exclude_self=False, kind="bigint"):
    schema = f"id {kind}, grp string, embedding array<float>"
    q = spark.createDataFrame(queries, schema).withColumnRenamed("id", "query_id").repartition(3)
    c = spark.createDataFrame(corpus, schema).withColumnRenamed("id", "faq_id").repartition(4)
    rows = knn_topk(q, c, k, within="grp", exclude_self=exclude_self, sizes=sizes).collect()
    return sorted((r["query_id"], r["grp"], r["rank"], r["faq_id"], round(r["score"], 6) + 0.0) for r in rows)


def clustered(n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 3
    return [
        (i, "big" if i % 3 else f"g{i % 5}", (centres[i % 6] + rng.normal(size=dim) * 0.2).tolist()) for i in range(n)
    ]


@pytest.mark.parametrize("path", sorted(PATHS))
def test_all_paths_equal_brute_force(spark, path):
    rows = clustered(160)
    assert run(spark, rows, rows, 4, PATHS[path], True) == brute(rows, rows, 4, True)


@pytest.mark.parametrize("path", sorted(PATHS))
def test_ties_zero_vectors_and_short_groups(spark, path):
    corpus = [(i, "a", [1.0, 0.0]) for i in range(70)] + [(i, "a", [0.0, 0.0]) for i in range(70, 75)]
    corpus += [(i, "b", [0.0, 1.0]) for i in range(75, 78)]
    queries = [(1, "a", [2.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", [1.0, 1.0]), (4, "none", [1.0, 0.0]), (5, "a", [-1.0, 0.0])]
    assert run(spark, queries, corpus, 6, PATHS[path]) == brute(queries, corpus, 6)


@pytest.mark.parametrize("path", ["scan", "cells"])
def test_many_results_and_text_ids(spark, path):
    rows = [(f"id{i:03d}é", g, v) for i, g, v in clustered(90)]
    assert run(spark, rows, rows, 25, PATHS[path], kind="string") == brute(rows, rows, 25)


def test_top_k_is_a_prefix(spark):
    rows = clustered(60)
    small, large = run(spark, rows, rows, 3, SPLIT), run(spark, rows, rows, 4, SPLIT)
    assert small == [r for r in large if r[2] <= 3]


def test_pruning_skips_far_cells(spark):
    """With tight clusters the questions visit few of the cells."""
    rng = np.random.default_rng(0)
    axes = np.eye(16)
    rows = [(i, "", (axes[i % 16] + rng.normal(size=16) * 0.01).tolist()) for i in range(320)]
    assert run(spark, rows, rows, 3, SPLIT) == brute(rows, rows, 3)


def test_refuses_mixed_dimensions_and_bad_k(spark):
    with pytest.raises(Exception, match="vectors differ"):
        run(spark, [(1, "a", [1.0, 0.0])], [(1, "a", [1.0, 0.0]), (2, "a", [1.0])] * 4, 1, KnnSizes())
    with pytest.raises(ValueError):
        run(spark, [(1, "a", [1.0])], [(1, "a", [1.0])], 0, KnnSizes())


def test_empty_sides(spark):
    one = [(1, "a", [1.0, 0.0])]
    for sizes in PATHS.values():
        assert run(spark, [], one, 2, sizes) == []
        assert run(spark, one, [], 2, sizes) == []


def watched_products(monkeypatch, *modules):
    """Rows on either side of the tiles of each search that runs after this."""
    from textloom.operators import knn

    seen, plain = [], knn.products

    def watched(routed, tiled, *args, **kwargs):
        seen.append((routed.count(), tiled.count()))
        return plain(routed, tiled, *args, **kwargs)

    for module in (knn, *modules):
        monkeypatch.setattr(module, "products", watched)
    return seen


@pytest.mark.parametrize("method, cells", [("cells", 100_000), ("cells", 0), ("scan", 100_000)])
def test_small_blocks_do_not_multiply_what_is_shuffled(spark, monkeypatch, method, cells):
    """Rows go once to each tile or pack of the other side; their number follows from bytes and slots, not from block_rows."""
    seen = watched_products(monkeypatch)
    rows = clustered(600)
    q = spark.createDataFrame(rows, "id bigint, grp string, embedding array<float>").withColumnRenamed("id", "query_id")
    c = q.withColumnRenamed("query_id", "faq_id")
    sizes = KnnSizes(broadcast_bytes=0, block_rows=4, pack_rows=4, max_cells=cells)
    got = knn_topk(q, c, 3, within="grp", exclude_self=True, sizes=sizes, method=method).collect()
    assert sorted((r["query_id"], r["grp"], r["rank"], r["faq_id"], round(r["score"], 6) + 0.0) for r in got) == brute(rows, rows, 3, True)
    assert len(seen) == 1 and max(seen[0]) <= 600 * 8


def test_tiles_follow_from_bytes_and_grow_with_the_pairs():
    """Three million rows on twelve slots go to few tiles; a row is sent once to each of them."""
    from textloom.operators.knn import tile_rows

    rows, packs = tile_rows(9e12, 64, KnnSizes(), 12)
    assert -(-3_000_000 // rows) <= 8 and -(-3_000_000 // packs) <= 8
    assert rows * 64 * 4 <= KnnSizes().tile_bytes


@pytest.mark.parametrize("kind", ["main axes", "none", "both"])
def test_large_tiles_look_at_few_pairs(monkeypatch, kind):
    """Parts and pairs that bounds rule out are not scored; copies, zero vectors and own rows are as in brute force."""
    from textloom.operators import knn

    rng = np.random.default_rng(8)
    flat = rng.normal(size=(5000, 6)) @ rng.normal(size=(6, 64)) + rng.normal(size=(5000, 64)) * 0.02 + 4.0
    m = {"main axes": flat, "none": rng.normal(size=(5000, 64)), "both": np.where(np.arange(5000)[:, None] % 4, flat, rng.normal(size=(5000, 64)))}[kind]
    m[100:140], m[200:220], m[300:310] = m[100], 0.0, m[300:301] * np.linspace(0.5, 2, 10)[:, None]
    m = m.astype(np.float32)
    length, place, k = np.linalg.norm(m.astype(float), axis=1), rng.permutation(5000), 4
    own = np.where(np.arange(5000) % 3, np.arange(5000), -1)
    looked, plain = [], np.matmul
    monkeypatch.setattr(knn.np, "matmul", lambda a, b, **how: looked.append(a.size * b.shape[1]) or plain(a, b, **how))
    places, scores = knn._tile_best(m, length, m, length, place, own, k)
    monkeypatch.undo()
    unit = np.divide(m.astype(float), length[:, None], out=np.zeros((5000, 64)), where=length[:, None] > 0)
    for i in [*range(0, 5000, 37), 100, 120, 200, 219, 300, 305]:
        s = np.round(unit @ unit[i], 9) + 0.0
        if own[i] >= 0:
            s[own[i]] = -9.0
        best = np.lexsort((place, -s))[:k]
        assert list(places[i]) == list(place[best]) and np.allclose(scores[i], s[best], atol=2e-9)
    assert sum(looked) < 5000 * 5000 * 64 * {"main axes": 0.5, "none": 1.3, "both": 0.8}[kind]


def test_many_copies_and_zero_vectors_in_tiles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "a", [1.0, 2.0, 3.0]) for i in range(80)] + [(i, "a", [0.0] * 3) for i in range(80, 95)]
    rows += [(i, "a", rng.normal(size=3).tolist()) for i in range(95, 140)]
    for sizes in (SPLIT, KnnSizes(broadcast_bytes=0, block_rows=9, pack_rows=7, max_cells=0)):
        assert run(spark, rows, rows, 4, sizes, True) == brute(rows, rows, 4, True)


def test_vectors_helpers(spark):
    from textloom.functions.vectors import cosine, l2_normalize

    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(l2_normalize(F.col("a")).alias("u"), cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(x, 6) for x in rows[0]["u"]] == [0.6, 0.8] and rows[1]["u"] == [0.0, 0.0]
    assert [round(r["c"], 9) for r in rows] == [0.96, 0.0]


def test_best_rows_are_merged_as_a_tree(spark):
    """Of many tasks a question's rows meet in groups first: at most nodes x k of them go to the last step."""
    from textloom.operators import knn

    rows = clustered(400)
    q = spark.createDataFrame(rows, "id bigint, grp string, embedding array<float>").withColumnRenamed("id", "query_id")
    c = q.withColumnRenamed("query_id", "faq_id").repartition(40)
    seen = []
    plain = knn.merge_best

    def watched(found, k, out, packs, nodes):
        seen.append((found.count(), found.groupBy("qid").agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0], nodes))
        return plain(found, k, out, packs, nodes)

    knn.merge_best = watched
    try:
        got = knn_topk(q, c, 3, within="grp", sizes=KnnSizes(merge_nodes=4), method="scan").collect()
    finally:
        knn.merge_best = plain
    assert seen[0][0] > 400 * 3 * 4 and seen[0][1] <= 4
    assert sorted((r["query_id"], r["grp"], r["rank"], r["faq_id"], round(r["score"], 6) + 0.0) for r in got) == brute(rows, rows, 3)


def test_bands(spark):
    """Approximate search: exact scores, recall as promised, blocks and packs of hot bands, groups."""
    from textloom.operators.knn_approx import Bands, knn_approx, recall

    assert Bands.reaching(0.9, 0.9, 8).count < Bands.reaching(0.9, 0.5, 8).count < Bands.reaching(0.99, 0.5, 8).count
    with pytest.raises(ValueError):
        Bands.reaching(1.0, 0.5, 8)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    rows = clustered(300) + [(1000 + i, "big", (hot + rng.normal(size=8) * 0.01).tolist()) for i in range(150)]
    q = spark.createDataFrame(rows, "id bigint, grp string, embedding array<float>").withColumnRenamed("id", "query_id")
    c = q.withColumnRenamed("query_id", "faq_id")
    bands = Bands.reaching(0.97, 0.8, 6)
    found = knn_approx(q, c, 4, bands, within="grp", exclude_self=True, sizes=KnnSizes(block_rows=20, pack_rows=30, merge_nodes=3))
    exact = knn_topk(q, c, 4, within="grp", exclude_self=True, method="scan")
    share = recall(found, exact).first()
    assert share["wanted"] == exact.count() and share["recall"] >= 0.95
    whole = {(r["query_id"], r["faq_id"]): round(r["score"], 9) for r in knn_topk(q, c, 450, within="grp", exclude_self=True).collect()}
    got = found.collect()
    assert all(whole[r["query_id"], r["faq_id"]] == round(r["score"], 9) for r in got) and len({(r["query_id"], r["rank"]) for r in got}) == len(got)
    assert knn_approx(q.limit(0), c, 4, bands).count() == knn_approx(q, c.limit(0), 4, bands).count() == 0


@pytest.mark.parametrize("path", ["scan", "cells"])
def test_vectors_that_are_not_finite_take_no_place(spark, path):
    good = [(i, "a", [1.0, float(i)]) for i in range(60)]
    bad = [(100, "a", [float("inf"), 1.0]), (101, "a", [float("nan"), 1.0]), (102, "a", [None, 1.0]), (103, "a", [-float("inf"), 0.0])]
    assert run(spark, good + bad, good + bad, 5, PATHS[path], True) == brute(good, good, 5, True)


# TF-IDF ------------------------------------------------------------------------------
def brute_tfidf(questions, docs, k):
    import math
    import re
    from collections import Counter

    cut = lambda t: Counter(re.findall(r"[^\W_]+", (t or "").lower()))
    weigh = lambda c: {t: 1 + math.log(n) for t, n in c.items()}
    length = lambda w: math.sqrt(sum(x * x for x in w.values())) or 1.0
    held = [(i, weigh(cut(t))) for i, t in docs]
    df = Counter(t for _, w in held for t in w)
    out = []
    for q, text in questions:
        asked = {t: w * math.log((len(docs) + 1) / (df[t] + 1)) for t, w in weigh(cut(text)).items()}
        scale = length(asked)
        scores = []
        for i, w in held:
            s = sum(a / scale * w[t] / length(w) for t, a in asked.items() if t in w and a > 0)
            if any(t in w and a > 0 for t, a in asked.items()):
                scores.append((-round(s, 9), i))
        out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("lead", [1, 3, 50])
def test_tfidf_equals_brute_force(spark, lead):
    """Frequent and rare words, ties, texts without words; bounds that cut early and late."""
    import random

    from textloom.operators.tfidf import tfidf_topk

    rng = random.Random(lead)
    words = ["the"] * 60 + ["of"] * 30 + [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(300)] + ["Éa", "x-y", "12"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 50)))) for i in range(150)] + [(200, None), (201, ""), (202, "—!"), (203, "the the")]
    docs += [(300 + i, docs[5][1]) for i in range(4)]
    questions = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(40)] + [(90, None), (91, "nowhere"), (92, docs[5][1])]
    q = spark.createDataFrame(questions, "question_id bigint, question string")
    d = spark.createDataFrame(docs, "faq_id bigint, source_text string").repartition(3)
    got = tfidf_topk(q, d, 4, lead_terms=lead).collect()
    assert sorted((r["question_id"], r["rank"], r["faq_id"], round(r["score"], 6)) for r in got) == brute_tfidf(questions, docs, 4)
    assert tfidf_topk(q.limit(0), d, 4).count() == tfidf_topk(q, d.limit(0), 4).count() == 0


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_tfidf_with_and_without_the_matrix(spark, monkeypatch, limit):
    """Few questions are answered in a scan, without the lists of terms; both ways give the same rows."""
    import random

    from textloom.operators import tfidf

    seen, plain = [], tfidf.written
    monkeypatch.setattr(tfidf, "written", lambda df, name: seen.append(name) or plain(df, name))
    rng = random.Random(1)
    words = ["the"] * 40 + [f"w{i % 90}" for i in range(200)]
    docs = [(f"d{i:03d}é", " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(700)]
    docs += [("x", docs[3][1]), ("y", None), ("z", "")]
    questions = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(30)] + [(90, None), (91, "nowhere")]
    q = spark.createDataFrame(questions, "question_id bigint, question string")
    d = spark.createDataFrame(docs, "faq_id string, source_text string").repartition(3)
    got = tfidf.tfidf_topk(q, d, 4, matrix_bytes=limit).collect()
    assert sorted((r["question_id"], r["rank"], r["faq_id"], round(r["score"], 6)) for r in got) == brute_tfidf(questions, docs, 4)
    assert ("tfidf-lists" in seen) == (limit == 0)
