"""Operators 11 to 13 against brute force, on tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import audit, crosspolytope, merkle, registry

SF = "/root/testdata/sf0.01"


# 11 filter audit

def brute_audit(docs, labels):
    marked = []
    for key, lang, text in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, _, t in docs),
        }
        own = [(q, x) for k, q, x in labels if k == key and k is not None]
        marked.append((lang or "", {f for f, bad in fails.items() if bad}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part in {m[0] for m in marked}:
        rows = [m[1:] for m in marked if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return sorted((*key, *counts) for key, counts in out.items())


COUNTS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark, odd):
    rng = random.Random(4)
    texts = ["WORD " * 120, " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(120)) + " 5%", "#", "", None, "x\x0by z"]
    texts += [r["text"] for r in odd.collect()]
    docs = [(rng.choice([None, *range(25)]), rng.choice(["en", "fr", None, ""]), rng.choice(texts)) for _ in range(90)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    df = spark.createDataFrame([(*d, 1, "h", "id") for d in docs], "doc_id long, lang string, text string, failed int, h string, id string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = audit.audit(df.repartition(5), marks)
    assert sorted(tuple(r[c] for c in COUNTS) for r in out.collect()) == brute_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0
    assert audit.audit(df, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_equal_hashes_are_not_equal_texts(spark, monkeypatch):
    """With a hash that is the same for all texts the exact text decides."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "en", "a"), (2, "en", "b"), (3, "fr", "a"), (4, "en", "b")], "doc_id long, lang string, text string")
    got = {r["id"] for r in audit.failures(df).where("failed >= 16").collect()}
    assert got == {3, 4}


# 12 Merkle manifest

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """Root, and for each leaf its siblings with the side they stand on."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(spots):
            other = at ^ 1
            paths[i].append((None, "") if other == len(level) else (other < at, level[other]))
        spots = [at // 2 for at in spots]
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_proofs(rows):
    """(key, leaf, subroot, root, siblings) of rows (doc_id, source, lang, n_chars, text)."""
    low = lambda x: (x is not None, x.encode() if isinstance(x, str) else x)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((low(r[0]), brute_leaf(r), r))
    names, trees = sorted(groups, key=low), {}
    for g in names:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = brute_tree([x[1] for x in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in names])
    return sorted(
        (repr(row[0]), leaf, trees[g][0], root, "".join(s for _, s in [*path, *top]))
        for g, top in zip(names, tops) for (_, leaf, row), path in zip(groups[g], trees[g][1])
    )


def merkle_rows(spark, rows, every):
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, path binary")
    leaves = df.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), merkle.leaf(*[F.col(c) for c in df.columns[:5]]).alias("digest"), F.lit(1).alias("more"))
    out = merkle.proofs(merkle.manifest(leaves.repartition(5), every)).collect()
    assert all(merkle.fold(r["digest"], r["path"]) == r["root"] and r["more"] == 1 for r in out)
    return sorted((repr(r["key"]), r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), "".join(s.hex() for s in merkle.siblings(r["path"]))) for r in out)


@pytest.mark.parametrize("every", [1, 2, 10])
def test_merkle(spark, every, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    rng = random.Random(every)
    rows = [(rng.choice([None, *range(-5, 300)]), rng.choice(["s", None, ""]), lang, rng.choice([None, 3]), rng.choice(["é", None, "", "x" * 90_000]))
            for lang, n in (("en", 67), (None, 9), ("é", 1), ("", 16), ("z", 2)) for _ in range(n)]
    rows += rows[:6]
    assert merkle_rows(spark, rows, every) == brute_proofs(rows)


def test_merkle_of_little(spark):
    one = [(7, "s", "en", 3, "abc")]
    assert merkle_rows(spark, one, 3) == brute_proofs(one)
    df = spark.createDataFrame([], "key long, grp string, digest binary")
    assert merkle.proofs(merkle.manifest(df)).count() == 0


def test_tampering_is_seen(spark):
    out = registry.op12_merkle(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {(int(k), leaf, sub, root, sha(path)) for k, leaf, sub, root, path in brute_proofs([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs])}
    got = out.collect()
    assert {(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got} == want
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root) for r in got)


# 13 nearest neighbours

def brute_nearest(rows, step, k):
    """{query: [(score, id), ...]} of the k nearest, ids with several vectors taken by the least one."""
    able = {}
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            able[i] = min(able.get(i, v), v)
    out = {}
    for q in able:
        if q % step == 0:
            a = np.array(able[q])
            scores = []
            for i, v in able.items():
                if i != q:
                    b = np.array(v)
                    scores.append((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i))
            out[q] = [(-s, i) for s, i in sorted(scores)[:k]]
    return out


def found_rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r["query_id"], [])
        got.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got)
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, bucket string, id int")


def test_search_that_probes_all_is_exact(spark):
    """Odd vectors, equal ones, one direction that holds a third; small blocks and packs."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(120)]
    hot = rng.normal(size=12)
    rows += [(200 + i, hot.tolist()) for i in range(40)] + [(300 + i, (hot + rng.normal(size=12) * 1e-3).tolist()) for i in range(40)]
    rows += [(5, rows[7][1]), (6, rows[6][1]), (400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] + [1.0] * 11), (404, [None] + [1.0] * 11),
             (405, [float("inf")] + [1.0] * 11), (None, rows[1][1]), (-6, (2 * np.array(rows[9][1])).tolist())]
    ready = crosspolytope.valid_vectors(vectors(spark, rows).drop("id"), "vec_id", "embedding")
    index = crosspolytope.Index(12, tables=2, probes=32, block_rows=16, pack_rows=8)
    got = found_rows(crosspolytope.search(ready, F.col("id") % 3 == 0, index, 5))
    want = brute_nearest(rows, 3, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-15)


def test_fitted_search(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    for bucket_rows in (256, 2):  # one turn, and two
        got = found_rows(crosspolytope.nearest(vectors(spark, rows).drop("id"), F.col("id") % 20 == 0, bucket_rows=bucket_rows))
        want = brute_nearest(rows, 20, 5)
        hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_of_little(spark):
    few = vectors(spark, [(0, [1.0]), (50, [2.0]), (7, [-1.0])]).drop("id")
    assert found_rows(crosspolytope.nearest(few, F.col("id") % 50 == 0)) == {0: [(1.0, 50), (-1.0, 7)], 50: [(1.0, 0), (-1.0, 7)]}
    for empty in (few.limit(0), few.where("vec_id = 7"), few.where("vec_id = 0")):
        out = crosspolytope.nearest(empty, F.col("id") % 50 == 0)
        assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]
    mixed = vectors(spark, [(0, [1.0, 2.0]), (1, [1.0])]).drop("id")
    with pytest.raises(Exception, match="different lengths"):
        crosspolytope.nearest(mixed, F.col("id") % 50 == 0).collect()


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute_nearest(rows, 50, 5)
    got = found_rows(registry.op13_neighbours(spark, "/root/testdata/sf0.1"))
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_hadamard_keeps_lengths_and_buckets_are_first_probes():
    rng = np.random.default_rng(2)
    u = crosspolytope.unit(rng.normal(size=(50, 10)))
    index = crosspolytope.Index(10, tables=2, depth=2)
    assert np.allclose(np.linalg.norm(crosspolytope.turned(u, index.signs()[0, 0]), axis=1), 1)
    probes = crosspolytope.probed(u, index, 40)
    assert (probes[:, :, 0] == crosspolytope.buckets(u, index)).all()
    assert all(len(set(p)) == 40 for row in probes for p in row)
