"""Each pipeline stage on odd rows, against brute force, and on empty tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import all_pairs_lines, brute_components, brute_hits, split

import corpus_pipeline
from textloom.llm import quality, registry

INNER = {"id": "x", "cell": 1, "sig": "s", "_quality": 0.1, "_gone": "g", "_words": 2, "_spans": "p", "_items": 3, "score": 0.7, "removed": 4, "component_id": 5}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark beside the documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    good = [" ".join(f"word{(i * j) % 97} and" for j in range(1, 40)) for i in range(1, 30)]
    bad = [f"## $$ {i} zz zz zz || zz " * 6 for i in range(30)]
    learned = [(1000 + i, t) for i, t in enumerate(good + bad)]
    spark.createDataFrame([(1000 + i, int(i < len(good)), 0) for i in range(len(learned))] + [(None, 1, 0), (1003, 1, 1), (1, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(f"alpha{i}" for i in range(20, 45))), (2, "one two"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, learned


@pytest.fixture
def docs(spark, odd, folder):
    """Odd rows, learned ones, near copies, lines in common, all with clashing columns."""
    rng = random.Random(2)
    base = [f"n{rng.randrange(900)}" for _ in range(60)]
    near = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in (3, 30, 31, 59)]
    shared = "\n".join(" ".join(f"s{j}w{i}" for i in range(12)) for j in range(4))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + folder[1] + list(enumerate(near, 300))
    rows += [(400, f"own one\n{shared}"), (401, f"{shared}\nown two"), (402, shared), (402, "another text of the same id")]
    table = spark.createDataFrame([(i, t, rng.choice(["en", None]), None, None if t is None else len(t)) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    return table.withColumns({k: F.lit(v) for k, v in INNER.items()})


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def check_shape(before, after):
    assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
    for name, value in INNER.items():
        assert after.where(F.col(name) == value).count() == after.count()


def test_quality_stage(spark, docs, folder):
    out = corpus_pipeline.good_quality(spark, docs, folder[0])
    check_shape(docs, out)
    model = quality.learn(docs, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    scored = quality.score(docs.select("doc_id", "text"), model, out="s").where("s >= 0.5")
    assert pairs(out) == pairs(scored) and 0 < out.count() < docs.count()
    kept = {r["doc_id"] for r in out.collect()}
    assert len(kept & set(range(1000, 1029))) >= 27 and len(kept & set(range(1029, 1059))) <= 3


def test_line_stage(spark, docs, folder):
    out = corpus_pipeline.without_shared_lines(spark, docs, folder[0])
    check_shape(docs, out)
    want = [(i, t) for i, t, gone in all_pairs_lines([(r["doc_id"], r["text"]) for r in docs.collect()]) if not gone or split(t)]
    assert pairs(out) == sorted(want, key=repr) and len(want) < docs.count()
    sizes = {(r["doc_id"], r["text"]): r["n_chars"] for r in out.collect()}
    assert all(n == (None if t is None else len(t)) for (_, t), n in sizes.items())


def test_group_stage(spark, docs, folder):
    out = corpus_pipeline.one_of_each_group(spark, docs, folder[0])
    check_shape(docs, out)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    later = {i for i, _, c in brute_components(rows) if i is not None and c != i}
    assert later and pairs(out) == sorted(((i, t) for i, t in rows if i not in later), key=repr)


def test_benchmark_stage(spark, docs, folder):
    out = corpus_pipeline.without_benchmark(spark, docs, folder[0])
    check_shape(docs, out)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = []
    for i, t in rows:
        n, hit, _ = brute_hits(t, items)
        if not (hit > 0 and 20 * hit >= n):
            clean.append((i, t))
    assert len(clean) < len(rows) and pairs(out) == sorted(clean, key=repr)


def test_packing_stage(spark, docs, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json"))
    out = corpus_pipeline.packed(spark, docs, folder[0]).collect()
    want = sorted(((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0), key=repr) == want
    assert sum(r["length"] for r in out) == sum(n for _, n in want)


def test_stages_of_empty_tables(spark, docs, folder):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder[0])
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
