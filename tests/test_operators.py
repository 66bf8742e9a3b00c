import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import sampling, sets
from textloom.operators.chunking import chunk_pages, clean_pages
from textloom.operators.matrix import class_matrix, distinct_class_ids, risk_matrix
from textloom.operators.model_map import (
    Caller, Replay, Rules, SliceError, distinct_prompts, model_map, pending_prompts, prompt_hash, store_responses,
)
from textloom.operators.numbering import number_rows


# Row numbers ------------------------------------------------------------------
def test_numbering_with_a_hot_key_and_gaps(spark):
    rng = random.Random(1)
    rows = [("hot", i * 3) for i in range(400)] + [(f"k{i % 20}", rng.randrange(10**6) * 50 + i) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint").repartition(5)
    got = {(r["k"], r["o"]): r["n"] for r in number_rows(df, ["k"], "o", "n", range_rows=37).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for i, o in enumerate(sorted(r[1] for r in rows if r[0] == k)):
            want[k, o] = i + 1
    assert got == want
    ids = spark.createDataFrame([(None, "b"), ("x", "b"), (None, "a"), ("x", None)], "k string, o string")
    assert sorted(map(tuple, number_rows(ids, ["k"], "o", "n", 1).collect()), key=repr) == sorted(
        [(None, "a", 1), (None, "b", 2), ("x", None, 1), ("x", "b", 2)], key=repr)
    assert number_rows(ids.limit(0), [], "o", "n").count() == 0


# Chunks -----------------------------------------------------------------------
def brute_chunks(pages, size, step, limit):
    """From word sums: page k of a window fits if the sum up to it keeps the limit or nothing with words is before it."""
    table = pd.DataFrame(pages, columns=["doc", "page", "text"]).sort_values(["doc", "page", "text"])
    rows = []
    for doc, own in table.groupby("doc"):
        words = own["text"].str.split().str.len().to_numpy()
        windows = [slice(i, i + size) for i in range(0, len(own), step)]
        sums = [np.cumsum(words[w]) for w in windows]
        fits = [np.logical_and.accumulate((s <= limit) | (s == words[w])) for s, w in zip(sums, windows)]
        parts = [own[w][f] for w, f in zip(windows, fits)]
        bodies = ["\n\n".join(x["text"]).strip() for x in parts]
        filled = [(x, t, s[f][-1]) for x, t, s, f in zip(parts, bodies, sums, fits) if t]
        rows += [
            (doc, k + 1, x["page"].min(), x["page"].max(), ",".join(x["page"].astype(str)), t, len(t), n)
            for k, (x, t, n) in enumerate(filled)
        ]
    return sorted(rows)


@pytest.mark.parametrize("size,step,limit", [(2, 1, 6), (2, 1, 1500), (3, 2, 9), (1, 1, 4)])
def test_chunks_equal_brute_force(spark, size, step, limit):
    rng = random.Random(size * 10 + step)
    pages = [("hot", i + 1, " ".join(["w"] * rng.choice([0, 0, 1, 3, 6, 20]))) for i in range(60)]
    pages += [(f"d{j}", 5 + i * 2, " ".join(["x"] * rng.randrange(7))) for j in range(6) for i in range(rng.randrange(1, 6))]
    pages += [("blank", i, "") for i in range(3)]
    df = spark.createDataFrame(pages, "doc_name string, page_number int, text string").repartition(4)
    got = chunk_pages(df, size, step, limit, range_rows=4).collect()
    assert sorted(map(tuple, got)) == brute_chunks(pages, size, step, limit)


def test_dense_pages_give_the_same_chunks(spark):
    pages = [(f"d{j}", i + 1, f"page {j} {i}") for j in range(4) for i in range(11)]
    df = spark.createDataFrame(pages, "doc_name string, page_number int, text string")
    want = sorted(map(tuple, chunk_pages(df, range_rows=3).collect()))
    assert sorted(map(tuple, chunk_pages(df, range_rows=3, dense=True).collect())) == want


def test_exact_limit_and_first_page_above_it(spark):
    pages = [("a", 1, "w " * 1000), ("a", 2, "w " * 500), ("b", 1, "w " * 1600), ("b", 2, "w")]
    df = clean_pages(spark.createDataFrame(pages, "doc_name string, page_number int, text string"))
    got = [(r["doc_name"], r["pages"], r["num_tokens"]) for r in chunk_pages(df).orderBy("doc_name", "chunk_id").collect()]
    assert got == [("a", "1,2", 1500), ("a", "2", 500), ("b", "1", 1600), ("b", "2", 1)]


# Samples, unions ----------------------------------------------------------------
def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    one = {r["id"] for r in sampling.sample_n(df.repartition(7), 10, "id").collect()}
    assert one == {r["id"] for r in sampling.sample_n(df.coalesce(1), 10, "id").collect()} and len(one) == 10
    assert one != {r["id"] for r in sampling.sample_n(df, 10, "id", seed=1).collect()}
    by = sampling.sample_n(df, 4, "id", by="g").groupBy("g").count().collect()
    assert {(r["g"], r["count"]) for r in by} == {(0, 4), (1, 4), (2, 4)}
    assert sampling.sample_n(df, 500, "id").count() == 200
    assert sampling.preview(df, 5, 1).count() == 5
    assert [r["id"] for r in sampling.first_n(df, 2, "id").collect()] == [0, 1]
    assert sampling.first_n(df, None, "id") is df


def test_first_rows_beyond_a_partition(spark, monkeypatch):
    """A sketch of few points, ties, nulls and a text key; as many rows as asked for, none gathered by a limit."""
    from textloom.operators import numbering

    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(40)]), f"t{rng.randrange(300):03d}") for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, k int, t string").repartition(9)
    for key, at in (("k", 1), ("t", 2)):
        for n in (0, 1, 300, 899, 900, 5000):
            for points in (10_000, 50):
                monkeypatch.setattr(sampling, "SKETCH", points)
                out = sampling.first_n(df, n, key)
                got = [r[at] for r in out.collect()]
                want = sorted((r[at] for r in rows), key=lambda x: (x is not None, x))[:n]
                assert sorted(got, key=lambda x: (x is not None, x)) == want
                assert "Limit" not in out._jdf.queryExecution().executedPlan().toString() or not n
    assert sampling.first_n(df.limit(0), 3, "k").count() == 0
    assert numbering.number_rows(df, [], "id", "n", 100).where("n = id + 1").count() == 900


def test_unions_and_counts(spark):
    a = spark.createDataFrame([("q1", "student")], "question string, persona string")
    b = spark.createDataFrame([("q2", "teacher", "math")], "question string, persona string, course string")
    merged = sets.merge_personas({"student": a, "none": None, "teacher": b})
    assert {(r["question"], r["course"]) for r in merged.collect()} == {("q1", None), ("q2", "math")}
    sources = sets.merge_sources({"art": a, "x": b, "gone": None})
    assert [tuple(r) for r in sets.counts_by(sources, "course").collect()] == [("art", 1), ("math", 1)]
    with pytest.raises(ValueError):
        sets.merge_personas({"a": None})
    new = spark.createDataFrame([("q1", "other"), ("q9", "other")], "question string, persona string")
    assert {tuple(r) for r in sets.add_unseen(a, new, "question").collect()} == {("q1", "student"), ("q9", "other")}


# Matrices -----------------------------------------------------------------------
def test_class_matrix(spark):
    kind = "doc_id string, relevant_classes array<struct<class_id:string,justification:string>>"
    df = spark.createDataFrame([("1", [("b", ""), ("a", "")]), ("2", []), ("3", None), ("4", [("b", "x")])], kind)
    assert distinct_class_ids(df) == ["a", "b"]
    assert [tuple(r) for r in class_matrix(df).orderBy("doc_id").collect()] == [
        ("1", 1, 1), ("2", 0, 0), ("3", 0, 0), ("4", 0, 1),
    ]
    assert class_matrix(df, ["z", "a"]).columns == ["doc_id", "a", "z"]
    with pytest.raises(ValueError):
        distinct_class_ids(df, 1)


def test_risk_matrix(spark):
    rows = [("safety", "high"), ("safety", "high"), ("health", "low"), ("health", "odd")]
    df = spark.createDataFrame(rows, "d string, l string").select(
        F.struct(F.struct(F.col("l").alias("level")).alias("severity"), F.struct(F.col("d").alias("domain")).alias("type")).alias(
            "issue_analysis"
        )
    )
    got = {tuple(r) for r in risk_matrix(df).collect()}
    assert got == {("safety", 0, 0, 2, 0, 0), ("health", 1, 0, 0, 0, 1)}


# Model boundary -----------------------------------------------------------------
def prompts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, p string")


def test_replay_keeps_every_row_and_key(spark):
    df = prompts(spark, ["a", "b", "a", None, "é"])
    stored = prompts(spark, ["a", "é", "a"]).select(prompt_hash(F.col("p")).alias("prompt_hash"), F.concat("p", F.lit("!")).alias("response"))
    rows = model_map(df, "p", Replay(stored)).orderBy("i").collect()
    assert [(r["response"], r["error"], r["attempts"], r["backend"]) for r in rows] == [
        ("a!", None, 1, "replay"), (None, "no response", 0, "replay"), ("a!", None, 1, "replay"),
        (None, "no response", 0, "replay"), ("é!", None, 1, "replay"),
    ]
    once = model_map(df, "p", Replay(stored.distinct(), unique=True)).orderBy("i").collect()
    assert [r["response"] for r in once] == [r["response"] for r in rows]
    nothing = stored.limit(0)
    assert all(r["error"] for r in model_map(df, "p", Replay(nothing)).collect())


def test_rules_and_reserved_columns(spark):
    df = prompts(spark, ["a"])
    assert model_map(df, "p", Rules(F.upper("p"))).first()["response"] == "A"
    with pytest.raises(ValueError):
        model_map(df.withColumn("error", F.lit(1)), "p", Rules(F.upper("p")))


def test_callable_retries_call_parse_and_validation(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(batch):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in batch)
        with open(log) as f:
            seen = f.read().split("\n")
        if "boom" in batch:
            raise RuntimeError("down")
        return ["bad" if p == "late" and seen.count("late") < 3 else p.upper() for p in batch]

    backend = Caller(call, max_tries=3, accept=lambda r: r != "bad", batch_rows=1, calls=2)
    df = prompts(spark, ["x", "late", "boom", "x", None])
    rows = model_map(df, "p", backend, str(tmp_path / "responses")).orderBy("i").collect()
    assert [(r["response"], r["attempts"], r["error"]) for r in rows] == [
        ("X", 1, None), ("LATE", 3, None), (None, 3, "RuntimeError: down"), ("X", 1, None), (None, 0, "no response"),
    ]
    with open(log) as f:
        asked = f.read().split()
    assert sorted(asked) == ["boom"] * 3 + ["late"] * 3 + ["x"]


def test_resume_asks_only_what_is_missing(spark, tmp_path):
    path, log = str(tmp_path / "responses"), str(tmp_path / "calls")

    def call(batch):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in batch)
        return [p + "!" for p in batch]

    backend = Caller(call)
    store_responses(distinct_prompts(prompts(spark, ["a", "b"]), "p"), backend, path)
    df = prompts(spark, ["a", "b", "c", "c"])
    assert [r["response"] for r in model_map(df, "p", backend, path).orderBy("i").collect()] == ["a!", "b!", "c!", "c!"]
    with open(log) as f:
        assert sorted(f.read().split()) == ["a", "b", "c"]
    assert pending_prompts(df, "p", spark.read.parquet(path)).count() == 0


def test_callable_setup_and_wrong_count(spark):
    once = Caller(lambda batch, tail: [p + tail for p in batch], setup=lambda: "?")
    assert model_map(prompts(spark, ["a"]), "p", once).first()["response"] == "a?"
    used = model_map(prompts(spark, ["a", "b"]), "p", Caller(lambda batch: [f"{os.urandom(8).hex()}" for _ in batch]))
    assert used.collect() == used.collect()
    short = Caller(lambda batch: [], max_tries=1)
    assert "0 responses" in model_map(prompts(spark, ["a"]), "p", short).first()["error"]


def test_hot_prompt_is_answered_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(batch):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in batch)
        return list(batch)

    df = prompts(spark, ["same"] * 300 + [str(i) for i in range(50)]).repartition(6)
    out = model_map(df, "p", Caller(call), str(tmp_path / "r"))
    assert out.count() == 350 and out.filter("response = p").count() == 350
    with open(log) as f:
        assert len(f.read().split()) == 51


def test_calls_are_timed(spark):
    import time as clock

    def call(batch):
        clock.sleep(0.05)
        return [p.upper() for p in batch]

    rows = model_map(prompts(spark, ["a", "b"]), "p", Caller(call, max_tries=2, accept=lambda r: r != "B", batch_rows=2, calls=1)).collect()
    seconds = {r["p"]: r["seconds"] for r in rows}
    assert 0.05 <= seconds["a"] < seconds["b"] and seconds["b"] >= 0.1
    assert model_map(prompts(spark, ["a"]), "p", Rules(F.col("p"))).first()["seconds"] is None


def test_long_class_matrix(spark):
    from textloom.operators.matrix import class_matrix, class_matrix_long, class_numbers

    kind = "doc_id string, relevant_classes array<struct<class_id:string,justification:string>>"
    df = spark.createDataFrame([("1", [("b", "x"), ("a", "y"), ("b", "z")]), ("2", []), ("3", None), ("4", [("é", None), (None, "q")])], kind)
    numbers = {r["class_id"]: r["class_no"] for r in class_numbers(df.select(F.explode("relevant_classes.class_id").alias("class_id"))).collect()}
    assert numbers == {"a": 1, "b": 2, "é": 3}
    wide = {(r["doc_id"], numbers[c]) for r in class_matrix(df, list(numbers)).collect() for c in numbers if r[c]}
    assert {tuple(r) for r in class_matrix_long(df).collect()} == wide == {("1", 1), ("1", 2), ("4", 3)}
    assert class_matrix_long(df).count() == 3


def test_a_failed_slice_asks_only_its_own_prompts_again(spark, tmp_path):
    """The model process dies on one prompt; its slice is asked again, the others are not."""
    log, down = tmp_path / "log", tmp_path / "down"
    down.write_text("x")

    def setup():
        return str(log), str(down)

    def call(batch, places):
        with open(places[0], "a") as f:
            f.write("".join(p + "\n" for p in batch))
        if "p7" in batch and os.path.exists(places[1]):
            os._exit(3)
        return [p.upper() for p in batch]

    df = spark.createDataFrame([(f"p{i}",) for i in range(60)], "p string")
    backend = Caller(call, setup=setup, slice_rows=10, calls=1, batch_rows=100)
    with pytest.raises(SliceError, match="1 of 6 slices failed"):
        model_map(df, "p", backend, str(tmp_path / "r"))
    stored = {r["response"] for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert 30 <= len(stored) < 60 and "P7" not in stored
    before = log.read_text().split().copy()
    assert all(before.count(p.lower()) == 1 for p in stored)
    down.unlink()
    out = model_map(df, "p", backend, str(tmp_path / "r")).collect()
    assert {r["response"] for r in out} == {f"P{i}" for i in range(60)}
    after = log.read_text().split()[len(before):]
    assert sorted(p.upper() for p in after) == sorted({f"P{i}" for i in range(60)} - stored)


def test_slices_share_the_calls_in_flight(spark, tmp_path):
    """Slices are asked at once, and never more calls than allowed are in flight."""
    import time

    folder = tmp_path / "times"
    folder.mkdir()

    def call(batch):
        start = time.time()
        time.sleep(0.3)
        (folder / f"{batch[0]}.txt").write_text(f"{start} {time.time()}")
        return [p.upper() for p in batch]

    names = [f"p{i}" for i in range(40)]
    backend = Caller(call, slice_rows=8, calls=3, batch_rows=4)
    out = model_map(prompts(spark, names), "p", backend, str(tmp_path / "r"))
    assert sorted(r["response"] for r in out.collect()) == sorted(n.upper() for n in names)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 40
    spans = [tuple(map(float, f.read_text().split())) for f in folder.iterdir()]
    most = max(sum(a <= at < b for a, b in spans) for at, _ in spans)
    assert 1 < most <= 3
    assert not [f for f in (tmp_path / "r").iterdir() if f.is_dir()]
