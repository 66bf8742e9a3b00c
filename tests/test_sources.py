import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers as IN, writers as OUT


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_documents_csv(spark, tmp_path):
    path = write(tmp_path / "d.csv", 'ID,TEXT,X\n 1 ,"a ""b"",\nc é",0\n2,  ,0\n,x,0\n003,ok,1\n')
    assert [tuple(r) for r in IN.read_documents(spark, path).collect()] == [("1", 'a "b",\nc é'), ("003", "ok")]
    ordered = IN.read_documents(spark, path, order_column="at").orderBy("at").collect()
    assert [r["doc_id"] for r in ordered] == ["1", "003"]
    with pytest.raises(ValueError, match="BODY"):
        IN.read_documents(spark, path, "ID", "BODY")
    issues = write(tmp_path / "i.csv", "id,text\n007,hello\n")
    assert tuple(IN.read_issue_texts(spark, issues).first()) == ("007", "hello")


def test_classes(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,label,context\n1, One ,c\n2,Two,\n")
    assert IN.read_classes(spark, path) == [{"id": "1", "label": "One", "context": "c"}, {"id": "2", "label": "Two"}]
    with pytest.raises(ValueError):
        IN.read_classes(spark, path, 1)
    with pytest.raises(ValueError):
        IN.class_catalogue([])


def test_chunk_page_and_faq_tables(spark, tmp_path):
    with_id = write(tmp_path / "a.csv", "text,chunk_id,extra\nt,5,x\n")
    without = write(tmp_path / "b.csv", "text\nt\nu\n")
    assert tuple(IN.read_chunks(spark, with_id).first()) == ("t", "5")
    assert len({r["chunk_id"] for r in IN.read_chunks(spark, without).collect()}) == 2
    pages = write(tmp_path / "p.csv", "doc_name,page_number,text,length\nd,2,abc,9\n")
    assert tuple(IN.read_pages(spark, pages).first()) == ("d", 2, "abc", 3)
    faq = spark.createDataFrame(
        [("t", 1, "q", "a", "math", "student", [0.5, 0.5])],
        "source_text string, chunk_id int, question string, answer string, course string, persona string, embedding array<double>",
    )
    OUT.write_faq(faq, str(tmp_path / "faq"))
    back = IN.read_faq(spark, str(tmp_path / "faq"))
    assert back.schema["chunk_id"].dataType.simpleString() == "string" and back.first()["course"] == "math"
    OUT.write_embedded(faq, str(tmp_path / "vec"))
    assert IN.read_faq(spark, str(tmp_path / "vec")).schema["embedding"].dataType.simpleString() == "array<float>"
    with pytest.raises(ValueError):
        IN.read_faq(spark, pages)


def values(df):
    return sorted(r["j"] for r in df.select(F.to_json("record").alias("j")).collect())


def test_records(spark, tmp_path):
    array = write(tmp_path / "a.json", ' [ {"a": "é"},\n {"b": {"c": 1}} ]')
    lines = write(tmp_path / "l.jsonl", '{"a": "é"}\n\n  {"b": {"c": 1}}\n')
    want = ['{"a":"é"}', '{"b":{"c":1}}']
    assert values(IN.read_records(spark, array)) == values(IN.read_records(spark, lines)) == want
    assert values(IN.read_records(spark, array, by_extension=True)) == want
    broken = write(tmp_path / "x.jsonl", '{"a":1}\n[1]\n{"a":\n')
    assert values(IN.read_records(spark, broken, "skip")) == ['{"a":1}']
    kept = IN.read_records(spark, broken, "keep").collect()
    assert sorted((r["raw"], r["ok"]) for r in kept) == [("[1]", False), ('{"a":', False), ('{"a":1}', True)]
    with pytest.raises(Exception, match="not a JSON object"):
        IN.read_records(spark, broken).select(F.to_json("record")).collect()
    with pytest.raises(ValueError):
        IN.read_records(spark, write(tmp_path / "t.txt", "{}"), by_extension=True)
    not_list = write(tmp_path / "o.json", '{"a":1}')
    with pytest.raises(Exception, match="JSON list"):
        IN.read_records(spark, not_list, by_extension=True).collect()


def test_projects(spark, tmp_path):
    for name in ("b/x/individual", "a"):
        write(tmp_path / "base" / name / "faq.csv", "question\n")
    write(tmp_path / "base" / "none" / "other.csv", "q\n")
    with pytest.warns(UserWarning, match="does not exist"):
        found = IN.find_projects(spark, [str(tmp_path / "base"), str(tmp_path / "gone")]).collect()
    assert [r["project_path"].split("/base/")[1] for r in found] == ["a", "b/x/individual"]
    df = spark.createDataFrame([("p2", 1), ("p1", 2)], "project string, v int")
    df.write.partitionBy("project").parquet(str(tmp_path / "t"))
    assert [r["project"] for r in IN.partition_projects(spark, str(tmp_path / "t")).collect()] == ["p1", "p2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 2, "é", None), ("p", 1, "x", 3.0)], "project string, i int, t string, s double")
    OUT.write_jsonl(df, str(tmp_path / "j"), "i")
    texts = [line for f in sorted((tmp_path / "j").glob("part*")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert [json.loads(x) for x in texts] == [
        {"project": "p", "i": 1, "t": "x", "s": 3.0}, {"project": "p", "i": 2, "t": "é", "s": None},
    ] and "é" in "".join(texts)
    OUT.write_details(df, str(tmp_path / "d"))
    raw = "".join(f.read_text() for f in (tmp_path / "d" / "project=p").glob("part*"))
    assert '"s":3.0' in raw and "null" not in raw
    OUT.write_summaries(df.withColumnRenamed("project", "parent"), str(tmp_path / "s"))
    assert (tmp_path / "s" / "parent=p").exists()
    OUT.write_texts(df, str(tmp_path / "x"), "t")
    assert spark.read.json(str(tmp_path / "x")).count() == 2
    OUT.write_table(df, str(tmp_path / "q"))
    with pytest.raises(ValueError):
        OUT.write_merged(df, str(tmp_path / "q"), str(tmp_path / "q") + "/")
    OUT.write_merged(df, str(tmp_path / "m"), str(tmp_path / "q"))
    schema = "project string, i int, t string, s double"
    assert IN.read_summary(spark, str(tmp_path / "m"), schema).count() == 2
    assert IN.read_summary(spark, str(tmp_path / "nothing"), schema).count() == 0
    labels = spark.createDataFrame([("1", [("a", "b")])], "doc_id string, relevant_classes array<struct<class_id:string,justification:string>>")
    OUT.write_jsonl(labels, str(tmp_path / "r"))
    assert IN.read_results(spark, str(tmp_path / "r")).first()["relevant_classes"][0]["class_id"] == "a"


def test_checkpoint_dir_is_kept(spark):
    from textloom.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


# Large arrays, clustered files ----------------------------------------------------
def elements(spark, path, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        from textloom.sources.json_array import _pieces, json_array_elements

        found = json_array_elements(spark, path)
        return _pieces(spark, path).rdd.getNumPartitions(), sorted(r["raw"].strip() for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def random_json(rng, depth=0):
    kind = rng.randrange(3 if depth < 3 else 1)
    if kind == 0:
        return rng.choice([1, -2.5, None, True, "", "a,b", "}]", '{"x":[', '\\"}', "back\\", "é\n☃", "x" * rng.randrange(60)])
    if kind == 1:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b}", 'q"', "c\\"]): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("split_bytes", [61, 400, 10**6])
def test_arrays_are_split_between_tasks(spark, tmp_path, split_bytes):
    import random

    rng = random.Random(split_bytes)
    want = []
    for i, form in enumerate([{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}]):
        items = [random_json(rng) for _ in range(60)]
        want += items
        write(tmp_path / "a" / f"{i}.json", " \n" * i + json.dumps(items, **form) + "\n " * i)
    write(tmp_path / "a" / "empty.json", " [ \n ] ")
    tasks, got = elements(spark, str(tmp_path / "a"), split_bytes)
    assert sorted(map(repr, map(json.loads, got))) == sorted(map(repr, want))
    assert tasks > 5 or split_bytes > 400


@pytest.mark.parametrize("split_bytes", [5, 10**6])
def test_what_is_no_single_list_is_refused(spark, tmp_path, split_bytes):
    for text in ('{"a":1}', "1", '"x"', "[1] 2", "[1][2]", "x [1]", '[{"a":1}', '[{"a":1}}]', '{"a":[1]}', '[{"a":1}]]', '["a]', '[{"b":1}, {"a":2}'):
        with pytest.raises(Exception, match="JSON list"):
            elements(spark, write(tmp_path / "x.json", text), split_bytes)


def test_malformed_elements_are_refused(spark, tmp_path):
    for text in ("[1,,2]", "[1,]", '[{"a":1} {"b":2}]', "[{]}"):
        for bad in ("fail", "skip", "keep"):
            with pytest.raises(Exception, match="JSON list|not a JSON object"):
                IN.read_records(spark, write(tmp_path / "x.json", text), bad).collect()
    assert IN.read_records(spark, write(tmp_path / "e.json", "[]")).count() == 0
    mixed = IN.read_records(spark, write(tmp_path / "m.json", '[1, {"a": null}, null, [2]]'), "keep")
    assert sorted((r["raw"], r["ok"]) for r in mixed.collect()) == [("1", False), ("[2]", False), ("null", False), ('{"a":null}', True)]


def test_array_files_hold_one_array_each(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit('"}],é\n'), F.col("id").cast("string")).alias("t"), F.lit(None).cast("int").alias("n")).repartition(4)
    OUT.write_json_arrays(df, str(tmp_path / "j"))
    OUT.write_json_arrays(df.limit(0), str(tmp_path / "none"))
    loaded = [x for f in (tmp_path / "j").glob("part*") for x in json.loads(f.read_text(encoding="utf-8"))]
    assert sorted(x["id"] for x in loaded) == list(range(50)) and all(x["n"] is None for x in loaded)
    assert IN.read_records(spark, str(tmp_path / "j")).count() == 50 and IN.read_records(spark, str(tmp_path / "none"), by_extension=False).count() == 0


def test_large_groups_get_more_files_and_small_ones_one(spark, tmp_path):
    rows = [("hot", i, "x" * 100) for i in range(600)] + [(f"g{i % 30}", i, "y") for i in range(300)] + [(None, 1, "z")]
    df = spark.createDataFrame(rows, "project string, i int, t string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join groups of so few bytes
    try:
        OUT.write_details(df, str(tmp_path / "d"), file_bytes=10_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {p.name: len(list(p.glob("part*"))) for p in (tmp_path / "d").glob("project=*")}
    hot = files.pop("project=hot")
    assert 1 < hot <= -(-600 * 130 // 10_000) and set(files.values()) == {1} and len(files) == 31
    back = spark.read.json(str(tmp_path / "d"))
    assert back.count() == len(rows) and back.where("project is null").count() == 1
    OUT.write_faq(df.selectExpr("project AS course", "i AS persona", "t"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == len(rows)


def test_array_scans_take_bounded_steps(monkeypatch):
    """A batch is scanned in steps of bounded bytes; strings, runs of backslashes and brackets go on over their bounds."""
    import json
    import random

    import numpy as np
    import pyarrow as pa

    from textloom.sources import json_array as J

    monkeypatch.setattr(J, "_STEP", 7)
    rng = random.Random(3)
    values = ["".join(rng.choices('\\"{}[],aé', k=rng.randrange(60))) for _ in range(300)]
    text = json.dumps([{"a": v, "b": [v]} for v in values], ensure_ascii=False)
    pieces = text.split("}")
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(pieces), "start": [0] * len(pieces), "size": [len(text)] * len(pieces), "value": pieces})
    steps = [body for _, _, body in J._bodies(iter([batch]))]
    assert b"".join(steps) == (text + "}").encode() and max(map(len, steps)) <= 7
    whole, cut = J._Scan(), J._Scan()
    outside, depth = whole.step(np.frombuffer(b"".join(steps), np.uint8))
    parts = [cut.step(np.frombuffer(body, np.uint8)) for body in steps]
    assert np.array_equal(np.concatenate([o for o, _ in parts]), outside) and np.array_equal(np.concatenate([d for _, d in parts]), depth)


def test_elements_longer_than_a_step(spark, tmp_path):
    import json

    from textloom.sources import json_array as J

    values = [{"a": "\\" * (i % 5) + '"},{' * (i % 7) + "é" * (400_000 if i == 40 else i), "b": [i, {"c": []}]} for i in range(90)]
    (tmp_path / "one.json").write_text(json.dumps(values, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "two.json").write_text("[]", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = [json.loads(r["raw"]) for r in J.json_array_elements(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda v: v["b"][0]
    assert sorted(got, key=key) == values
