import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import jsonx as J
from textloom.operators.once import add_checked, resolve

ANSWERS = [
    '{"a":1}', ' [1, 2] ', "null", '"x"', "1.5", "true", '{"a":{"b":[null]}}', '{"a":"é\\u00e9\\n"}',
    '{"a":1} trailing', '{"a":1}}', "[1]]", "1,2", '1,"x":2', "1],[2", "", "  ", "nan", '{"a":1', "{'a':1}", "prose",
    '{"a":1}{"b":2}', '[1,]', '"a\nb"', ' {"a":1}',
]


def read(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, r string")
    return [r["o"] for r in df.select("i", expr(F.col("r")).alias("o")).orderBy("i").collect()]


def loads(text):
    try:
        return json.loads(text)
    except ValueError:
        return "refused"


def test_strict_accepts_what_a_json_parser_accepts(spark):
    got = read(spark, ANSWERS, lambda c: F.to_json(J.parse_strict(c)))
    assert ["refused" if g is None else json.loads(g) for g in got] == [loads(a) for a in ANSWERS]
    assert read(spark, [None], lambda c: J.parse_strict(c).isNull()) == [True]


def test_known_divergences_are_refusals(spark):
    assert read(spark, ['{"a":1,"a":2}', "NaN", "[Infinity]"], lambda c: J.parse_strict(c).isNull()) == [True] * 3


def test_own_digest_cannot_be_forged(spark):
    import hashlib

    text = '1,"x"'
    forged = [f'1,"{hashlib.md5(text.encode()).hexdigest()}"', '1,"",2']
    assert read(spark, forged, lambda c: J.parse_strict(c).isNull()) == [True, True]


FENCED = '```json\n{"a":1}\n```'


def test_lenient_order(spark):
    texts = [FENCED, "see " + FENCED + " ok", '```json {"a":1}', 'so {"a":1} ok', "none", "[1]", '```json x``` {"a":2}']
    assert read(spark, texts, lambda c: F.to_json(J.parse_lenient(c))) == [
        '{"a":1}', '{"a":1}', '{"a":1}', '{"a":1}', None, "[1]", '{"a":2}',
    ]


def test_unfenced_braces_and_text(spark):
    assert read(spark, [FENCED, "x" + FENCED, "```[1]```"], lambda c: F.to_json(J.parse_unfenced(c))) == ['{"a":1}', None, "[1]"]
    assert read(spark, ["a {\n} b", "[1]", "no"], lambda c: F.to_json(J.parse_braces(c))) == ["{}", "[1]", None]
    got = read(spark, [' ok [1] {"a":2} ', "[x", " 7 ", "text } {"], J.parse_or_text)
    assert [(g["text"], g["is_json"]) for g in got] == [
        ('ok [1] {"a":2}', False), ("[x", False), ("7", True), ("text } {", False),
    ]


def test_schema_from_example():
    s = J.schema_from_example({"a": True, "b": 1, "c": 1.5, "d": "x", "e": None, "f": [], "g": [None, {"h": 1}]})
    kinds = {f.name: f.dataType.simpleString() for f in s.fields}
    assert kinds == {
        "a": "boolean", "b": "bigint", "c": "double", "d": "string", "e": "variant", "f": "array<variant>",
        "g": "array<struct<h:bigint>>",
    }
    with pytest.raises(ValueError):
        J.schema_from_example([1])


SCHEMA = T.StructType(
    [
        J.required("id", T.StringType()), J.required("n", T.LongType()), J.required("x", T.DoubleType()),
        J.required("b", T.BooleanType()),
        J.nullable("s", T.StructType([J.required("tags", T.ArrayType(T.StringType(), False))])),
        J.required("items", T.ArrayType(T.StructType([J.required("i", T.LongType())]), False)),
        J.optional("any", T.VariantType()),
    ]
)
GOOD = {"id": "a", "n": 1, "x": 1.5, "b": True, "s": None, "items": [{"i": 1}, {"i": "2"}]}
CHANGES = [
    {}, {"n": "3"}, {"n": 2.0}, {"n": 1.9}, {"n": True}, {"n": None}, {"n": "x"}, {"n": [1]}, {"id": 1}, {"id": None},
    {"s": {"tags": ["a", 1]}}, {"s": {"tags": ["a"]}}, {"s": {}}, {"s": []}, {"s": "x"}, {"items": {"i": 1}},
    {"items": [{"i": 1}, {}]}, {"items": []}, {"items": None}, {"items": [None]}, {"b": "Yes"}, {"b": 2}, {"b": 0},
    {"b": "maybe"}, {"x": "1e3"}, {"x": 1}, {"x": False}, {"x": "one"}, {"any": [1]}, {"any": None}, {"more": 1},
]


def variants():
    out = [{**GOOD, **c} for c in CHANGES]
    out += [{k: v for k, v in GOOD.items() if k != gone} for gone in GOOD]
    return [json.dumps(v) for v in out] + ["[1]", "null", "3", "{}"]


def test_validation_agrees_with_pydantic(spark):
    pydantic = pytest.importorskip("pydantic")
    from typing import Any, List, Optional

    item = pydantic.create_model("Item", i=(int, ...))
    sub = pydantic.create_model("Sub", tags=(List[str], ...))
    model = pydantic.create_model(
        "Model", id=(str, ...), n=(int, ...), x=(float, ...), b=(bool, ...), s=(Optional[sub], ...),
        items=(List[item], ...), any=(Optional[Any], None),
    )

    def accepted(text):
        try:
            value = model(**json.loads(text)).model_dump()
            return value["n"], value["x"], value["b"], value["s"], value["items"]
        except Exception:
            return None

    texts = variants()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    rows = add_checked(df, J.parse_strict(F.col("r")), SCHEMA).orderBy("i").collect()
    for row, text in zip(rows, texts):
        want = accepted(text)
        c = row["checked"]
        assert c["ok"] == (want is not None) == (c["error"] is None), text
        if want is not None:
            p = c["payload"].asDict(recursive=True)
            assert (p["n"], p["x"], p["b"], p["s"], p["items"]) == want, text
        else:
            assert c["payload"] is None


def test_failure_lanes(spark):
    schema = T.StructType([J.required("n", T.LongType())])
    df = spark.createDataFrame([(1, '{"n":1}'), (2, "x"), (3, '{"n":null}')], "i int, r string")
    checked = add_checked(df, J.parse_strict(F.col("r")), schema)

    def lane(mode, default=None):
        out = resolve(checked, mode, default).orderBy("i").collect()
        return [(r["i"], r["payload"] and r["payload"]["n"], r["error"]) for r in out]

    assert lane("null") == [(1, 1, None), (2, None, "not JSON"), (3, None, "$.n: null")]
    assert lane("drop") == [(1, 1, None)]
    zero = F.struct(F.lit(0).cast("bigint").alias("n"))
    assert [x[1] for x in lane("default", zero)] == [1, 0, 0]
    with pytest.raises(Exception, match="not JSON|null"):
        lane("fail")
    with pytest.raises(ValueError):
        resolve(checked, "default")


def mutated(rng, value, depth=0):
    """A JSON value with a member dropped, added, nulled or of another kind here and there."""
    if rng.random() < 0.06:
        return rng.choice([None, 1, 1.5, 2.0, "1", "x", "true", True, [], {}, [None], [1, "a"], {"a": None}])
    if isinstance(value, dict):
        out = {k: mutated(rng, v, depth + 1) for k, v in value.items() if rng.random() > 0.02}
        return {**out, "extra": 1} if rng.random() < 0.05 else out
    if isinstance(value, list):
        return [mutated(rng, rng.choice(value), depth + 1) for _ in range(rng.randrange(4))] if value else value
    return value


def test_whole_records_are_validated_like_their_members(spark, monkeypatch):
    """The fast lane accepts what the member-by-member check accepts, with the same payload, and nothing else."""
    import random

    from textloom.functions import jsonx as J

    item = T.StructType([J.required("i", T.LongType()), J.nullable("t", T.StringType()), J.optional("o", T.DoubleType())])
    schema = T.StructType([
        J.required("z", T.StringType()), J.required("a", T.LongType()), J.nullable("f", T.DoubleType()), J.optional("b", T.BooleanType()),
        J.required("words", T.ArrayType(T.StringType(), False)), J.optional("nulls", T.ArrayType(T.LongType(), True)),
        J.required("items", T.ArrayType(item, False)), J.nullable("part", T.StructType([J.required("deep", T.ArrayType(T.ArrayType(T.LongType(), False), False))])),
    ])
    base = {
        "z": "é", "a": 5, "f": 1.25, "b": True, "words": ["x", "y"], "nulls": [1, 2], "items": [{"i": 1, "t": "q", "o": 2}, {"i": 2, "t": None}],
        "part": {"deep": [[1, 2], [3]]},
    }
    rng = random.Random(8)
    values = [base, {**base, "part": None, "f": None}] + [mutated(rng, base) for _ in range(500)]
    texts = [json.dumps(v, ensure_ascii=False) for v in values] + ["", "nope", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("v", J.parse_strict(F.col("t")))

    def checked():
        rows = df.select("n", J.validate("v", schema).alias("c")).orderBy("n").collect()
        return [(r["c"]["ok"], r["c"]["error"], r["c"]["payload"]) for r in rows]

    fast = checked()
    assert J._shape(schema) is not None and 50 < sum(ok for ok, _, _ in fast) < 450
    monkeypatch.setattr(J, "_shape", lambda dtype: None)
    assert fast == checked()
