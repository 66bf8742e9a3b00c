"""Parsing and validating JSON answers as columns.

``from_json`` and ``try_parse_json`` are more forgiving than a JSON parser
should be: both accept text after the document.  ``parse_strict`` closes that
gap.  A parsed answer is a ``variant``; SQL null means *not JSON*, a variant
null means the JSON literal ``null``.

Two divergences from Python's parser remain: repeated object keys and the
``NaN`` / ``Infinity`` literals are refused here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import let, trim_ws

# Texts read as booleans, and number shapes read from text.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "f", "false", "n", "no", "off")
INT_TEXT = r"^\s*[+-]?[0-9]+(\.0+)?\s*$"
FLOAT_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

OPTIONAL = {"optional": True}


# Parsing ------------------------------------------------------------------
def parse_strict(c: Column) -> Column:
    """The whole text must be one JSON document.

    The text is parsed as the first of exactly two array elements; the second
    is its own digest, so neither trailing text nor closing brackets inside
    the text can produce the expected shape.
    """


    def unbox(text: Column, seal: Column, boxed: Column) -> Column:
        sealed = F.try_variant_get(boxed, "$[1]", "string") == seal
        alone = F.try_variant_get(boxed, "$[2]", "variant").isNull()
        return F.when(sealed & alone, F.try_variant_get(boxed, "$[0]", "variant"))

    def box(text: Column, seal: Column) -> Column:
        return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))

    return let(c, lambda t: let(F.md5(t), lambda seal: let(box(t, seal), lambda boxed: unbox(t, seal, boxed))))


def parse_lenient(c: Column) -> Column:
    """Whole text, else a fenced block, else first ``{`` to last ``}``."""
    fenced = F.regexp_extract(c, r"(?s)```json(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(parse_strict(c), parse_strict(fenced), parse_strict(braces))


def parse_unfenced(c: Column) -> Column:
    """Remove every fence marker, then parse what is left."""
    return parse_strict(F.regexp_replace(c, "```json|```", ""))


def parse_braces(c: Column) -> Column:
    """First ``{`` to last ``}`` when there is such a span, else the whole text."""
    return let(
        trim_ws(c),
        lambda body: let(
            F.regexp_extract(body, r"(?s)\{.*\}", 0),
            lambda span: parse_strict(F.when(span != "", span).otherwise(body)),
        ),
    )


def parse_or_text(c: Column) -> Column:
    """``struct<value variant, text string, is_json boolean>``.

    The span from the first opening to the last closing bracket is tried, then
    the whole text; when both fail the trimmed text itself is the value.
    """


    def parts(body: Column) -> Column:
        span = F.regexp_extract(body, r"(?s)[{\[].*[}\]]", 0)
        return let(
            F.coalesce(parse_strict(span), parse_strict(body)),
            lambda value: F.struct(value.alias("value"), body.alias("text"), value.isNotNull().alias("is_json")),
        )

    return let(trim_ws(c), parts)


# Kinds --------------------------------------------------------------------
def as_list(v: Column) -> Column:
    """``array<variant>`` of a JSON list, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_list(v: Column) -> Column:
    return F.coalesce(as_list(v).isNotNull(), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit(False))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def as_text_or_json(v: Column) -> Column:
    """Text of a string variant; compact JSON of anything else."""
    return F.when(is_text(v), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def field_path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def member(v: Column, name: str) -> Column:
    """The value under a key: SQL null when absent, variant null when null."""
    return F.try_variant_get(v, field_path(name), "variant")


# Schemas ------------------------------------------------------------------
def required(name: str, dtype: T.DataType) -> T.StructField:
    """Key must be present and not null."""
    return T.StructField(name, dtype, False)


def nullable(name: str, dtype: T.DataType) -> T.StructField:
    """Key must be present, its value may be null."""
    return T.StructField(name, dtype, True)


def optional(name: str, dtype: T.DataType) -> T.StructField:
    """Key may be absent."""
    return T.StructField(name, dtype, True, OPTIONAL)


def schema_from_example(example: dict[str, Any]) -> T.StructType:
    """Schema of one example object.

    A null makes an optional field of any kind; a list takes the type of its
    first non-null element, or any when there is none.
    """
    if not isinstance(example, dict):
        raise ValueError("the example must be a JSON object")
    fields = []
    for name, value in example.items():
        if value is None:
            fields.append(optional(name, T.VariantType()))
        else:
            fields.append(required(name, _type_of(value)))
    return T.StructType(fields)


def _type_of(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, dict):
        return schema_from_example(value)
    if isinstance(value, list):
        first = next((item for item in value if item is not None), None)
        if first is None:
            return T.ArrayType(T.VariantType(), True)
        return T.ArrayType(_type_of(first), False)
    return T.VariantType()


# Validation ---------------------------------------------------------------
# A schema becomes one SQL expression text: a nested record has dozens of
# members, and one parse is far cheaper than thousands of column calls.
def validate(column: str, schema: T.StructType) -> Column:
    """``struct<payload, ok, error>`` of a variant column against a schema.

    Unknown keys are ignored; the error names the first offending path.
    """
    names = iter(f"v{i}" for i in range(1_000_000))
    problem = f"CASE WHEN {{v}} IS NULL THEN 'not JSON' ELSE {_struct_problem('{v}', schema, '$', names)} END"
    value = _struct_value("{v}", schema, names)

    def result(v: str, error: str) -> str:
        return (
            f"named_struct('payload', CASE WHEN {error} IS NULL THEN {value.replace('{v}', v)} END, "
            f"'ok', {error} IS NULL, 'error', {error})"
        )

    text = _let(column, names, lambda v: _let(problem.replace("{v}", v), names, lambda error: result(v, error)))
    pattern = _shape(schema)
    return F.expr(text if pattern is None else f"coalesce({_at_once(column, schema, pattern, names)}, {text})")


# Records that have exactly the keys and kinds of the schema, nearly all that are right, are told by the text of their own
# schema and cast in one go; only the others are looked at member by member.
def _at_once(column: str, schema: T.StructType, pattern: str, names: Iterator[str]) -> str:
    """The accepted result of a record that fits as it is, else null."""

    def accepted(p: str) -> str:
        return (
            f"CASE WHEN {p} IS NOT NULL AND NOT ({_null_inside(p, schema, names)}) "
            f"THEN named_struct('payload', {p}, 'ok', true, 'error', CAST(NULL AS STRING)) END"
        )

    def cast(v: str) -> str:
        whole = _let(_get(v, "$", schema.simpleString()), names, accepted)
        return f"CASE WHEN schema_of_variant({v}) RLIKE {_quoted('^' + pattern + '$')} THEN {whole} END"

    return _let(column, names, cast)


def _shape(dtype: T.DataType) -> str | None:
    """Pattern of the schema texts whose values need no conversion; None where there is none."""
    plain = {
        T.StringType(): "STRING", T.LongType(): "BIGINT", T.BooleanType(): "BOOLEAN",
        T.DoubleType(): r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\))",
    }
    if isinstance(dtype, T.ArrayType):
        element = _shape(dtype.elementType)
        return None if element is None else f"ARRAY<(?:VOID|{element})>"
    if not isinstance(dtype, T.StructType):
        return plain.get(dtype)
    members = []
    for f in sorted(dtype.fields, key=lambda f: f.name):
        kind = _shape(f.dataType)
        if kind is None or not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", f.name):
            return None
        member = f"{f.name}: (?:VOID|{kind})" if f.nullable else f"{f.name}: {kind}"
        members.append(f"(?:{member}(?:, |(?=>)))" + ("?" if f.metadata == OPTIONAL else ""))
    return f"OBJECT<{''.join(members)}>"


def _null_inside(x: str, dtype: T.DataType, names: Iterator[str], listed: bool = False) -> str:
    """Whether a member of a list lacks what it must have, or may lack it: the schema text of a list tells that of all members together."""
    tests = []
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            child = f"{x}.{f.name}"
            if listed and f.metadata != OPTIONAL:
                tests.append(f"{child} IS NULL")
            deep = _null_inside(child, f.dataType, names, listed)
            if deep != "false":
                tests.append(f"({child} IS NOT NULL AND ({deep}))")
    elif isinstance(dtype, T.ArrayType):
        e = next(names)
        inner = [] if dtype.containsNull else [f"{e} IS NULL"]
        deep = _null_inside(e, dtype.elementType, names, True)
        if deep != "false":
            inner.append(f"({e} IS NOT NULL AND ({deep}))")
        if inner:
            tests.append(f"exists({x}, {e} -> {' OR '.join(inner)})")
    return f"coalesce({' OR '.join(tests)}, false)" if tests else "false"


def _let(x: str, names: Iterator[str], body: Callable[[str], str]) -> str:
    """``body`` of a lambda variable that holds ``x``, evaluated once."""
    name = next(names)
    return f"get(transform(array({x}), {name} -> {body(name)}), 0)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(x: str, path: str, kind: str) -> str:
    return f"try_variant_get({x}, {_quoted(path)}, '{kind}')"


def _struct_problem(v: str, schema: T.StructType, path: str, names: Iterator[str]) -> str:
    """A value that is no object has no members, so every key is missing."""
    problems = [_problem(_get(v, field_path(f.name), "variant"), f, f"{path}.{f.name}", names) for f in schema.fields]
    if all(f.metadata == OPTIONAL for f in schema.fields):
        shape = f"CASE WHEN {_get(v, '$', 'map<string,variant>')} IS NULL THEN {_quoted(path + ': not an object')} END"
        problems.insert(0, shape)
    return f"coalesce({', '.join(problems)})"


def _problem(x: str, f: T.StructField, path: str, names: Iterator[str]) -> str:
    absent = "CAST(NULL AS STRING)" if f.metadata == OPTIONAL else _quoted(f"{path}: missing")
    null = "CAST(NULL AS STRING)" if f.nullable else _quoted(f"{path}: null")
    return _let(
        x,
        names,
        lambda x: f"CASE WHEN {x} IS NULL THEN {absent} WHEN is_variant_null({x}) THEN {null} "
        f"ELSE {_type_problem(x, f.dataType, path, names)} END",
    )


def _type_problem(x: str, dtype: T.DataType, path: str, names: Iterator[str]) -> str:
    if isinstance(dtype, T.StructType):
        return _struct_problem(x, dtype, path, names)
    if isinstance(dtype, T.VariantType):
        return "CAST(NULL AS STRING)"
    if isinstance(dtype, T.ArrayType):
        not_list, items = _quoted(f"{path}: not a list"), _get(x, "$", "array<variant>")
        if isinstance(dtype.elementType, T.VariantType):
            return f"CASE WHEN {items} IS NULL THEN {not_list} END"
        element = T.StructField("", dtype.elementType, dtype.containsNull)
        e = next(names)
        bad = f"{_problem(e, element, path + '[]', names)} IS NOT NULL"
        return _let(
            items,
            names,
            lambda a: f"CASE WHEN {a} IS NULL THEN {not_list} "
            f"WHEN exists({a}, {e} -> {bad}) THEN {_quoted(path + ': bad element')} END",
        )
    wrong = _quoted(f"{path}: not {dtype.simpleString()}")
    fits = _let(f"schema_of_variant({x})", names, lambda k: _scalar_fits(x, k, dtype))
    return f"CASE WHEN NOT coalesce({fits}, false) THEN {wrong} END"


def _scalar_fits(x: str, k: str, dtype: T.DataType) -> str:
    """Numbers and flags also fit when written as the other or as text."""
    if isinstance(dtype, T.StringType):
        return f"{k} = 'STRING'"
    text, number = _get(x, "$", "string"), _get(x, "$", "double")
    fractional = f"({k} LIKE 'DECIMAL%' OR {k} IN ('DOUBLE', 'FLOAT'))"
    if isinstance(dtype, T.LongType):
        return (
            f"{k} IN ('BIGINT', 'BOOLEAN') OR ({fractional} AND {number} = floor({number})) "
            f"OR ({k} = 'STRING' AND {text} RLIKE {_quoted(INT_TEXT)})"
        )
    if isinstance(dtype, T.DoubleType):
        return (
            f"{k} IN ('BIGINT', 'BOOLEAN') OR {fractional} OR ({k} = 'STRING' AND {text} RLIKE {_quoted(FLOAT_TEXT)})"
        )
    if isinstance(dtype, T.BooleanType):
        words = ", ".join(_quoted(w) for w in (*TRUE_TEXTS, *FALSE_TEXTS))
        return (
            f"{k} = 'BOOLEAN' OR (({k} = 'BIGINT' OR {fractional}) AND {number} IN (0.0D, 1.0D)) "
            f"OR ({k} = 'STRING' AND lower({text}) IN ({words}))"
        )
    raise ValueError(f"unsupported type {dtype.simpleString()}")


def _struct_value(v: str, schema: T.StructType, names: Iterator[str]) -> str:
    members = [
        f"{_quoted(f.name)}, {_value(_get(v, field_path(f.name), 'variant'), f.dataType, names)}" for f in schema.fields
    ]
    return f"named_struct({', '.join(members)})"


def _value(x: str, dtype: T.DataType, names: Iterator[str]) -> str:
    if isinstance(dtype, T.StringType):
        return _get(x, "$", "string")
    if isinstance(dtype, T.VariantType):
        return x
    if isinstance(dtype, T.ArrayType):
        items = _get(x, "$", "array<variant>")
        if isinstance(dtype.elementType, T.VariantType):
            return items
        e = next(names)
        return f"transform({items}, {e} -> {_value(e, dtype.elementType, names)})"
    if isinstance(dtype, T.StructType):
        return _let(
            x,
            names,
            lambda x: f"CASE WHEN {x} IS NOT NULL AND NOT is_variant_null({x}) THEN {_struct_value(x, dtype, names)} END",
        )
    return _let(x, names, lambda x: _let(f"schema_of_variant({x})", names, lambda k: _scalar_value(x, k, dtype)))


def _scalar_value(x: str, k: str, dtype: T.DataType) -> str:
    text, number, flag = (_get(x, "$", t) for t in ("string", "double", "boolean"))
    if isinstance(dtype, T.LongType):
        return (
            f"CASE {k} WHEN 'BIGINT' THEN {_get(x, '$', 'bigint')} WHEN 'BOOLEAN' THEN CAST({flag} AS BIGINT) "
            f"WHEN 'STRING' THEN try_cast(regexp_extract({text}, '[+-]?[0-9]+', 0) AS BIGINT) "
            f"ELSE CAST(floor({number}) AS BIGINT) END"
        )
    if isinstance(dtype, T.DoubleType):
        return (
            f"CASE {k} WHEN 'BOOLEAN' THEN CAST({flag} AS DOUBLE) "
            f"WHEN 'STRING' THEN try_cast(trim({text}) AS DOUBLE) ELSE {number} END"
        )
    true = ", ".join(_quoted(w) for w in TRUE_TEXTS)
    return f"CASE {k} WHEN 'BOOLEAN' THEN {flag} WHEN 'STRING' THEN lower({text}) IN ({true}) ELSE {number} = 1.0D END"
