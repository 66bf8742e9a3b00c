"""Label generation by a large model, training text, batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.jsonx import (
    as_text_or_json,
    is_object,
    is_text,
    member,
    parse_or_text,
    parse_strict,
    schema_from_example,
)
from textloom.functions.prompts import example_system_prompt, inference_prompt, sft_text, with_system
from textloom.functions.text import truncate_tokens
from textloom.operators.model_map import Caller, Replay, Rules, model_map
from textloom.operators.once import add_checked, add_once
from textloom.operators.sampling import first_n

# Fixed values
RECORD_KEYS = ("system_prompt", "user_prompt", "teacher_output")
PROMPT_KEYS = ("document_id", "texto")


def require_keys(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """Records (a variant column) that are objects and hold every key.

    A key with a null value counts as present.
    """
    r = F.col(record)
    ok = is_object(r)
    for key in keys:
        ok = ok & member(r, key).isNotNull()
    return df.filter(ok)


def drop_counts(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """How many records :func:`require_keys` keeps and why others go."""
    r = F.col(record)
    whole = is_object(r)
    has_all = F.lit(True)
    for key in keys:
        has_all = has_all & member(r, key).isNotNull()
    return df.agg(
        F.count_if(whole & has_all).alias("kept"),
        F.count_if(~whole).alias("not_objects"),
        F.count_if(whole & ~has_all).alias("missing_keys"),
    )


def error_counts(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows and failures of a finished job."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(error).alias("errors"))


def prompt_problem(system: Column, user: Column, keys: Sequence[str] = PROMPT_KEYS) -> Column:
    """Why a record's prompts are unusable, else null.

    The system prompt is text or null; the user prompt is text, or an object
    with the given keys.  Both are variants.
    """
    absent_system = system.isNull() | F.is_variant_null(system)
    has_keys = is_object(user)
    for key in keys:
        has_keys = has_keys & member(user, key).isNotNull()
    return (
        F.when(~absent_system & ~is_text(system), F.lit("system_prompt must be a string or null"))
        .when(user.isNull() | ~(is_text(user) | is_object(user)), F.lit("user_prompt must be a string or an object"))
        .when(is_object(user) & ~has_keys, F.lit("user_prompt object lacks a required key"))
    )


def variant_text(v: Column) -> Column:
    """Text of a variant: strings as they are, other values as compact JSON;
    absent and null values are null."""
    return F.when(~F.is_variant_null(v), as_text_or_json(v))


def label_records(
    records: DataFrame,
    example: Mapping[str, Any],
    backend: Replay | Rules | Caller,
    output_field: str | None = None,
    prompt_keys: Sequence[str] = PROMPT_KEYS,
    response_path: str | None = None,
) -> DataFrame:
    """Records with ``teacher_output`` (JSON text) and ``error``.

    ``records``: variants ``system_prompt`` and ``user_prompt`` plus any other
    columns, all kept.  ``output_field`` takes one member of the answer.  A bad
    record is not sent; it keeps its row with a null output and the reason.
    """
    schema = schema_from_example(dict(example))
    if output_field is not None and output_field not in schema.names:
        raise ValueError(f"the example has no field {output_field!r}")
    system, user = F.col("system_prompt"), F.col("user_prompt")
    problem = prompt_problem(system, user, prompt_keys)
    prompt = with_system(example_system_prompt(variant_text(system), example), variant_text(user))
    asked = records.withColumns({"_problem": problem, "prompt": F.when(problem.isNull(), prompt)})
    answered = model_map(asked, "prompt", backend, response_path)
    checked = add_checked(answered, parse_strict(F.col("response")), schema, "_c")
    payload = F.col("_c.payload")
    if output_field is None:
        output = F.to_json(payload, {"ignoreNullFields": "false"})
    else:
        output = _json_of(payload[output_field], schema[output_field].dataType)
    usable = F.col("_problem").isNull() & F.col("_c.ok")
    reason = F.coalesce(
        F.col("_problem"), F.when(F.col("response").isNull(), F.col("error")), F.col("_c.error")
    )
    return checked.select(
        *records.columns, F.when(usable, output).alias("teacher_output"), F.when(~usable, reason).alias("error")
    )


def _json_of(c: Column, dtype: T.DataType) -> Column:
    """JSON text of one value; scalars need a wrapper to be rendered."""
    if isinstance(dtype, (T.StructType, T.ArrayType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def sft_examples(
    records: DataFrame, record: str = "record", max_examples: int | None = None, order_by: str | None = None
) -> DataFrame:
    """``instruction, input, output`` from labelled records (a variant column).

    Records whose output is null are failures of the labelling step and are
    left out; they would train on the text of a null.
    """
    kept = require_keys(records, record, RECORD_KEYS)
    r = F.col(record)
    kept = kept.filter(~F.is_variant_null(member(r, "teacher_output")))
    if max_examples is not None:
        if order_by is None:
            raise ValueError("max_examples needs order_by")
        kept = first_n(kept, max_examples, order_by)
    return kept.select(
        *([order_by] if order_by else []),
        F.coalesce(variant_text(member(r, "system_prompt")), F.lit("")).alias("instruction"),
        F.coalesce(variant_text(member(r, "user_prompt")), F.lit("")).alias("input"),
        variant_text(member(r, "teacher_output")).alias("output"),
    )


def sft_texts(examples: DataFrame, eos: str) -> DataFrame:
    """Adds ``text``, the whole training sample."""
    return examples.withColumn(
        "text", sft_text(F.col("instruction"), F.col("input"), F.col("output"), eos)
    )


def batch_score(
    records: DataFrame,
    backend: Replay | Rules | Caller,
    record: str = "record",
    max_tokens: int | None = None,
    preamble: bool = False,
    response_path: str | None = None,
) -> DataFrame:
    """Other columns plus ``system_prompt, user_prompt, student_output, is_json``.

    Records without both prompts are left out.  ``max_tokens`` keeps the tail
    of a long prompt.  The output is compact JSON, or the answer's text.
    """
    kept = require_keys(records, record, RECORD_KEYS[:2])
    r = F.col(record)
    system, user = variant_text(member(r, "system_prompt")), variant_text(member(r, "user_prompt"))
    prompt = inference_prompt(F.coalesce(system, F.lit("")), F.coalesce(user, F.lit("")), preamble)
    if max_tokens is not None:
        prompt = truncate_tokens(prompt, max_tokens)
    others = [c for c in records.columns if c != record]
    asked = kept.select(*others, system.alias("system_prompt"), user.alias("user_prompt"), prompt.alias("prompt"))
    answered = model_map(asked, "prompt", backend, response_path)
    parsed = add_once(answered, F.struct(parse_or_text(F.col("response")).alias("_p")))
    output = F.when(F.col("_p.is_json"), F.to_json("_p.value")).otherwise(F.col("_p.text"))
    return parsed.select(
        *others, "system_prompt", "user_prompt", output.alias("student_output"), F.col("_p.is_json").alias("is_json")
    )
