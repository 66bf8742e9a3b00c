"""Structured question steps: prompt plus inputs plus schema -> JSON object."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.jsonx import is_object, parse_strict
from textloom.functions.prompts import tool_system_prompt, tool_user_prompt, with_system
from textloom.operators.model_map import Caller, Replay, Rules, model_map
from textloom.operators.once import add_once


def tool_prompts(steps: DataFrame) -> DataFrame:
    """Adds ``prompt`` to ``system_prompt, user_prompt, input_dict, output_schema``."""
    return steps.withColumn(
        "prompt",
        with_system(
            tool_system_prompt(F.col("system_prompt"), F.col("output_schema")),
            tool_user_prompt(F.col("user_prompt"), F.col("input_dict")),
        ),
    )


def tool_step(steps: DataFrame, backend: Replay | Rules | Caller, response_path: str | None = None) -> DataFrame:
    """Adds ``raw_output, json_output, error``.

    Only an object counts as parsed; a JSON list is reported as unparsed.
    """
    answered = model_map(tool_prompts(steps), "prompt", backend, response_path)
    answered = add_once(answered, F.struct(parse_strict(F.col("response")).alias("_v")))
    v = F.col("_v")
    problem = F.when(v.isNull(), F.lit("not JSON")).when(~is_object(v), F.lit("not an object"))
    return answered.select(
        *steps.columns,
        F.coalesce("response", F.lit("")).alias("raw_output"),
        F.when(is_object(v), F.to_json(v)).alias("json_output"),
        F.coalesce(F.when(F.col("response").isNull(), F.col("error")), problem).alias("error"),
    )


def step_result(stepped: DataFrame, name: str) -> DataFrame:
    """One column named after the step: its object, or ``{"raw_output": ...}``
    when there is none or it is empty."""
    empty = F.coalesce(F.col("json_output"), F.lit("{}")) == "{}"
    raw = F.to_json(F.struct("raw_output"))
    return stepped.withColumn(name, F.when(empty, raw).otherwise(F.col("json_output")))


def tool_chain(
    df: DataFrame, steps: Mapping[str, tuple[Mapping[str, object], Replay | Rules | Caller]]
) -> DataFrame:
    """Run named steps over the same rows, one result column each.

    A step is ``({system_prompt, user_prompt, input_dict, output_schema}
    columns, backend)``.  Steps take no output of earlier ones.
    """
    fields = ("system_prompt", "user_prompt", "input_dict", "output_schema")
    out = df
    for name, (columns, backend) in steps.items():
        shaped = out.withColumns({f: columns[f] for f in fields})
        done = step_result(tool_step(shaped, backend), name)
        out = done.select(*out.columns, name)
    return out
