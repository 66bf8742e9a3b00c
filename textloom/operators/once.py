"""A boundary for computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.jsonx import validate


def add_once(df: DataFrame, fields: Column) -> DataFrame:
    """``df`` plus the members of a struct expression, computed once per row.

    Catalyst pushes a filter on a computed column below its projection and so
    computes the column twice.  A generator over a one-element array is a row
    for a row, and nothing is pushed through it.
    """
    return df.select("*", F.inline_outer(F.array(fields)))


def add_checked(df: DataFrame, parsed: Column, schema: T.StructType, out: str = "checked") -> DataFrame:
    """``df`` plus ``out``: a parsed answer as ``struct<payload, ok, error>``."""
    held = add_once(df, F.struct(parsed.alias("_parsed")))
    return add_once(held, F.struct(validate("_parsed", schema).alias(out))).drop("_parsed")


def resolve(df: DataFrame, on_error: str, default: Column | None = None, checked: str = "checked") -> DataFrame:
    """``checked`` replaced by ``payload`` and ``error``, with a lane for failures.

    ``null`` leaves the payload null, ``default`` puts the given value there,
    ``drop`` removes the row, ``fail`` stops the job.
    """
    if on_error not in ("null", "default", "drop", "fail"):
        raise ValueError("on_error is null, default, drop or fail")
    if (on_error == "default") != (default is not None):
        raise ValueError("a default goes with on_error='default'")
    ok, payload, error = F.col(f"{checked}.ok"), F.col(f"{checked}.payload"), F.col(f"{checked}.error")
    if on_error == "default":
        payload = F.when(ok, payload).otherwise(default)
    elif on_error == "fail":
        kind = df.schema[checked].dataType["payload"].dataType
        payload = F.when(ok, payload).otherwise(F.raise_error(error).cast(kind))
    rows = df.filter(ok) if on_error == "drop" else df
    return rows.select(*[c for c in df.columns if c != checked], payload.alias("payload"), error.alias("error"))
