"""Issue extraction: nested records, flat views, rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.jsonx import nullable, parse_lenient, required
from textloom.functions.prompts import with_system
from textloom.functions.text import let
from textloom.operators.matrix import SEVERITY_LEVELS
from textloom.operators.model_map import Caller, Replay, Rules, model_map
from textloom.operators.once import add_checked, add_once

_TEXTS = T.ArrayType(T.StringType(), False)
ENTITY_KINDS = ("persons", "organizations", "locations", "dates", "misc")
ISSUE_ANSWER = T.StructType(
    [
        required("id", T.StringType()),
        required("input_text", T.StringType()),
        required("is_issue", T.BooleanType()),
        nullable(
            "issue_analysis",
            T.StructType(
                [
                    required(
                        "severity",
                        T.StructType([required("level", T.StringType()), required("justification", T.StringType())]),
                    ),
                    required(
                        "category",
                        T.StructType(
                            [
                                required("label", T.StringType()),
                                required("confidence", T.DoubleType()),
                                required("keywords", _TEXTS),
                            ]
                        ),
                    ),
                    required(
                        "type",
                        T.StructType([required("domain", T.StringType()), required("subcategory", T.StringType())]),
                    ),
                    required("summary", T.StringType()),
                    required("impacted_entities", _TEXTS),
                    required("likely_consequences", _TEXTS),
                ]
            ),
        ),
        required("named_entities", T.StructType([required(kind, _TEXTS) for kind in ENTITY_KINDS])),
        required("explanation", T.StructType([required("steps", _TEXTS), required("reasoning", T.StringType())])),
    ]
)


def check_domain_values(checked: Column) -> Column:
    """A checked answer whose severity and confidence must also be in range."""
    analysis = checked["payload"]["issue_analysis"]
    outside = (
        F.when(
            ~analysis["severity"]["level"].isin(*SEVERITY_LEVELS), F.lit("$.issue_analysis.severity.level: unknown")
        )
        .when(
            ~analysis["category"]["confidence"].between(0.0, 1.0),
            F.lit("$.issue_analysis.category.confidence: outside 0..1"),
        )
    )
    return let(
        F.coalesce(checked["error"], outside),
        lambda error: F.struct(
            F.when(error.isNull(), checked["payload"]).alias("payload"), error.isNull().alias("ok"), error.alias("error")
        ),
    )


def analyze_issues(
    docs: DataFrame,
    backend: Replay | Rules | Caller,
    system: str = "Report whether the text describes an issue, as one JSON object.",
    check_domains: bool = False,
    response_path: str | None = None,
) -> DataFrame:
    """``id, response, payload, ok, error`` for rows ``id, text``; none is lost."""
    asked = docs.withColumn("prompt", with_system(system, F.col("text")))
    answered = model_map(asked, "prompt", backend, response_path)
    checked = add_checked(answered.select("id", "response"), parse_lenient(F.col("response")), ISSUE_ANSWER)
    result = check_domain_values(F.col("checked")) if check_domains else F.col("checked")
    return add_once(checked, result).drop("checked")


def issue_records(analyzed: DataFrame) -> DataFrame:
    """Accepted records; the id is the input's, never the answer's."""
    fields = [F.col(f"payload.{f.name}").alias(f.name) for f in ISSUE_ANSWER.fields if f.name != "id"]
    return analyzed.filter("ok").select(F.col("id").cast("string").alias("id"), *fields)


def rejected_issues(analyzed: DataFrame) -> DataFrame:
    return analyzed.filter("NOT ok").select("id", "response", "error")


def issue_facts(records: DataFrame) -> DataFrame:
    """One flat row per record."""
    a = F.col("issue_analysis")
    return records.select(
        "id",
        "is_issue",
        a["severity"]["level"].alias("severity"),
        a["category"]["label"].alias("category"),
        a["category"]["confidence"].alias("confidence"),
        a["type"]["domain"].alias("domain"),
        a["type"]["subcategory"].alias("subcategory"),
        a["summary"].alias("summary"),
    )


def issue_entities(records: DataFrame) -> DataFrame:
    """``id, kind, entity``: named entities, one row each."""
    lists = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"named_entities.{k}").alias("names")) for k in ENTITY_KINDS]
    )
    kinds = records.select("id", F.explode(lists).alias("_k"))
    return kinds.select("id", F.col("_k.kind").alias("kind"), F.explode("_k.names").alias("entity"))
