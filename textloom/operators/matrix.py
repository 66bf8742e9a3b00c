"""Document x class and domain x severity matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.numbering import number_rows, written

# Fixed value: severity levels from mild to severe
SEVERITY_LEVELS = ("low", "moderate", "high", "critical")


def distinct_class_ids(results: DataFrame, max_classes: int = 10_000) -> list[str]:
    """Sorted ids that occur in ``relevant_classes``.

    They become columns, so there can only be as many as a table may have;
    more is an error, not a cut.
    """
    ids = results.select(F.explode("relevant_classes.class_id").alias("class_id")).distinct()
    rows = ids.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes cannot become columns")
    return sorted(r["class_id"] for r in rows)


def class_matrix(results: DataFrame, class_ids: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per class, documents without labels as zero rows.

    The labels of a document sit in one array, so this is a projection: no
    explode, no pivot, no shuffle.
    """
    ids = sorted(class_ids) if class_ids is not None else distinct_class_ids(results)
    assigned = F.coalesce(F.col("relevant_classes.class_id"), F.array().cast("array<string>"))
    return results.select(
        "doc_id", *[F.array_contains(assigned, cid).cast("int").alias(cid) for cid in ids]
    )


def class_numbers(ids: DataFrame) -> DataFrame:
    """``class_id, class_no`` (from 1, in the order of the ids) of the classes in ``class_id``; any number of them."""
    return number_rows(ids.select("class_id").where("class_id IS NOT NULL").distinct(), [], "class_id", "class_no")


def class_matrix_long(results: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``doc_id, class_no``: the ones of the 0/1 matrix, each once.

    For catalogues too large for columns.  Ids are numbered by a distributed sort and
    joined; no list of classes is on the driver.  Documents without labels have no ones.
    """
    ones = results.select("doc_id", F.explode(F.array_distinct("relevant_classes.class_id")).alias("class_id"))
    if numbers is None:
        ones = written(ones, "class-ones")
        numbers = class_numbers(ones)
    return ones.join(numbers, "class_id").select("doc_id", "class_no")


def risk_matrix(issues: DataFrame, levels: Sequence[str] = SEVERITY_LEVELS) -> DataFrame:
    """Issue counts by domain and severity; other levels land in ``other``."""
    level = F.col("issue_analysis.severity.level")
    domain = F.col("issue_analysis.type.domain")
    return (
        issues.filter(F.col("issue_analysis").isNotNull())
        .groupBy(domain.alias("domain"))
        .agg(
            *[F.count_if(level == name).alias(name) for name in levels],
            F.count_if(~level.isin(*levels)).alias("other"),
        )
    )
