"""Summaries of project metrics: parents, overall, levels, increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.paths import parent_path, project_folder
from textloom.operators.sets import add_unseen
from textloom.plans.evaluate import DEFAULT_KS, JUDGE_MEANS, metric_columns


def _weighted(metric: str, weight: Column, missing_as_zero: bool) -> Column:
    value = F.coalesce(F.col(metric), F.lit(0.0)) if missing_as_zero else F.col(metric)
    total = F.sum(weight)
    return F.when(total > 0, F.sum(value * weight) / total).alias(metric)


def weighted_rollup(
    projects: DataFrame,
    by: Sequence[str] = (),
    ks: Sequence[int] = DEFAULT_KS,
    judge_weight: str = "total_questions",
    missing_as_zero: bool = False,
    count_as: str = "total_projects",
) -> DataFrame:
    """Question-weighted means of every metric; overall when ``by`` is empty.

    Judge means cover projects that have one.  Their weight is the number of
    all questions, or ``judge_weight="judged"`` for the judged ones.  A group
    without questions has null means.
    """
    n = F.col("total_questions")
    judged = [m for m in JUDGE_MEANS if m in projects.columns]
    weight = F.when(F.col("avg_llm_score").isNotNull(), F.col(judge_weight)) if judged else None
    aggs = [
        F.count(F.lit(1)).alias(count_as),
        F.sum("total_questions").alias("total_questions"),
        *[_weighted(m, n, missing_as_zero) for m in metric_columns(ks)],
    ]
    if judged:
        total = F.sum(weight)
        aggs += [F.when(total > 0, F.sum(F.col(m) * weight) / total).alias(m) for m in judged]
        aggs.append(F.coalesce(total, F.lit(0)).alias("total_evaluated"))
    return projects.groupBy(*by).agg(*aggs)


def parent_summaries(projects: DataFrame, path: str = "project_path", **kwargs) -> DataFrame:
    """One summary per parent path of the project paths."""
    keyed = projects.withColumn("parent", parent_path(F.col(path)))
    return weighted_rollup(keyed, ["parent"], count_as="total_subfolders", **kwargs)


def overall_summary(projects: DataFrame, path: str = "project_path", **kwargs) -> DataFrame:
    """One summary per top folder of the project paths."""
    keyed = projects.withColumn("project_folder", project_folder(F.col(path)))
    return weighted_rollup(keyed, ["project_folder"], missing_as_zero=True, **kwargs)


def merged_summary(existing: DataFrame, new: DataFrame, path: str = "project_path", **kwargs) -> tuple[DataFrame, DataFrame]:
    """``(projects, summary)`` after adding projects not summarised before."""
    projects = add_unseen(existing, new, path)
    return projects, overall_summary(projects, path, **kwargs)


def rollup_levels(
    details: DataFrame, parent: str = "parent", project: str = "project", ks: Sequence[int] = DEFAULT_KS
) -> DataFrame:
    """Project, parent and overall means of evaluation rows in one job.

    Rows shrink to sums per project first; the grouping sets then run over
    that small table.  ``level`` is ``project``, ``parent`` or ``overall``.
    """
    names = metric_columns(ks)
    sums = details.groupBy(parent, project).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(m).cast("double")).alias(m) for m in names]
    )
    p, j = F.col(parent), F.col(project)
    level = (
        F.when(F.grouping(parent) == 1, "overall").when(F.grouping(project) == 1, "parent").otherwise("project")
    )
    total = F.sum("n")
    return sums.groupingSets([[p, j], [p], []], p, j).agg(
        level.alias("level"), total.alias("total_questions"), *[(F.sum(m) / total).alias(m) for m in names]
    )


# Report shape -----------------------------------------------------------------
def metric_maps(df: DataFrame, keep: Sequence[str], ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Wide metric columns as maps keyed by k in text form, as reports hold them."""

    def as_map(name: str) -> Column:
        pairs = [x for k in ks for x in (F.lit(str(k)), F.col(f"{name}_at_{k}"))]
        return F.create_map(*pairs).alias(f"{name}_at_k")

    means = [m for m in JUDGE_MEANS if m in df.columns]
    generation = (
        [F.when(F.col("avg_llm_score").isNotNull(), F.struct(*means)).alias("generation_metrics")] if means else []
    )
    return df.select(*keep, as_map("hit"), "mrr", *[as_map(m) for m in ("precision", "recall", "ndcg")], *generation)


def metric_value(df: DataFrame, metric: str, k: int) -> Column:
    """Value of a metric map under ``k``; 0 when it has no such key.

    The map may be keyed by text or by integer.
    """
    key = df.schema[metric].dataType.keyType
    return F.coalesce(F.try_element_at(F.col(metric), F.lit(str(k)).cast(key)), F.lit(0.0))


def from_metric_maps(df: DataFrame, keep: Sequence[str], ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Inverse of :func:`metric_maps`."""
    cols = [
        metric_value(df, f"{m}_at_k", k).alias(f"{m}_at_{k}")
        for m in ("hit", "precision", "recall", "ndcg")
        for k in ks
    ]
    means = [F.col(f"generation_metrics.{m}").alias(m) for m in JUDGE_MEANS] if "generation_metrics" in df.columns else []
    return df.select(*keep, "mrr", *cols, *means)
