"""Retrieval metrics for one relevant item per question.

All of them follow from two facts about a ranked list: the position of the
first match, and the number of matches among the first k.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit_at(first_pos: Column, k: Column | int) -> Column:
    return F.coalesce(first_pos <= k, F.lit(False))


def recall_at(first_pos: Column, k: Column | int) -> Column:
    return hit_at(first_pos, k).cast("double")


def precision_at(matches_in_k: Column, k: int) -> Column:
    """Matches over k.  The same item returned twice counts twice."""
    return F.lit(0.0) if k == 0 else matches_in_k.cast("double") / F.lit(float(k))


def ndcg_at(first_pos: Column, k: Column | int) -> Column:
    """Gain of the first match only; the ideal list has it in front."""
    gain = F.lit(1.0) / F.log2(first_pos.cast("double") + 1.0)
    return F.when(hit_at(first_pos, k), gain).otherwise(F.lit(0.0))


def reciprocal_rank(first_pos: Column) -> Column:
    return F.coalesce(F.lit(1.0) / first_pos.cast("double"), F.lit(0.0))


def judge_mean(correctness: Column, completeness: Column, relevance: Column) -> Column:
    """Mean of the three sub-scores to one decimal: a check on the overall score."""
    total = correctness.cast("double") + completeness.cast("double") + relevance.cast("double")
    return F.round(total / 3.0, 1)
