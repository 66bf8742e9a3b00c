"""Unions of question-answer sets, their counts, and summary merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_personas(sets: Mapping[str, DataFrame | None]) -> DataFrame:
    """Union of per-persona sets in the given order; missing ones are skipped."""
    return _union_all([df for df in sets.values() if df is not None])


def merge_sources(sets: Mapping[str, DataFrame | None]) -> DataFrame:
    """Union of per-course sets; a set without ``course`` takes its name."""
    return _union_all([with_course(df, name) for name, df in sets.items() if df is not None])


def with_course(df: DataFrame, name: str) -> DataFrame:
    return df if "course" in df.columns else df.withColumn("course", F.lit(name))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def distinct_chunks(faq: DataFrame) -> DataFrame:
    """Distinct ``(text, chunk_id)`` pairs behind a question-answer set."""
    return faq.select(F.col("source_text").alias("text"), "chunk_id").distinct()


def add_unseen(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows as they are, new rows only where the key is unseen."""
    unseen = new.join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(unseen, allowMissingColumns=True)
