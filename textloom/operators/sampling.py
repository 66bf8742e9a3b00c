"""Seeded samples and previews: the limit is the feature here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.numbering import hash_order, number_rows

#: Points of the sketch that looks for a threshold: it is off by a row in so many.
SKETCH = 10_000


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, by: str | None = None) -> DataFrame:
    """``n`` rows by seeded hash order, per ``by`` value when given.

    Fewer rows come back whole.  The rank filter lets Spark cut each map
    partition to ``n`` rows per group before the shuffle, hot groups included.
    A sample of the whole table is cut by a threshold of the hash, see :func:`first_n`.
    """
    order = [hash_order(F.col(key), seed), F.col(key)]
    if by is None:
        # fifteen hexadecimal digits as a number: the order of the digest, where they differ
        place = F.conv(F.substring(order[0], 1, 15), 16, 10).cast("long")
        hashed = df.withColumn("_place", place).withColumn("_hash", order[0])
        return _smallest(hashed, n, "_place", ["_hash", key]).select(*df.columns)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def preview(df: DataFrame, n: int = 5, seed: int | None = None) -> DataFrame:
    """A few random rows to look at."""
    return df.orderBy(F.rand() if seed is None else F.rand(seed)).limit(n)


def first_n(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """The first ``n`` records by an explicit order key; all when ``n`` is None.

    Equal keys are ordered by a hash of the row.  No task gathers the ``n`` rows.
    """
    if n is None:
        return df
    tie = F.xxhash64(F.to_json(F.struct(*df.columns)))
    return _smallest(df.withColumn("_tie", tie), n, key, ["_tie"]).select(*df.columns)


def _smallest(df: DataFrame, n: int, key: str, ties: list[str]) -> DataFrame:
    """The ``n`` smallest rows by ``key`` and ``ties``.

    A quantile sketch of a numeric key gives a threshold that at least ``n`` rows pass and few
    more; those are numbered over ranges, and the numbers make the exact cut.  Null keys come first.
    """
    if n <= 0:
        return df.limit(0)
    kind = df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        total = df.count()
        share = n / max(total, 1) + 2 / SKETCH
        if share < 1:
            edge = df.agg(F.percentile_approx(key, share, SKETCH)).first()[0]
            passing = df.where(F.col(key).isNull() | (F.col(key) <= F.lit(edge))) if edge is not None else df
            df = passing if passing.count() >= n else df
    return number_rows(df, [], [key, *ties], "_number").where(F.col("_number") <= n).drop("_number")
