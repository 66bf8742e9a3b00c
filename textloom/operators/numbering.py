"""Row numbers within a key that do not put a whole key into one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import ensure_checkpoint_dir


def range_key(keys: Sequence[str], at: Column) -> Column:
    """Partition key of an order range: the keys and the range number.

    As a struct it is equal to itself even where a key is null, so windows and
    joins on it share one exchange.
    """
    return F.struct(*keys, at.cast("long").alias("range"))


def written(df: DataFrame, name: str, *apart: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: computed once, and lineage ends.

    Rows that differ in the columns ``apart`` are in different files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*apart).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shifted(df: DataFrame, part: str, keys: Sequence[str], local: str, out: str) -> DataFrame:
    """Numbers within order ranges made numbers within ``keys``.

    ``part`` is a :func:`range_key`, ``local`` counts from 1 inside it; earlier ranges of the
    same keys shift a row by their size, which is a small table.
    """
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*[F.col(part)[k] for k in keys])
        .orderBy(F.col(part)["range"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select(part, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    return df.join(shifts, part).withColumn(out, (F.col(local) + F.col("_shift")).cast("long")).drop("_shift")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, out: str, range_rows: int = 65_536) -> DataFrame:
    """1-based position of each row within ``keys`` by ``order``; the numbered rows are written once.

    Rows are range-sorted by keys and order, in as many ranges as their number asks for, whatever the
    values of the order are.  A row's place in its range is shifted by what the earlier ranges hold of its key.
    So a key with a third of all rows, or with all of them, is spread over many tasks.  ``order`` must be
    unique within a key for the numbers to be fixed.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = [*keys, *order]
    ranges = max(1, -(-df.count() // range_rows))
    cut = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    key = F.struct(*keys) if keys else F.lit(0)
    laid = written(
        cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", key).withColumn("_range", F.spark_partition_id()), "numbered"
    )
    # within a range the rows of a key lie side by side
    sizes = laid.groupBy("_range", "_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    joined = laid.join(sizes.select("_range", "_key", shift.alias("_shift")), ["_range", "_key"])
    return joined.withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).select(*df.columns, out)


def hash_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order that no partitioning can change."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
