"""Sinks.  Order is a column, not a file position; nothing is gathered into
one file.

Tables that are partitioned by a column are clustered first: the bytes of each
group are counted, a group of up to ``file_bytes`` goes to one task and so to one
file, a larger one is dealt to as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order_by: str | None = None, keep_nulls: bool = True, mode: str = "error") -> None:
    """JSON lines in UTF-8; ``order_by`` range-sorts the output files."""
    out = df.orderBy(order_by) if order_by else df
    out.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


#: Bytes of a group, as JSON text, that one file may hold.
FILE_BYTES = 256 << 20


def clustered(df: DataFrame, by: Sequence[str], file_bytes: int = FILE_BYTES) -> DataFrame:
    """``df`` dealt out so that ``partitionBy(*by)`` writes at most ``ceil(bytes / file_bytes)`` files a group."""
    group = F.struct(*by)  # equal to itself where a column is null
    bytes_ = F.octet_length(F.to_json(F.struct(*df.columns)))
    sizes = df.groupBy(group.alias("_group")).agg(F.ceil(F.sum(bytes_) / file_bytes).cast("int").alias("_files"))
    large = sizes.where(F.col("_files") > 1)
    salt = F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.coalesce(F.col("_files"), F.lit(1)))
    salted = df.withColumn("_group", group).join(large, "_group", "left").withColumn("_salt", salt)
    return salted.repartition("_group", "_salt").select(*df.columns)


def write_faq(faq: DataFrame, path: str, mode: str = "error", file_bytes: int = FILE_BYTES) -> None:
    """Question-answer table, prunable by course and persona."""
    by = ("course", "persona")
    clustered(faq, by, file_bytes).write.mode(mode).partitionBy(*by).parquet(path)


def write_embedded(faq: DataFrame, path: str, mode: str = "error") -> None:
    """Rows with the vector in the same row: nothing to keep aligned."""
    faq.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode(mode).parquet(path)


def write_details(
    details: DataFrame, path: str, by: Sequence[str] = ("project",), mode: str = "error", file_bytes: int = FILE_BYTES
) -> None:
    """Evaluation rows by project; judge fields only where they exist."""
    clustered(details, by, file_bytes).write.mode(mode).partitionBy(*by).option("ignoreNullFields", True).json(path)


def write_summaries(summaries: DataFrame, path: str, by: str = "parent", mode: str = "error", file_bytes: int = FILE_BYTES) -> None:
    clustered(summaries, [by], file_bytes).write.mode(mode).partitionBy(by).json(path)


def write_merged(projects: DataFrame, path: str, read_from: str | None = None, mode: str = "error") -> None:
    """Merged summary rows, never over the path they are being read from."""
    if read_from is not None and read_from.rstrip("/") == path.rstrip("/"):
        raise ValueError("write the merged summary to a new path")
    projects.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_texts(examples: DataFrame, path: str, column: str = "text", mode: str = "error") -> None:
    """One JSON line per training text, so texts with line breaks stay whole."""
    examples.select(column).write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON arrays in UTF-8, one whole array in each file: an element a line, after a comma from the second on."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(lead + text)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]" if lead == "[" else "]"])})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(listed, "value string").write.mode(mode).text(path)
