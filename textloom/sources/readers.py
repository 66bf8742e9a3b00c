"""Readers for the tables the jobs start from.

Parquet is the native format; CSV and JSON are import formats.  JSON lines and
JSON arrays are split between tasks.  A CSV with line breaks inside cells cannot
be, so large inputs belong in another format.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.jsonx import is_object, parse_strict
from textloom.functions.text import is_blank, trim_ws
from textloom.operators.once import add_once
from textloom.plans.classify import clean_rows
from textloom.plans.faq import with_chunk_id
from textloom.sources.json_array import json_array_elements


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV by its extension, Parquet otherwise; every CSV cell is text unless
    a schema says more."""
    if not path.rstrip("/").lower().endswith(".csv"):
        return spark.read.parquet(path)
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("encoding", "UTF-8")
    )
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def need_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_documents(
    spark: SparkSession, path: str, id_column: str = "ID", text_column: str = "TEXT", order_column: str | None = None
) -> DataFrame:
    """``doc_id, text``: trimmed, blank rows dropped.

    ``order_column`` adds a number that increases in file order, for a sink
    that is to keep it.  It is taken at the scan; it is no stable key.
    """
    df = need_columns(read_table(spark, path), [id_column, text_column])
    if order_column is None:
        return clean_rows(df, id_column, text_column)
    ordered = df.withColumn(order_column, F.monotonically_increasing_id())
    return clean_rows(ordered, id_column, text_column, keep=[order_column])


def read_issue_texts(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` as they are; the id stays text."""
    df = need_columns(read_table(spark, path), ["id", "text"])
    return df.select(F.col("id").cast("string").alias("id"), "text")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``text, chunk_id``; the chunk id is derived where it is absent."""
    df = with_chunk_id(need_columns(read_table(spark, path), ["text"]))
    return df.select("text", F.col("chunk_id").cast("string").alias("chunk_id"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, page_number, text, length``."""
    df = need_columns(read_table(spark, path), ["doc_name", "page_number", "text"])
    return df.select(
        "doc_name", F.col("page_number").cast("int").alias("page_number"), "text", F.length("text").alias("length")
    )


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """Question-answer table, with its vectors in the same rows if it has any."""
    df = need_columns(read_table(spark, path), ["source_text", "chunk_id", "question", "answer"])
    return df.withColumn("chunk_id", F.col("chunk_id").cast("string"))


# Catalogues -------------------------------------------------------------------
def class_catalogue(rows: Sequence[Mapping[str, str]]) -> list[dict[str, str]]:
    """Classes from configuration: members trimmed, at least one class."""
    if not rows:
        raise ValueError("the class catalogue is empty")
    return [{k: str(v).strip() for k, v in row.items()} for row in rows]


def read_classes(spark: SparkSession, path: str, max_classes: int = 10_000) -> list[dict[str, str]]:
    """Classes from a file.  The whole list goes into every prompt, so it is
    small by nature; a longer one is an error, not a cut.  Rows are sorted."""
    rows = read_table(spark, path).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    rows.sort(key=lambda r: tuple(map(str, r)))  # the list is part of every prompt, so its order must not follow the files
    return class_catalogue([{k: v for k, v in r.asDict().items() if v is not None} for r in rows])


# JSON records -----------------------------------------------------------------
def read_records(spark: SparkSession, path: str, bad: str = "fail", by_extension: bool = False) -> DataFrame:
    """``record`` (variant) from a JSON array or JSON lines.

    The shape is told by the first character, or by the extension (``.json``
    is an array, ``.jsonl`` lines, anything else refused).  ``bad``: a line
    that is not an object stops the job (``fail``), is dropped (``skip``), or
    stays with its raw text and ``ok = false`` (``keep``).
    """
    if bad not in ("fail", "skip", "keep"):
        raise ValueError("bad is fail, skip or keep")
    if by_extension:
        name = path.rstrip("/").lower()
        if not name.endswith((".json", ".jsonl")):
            raise ValueError("records must be .json or .jsonl")
        whole = name.endswith(".json")
    else:
        head = spark.read.text(path).filter(~is_blank(F.col("value"))).select(trim_ws(F.col("value"))).first()
        whole = head is not None and head[0].startswith("[")
    if whole:
        parsed = add_once(json_array_elements(spark, path), F.struct(parse_strict(F.col("raw")).alias("_parsed")))
        broken = F.raise_error(F.concat(F.lit("the input must be a JSON list; not an element: "), F.col("raw"))).cast("variant")
        rows = parsed.select(F.coalesce("_parsed", broken).alias("record")).withColumn("raw", F.to_json("record"))
    else:
        raw = spark.read.text(path).filter(~is_blank(F.col("value"))).withColumnRenamed("value", "raw")
        rows = add_once(raw, F.struct(parse_strict(F.col("raw")).alias("record"))).select("record", "raw")
    rows = rows.withColumn("ok", is_object(F.col("record")))
    if bad == "keep":
        return rows
    if bad == "skip":
        return rows.filter("ok").select("record")
    failed = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("raw"))).cast("variant")
    return rows.select(F.when(F.col("ok"), F.col("record")).otherwise(failed).alias("record"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Multi-label results: ``doc_id, relevant_classes``."""
    schema = "doc_id string, relevant_classes array<struct<class_id:string,justification:string>>"
    return spark.read.schema(schema).json(path)


# Projects and summaries -------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def find_projects(spark: SparkSession, bases: Sequence[str], marker: str = "faq.csv") -> DataFrame:
    """Sorted ``project_path`` of every folder below the bases that holds the
    marker file.  Files are listed, not read; a missing base is a warning."""
    found = spark.createDataFrame([], "project_path string")
    for base in bases:
        if not path_exists(spark, base):
            warnings.warn(f"path does not exist: {base}", stacklevel=2)
            continue
        listed = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker)
            .load(base).select(F.regexp_replace("path", "/[^/]*$", "").alias("project_path"))
        )
        found = found.unionByName(listed)
    return found.distinct().orderBy("project_path")


def partition_projects(spark: SparkSession, path: str, columns: Sequence[str] = ("project",)) -> DataFrame:
    """Projects of a table partitioned by them; only partition values are read."""
    return spark.read.parquet(path).select(*columns).distinct().orderBy(*columns)


def read_summary(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An earlier summary, or no rows when there is none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
