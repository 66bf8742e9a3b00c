"""Cells and buckets: how row groups ask questions about keys that all rows share.

A *cell* is a hash group of documents, a *bucket* a hash group of keys.  Cells
send their distinct keys to buckets as packed arrays (a few bytes a key instead
of a row), a bucket sees what all cells sent for its keys and answers in the
order of the question.  A key that a third of all rows hold is sent once a cell.
Both counts follow the counted bytes of the data and not a setting.  Each cell sends
to each bucket, so messages grow with the square of the cells; a cell therefore grows with the root of the
data, which keeps some hundreds of keys in a message, up to what one task should hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import ensure_checkpoint_dir

MESSAGE = pa.schema([("to", pa.int32()), ("cell", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
MESSAGE_DDL = "to int, cell int, kind int, data binary"


#: Cells and buckets at least, and bytes of text in a cell: at least, and at most.
LEAST, CELL_BYTES = 64, (2 << 20, 64 << 20)
_MESSAGE_BYTES = 3072  # some 500 keys of six bytes


def group_counts(size: int | None) -> tuple[int, int]:
    """Cells and buckets for so many bytes of text."""
    size = int(size or 0)
    cells = max(LEAST, -(-size // min(max(CELL_BYTES[0], isqrt(_MESSAGE_BYTES * size)), CELL_BYTES[1])))
    return cells, max(LEAST, cells // 2)


def text_bytes(docs: DataFrame, text: str) -> int | None:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0]


def cell_of(count: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def in_cells(df: DataFrame, count: int, key: str) -> DataFrame:
    """``df`` with its cell, dealt out by it.  Reused by every step of a plan that reads it."""
    return df.withColumn("cell", cell_of(count, key)).repartition("cell")


def messages(to: np.ndarray, cell: np.ndarray, kind: int, data: list[bytes]) -> pa.Table:
    n = len(data)
    wide = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), n))
    return pa.table([wide(to), wide(cell), wide(kind), pa.array(data, pa.binary())], schema=MESSAGE)


def split_by(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by group, the groups present and the cuts between them."""
    order = np.argsort(groups, kind="stable")
    present, first = np.unique(groups[order], return_index=True)
    return order, present, np.r_[first, len(groups)]


def bucket_of(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def ask(sent: DataFrame, reduce: Callable[[pa.Table], pa.Table], schema: str = MESSAGE_DDL) -> DataFrame:
    """Messages grouped by bucket (``to``), answered by ``reduce``."""
    return sent.groupBy("to").applyInArrow(reduce, schema)


def heard(docs: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each cell's rows beside the messages that came back to it."""
    return docs.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(fn, schema)


def answered(right: pa.Table, kind: int) -> dict[int, bytes]:
    """Answers of one kind, by the bucket that gave them."""
    own = right.filter(pa.compute.equal(right["kind"], kind))
    return dict(zip(own["to"].to_pylist(), own["data"].to_pylist()))


def with_fields(schema: T.StructType, **fields: str) -> T.StructType:
    """A new schema with columns appended (``StructType.add`` changes the one that a DataFrame caches)."""
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields.items()))
    return T.StructType([*schema.fields, *added.fields])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it while a column of ``df`` begins so."""
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted += "_"
    return wanted


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: the work is done once, lineage ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
