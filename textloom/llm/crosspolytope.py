"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (three rounds of random signs
and a Hadamard transform) and falls to the nearest signed axis.  A bucket of a
table is the axes of ``depth`` such turns together; ``tables`` of them are made, each
vector lies in one bucket of each, and a question probes the ``probes`` buckets of a table
whose axes lie nearest to it.  Buckets that meet are scored exactly, and a
question's best ones of all buckets are merged.

``depth`` follows the number of vectors (a bucket holds ``bucket_rows`` of them or
more on average).  ``probes`` is fitted: for at most ``sample`` questions, chosen by hash,
the true neighbours are found by one scan, and it is the least number that reaches
``recall`` on them.  All else covers every vector.  Buckets that hold more than
``block_rows`` are cut into blocks, those with more than ``pack_rows`` questions into packs, and every
block meets every pack, so a group is bounded also where a third of all vectors point the same way.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
elements takes no part, and neither does a row without an id; of rows that share an id the
one with the least vector counts; of equal vectors only the ``k + 1`` smallest ids are candidates, as
the others cannot be among the best; equal scores go by id; an empty table gives an empty
table; vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.cells import store

_TURNS = 3
_FOUND = "query_id long, vec_id long, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Scores of matrix products this near to the last place are worked out again, one by one.
_NEAR = 1e-9
#: Cells of a product held at once.
_CELLS = 4_000_000


@dataclass(frozen=True)
class Index:
    """Parameters of the tables; equal ones give equal buckets on any machine."""

    dim: int
    tables: int = 3
    depth: int = 1
    probes: int = 16
    seed: int = 7
    block_rows: int = 8192
    pack_rows: int = 4096

    @property
    def width(self) -> int:
        return 1 << max(0, (self.dim - 1).bit_length())

    def signs(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.choice(np.array([-1.0, 1.0]), (self.tables, self.depth, _TURNS, self.width))


# Vectors ---------------------------------------------------------------------
def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lengths = np.unique(np.diff(np.asarray(column.offsets)))
    if len(lengths) > 1 or dim is not None and len(lengths) and lengths[0] != dim:
        raise ValueError(f"vectors of different lengths: {[*lengths, dim]}")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), lengths[0] if len(lengths) else dim or 0)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of summation that no batching changes."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec`` of the vectors that have a direction, one row an id."""
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch["vec"]), 0))
            if not batch.num_rows:
                continue
            flat = np.asarray(batch["vec"].flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
            offsets = np.asarray(batch["vec"].offsets)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.add.reduceat(flat * flat, offsets[:-1] - offsets[0])
            yield batch.filter(pa.array(np.isfinite(norm) & (norm > 0)))

    given = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"))
    able = given.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).mapInArrow(keep, f"id long, vec array<{kind}>")
    return able.groupBy("id").agg(F.min("vec").alias("vec"))


# Hashing ---------------------------------------------------------------------
def hadamard(m: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, scaled to keep lengths."""
    rows, n = m.shape
    half = 1
    while half < n:
        pairs = m.reshape(rows, n // (2 * half), 2, half)
        m = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return m / np.sqrt(n)


def turned(units: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(units), signs.shape[-1]))
    out[:, : units.shape[1]] = units
    for turn in signs:
        out = hadamard(out * turn)
    return out


def buckets(units: np.ndarray, index: Index) -> np.ndarray:
    """``(rows, tables)``: the bucket of each vector in each table."""
    out, rows = np.zeros((len(units), index.tables), np.int64), np.arange(len(units))
    for t, table in enumerate(index.signs()):
        for signs in table:
            x = turned(units, signs)
            axis = np.abs(x).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * index.width) + 2 * axis + (x[rows, axis] < 0)
    return out


def probed(units: np.ndarray, index: Index, probes: int) -> np.ndarray:
    """``(rows, tables, probes)``: the buckets nearest to each question, nearest first; -1 where there are no more.

    An axis costs the squared gap to the nearest one; costs of the turns of a bucket add up.
    """
    wide, most = 2 * index.width, min(probes, (2 * index.width) ** index.depth)
    out = np.full((len(units), index.tables, probes), -1, np.int64)
    for t, table in enumerate(index.signs()):
        cost, names = np.zeros((len(units), 1)), np.zeros((len(units), 1), np.int64)
        for signs in table:
            x = turned(units, signs)
            both = np.stack([x, -x], axis=2).reshape(len(units), wide)
            gap = (both.max(axis=1, keepdims=True) - both) ** 2
            sums = (cost[:, :, None] + gap[:, None, :]).reshape(len(units), -1)
            all_names = (names[:, :, None] * wide + np.arange(wide)).reshape(len(units), -1)
            order = np.argsort(sums, axis=1, kind="stable")[:, :most]
            cost, names = np.take_along_axis(sums, order, axis=1), np.take_along_axis(all_names, order, axis=1)
        out[:, t, : names.shape[1]] = names[:, :probes]
    return out


# Scoring ---------------------------------------------------------------------
def best_pairs(qids: np.ndarray, qm: np.ndarray, cids: np.ndarray, cm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the ``k`` nearest candidates of each question, its own id apart: ``question row, candidate row, score``.

    A matrix product names them, with all that come within ``_NEAR`` of the last one; their scores are then worked out pair by pair.
    """
    qu, cu = unit(qm), unit(cm)
    found = []
    step = max(1, _CELLS // max(1, len(cids)))
    for at in range(0, len(qids), step):
        s = qu[at : at + step] @ cu.T
        s[qids[at : at + step, None] == cids[None, :]] = -np.inf
        edge = np.partition(s, -k, axis=1)[:, -k] if len(cids) > k else np.full(len(s), -2.0)
        q, c = np.nonzero((s >= edge[:, None] - _NEAR) & np.isfinite(s))
        found.append((q + at, c))
    q, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    score = cosines(qm[q], cm[c])
    order = np.lexsort((cids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], c[rank < k], score[rank < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best of each question, each candidate once."""
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def exact_neighbors(vectors: DataFrame, ids: np.ndarray, vecs: np.ndarray, k: int) -> DataFrame:
    """The true ``k`` nearest of a bounded set of questions, by one scan of ``id, vec``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cids = batch["id"].to_numpy()
                q, c, score = best_pairs(ids, vecs, cids, matrix(batch["vec"], vecs.shape[1]), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(cids[c]), pa.array(score)], schema=_FOUND_ARROW)

    return ranked(vectors.mapInArrow(scan, _FOUND), k)


# Index and search ------------------------------------------------------------
def fit(vectors: DataFrame, questions: Column, k: int, recall: float = 0.97, sample: int = 256, bucket_rows: int = 256, **fixed) -> Index | None:
    """An index over ``id, vec`` for the questions that ``questions`` picks; None where there are none.

    Reads at most ``sample`` questions and their ``k`` neighbours to the driver.
    """
    asked = vectors.where(questions).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not len(asked):
        return None
    n, ids, vecs = vectors.count(), asked["id"].to_numpy(), matrix(asked["vec"])
    width = 2 * Index(vecs.shape[1]).width
    depth = max(1, int(np.log(max(n / bucket_rows, 1)) / np.log(width))) if width > 2 else 1
    index = Index(vecs.shape[1], depth=depth, **fixed)
    true = exact_neighbors(vectors, ids, vecs, k).toArrow()
    if not len(true):
        return index
    theirs = vectors.where(F.col("id").isin(true["vec_id"].unique().to_pylist())).toArrow()
    spots = dict(zip(theirs["id"].to_pylist(), buckets(unit(matrix(theirs["vec"], index.dim)), index)))
    want: dict[int, list[np.ndarray]] = {}
    for q, c in zip(true["query_id"].to_pylist(), true["vec_id"].to_pylist()):
        want.setdefault(q, []).append(spots[c])
    probes, most = index.probes, width**depth
    while True:  # each turn looks at four times as many buckets
        probes = min(probes, most)
        met = np.zeros(probes)
        for rows in _slices(len(ids), index, probes):
            for q, ways in zip(ids[rows].tolist(), probed(unit(vecs[rows]), index, probes)):
                met += (ways[None] == np.array(want[q])[:, :, None]).any(axis=1).cumsum(axis=1).astype(bool).sum(axis=0) if q in want else 0
        enough = np.flatnonzero(met >= recall * len(true))
        if len(enough) or probes == most:
            return Index(index.dim, depth=depth, probes=int(enough[0]) + 1 if len(enough) else most, **fixed)
        probes *= 4


def _slices(rows: int, index: Index, probes: int) -> Iterator[slice]:
    """Slices of rows whose probe costs take a bounded number of cells."""
    step = max(1, _CELLS // (2 * index.width * (max(probes, 1) if index.depth > 1 else 1)))
    return (slice(at, at + step) for at in range(0, rows, step))


def _in_buckets(vectors: DataFrame, index: Index, probes: int = 0, whole: bool = True) -> DataFrame:
    """A row for each table (and probe): ``tab, bucket, id`` and, if ``whole``, ``vec``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch.num_rows, index, probes):
                part = batch.slice(rows.start, rows.stop - rows.start)
                units = unit(matrix(part["vec"], index.dim))
                names = probed(units, index, probes) if probes else buckets(units, index)[:, :, None]
                row, table, place = np.nonzero(names >= 0)
                columns = [pa.array(table.astype(np.int32)), pa.array(names[row, table, place]), part["id"].take(pa.array(row))]
                if whole:
                    columns.append(part["vec"].take(pa.array(row)))
                yield pa.RecordBatch.from_arrays(columns, names=["tab", "bucket", "id", "vec"][: len(columns)])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.mapInArrow(run, "tab int, bucket long, id long" + f", vec {kind}" * whole)


def _cuts(rows: DataFrame, most: int, out: str) -> DataFrame:
    """``tab, bucket`` and the number of cuts of the buckets with over ``most`` rows."""
    sizes = rows.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return store(sizes.select("tab", "bucket", F.ceil(F.col("n") / most).cast("int").alias(out)), f"polytope-{out}")


def _candidates(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` without the rows that ``k + 1`` equal vectors of smaller ids come before."""
    marked = vectors.withColumn("h", F.xxhash64("vec"))
    crowded = store(marked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h"), "polytope-equal")
    smallest = Window.partitionBy("h", "vec").orderBy("id")
    first = marked.join(crowded, "h", "left_semi").withColumn("_copy", F.row_number().over(smallest)).where(F.col("_copy") <= k + 1)
    return marked.join(crowded, "h", "left_anti").select("id", "vec").union(first.select("id", "vec"))


def search(vectors: DataFrame, questions: Column, index: Index, k: int) -> DataFrame:
    """The ``k`` nearest found of every question; candidates are all rows of ``id, vec`` but the question's own."""
    held, asked = _candidates(vectors, k), vectors.where(questions)
    cuts = (
        (_cuts(_in_buckets(held, index, whole=False), index.block_rows, "blocks"), "blocks"),
        (_cuts(_in_buckets(asked, index, index.probes, whole=False), index.pack_rows, "packs"), "packs"),
    )
    spot = ["tab", "bucket", "blocks", "packs"]

    def placed(rows: DataFrame, own: str) -> DataFrame:
        """A row goes to its own cut of its side and to every cut of the other side."""
        for table, cut in cuts:
            rows = rows.join(table, ["tab", "bucket"], "left")
            many = F.coalesce(F.col(cut), F.lit(1))
            rows = rows.withColumn(cut, F.pmod(F.xxhash64("id"), many).cast("int") if cut == own else F.explode(F.sequence(F.lit(0), many - 1)))
        return rows.select(*spot, "id", "vec")

    holding, asking = placed(_in_buckets(held, index), "blocks"), placed(_in_buckets(asked, index, index.probes), "packs")

    def meet(asking: pa.Table, holding: pa.Table) -> pa.Table:
        if not len(asking) or not len(holding):
            return _FOUND_ARROW.empty_table()
        qids, cids = asking["id"].to_numpy(), holding["id"].to_numpy()
        q, c, score = best_pairs(qids, matrix(asking["vec"], index.dim), cids, matrix(holding["vec"], index.dim), k)
        return pa.table([pa.array(qids[q]), pa.array(cids[c]), pa.array(score)], schema=_FOUND_ARROW)

    return ranked(asking.groupBy(*spot).cogroup(holding.groupBy(*spot)).applyInArrow(meet, _FOUND), k)


def nearest(df: DataFrame, questions: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows of ``df`` that ``questions`` (a condition on ``id``) picks."""
    vectors = store(valid_vectors(df, key, vector), "polytope-vectors")
    index = fit(vectors, questions, k, **settings)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(vectors, questions, index, k)
