"""Exact top-k by cosine similarity for a whole table of questions.

Scores are compared after rounding to ``SCORE_DECIMALS``; equal scores are
ordered by the id.  So the result does not depend on summation order.

Two ways to the same rows, by ``method``:

* ``scan``: every question meets every row of its group.  A question matrix of up to
  ``broadcast_bytes`` goes to every task, the corpus is scanned once and never
  shuffled, each task keeps its running top-k; a larger one meets the corpus in tiles;
* ``cells``, for many questions: the corpus is cut into cells around pivot
  vectors, and a question visits only the cells that can hold one of its k
  nearest (angles obey the triangle inequality, so the cut is exact).

A tile is a bounded part of the corpus (whole cells, or a part of a large one) that meets a
bounded pack of questions.  Its size follows from bytes, so what is shuffled is a row once for
each tile or pack of the other side, and not once for each block of a matrix product.  In a tile
the products are small blocks, and of a block only the scores are looked at that reach the k-th best so far.

Without a method the counted size of the question table decides.  No pair of
vectors is ever a row of a DataFrame, only top-k rows leave a task, and they
are merged as a tree: first those of a group of tasks, then those of all groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SCORE_DECIMALS = 9
#: Added to a pruning angle: covers the rounding above near angle zero.
ANGLE_SLACK = 1e-4
#: Cells of a block product: bounds the score matrix a task holds.
PRODUCT_CELLS = 4_000_000
#: Questions that are routed at once or meet a part of a tile at once, and rows of such a part.
STEP_ROWS = 1024
PART_ROWS = 512
#: Questions of a step that share a box.
RUN_ROWS = 64
#: Main axes of a tile on which scores are bounded, and rows that tell them.
AXES = 24
AXES_ROWS = 8192
#: Products that are made whole before a bound is tried again, at most.
WAIT = 7
#: What rounding may take from a score that decides which pairs are looked at.
ROUNDING = 2 * 10.0**-SCORE_DECIMALS
#: Rounding of a float32, and what it may add to a distance of coordinates.
UNIT = 2.0**-24
NEAR_SLACK = 1e-5


@dataclass(frozen=True)
class KnnSizes:
    """Size bounds.  None of them changes the result.

    ``tile_bytes`` bounds the vectors of one side of a tile; ``block_rows`` and ``pack_rows``
    are the least that a tile of the corpus and a pack of questions is cut to.
    """

    broadcast_bytes: int = 8 << 20
    tile_bytes: int = 96 << 20
    block_rows: int = 8192
    pack_rows: int = 4096
    max_pivots: int = 256
    max_cells: int = 100_000
    merge_nodes: int = 16
    scan_waves: int = 4


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    corpus_id: str = "faq_id",
    vector: str = "embedding",
    within: str | None = None,
    exclude_self: bool = False,
    sizes: KnnSizes = KnnSizes(),
    method: str | None = None,
) -> DataFrame:
    """``query_id, [within,] corpus_id, rank, score`` of the k best per query.

    ``method``: ``scan``, ``cells``, or None for the counted size to decide.

    ``within`` restricts each query to corpus rows of the same group;
    ``exclude_self`` drops the corpus row whose id equals the query's.
    Ids must be unique on either side (the corpus side: within a group); the
    group comes back as text.  Both tables are read more than once, so a table
    that is costly to compute should be written first.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if method not in (None, "scan", "cells"):
        raise ValueError("method is scan, cells or None")
    q = _shape(queries, query_id, vector, within)
    c = _shape(corpus, corpus_id, vector, within)
    facts = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n_queries, dim = facts["n"], facts["dim"] or 0
    out = found_schema(q, c)
    few = n_queries * max(dim, 1) * 8 <= sizes.broadcast_bytes
    if few and method != "cells":
        found = _scan(q, c, k, exclude_self, out, sizes)
    elif method == "scan":
        found = _group_tiles(q, c, k, exclude_self, out, dim, sizes)
    else:
        found = _cell_tiles(q, c, k, exclude_self, out, dim, sizes)
    ranked = merge_best(found, k, out, -(-n_queries // sizes.pack_rows), sizes.merge_nodes)
    group = [F.col("grp").alias(within)] if within else []
    return ranked.select(
        F.col("qid").alias(query_id), *group, F.col("cid").alias(corpus_id if corpus_id != query_id else "neighbor_id"),
        "rank", "score",
    )


def found_schema(q: DataFrame, c: DataFrame) -> T.StructType:
    """Best rows as tasks hand them on; ``node`` names the group of tasks they come from."""
    return T.StructType(
        [
            T.StructField("qid", q.schema["id"].dataType),
            T.StructField("grp", T.StringType()),
            T.StructField("cid", c.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("node", T.IntegerType()),
        ]
    )


def merge_best(found: DataFrame, k: int, out: T.StructType, packs: int, nodes: int) -> DataFrame:
    """``qid, grp, cid, score, rank`` of the k best of each question, each neighbour once.

    A tree of two levels: a group of the first holds what a ``1 / nodes`` part of the tasks
    found for a pack of questions, a group of the second at most k rows of each part for
    each question.  So what meets in one place does not grow with the number of tasks.
    """
    node = out["node"]
    lower = T.StructType([*out.fields, T.StructField("pack", T.LongType())])
    upper = T.StructType([*[f for f in out.fields if f is not node], T.StructField("rank", T.IntegerType())])
    pack = F.pmod(F.xxhash64("grp", "qid"), F.lit(max(1, packs)))

    def best(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
        # codes instead of values: any id type sorts, and a tie goes to the lower id
        name, ask, cid = (_codes(group.column(c)) for c in ("grp", "qid", "cid"))
        score = group.column("score").to_numpy()
        order = np.lexsort((-score, cid, ask, name))
        again = np.zeros(len(order), bool)
        again[1:] = np.all([x[order][1:] == x[order][:-1] for x in (name, ask, cid)], axis=0)
        order = order[~again]
        order = order[np.lexsort((cid[order], -score[order], ask[order], name[order]))]
        first = np.ones(len(order), bool)
        first[1:] = (ask[order][1:] != ask[order][:-1]) | (name[order][1:] != name[order][:-1])
        at = np.arange(len(order))
        rank = at - np.maximum.accumulate(np.where(first, at, 0))
        return group.take(pa.array(order[rank < k])), rank[rank < k] + 1

    def partly(group: pa.Table) -> pa.Table:
        return best(group)[0]

    def wholly(group: pa.Table) -> pa.Table:
        kept, rank = best(group)
        return kept.drop_columns(["node", "pack"]).append_column("rank", pa.array(rank.astype(np.int32)))

    rows = found.withColumn("pack", pack)
    return rows.groupBy("node", "pack").applyInArrow(partly, lower).groupBy("pack").applyInArrow(wholly, upper)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that sort as the values of a column do."""
    values = _ids(column)
    if values.dtype != object:
        return values
    names = np.sort(pa.compute.unique(column).to_numpy(zero_copy_only=False).astype(object))
    return np.searchsorted(names, values)


def _shape(df: DataFrame, id_col: str, vector: str, within: str | None) -> DataFrame:
    group = F.col(within).cast("string") if within else F.lit("")
    return df.select(
        F.col(id_col).alias("id"), group.alias("grp"), F.col(vector).cast("array<float>").alias("vec")
    ).filter(F.col("vec").isNotNull() & F.col("grp").isNotNull())


# Dense arithmetic inside a task ---------------------------------------------
def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Unit rows as float64; zero vectors stay zero, and a row with a null, NaN or infinite element holds a NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if rows == 0:
        return flat.reshape(0, 0)
    if len(flat) % rows or len(set(np.diff(np.asarray(column.offsets)))) > 1:
        raise ValueError("vectors differ in length")
    m = flat.reshape(rows, -1)
    if dim is not None and m.shape[1] != dim:
        raise ValueError("vectors differ in length")
    with np.errstate(invalid="ignore"):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.where(norm == 0, 0.0, np.nan) * np.ones_like(m), where=norm > 0)


def clean(rows, dim: int | None = None):
    """A batch or table without the vectors that have no cosine (null, NaN, infinite elements), and its matrix."""
    m = _matrix(rows.column("vec"), dim)
    good = np.isfinite(m).all(axis=1)
    return (rows, m) if good.all() else (rows.filter(pa.array(good)), m[good])


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False))


def _best(qm: np.ndarray, cm: np.ndarray, cids: np.ndarray, k: int, qids: np.ndarray | None):
    """Top-k columns per row as ``(ids, scores)``; ``-inf`` marks no entry.

    ``cids`` must be sorted, so the first of equal scores has the lowest id.
    """
    width = min(k, len(cids))
    ids = np.empty((len(qm), width), dtype=cids.dtype)
    scores = np.empty((len(qm), width))
    step = max(1, PRODUCT_CELLS // max(1, len(cids)))
    for at in range(0, len(qm), step):
        s = np.round(qm[at : at + step] @ cm.T, SCORE_DECIMALS) + 0.0
        if qids is not None:
            own = qids[at : at + step]
            spot = np.minimum(np.searchsorted(cids, own), len(cids) - 1)
            same = np.flatnonzero(cids[spot] == own)
            s[same, spot[same]] = -np.inf
        rows = np.arange(len(s))
        if width <= 16:
            for j in range(width):
                col = s.argmax(axis=1)
                ids[at : at + step, j] = cids[col]
                scores[at : at + step, j] = s[rows, col]
                s[rows, col] = -np.inf
        else:
            order = np.argsort(-s, axis=1, kind="stable")[:, :width]
            ids[at : at + step] = cids[order]
            scores[at : at + step] = np.take_along_axis(s, order, axis=1)
    return ids, scores


def _merge(a, b, k: int):
    """Best k of two ``(ids, scores)`` tables with the same rows."""
    if a is None:
        return b
    ids, scores = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _emit(qids: np.ndarray, group: str, best, schema: pa.Schema, nodes: int) -> pa.RecordBatch:
    ids, scores = best
    task = TaskContext.get()
    keep = np.isfinite(scores)
    rows = np.repeat(np.arange(len(qids)), scores.shape[1])[keep.ravel()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(qids[rows], schema.field(0).type),
            pa.array([group] * len(rows), schema.field(1).type),
            pa.array(ids.ravel()[keep.ravel()], schema.field(2).type),
            pa.array(scores.ravel()[keep.ravel()], schema.field(3).type),
            pa.array(np.full(len(rows), (task.partitionId() if task else 0) % nodes, np.int32)),
        ],
        schema=schema,
    )


def _arrow_schema(out: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out.fields])


def _by_group(groups: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    names, inverse = np.unique(groups.astype(str), return_inverse=True)
    for i, name in enumerate(names):
        yield str(name), np.flatnonzero(inverse == i)


# Few questions: one scan of the corpus --------------------------------------
def _scan(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, out: T.StructType, sizes: KnnSizes) -> DataFrame:
    table, dim = q.toArrow(), None
    shared: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if len(table):
        table, qm = clean(table)
        dim, qids = qm.shape[1], _ids(table.column("id"))
        for name, at in _by_group(_ids(table.column("grp"))):
            shared[name] = (qids[at], qm[at])
    context = q.sparkSession.sparkContext
    box = context.broadcast(shared)
    schema = _arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = box.value, {}
        for batch in batches:
            if not len(batch):
                continue
            batch, cm = clean(batch, dim)
            cids = _ids(batch.column("id"))
            for name, at in _by_group(_ids(batch.column("grp"))):
                if name not in asked:
                    continue
                at = at[np.argsort(cids[at], kind="stable")]
                qids, qm = asked[name]
                new = _best(qm, cm[at], cids[at], k, qids if exclude_self else None)
                best[name] = _merge(best.get(name), new, k)
        for name, found in best.items():
            yield _emit(asked[name][0], name, found, schema, sizes.merge_nodes)

    # A task answers every question once, so there are a few waves of tasks and not one for each split.
    return c.coalesce(sizes.scan_waves * context.defaultParallelism).mapInArrow(scan, out)


# Many questions: tiles of the corpus, packs of questions ----------------------
def tile_rows(pairs: float, dim: int, sizes: KnnSizes, slots: int) -> tuple[int, int]:
    """Rows of a tile and of a pack: as many as ``tile_bytes`` holds, fewer if that gave under three tiles a slot."""
    rows = min(sizes.tile_bytes // (4 * max(dim, 1)), int((pairs / (3 * slots)) ** 0.5))
    return max(1, sizes.block_rows, rows), max(1, sizes.pack_rows, rows)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """The cells of one group: numbers, radii, ``near`` least radii, first tile and number of tiles, packs of its questions."""

    ids: np.ndarray
    rmax: np.ndarray
    low: np.ndarray
    first: np.ndarray
    tiles: np.ndarray
    packs: int

    def in_tiles(self) -> np.ndarray:
        """``(cells, tiles)``: 1 where a cell has rows in a tile."""
        at = np.arange(int((self.first + self.tiles).max()))
        return ((at >= self.first[:, None]) & (at < (self.first + self.tiles)[:, None])).astype(np.float32)


def _laid(rows: list, near: int, per_tile: int, packs: int) -> Cells:
    """Cells in the order of their numbers: small ones share a tile, a large one has several of its own."""
    first, tiles, at, full = [], [], -1, per_tile
    for row in rows:
        own = -(-row["n"] // per_tile)
        if own > 1 or full + row["n"] > per_tile:
            at, full = at + 1, 0
        first.append(at)
        tiles.append(own)
        at, full = at + own - 1, per_tile if own > 1 else full + row["n"]
    low = np.full((len(rows), near), np.inf)
    for i, row in enumerate(rows):
        low[i, : len(row["low"])] = row["low"]
    return Cells(np.array([r["cell"] for r in rows]), np.array([r["rmax"] for r in rows]), low, np.array(first), np.array(tiles), packs)


def _cell_tiles(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, out: T.StructType, dim: int, sizes: KnnSizes) -> DataFrame:
    spark = q.sparkSession
    size = c.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("g")).first()
    if size["g"] > sizes.max_cells:
        # So many groups that no per-group table is safe to hand out: a group
        # is one cell, cut by its own size.
        return _group_tiles(q, c, k, exclude_self, out, dim, sizes)
    n_pivots = min(sizes.max_pivots, -(-size["n"] // sizes.block_rows), sizes.max_cells // max(1, size["g"]))
    n_pivots = max(1, n_pivots)
    chosen = c.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toArrow()
    if not len(chosen):
        return spark.createDataFrame([], out)
    pivots = _matrix(chosen.column("vec"))
    pivots = pivots[np.isfinite(pivots).all(axis=1)]
    if not len(pivots):
        pivots = np.eye(1, pivots.shape[1])

    near = k + 1 if exclude_self else k

    # A zero vector has no direction: the triangle inequality says nothing
    # about it, so it gets an infinite radius and its cell is always visited.
    def place(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        batch, m = clean(batch, pivots.shape[1])
        angle = _angles(m, pivots)
        cell = angle.argmin(axis=1)
        radius = angle[np.arange(len(m)), cell]
        radius[~m.any(axis=1)] = np.inf
        return batch, cell, radius

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple[int, float, np.ndarray]] = {}
        for batch in batches:
            if not len(batch):
                continue
            batch, cell, radius = place(batch)
            for name, at in _by_group(_ids(batch.column("grp"))):
                for one in np.unique(cell[at]):
                    r = radius[at[cell[at] == one]]
                    n, far, low = seen.get((name, int(one)), (0, 0.0, np.empty(0)))
                    low = np.sort(np.concatenate([low, r]))[:near]
                    seen[name, int(one)] = (n + len(r), max(far, float(r.max())), low)
        yield pa.RecordBatch.from_pydict(
            {
                "grp": pa.array([g for g, _ in seen], pa.string()),
                "cell": pa.array([c for _, c in seen], pa.int32()),
                "n": pa.array([v[0] for v in seen.values()], pa.int64()),
                "rmax": pa.array([v[1] for v in seen.values()], pa.float64()),
                "low": pa.array([v[2].tolist() for v in seen.values()], pa.list_(pa.float64())),
            }
        )

    # One pass for the statistics: a task reports each cell it saw once.
    surveyed = c.mapInArrow(survey, "grp string, cell int, n bigint, rmax double, low array<double>")
    summary = surveyed.groupBy("grp", "cell").agg(
        F.sum("n").alias("n"),
        F.max("rmax").alias("rmax"),
        F.slice(F.sort_array(F.flatten(F.collect_list("low"))), 1, near).alias("low"),
    )
    held: dict[str, list] = {}
    for row in summary.orderBy("grp", "cell").collect():  # at most max_cells rows
        held.setdefault(row["grp"], []).append(row)
    known = q.join(c.select("grp").distinct(), "grp", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    asked = {row["grp"]: row["n"] for row in known.collect()}
    pairs = float(sum(asked.get(name, 0) * sum(r["n"] for r in rows) for name, rows in held.items()))
    per_tile, per_pack = tile_rows(pairs, dim, sizes, spark.sparkContext.defaultParallelism)
    cells = {name: _laid(rows, near, per_tile, -(-asked[name] // per_pack)) for name, rows in held.items() if name in asked}
    box = spark.sparkContext.broadcast(cells)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            batch, cell, _ = place(batch)
            facts = np.zeros((3, len(cell)), np.int32)
            for name, at in _by_group(_ids(batch.column("grp"))):
                if name in box.value:
                    own = box.value[name]
                    spot = np.searchsorted(own.ids, cell[at])
                    facts[0, at], facts[1, at], facts[2, at] = own.first[spot], own.tiles[spot], own.packs
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), *[pa.array(f) for f in facts]],
                names=["id", "grp", "vec", "cell", "first", "tiles", "packs"],
            )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), STEP_ROWS):
                batch, m = clean(whole.slice(start, STEP_ROWS), pivots.shape[1])
                angle = _angles(m, pivots)
                for name, at in _by_group(_ids(batch.column("grp"))):
                    if name not in box.value:
                        continue
                    own = box.value[name]
                    theta = angle[np.ix_(at, own.ids)]
                    reach = (theta[:, :, None] + own.low).reshape(len(at), -1)
                    bound = np.partition(reach, near - 1, axis=1)[:, near - 1]
                    bound[~m[at].any(axis=1)] = np.inf
                    visits = theta - own.rmax <= bound[:, None] + ANGLE_SLACK
                    rows, tile = np.nonzero(visits.astype(np.float32) @ own.in_tiles())
                    taken = batch.take(pa.array(at[rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(bound[rows]), pa.array(tile, pa.int32()), pa.array(np.full(len(rows), own.packs, np.int32))],
                        names=["id", "grp", "vec", "bound", "tile", "packs"],
                    )

    number = T.IntegerType()
    settled = c.mapInArrow(settle, T.StructType([*c.schema.fields, *[T.StructField(f, number) for f in ("cell", "first", "tiles", "packs")]]))
    tiled = settled.where("packs > 0").select(
        "id", "grp", "vec", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("tiles"))).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"),
    )
    fields = [T.StructField("bound", T.DoubleType()), T.StructField("tile", number), T.StructField("packs", number)]
    routed = q.mapInArrow(route, T.StructType([*q.schema.fields, *fields]))
    packed = routed.withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")).cast("int")).drop("packs")
    n_tiles = sum(own.packs * int((own.first + own.tiles).max()) for own in cells.values())

    return products(packed, tiled, ["grp", "tile", "pack"], k, exclude_self, out, n_tiles, sizes.merge_nodes)


def _group_tiles(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, out: T.StructType, dim: int, sizes: KnnSizes) -> DataFrame:
    """Every question meets every row of its group; the groups are counted and never listed on the driver."""
    slots = q.sparkSession.sparkContext.defaultParallelism
    both = c.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(q.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp")
    pairs = both.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    per_tile, per_pack = tile_rows(pairs, dim, sizes, slots)
    cuts = both.select("grp", F.ceil(F.col("n") / per_tile).cast("int").alias("tiles"), F.ceil(F.col("m") / per_pack).cast("int").alias("packs"))
    n_tiles = cuts.agg(F.sum(F.col("tiles") * F.col("packs"))).first()[0] or 0

    def dealt(rows: DataFrame, own: str, mine: str, other: str, others: str) -> DataFrame:
        spot = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias(own)
        return rows.join(cuts, "grp").select("id", "grp", "vec", spot, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

    packed, tiled = dealt(q, "pack", "packs", "tile", "tiles"), dealt(c, "tile", "tiles", "pack", "packs")
    return products(packed, tiled, ["grp", "tile", "pack"], k, exclude_self, out, n_tiles, sizes.merge_nodes)


def _fewest_copies(m: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions without those that ``most`` equal vectors with lower ids stand before."""
    bits = np.ascontiguousarray(m, np.float32).view(np.uint32)
    odd = np.random.default_rng(5).integers(1, 1 << 62, bits.shape[1], np.uint64) | np.uint64(1)
    mark = np.zeros(len(bits), np.uint64)
    for i, factor in enumerate(odd):
        mark += bits[:, i] * factor
    order = np.lexsort((ids, mark))
    lone = np.ones(len(order), bool)
    lone[1:] = mark[order][1:] != mark[order][:-1]
    spot = np.flatnonzero(~lone)
    lone[spot] = (m[order[spot]] != m[order[spot - 1]]).any(axis=1)
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(lone, at, 0)) < most])


class _Best:
    """The k best of some questions: scores, and places of the rows in the order of their ids."""

    def __init__(self, rows: int, k: int):
        self.k, self.scores, self.places = k, np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        some = np.unique(row)
        row = np.concatenate([np.repeat(some, self.k), row])
        score = np.concatenate([self.scores[some].ravel(), score])
        place = np.concatenate([self.places[some].ravel(), place])
        order = np.lexsort((place, -score, row))
        kept = order[np.searchsorted(row[order], some)[:, None] + np.arange(self.k)]
        self.scores[some], self.places[some] = score[kept], place[kept]


def _rows(table: pa.Table, dim: int | None = None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A table without the vectors that have no cosine, its rows as they are in float32, and their lengths."""
    chunks = [c for c in table.column("vec").chunks if len(c)]
    for chunk in chunks:
        wide = np.diff(np.asarray(chunk.offsets))
        dim = int(wide[0]) if dim is None else dim
        if (wide != dim).any():
            raise ValueError("vectors differ in length")
    m, at = np.empty((len(table), dim or 0), np.float32), 0
    length = np.empty(len(table))
    for chunk in chunks:
        to = at + len(chunk)
        m[at:to] = np.asarray(chunk.flatten(), dtype=np.float32).reshape(len(chunk), -1)
        length[at:to], at = np.linalg.norm(m[at:to].astype(np.float64), axis=1), to
    good = np.isfinite(length)
    return (table, m, length) if good.all() else (table.filter(pa.array(good)), m[good], length[good])


class _Axes:
    """The main axes of some rows.  Coordinates are what a row has along them, and the length of what is left:
    no two rows are nearer to each other than their coordinates are."""

    def __init__(self, m: np.ndarray, length: np.ndarray):
        some = np.random.default_rng(5).choice(len(m), min(len(m), AXES_ROWS), replace=False)
        unit = m[some] / length[some, None]
        self.middle = unit.mean(axis=0)
        turned = np.linalg.eigh((unit - self.middle).T @ (unit - self.middle))[1][:, ::-1]
        self.turned = turned[:, : m.shape[1] if m.shape[1] <= 2 * AXES else AXES]

    def coordinates(self, m: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates, and the products with the middle."""
        x, along = np.empty((len(m), self.turned.shape[1] + 1), np.float32), np.empty(len(m))
        for at in range(0, len(m), 8 * STEP_ROWS):
            part = slice(at, at + 8 * STEP_ROWS)
            unit = m[part] / length[part, None]
            along[part] = unit @ self.middle
            unit -= self.middle
            own = unit @ self.turned
            x[part, 1:] = own
            x[part, 0] = np.sqrt(np.maximum(np.einsum("ij,ij->i", unit, unit) - np.einsum("ij,ij->i", own, own), 0.0))
        return x, along


def _halved(x: np.ndarray, *rows: int) -> np.ndarray:
    """An order in which each run of each number of ``rows`` lies close together: halves along the axis with most spread."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        some = todo.pop()
        if len(some) <= min(rows):
            out.append(some)
            continue
        own, run = x[some], max(r for r in rows if r < len(some))
        low = (len(some) // run + 1) // 2 * run
        cut = np.argpartition(own[:, own.var(axis=0).argmax()], low)
        todo += [some[cut[low:]], some[cut[:low]]]
    return np.concatenate(out)


def _gap(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Distances of boxes from one box."""
    return np.sqrt((np.maximum(np.maximum(low - most, least - high), 0.0) ** 2).sum(axis=1))


def _tile_best(qm, qlen, cm, clen, place: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray | None = None):
    """Best rows of a tile for each question, as ``(places, scores)``; ``-inf`` marks no entry.

    ``own`` says where a question's own row is, or -1; ``reach`` bounds the angle of each question's k-th nearest.

    Rows and questions are ordered by their coordinates on the main axes of the tile.  A run of rows is skipped by
    questions that are too far from the box of its coordinates; of the others, the coordinates give a bound of each
    score, which is a product of few columns, and only pairs whose bound reaches the k-th best so far are scored.
    Where such bounds leave too many pairs, as with vectors without main axes, whole products tell them.
    """
    places, scores = np.full((len(qm), k), np.iinfo(np.int64).max), np.full((len(qm), k), -np.inf)
    floors = np.full(len(qm), -1.5)
    if reach is not None:
        # what the k-th best score is sure to reach, less what rounding may take from it
        sure = np.isfinite(reach)
        floors[sure] = np.cos(np.minimum(reach[sure] + ANGLE_SLACK, np.pi)) - ROUNDING
    # Vectors without a direction score zero: with such a question all rows do, so the first ids win.
    first = np.argsort(place)[: k + 1]
    for i in np.flatnonzero(qlen == 0):
        some = np.sort(place[first[first != own[i]]])[:k]
        places[i, : len(some)], scores[i, : len(some)] = some, 0.0
    nowhere, live, asked = np.flatnonzero(clen == 0), np.flatnonzero(clen > 0), np.flatnonzero(qlen > 0)
    axes = _Axes(cm[live], clen[live]) if len(live) >= 4 * PART_ROWS else None
    if axes is not None and len(asked):
        x, across = axes.coordinates(cm[live], clen[live])
        order = _halved(x, PART_ROWS)
        x, across, live = x[order], across[order], live[order]
        starts = np.arange(0, len(live), PART_ROWS)
        low, high = (side.reduceat(x, starts, axis=0) for side in (np.minimum, np.maximum))
        right = np.column_stack([x, across.astype(np.float32)])
        y, along = axes.coordinates(qm[asked], qlen[asked])
        order = _halved(y, STEP_ROWS, RUN_ROWS)
        y, along, asked = y[order], along[order], asked[order]
        reachable = np.sqrt(np.einsum("ij,ij->i", right, right).max()) * np.sqrt(np.einsum("ij,ij->i", y, y).max() + 1.0)
        loose = UNIT * (right.shape[1] + 4) * reachable
        base = float(axes.middle @ axes.middle)
        few = axes.turned.shape[1] < qm.shape[1]
    else:
        starts, few = np.arange(0, len(live), PART_ROWS), False
    cm, clen, where = cm[live], clen[live], place[live]
    at = np.full(len(place), -1)
    at[live] = np.arange(len(live))
    mine = np.where(own >= 0, at[own], -1) if len(place) else own
    whole_loose, inverse = UNIT * (qm.shape[1] + 4), 1.0 / clen[:, None]
    # Products and what of them is seen go to the same memory: a block is small, so new pages cost more than the work.
    room, marks = np.empty(STEP_ROWS * PART_ROWS, np.float32), np.empty(STEP_ROWS * PART_ROWS, bool)

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))

    def reaching(s: np.ndarray, bar: np.ndarray) -> int:
        return np.count_nonzero(np.greater_equal(s, bar.astype(np.float32)[:, None], out=marks[: s.size].reshape(s.shape)))

    def marked(size: int) -> np.ndarray:
        """Where marks are set: few are, so eight are looked at at once."""
        words = -(-size // 8)
        marks[size : 8 * words] = False
        some = np.flatnonzero(marks[: 8 * words].view(np.uint64) != 0)
        at, spot = np.nonzero(marks.reshape(-1, 8)[some])
        return some[at] * 8 + spot

    for start in range(0, len(asked), STEP_ROWS):
        rows = asked[start : start + STEP_ROWS]
        raw, norm, self_at, floor = qm[rows].astype(np.float64), qlen[rows], mine[rows], floors[rows]
        unit = (raw / norm[:, None]).astype(np.float32)
        best, held, waiting, wait, skipped = _Best(len(rows), k), [], 0, 0, 0

        def settle() -> None:
            """Scores of the pairs that were told, and what the k-th best is sure to reach since."""
            row, col = (np.concatenate(part) for part in zip(*held))
            exact = np.empty(len(row))
            for step in range(0, len(row), 8 * STEP_ROWS):
                r, c = row[step : step + 8 * STEP_ROWS], col[step : step + 8 * STEP_ROWS]
                exact[step : step + 8 * STEP_ROWS] = np.einsum("ij,ij->i", raw[r], cm[c].astype(np.float64)) / (norm[r] * clen[c])
            exact = np.round(exact, SCORE_DECIMALS) + 0.0
            good = exact >= best.scores[row, k - 1]
            if good.any():
                best.add(row[good], exact[good], where[col[good]])
                np.maximum(floor, best.scores[:, k - 1] - ROUNDING, out=floor)
            held.clear()

        for i in nowhere:
            others = np.flatnonzero(own[rows] != i)
            best.add(others, np.zeros(len(others)), np.full(len(others), place[i]))
        np.maximum(floor, best.scores[:, k - 1] - ROUNDING, out=floor)
        parts, gap, reached = range(len(starts)), None, None
        if axes is not None:
            spot, least = y[start : start + STEP_ROWS], along[start : start + STEP_ROWS]
            left = np.column_stack([spot, np.ones(len(rows), np.float32)])
            least_of, most_of = spot.min(axis=0), spot.max(axis=0)
            parts = np.lexsort((((low + high - least_of - most_of) ** 2).sum(axis=1), _gap(low, high, least_of, most_of)))
            # boxes of few neighbouring questions: most parts are too far from most of them
            runs = np.arange(0, len(rows), RUN_ROWS)
            gap = np.stack([_gap(low, high, spot[r : r + RUN_ROWS].min(axis=0), spot[r : r + RUN_ROWS].max(axis=0)) for r in runs])
        for done, i in enumerate(parts):
            begin, end = starts[i], min(starts[i] + PART_ROWS, len(cm))
            asks = np.arange(len(rows))
            if gap is not None:
                if reached is None:
                    reached = np.sqrt(np.maximum(2.0 - 2.0 * floor, 0.0)) + NEAR_SLACK
                    furthest = np.maximum.reduceat(reached, runs)
                open_runs = gap[:, i] <= furthest
                if not open_runs.any():
                    continue
                asks = np.flatnonzero(np.repeat(open_runs, RUN_ROWS)[: len(rows)])
                out = spot[asks]
                np.maximum(low[i] - out, out - high[i], out=out)
                np.maximum(out, 0.0, out=out)
                asks = asks[np.einsum("ij,ij->i", out, out) <= reached[asks] ** 2]
                if not len(asks):
                    continue
            size, bounded = len(asks) * (end - begin), False
            if few and done and skipped >= wait:
                bounded = reaching(times(left[asks], right[begin:end]), floor[asks] - least[asks] + base - loose) <= size // 100
                wait, skipped = (0, 0) if bounded else (min(WAIT, 2 * wait + 1), 0)
            if not bounded:
                skipped += 1
                s = times(unit[asks], (cm[begin:end] * inverse[begin:end]).astype(np.float32))
                in_it = np.flatnonzero((self_at[asks] >= begin) & (self_at[asks] < end))
                s[in_it, self_at[asks[in_it]] - begin] = -3.0
                if reaching(s, floor[asks] - whole_loose) > 2 * k * len(asks) and end - begin > k:
                    kth = np.partition(s, end - begin - k, axis=1)[:, end - begin - k]
                    floor[asks], reached = np.maximum(floor[asks], kth - whole_loose - ROUNDING), None
                    reaching(s, floor[asks] - whole_loose)
            row, col = np.divmod(marked(size), end - begin)
            row, col = asks[row], begin + col
            if bounded and len(row):
                near = ~(np.einsum("ij,ij->i", unit[row], cm[col]) * inverse[col, 0] < floor[row] - 2 * whole_loose)
                near &= col != self_at[row]
                row, col = row[near], col[near]
            if len(row):
                held.append((row, col))
                waiting += len(row)
            if held and (waiting >= 4 * STEP_ROWS or done < 4):
                settle()
                waiting, reached = 0, None
        if held:
            settle()
        places[rows], scores[rows] = best.places, best.scores
    return places, scores


def products(
    routed: DataFrame, tiled: DataFrame, key: list[str], k: int, exclude_self: bool, out: T.StructType, n_tiles: int, nodes: int,
) -> DataFrame:
    """Top-k of every (question pack, corpus tile) pair that routing kept; both sides hold the ``key`` of the pair.

    The number of partitions is stated: the bytes are few for the work they
    cause, and adaptive execution would join them into too few tasks.
    Where questions have a ``bound``, it is one of the angle of their k-th nearest.
    """
    session = routed.sparkSession
    wide = max(16 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(4 * n_tiles, wide))
    # Both sides may come from one table: fresh column identities keep them apart.
    corpus = tiled.select(*[F.col(name).alias(name) for name in tiled.columns])
    schema = _arrow_schema(out)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        left, qm, qlen = _rows(left)
        right, cm, clen = _rows(right, qm.shape[1])
        if not len(left) or not len(right):
            return schema.empty_table()
        name, qids, cids = left.column("grp")[0].as_py(), _ids(left.column("id")), _ids(right.column("id"))
        by_id = np.argsort(cids, kind="stable")
        ids, place = cids[by_id], np.empty(len(cids), np.int64)
        place[by_id] = np.arange(len(cids))
        kept = _fewest_copies(cm, place, k + 1 if exclude_self else k)
        cm, clen, place = cm[kept], clen[kept], place[kept]
        own = np.full(len(qids), -1)
        if exclude_self:
            spot = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
            at = np.full(len(cids), -1)
            at[place] = np.arange(len(place))
            own = np.where(ids[spot] == qids, at[spot], -1)
        reach = left.column("bound").to_numpy() if "bound" in left.column_names else None
        places, scores = _tile_best(qm, qlen, cm, clen, place, own, k, reach)
        found = ids[np.where(np.isfinite(scores), places, 0)]
        return pa.Table.from_batches([_emit(qids, name, (found, scores), schema, nodes)])

    return (
        routed.repartition(parts, *key)
        .groupBy(*key)
        .cogroup(corpus.repartition(parts, *key).groupBy(*key))
        .applyInArrow(product, out)
    )
