"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

1. Class counts of every n-gram, over all labelled rows (``count_features``):
   each task adds up vectors of ``n_features`` slots, Spark adds the slots.
2. ``r``, the log ratio of the smoothed class frequencies, scales the indicators.
3. A linear hinge-loss model over the scaled, length-normalised indicators is fit
   by dual coordinate descent on at most ``max_fit_rows`` labelled rows, taken in
   the order of a seeded hash.  This is the only bounded sample.
4. A logistic curve turns margins into scores; 0.5 is at margin 0.

Tokens are runs of letters, digits and non-ASCII characters (lower-cased), and
runs of other visible characters; n-grams are one and two tokens long, and one
or two tokens said two or three times in a row are n-grams whatever their wording.

Defined cases: null and empty texts have no features and get the score of the
bias; rows without a label are not learned from; an id labelled twice counts once,
with the larger label; repeated rows are learned from and scored one by one; texts of any length are read whole; with one class or
no rows to learn from every score is the share of label 1 (0.5 for none); an empty table gives an empty table.
Other columns of the input never reach the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import with_fields
from textloom.llm.words import buffers, grams, mix, word_hashes

BITS = 18
#: Rows the linear model is fit on (documented bound); class counts cover all labelled rows.
MAX_FIT_ROWS = 5_000
_SLICE = 4 << 20
_FLOOR = 1e-6

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x00, 0x21), 0x7F]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def _tokens(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _CLASS[body]
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0
    return starts[keep], ends[keep]


def _repeats(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams up to their wording: one or two tokens said twice, and three times, in a row."""
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, row.dtype)]
    for period in (1, 2):
        for times in (2, 3):
            span, tail = period * times, period * (times - 1)
            n = len(h) - span + 1
            if n < 1:
                continue
            equal = row[:n] == row[span - 1 :]
            for j in range(tail):
                equal &= h[j : j + n] == h[j + period : j + period + n]
            rows.append(row[:n][equal])
            found.append(np.full(len(rows[-1]), mix(np.array([span * 16 + period], np.uint64))[0]))
    return np.concatenate(found), np.concatenate(rows)


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each distinct feature, slot) of row groups of bounded size."""
    body, at = buffers(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        part, own = body[at[i] : at[j]], at[i : j + 1] - at[i]
        slots, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(part):
            starts, ends = _tokens(part, own)
            h = word_hashes(part, starts, ends, fold=True)
            row = np.searchsorted(own, starts, side="right") - 1
            pairs = grams(h, 2)
            same = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
            again, again_row = _repeats(h, row)
            slot = np.concatenate([h, pairs[same], again]) >> np.uint64(64 - bits)
            rows = np.concatenate([row, row[:-1][same] if len(row) > 1 else row[:0], again_row])
            key = np.unique((rows.astype(np.int64) << bits) | slot.astype(np.int64))
            rows, slots = key >> bits, key & ((1 << bits) - 1)
        yield i, j, rows, slots
        i = j


@dataclass
class Model:
    """``ratio``: log-count ratios; ``weight``: the fitted weights times the ratios; a bias and a logistic slope."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    bits: int = BITS

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, j, rows, slots in features(column, self.bits):
            n = j - i
            norm = np.sqrt(np.bincount(rows, self.ratio[slots] ** 2, n))
            dot = np.bincount(rows, self.weight[slots], n)
            margin = np.where(norm > _FLOOR, dot / np.maximum(norm, _FLOOR), 0.0) + self.bias
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.slope * margin, -500, 500)))
        return out


def count_features(rows: DataFrame, text: str, label: str, bits: int = BITS) -> DataFrame:
    """``slot, n0, n1``: rows of each label with the feature; slot -1 counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int64)
        total = [0, 0]
        for batch in batches:
            y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            total[0] += int((y == 0).sum())
            total[1] += int((y == 1).sum())
            for i, _, row, slot in features(batch.column(0), bits):
                for c in (0, 1):
                    sums[c] += np.bincount(slot[y[i + row] == c], minlength=1 << bits)
        seen = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, seen], pa.int64()), pa.array(np.r_[total[0], sums[0][seen]]), pa.array(np.r_[total[1], sums[1][seen]])],
            names=["slot", "n0", "n1"],
        )

    counted = rows.select(F.col(text).alias("t"), F.col(label).cast("long").alias("y")).mapInArrow(count, "slot long, n0 long, n1 long")
    return counted.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def hinge_fit(
    rows: np.ndarray, slots: np.ndarray, y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7,
) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for hinge loss; rows must be sorted.  Returns weights, bias and margins."""
    cut = np.searchsorted(rows, np.arange(len(y) + 1))
    scale = ratio[slots]
    norm = np.sqrt(np.bincount(rows, scale**2, len(y)))
    x = (scale / np.maximum(norm, _FLOOR)[rows]).astype(np.float32)
    del scale
    sign = np.where(y == 1, 1.0, -1.0)
    upper = c * len(y) / (2 * np.maximum(1, np.where(y == 1, (y == 1).sum(), (y == 0).sum())))  # classes weigh the same
    diagonal = np.where(norm > _FLOOR, 1.0, 0.0) + 1.0
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            own = slice(cut[i], cut[i + 1])
            at, value = slots[own], x[own]
            gradient = sign[i] * (w[at] @ value + b) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * value
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    margin = np.bincount(rows, w[slots] * x, len(y)) + b
    return w, b, margin


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of the logistic curve through margin 0 with the least log loss."""
    grid = np.geomspace(0.25, 16, 25)
    sign = np.where(y == 1, 1.0, -1.0)
    return float(min(grid, key=lambda s: np.logaddexp(0, -s * sign * margin).sum()))


def fit(labelled: DataFrame, key: str, text: str, label: str, bits: int = BITS, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """The model of labelled rows (label 0 or 1)."""
    known = labelled.where(F.col(label).isin(0, 1))
    counts = known.transform(count_features, text, label, bits).toPandas()
    n = np.zeros((2, 1 << bits))
    totals = counts[counts["slot"] == -1]
    total = [int(totals[c].sum()) for c in ("n0", "n1")]
    body = counts[counts["slot"] >= 0]
    n[0, body["slot"]], n[1, body["slot"]] = body["n0"], body["n1"]
    flat = np.zeros(1 << bits)
    if not sum(total):
        return Model(flat, flat, 0.0, 1.0, bits)
    if not all(total):
        share = min(max(total[1] / sum(total), 1e-9), 1 - 1e-9)
        return Model(flat, flat, float(np.log(share / (1 - share))), 1.0, bits)
    p = (n + 1) / (np.array(total)[:, None] + 2)
    ratio = np.where(n.sum(0) > 0, np.log(p[1] / p[0]), 0.0)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, slot in features(batch.column(1), bits):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(slot, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], lists], names=["k", "y", "slots"])

    share = min(1.0, 1.2 * max_fit_rows / sum(total))
    picked = F.pmod(F.xxhash64(F.lit(11), F.col(key).cast("string")), F.lit(1 << 30))
    rows = known.where(picked <= int(share * (1 << 30))).select(
        picked.alias("k"), F.col(text).alias("t"), F.col(label).cast("long").alias("y")
    )
    del counts, body, n, p
    got = rows.mapInArrow(sample, "k long, y long, slots array<int>").orderBy("k", "y").limit(max_fit_rows).toArrow()
    y = got["y"].to_numpy()
    lists = got["slots"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    slots = lists.flatten().to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(flat, flat, float(np.log((total[1] + 1) / (total[0] + 1))), 1.0, bits)
    w, b, margin = hinge_fit(np.repeat(np.arange(len(y), dtype=np.int32), lengths), slots, y, ratio)
    return Model(ratio, w * ratio, b, _slope(margin, y), bits)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus the score; the model goes to the tasks (its size is fixed by ``bits``).

    An input column named ``out`` is replaced.
    """
    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(held.value.scores(batch.column(batch.num_columns - 1)))],
                names=[*batch.schema.names[:-1], out],
            )

    given = docs.select("*", F.col(text).alias("_score_text"))
    schema = with_fields(docs.schema, **{out: "double"})
    return given.mapInArrow(run, schema)


def is_held_out(key: str) -> F.Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of the labelled rows that are not held out.

    Labels grow with the documents, so they are merged at every size and never broadcast.
    """
    marks = labels.groupBy(key).agg(F.max(label).alias("_label")).where(~is_held_out(key))
    texts = docs.where(~is_held_out(key)).select(key, text)
    return fit(texts.join(marks.hint("merge"), key), key, text, "_label")
