"""What the two searches for repeated word spans share.

Both work on cells of documents.  A first question, on a minimiser of each window,
leaves out windows that no other document can have: two equal windows have equal
minimisers.  Spans are kept apart by (document id, text hash), so rows that
share an id each get their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import LEAST, MESSAGE_DDL, answered, ask, bucket_of, heard, in_cells, messages, store
from textloom.llm.words import BLANKS, Words, grams

_LOW = np.uint64(0xFFFFFFFF)


def text_cells(docs: DataFrame, key: str, text: str, cells: int = LEAST) -> DataFrame:
    """``cell, id, sig, t``: the rows of ``docs`` dealt to cells."""
    given = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("sig"), F.col(text).alias("t"))
    return in_cells(given, cells, "id")


class Cell:
    """The words of the rows of a cell in a fixed order, and the windows of ``size`` words with their minimisers.

    ``doc``: number of the row's id among the sorted ids of the cell.  Rows without an id take part in nothing.
    """

    def __init__(self, left: pa.Table, size: int, part: int):
        left = left.filter(left["id"].is_valid()).sort_by([("id", "ascending"), ("sig", "ascending")])
        self.ids, self.sigs = left["id"].to_numpy(), left["sig"].to_numpy()
        self.words = Words(left["t"], BLANKS)
        self.h, self.row = self.words.h, self.words.rows()
        self.names, doc = np.unique(self.ids, return_inverse=True) if len(self.ids) else (self.ids, np.zeros(0, np.int64))
        self.doc = doc
        n = max(0, len(self.h) - size + 1)
        self.valid = self.row[:n] == self.row[size - 1 :] if n else np.zeros(0, bool)
        small = grams(self.h, part)
        least = small[:n].copy()
        for j in range(1, size - part + 1):
            np.minimum(least, small[j : j + n], out=least)
        self.least, self.small = least, small


def _keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    short = (bucket_of(h, buckets).astype(np.uint64) << np.uint64(32)) | (h & _LOW)
    keys, at = np.unique(short, return_inverse=True)
    present, first = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
    return keys, at, present, np.r_[first, len(keys)]


def _twice(group: pa.Table) -> pa.Table:
    """Which of the keys asked for are in two documents or more."""
    data = group["data"].to_pylist()
    sizes = [len(d) // 5 for d in data]
    low = np.concatenate([np.frombuffer(d, "<u4", n) for d, n in zip(data, sizes)])
    many = np.concatenate([np.frombuffer(d, "u1", n, 4 * n) for d, n in zip(data, sizes)])
    _, at = np.unique(low, return_inverse=True)
    found = (np.bincount(at, many) > 1)[at]
    return messages(group["to"].to_numpy(), group["cell"].to_numpy(), 0, [np.packbits(p).tobytes() for p in np.split(found, np.cumsum(sizes)[:-1])])


def ask_minimisers(texts: DataFrame, size: int, part: int, buckets: int) -> DataFrame:
    """Answers on the minimisers of each cell, to be read with ``shared_minimisers``."""
    def tell(key: tuple, left: pa.Table) -> pa.Table:
        cell = Cell(left, size, part)
        h, doc = cell.least[cell.valid], cell.doc[cell.row[: len(cell.valid)][cell.valid]]
        keys, at, present, cuts = _keys(h, buckets)
        first, last = np.full(len(keys), len(cell.ids)), np.full(len(keys), -1)
        np.minimum.at(first, at, doc)
        np.maximum.at(last, at, doc)
        low, many = (keys & _LOW).astype("<u4"), (1 + (first < last)).astype("u1")
        return messages(present, key[0].as_py(), 0, [low[a:b].tobytes() + many[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    return store(ask(texts.groupBy("cell").applyInArrow(tell, MESSAGE_DDL), _twice), "minimisers")


def shared_minimisers(cell: Cell, right: pa.Table, buckets: int) -> np.ndarray:
    """Windows of a cell whose minimiser is in two documents or more."""
    out = np.zeros(len(cell.valid), bool)
    keys, at, present, cuts = _keys(cell.least[cell.valid], buckets)
    told = answered(right, 0)
    bits = [np.unpackbits(np.frombuffer(told[b], "u1"), count=int(n)) for b, n in zip(present.tolist(), np.diff(cuts))]
    out[cell.valid] = np.concatenate(bits)[at].astype(bool) if bits else np.zeros(0, bool)
    return out


def cut_words(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: what is left of each row without the words of its spans (``cell, id, sig, start, stop``)."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, sig, a, b in zip(*(right[c].to_pylist() for c in ("id", "sig", "start", "stop"))):
            own.setdefault((doc, sig), []).append((a, b))
        words = Words(left["t"], BLANKS)
        ids, sigs = left["id"].to_pylist(), left["sig"].to_pylist()
        removed, kept = [], []
        for r, name in enumerate(zip(ids, sigs)):
            a, b = int(words.first[r]), int(words.first[r + 1])
            raw = words.body[words.at[r] : words.at[r + 1]].tobytes().split()
            if found := own.get(name):
                depth = np.zeros(b - a + 1, np.int64)
                for x, y in found:
                    depth[x] += 1
                    depth[y] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                raw = [w for w, g in zip(raw, gone.tolist()) if not g]
            else:
                removed.append(0)
            kept.append(b" ".join(raw).decode())
        return pa.table(
            [left["id"], pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    return heard(texts, spans, cut, "doc_id long, n_words long, n_removed long, kept string")
