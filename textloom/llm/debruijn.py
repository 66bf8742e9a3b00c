"""Substring de-duplication on a compacted de Bruijn graph.

A window of 13 words is an edge from the node of its first 12 words to that of
its last 12.  Only edges that two documents or more have are in the graph.

1. Minimisers leave out windows that cannot be in another document.
2. Each node hears, from all cells, which words come before and after it.  It tells which
   of its edges are repeated, and whether it is inner: the same repeated edge
   in and the same repeated edge out at every place.
3. A maximal path over inner nodes is compacted to one row: document, start,
   length.  Every document with one edge of such a path has all of it.
4. Spark groups equal paths, the smallest document is the source of each, and a join brings
   the source's coordinates to the copies.  A second hash of the words of both spans
   verifies them.  Copies in documents with a larger id are cut.

Defined cases: null and empty texts and texts of fewer than 13 words lose nothing; a repeat
inside one document alone is kept; rows that share an id are one document; a row without an id neither loses
words nor is a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import LEAST, MESSAGE_DDL, answered, ask, bucket_of, cell_of, group_counts, heard, messages, split_by, store, text_bytes
from textloom.llm.repeats import Cell, ask_minimisers, cut_words, shared_minimisers, text_cells
from textloom.llm.words import grams, mix

WINDOW = 13
PART = 8
_NODE = np.dtype([("u", "<u8"), ("before", "<u4"), ("after", "<u4"), ("doc", "<u4")])
_MANY = np.uint32(0xFFFFFFFF)
_REPEATED, _INNER = 1, 2


def _nodes(cell: Cell, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (node, word before, word after) of a cell, the number of each place's among them, and the places.

    A word is 0 where there is no candidate edge on that side.
    """
    n = len(cell.h)
    short = (mix(cell.h + np.uint64(1)) >> np.uint64(32)).astype("<u4") | np.uint32(1)
    out, in_ = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    at = np.flatnonzero(edges)
    out[at] = True
    in_[at + 1] = True
    places = np.flatnonzero(out | in_)
    node = np.zeros(len(places), _NODE)
    node["u"] = grams(cell.h, size - 1)[places]
    node["before"] = np.where(in_[places], short[np.maximum(places - 1, 0)], 0)
    node["after"] = np.where(out[places], short[np.minimum(places + size - 1, n - 1)], 0)
    node["doc"] = cell.doc[cell.row[places]]
    order = np.lexsort((node["doc"], node["after"], node["before"], node["u"]))
    s = node[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["u"][1:] != s["u"][:-1]) | (s["before"][1:] != s["before"][:-1]) | (s["after"][1:] != s["after"][:-1])
    distinct = s[new].copy()
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    last = s["doc"][np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]] if len(s) else s["doc"]
    distinct["doc"] = np.where(last != distinct["doc"], _MANY, distinct["doc"])
    return distinct, number, places


def _in_two(u: np.ndarray, word: np.ndarray, code: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows whose (node, word) is in two documents or more; ``word`` 0 is none."""
    order = np.lexsort((word, u))
    us, ws = u[order], word[order]
    new = np.ones(len(us), bool)
    new[1:] = (us[1:] != us[:-1]) | (ws[1:] != ws[:-1])
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(code[order], first), np.maximum.reduceat(code[order], first)
    found = (low != high) | np.logical_or.reduceat(many[order], first)
    out = np.empty(len(u), bool)
    out[order] = found[np.cumsum(new) - 1]
    return out & (word > 0)


def _judge_nodes(group: pa.Table) -> pa.Table:
    parts = [np.frombuffer(d, _NODE) for d in group["data"].to_pylist()]
    sizes = [len(p) for p in parts]
    node = np.concatenate(parts)
    code = (np.repeat(group["cell"].to_numpy().astype(np.int64), sizes) << 32) | node["doc"]
    many = node["doc"] == _MANY
    into, out = _in_two(node["u"], node["before"], code, many), _in_two(node["u"], node["after"], code, many)
    before, after = np.where(into, node["before"], 0), np.where(out, node["after"], 0)
    used = into | out
    way = (before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
    _, at = np.unique(node["u"], return_inverse=True)
    low, high = np.full(at.max() + 1, np.iinfo(np.uint64).max), np.zeros(at.max() + 1, np.uint64)
    np.minimum.at(low, at[used], way[used])
    np.maximum.at(high, at[used], way[used])
    inner = (low == high)[at] & into & out
    said = (out * _REPEATED + inner * _INNER).astype("u1")
    return messages(group["to"].to_numpy(), group["cell"].to_numpy(), 1, [p.tobytes() for p in np.split(said, np.cumsum(sizes)[:-1])])


def _paths(cell: Cell, edges: np.ndarray, said: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last edge of each compacted path of the cell."""
    n = len(edges)
    mark = np.zeros(len(cell.h) + 1, np.uint8)
    mark[places] = said
    repeated = edges & ((mark[:n] & _REPEATED) > 0)
    inner = (mark[:n] & _INNER) > 0
    goes_on = np.zeros(n, bool)
    goes_on[1:] = repeated[1:] & repeated[:-1] & inner[1:]
    first = np.flatnonzero(repeated & ~goes_on)
    last = np.flatnonzero(repeated & ~np.r_[goes_on[1:], False])
    return first, last


def compact_paths(texts: DataFrame, size: int = WINDOW, part: int = PART, buckets: int = LEAST) -> DataFrame:
    """``key, proof, id, sig, start, edges``: every occurrence of every compacted path."""
    shared = ask_minimisers(texts, size, part, buckets)

    def tell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell = Cell(left, size, part)
        node, _, _ = _nodes(cell, shared_minimisers(cell, right, buckets), size)
        order, present, cuts = split_by(bucket_of(node["u"], buckets))
        node = node[order]
        return messages(present, key[0].as_py(), 1, [node[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    judged = store(ask(heard(texts, shared, tell, MESSAGE_DDL), _judge_nodes), "nodes")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        cell = Cell(left, size, part)
        edges = shared_minimisers(cell, right, buckets)
        node, number, places = _nodes(cell, edges, size)
        order, present, _ = split_by(bucket_of(node["u"], buckets))
        told = answered(right, 1)
        said = np.empty(len(node), np.uint8)
        said[order] = np.frombuffer(b"".join(told[b] for b in present.tolist()), "u1")
        first, last = _paths(cell, edges, said[number], places)
        sums = np.r_[np.uint64(0), np.cumsum(mix(cell.h ^ grams(cell.h, 1)))]
        row = cell.row[first] if len(first) else np.zeros(0, np.int64)
        window = grams(cell.h, size)
        head, tail = window[first], window[last]
        proof = mix(head * np.uint64(3) + tail * np.uint64(5)) ^ (sums[last + size] - sums[first])
        start = first - cell.words.first[row]
        return pa.table(
            [pa.array(head.view("<i8")), pa.array(proof.view("<i8")), pa.array(cell.ids[row]), pa.array(cell.sigs[row]),
             pa.array(start, pa.int32()), pa.array(last - first + 1, pa.int32())],
            names=["key", "proof", "id", "sig", "start", "edges"],
        )

    return heard(texts, shared.unionByName(judged), walk, "key long, proof long, id long, sig long, start int, edges int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each row without words in windows that start in a document with a smaller id."""
    cells, buckets = group_counts(text_bytes(docs, text))
    texts = text_cells(docs, key, text, cells)
    paths = store(compact_paths(texts, size, buckets=buckets), "paths")
    source = paths.groupBy("key", "edges").agg(F.min(F.struct("id", "start", "proof")).alias("source"))
    copies = paths.join(source, ["key", "edges"]).where("id > source.id and proof = source.proof")
    spans = copies.select(
        cell_of(cells, "id").alias("cell"), "id", "sig", "start", (F.col("start") + F.col("edges") + (size - 1)).alias("stop")
    )
    return cut_words(texts, spans)
