"""De-duplication of long passages with sparse suffix arrays.

Only suffixes at minimiser positions are kept: the k-word piece with the
smallest hash in each window of ``size`` words.  Equal windows have equal
minimisers, so every repeated passage of ``size`` words holds such an anchor at the
same place in all its copies.

1. Anchors that no other document has are left out (one question a cell).
2. The others go to the bucket of their anchor, with the words a window around them can reach; what
   a cell holds several times goes once, with its smallest id.  A bucket sorts its suffixes by their words to the right and compares
   neighbours; what matches no neighbour far enough for any window goes no further.
3. Matches are extended left: for each number of words to the left, the suffixes
   that begin there are sorted and neighbours compared over ``size`` words; the
   first document of a run of equal ones is the source.
4. Each document cuts the words in windows that an earlier document has.

Defined cases: null and empty texts and texts of fewer than ``size`` words lose
nothing; a repeat inside one document alone is kept; rows that share an id are
one document; a row without an id neither loses words nor is a source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.cells import MESSAGE_DDL, answered, ask, bucket_of, group_counts, heard, messages, split_by, store, text_bytes
from textloom.llm.repeats import Cell, ask_minimisers, cut_words, shared_minimisers, text_cells
from textloom.llm.words import mix

SIZE = 50
PART = 10
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _record(size: int, part: int) -> np.dtype:
    """An anchor: its hash, document, and 32-bit words around it (``reach`` on either side); 0 is outside the document."""
    return np.dtype([("h", "<u8"), ("id", "<i8"), ("w", "<u4", (2 * size - part,))])


def _anchors(cell: Cell, windows: np.ndarray, size: int, part: int) -> np.ndarray:
    """Places of the anchors of the given windows."""
    at = np.flatnonzero(windows)
    if not len(at):
        return at
    best = at.copy()
    for j in range(1, size - part + 1):
        best = np.where(cell.small[at + j] < cell.small[best], at + j, best)
    return np.unique(best)


def _suffixes(cell: Cell, anchors: np.ndarray, size: int, part: int) -> np.ndarray:
    reach = size - part
    out = np.zeros(len(anchors), _record(size, part))
    out["h"], out["id"] = cell.small[anchors], cell.ids[cell.row[anchors]] if len(anchors) else 0
    short = (mix(cell.h + np.uint64(1)) >> np.uint64(32)).astype("<u4") | np.uint32(1)
    for j in range(2 * size - part):
        place = anchors - reach + j
        inside = (place >= 0) & (place < len(short))
        place = np.clip(place, 0, max(0, len(short) - 1))
        if len(short):
            inside &= cell.row[place] == cell.row[anchors]
            out["w"][:, j] = np.where(inside, short[place], 0)
    return out


class _Kinds:
    """Anchors of a cell with equal words around them, as far as a window around the anchor can reach inside the document.

    ``first``: of each kind the anchor of the smallest id, in rising order of their places; ``kind``: the number of every
    anchor's kind; ``whole``: bit l tells whether the window that begins l words left of the anchor lies in the document.
    """

    def __init__(self, cell: Cell, anchors: np.ndarray, size: int, part: int):
        reach, row = size - part, cell.row[anchors]
        low = np.maximum(anchors - reach, cell.words.first[row])
        high = np.minimum(anchors + size, cell.words.first[row + 1])
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(cell.h), base, np.uint64)], dtype=np.uint64) for base in (_STEP, _BACK))
        sums = np.r_[np.uint64(0), np.cumsum(mix(cell.h + np.uint64(1)) * up[:-1], dtype=np.uint64)]
        around = mix((sums[high] - sums[low]) * down[low]) + ((anchors - low) << 8 | high - anchors).astype(np.uint64)
        key = mix(mix(around) ^ cell.small[anchors])
        order = np.lexsort((cell.ids[row], key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        places = order[new]
        self.first = np.sort(places)
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.searchsorted(self.first, places)[np.cumsum(new) - 1]
        self.whole = np.zeros(len(anchors), np.uint64)
        for left in range(reach + 1):
            inside = (anchors - left >= low) & (anchors - left + size <= high)
            self.whole[inside] |= np.uint64(1) << np.uint64(left)


def _reach_of_neighbours(suffixes: np.ndarray, reach: int) -> np.ndarray:
    """Longest common run to the right of the anchor start with a neighbour in suffix order."""
    words = suffixes["w"]
    last = words.shape[1]
    order = np.lexsort((*[words[:, j] for j in range(last - 1, reach - 1, -1)], suffixes["h"]))
    out = np.zeros(len(order), np.int64)
    if not len(order):
        return out
    h = suffixes["h"][order]
    going, common = h[1:] == h[:-1], np.zeros(len(order) - 1, np.int64)
    for j in range(reach, last):
        word = words[order, j]
        going &= (word[1:] == word[:-1]) & (word[1:] > 0)
        common += going
    out[order] = np.maximum(np.r_[0, common], np.r_[common, 0])
    return out


def _earlier_windows(suffixes: np.ndarray, size: int, part: int) -> np.ndarray:
    """Bit l of each suffix: the window that begins l words left of the anchor is in a document with a smaller id."""
    reach = size - part
    bits = np.zeros(len(suffixes), np.uint64)
    near = np.flatnonzero(_reach_of_neighbours(suffixes, reach) >= part)
    if not len(near):
        return bits
    words, ids, anchor = suffixes["w"], suffixes["id"][near], suffixes["h"][near]
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(words.shape[1] - 1, _STEP)])
    gaps, total = np.zeros(len(near), np.int64), np.zeros(len(near), np.uint64)

    def turn(j: int, come: bool) -> None:
        """Word j joins or leaves the running sum of the window; columns one at a time keep memory to a few numbers a suffix."""
        nonlocal total
        word = words[near, j]
        term = mix(word.astype(np.uint64)) * power[j]
        total = total + term if come else total - term
        gaps[word == 0] += 1 if come else -1

    for j in range(reach, reach + size):
        turn(j, True)
    for left in range(reach + 1):
        a = reach - left
        if left:
            turn(a, True)
            turn(a + size, False)
        full = np.flatnonzero(gaps == 0)
        window = mix(total[full]) ^ anchor[full]
        order = np.lexsort((ids[full], window))
        w, d = window[order], ids[full][order]
        if not len(w):
            continue
        new = np.r_[True, w[1:] != w[:-1]]
        first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = near[full[order[first < d]]]
        bits[late] |= np.uint64(1) << np.uint64(left)
    return bits


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, part: int = PART) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: rows without the words of passages of ``size`` words or more that a smaller id has."""
    if size - part > 63:
        raise ValueError("an anchor reaches at most 63 words to the left")
    cells, buckets = group_counts(text_bytes(docs, text))
    texts = text_cells(docs, key, text, cells)
    shared = ask_minimisers(texts, size, part, buckets)
    kind = _record(size, part)

    def dealt(left: pa.Table, right: pa.Table) -> tuple[Cell, np.ndarray, np.ndarray]:
        cell = Cell(left, size, part)
        anchors = _anchors(cell, shared_minimisers(cell, right, buckets), size, part)
        order, _, _ = split_by(bucket_of(cell.small[anchors], buckets))
        return cell, anchors[order], bucket_of(cell.small[anchors], buckets)[order]

    def tell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, anchors, buckets = dealt(left, right)
        first = _Kinds(cell, anchors, size, part).first
        _, present, cuts = split_by(buckets[first])
        data = [_suffixes(cell, anchors[first[a:b]], size, part).tobytes() for a, b in zip(cuts, cuts[1:])]
        return messages(present, key[0].as_py(), 1, data)

    def compare(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(d, kind) for d in group["data"].to_pylist()]
        bits = _earlier_windows(np.concatenate(parts), size, part)
        data = [p.tobytes() for p in np.split(bits, np.cumsum([len(p) for p in parts])[:-1])]
        return messages(group["to"].to_numpy(), group["cell"].to_numpy(), 1, data)

    found = store(ask(heard(texts, shared, tell, MESSAGE_DDL), compare), "suffixes")

    def spans(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, anchors, buckets = dealt(left, right)
        told = answered(right, 1)
        kinds = _Kinds(cell, anchors, size, part)
        said = np.frombuffer(b"".join(told[b] for b in np.unique(buckets).tolist()), "<u8")[kinds.kind]
        # what the smallest id of the cell holds too is earlier for all others
        ids = cell.ids[cell.row[anchors]]
        bits = np.where(ids > ids[kinds.first][kinds.kind], kinds.whole, said) if len(anchors) else said
        start = [np.zeros(0, np.int64)]
        for left_words in range(size - part + 1):
            start.append(anchors[(bits >> np.uint64(left_words) & np.uint64(1)) > 0] - left_words)
        start = np.unique(np.concatenate(start))
        row = cell.row[start] if len(start) else np.zeros(0, np.int64)
        if len(start):  # windows that touch are one span
            new = np.r_[True, (start[1:] > start[:-1] + size) | (row[1:] != row[:-1])]
            stop = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]] + size
            start, row = start[new], row[new]
        else:
            stop = start
        base = cell.words.first[row]
        return pa.table(
            [pa.array([key[0].as_py()] * len(row), pa.int32()), pa.array(cell.ids[row]), pa.array(cell.sigs[row]),
             pa.array(start - base, pa.int32()), pa.array(stop - base, pa.int32())],
            names=["cell", "id", "sig", "start", "stop"],
        )

    cut = heard(texts, shared.unionByName(found), spans, "cell int, id long, sig long, start int, stop int")
    return cut_words(texts, cut)
