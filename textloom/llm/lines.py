"""Line de-duplication by pairwise alignment.

Lines are the pieces between line feeds.  Documents overlap when they share a
run of consecutive lines with at least ``min_words`` words together.  The keys of
a document are its shortest such runs, one that starts and one that ends at each
line; every line of a common block is in a run that lies in the block.  Each run
names one partner first: the document with the smallest id that holds it, so a run
that thousands of documents share makes one pair for each of them.  A run that
alignment left a line of names its next earlier holders, 8 times as many each
round, until it is covered or has none left: what is deleted is what all pairs
would delete.  A document is aligned with its partners by patience diff, and
aligned common blocks of at least ``min_words`` words are deleted from the
document with the larger id.  Alignment reads the input, not what is left.

Defined cases: null texts stay null and have no lines; blank lines alone never
make a block; rows with the same id count as one holder with several texts, and each row is aligned by
itself, not with the others of its id; a row whose id is null is kept as it is; a row that keeps no line has an empty
text; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import MESSAGE, MESSAGE_DDL, ask, bucket_of, cell_of, group_counts, heard, messages, split_by, store
from textloom.llm.words import BLANKS, bounds, buffers, mix, word_hashes

MIN_WORDS = 10


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs of equal elements, by patience diff.

    Elements found once on both sides anchor the alignment; where there are
    none, the n-th occurrence on one side is matched to the n-th on the other.
    """
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        anchors = _longest_rise(_unique_pairs(a, b, i, m, j, n) or _numbered_pairs(a, b, i, m, j, n))
        if anchors:
            out += anchors
            for (x, y), (z, w) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)]):
                open_.append((x + 1, z, y + 1, w))
    return sorted(out)


def _unique_pairs(a, b, i, m, j, n):
    left, right = Counter(a[i:m]), Counter(b[j:n])
    at = {b[y]: y for y in range(j, n) if right[b[y]] == 1}
    return [(x, at[a[x]]) for x in range(i, m) if left[a[x]] == 1 and a[x] in at]


def _numbered_pairs(a, b, i, m, j, n):
    at, seen = {}, Counter()
    for y in range(j, n):
        at[b[y], seen[b[y]]] = y
        seen[b[y]] += 1
    seen, out = Counter(), []
    for x in range(i, m):
        if (y := at.get((a[x], seen[a[x]]))) is not None:
            out.append((x, y))
        seen[a[x]] += 1
    return out


def _longest_rise(pairs):
    """The longest run of pairs whose second members rise (the first ones do)."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Elements of ``b`` in aligned blocks with enough words."""
    out, block, last = [], [], (-2, -2)
    for pair in [*patience(a, b), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(words[y] for y in block) >= min_words:
                out += block
            block = []
        block.append(pair[1])
        last = pair
    return out


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, at = buffers(batch.column(2))
        feeds, filled = np.flatnonzero(body == 0x0A), np.diff(at) > 0
        starts, stops = np.sort(np.r_[at[:-1][filled], feeds + 1]), np.sort(np.r_[feeds, at[1:][filled]])
        words, _ = bounds(body, at, BLANKS)  # a line feed is a blank, so no word crosses lines
        count = (np.searchsorted(words, stops) - np.searchsorted(words, starts)).astype("<i4")
        own = np.diff(np.searchsorted(feeds, at))
        first = np.r_[0, np.cumsum(np.where(filled, own + 1, 0))]  # a row without text has no lines
        hashes = word_hashes(body, starts, stops, False)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], _packed_rows(hashes, first, 8), _packed_rows(count, first, 4)], names=["id", "sig", "lines", "words"]
        )


def _packed_rows(values: np.ndarray, first: np.ndarray, width: int) -> pa.Array:
    """A binary array whose row r holds ``values[first[r]:first[r + 1]]``."""
    offsets = pa.py_buffer((first * width).astype("<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, sig, lines, words``: a text hash, and packed hashes and word counts of the lines of each row."""
    given = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("sig"), F.col(text).alias("t")
    )
    return given.mapInArrow(_hash_lines, "id long, sig long, lines binary, words binary")


_BASE = 0x9E3779B97F4A7C15
_RISE = np.uint64(0xD1B54A32D192ED03)


def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)


def line_runs(h: np.ndarray, words: np.ndarray, min_words: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and end of the shortest runs of ``min_words`` words, one from each line on and one up to each line.

    ``first``: where each of several documents begins, and the end of the last one; a run never crosses documents.
    Equal hashes of unequal runs name a partner too many, which aligns nothing.
    """
    size = len(h)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.zeros(size, np.int64), np.full(size, size)
    if first is not None:
        low, high = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    total, at = np.r_[0, np.cumsum(words, dtype=np.int64)], np.arange(size)
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words), at + 1)
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at)
    on, back = ends <= high, starts >= low
    firsts, stops = np.r_[at[on], starts[back]], np.r_[ends[on], at[back] + 1]
    _, one = np.unique(firsts * (size + 1) + stops, return_index=True)
    firsts, stops = firsts[one], stops[one]
    sums = np.r_[np.uint64(0), np.cumsum((h + _RISE) * _powers(_BASE, size), dtype=np.uint64)]
    hashes = mix((sums[stops] - sums[firsts]) * _powers(pow(_BASE, -1, 2**64), size)[firsts] + (stops - firsts).astype(np.uint64))
    return hashes, firsts, stops


class Runs:
    """The runs of all rows of a table, worked out together: ``h``, ``firsts``, ``stops`` and the ``row`` of each."""

    def __init__(self, table: pa.Table, min_words: int):
        lines, at = buffers(table["lines"])
        words, _ = buffers(table["words"])
        self.first = at // 8
        self.h, self.firsts, self.stops = line_runs(lines.view("<u8"), words.view("<i4"), min_words, self.first)
        self.row = np.searchsorted(self.first, self.firsts, side="right") - 1
        self.cuts = np.searchsorted(self.row, np.arange(len(self.first)))

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of one row, by lines of that row."""
        part = slice(self.cuts[row], self.cuts[row + 1])
        return self.h[part], self.firsts[part] - self.first[row], self.stops[part] - self.first[row]


_KEY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("n", "<i8")])


def _cell_keys(left: pa.Table, min_words: int) -> np.ndarray:
    """Each run hash of a cell once: with its smallest holder and the number of holders; sorted by hash."""
    runs = Runs(left, min_words)
    h, d = runs.h, left["id"].to_numpy()[runs.row]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    other = new | np.r_[True, d[1:] != d[:-1]] if len(h) else new
    out = np.empty(int(new.sum()), _KEY)
    out["h"], out["doc"] = h[new], d[new]
    out["n"] = np.add.reduceat(other.astype(np.int64), np.flatnonzero(new)) if len(out) else 0
    return out


def _first_holders(group: pa.Table) -> pa.Table:
    """For what each cell asked: the smallest holder anywhere and how many documents hold the run."""
    parts = [np.frombuffer(x, _KEY) for x in group["data"].to_pylist()]
    keys = np.concatenate(parts)
    _, at = np.unique(keys["h"], return_inverse=True)
    least = np.full(at.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, keys["doc"])
    holders = np.bincount(at, keys["n"]).astype(np.int64)
    keys["doc"], keys["n"] = least[at], holders[at]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    data = [p[p["n"] > 1].tobytes() for p in np.split(keys, cuts)]
    return messages(group["to"].to_numpy(), group["cell"].to_numpy(), 0, data)


def _partners(left: pa.Table, right: pa.Table, min_words: int) -> Iterator[tuple[dict, tuple, np.ndarray]]:
    """Each row that has partners, its runs, and the keys of its runs with an earlier first holder."""
    known = [np.frombuffer(x, _KEY) for x, kind in zip(right["data"].to_pylist(), right["kind"].to_pylist()) if kind == 0]
    keys = np.concatenate(known) if known else np.zeros(0, _KEY)
    keys = keys[np.argsort(keys["h"], kind="stable")]
    if not len(keys) or not left.num_rows:
        return
    runs = Runs(left, min_words)
    at = np.minimum(np.searchsorted(keys["h"], runs.h), len(keys) - 1)
    hit = (keys["h"][at] == runs.h) & (keys["doc"][at] < left["id"].to_numpy()[runs.row])
    rows = np.unique(runs.row[hit])
    picked = left.select(["id", "sig", "lines", "words"]).take(pa.array(rows)).to_pylist()
    for r, row in zip(rows.tolist(), picked):
        part = slice(runs.cuts[r], runs.cuts[r + 1])
        yield row, runs.of(r), keys[np.unique(at[part][hit[part]])]


def _uncovered(runs: tuple, cut: set[int], size: int) -> np.ndarray:
    """Hashes of the runs with a line that is not cut."""
    kept = np.ones(size + 1, np.int64)
    kept[[0, *(x + 1 for x in cut)]] = 0
    kept = np.cumsum(kept)
    return np.unique(runs[0][kept[runs[2]] > kept[runs[1]]])


_STATE = pa.schema([
    ("id", pa.int64()), ("sig", pa.int64()), ("cell", pa.int32()), ("lines", pa.binary()), ("words", pa.binary()),
    ("removed", pa.binary()), ("tried", pa.binary()), ("open", pa.binary()),
])
_STATE_DDL = "id long, sig long, cell int, lines binary, words binary, removed binary, tried binary, open binary"


def _state(row: dict, cell: int, cut: set[int], tried: set[int], open_: np.ndarray) -> dict:
    """A row after a round; what the next one needs only if runs are still open."""
    out = {"id": row["id"], "sig": row["sig"], "cell": cell, "removed": np.array(sorted(cut), "<i4").tobytes() if cut else None}
    if len(open_):
        out |= {"lines": row["lines"], "words": row["words"], "tried": np.array(sorted(tried), "<i8").tobytes(), "open": open_.astype("<u8").tobytes()}
    return out


def _sent_lines(right: pa.Table) -> dict[int, list[list[int]]]:
    """The lines of each text of each partner sent to a cell."""
    out: dict[int, list[list[int]]] = {}
    for d, kind in zip(right["data"].to_pylist(), right["kind"].to_pylist()):
        if kind == 1:
            out.setdefault(int.from_bytes(d[:8], "big", signed=True), []).append(np.frombuffer(d[8:], "<u8").tolist())
    return out


def _without_foreign(lines: list[int], own: set[int]) -> tuple[int, ...]:
    """``lines`` with each stretch of lines that are not in ``own`` as one -1, which aligns the same blocks."""
    out = []
    for x in lines:
        x = x if x in own else -1
        if x >= 0 or not out or out[-1] >= 0:
            out.append(x)
    return tuple(out)


def _holders(cell: int, left: pa.Table, right: pa.Table, min_words: int, buckets: int) -> pa.Table:
    """All (run, document) of a cell for the runs that are asked for."""
    wanted = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in right["data"].to_pylist())])
    if len(wanted) and left.num_rows:
        runs = Runs(left, min_words)
        asked = np.isin(runs.h, wanted)
        found = np.zeros(int(asked.sum()), _KEY)
        found["h"], found["doc"] = runs.h[asked], left["id"].to_numpy()[runs.row[asked]]
    else:
        found = np.zeros(0, _KEY)
    keys = np.unique(found)
    order, present, cuts = split_by(bucket_of(keys["h"], buckets))
    keys = keys[order]
    return messages(present, cell, 0, [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Distinct (run, document), sorted, with the rank of the document among the holders in ``n``."""
    keys["n"] = 0
    keys = np.unique(keys)
    new = np.flatnonzero(np.r_[True, keys["h"][1:] != keys["h"][:-1]]) if len(keys) else np.zeros(0, np.int64)
    keys["n"] = np.arange(len(keys)) - np.repeat(new, np.diff(np.r_[new, len(keys)]))
    return keys


def _ask_open(cell: int, left: pa.Table, buckets: int) -> pa.Table:
    keys = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in left["open"].to_pylist()]))
    order, present, cuts = split_by(bucket_of(keys, buckets))
    keys = keys[order]
    return messages(present, cell, 1, [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])


def _route(told: pa.Table, asks: pa.Table) -> pa.Table:
    """The open runs of a bucket, sent to the cells that have them."""
    asked = [np.frombuffer(x, "<u8") for x in asks["data"].to_pylist()]
    if not asked or not told.num_rows:
        return MESSAGE.empty_table()
    wanted = np.unique(np.concatenate(asked))
    data = [h[np.isin(h, wanted)].tobytes() for h in (np.frombuffer(x, _KEY)["h"] for x in told["data"].to_pylist())]
    return messages(told["to"].to_numpy(), told["cell"].to_numpy(), 0, data).filter(pa.array([len(d) > 0 for d in data], pa.bool_()))


def _next_holders(listed: pa.Table, asks: pa.Table, low: int, high: int) -> pa.Table:
    """For each asking cell the holders of its open runs with rank ``low`` to ``high``."""
    if not asks.num_rows or not listed.num_rows:
        return MESSAGE.empty_table()
    keys = _ranked(np.concatenate([np.frombuffer(x, _KEY) for x in listed["data"].to_pylist()]))
    keys = keys[(keys["n"] >= low) & (keys["n"] <= high)]
    data = [keys[np.isin(keys["h"], np.frombuffer(x, "<u8"))].tobytes() for x in asks["data"].to_pylist()]
    return messages(asks["to"].to_numpy(), asks["cell"].to_numpy(), 0, data)


def _named(left: pa.Table, right: pa.Table) -> Iterator[tuple[dict, dict[int, list[int]]]]:
    """Each open row with the earlier holders that came for each of its open runs."""
    parts = [np.frombuffer(x, _KEY) for x, kind in zip(right["data"].to_pylist(), right["kind"].to_pylist()) if kind == 0]
    keys = np.sort(np.concatenate(parts), order=["h", "n"]) if parts else np.zeros(0, _KEY)
    for row in left.to_pylist():
        named = {}
        for h in np.frombuffer(row["open"], "<u8"):
            part = keys[np.searchsorted(keys["h"], h) : np.searchsorted(keys["h"], h, side="right")]
            named[int(h)] = part[part["doc"] < row["id"]]
        yield row, named


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, sig, removed``: packed numbers of the deleted lines of each (id, text hash) that loses any.

    Nothing is collected but, each round, whether runs are still open.
    """
    rows = store(line_table(docs, key, text), "lines")
    count, buckets = group_counts(6 * (rows.agg(F.sum(F.octet_length("lines"))).first()[0] or 0))  # a hash stands for some fifty bytes
    dealt = rows.withColumn("cell", cell_of(count, "id", "sig")).repartition("cell")

    def tell(key: tuple, left: pa.Table) -> pa.Table:
        keys = _cell_keys(left, min_words)
        order, present, cuts = split_by(bucket_of(keys["h"], buckets))
        keys = keys[order]
        return messages(present, key[0].as_py(), 0, [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])

    told = store(dealt.groupBy("cell").applyInArrow(tell, MESSAGE_DDL), "runs")
    answers = store(ask(told, _first_holders), "holders")

    def name(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        named = sorted({p for _, _, found in _partners(left, right, min_words) for p in found["doc"].tolist()})
        return pa.table([pa.array(named, pa.int64()), pa.array([key[0].as_py()] * len(named), pa.int32())], names=["id", "cell"])

    def lines_for(wanted: DataFrame) -> DataFrame:
        """The lines of each text of each partner, once for each cell that asked."""
        partner_rows = rows.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "lines").distinct()
        return wanted.join(partner_rows, "id").select(
            F.lit(0).alias("to"), "cell", F.lit(1).alias("kind"), F.concat(F.unhex(F.lpad(F.hex("id"), 16, "0")), "lines").alias("data")
        )

    def align(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lines, out = _sent_lines(right), []
        for row, runs, found in _partners(left, right, min_words):
            own, words, cut = np.frombuffer(row["lines"], "<u8").tolist(), np.frombuffer(row["words"], "<i4").tolist(), set()
            partners = set(found["doc"].tolist())
            for partner in partners:
                for text in lines[partner]:
                    cut.update(common_blocks(text, own, words, min_words))
            more = found["h"][found["n"] > 2]  # two holders are the first one and the row's own
            open_ = np.intersect1d(more, _uncovered(runs, cut, len(own))) if len(more) else more
            if cut or len(open_):
                out.append(_state(row, key[0].as_py(), cut, partners, open_))
        return pa.Table.from_pylist(out, _STATE)

    wanted = store(heard(dealt, answers, name, "id long, cell int"), "wanted")
    state = store(heard(dealt, answers.unionByName(lines_for(wanted)), align, _STATE_DDL), "aligned")
    done, left = state.where("open is null"), state.where("open is not null")
    holders, low, high = None, 1, 9
    while not left.isEmpty():
        asks = store(left.groupBy("cell").applyInArrow(lambda key, t: _ask_open(key[0].as_py(), t, buckets), MESSAGE_DDL), "open")
        if holders is None:
            route = told.groupBy("to").cogroup(asks.groupBy("to")).applyInArrow(_route, MESSAGE_DDL)
            listed = heard(dealt, route, lambda key, l, r: _holders(key[0].as_py(), l, r, min_words, buckets), MESSAGE_DDL)
            holders = store(listed, "all-holders")
        state = store(_align_next(left, holders, asks, low, high, lines_for, min_words), "aligned")
        done, left = done.unionByName(state.where("open is null")), state.where("open is not null")
        low, high = high, 8 * high + 1
    return done.where("removed is not null").select("id", "sig", "removed")


def _align_next(left: DataFrame, holders: DataFrame, asks: DataFrame, low: int, high: int, lines_for: Callable, min_words: int) -> DataFrame:
    """Open rows aligned with the holders of rank ``low`` to below ``high`` of their open runs."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a cell lists, cut to the ranks that can matter."""
        for batch in batches:
            data = []
            for x in batch.column(3).to_pylist():
                keys = _ranked(np.frombuffer(x, _KEY).copy())
                data.append(keys[keys["n"] <= high].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], schema=MESSAGE)

    def answer(listed: pa.Table, asked: pa.Table) -> pa.Table:
        return _next_holders(listed, asked, low, high)

    def name(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        named = set()
        for row, found in _named(left, right):
            new = {p for part in found.values() for p in part["doc"][part["n"] < high].tolist()}
            named |= new.difference(np.frombuffer(row["tried"], "<i8").tolist())
        named = sorted(named)
        return pa.table([pa.array(named, pa.int64()), pa.array([key[0].as_py()] * len(named), pa.int32())], names=["id", "cell"])

    def align(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lines, out = _sent_lines(right), []
        for row, found in _named(left, right):
            h, n = np.frombuffer(row["lines"], "<u8"), np.frombuffer(row["words"], "<i4")
            own, words, runs = h.tolist(), n.tolist(), line_runs(h, n, min_words)
            cut = set(np.frombuffer(row["removed"] or b"", "<i4").tolist())
            tried, seen, known = set(np.frombuffer(row["tried"], "<i8").tolist()), set(), set(own)
            bare = set(_uncovered(runs, cut, len(own)).tolist())
            for run, part in found.items():
                for partner in part["doc"][part["n"] < high].tolist():
                    if run not in bare:
                        break
                    if partner in tried:
                        continue
                    tried.add(partner)
                    for shape in {_without_foreign(text, known) for text in lines[partner]} - seen:
                        seen.add(shape)
                        cut.update(common_blocks(list(shape), own, words, min_words))
                        bare = set(_uncovered(runs, cut, len(own)).tolist())
            more = [run for run, part in found.items() if run in bare and len(part) and part["n"][-1] == high]
            out.append(_state(row, key[0].as_py(), cut, tried, np.array(more, np.uint64)))
        return pa.Table.from_pylist(out, _STATE)

    listed = holders.mapInArrow(lowest, MESSAGE_DDL)
    pairs = store(listed.groupBy("to").cogroup(asks.groupBy("to")).applyInArrow(answer, MESSAGE_DDL), "next-holders")
    wanted = store(heard(left, pairs, name, "id long, cell int"), "wanted")
    return heard(left, pairs.unionByName(lines_for(wanted)), align, _STATE_DDL)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, out: str = "removed_lines") -> DataFrame:
    """``docs`` with ``text`` rid of deleted lines and ``out``, their packed 32-bit numbers (null where none).

    An input column named ``out`` is replaced.
    """
    docs = docs.drop(out)
    gone = removed_lines(docs, key, text, min_words).dropDuplicates(["id", "sig"]).withColumnRenamed("removed", out)
    # merged at every size: a small answer would be broadcast and a large one not
    same = (docs[key].cast("long") == gone["id"]) & (F.xxhash64(docs[text]) == gone["sig"])
    joined = docs.join(gone.hint("merge"), same, "left")
    joined = joined.select(*(docs[c] for c in docs.columns), gone[out])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            values = batch.column(at).to_pylist()
            for r, cut in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if cut:
                    drop = set(np.frombuffer(cut, "<i4").tolist())
                    values[r] = "\n".join(x for i, x in enumerate(values[r].split("\n")) if i not in drop)
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, pa.string()))

    return joined.mapInArrow(rebuild, joined.schema)
