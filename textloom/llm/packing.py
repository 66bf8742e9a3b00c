"""Packing into fixed-length sequences: first-fit decreasing in randomised groups.

Documents become token ids plus an end id.  A document longer than a sequence is
cut into full sequences and a rest, so every id lies in one piece.  Rests are put
into bins by first-fit decreasing inside groups of about ``group_rows`` pieces,
dealt by a seeded hash of the document; a tournament tree over the bin
capacities finds the first bin with room in log time.

Defined cases: a null text is an empty one (the end id alone); ties in length go
by document id, start and checksum; rows with equal ids are packed one by one; an empty
table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import store, with_fields
from textloom.llm.words import BLANKS, bounds, buffers, mix, word_hashes

CAPACITY = 4096
GROUP_ROWS = 8192


class FirstFit:
    """Bins under a tournament tree: each inner node holds the largest room below it."""

    def __init__(self, capacity: int, most: int):
        self.size = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.size)
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) in the first bin with room."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= length
        own = node - self.size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return own, offset


#: Bytes of text that are worked on together, and bytes of units and ids that a Python worker remembers.
_TEXT_BYTES, _MEMORY = 2 << 20, 96 << 20
_TOGETHER = 4096  # units that the tokenizer gets at once
_TOKENIZERS: dict = {}
#: Kinds of bytes: blanks, letters, digits, other ASCII, and the rest.
_KIND = np.full(256, 4, np.uint8)
_KIND[:0x80] = 3
_KIND[list(BLANKS)] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2


def _units(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the pieces of text that the tokenizer works on one by one.

    A word of ASCII characters and precomposed Latin letters is cut where letters, digits and other characters meet and
    between digits, as the tokenizer itself does.  A word with anything else, with an apostrophe (contractions) or with ``<``
    (special tokens) is one unit.
    """
    starts, ends = bounds(body, at, BLANKS)
    kind = _KIND[body]
    # the two bytes of U+00C0 to U+024F, but for two signs and the one letter whose lower case is two characters
    lead, tail = body[:-1], body[1:]
    latin = (lead >= 0xC3) & (lead <= 0xC9) & (tail >= 0x80) & (tail < 0xC0)
    latin &= ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((lead == 0xC4) & (tail == 0xB0)) & ~((lead == 0xC9) & (tail >= 0x90))
    places = np.flatnonzero(latin)
    kind[places] = 1
    kind[places + 1] = 1
    odd = np.r_[0, np.cumsum((kind == 4) | (body == 0x27) | (body == 0x3C))]
    whole = odd[ends] > odd[starts]
    inner = np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
    word = np.searchsorted(starts, inner, side="right") - 1
    inner = inner[~whole[word] & (inner > starts[word])] if len(inner) else inner
    return np.sort(np.r_[starts, inner], kind="stable"), np.sort(np.r_[ends, inner], kind="stable")


class _Known:
    """Ids of units: those of the unit with the hash ``keys[i]`` are ``ids[cuts[i]:cuts[i + 1]]``; keys rise."""

    def __init__(self, keys: np.ndarray, cuts: np.ndarray, ids: np.ndarray):
        self.keys, self.cuts, self.ids = keys, cuts, ids

    @classmethod
    def none(cls) -> _Known:
        return cls(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, "<u4"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def with_more(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> _Known:
        keys, sizes, pool = np.r_[self.keys, keys], np.r_[np.diff(self.cuts), sizes], np.r_[self.ids, ids]
        order = np.argsort(keys, kind="stable")
        begins, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        cuts = np.r_[0, np.cumsum(sizes)]
        return _Known(keys[order], cuts, pool[np.repeat(begins - cuts[:-1], sizes) + np.arange(len(pool))])

    def bytes(self) -> int:
        return 16 * len(self.keys) + 4 * len(self.ids)


class WordIds:
    """Ids of texts, each distinct unit of which is worked out when first met.

    For tokenizers that drop white space, never look across it and lower-case.  Units that differ in the case of ASCII
    letters are one, but for those that may hold a special token, which is told by its exact letters.  What is new joins a
    small table and that, now and then, the large one; when both are too large, the small one takes its place.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.large, self.small = _Known.none(), _Known.none()

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and the cuts between its rows."""
        body, rows = buffers(column)
        starts, ends = _units(body, rows) if len(body) else (np.zeros(0, np.int64),) * 2
        keys = word_hashes(body, starts, ends, True)
        marks = np.flatnonzero((body[:-1] == ord("<")) & (body[1:] == ord("|")))
        exact = np.unique(np.searchsorted(starts, marks, side="right") - 1)
        if len(exact):
            keys[exact] = mix(word_hashes(body, starts[exact], ends[exact], False) + np.uint64(1))
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        begins, sizes, pool = self._ids_of(distinct, body, starts[first], ends[first])
        begins, sizes = begins[place], sizes[place]
        stops = np.cumsum(sizes)
        out = pool[np.repeat(begins - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        return out, np.r_[0, stops][np.searchsorted(starts, rows)]

    def _ids_of(self, keys: np.ndarray, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each key begin, how many there are, and the ids."""
        old = self.large.find(keys)
        new = np.flatnonzero(old < 0)
        new = new[self.small.find(keys[new]) < 0]
        if len(new):
            raw = body.tobytes()
            units = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            found: list[list[int]] = []
            for a in range(0, len(units), _TOGETHER):
                found += [e.ids for e in self.tokenizer.encode_batch_fast(units[a : a + _TOGETHER], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), "<u4")
            self.small = self.small.with_more(keys[new], np.array([len(x) for x in found], np.int64), ids)
        at = self.small.find(keys)
        young = at >= 0
        begins, sizes = (np.where(young, self.small.cuts[at + lag] + len(self.large.ids), self.large.cuts[old + lag]) for lag in (0, 1))
        out = begins, sizes - begins, np.concatenate([self.large.ids, self.small.ids])
        if self.large.bytes() + self.small.bytes() > _MEMORY:
            self.large, self.small = self.small, _Known.none()
        elif 4 * len(self.small.keys) > len(self.large.keys):
            self.large = self.large.with_more(self.small.keys, np.diff(self.small.cuts), self.small.ids)
            self.small = _Known.none()
        return out


def _word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def by_bytes(column: pa.Array, most: int) -> Iterator[slice]:
    """Slices of rows of about ``most`` bytes of text; a longer text is one by itself."""
    _, at = buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield slice(row, end)
        row = end


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 2,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece; texts are read a few MB at a time."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _word_ids(tokenizer)
        for batch in batches:
            for part in by_bytes(batch.column(1), _TEXT_BYTES):
                rows = [[], [], [], [], []]
                docs, texts = (c.slice(part.start, part.stop - part.start) for c in batch.columns)
                ids, cuts = own.of(texts)
                for doc, a, b in zip(docs.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    total = b - a + 1
                    tokens = ids[a:b].tobytes() + end
                    for start in range(0, total, capacity):
                        piece = tokens[4 * start : 4 * (start + capacity)]
                        for column, x in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), total)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 17) -> DataFrame:
    """``pieces`` plus ``sequence_id, offset, sequence_length``; a sequence never leaves its group."""
    pieces = store(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = group["length"].to_pylist()
        bins = FirstFit(capacity, len(lengths))
        spots = [bins.place(n) for n in lengths]
        number, offset = np.array([s[0] for s in spots], np.int64), np.array([s[1] for s in spots], np.int64)
        used = np.bincount(number, lengths).astype(np.int64)
        base = np.int64(group["_group"][0].as_py()) << np.int64(32)
        out = group.drop_columns(["_group"])
        for name, values in (("sequence_id", base + number), ("offset", offset), ("sequence_length", used[number])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    schema = with_fields(pieces.schema, sequence_id="long", offset="long", sequence_length="long")
    return dealt.groupBy("_group").applyInArrow(fill, schema)
