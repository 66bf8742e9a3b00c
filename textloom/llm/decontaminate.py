"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to lower-case words and cut into windows of 13
words; an item of fewer words is one window.  The automaton holds every window
once.  A document is normalised the same way, scanned once, and the end of each
match is mapped to word numbers and to byte offsets of the original text.

Defined cases: null and empty texts have no words and no hits; an item without
words or without an id has no window; an empty benchmark hits nothing; texts of any length are scanned whole; windows shared by items hit all of them; equal rows give
equal rows; other columns of ``docs`` pass through, and input columns that have the
name of a result column (``columns``) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.words import NOT_ALNUM, bounds, buffers

WINDOW = 13
#: Normalised benchmark bytes in one automaton.  A larger benchmark is scanned for in blocks, one automaton each.
BLOCK_BYTES = 4 << 20

_TABLE = bytearray(range(256))
for _b in NOT_ALNUM:
    _TABLE[_b] = 0x20
for _b in range(0x41, 0x5B):
    _TABLE[_b] = _b + 0x20
_TABLE = bytes(_TABLE)
_NOT_WORD = bytes(b for b in range(256) if _TABLE[b] == 0x20)

SPAN = T.StructType([
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType()),
])


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(words: list[bytes], size: int = WINDOW) -> set[str]:
    """Windows as blank-framed strings, one character for each byte."""
    last = max(1, len(words) - size + 1) if words else 0
    return {" " + b" ".join(words[i : i + size]).decode("latin-1") + " " for i in range(last)}


def automaton(items: list[tuple[int, str]], size: int = WINDOW) -> tuple[ahocorasick.Automaton, list[list[int]]] | None:
    """The automaton, whose values are (words of the window, window number), and the items of each window."""
    owners: dict[str, list[int]] = {}
    for item, text in items:
        for window in windows(normal_words(text), size):
            owners.setdefault(window, []).append(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for number, window in enumerate(owners):
        found.add_word(window, (window.count(" ") - 1, number))
    found.make_automaton()
    return found, list(owners.values())


#: Automata of a Python worker, by the digest of their items; the last few are kept.
_BUILT: dict[tuple[str, int], tuple | None] = {}


def _automaton_of(digest: str, items: list[tuple[int, str]], size: int):
    if (digest, size) not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[digest, size] = automaton(items, size)
    return _BUILT[digest, size]


def _scan(
    batches: Iterator[pa.RecordBatch], digest: str, items: list[tuple[int, str]], text: str, size: int, columns: tuple[str, str, str],
) -> Iterator[pa.RecordBatch]:
    """Batches with the result columns; where they are there, from another automaton, results are merged."""
    built = _automaton_of(digest, items, size)
    kind = pa.struct([(f.name, pa.int64()) for f in SPAN])
    for batch in batches:
        column = batch.column(text)
        body, at = buffers(column)
        counts, spans, owners = [], [], []
        for r in range(len(column)):
            raw = body[at[r] : at[r + 1]].tobytes()
            words = raw.translate(_TABLE).split()
            counts.append(len(words))
            spans.append([])
            owners.append([])
            if not built or not words:
                continue
            line = " " + b" ".join(words).decode("latin-1") + " "
            hits = list(built[0].iter(line))
            if not hits:
                continue
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
            last = np.searchsorted(blanks, [end for end, _ in hits]) - 1
            first = last - np.array([n for _, (n, _) in hits]) + 1
            starts, ends = bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _NOT_WORD)
            order = np.argsort(first, kind="stable")
            reach = np.maximum.accumulate(last[order])
            new = np.r_[True, first[order][1:] > reach[:-1] + 1]
            for a, b in zip(first[order][new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]):
                spans[-1].append((int(a), int(b), int(starts[a]), int(ends[b])))
            owners[-1] = sorted({i for _, (_, w) in hits for i in built[1][w]})
        if columns[0] in batch.schema.names:
            known, seen = (batch.column(c).to_pylist() for c in columns[1:])
            spans = [_merge([tuple(x.values()) for x in a] + b) for a, b in zip(known, spans)]
            owners = [sorted({*a, *b}) for a, b in zip(seen, owners)]
            batch = batch.select([c for c in batch.schema.names if c not in columns])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(counts, pa.int64()),
             pa.array([[dict(zip(SPAN.names, s)) for s in row] for row in spans], pa.list_(kind)),
             pa.array(owners, pa.list_(pa.int64()))],
            names=[*batch.schema.names, *columns],
        )


def _merge(spans: list) -> list[tuple[int, int, int, int]]:
    out: list[list[int]] = []
    for a, b, x, y in sorted(tuple(s) for s in spans):
        if out and a <= out[-1][1] + 1:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, y
        else:
            out.append([a, b, x, y])
    return [tuple(s) for s in out]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, block_bytes: int = BLOCK_BYTES, columns: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
) -> DataFrame:
    """``docs`` plus the word count, the merged hit spans and the sorted ids of the items hit.

    The benchmark is the stated query set.  It is read in blocks whose size is
    checked (``block_bytes`` of text), so what is sent to the tasks is bounded.
    Every block is one pass over the rows as they stream by; no shuffle.
    """
    docs = docs.drop(*columns)
    sizes = benchmark.select(
        F.col(item_id).cast("long").alias("i"), F.coalesce(item_text, F.lit("")).alias("t")
    ).withColumn("b", F.octet_length("t"))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    schema = T.StructType([
        *docs.schema.fields, T.StructField(columns[0], T.LongType()), T.StructField(columns[1], T.ArrayType(SPAN)),
        T.StructField(columns[2], T.ArrayType(T.LongType())),
    ])
    out = docs
    for number in range(blocks):
        own = sizes.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number).select("i", "t")
        items = sorted((r["i"], r["t"]) for r in own.where("i is not null").collect())
        digest = hashlib.sha256(repr(items).encode()).hexdigest()
        scan = partial(_scan, digest=digest, items=items, text=text, size=size, columns=columns)
        out = out.mapInArrow(scan, schema)
    return out


def hit_words(spans: str) -> F.Column:
    """Words inside any span."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)


def is_contaminated(hit: F.Column, words: F.Column) -> F.Column:
    """At least a twentieth of the words are hit."""
    return (hit > 0) & (20 * hit >= words)
