"""Unigram token counts by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and its piece count, never
a path.  Scores are summed in 32-bit floats and ties are settled as the public
unigram tokenizer does: at each end the candidate that starts first wins, unless a later one
is strictly better; a character that is no piece by itself costs the least score less ten, and
unknown characters side by side are one token.

Blanks become the piece mark and one mark is put in front.  No piece has a mark after another
character, so marked segments are independent.  The distinct new segments of some texts go
through the automaton together, and the dynamic programming takes a step for the k-th characters of
all of them at once; their counts are remembered.  ``byte_pieces``: an unknown character counts as its UTF-8 bytes.

Defined cases: null and empty texts have no tokens; equal rows give equal counts; texts of any length are
counted whole; an empty table gives an empty table; an input column with the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import with_fields

MARK = "▁"
#: Characters of segments that a Python worker remembers in each of two generations, and of texts worked on together.
MEMORY, _TEXT_CHARS = 8_000_000, 2_000_000
#: Segments worked on together, and their greatest length; longer ones are worked out one by one.
_TOGETHER, _LONG = 16_384, 64
_GAP = "\U0010ffff"
_UNKNOWN = np.float32(10)


class SegmentCounts:
    """Piece counts of marked segments, worked out when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.automaton = ahocorasick.Automaton()
        for number, (piece, _) in enumerate(pieces):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.sizes = np.array([len(p) for p, _ in pieces], np.int64)
        self.scores = np.array([s for _, s in pieces], np.float32)
        self.unknown = self.scores.min() - _UNKNOWN
        self.byte_pieces = byte_pieces
        inner = re.compile(f"[^{MARK}]{MARK}")
        # unknown characters must not meet across segments either: the mark is a piece, or each of them counts
        self.separable = not any(inner.search(p) for p, _ in pieces) and (byte_pieces or any(p == MARK for p, _ in pieces))
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held = 0

    def totals(self, texts: list[str | None]) -> list[int]:
        """Token counts of texts."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        split = [_SEGMENTS.findall(m) if self.separable else [m] * bool(m) for m in marked]
        known: dict[str, int] = {}
        for part in split:
            known.update(dict.fromkeys(part, 0))
        new = []
        for segment in known:
            n = self.young.get(segment) or self.old.get(segment)
            if n:
                known[segment] = n
            else:
                new.append(segment)
        if new:
            counts = self.count_all(new)
            known.update(zip(new, counts))
            self._remember(zip(new, counts), sum(map(len, new)))
        return [sum(map(known.__getitem__, part)) for part in split]

    def _remember(self, counts, size: int) -> None:
        """A full generation becomes the old one, and what was the old one goes."""
        if self.held + size > MEMORY:
            self.old, self.young, self.held = self.young, {}, 0
        self.young.update(counts)
        self.held += size

    def count(self, segment: str) -> int:
        return self.count_all([segment])[0]

    def count_all(self, segments: list[str]) -> list[int]:
        """Piece counts of segments; short ones are worked out together, those of like length in one go."""
        out, groups = [0] * len(segments), {}
        for i, segment in enumerate(segments):
            if len(segment) > _LONG:
                out[i] = self._viterbi_one(segment)
            else:
                groups.setdefault(len(segment).bit_length(), []).append(i)
        for group in groups.values():
            for at in range(0, len(group), _TOGETHER):
                own = group[at : at + _TOGETHER]
                for i, n in zip(own, self._viterbi([segments[i] for i in own])):
                    out[i] = n
        return out

    def _viterbi_one(self, segment: str) -> int:
        """The same, character by character, for a long segment."""
        size, none = len(segment), np.float32(-np.inf)
        best, count, tail = [np.float32(0)] + [none] * size, [0] * (size + 1), [False] * (size + 1)
        single, at = False, 0

        def pass_end() -> None:
            """Leave an end: a character without a piece of its own may be unknown."""
            if at and not single:
                total = best[at - 1] + self.unknown
                if total > best[at]:
                    more = len(segment[at - 1].encode()) if self.byte_pieces else not tail[at - 1]
                    best[at], count[at], tail[at] = total, count[at - 1] + more, True

        for last, piece in self.automaton.iter(segment):
            while at <= last:
                pass_end()
                at, single = at + 1, False
            start = at - int(self.sizes[piece])
            total = best[start] + self.scores[piece]
            if total > best[at]:
                best[at], count[at] = total, count[start] + 1
            single = single or start == at - 1
        while at <= size:
            pass_end()
            at, single = at + 1, False
        return count[size]

    def _viterbi(self, segments: list[str]) -> list[int]:
        sizes = np.array([len(s) for s in segments], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1  # a gap that no piece holds is behind each segment
        joined = _GAP.join(segments)
        found = np.fromiter(self.automaton.iter(joined), np.dtype([("end", "i8"), ("piece", "i8")]))
        end = found["end"] + 1
        owner = np.searchsorted(begins, found["end"], side="right") - 1
        step, length = end - begins[owner], self.sizes[found["piece"]]
        # cell e of a segment: what is best for its first e characters
        most = int(sizes.max(initial=0))
        best = np.full((len(segments), most + 1), -np.inf, np.float32)
        count = np.zeros((len(segments), most + 1), np.int64)
        tail = np.zeros((len(segments), most + 1), bool)  # the best ends in an unknown character
        single = np.zeros((len(segments), most + 1), bool)
        best[:, 0] = 0
        single[owner[length == 1], step[length == 1]] = True
        weight = self._unknown_sizes(segments, sizes, most)
        # matches come by segment and end, the longest piece first; the rank of a match at its end is its turn
        order = np.argsort(step.astype(np.int16), kind="stable")
        owner, step, length, score = owner[order], step[order], length[order], self.scores[found["piece"][order]]
        first = np.ones(len(order), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (step[1:] != step[:-1])
        at = np.arange(len(order))
        turn = at - np.maximum.accumulate(np.where(first, at, 0))
        cuts = np.searchsorted(step, np.arange(most + 2))
        for e in range(1, most + 1):
            part = slice(cuts[e], cuts[e + 1])
            o, n, s, t = owner[part], length[part], score[part], turn[part]
            for r in range(int(t.max(initial=-1)) + 1):
                own, size, add = (o, n, s) if len(o) == 0 else (o[t == r], n[t == r], s[t == r])
                total = best[own, e - size] + add
                better = total > best[own, e]
                own, size = own[better], size[better]
                best[own, e], count[own, e] = total[better], count[own, e - size] + 1
            open_ = np.flatnonzero((sizes >= e) & ~single[:, e])
            if len(open_):
                total = best[open_, e - 1] + self.unknown
                better = total > best[open_, e]
                own = open_[better]
                more = weight[own, e] if self.byte_pieces else ~tail[own, e - 1]
                best[own, e], count[own, e], tail[own, e] = total[better], count[own, e - 1] + more, True
        return count[np.arange(len(segments)), sizes].tolist()

    def _unknown_sizes(self, segments: list[str], sizes: np.ndarray, most: int) -> np.ndarray | None:
        """UTF-8 bytes of each character, where they count."""
        if not self.byte_pieces:
            return None
        out = np.zeros((len(segments), most + 1), np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        row = np.repeat(np.arange(len(segments)), sizes)
        out[row, np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = width
        return out


_SEGMENTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_COUNTERS: dict = {}


def count_text(counts: SegmentCounts, text: str | None) -> int:
    return counts.totals([text])[0]


def model_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and scores of a sentencepiece model file, and whether it has byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids)


def token_counts(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` plus the token count of each text.  An input column named ``out`` is replaced."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _COUNTERS.get(model_path)
        if counts is None:
            counts = _COUNTERS[model_path] = SegmentCounts(*model_pieces(model_path))
        for batch in batches:
            n: list[int] = []
            part, chars = [], 0
            for value in batch.column(batch.num_columns - 1):
                part.append(value.as_py())
                chars += len(part[-1] or "")
                if chars > _TEXT_CHARS:
                    n += counts.totals(part)
                    part, chars = [], 0
            n += counts.totals(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], out])

    return docs.select("*", F.col(text).alias("_count_text")).mapInArrow(run, with_fields(docs.schema, **{out: "long"}))
