"""Elements of large JSON array files, read by several tasks each.

A file is read as text that is cut after every closing brace, which Spark can
split at any byte.  Whether a brace, a comma or a quote counts depends on what comes
before it, so there are two passes.  The first says for each split how it changes
the state (inside a string or not, depth of brackets) from either state it may begin in; a
table of one row a split, summed up in file order, gives the state at each split's start.
The second cuts the splits at the commas of the outer list.  An element that lies across
splits leaves a part in each, and the parts are put together by the number of the element.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces end with this character; it is put back in front of the scan.
_CUT = "}"
_NOT_A_LIST = "the input must be a JSON list"
_KINDS = np.zeros(256, np.int8)
_KINDS[[ord("["), ord("{")]] = 1
_KINDS[[ord("]"), ord("}")]] = -1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
#: Bytes that are scanned at once; the arrays of a scan take about a hundred bytes for each.
_STEP = 1 << 19


@dataclass
class _Scan:
    """State of a scan: inside a string, the depth of brackets, and whether an odd run of backslashes came last."""

    inside: bool = False
    depth: int = 0
    odd: bool = False

    def step(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each byte lies outside strings, and the depth after it; moves the state on."""
        at = np.arange(len(body))
        other = np.maximum.accumulate(np.where(body != ord("\\"), at, -1))
        slashes = np.zeros(len(body), np.int64)
        slashes[1:] = at[:-1] - other[:-1]  # an unbroken run of them before each byte
        if self.odd:  # the run goes on from the bytes before
            slashes[: int(np.argmax(np.r_[body != ord("\\"), True])) + 1] += 1
        quote = (body == ord('"')) & (slashes % 2 == 0)
        parity = np.cumsum(quote) + self.inside
        outside = ((parity - quote) % 2 == 0) & ~quote
        depth = self.depth + np.cumsum(np.where(outside, _KINDS[body], 0))
        if len(body):
            last = body[-1] == ord("\\")
            self.inside, self.depth, self.odd = bool(parity[-1] % 2), int(depth[-1]), bool(last and slashes[-1] % 2 == 0)
        return outside, depth


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """``file, start of the split, bytes`` of the rows of one split, at most ``_STEP`` bytes at once."""
    for batch in batches:
        files, starts, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(3)
        now, held, size = None, [], 0
        for i, start in enumerate(starts):
            split = (files[i].as_py(), start)
            if held and (split != now or size > _STEP):
                yield from _steps(now, held)
                held, size = [], 0
            body = texts[i].as_py().encode()
            now, size = split, size + len(body)
            held += [body, _CUT.encode()]
        if held:
            yield from _steps(now, held)


def _steps(split: tuple[str, int], held: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
    body = b"".join(held)
    for at in range(0, len(body), _STEP):
        yield *split, body[at : at + _STEP]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece of text up to a closing brace, with the split it was read in."""
    return spark.read.option("lineSep", _CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), "value",
    )


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], list] = {}
    for file, start, body in _bodies(batches):
        scans = seen.setdefault((file, start), [_Scan(False), _Scan(True), 0])
        raw = np.frombuffer(body, np.uint8)
        for scan in scans[:2]:
            scan.step(raw)
        scans[2] += len(raw)
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([f for f, _ in seen], pa.string()), "start": pa.array([s for _, s in seen], pa.int64()),
        "flips": pa.array([v[0].inside for v in seen.values()], pa.bool_()),
        "rise": pa.array([v[0].depth for v in seen.values()], pa.int64()), "rise_inside": pa.array([v[1].depth for v in seen.values()], pa.int64()),
        "bytes": pa.array([v[2] for v in seen.values()], pa.int64()),
    })


def split_states(pieces: DataFrame) -> DataFrame:
    """``file, start, inside, depth`` at the start of each split, and ``last``: the file's last split, whose last brace is put in."""
    told = pieces.mapInArrow(_survey, "file string, start long, flips boolean, rise long, rise_inside long, bytes long")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    known = told.withColumn("inside", inside)
    rise = F.when(F.col("inside"), F.col("rise_inside")).otherwise(F.col("rise"))
    depth = F.coalesce(F.sum(rise).over(before), F.lit(0))
    return known.select("file", "start", "inside", depth.alias("depth"), F.lead("start").over(order).isNull().alias("last"))


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, raw``: the text of each element of every array file under ``path``.

    A file that is no single list, or whose list has an empty place, stops the job.  The
    states of the splits go to all tasks: one small row for each split of the files.
    """
    pieces = _pieces(spark, path)
    states = {(r["file"], r["start"]): (r["inside"], r["depth"], r["last"]) for r in split_states(pieces).collect()}
    box = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A brace is put behind every piece, also behind the last one of a file, which has none: so one byte is held back.
        now, scan, held, open_text, opened, number, lists = None, _Scan(), b"", [], False, 0, 0
        rows: list[tuple[str, int, int, bool, bool, str]] = []

        def feed(body: bytes) -> None:
            nonlocal open_text, opened, number, lists
            if not body:
                return
            raw = np.frombuffer(body, np.uint8)
            depth_before = scan.depth
            outside, depth = scan.step(raw)
            was = np.r_[depth_before, depth[:-1]]
            ends = outside & (((raw == ord(",")) & (depth == 1)) | ((raw == ord("]")) & (depth == 0) & (was == 1)))
            begins = outside & (raw == ord("[")) & (depth == 1) & (was == 0)
            stray = (depth < 1) & ~ends & ~begins & ~(outside & _BLANK[raw]) | outside & (raw == ord("{")) & (was == 0)
            lists += int(begins.sum()) + (now[1] > 0 and begins.any())
            if stray.any() or lists > 1:
                raise ValueError(_NOT_A_LIST)
            at = 0
            for i in np.flatnonzero(ends | begins):
                if begins[i]:
                    opened, open_text = True, []
                else:
                    open_text.append(body[at:i])
                    text = b"".join(open_text).decode()
                    if number or raw[i] == ord(",") or not opened or text.strip():  # else the list is empty
                        rows.append((*now, number, opened, True, text))
                    opened, open_text, number = raw[i] == ord(","), [], number + 1
                at = i + 1
            if scan.depth >= 1:
                open_text.append(body[at:])

        def close() -> None:
            if now is None:
                return
            feed(held[:-1] if box.value[now][2] else held)
            if scan.depth >= 1:
                rows.append((*now, number, opened, False, b"".join(open_text).decode()))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "number", "opens", "closes", "part"])
            rows.clear()
            return done

        for file, start, body in _bodies(batches):
            if (file, start) != now:
                close()
                now, held = (file, start), b""
                scan, open_text, opened, number, lists = _Scan(*box.value[now][:2]), [], False, 0, 0
            feed(held)
            held = body
            if rows:
                yield out()
        close()
        yield out()

    parts = pieces.mapInArrow(cut, "file string, start long, number long, opens boolean, closes boolean, part string")
    whole = parts.where("opens and closes").select("file", F.col("part").alias("raw"))
    return whole.unionByName(_joined(parts.where("not (opens and closes)")))


def _joined(parts: DataFrame) -> DataFrame:
    """Elements across splits: at most two parts a split; a part that opens begins the next element."""
    order = Window.partitionBy("file").orderBy("start", "number")
    of = F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = parts.withColumn("_of", of).groupBy("file", "_of").agg(
        F.array_sort(F.collect_list(F.struct("start", "number", "part"))).alias("_p"),
        F.bool_or("closes").alias("_closed"), F.bool_or("opens").alias("_opened"),
    )
    text = F.array_join(F.transform("_p", lambda p: p["part"]), "")
    broken = F.raise_error(F.lit(_NOT_A_LIST)).cast("string")
    return grouped.select("file", F.when(F.col("_closed") & F.col("_opened"), text).otherwise(broken).alias("raw"))
