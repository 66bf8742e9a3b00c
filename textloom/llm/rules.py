"""Quality rules as weak supervision.

Each rule votes good or bad on a document or abstains.  Expectation-maximisation
over the counts of the vote patterns (at most 3 to the number of rules, whatever
the size of the table) estimates how often each rule is right about good
and about bad documents, and the posterior probability of a good document replaces all-must-pass filtering.

Defined cases: null, empty and blank texts have no words, fail the base rule and
are not kept; equal rows give equal results; documents that fail the base rule take no part in the estimate;
with nothing to estimate from, the starting accuracies hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import free_name, store, with_fields
from textloom.llm.words import BLANKS, Words, grams

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
GOOD, BAD, ABSTAIN = 1, 0, -1
_SLICE = 4 << 20


def _repeat_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """Words of each row in windows that occur twice or more in it."""
    row = words.rows()
    n = len(words.h)
    if n < size + 1:
        return np.zeros(len(words.counts), np.int64)
    same = row[: n - size + 1] == row[size - 1 :]
    at = np.flatnonzero(same)
    key = grams(words.h, size)[at]
    order = np.lexsort((key, row[at]))
    k, r = key[order], row[at][order]
    twin = np.zeros(len(order), bool)
    if len(order) > 1:
        equal = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        twin[1:] |= equal
        twin[:-1] |= equal
    starts = at[order[twin]]
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + size, -1)
    return np.bincount(row, np.cumsum(depth[:-1]) > 0, len(words.counts)).astype(np.int64)


def _stats(column: pa.Array) -> Iterator[list[np.ndarray]]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + _SLICE, side="right")) - 1)
        words = Words(column[i:j], BLANKS)
        body, at = words.body, words.at
        upto = lambda mask: np.r_[0, np.cumsum(mask)]
        point = upto((body & 0xC0) != 0x80)
        symbol = upto(np.isin(body, np.frombuffer(SYMBOLS, np.uint8)))
        chars = np.bincount(words.rows(), point[words.ends] - point[words.starts], j - i).astype(np.int64)
        lines, doubles = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
        for r in range(j - i):
            seen: set[bytes] = set()
            for line in body[at[r] : at[r + 1]].tobytes().split(b"\n"):
                if line.strip(BLANKS):
                    lines[r] += 1
                    doubles[r] += line in seen
                    seen.add(line)
        yield [words.counts, chars, symbol[at[1:]] - symbol[at[:-1]], lines, doubles, _repeat_words(words)]
        i = j


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``STATS``.  Input columns with those names are replaced."""
    docs = docs.drop(*STATS)
    rest = docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_stats(batch.column(batch.num_columns - 1))) or [[np.zeros(0, np.int64)] * len(STATS)]
            found = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], *STATS])

    schema = with_fields(rest.schema, **dict.fromkeys(STATS, "long"))
    return docs.select(*rest.columns, F.col(text).alias("_t")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def default_rules() -> dict[str, Column]:
    """Votes from ``STATS``: each rule is sure at both ends and abstains between."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    length = F.col("word_chars") / words
    return {
        "word_length": _vote((length < 2.5) | (length > 14), length.between(3, 10)),
        "symbols": _vote(F.col("n_symbols") > 0.1 * words, F.col("n_symbols") <= 0.01 * words),
        "double_lines": _vote(F.col("n_dup_lines") > 0.3 * lines, F.col("n_dup_lines") == 0),
        "repeats": _vote(F.col("n_repeat_words") > 0.15 * words, F.col("n_repeat_words") == 0),
        "size": _vote(F.col("n_words") < 25, F.col("n_words") >= 60),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, turns: int = 200, right: float = 8.0, wrong: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and each rule's accuracy on (bad, good), by EM.

    Accuracies have a Beta(right, wrong) prior, counted in documents, so an
    unused rule keeps its starting accuracy and the classes cannot change places.
    """
    accuracy = np.full((2, votes.shape[1]), right / (right + wrong))
    share, posterior = 0.8, np.full(len(votes), 0.5)
    for _ in range(turns):
        logit = np.log(share / (1 - share)) * np.ones(len(votes))
        logit += np.where(votes == GOOD, np.log(accuracy[1] / (1 - accuracy[0])), 0).sum(1)
        logit += np.where(votes == BAD, np.log((1 - accuracy[1]) / accuracy[0]), 0).sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        moved, posterior = np.abs(new - posterior).max(initial=0), new
        for c, weight in ((0, (1 - posterior) * counts), (1, posterior * counts)):
            hit = ((votes == c) * weight[:, None]).sum(0) + right
            accuracy[c] = hit / (hit + ((votes == 1 - c) * weight[:, None]).sum(0) + wrong)
        accuracy = np.clip(accuracy, 0.55, 0.999)
        share = float(np.clip((posterior @ counts + right) / (counts.sum() + right + wrong), 0.02, 0.98))
        if moved < 1e-9:
            break
    return posterior, accuracy


def judge(stats: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """``stats`` plus ``base_failed``, ``p_good`` and ``kept``; input columns of these names are replaced."""
    rules, stats = rules or default_rules(), stats.drop("base_failed", "p_good", "kept")
    prefix = free_name(stats, "_vote")
    names = [f"{prefix}{number}" for number in range(len(rules))]
    voted = store(stats.withColumn("base_failed", base_failed()).withColumns(dict(zip(names, rules.values()))), "votes")
    patterns = voted.where("not base_failed").groupBy(*names).count().toPandas()  # at most 3 ** rules rows
    votes = patterns[names].to_numpy().reshape(-1, len(names))
    posterior, _ = estimate(votes, patterns["count"].to_numpy(dtype=float))
    rows = [(*map(int, v), float(p)) for v, p in zip(votes, posterior)]
    known = stats.sparkSession.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", p_good double")
    out = voted.join(F.broadcast(known), names, "left").drop(*names)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_good") >= threshold, F.lit(False)))
