"""Audit of how document filters interact, by an existential self-join.

Four filters look at one row; the fifth fails a document whose text is the text
of a document with a smaller id.  That one is a left-semi join on hash, exact
text and smaller id.  Only texts whose hash occurs under two ids go into it, and
each distinct text stands once on the right, with its smallest id.  Failing ids
of all filters are united and every document becomes one bit combination; what
any order of the filters keeps, removes and loses follows from the number of
documents of each combination, so the orders cost nothing on the data.

Defined cases: a null text is empty and fails the first filter alone (and the
fifth, after another empty text); a null part is the empty string; a row without an id is never a
copy and never the first of its text; rows that share an id are counted one by
one and are no copies of each other; a document is good or toxic when any of its
label rows says so; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.cells import store

FILTERS = "ABCDE"
COPY = "E"
_CAPITALS = "[A-Z]"
_BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    """Bounds of the row filters A to D."""

    min_words: int = 100
    min_distinct_percent: int = 80
    max_capital_percent: int = 10
    symbols: str = "#$%&*|"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def row_failures(text: Column, limits: Limits = Limits()) -> Column:
    """Bits of the row filters that a text fails."""
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")
    tests = {
        "A": lambda w: F.size(w) < limits.min_words,
        "B": lambda w: 100 * F.size(F.array_distinct(w)) < limits.min_distinct_percent * F.size(w),
        "C": lambda w: 100 * F.regexp_count(text, F.lit(_CAPITALS)) > limits.max_capital_percent * F.length(text),
        "D": lambda w: F.translate(text, limits.symbols, "") != text,
    }
    bits = lambda w: sum((F.when(test(w), _bit(k)).otherwise(0) for k, test in tests.items()), F.lit(0))
    return F.transform(F.array(words), bits)[0]  # the words are found once


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """``id, part, failed, copies``: the failed filters as bits, and the rows of that id, part and text."""
    given = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    rows = store(given.select("id", "part", "h", row_failures(F.col("text"), limits).alias("failed")), "audit-rows")
    held = rows.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    twice = store(held.where("low < high").select("h"), "audit-hashes")
    texts = store(given.join(twice, "h", "left_semi"), "audit-texts")
    first = store(texts.groupBy("h", "text").agg(F.min("id").alias("first")), "audit-first")
    earlier = (texts["h"] == first["h"]) & (texts["text"] == first["text"]) & (first["first"] < texts["id"])
    copies = texts.join(first, earlier, "left_semi")
    marks = rows.withColumn("rows", F.lit(1)).unionByName(
        copies.select("id", "part", "h", F.lit(_bit(COPY)).alias("failed"), F.lit(0).alias("rows"))
    )
    one = marks.groupBy("id", "part", "h").agg(F.bit_or("failed").alias("failed"), F.sum("rows").alias("copies"))
    return one.select("id", "part", "failed", "copies")


def combinations(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``part, failed, n, good, toxic``: documents of each bit combination, a table of 32 rows a part at most."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    sums = [F.sum(F.col("copies") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    return failed.join(known, "id", "left").groupBy("part", "failed").agg(F.sum("copies").alias("n"), *sums)


def orders(filters: str = FILTERS) -> Column:
    """Every order of the filters, as an array of strings."""
    return F.array(*[F.lit("".join(p)) for p in permutations(filters)])


def step_counts(table: DataFrame) -> DataFrame:
    """What each step of each order does to each part, from a table of :func:`combinations`."""
    bits = F.create_map(*[F.lit(x) for k in FILTERS for x in (k, _bit(k))])
    by_order = table.withColumn("filter_order", F.explode(orders())).select(
        "*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")
    )
    before = F.aggregate(
        F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda acc, k: acc.bitwiseOR(bits[k])
    )
    steps = by_order.withColumn("bit", bits[F.col("letter")]).withColumn("before", before)
    failed = F.col("failed")
    fails, gone = failed.bitwiseAND(F.col("bit")) != 0, failed.bitwiseAND(F.col("before")) != 0
    share = F.lit(factorial(len(FILTERS))) / F.bit_count(failed)  # in as many orders this filter comes first of those that fail

    def total(when: Column, value: Column) -> Column:
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    return steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step")).agg(
        total(~fails & ~gone, F.col("n")).alias("kept"),
        total(fails & ~gone, F.col("n")).alias("removed"),
        total(fails & gone, F.col("n")).alias("redundant"),
        total(failed == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(fails & ~gone, F.col("good")).alias("good_lost"),
        total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * share.cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return step_counts(combinations(failures(docs, key, text, part, limits), labels, key))
