"""Top-k by TF-IDF over an inverted index, in columns.

Terms are lower-cased runs of letters and digits.  A text weighs a term by
``1 + ln(tf)``, scaled to length one; a question weighs it by that times
``ln((n + 1) / (df + 1))`` and is scaled to length one as well.  Weights and scale of a text are
worked out inside its row, so the index costs no shuffle: it is a scan that
keeps the terms which some question asks for, keyed by a 64-bit hash.

A question's terms are taken in the order of their greatest impact.  Partial
sums over the first few terms give a score that its k-th result is sure to
reach; terms that together cannot lift a new text over it are only looked up
for texts that an earlier term has brought in.  So the lists of frequent terms,
which nearly all texts are in, are not joined with the questions that hold them.

Where the weights of all questions make a small matrix (``matrix_bytes``), they go to every task instead and the
texts are scanned: a slice of texts times that matrix is all their scores, and a task hands on its best rows only.
So the work grows with the texts and not with the lists of frequent terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions.text import let
from textloom.operators.numbering import written

#: Terms of a question that are summed up first, and what rounding may take from a bound.
LEAD_TERMS = 6
_SLACK = 1e-8
SCORE_DECIMALS = 9
#: Weights of all questions that are handed to every task, and texts that are scored at once.
MATRIX_BYTES = 32 << 20
_SLICE_ROWS = 512


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_weights(text: Column) -> Column:
    """``array<struct<term, weight>>``: the hash and weight of the distinct terms; equal terms stand side by side once sorted."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def weigh(first: Column) -> Column:
            ends = F.concat(F.slice(first, 2, F.size(first)), F.array(n))
            return F.zip_with(
                first, ends,
                lambda a, b: F.struct(F.get(ordered, a).alias("term"), (1 + F.log((b - a).cast("double"))).alias("weight")),
            )

        kind = "array<struct<term:bigint,weight:double>>"
        return F.when(n == 0, F.array().cast(kind)).otherwise(let(starts, weigh).cast(kind))

    found = F.coalesce(terms(text), F.array().cast("array<string>"))
    return let(F.sort_array(F.transform(found, lambda t: F.xxhash64(t))), runs)


def _unit(text: Column) -> Column:
    """The weights of a text, of length one."""
    def scaled(terms: Column) -> Column:
        length = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["weight"] * t["weight"]))
        unit = lambda by: F.transform(terms, lambda t: F.struct(t["term"].alias("term"), (t["weight"] / by).alias("weight")))
        return let(length, unit)

    return let(term_weights(text), scaled)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, term, weight``: a row for each distinct term of each text; the weights of a text have length one."""
    return df.select(F.col(key).alias("id"), F.inline(_unit(F.col(text))))


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each question; equal scores by the lower id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
    first = np.r_[True, q[order][1:] != q[order][:-1]]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k] if len(order) else order


def _scan(asked: DataFrame, wanted: DataFrame, corpus: DataFrame, k: int, corpus_id: str, text: str) -> DataFrame:
    """``q, id, rank, score``: every text against the matrix of all questions."""
    spark = corpus.sparkSession
    terms_ = np.sort(np.array([r["term"] for r in wanted.collect()], np.int64))  # no more than fit the matrix
    box = spark.sparkContext.broadcast(terms_)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = box.value
        for batch in batches:
            held, starts = batch.column(1).flatten(), np.asarray(batch.column(1).offsets)
            term = held.field("term").to_numpy()
            spot = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            hit = known[spot] == term if len(known) else np.zeros(len(term), bool)
            cut = pa.array(np.r_[0, np.cumsum(hit)][starts - starts[0]].astype(np.int32))
            lists = [pa.array(spot[hit].astype(np.int32)), pa.array(held.field("weight").to_numpy()[hit])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(cut, x) for x in lists]], names=["id", "terms", "weights"])

    weighed = corpus.select(F.col(corpus_id).alias("id"), _unit(F.col(text)).alias("w"))
    kind = weighed.schema["id"].dataType
    shape = T.StructType().add("id", kind).add("terms", T.ArrayType(T.IntegerType())).add("weights", T.ArrayType(T.DoubleType()))
    held = written(weighed.mapInArrow(keep, shape), "tfidf-texts")
    n = held.count()
    counts = held.select(F.explode("terms").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df")).collect()
    if held.select("id").distinct().count() < n:  # rows of one id are one text
        held = held.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("weights")).alias("weights"))
    df = np.zeros(len(terms_))
    for row in counts:
        df[row["at"]] = row["df"]
    rows = asked.toArrow().combine_chunks()
    names = rows.column("id").unique()
    q = pa.compute.index_in(rows.column("id"), names).to_numpy()
    at = np.searchsorted(terms_, rows.column("term").to_numpy())
    raw = rows.column("weight").to_numpy() * np.log((n + 1.0) / (df[at] + 1.0))
    length = np.sqrt(np.bincount(q, raw * raw, len(names)))[q]
    matrix = np.zeros((len(terms_), len(names)))
    np.add.at(matrix, (at, q), np.where(raw > 0, np.divide(raw, length, out=np.zeros_like(raw), where=length > 0), 0.0))
    shared = spark.sparkContext.broadcast((matrix, names))
    out = T.StructType().add("q", asked.schema["id"].dataType).add("id", kind).add("score", "double")
    schema = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asks = shared.value
        best_q, best_s, best_i = np.empty(0, np.int64), np.empty(0), None
        floor = np.zeros(len(asks))
        for batch in batches:
            for start in range(0, len(batch), _SLICE_ROWS):
                part = batch.slice(start, _SLICE_ROWS)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                lengths = np.diff(np.asarray(part.column("terms").offsets))
                dense = np.zeros((len(part), len(weight)))
                where = (np.repeat(np.arange(len(part)), lengths), part.column("terms").flatten().to_numpy())
                np.add.at(dense, where, part.column("weights").flatten().to_numpy())
                s = dense @ weight
                row, col = np.nonzero((s > 0) & (s >= floor - 10.0**-SCORE_DECIMALS))
                best_i = ids[:0] if best_i is None else best_i
                all_q, all_i = np.r_[best_q, col], np.r_[best_i, ids[row]]
                all_s = np.r_[best_s, np.round(s[row, col], SCORE_DECIMALS)]
                kept = _best(all_q, all_s, all_i, k)
                best_q, best_s, best_i = all_q[kept], all_s[kept], all_i[kept]
                full = np.flatnonzero(np.bincount(best_q, minlength=len(asks)) == k)
                lowest = np.full(len(asks), np.inf)
                np.minimum.at(lowest, best_q, best_s)
                floor[full] = lowest[full]
        if best_i is not None:
            columns = (asks.take(pa.array(best_q, pa.int64())), pa.array(best_i, schema.field(1).type), pa.array(best_s))
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    found = written(held.mapInArrow(score, out), "tfidf-found")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def tfidf_topk(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    question_id: str = "question_id",
    corpus_id: str = "faq_id",
    question: str = "question",
    text: str = "source_text",
    lead_terms: int = LEAD_TERMS,
    matrix_bytes: int = MATRIX_BYTES,
) -> DataFrame:
    """``question_id, corpus_id, rank, score`` of the k best texts of each question that share a term with it.

    Scores that agree to ``SCORE_DECIMALS`` are ties, ordered by id.  Ids must be unique on
    either side.  Terms that all texts hold weigh nothing.
    """
    if k < 1 or lead_terms < 1:
        raise ValueError("k and lead_terms must be at least 1")
    asked = written(postings(questions, question_id, question), "tfidf-questions")
    # written, so that their size is known before the corpus is read: few terms reach the scan without a shuffle of the postings
    wanted = written(asked.select("term").distinct(), "tfidf-wanted")
    if asked.select("id").distinct().count() * wanted.count() * 8 <= matrix_bytes:
        best = _scan(asked, wanted, corpus, k, corpus_id, text)
        return best.select(F.col("q").alias(question_id), F.col("id").alias(corpus_id), "rank", "score")
    lists = written(postings(corpus, corpus_id, text).join(wanted, "term", "left_semi"), "tfidf-lists")
    n = corpus.count()
    known = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"))
    idf = F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0))
    # Only terms that some text holds can score, but all of a question's terms make its length: those no text holds have df 0.
    weighed = asked.join(known, "term", "left").select(
        F.col("id").alias("q"), "term", F.coalesce("top", F.lit(0.0)).alias("top"),
        (F.col("weight") * F.coalesce(idf, F.log(F.lit(n) + 1.0))).alias("raw"),
    )
    mine = Window.partitionBy("q")
    scaled = weighed.withColumn("weight", F.col("raw") / F.nullif(F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(mine)), F.lit(0.0)))
    impact = scaled.where((F.col("weight") > 0) & (F.col("top") > 0)).withColumn("impact", F.col("weight") * F.col("top"))
    by_impact = mine.orderBy(F.desc("impact"), "term")
    # reach: what this term and all after it can add to a text
    reach = F.sum("impact").over(by_impact.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ordered = impact.select("q", "term", "weight", F.row_number().over(by_impact).alias("place"), reach.alias("reach"))

    def sums(part: DataFrame) -> DataFrame:
        products = part.select("q", "term", F.col("weight").alias("_w")).join(lists, "term")
        return products.groupBy("q", "id").agg(F.sum(F.col("_w") * F.col("weight")).alias("part"))

    def kth(partial: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("part"))
        return partial.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("q", F.col("part").alias("sure"))

    lead = kth(sums(ordered.where(F.col("place") <= lead_terms)))
    split = written(
        ordered.join(lead, "q", "left").withColumn("late", F.col("reach") + _SLACK < F.coalesce("sure", F.lit(0.0))), "tfidf-split"
    )
    late = split.where("late")
    brought = sums(split.where(~F.col("late")))
    rest = late.groupBy("q").agg(F.max("reach").alias("rest"))
    sure = split.select("q", "sure").distinct()
    open_ = written(
        brought.join(rest, "q", "left").join(sure, "q")
        .where(F.col("part") + F.coalesce("rest", F.lit(0.0)) + _SLACK >= F.coalesce("sure", F.lit(0.0))).select("q", "id", "part"),
        "tfidf-open",
    )
    looked_up = (
        open_.select("q", "id").join(late.select("q", "term", F.col("weight").alias("_w")), "q").join(lists, ["term", "id"])
        .groupBy("q", "id").agg(F.sum(F.col("_w") * F.col("weight")).alias("more"))
    )
    total = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), SCORE_DECIMALS)
    scored = open_.join(looked_up, ["q", "id"], "left").select("q", "id", total.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("q").alias(question_id), F.col("id").alias(corpus_id), "rank", "score"
    )
