"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept and returns a DataFrame; all but the last return the columns of ``documents``.

Defined cases: null texts pass the stages as texts without words; a document
that line de-duplication leaves without a word goes, one that had none stays; rows
that share an id share the decisions on near duplicates, so all of them stay or go, and each is packed; a row
without an id is never a duplicate; texts of any length are worked on whole; an empty table passes as an empty
table; columns beside those of ``documents`` pass the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard, lines, packing, quality
from textloom.llm.cells import free_name, store
from textloom.llm.registry import tokenizer_path

HAS_WORD = r"[^\x20\x09-\x0D]"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; learned from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.learn(docs, labels)
    mark = free_name(docs, "_quality")
    return quality.score(docs, model, out=mark).where(F.col(mark) >= 0.5).select(docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document, and a document of which nothing is left goes."""
    mark = free_name(docs, "_gone")
    out, whole = lines.dedup_lines(docs, out=mark), F.col(mark).isNull()
    left = whole | F.col("text").rlike(HAS_WORD)
    size = F.when(~whole, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.where(left).withColumn("n_chars", size).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component."""
    linked = jaccard.link_components(docs)
    later = linked.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    words, spans, items = (free_name(docs, name) for name in ("_words", "_spans", "_items"))
    found = decontaminate.find_contamination(docs, benchmark, columns=(words, spans, items))
    bad = decontaminate.is_contaminated(decontaminate.hit_words(spans), F.col(words))
    return found.where(~bad).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Several stages (patience diff, tokenizer, a fitted model) have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
