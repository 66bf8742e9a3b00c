"""Tables written by the sinks and read back by the readers, and responses stored by a caller."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.operators.model_map import Caller, model_map
from textloom.registry.base import documents, table
from textloom.session import ensure_checkpoint_dir
from textloom.sources import readers as IN, writers as OUT


def _fresh(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# A model that must be asked several times ---------------------------------------
def _first_asked() -> dict:
    return {}


def _answer(prompts: list[str], asked: dict) -> list[str]:
    """The number of times a prompt has been asked, and its length."""
    for prompt in prompts:
        asked[prompt] = asked.get(prompt, 0) + 1
    return [f"{asked[p]} {len(p)}" for p in prompts]


def _accept(response: str) -> bool:
    """A text of length n is answered well the n % 4 + 1st time."""
    times, size = map(int, response.split())
    return times > size % 4


def caller_retries(spark, d):
    """Three tries in slices of 500 prompts; a fourth of the texts would need a fourth try."""
    caller = Caller(_answer, max_tries=3, accept=_accept, setup=_first_asked, calls=4, slice_rows=500)
    out = model_map(documents(spark, d, "doc_id", "text"), "text", caller, _fresh(spark, "responses"))
    return out.select("doc_id", "response", "attempts", "error", "backend")


# Sources and sinks --------------------------------------------------------------
def json_array_records(spark, d):
    """JSON arrays written a file a task and read by their elements."""
    path = _fresh(spark, "arrays")
    OUT.write_json_arrays(table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    found = IN.read_records(spark, path)
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return found.select(get("doc_id", "bigint"), get("lang", "string"), get("text", "string"))


def json_line_records(spark, d):
    path = _fresh(spark, "lines")
    OUT.write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "text"), path, "doc_id")
    found = IN.read_records(spark, path, bad="skip")
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return found.select(get("doc_id", "bigint"), get("lang", "string"), get("text", "string"))


def details_by_project(spark, d):
    """Rows by project, a large project in as many files as its bytes ask for."""
    path = _fresh(spark, "details")
    rows = table(spark, d, "documents").select(F.col("lang").alias("project"), "doc_id", "source", "n_chars")
    OUT.write_details(rows, path, file_bytes=4096)
    back = spark.read.schema("doc_id long, source string, n_chars long, project string").json(path)
    named = back.withColumn("_file", F.col("_metadata.file_path"))
    size = F.octet_length(F.to_json(F.struct("project", "doc_id", "source", "n_chars")))
    sums = named.groupBy("project").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.min("source").alias("first_source"),
        F.count_distinct("_file").alias("_files"), F.ceil(F.sum(size) / 4096).alias("_most"),
    )
    return sums.select("project", "n", "n_chars", "first_source", (F.col("_files") <= F.col("_most")).alias("files_in_bound"))


def faq_table(spark, d):
    """A question-answer table by course and persona, read back pruned to one course."""
    path = _fresh(spark, "faq")
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.col("text").alias("source_text"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("About "), "source").alias("question"),
        F.col("n_chars").cast("string").alias("answer"), F.col("lang").alias("course"), F.concat(F.lit("p"), F.col("doc_id") % 3).alias("persona"),
    )
    OUT.write_faq(rows, path)
    back = IN.read_faq(spark, path).where(F.col("course") != "en")
    return back.select("chunk_id", "course", "persona", "question", "answer", F.md5("source_text").alias("text_md5"))


def summaries_by_parent(spark, d):
    path = _fresh(spark, "summaries")
    rows = table(spark, d, "documents").groupBy(F.col("lang").alias("parent"), "source").agg(F.count("*").alias("n"))
    OUT.write_summaries(rows, path)
    return IN.read_summary(spark, path, "source string, n long, parent string")


def merged_summary(spark, d):
    """An earlier summary and a merged one, over a new path."""
    old, new = _fresh(spark, "old"), _fresh(spark, "merged")
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    OUT.write_merged(rows, old)
    OUT.write_merged(IN.read_summary(spark, old, "source string, n long, n_chars long"), new, read_from=old)
    return IN.read_summary(spark, new, "source string, n long, n_chars long")


def embedded_table(spark, d):
    """Vectors in the same row as the entry; written once, read back as float."""
    path = _fresh(spark, "embedded")
    rows = table(spark, d, "embeddings").select(
        F.lit("t").alias("source_text"), F.col("vec_id").alias("chunk_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    OUT.write_embedded(rows, path)
    back = IN.read_faq(spark, path)
    return back.select("chunk_id", F.size("embedding").alias("dim"), F.get("embedding", F.lit(0)).cast("double").alias("head"))


def training_texts(spark, d):
    """Training texts with line breaks stay one record each."""
    path = _fresh(spark, "texts")
    OUT.write_texts(table(spark, d, "conversations").select("text"), path)
    return spark.read.schema("text string").json(path).groupBy("text").agg(F.count("*").alias("n"))


def csv_documents(spark, d):
    """Texts with quotes and line breaks through a CSV file, read as documents."""
    path = _fresh(spark, "csv") + ".csv"
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ID"), F.col("text").alias("TEXT"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(path)
    return IN.read_documents(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


def pages_table(spark, d):
    """Pages and chunks from a table: numbers as integers, lengths counted, ids as text."""
    path = _fresh(spark, "pages")
    talk = table(spark, d, "conversations")
    OUT.write_table(talk.select(F.col("conv_id").cast("string").alias("doc_name"), F.col("turn").alias("page_number"), "text"), path)
    return IN.read_pages(spark, path).select("doc_name", "page_number", "length", F.md5("text").alias("text_md5"))


def chunk_table(spark, d):
    """Chunks without an id get the digest of their text; issue texts stay as they are."""
    path = _fresh(spark, "chunks")
    OUT.write_table(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    issues = IN.read_issue_texts(spark, path).select("id", F.md5("text").alias("chunk_id"))
    chunks = IN.read_chunks(spark, path).groupBy("chunk_id").agg(F.count("*").alias("n"))
    return issues.join(chunks, "chunk_id").select("id", "chunk_id", "n")


def class_results(spark, d):
    """Multi-label results as JSON lines and back."""
    path = _fresh(spark, "results")
    given = F.struct(F.col("lang").alias("class_id"), F.col("source").alias("justification"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array(given).alias("relevant_classes"))
    OUT.write_jsonl(rows, path)
    back = IN.read_results(spark, path).select("doc_id", F.inline("relevant_classes"))
    return back.select("doc_id", "class_id", "justification")


def projects_found(spark, d):
    """Projects of a partitioned table by its folders alone."""
    path = _fresh(spark, "projects")
    table(spark, d, "documents").select("doc_id", F.col("source").alias("project")).write.partitionBy("project").parquet(path)
    return IN.partition_projects(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        caller_retries, json_array_records, json_line_records, details_by_project, faq_table, summaries_by_parent, merged_summary,
        embedded_table, training_texts, csv_documents, pages_table, chunk_table, class_results, projects_found,
    )
}

_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
ORACLE = {
    "caller_retries": """
      SELECT doc_id, concat(tries, ' ', n) AS response, CAST(tries AS INTEGER) AS attempts,
             CASE WHEN n % 4 = 3 THEN 'refused' END AS error, 'callable' AS backend
      FROM (SELECT doc_id, length(text) AS n, least(length(text) % 4 + 1, 3) AS tries FROM documents)""",
    "json_array_records": "SELECT doc_id, lang, text FROM documents",
    "json_line_records": "SELECT doc_id, lang, text FROM documents",
    "details_by_project": """
      SELECT lang AS project, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(source) AS first_source, true AS files_in_bound
      FROM documents GROUP BY 1""",
    "faq_table": """
      SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lang AS course, concat('p', doc_id % 3) AS persona, concat('About ', source) AS question,
             CAST(n_chars AS VARCHAR) AS answer, md5(text) AS text_md5 FROM documents WHERE lang <> 'en'""",
    "summaries_by_parent": "SELECT source, count(*) AS n, lang AS parent FROM documents GROUP BY source, lang",
    "merged_summary": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "embedded_table": """
      SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(embedding[1] AS DOUBLE) AS head FROM embeddings""",
    "training_texts": "SELECT text, count(*) AS n FROM conversations GROUP BY 1",
    "csv_documents": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5({_TRIM}) AS text_md5 FROM documents WHERE {_TRIM} <> ''",
    "pages_table": """
      SELECT CAST(conv_id AS VARCHAR) AS doc_name, CAST(turn AS INTEGER) AS page_number, CAST(length(text) AS INTEGER) AS length,
             md5(text) AS text_md5 FROM conversations""",
    "chunk_table": """
      SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS chunk_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents""",
    "class_results": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS class_id, source AS justification FROM documents",
    "projects_found": "SELECT DISTINCT source AS project FROM documents",
}
