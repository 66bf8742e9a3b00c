"""Nearest neighbours, retrieval metrics, projects and roll-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textloom.functions.paths import parent_path, project_folder
from textloom.functions.prompts import rag_prompt as rag_prompt_text
from textloom.functions.vectors import cosine, l2_normalize
from textloom.operators import knn_approx as A
from textloom.operators.knn import KnnSizes, knn_topk as topk
from textloom.operators.once import add_once
from textloom.operators.sets import add_unseen, distinct_chunks as distinct_chunks_of
from textloom.plans import evaluate as E, rollup as R
from textloom.operators.model_map import Rules
from textloom.operators.numbering import written
from textloom.operators.tfidf import tfidf_topk
from textloom.plans.faq import contexts, embed, rag_answer, retrieve
from textloom.registry.base import documents, table

KS = (1, 3, 5)
METRICS = E.metric_columns(KS)


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _neighbors(spark, d, k, **how):
    """Every vector asks for its k nearest other vectors."""
    e = _vectors(spark, d)
    return topk(
        e.select(F.col("vec_id").alias("query_id"), "embedding"), e, k, "query_id", "vec_id", exclude_self=True, **how
    )


def _labelled(spark, d, found):
    labels = _vectors(spark, d).select("vec_id", "label")
    found = found.withColumn("score", F.round("score", 6))
    return found.join(labels, "vec_id").select("query_id", "vec_id", "rank", "score", "label")


def knn_topk(spark, d):
    return _labelled(spark, d, _neighbors(spark, d, 5, method="scan"))


def knn_cells(spark, d):
    """The path of large question tables: cells around pivots, blocks and packs."""
    sizes = KnnSizes(block_rows=512, pack_rows=512)
    return _labelled(spark, d, _neighbors(spark, d, 5, method="cells", sizes=sizes))


def _within_label(spark, d, **how):
    e = _vectors(spark, d)
    found = topk(
        e.select(F.col("vec_id").alias("query_id"), "embedding", "label"), e, 3, "query_id", "vec_id",
        within="label", exclude_self=True, **how,
    )
    return found.select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


def knn_blocks(spark, d):
    """The path of very many groups: a group is one cell, cut into blocks by its own size."""
    return _within_label(spark, d, method="cells", sizes=KnnSizes(block_rows=128, pack_rows=512, max_cells=0))


#: The nearest of these vectors, which have no clusters, lie at a cosine of about 0.35.
BANDS = A.Bands.reaching(recall=0.96, similarity=0.3, bits=4)


def _approx(spark, d):
    e = _vectors(spark, d)
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return A.knn_approx(asked, e, 5, BANDS, "query_id", "vec_id", exclude_self=True)


def knn_approx(spark, d):
    return _labelled(spark, d, _approx(spark, d))


def knn_recall(spark, d):
    """Share of the true five nearest that the approximate search finds."""
    found = A.recall(_approx(spark, d), _neighbors(spark, d, 5, method="scan"), "query_id", "vec_id")
    return found.select("wanted", "found", F.round("recall", 9).alias("recall"), (F.col("recall") >= 0.9).alias("enough"))


def knn_within_label(spark, d):
    """Retrieval restricted to the question's own project."""
    return _within_label(spark, d, method="scan")


def unit_vectors(spark, d):
    e = add_once(_vectors(spark, d), F.struct(l2_normalize(F.col("embedding")).alias("unit")))
    return e.select(
        "vec_id",
        F.round(cosine(F.col("unit"), F.col("embedding")), 5).alias("self_cosine"),
        F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("unit_sum"),
    )


def _scored(spark, d):
    """Labels act as chunk ids: one wide metric row per vector, with a project."""
    e = _vectors(spark, d)
    labels = e.select("vec_id", F.col("label").alias("found"))
    mine = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    ranked = _neighbors(spark, d, 5).join(labels, "vec_id").join(mine, "query_id")
    scored = E.score_ranked(ranked, ["query_id", "wanted"], F.col("found") == F.col("wanted"), KS)
    path = F.concat(
        F.lit("projects/batch_"), (F.col("wanted") % 3).cast("string"), F.lit("/c"), F.col("wanted").cast("string"),
        F.when(F.col("query_id") % 2 == 0, "/individual").otherwise("/unificado"),
    )
    return scored.withColumn("project_path", path).withColumn("is_original", F.col("query_id") % 6 == 0)


def _rounded(df, names=METRICS):
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in names else F.col(c) for c in df.columns])


def retrieval_metrics(spark, d):
    return _rounded(_scored(spark, d).drop("wanted", "project_path", "is_original"))


def metrics_by_k(spark, d):
    long = E.long_metrics(_scored(spark, d), ["query_id"], KS)
    return long.select("query_id", "k", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


def _projects(spark, d):
    return E.project_metrics(_scored(spark, d), ["project_path"], KS)


def project_metrics(spark, d):
    return _rounded(_projects(spark, d))


def weighted_rollup(spark, d):
    return _rounded(R.parent_summaries(_projects(spark, d), ks=KS))


def overall_summary(spark, d):
    return _rounded(R.overall_summary(_projects(spark, d), ks=KS))


def rollup_levels(spark, d):
    details = _scored(spark, d).withColumn("parent", parent_path(F.col("project_path")))
    levels = R.rollup_levels(details, "parent", "project_path", KS)
    return _rounded(levels)


def summary_merge(spark, d):
    """Earlier summaries hold the individual projects; the rest are new."""
    new = _projects(spark, d)
    existing = new.filter(F.col("project_path").endswith("/individual")).withColumn("state", F.lit("kept"))
    merged = add_unseen(existing, new.withColumn("state", F.lit("added")), "project_path")
    return _rounded(merged)


def metric_maps(spark, d):
    maps = R.metric_maps(_projects(spark, d), ["project_path"], KS)
    return maps.select(
        "project_path", F.round("mrr", 6).alias("mrr"),
        F.round(R.metric_value(maps, "hit_at_k", 3), 6).alias("hit_at_3"),
        F.round(R.metric_value(maps, "ndcg_at_k", 7), 6).alias("ndcg_at_7"),
    )


def project_paths(spark, d):
    e = _vectors(spark, d)
    path = F.concat(
        F.when(F.col("vec_id") % 2 == 0, "projects\\").otherwise("/data//"), F.lit("b"), F.col("label").cast("string"),
        F.when(F.col("vec_id") % 3 == 0, "/individual").when(F.col("vec_id") % 3 == 1, "\\unificado").otherwise("/x/"),
    )
    return e.select("vec_id", parent_path(path).alias("parent"), project_folder(path).alias("folder"))


#: Characters that the encoder below counts.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,éèàçüöñß"


def letter_counts(texts: list[str]) -> np.ndarray:
    """A plain encoder: how often each letter occurs, and one for the text itself."""
    slots = np.zeros(max(map(ord, LETTERS)) + 2, np.int64)
    slots[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
    counts = np.empty((len(texts), len(LETTERS) + 1))
    for at in range(0, len(texts), 64):
        some = texts[at : at + 64]
        codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(len(some)), [len(t) for t in some])
        found = row * counts.shape[1] + slots[np.minimum(codes, len(slots) - 1)]
        counts[at : at + 64] = np.bincount(found, minlength=len(some) * counts.shape[1]).reshape(len(some), -1)
    counts[:, 0] = 1.0
    return counts


def _documents(spark, d):
    """Documents as entries without a vector: texts as sources."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("faq_id"), F.col("text").alias("source_text"), F.col("source").alias("_source"),
        F.concat(F.lit("About "), "source", F.lit(" in "), "lang", F.lit("?")).alias("question"),
        F.concat(F.lit("It has "), F.col("n_chars").cast("string"), F.lit(" characters.")).alias("answer"),
    )


def _with_known(spark, d, docs):
    """Entries with the label of their vector as chunk, and the vector; ``_known`` is null where there is none."""
    vec = _vectors(spark, d).select(
        F.col("vec_id").alias("faq_id"), F.col("label").cast("string").alias("_label"), "embedding", F.lit(True).alias("_known")
    )
    chunk = F.when(F.col("_known"), F.col("_label")).otherwise(F.col("_source"))
    return docs.join(vec, "faq_id", "left").withColumn("chunk_id", chunk).drop("_label", "_source")


def _apart(df, name, *columns):
    """Written entries; those with a known vector are in files of their own, as each branch of a union would be."""
    known = F.coalesce("_known", F.lit(False)).alias("_known")
    return written(df.select(*columns, known), name, "_known").drop("_known")


def _faq(spark, d):
    """A question-answer table of all documents: texts as sources, labels as chunks.

    A document has the vector of its id, or is encoded where there is none.
    """
    made = embed(_with_known(spark, d, _documents(spark, d)), letter_counts, "source_text", known="_known")
    return _apart(made, "faq", "faq_id", "source_text", "question", "answer", "chunk_id", "embedding")


def _index(spark, d):
    """The same table without source texts and answers: texts are encoded where they are read, so none is shuffled or written."""
    docs = _documents(spark, d).withColumns({"_made": F.lit(None).cast("array<float>"), "_blank": F.col("source_text").isNull()})
    made = embed(docs, letter_counts, "source_text", "_made", known="_blank").drop("source_text", "answer")
    none = F.when(F.col("_blank"), F.raise_error(F.lit("no text to encode")).cast("array<float>")).otherwise(F.col("_made"))
    both = _with_known(spark, d, made).withColumn("embedding", F.when(F.col("_known"), F.col("embedding")).otherwise(none))
    return _apart(both, "index", "faq_id", "question", "chunk_id", "embedding")


def _retrieved(spark, d, k=3):
    index = _index(spark, d)
    asked = index.select(F.col("faq_id").alias("question_id"), "question", "embedding")
    return asked, retrieve(asked, _with_known(spark, d, _documents(spark, d)), k, exclude_self=True, index=index)


def retrieve_q(spark, d):
    found = _retrieved(spark, d)[1]
    return found.withColumn("score", F.round("score", 6))


#: Entries that are to be found lie at a cosine of 0.95 or more.
FAQ_BANDS = A.Bands.reaching(recall=0.95, similarity=0.95, bits=8)


def retrieve_approx(spark, d):
    """The three best entries of the same course among those that share a band with the question."""
    faq = _faq(spark, d)
    asked = faq.select(F.col("faq_id").alias("question_id"), "embedding", "chunk_id")
    found = retrieve(asked, faq, 3, within="chunk_id", payload=("question", "answer"), exclude_self=True, bands=FAQ_BANDS)
    return found.withColumn("score", F.round("score", 6))


def rag_prompt(spark, d):
    asked, found = _retrieved(spark, d)
    joined = asked.select("question_id", "question").join(contexts(found), "question_id")
    return joined.select("question_id", rag_prompt_text(F.col("context"), F.col("question")).alias("prompt"))


def rag_answer_q(spark, d):
    """Answers by rule: how many contexts there are and the best answer."""
    asked, found = _retrieved(spark, d)
    rule = F.concat(
        F.lit(" "), F.size("context").cast("string"), F.lit(" contexts. "), F.get("context", F.lit(0))["answer"], F.lit("\n")
    )
    done = rag_answer(asked, found, Rules(rule))
    return done.select("question_id", "question", "answer", F.size("context").alias("n_context"), "raw_response")


def evaluate_retrieval(spark, d):
    """Every entry's own question against the whole table, itself included."""
    faq = _index(spark, d)
    items = faq.select(
        F.col("faq_id").alias("item_id"), F.col("chunk_id").alias("correct_chunk_id"),
        (F.col("faq_id") % 4 == 0).alias("is_original"), "embedding",
    )
    done = E.evaluate_retrieval(items, faq.drop("question"), KS, 5)
    return _rounded(done.withColumn("retrieved_chunks", F.array_join("retrieved_chunks", ",")))


def evaluate_by_text(spark, d):
    """The same with chunk ids looked up by source text: of equal texts the first entry counts."""
    faq = _faq(spark, d)
    items = faq.select(
        F.col("faq_id").alias("item_id"), F.col("chunk_id").alias("correct_chunk_id"),
        (F.col("faq_id") % 4 == 0).alias("is_original"), "embedding",
    )
    done = E.evaluate_retrieval(items, faq.drop("question", "answer"), KS, 5, by_text=True, position="faq_id")
    return done.select("item_id", F.array_join("retrieved_chunks", ",").alias("retrieved_chunks"), "correct_chunk_position", F.round("mrr", 6).alias("mrr"))


def distinct_chunks(spark, d):
    return distinct_chunks_of(_faq(spark, d))


def tfidf_retrieval(spark, d):
    """Benchmark items answered from the documents by TF-IDF."""
    docs = documents(spark, d, "doc_id", "text").select(F.col("doc_id").alias("faq_id"), F.col("text").alias("source_text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return tfidf_topk(items, docs, 5).withColumn("score", F.round("score", 6))


QUERIES = {
    "knn_topk": knn_topk,
    "knn_cells": knn_cells,
    "knn_blocks": knn_blocks,
    "knn_approx": knn_approx,
    "knn_recall": knn_recall,
    "knn_within_label": knn_within_label,
    "unit_vectors": unit_vectors,
    "retrieval_metrics": retrieval_metrics,
    "metrics_by_k": metrics_by_k,
    "project_metrics": project_metrics,
    "weighted_rollup": weighted_rollup,
    "overall_summary": overall_summary,
    "rollup_levels": rollup_levels,
    "summary_merge": summary_merge,
    "metric_maps": metric_maps,
    "project_paths": project_paths,
    "retrieve": retrieve_q,
    "retrieve_approx": retrieve_approx,
    "rag_prompt": rag_prompt,
    "rag_answer": rag_answer_q,
    "evaluate_retrieval": evaluate_retrieval,
    "evaluate_by_text": evaluate_by_text,
    "distinct_chunks": distinct_chunks,
    "tfidf_retrieval": tfidf_retrieval,
}

# Oracles ----------------------------------------------------------------------


def _pairs(extra: str, k: int, base: str = "embeddings") -> str:
    return f"""
      SELECT query_id, vec_id, label, wanted, cos, r AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS wanted,
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS cos,
               CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
                 round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC,
                 e.vec_id) AS INTEGER) AS r
        FROM {base} q JOIN {base} e ON {extra}) WHERE r <= {k}"""


#: All documents, with the vector of their id or their letter counts scaled to length one.
_COUNTS = f"list_prepend(1.0::DOUBLE, list_transform({list(LETTERS)}, lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)))"
_KNOWN = f"""(
  SELECT doc_id AS vec_id, coalesce(CAST(label AS VARCHAR), source) AS label, text, source, lang, n_chars, coalesce(embedding, list_transform(
    {_COUNTS}, lambda x: CAST(x / sqrt(list_sum(list_transform({_COUNTS}, lambda y: y * y))) AS FLOAT))) AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
_TOP5 = _pairs("q.vec_id <> e.vec_id", 5)
_AT = ", ".join(
    [f"coalesce(pos <= {k}, false) AS hit_at_{k}" for k in KS]
    + ["coalesce(1.0 / pos, 0.0) AS mrr"]
    + [f"in_{k} / {k}.0 AS precision_at_{k}" for k in KS]
    + [f"CAST(coalesce(pos <= {k}, false) AS DOUBLE) AS recall_at_{k}" for k in KS]
    + [f"CASE WHEN pos <= {k} THEN 1.0 / log2(pos + 1.0) ELSE 0.0 END AS ndcg_at_{k}" for k in KS]
)
_SCORED = f"""
  SELECT query_id, wanted, CAST(pos AS INTEGER) AS correct_chunk_position, {_AT},
         concat('projects/batch_', wanted % 3, '/c', wanted,
                CASE WHEN query_id % 2 = 0 THEN '/individual' ELSE '/unificado' END) AS project_path,
         query_id % 6 = 0 AS is_original
  FROM (SELECT query_id, wanted, min(rank) FILTER (WHERE label = wanted) AS pos,
               {", ".join(f"CAST(count(*) FILTER (WHERE label = wanted AND rank <= {k}) AS DOUBLE) AS in_{k}" for k in KS)}
        FROM ({_TOP5}) GROUP BY query_id, wanted)"""


def _round_all(prefix: str = "") -> str:
    return ", ".join(f"round(CAST({prefix}{m} AS DOUBLE), 6) AS {m}" for m in METRICS)


def _mean(cond: str) -> str:
    return ", ".join(f"avg(CAST({m} AS DOUBLE)) FILTER (WHERE {cond}) AS {m}" for m in METRICS)


_HAS = "bool_or(NOT is_original) OVER (PARTITION BY project_path)"
_PROJECTS = f"""
  SELECT project_path, count(*) AS total_questions, {_mean('true')}
  FROM (SELECT *, {_HAS} AS has FROM ({_SCORED})) WHERE NOT is_original OR NOT has GROUP BY project_path"""
_WEIGHTED = ", ".join(
    f"round(sum({m} * total_questions) / sum(total_questions), 6) AS {m}" for m in METRICS
)
_PARENT = r"regexp_replace(project_path, '/(individual|unificado)$', '')"
_FAQ = f"""
  SELECT vec_id AS faq_id, label AS chunk_id, embedding, text AS source_text,
         concat('About ', source, ' in ', lang, '?') AS question, concat('It has ', n_chars, ' characters.') AS answer
  FROM {_KNOWN}"""
_FOUND = f"""
  SELECT query_id AS question_id, rank, faq_id, source_text, chunk_id, question, answer, cos
  FROM ({_pairs('q.vec_id <> e.vec_id', 3, _KNOWN)}) JOIN ({_FAQ}) ON faq_id = vec_id"""
_PATHS = r"""concat(CASE WHEN vec_id % 2 = 0 THEN 'projects\' ELSE '/data//' END, 'b', label,
  CASE vec_id % 3 WHEN 0 THEN '/individual' WHEN 1 THEN '\unificado' ELSE '/x/' END)"""
_CONTEXT = (
    "string_agg(concat('[', rank, ']', chr(10), 'Text: ', f.source_text, ' ', chr(10), 'Question: ', f.question, "
    "chr(10), 'Answer: ', f.answer, chr(10), chr(10)), '' ORDER BY rank)"
)

_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9)"


def _banded(bands: A.Bands, k: int, base: str, extra: str) -> str:
    """Plane components by the digest rule; a pair is found when it agrees in all bits of a band."""
    return f"""
  WITH base AS (SELECT * FROM {base}), dims AS (SELECT max(len(embedding)) AS dim FROM base),
  planes AS (
    SELECT band, bit, list(CASE WHEN instr('13579bdf', md5(concat({bands.seed}, ':', band, ':', bit, ':', i))[1]) > 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY i) AS plane
    FROM dims, range({bands.count}) AS a(band), range({bands.bits}) AS b(bit), unnest(range(dim)) AS c(i) GROUP BY 1, 2),
  codes AS (
    SELECT vec_id, embedding, label, band, sum(CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), plane) >= -1e-9 THEN 1 << bit ELSE 0 END) AS code
    FROM base, planes GROUP BY ALL),
  met AS (SELECT DISTINCT q.vec_id AS query_id, e.vec_id FROM codes q JOIN codes e USING (band, code) WHERE q.vec_id <> e.vec_id {extra}),
  found AS (SELECT * FROM (
    SELECT query_id, vec_id, e.label, {_COSINE} AS cos,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE} DESC, e.vec_id) AS INTEGER) AS rank
    FROM met JOIN base e USING (vec_id) JOIN base q ON q.vec_id = query_id) WHERE rank <= {k})"""


_BANDED = _banded(BANDS, 5, "embeddings", "")
_TFIDF = r"""
  WITH t AS (
    SELECT kind, id, term, 1 + ln(count(*)) AS w FROM (
      SELECT kind, id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term
      FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark))
    GROUP BY 1, 2, 3),
  d AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM t WHERE kind = 'd'),
  f AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
  r AS (SELECT id, term, w * ln(((SELECT count(*) FROM documents) + 1.0) / (coalesce(df, 0) + 1.0)) AS w FROM t LEFT JOIN f USING (term) WHERE kind = 'q'),
  q AS (SELECT id, term, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY id)), 0) AS w FROM r),
  s AS (SELECT q.id AS question_id, d.id AS faq_id, round(sum(q.w * d.w), 9) AS score FROM q JOIN d USING (term) WHERE q.w > 0 GROUP BY 1, 2)
  SELECT question_id, faq_id, rank, round(score, 6) AS score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, faq_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5"""
_SAME_LABEL = f"""
  SELECT query_id, vec_id, CAST(label AS VARCHAR) AS label, rank, round(cos, 6) AS score
  FROM ({_pairs('q.vec_id <> e.vec_id AND q.label = e.label', 3)})"""
_NEAREST = f"SELECT query_id, vec_id, rank, round(cos, 6) AS score, label FROM ({_TOP5})"

ORACLE = {
    "knn_cells": _NEAREST,
    "knn_blocks": _SAME_LABEL,
    "knn_approx": f"{_BANDED} SELECT query_id, vec_id, rank, round(cos, 6) AS score, label FROM found",
    "knn_recall": f"""{_BANDED}, best AS ({_TOP5})
      SELECT count(*) AS wanted, count(found.vec_id) AS found, round(count(found.vec_id) / count(*), 9) AS recall,
             count(found.vec_id) / count(*) >= 0.9 AS enough
      FROM best LEFT JOIN found ON found.query_id = best.query_id AND found.vec_id = best.vec_id""",
    "tfidf_retrieval": _TFIDF.replace("\\\\", "\\"),
    "knn_topk": f"SELECT query_id, vec_id, rank, round(cos, 6) AS score, label FROM ({_TOP5})",
    "knn_within_label": _SAME_LABEL,
    "unit_vectors": """
      SELECT vec_id, 1.0::DOUBLE AS self_cosine,
             round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / n AS FLOAT)::DOUBLE)), 4) AS unit_sum
      FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n
            FROM embeddings)""",
    "retrieval_metrics": f"SELECT query_id, correct_chunk_position, {_round_all()} FROM ({_SCORED})",
    "metrics_by_k": " UNION ALL ".join(
        f"SELECT query_id, {k} AS k, hit_at_{k} AS hit, round(precision_at_{k}, 6) AS precision, "
        f"round(recall_at_{k}, 6) AS recall, round(ndcg_at_{k}, 6) AS ndcg FROM ({_SCORED})"
        for k in KS
    ),
    "project_metrics": f"SELECT project_path, total_questions, {_round_all()} FROM ({_PROJECTS})",
    "weighted_rollup": f"""
      SELECT {_PARENT} AS parent, count(*) AS total_subfolders,
             CAST(sum(total_questions) AS BIGINT) AS total_questions, {_WEIGHTED}
      FROM ({_PROJECTS}) GROUP BY 1""",
    "overall_summary": f"""
      SELECT split_part(project_path, '/', 2) AS project_folder, count(*) AS total_projects,
             CAST(sum(total_questions) AS BIGINT) AS total_questions, {_WEIGHTED}
      FROM ({_PROJECTS}) GROUP BY 1""",
    "rollup_levels": f"""
      SELECT parent, project_path,
             CASE WHEN grouping(parent) = 1 THEN 'overall' WHEN grouping(project_path) = 1 THEN 'parent'
                  ELSE 'project' END AS level,
             count(*) AS total_questions, {", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in METRICS)}
      FROM (SELECT *, {_PARENT} AS parent FROM ({_SCORED}))
      GROUP BY GROUPING SETS ((parent, project_path), (parent), ())""",
    "summary_merge": f"""
      SELECT project_path, total_questions, {_round_all()},
             CASE WHEN project_path LIKE '%/individual' THEN 'kept' ELSE 'added' END AS state FROM ({_PROJECTS})""",
    "metric_maps": f"""
      SELECT project_path, round(mrr, 6) AS mrr, round(hit_at_3, 6) AS hit_at_3, 0.0::DOUBLE AS ndcg_at_7
      FROM ({_PROJECTS})""",
    "project_paths": rf"""
      SELECT vec_id,
             array_to_string(list_filter(string_split(
               regexp_replace(p, '/(individual|unificado)$', ''), '/'), lambda x: x <> ''), '/') AS parent,
             CASE WHEN parts[1] = 'projects' AND len(parts) > 1 THEN parts[2] ELSE parts[1] END AS folder
      FROM (SELECT vec_id, p, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts
            FROM (SELECT vec_id, replace({_PATHS}, '\', '/') AS p FROM embeddings))""",
    "retrieve": f"""
      SELECT question_id, rank, faq_id, source_text, chunk_id, question, answer, round(cos, 6) AS score
      FROM ({_FOUND})""",
    "retrieve_approx": f"""{_banded(FAQ_BANDS, 3, _KNOWN, "AND q.label = e.label")}
      SELECT query_id AS question_id, found.label AS chunk_id, rank, found.vec_id AS faq_id, concat('About ', source, ' in ', lang, '?') AS question,
             concat('It has ', n_chars, ' characters.') AS answer, round(cos, 6) AS score
      FROM found JOIN base USING (vec_id)""",
    "rag_prompt": f"""
      SELECT question_id, concat('Context:', chr(10), {_CONTEXT}, chr(10), chr(10), 'User question:', chr(10),
             any_value(q.question)) AS prompt
      FROM ({_FOUND}) f JOIN ({_FAQ}) q ON q.faq_id = f.question_id GROUP BY question_id""",
    "rag_answer": f"""
      SELECT question_id, any_value(q.question) AS question,
             concat(count(*), ' contexts. ', max(f.answer) FILTER (WHERE rank = 1)) AS answer,
             CAST(count(*) AS INTEGER) AS n_context,
             concat(' ', count(*), ' contexts. ', max(f.answer) FILTER (WHERE rank = 1), chr(10)) AS raw_response
      FROM ({_FOUND}) f JOIN ({_FAQ}) q ON q.faq_id = f.question_id GROUP BY question_id""",
    "evaluate_retrieval": f"""
      SELECT query_id AS item_id, CAST(wanted AS VARCHAR) AS correct_chunk_id, query_id % 4 = 0 AS is_original,
             chunks AS retrieved_chunks, CAST(pos AS INTEGER) AS correct_chunk_position, {_round_all()}
      FROM (SELECT query_id, wanted, chunks, pos, {_AT} FROM (
        SELECT query_id, wanted, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) AS chunks,
               min(rank) FILTER (WHERE label = wanted) AS pos,
               {", ".join(f"CAST(count(*) FILTER (WHERE label = wanted AND rank <= {k}) AS DOUBLE) AS in_{k}" for k in KS)}
        FROM ({_pairs('true', 5, _KNOWN)}) GROUP BY query_id, wanted))""",
    "evaluate_by_text": f"""
      WITH known AS (SELECT * FROM {_KNOWN}), first AS (SELECT text, min_by(label, vec_id) AS first FROM known GROUP BY 1),
      found AS ({_pairs('true', 5, 'known')})
      SELECT query_id AS item_id, string_agg(first, ',' ORDER BY rank) AS retrieved_chunks,
             CAST(min(rank) FILTER (WHERE first = wanted) AS INTEGER) AS correct_chunk_position,
             round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE first = wanted), 0.0), 6) AS mrr
      FROM found JOIN known k ON k.vec_id = found.vec_id JOIN first USING (text) GROUP BY 1""",
    "distinct_chunks": f"SELECT DISTINCT source_text AS text, chunk_id FROM ({_FAQ})",
}
