"""Multi-label and two-stage classification with the lexicon rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators.matrix import class_matrix as class_matrix_of, class_matrix_long as class_matrix_long_of
from textloom.operators.model_map import Replay, Rules, prompt_hash
from textloom.plans import classify as C
from textloom.registry.base import documents, sql_text

CLASSES = [
    {"id": "english", "label": "English", "description": "the of and that with from", "context": "function words"},
    {"id": "french", "label": "Francais", "description": "le la les un une et que dans", "context": "mots outils"},
    {"id": "german", "label": "Deutsch", "description": "der die das und ist nicht ein", "context": "Funktionswörter"},
    {"id": "spanish", "label": "Español", "description": "el la los un una y que del", "context": "palabras función"},
]
#: The rules also know a class that the enforced catalogue does not have.
WIDER = [*CLASSES, {"id": "numeric", "label": "Numbers", "description": "one two 1 2 3", "context": "digits"}]
SYSTEM = "Assign classes.\n{CLASSES_DESCRIPTION}"
SHARE = 0.25


def lexicon_scores(spark, d):
    return C.lexicon_scores(documents(spark, d, "doc_id", "text"), CLASSES)


def top_candidates(spark, d):
    top = C.top_candidates(C.lexicon_scores(documents(spark, d, "doc_id", "text"), WIDER), 3)
    return top.select("doc_id", "class_id", "score", "ranking", F.round("confidence", 6).alias("confidence"))


def label_prompts(spark, d):
    return C.label_prompts(documents(spark, d, "doc_id", "text"), CLASSES, SYSTEM).select("doc_id", "prompt")


def _multilabel(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    asked = C.label_prompts(docs, CLASSES, SYSTEM).select("doc_id", prompt_hash(F.col("prompt")).alias("prompt_hash"))
    stored = asked.join(C.rules_labels(docs, WIDER, SHARE), "doc_id").select("prompt_hash", "response")
    return C.classify_multilabel(docs, CLASSES, Replay(stored), SYSTEM)


def classify_multilabel(spark, d):
    out = _multilabel(spark, d)
    return out.select(
        "doc_id", F.array_join("relevant_classes.class_id", ",").alias("labels"), "n_labels",
        F.size("rejected").alias("n_rejected"), "ok",
    )


def class_matrix(spark, d):
    return class_matrix_of(_multilabel(spark, d), [c["id"] for c in CLASSES])


def class_matrix_long(spark, d):
    return class_matrix_long_of(_multilabel(spark, d))


def _two_stage(spark, d):
    """The generalist answers from the lexicon; the specialist keeps shares of
    at least a fifth.  Some first answers are unusable."""
    docs = documents(spark, d, "doc_id", "text")
    top = C.top_candidates(C.lexicon_scores(docs, CLASSES), 5)
    entry = F.struct(
        "ranking", F.col("class_id").alias("id"), "confidence", F.lit("words in common").alias("explanation")
    )
    listed = top.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("_list"))
    shape = F.col("doc_id") % 5
    answer = (
        F.when(shape == 1, F.concat(F.lit("```json\n"), "_list", F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit('{"list":'), "_list", F.lit("}")))
        .otherwise(F.col("_list"))
    )
    asked = docs.join(listed, "doc_id", "left").withColumn("_first", answer)
    second = F.to_json(F.filter("stage1", lambda c: c["confidence"] >= 0.2))
    return C.classify_two_stage(asked, CLASSES, Rules(F.col("_first")), Rules(second))


def two_stage(spark, d):
    out = _two_stage(spark, d)
    return out.select(
        "doc_id", "status", "error",
        F.array_join("stage1.id", ",").alias("candidates"), F.array_join("stage2.id", ",").alias("final"),
        F.round(F.aggregate("stage2.confidence", F.lit(0.0), lambda a, x: a + x), 6).alias("kept_share"),
    )


def specialist_prompts(spark, d):
    """Second-stage prompts: candidates with label and context from the catalogue."""
    out = _two_stage(spark, d).filter(F.col("stage1").isNotNull())
    bare = F.transform(
        "stage1",
        lambda c: F.struct(
            c["ranking"].alias("ranking"), c["id"].alias("id"), F.lit(0.5).alias("confidence"),
            c["explanation"].alias("explanation"),
        ),
    )
    prompt = C.specialist_prompt(F.col("text"), bare, CLASSES, "Order them.")
    return out.select("doc_id", prompt.alias("prompt"))


def two_stage_status(spark, d):
    return _two_stage(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "lexicon_scores": lexicon_scores,
    "top_candidates": top_candidates,
    "label_prompts": label_prompts,
    "classify_multilabel": classify_multilabel,
    "class_matrix": class_matrix,
    "class_matrix_long": class_matrix_long,
    "two_stage": two_stage,
    "two_stage_status": two_stage_status,
    "specialist_prompts": specialist_prompts,
}

# Oracles ----------------------------------------------------------------------


def _lexicon(classes) -> str:
    rows = sorted({(c["id"], w) for c in classes for w in c["description"].lower().split()})
    return "(VALUES " + ", ".join(f"({sql_text(i)}, {sql_text(w)})" for i, w in rows) + ") AS l(class_id, token)"


def _scores(classes) -> str:
    return rf"""
      SELECT doc_id, class_id, count(*) AS score
      FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS token FROM documents)
      JOIN {_lexicon(classes)} USING (token) GROUP BY 1, 2"""


def _shares(classes) -> str:
    return f"""
      SELECT *, CAST(score AS DOUBLE) / sum(score) OVER (PARTITION BY doc_id) AS confidence FROM ({_scores(classes)})"""


_RANKED = f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, class_id) AS INTEGER) AS ranking
  FROM ({{shares}})"""
_LINES = "\n".join(f"- {c['id']}: {c['description']}" for c in CLASSES)
_LABELS = f"""
  SELECT d.doc_id, string_agg(class_id, ',' ORDER BY class_id) FILTER (WHERE class_id <> 'numeric') AS labels,
         count(class_id) FILTER (WHERE class_id <> 'numeric') AS n, count(*) FILTER (WHERE class_id = 'numeric') AS x,
         count(class_id) > 0 AS ok
  FROM documents d LEFT JOIN (SELECT * FROM ({_shares(WIDER)}) WHERE confidence >= {SHARE}) s ON s.doc_id = d.doc_id
  GROUP BY d.doc_id"""
_STAGES = f"""
  SELECT d.doc_id, doc_id % 5 AS shape, c.* EXCLUDE (id) FROM documents d LEFT JOIN (
    SELECT doc_id AS id, string_agg(class_id, ',' ORDER BY ranking) AS first,
           string_agg(class_id, ',' ORDER BY ranking) FILTER (WHERE confidence >= 0.2) AS second,
           sum(confidence) FILTER (WHERE confidence >= 0.2) AS kept
    FROM ({_RANKED.format(shares=_shares(CLASSES))}) GROUP BY doc_id) c ON c.id = d.doc_id"""
_STATUS = """CASE WHEN first IS NULL OR shape = 2 THEN 'generalist_failed' WHEN second IS NULL THEN 'specialist_failed'
  ELSE 'success' END"""
_CATALOGUE = ", ".join(
    f"({sql_text(c['id'])}, {sql_text(c['label'])}, {sql_text(c['context'])})" for c in CLASSES
)

ORACLE = {
    "lexicon_scores": _scores(CLASSES),
    "top_candidates": f"""
      SELECT doc_id, class_id, score, ranking, round(confidence, 6) AS confidence
      FROM ({_RANKED.format(shares=_shares(WIDER))}) WHERE ranking <= 3""",
    "label_prompts": "SELECT doc_id, concat("
    + sql_text(
        f"Assign classes.\n{_LINES}\n\n"
        "Which of these classes clearly apply to the text? Several may; none is a fine answer.\n"
        f"Use only the ids listed, each with a short justification.\n\nClasses (id: description):\n{_LINES}\n\nText:\n\"\"\""
    )
    + ", text, "
    + sql_text('"""\n\nAnswer with {"relevant_classes": [{"class_id": "<id>", "justification": "<why>"}]}')
    + ") AS prompt FROM documents",
    "classify_multilabel": f"""
      SELECT doc_id, coalesce(labels, '') AS labels, CAST(n AS INTEGER) AS n_labels, CAST(x AS INTEGER) AS n_rejected, ok
      FROM ({_LABELS})""",
    "class_matrix": "SELECT doc_id, "
    + ", ".join(
        f"CAST(list_contains(string_split(coalesce(labels, ''), ','), {sql_text(c['id'])}) AS INTEGER) AS {c['id']}"
        for c in CLASSES
    )
    + f" FROM ({_LABELS})",
    "class_matrix_long": f"""
      SELECT doc_id, dense_rank() OVER (ORDER BY class_id) AS class_no
      FROM (SELECT DISTINCT doc_id, unnest(string_split(labels, ',')) AS class_id FROM ({_LABELS}) WHERE coalesce(labels, '') <> '')""",
    "two_stage": f"""
      SELECT doc_id, status, CASE WHEN status <> 'success' THEN concat('no usable answer: ', status) END AS error,
             CASE WHEN status <> 'generalist_failed' THEN first END AS candidates,
             CASE WHEN status = 'success' THEN second END AS final,
             CASE WHEN status = 'success' THEN round(kept, 6) END AS kept_share
      FROM (SELECT *, {_STATUS} AS status FROM ({_STAGES}))""",
    "two_stage_status": f"SELECT {_STATUS} AS status, count(*) AS n FROM ({_STAGES}) GROUP BY 1",
    "specialist_prompts": f"""
      SELECT r.doc_id, concat('Order them.', chr(10), chr(10), '{{"document":', to_json(any_value(d.text)), ',"labels":[',
             string_agg(CAST(to_json({{'id': class_id, 'label': label, 'context': context, 'confidence': 0.5,
                             'explanation': 'words in common'}}) AS VARCHAR), ',' ORDER BY ranking), ']}}') AS prompt
      FROM ({_RANKED.format(shares=_shares(CLASSES))}) r JOIN (VALUES {_CATALOGUE}) AS k(id, label, context)
      ON k.id = class_id JOIN documents d ON d.doc_id = r.doc_id WHERE r.doc_id % 5 <> 2 GROUP BY r.doc_id""",
}
