"""Multi-label and two-stage classification."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.jsonx import as_list, is_list, parse_strict, parse_unfenced, required
from textloom.functions.prompts import class_system_prompt, class_user_prompt, document_labels_json, with_system
from textloom.functions.text import empty_strings, is_blank, let, trim_ws
from textloom.operators.model_map import Caller, Replay, Rules, model_map
from textloom.operators.once import add_checked, add_once

LABELS_ANSWER = T.StructType(
    [
        required(
            "relevant_classes",
            T.ArrayType(
                T.StructType([required("class_id", T.StringType()), required("justification", T.StringType())]), False
            ),
        )
    ]
)
LABELS_TYPE = "array<struct<class_id:string,justification:string>>"
#: Everything that is not a letter or a digit separates words.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def clean_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Trimmed id and text; rows where either is blank are dropped."""
    shaped = docs.select(
        trim_ws(F.col(doc_id).cast("string")).alias("doc_id"), trim_ws(F.col(text)).alias("text"), *keep
    )
    return shaped.filter(~is_blank(F.col("doc_id")) & ~is_blank(F.col("text")))


# Rules backend: overlap of document words with class descriptions ------------
def lexicon_rows(classes: Sequence[Mapping[str, str]], text_field: str = "description") -> list[tuple[str, str]]:
    """``(class_id, token)``: the distinct words of each class text."""
    words = {(c["id"].strip(), word) for c in classes for word in re.split(r"[\W_]+", c[text_field].lower())}
    return sorted((name, word) for name, word in words if word)


def lexicon(spark, classes: Sequence[Mapping[str, str]], text_field: str = "description") -> DataFrame:
    return spark.createDataFrame(lexicon_rows(classes, text_field), "class_id string, token string")


def lexicon_scores(docs: DataFrame, classes: Sequence[Mapping[str, str]], text_field: str = "description") -> DataFrame:
    """``doc_id, class_id, score``: word occurrences found in the class words.

    The catalogue comes from the driver and is as small as a prompt.  Words that no class has are
    dropped inside the row, so only hits become rows; counts are combined on the map side.
    """
    known = sorted({word for _, word in lexicon_rows(classes, text_field)})
    words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w.isin(*known)) if known else empty_strings()
    hits = docs.select("doc_id", F.explode(words).alias("token")).join(lexicon(docs.sparkSession, classes, text_field), "token")
    return hits.groupBy("doc_id", "class_id").agg(F.count(F.lit(1)).alias("score"))


def confidences(scores: DataFrame) -> DataFrame:
    """Adds ``confidence``: the share of a class in its document's score."""
    total = F.sum("score").over(Window.partitionBy("doc_id"))
    return scores.withColumn("confidence", F.col("score") / total)


def rules_labels(docs: DataFrame, classes: Sequence[Mapping[str, str]], min_confidence: float = 0.5) -> DataFrame:
    """``doc_id, response``: a multi-label answer built from lexicon scores."""
    scored = confidences(lexicon_scores(docs, classes)).filter(F.col("confidence") >= min_confidence)
    label = F.struct("class_id", F.concat(F.lit("score "), F.col("score").cast("string")).alias("justification"))
    return scored.groupBy("doc_id").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(label)).alias("relevant_classes"))).alias("response")
    )


# Multi-label ------------------------------------------------------------------
def label_prompts(docs: DataFrame, classes: Sequence[Mapping[str, str]], system: str) -> DataFrame:
    return docs.withColumn(
        "prompt", with_system(class_system_prompt(system, classes), class_user_prompt(F.col("text"), classes))
    )


def known_labels(checked: Column, class_ids: Sequence[str] | None = None) -> Column:
    """``struct<relevant_classes, rejected, ok, error>``; empty when refused.

    With ``class_ids`` only known classes stay, the others are ``rejected``.
    """
    none = F.array().cast(LABELS_TYPE)
    labels = F.coalesce(checked["payload"]["relevant_classes"], none)
    if class_ids is None:
        known, other = labels, none
    else:
        known = F.filter(labels, lambda c: c["class_id"].isin(*class_ids))
        other = F.filter(labels, lambda c: ~c["class_id"].isin(*class_ids))
    return F.struct(
        known.alias("relevant_classes"), other.alias("rejected"),
        checked["ok"].alias("ok"), checked["error"].alias("error"),
    )


def classify_multilabel(
    docs: DataFrame,
    classes: Sequence[Mapping[str, str]],
    backend: Replay | Rules | Caller,
    system: str = "You assign predefined classes to texts.",
    enforce_catalog: bool = True,
    response_path: str | None = None,
) -> DataFrame:
    """``doc_id, relevant_classes, n_labels, rejected, ok, error`` per document."""
    answered = model_map(label_prompts(docs, classes, system), "prompt", backend, response_path)
    ids = [c["id"].strip() for c in classes] if enforce_catalog else None
    checked = add_checked(answered.select("doc_id", "response"), parse_strict(F.col("response")), LABELS_ANSWER)
    parsed = add_once(checked.select("doc_id", "checked"), known_labels(F.col("checked"), ids))
    return parsed.select(
        "doc_id", "relevant_classes", F.size("relevant_classes").alias("n_labels"), "rejected", "ok", "error"
    )


# Two stages -------------------------------------------------------------------
def top_candidates(scores: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best classes per document with their ``ranking``."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "class_id")
    return confidences(scores).withColumn("ranking", F.row_number().over(order)).filter(F.col("ranking") <= k)


def _entries(v: Column) -> Column:
    """List answers as structs; missing members become null."""
    return F.transform(
        as_list(v),
        lambda e, i: F.struct(
            F.coalesce(F.try_variant_get(e, "$.ranking", "int"), i + 1).alias("ranking"),
            F.try_variant_get(e, "$.id", "string").alias("id"),
            F.try_variant_get(e, "$.confidence", "double").alias("confidence"),
            F.try_variant_get(e, "$.explanation", "string").alias("explanation"),
        ),
    )


def _nonempty_list(response: Column) -> Column:
    def entries(v: Column) -> Column:
        return F.when(is_list(v) & (F.size(as_list(v)) > 0), _entries(v))

    return let(parse_unfenced(response), entries)


def _catalogue_map(classes: Sequence[Mapping[str, str]], field: str) -> Column:
    pairs = [F.lit(x) for c in classes for x in (str(c["id"]), c.get(field))]
    return F.create_map(*pairs)


def generalist_prompt(text: Column, classes: Sequence[Mapping[str, str]], system: str) -> Column:
    """System text plus the document and the whole class list as JSON."""
    listing = json.dumps([dict(c) for c in classes], ensure_ascii=False)
    return with_system(system, document_labels_json(text, listing))


def specialist_prompt(text: Column, candidates: Column, classes: Sequence[Mapping[str, str]], system: str) -> Column:
    """System text plus the document and its candidates as JSON.

    Candidates get their ``label`` and ``context`` back from the catalogue;
    ids outside it are left out, since they name no class.
    """
    label, context = _catalogue_map(classes, "label"), _catalogue_map(classes, "context")
    known = F.filter(candidates, lambda c: c["id"].isin(*[str(x["id"]) for x in classes]))
    rich = F.transform(
        known,
        lambda c: F.struct(
            c["id"].alias("id"),
            F.try_element_at(label, c["id"]).alias("label"),
            F.try_element_at(context, c["id"]).alias("context"),
            c["confidence"].alias("confidence"),
            c["explanation"].alias("explanation"),
        ),
    )
    return F.when(F.size(known) > 0, with_system(system, document_labels_json(text, F.to_json(rich))))


def classify_two_stage(
    docs: DataFrame,
    classes: Sequence[Mapping[str, str]],
    generalist: Replay | Rules | Caller,
    specialist: Replay | Rules | Caller,
    generalist_system: str = "Select the five most likely classes. Answer with a JSON list of id, confidence, explanation.",
    specialist_system: str = "Keep and order the relevant candidates. Answer with a JSON list of ranking, id, confidence, explanation.",
    response_paths: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """``doc_id, text, stage1, stage2, status, error``: one wide row per document.

    The second stage is asked only where the first gave a non-empty list.
    """
    asked = docs.withColumn("prompt", generalist_prompt(F.col("text"), classes, generalist_system))
    one = model_map(asked, "prompt", generalist, response_paths[0])
    one = add_once(one, F.struct(_nonempty_list(F.col("response")).alias("stage1"))).select("doc_id", "text", "stage1")
    asked = one.withColumn("prompt", specialist_prompt(F.col("text"), F.col("stage1"), classes, specialist_system))
    two = model_map(asked, "prompt", specialist, response_paths[1])
    stage2 = F.when(F.col("prompt").isNotNull(), _nonempty_list(F.col("response")))
    done = add_once(two.select("doc_id", "text", "stage1", "prompt", "response"), F.struct(stage2.alias("stage2")))
    done = done.select("doc_id", "text", "stage1", "stage2")
    status = (
        F.when(F.col("stage1").isNull(), F.lit("generalist_failed"))
        .when(F.col("stage2").isNull(), F.lit("specialist_failed"))
        .otherwise(F.lit("success"))
    )
    return done.withColumn("status", status).withColumn(
        "error", F.when(F.col("status") != "success", F.concat(F.lit("no usable answer: "), F.col("status")))
    )
