"""Anonymisation: text -> sentences -> batches -> model -> one text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.jsonx import optional, parse_strict, required
from textloom.functions.prompts import REDACTION_TEMPLATE, Redaction, redaction_prompt
from textloom.functions.redact import Gazetteers, postprocess, redact, redact_all
from textloom.functions.text import empty_strings, let, split_sentences
from textloom.operators.model_map import Caller, Replay, Rules, model_map
from textloom.operators.once import add_checked, add_once

SENTENCE = T.StructType([required("original_index", T.LongType()), required("text", T.StringType())])
BATCH_ANSWER = T.StructType(
    [
        required("sentences", T.ArrayType(SENTENCE, False)),
        optional("warnings", T.ArrayType(T.StringType(), False)),
        optional("errors", T.ArrayType(T.StringType(), False)),
    ]
)


def sentence_batches(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    per_batch: int = 8,
    pattern: str | None = None,
) -> DataFrame:
    """``doc_id, batch_id, sentences``: fixed-size batches in order.

    Slices are cut inside the row and then exploded, so no shuffle is needed.
    A document without sentences keeps one row with a null batch.
    """
    if per_batch < 1:
        raise ValueError("per_batch must be at least 1")
    split = docs.select(F.col(doc_id).alias("doc_id"), split_sentences(F.col(text), pattern).alias("_all"))
    last = F.floor((F.size("_all") - 1) / per_batch).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(F.col("_all"), b * per_batch + 1, F.lit(per_batch))
    )
    return split.select(
        "doc_id", F.posexplode_outer(F.when(F.size("_all") > 0, slices)).alias("batch_id", "sentences")
    )


def rules_answer(
    sentences: Column, options: Redaction | None = None, gazetteers: Gazetteers = Gazetteers()
) -> Column:
    """The answer format, filled by the redaction rules."""
    done = F.transform(
        redact_all(sentences, options, gazetteers), lambda s, i: F.struct(i.cast("int").alias("original_index"), s.alias("text"))
    )
    return F.to_json(F.struct(done.alias("sentences")))


def check_indexes(checked: Column, expected: Column) -> Column:
    """A checked answer whose indexes must also be unique and in range."""
    index = F.transform(checked["payload"]["sentences"], lambda s: s["original_index"])
    return let(
        let(index, lambda index: F.coalesce(checked["error"], _index_problem(index, expected))),
        lambda error: F.struct(checked["payload"].alias("payload"), error.isNull().alias("ok"), error.alias("error")),
    )


def _index_problem(index: Column, expected: Column) -> Column:
    return (
        F.when(F.exists(index, lambda i: i < 0), F.lit("negative original_index"))
        .when(F.size(F.array_distinct(index)) < F.size(index), F.lit("duplicated original_index"))
        .when(
            (F.size(index) == expected) & F.exists(index, lambda i: i >= expected),
            F.lit("original_index out of range"),
        )
    )


def answer_batches(
    docs: DataFrame,
    backend: Replay | Rules | Caller,
    options: Redaction | None = None,
    per_batch: int = 8,
    template: str = REDACTION_TEMPLATE,
    numbered: bool = True,
    pattern: str | None = None,
    response_path: str | None = None,
) -> DataFrame:
    """One row per batch with its prompt, response and checked answer."""
    batches = sentence_batches(docs, per_batch=per_batch, pattern=pattern).withColumn(
        "prompt", redaction_prompt(F.col("sentences"), options, template, numbered)
    ).withColumn("prompt_chars", F.length("prompt"))  # taken here, so that a prompt need not cross the join with the answers
    answered = model_map(batches, "prompt", backend, response_path)
    checked = add_checked(answered, parse_strict(F.col("response")), BATCH_ANSWER)
    answer = check_indexes(F.col("checked"), F.size("sentences"))
    return add_once(checked, F.struct(answer.alias("answer"))).drop("checked")


def batch_sentences_out(
    sentences: Column,
    answer: Column,
    options: Redaction | None = None,
    own: Column | None = None,
    missing: str = "keep",
    on_error: str = "keep",
) -> Column:
    """The sentences of a batch after the answer, in order.

    ``own`` are the same sentences redacted by rule, where they have been made; else each is redacted when it is needed.

    ``missing``: a sentence the answer leaves out becomes ``empty`` text, or
    ``keep`` falls back on the rule-redacted source.  ``on_error``: what a
    refused answer gives, ``keep`` (as above), ``null`` or ``fail``.
    """
    if missing not in ("keep", "empty") or on_error not in ("keep", "null", "fail"):
        raise ValueError("missing is keep or empty; on_error is keep, null or fail")
    source, by_rule = (sentences, lambda s: redact(s, options)) if own is None else (own, lambda s: s)

    def fill(found: Column) -> Column:
        def pick(s: Column, i: Column) -> Column:
            absent = F.lit("") if missing == "empty" else by_rule(s)
            return postprocess(F.coalesce(F.try_element_at(found, i.cast("bigint")), absent), options)

        return F.transform(source, pick)

    by_index = F.map_from_entries(
        F.transform(answer["payload"]["sentences"], lambda s: F.struct(s["original_index"], s["text"]))
    )
    given = let(F.when(answer["ok"], by_index), fill)
    refused = {
        "keep": F.transform(source, lambda s: postprocess(by_rule(s), options)),
        "null": F.lit(None).cast("array<string>"),
        "fail": F.raise_error(F.concat(F.lit("batch refused: "), answer["error"])).cast("array<string>"),
    }[on_error]
    return (
        F.when(sentences.isNull(), empty_strings()).when(answer["ok"], given).otherwise(refused)
    )


def anonymize(
    docs: DataFrame,
    backend: Replay | Rules | Caller,
    options: Redaction | None = None,
    gazetteers: Gazetteers = Gazetteers(),
    per_batch: int = 8,
    separator: str = " ",
    missing: str = "keep",
    on_error: str = "keep",
    **kwargs,
) -> DataFrame:
    """``doc_id, text, ok, batches``: each document as one anonymised text.

    Only the batches of a single document are ever brought together.  Blank
    documents give empty text.
    """
    answered = answer_batches(docs, backend, options, per_batch, **kwargs)
    own = None
    if gazetteers != Gazetteers():  # names are found in Python, which must not run inside a higher-order function
        answered = answered.withColumn("_own", redact_all(F.col("sentences"), options, gazetteers))
        own = F.col("_own")
    out = batch_sentences_out(F.col("sentences"), F.col("answer"), options, own, missing, on_error)
    good = F.col("sentences").isNull() | F.col("answer.ok")
    part = F.struct("batch_id", out.alias("out"))
    joined = F.transform(F.array_sort("_parts"), lambda p: p["out"])
    return (
        answered.select("doc_id", good.alias("_ok"), part.alias("_part"))
        .groupBy("doc_id")
        .agg(
            F.collect_list("_part").alias("_parts"),
            F.bool_and("_ok").alias("ok"),
            F.count("_part.batch_id").alias("batches"),
        )
        .select(
            "doc_id",
            F.when(
                ~F.exists("_parts", lambda p: p["out"].isNull()), F.array_join(F.flatten(joined), separator)
            ).alias("text"),
            "ok",
            "batches",
        )
    )


def batch_meta(answered: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    """Metrics per batch; the latency is that of the calls which asked it, null without a caller."""
    done = F.col("answer.payload")
    return answered.filter(F.col("sentences").isNotNull()).select(
        "doc_id",
        "batch_id",
        F.size("sentences").alias("sent_count"),
        F.col("seconds").alias("llm_latency_s"),
        "prompt_chars",
        F.when(F.col("answer.ok"), F.size(done["sentences"])).otherwise(F.lit(0)).alias("returned_count"),
        F.lit(provider).cast("string").alias("provider"),
        F.lit(model).cast("string").alias("model"),
        F.greatest(F.col("attempts") - 1, F.lit(0)).alias("retries"),
        done["warnings"].alias("warnings"),
        done["errors"].alias("errors"),
        F.col("answer.ok").alias("ok"),
    )


def dry_run_prompt(
    docs: DataFrame,
    limit_sentences: int = 5,
    options: Redaction | None = None,
    template: str = REDACTION_TEMPLATE,
    numbered: bool = True,
) -> DataFrame:
    """Prompt over the first sentences of each document, without any call."""
    first = F.slice(split_sentences(F.col("text")), 1, max(1, limit_sentences))
    return docs.select("doc_id", redaction_prompt(first, options, template, numbered).alias("prompt"))
