"""Evaluation sets, retrieval scores, judged answers, project metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions.jsonx import is_object, parse_braces
from textloom.functions.prompts import judge_prompt, paraphrase_prompt, with_system
from textloom.functions.text import as_id, let, line_list
from textloom.operators.knn import KnnSizes
from textloom.operators.numbering import written
from textloom.operators.model_map import ADDED, Caller, Replay, Rules, model_map
from textloom.operators.once import add_once
from textloom.operators.sampling import sample_n
from textloom.plans.faq import retrieve

DEFAULT_KS = (1, 3, 5)
JUDGE_FIELDS = ("llm_judge_score", "llm_judge_correctness", "llm_judge_completeness", "llm_judge_relevance")
JUDGE_MEANS = ("avg_llm_score", "avg_correctness", "avg_completeness", "avg_relevance")


def metric_columns(ks: Sequence[int] = DEFAULT_KS) -> list[str]:
    """Retrieval metric columns in report order."""
    at = lambda name: [f"{name}_at_{k}" for k in ks]
    return [*at("hit"), "mrr", *at("precision"), *at("recall"), *at("ndcg")]


# Evaluation set ---------------------------------------------------------------
def make_eval_set(
    faq: DataFrame,
    backend: Replay | Rules | Caller,
    num_questions: int | None = None,
    num_variations: int = 3,
    project: str | None = None,
    seed: int = 42,
    response_path: str | None = None,
) -> DataFrame:
    """Questions and their variations as evaluation items: all, or a seeded sample of ``num_questions``.

    An unanswered paraphrase falls back on the original question, which then
    counts as original; ``variation_ok`` tells the two apart.
    """
    sampled = faq if num_questions is None else sample_n(faq, num_questions, "faq_id", seed, project)
    asked = sampled.withColumn("prompt", paraphrase_prompt(F.col("question"), num_variations))
    answered = model_map(asked, "prompt", backend, response_path)
    return eval_items(answered, num_variations, project)


def eval_items(answered: DataFrame, num_variations: int, project: str | None = None) -> DataFrame:
    """Original and variations of answered rows, one item each."""
    good = F.col("response").isNotNull() & F.col("error").isNull()
    variations = F.when(good, line_list(F.col("response"), num_variations)).otherwise(F.array("question"))
    items = answered.select(
        "faq_id", *([project] if project else []), F.col("question").alias("_original"), "chunk_id", "source_text",
        "answer", good.alias("variation_ok"),
        F.posexplode(F.concat(F.array("question"), variations)).alias("_pos", "question"),
    )
    return items.select(
        F.concat_ws("#", F.col("faq_id").cast("string"), F.col("_pos").cast("string")).alias("item_id"),
        *([project] if project else []),
        "question",
        as_id(F.col("chunk_id")).alias("correct_chunk_id"),
        (F.col("question") == F.col("_original")).alias("is_original"),
        "source_text", "answer", "variation_ok",
    )


# Retrieval --------------------------------------------------------------------
def score_ranked(ranked: DataFrame, item: Sequence[str], match: Column, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Every metric of every item from rows ``item..., rank``.

    All of them come from one aggregate: the first matching rank and, per k,
    the matches within it.
    """
    facts = ranked.groupBy(*item).agg(
        F.min(F.when(match, F.col("rank"))).alias("correct_chunk_position"),
        *[F.count_if(match & (F.col("rank") <= k)).alias(f"_in_{k}") for k in ks],
    )
    return with_metrics(facts, item, ks)


def with_metrics(facts: DataFrame, keep: Sequence[str], ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    pos = F.col("correct_chunk_position")
    count = lambda k: F.coalesce(F.col(f"_in_{k}"), F.lit(0))
    return facts.select(
        *keep,
        "correct_chunk_position",
        *[M.hit_at(pos, k).alias(f"hit_at_{k}") for k in ks],
        M.reciprocal_rank(pos).alias("mrr"),
        *[M.precision_at(count(k), k).alias(f"precision_at_{k}") for k in ks],
        *[M.recall_at(pos, k).alias(f"recall_at_{k}") for k in ks],
        *[M.ndcg_at(pos, k).alias(f"ndcg_at_{k}") for k in ks],
    )


def evaluate_retrieval(
    items: DataFrame,
    faq: DataFrame,
    ks: Sequence[int] = DEFAULT_KS,
    top_k: int = 5,
    within: str | None = None,
    match_on: Sequence[str] = ("chunk_id",),
    by_text: bool = False,
    sizes: KnnSizes = KnnSizes(),
    position: str = "faq_id",
) -> DataFrame:
    """Retrieve once for all items and score the lists.

    ``items``: ``item_id, correct_chunk_id, is_original, embedding`` plus the
    other ``match_on`` columns under the same names.  ``match_on=("course",
    "chunk_id")`` is right where chunk ids restart per course.  ``by_text``
    looks chunk ids up by source text, first entry first, as a plain list of
    texts would; the column ``position`` says which entry that is.
    """
    extra = [c for c in match_on if c != "chunk_id"]
    payload = [c for c in ("chunk_id", *extra) if c != within]
    if by_text:
        # Looked up once for each entry, before the search, and written, as the search reads its table more
        # than once: no text is shuffled, neither for the lookup nor with the found rows.
        scope = [within] if within else []
        digest = F.unhex(F.sha2("source_text", 256)).alias("_digest")  # see model_map: keeps hot texts splittable
        first = faq.groupBy(*scope, digest).agg(F.min_by("chunk_id", position).alias("_first"))
        first = first.select(*scope, F.unhex(F.hex("_digest")).alias("_digest"), "_first")
        entries = faq.select("faq_id", "embedding", *scope, *[c for c in extra if c != within], digest)
        faq = written(entries.join(first, [*scope, "_digest"], "left").withColumnRenamed("_first", "chunk_id").drop("_digest"), "entries")
    found = retrieve(items, faq, top_k, within, payload, "item_id", sizes=sizes)
    found = found.withColumn("chunk_id", as_id(F.col("chunk_id")))
    truth = items.select("item_id", "correct_chunk_id", *[F.col(c).alias(f"_true_{c}") for c in extra])
    match = F.col("chunk_id") == as_id(F.col("correct_chunk_id"))
    for c in extra:
        match = match & (F.col(c) == F.col(f"_true_{c}"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    facts = (
        found.join(truth, "item_id")
        .groupBy("item_id")
        .agg(
            F.transform(listed, lambda e: e["chunk_id"]).alias("retrieved_chunks"),
            F.min(F.when(match, F.col("rank"))).alias("correct_chunk_position"),
            *[F.count_if(match & (F.col("rank") <= k)).alias(f"_in_{k}") for k in ks],
        )
    )
    keep = [c for c in items.columns if c != "embedding"]
    full = items.select(*keep).join(facts, "item_id", "left").withColumn(
        "retrieved_chunks", F.coalesce("retrieved_chunks", F.array().cast("array<string>"))
    )
    return with_metrics(full, [*keep, "retrieved_chunks"], ks)


def long_metrics(details: DataFrame, item: Sequence[str], ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """One row per item and k: ``hit, precision, recall, ndcg``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.col(f"hit_at_{k}").alias("hit"),
                *[F.col(f"{m}_at_{k}").alias(m) for m in ("precision", "recall", "ndcg")],
            )
            for k in ks
        ]
    )
    return details.select(*item, F.explode(rows).alias("_m")).select(*item, "_m.*")


def last_per_question(rows: DataFrame, order: str, scope: Sequence[str] = ()) -> DataFrame:
    """The last of the rows that share a question text.

    Items have ids, so nothing collapses by default; this is for comparing
    with results keyed by question text.
    """
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(order))
    return rows.groupBy(*scope, "question").agg(last.alias("_r")).select("_r.*")


# Judged answers ---------------------------------------------------------------
def parse_judgement(response: Column, failed_as_zero: bool = False) -> Column:
    """``struct`` of four scores, a text and ``judge_ok``.

    A failed judgement has null scores and stays out of every mean;
    ``failed_as_zero`` scores it 0 instead.
    """

    def result(v: Column, ok: Column) -> Column:
        def score(name: str, kind: str) -> Column:
            value = F.when(ok, F.try_variant_get(v, f"$.{name}", kind))
            return F.when(~ok, F.lit(0).cast(kind)).otherwise(value) if failed_as_zero else value

        return F.struct(
            score("overall_score", "double").alias("llm_judge_score"),
            score("correctness", "bigint").alias("llm_judge_correctness"),
            score("completeness", "bigint").alias("llm_judge_completeness"),
            score("relevance", "bigint").alias("llm_judge_relevance"),
            F.when(ok, F.try_variant_get(v, "$.justification", "string")).alias("llm_judge_justification"),
            ok.alias("judge_ok"),
        )

    return let(parse_braces(response), lambda v: let(is_object(v), lambda ok: result(v, ok)))


def judge(
    answers: DataFrame,
    backend: Replay | Rules | Caller,
    system: str = "You grade answers from 1 to 5.",
    failed_as_zero: bool = False,
    response_path: str | None = None,
) -> DataFrame:
    """Adds the judge columns to rows ``question, generated_answer, answer``."""
    prompt = with_system(system, judge_prompt(F.col("question"), F.col("generated_answer"), F.col("answer")))
    answered = model_map(answers.withColumn("prompt", prompt), "prompt", backend, response_path)
    judged = add_once(answered, parse_judgement(F.col("response"), failed_as_zero))
    return judged.drop("prompt", *ADDED)


def consistent_judgement() -> Column:
    """Does the overall score equal the rounded mean of its parts?"""
    mean = M.judge_mean(
        F.col("llm_judge_correctness"), F.col("llm_judge_completeness"), F.col("llm_judge_relevance")
    )
    return F.abs(mean - F.col("llm_judge_score")) < 0.05


# Projects ---------------------------------------------------------------------
def project_metrics(details: DataFrame, project: Sequence[str] = ("project",), ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Means per project over its variations, or over everything without any.

    Both means are taken in the same aggregate and one is chosen afterwards,
    so a large project is combined on the map side instead of being windowed.
    """
    variation = ~F.col("is_original")
    judged = [(f, m) for f, m in zip(JUDGE_FIELDS, JUDGE_MEANS) if f in details.columns]
    # A row without an overall score is not a judged row.
    scored = F.col(JUDGE_FIELDS[0]).isNotNull() if judged else F.lit(False)
    aggs = [F.count_if(variation).alias("_v_n"), F.count(F.lit(1)).alias("_a_n")]
    for name in metric_columns(ks):
        value = F.col(name).cast("double")
        aggs += [F.avg(F.when(variation, value)).alias(f"_v_{name}"), F.avg(value).alias(f"_a_{name}")]
    for column, mean in judged:
        value = F.when(scored, F.col(column).cast("double"))
        aggs += [F.avg(F.when(variation, value)).alias(f"_v_{mean}"), F.avg(value).alias(f"_a_{mean}")]
    if judged:
        aggs += [F.count_if(variation & scored).alias("_v_judged"), F.count_if(scored).alias("_a_judged")]
    names = [*metric_columns(ks), *[m for _, m in judged], *(["judged"] if judged else [])]
    pick = lambda n: F.when(F.col("_v_n") > 0, F.col(f"_v_{n}")).otherwise(F.col(f"_a_{n}"))
    return details.groupBy(*project).agg(*aggs).select(
        *project, pick("n").alias("total_questions"), *[pick(n).alias(n) for n in names]
    )
