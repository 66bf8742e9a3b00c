"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.operators.model_map import Replay, model_map, prompt_hash
from textloom.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {
    name for name in QUERIES
    if name in (
        "knn_topk knn_within_label retrieval_metrics metrics_by_k project_metrics weighted_rollup overall_summary "
        "rollup_levels summary_merge metric_maps retrieve rag_prompt rag_answer evaluate_retrieval evaluate_by_text retrieve_approx "
        "knn_cells knn_blocks knn_approx knn_recall redact_names json_array_records"
    ).split()
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_and_no_python_outside_retrieval(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search(r"NestedLoopJoin|CartesianProduct", text)
    python = re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|CoGroups", text)
    assert bool(python) <= (name in PYTHON_ALLOWED)


def test_scans_read_only_what_is_used(spark):
    schema = re.compile(r"ReadSchema: struct<([^>]*)>")
    spark.conf.set("spark.sql.debug.maxToStringFields", "50")
    assert schema.findall(plan(QUERIES["token_counts"](spark, SF_DIR))) == ["doc_id:bigint,text:string"]
    assert schema.findall(plan(QUERIES["sample_per_source"](spark, SF_DIR))) == ["doc_id:bigint,source:string"]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [In(lang, [en,fr])" in plan(QUERIES["replay_join"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["split_sentences", "sentence_batches", "class_matrix", "faq_explode", "issue_facts"])
def test_row_local_steps_do_not_shuffle(spark, name):
    """Past the one exchange of a small file and the joins of stored answers."""
    text = plan(QUERIES[name](spark, SF_DIR))
    shuffles = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    assert name == "class_matrix" or not shuffles


def test_ranked_limits_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["sample_per_source"](spark, SF_DIR))


def test_hot_prompt_is_split_by_adaptive_execution(spark):
    """A third of the rows share a prompt; the skewed side is split at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        text = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        pad = F.sha2(F.col("id").cast("string"), 512)
        df = spark.range(0, 60_000, 1, 8).select("id", text.alias("p"), pad.alias("pad"))
        stored = df.select(prompt_hash(F.col("p")).alias("prompt_hash"), F.upper("p").alias("response")).distinct()
        out = model_map(df, "p", Replay(stored))
        joined = out.select("id", "pad", (F.col("response") == F.upper("p")).alias("right"))
        rows = joined.collect()
        assert len(rows) == 60_000 and all(r["right"] for r in rows)
        assert "skew=true" in plan(joined)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_chunk_windows_read_the_texts_once(spark):
    """The plan that is left after the chunks are written reads them, not the pages, and deals out small tables only."""
    text = plan(QUERIES["chunk_windows"](spark, SF_DIR))
    assert "conversations.parquet" not in text and text.count("Exchange") <= 5
