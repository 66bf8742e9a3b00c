"""The one place where a model is called: prompt in, response out.

Three backends share one contract.  Input is any frame with a prompt column;
output is the same rows plus ``response``, ``attempts``, ``error``, ``seconds``
(the time of the calls it was part of) and ``backend``.  Equal prompts are answered once.

* ``Replay``   - an equi-join with stored responses: deterministic, also the
  cache and the resume point of a job;
* ``Rules``    - a column expression in place of a model.  It answers the same
  question in the same format; it does not imitate a model;
* ``Caller`` - user code over Arrow batches.  No HTTP client is shipped.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import ensure_checkpoint_dir

RESPONSE_SCHEMA = "prompt_hash string, response string, attempts int, error string, seconds double"
ADDED = ("response", "attempts", "error", "seconds", "backend")


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


@dataclass(frozen=True)
class Replay:
    """Stored responses: ``prompt_hash, response`` and optionally the rest.

    Of several rows for a prompt the good one counts, then the first in text
    order.  ``unique`` promises one row per prompt and saves that step.
    """

    responses: DataFrame
    unique: bool = False


@dataclass(frozen=True)
class Rules:
    """A response built from the row's own columns."""

    response: Column


@dataclass(frozen=True)
class Caller:
    """``call(prompts) -> responses`` on a list of prompts.

    ``accept`` sees a response and raises or returns False to refuse it, so a
    retry covers the call, the parse and the validation.  ``batch_rows`` are the
    prompts handed over at once.  ``setup`` runs once per task and its result is
    passed to ``call``.

    Prompts are asked in slices, and each slice is committed by itself.  ``calls`` bounds the
    tasks and so the calls in flight: they are dealt to the slices that are asked at once, so no call
    waits until a slice is planned or committed.  Without it slices are asked one after the other.
    ``slice_rows`` bounds the prompts that are asked again when a slice is lost; the number of slices,
    not that of calls, grows with the prompts.
    """

    call: Callable[..., list[str]]
    max_tries: int = 3
    accept: Callable[[str], bool | None] | None = None
    calls: int | None = None
    batch_rows: int = 64
    slice_rows: int = 100_000
    setup: Callable[[], object] | None = None


def distinct_prompts(df: DataFrame, prompt: str) -> DataFrame:
    """``prompt_hash, prompt`` once per distinct prompt.

    Only one copy per map partition is shuffled, so a prompt that a third of
    the rows share costs no more than any other.
    """
    hashed = df.select(prompt_hash(F.col(prompt)).alias("prompt_hash"), F.col(prompt).alias("prompt"))
    return hashed.filter(F.col("prompt").isNotNull()).groupBy("prompt_hash").agg(
        F.any_value("prompt").alias("prompt")
    )


def pending_prompts(df: DataFrame, prompt: str, stored: DataFrame) -> DataFrame:
    """Distinct prompts without a good stored response: what a resumed job owes."""
    if "error" in stored.columns:
        stored = stored.filter(F.col("error").isNull())
    return distinct_prompts(df, prompt).join(stored.select("prompt_hash"), "prompt_hash", "left_anti")


def call_model(prompts: DataFrame, backend: Caller) -> DataFrame:
    """Responses for ``prompt_hash, prompt`` rows, not yet materialised."""
    if backend.calls:
        prompts = prompts.repartition(backend.calls, "prompt_hash")
    return prompts.select("prompt_hash", "prompt").mapInPandas(_caller(backend), RESPONSE_SCHEMA)


class SliceError(RuntimeError):
    """Some slices failed; the others are stored and will not be asked again."""


def store_responses(prompts: DataFrame, backend: Caller, path: str) -> DataFrame:
    """Call the model slice by slice, append the responses to ``path``, read them back.

    Prompts are dealt to slices by their digest and written once, so a slice reads
    its own prompts only.  A slice that fails does not stop the others; at the end the
    failure is raised, and the next run asks what has no good answer by then.
    """
    spark = prompts.sparkSession
    todo = f"{ensure_checkpoint_dir(spark)}/textloom-prompts-{uuid.uuid4().hex}"
    prompts.select("prompt_hash", "prompt").write.parquet(todo)
    held = spark.read.schema("prompt_hash string, prompt string").parquet(todo)
    slices = -(-held.count() // backend.slice_rows)
    if slices > 1:
        of = F.pmod(F.crc32(F.col("prompt_hash").cast("binary")), F.lit(slices)).cast("int")
        dealt = f"{todo}-slices"
        held.withColumn("slice", of).repartition(slices, "slice").write.partitionBy("slice").parquet(dealt)
        held = spark.read.schema("prompt_hash string, prompt string, slice int").parquet(dealt)
    at_once = max(1, min(backend.calls or 1, slices))
    asked = replace(backend, calls=backend.calls // at_once) if backend.calls else backend

    files, target = _files(spark, path)
    # Slices that are asked at once may not append to one folder: each has its own, out of sight, and its files are moved when it is done.
    hidden = f"{path}/_asked-{uuid.uuid4().hex}"

    def ask(i: int) -> tuple[int, Exception] | None:
        part = held.where(F.col("slice") == i) if slices > 1 else held
        own = f"{hidden}/{i}"
        try:
            call_model(part, asked).write.parquet(own)
            for found in files.globStatus(_files(spark, f"{own}/part-*")[1]):
                if not files.rename(found.getPath(), target):
                    raise OSError(f"could not move {found.getPath().toString()}")
        except Exception as exc:
            return i, exc
        return None

    if slices:
        files.mkdirs(target)
        with ThreadPoolExecutor(at_once) as pool:
            failed = [one for one in pool.map(inheritable_thread_target(ask), range(slices)) if one]
        files.delete(_files(spark, hidden)[1], True)
    else:
        failed = []
    if failed:
        numbers = ", ".join(str(i) for i, _ in failed)
        raise SliceError(f"{len(failed)} of {slices} slices failed: {numbers}") from failed[0][1]
    if not slices:
        spark.createDataFrame([], RESPONSE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)


def model_map(
    df: DataFrame,
    prompt: str,
    backend: Replay | Rules | Caller,
    response_path: str | None = None,
) -> DataFrame:
    """Add a response to every row of ``df``; see the module text.

    With ``Caller`` the prompts are asked now and the responses written to
    ``response_path``, where prompts with a good answer are not asked again.
    Without a path they go to a new table in the checkpoint folder.  Either
    way the plan that follows reads a table, so a lost executor or a second
    use of the result cannot repeat a call.
    """
    clash = [c for c in (*ADDED, "prompt_hash") if c in df.columns]
    if clash:
        raise ValueError(f"the input already has {', '.join(clash)}")
    if isinstance(backend, Rules):
        return df.withColumns(
            {
                "response": backend.response,
                "attempts": F.lit(1),
                "error": F.lit(None).cast("string"),
                "seconds": F.lit(None).cast("double"),
                "backend": F.lit("rules"),
            }
        )
    if isinstance(backend, Replay):
        return _attach(df, prompt, backend.responses, "replay", backend.unique)
    spark = df.sparkSession
    if response_path is None:
        fresh = f"{ensure_checkpoint_dir(spark)}/textloom-responses-{uuid.uuid4().hex}"
        answers = store_responses(distinct_prompts(df, prompt), backend, fresh)
        return _attach(df, prompt, answers, "callable", unique=True)
    stored = _read_stored(spark, response_path)
    todo = distinct_prompts(df, prompt) if stored is None else pending_prompts(df, prompt, stored)
    return _attach(df, prompt, store_responses(todo, backend, response_path), "callable")


def _files(spark, path: str):
    """The Hadoop file system of a path, and the path for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _read_stored(spark, path: str) -> DataFrame | None:
    files, stored = _files(spark, path)
    if not files.exists(stored):
        return None
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)


def _attach(df: DataFrame, prompt: str, answers: DataFrame, name: str, unique: bool = False) -> DataFrame:
    """Left join on the prompt digest.

    The right side has one row per digest, so rows never multiply.  When many
    rows share a prompt the skewed side is the left one, which adaptive
    execution splits - but only where both sides reach the join straight from
    an exchange.  Joining on the binary digest, not on the text one the right
    side was grouped by, puts an exchange there.
    """
    have = set(answers.columns)
    attempts = F.col("attempts") if "attempts" in have else F.lit(1)
    error = F.col("error") if "error" in have else F.lit(None).cast("string")
    seconds = F.col("seconds") if "seconds" in have else F.lit(None).cast("double")
    right = answers.select("prompt_hash", "response", attempts.alias("attempts"), error.alias("error"), seconds.alias("seconds"))
    if not unique:
        first = F.min_by(
            F.struct("response", "attempts", "error", "seconds"),
            F.struct(F.col("error").isNotNull(), F.coalesce("response", F.lit(""))),
        )
        right = right.groupBy("prompt_hash").agg(first.alias("_a")).select("prompt_hash", "_a.*")
    right = right.select(F.unhex("prompt_hash").alias("_digest"), "response", "attempts", "error", "seconds")
    keyed = df.withColumn("_digest", F.unhex(prompt_hash(F.col(prompt))))
    joined = keyed.join(right, "_digest", "left").drop("_digest")
    missing = F.col("response").isNull() & F.col("error").isNull()
    return joined.withColumns(
        {
            "attempts": F.coalesce("attempts", F.lit(0)),
            "error": F.when(missing, F.lit("no response")).otherwise(F.col("error")),
            "backend": F.lit(name),
        }
    )


def _caller(backend: Caller) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def ask(prompts: list[str], extra: tuple) -> list[str]:
        answers = list(backend.call(prompts, *extra))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts, {len(answers)} responses")
        return answers

    def refuse(response: str) -> str | None:
        if response is None:
            return "no response"
        if backend.accept is None:
            return None
        try:
            return "refused" if backend.accept(response) is False else None
        except Exception as exc:
            return f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extra = (backend.setup(),) if backend.setup else ()
        for frame in batches:
            for at in range(0, len(frame), backend.batch_rows):
                part = frame.iloc[at : at + backend.batch_rows]
                prompts = part["prompt"].tolist()
                response: list[str | None] = [None] * len(prompts)
                error: list[str | None] = ["not asked"] * len(prompts)
                tries, seconds = [0] * len(prompts), [0.0] * len(prompts)
                for _ in range(backend.max_tries):
                    open_ = [i for i, e in enumerate(error) if e is not None]
                    if not open_:
                        break
                    start = time.perf_counter()
                    try:
                        answers, failed = ask([prompts[i] for i in open_], extra), None
                    except Exception as exc:
                        answers, failed = [], f"{type(exc).__name__}: {exc}"
                    took = time.perf_counter() - start
                    for i in open_:
                        seconds[i] += took
                        if failed is not None:
                            tries[i] += 1
                            error[i] = failed
                    for i, answer in zip(open_, answers):
                        tries[i] += 1
                        response[i], error[i] = answer, refuse(answer)
                yield pd.DataFrame(
                    {
                        "prompt_hash": part["prompt_hash"].tolist(),
                        "response": response,
                        "attempts": tries,
                        "error": error,
                        "seconds": seconds,
                    }
                )

    return run
