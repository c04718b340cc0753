"""Text completion by a user-supplied client, and what it costs.

``client_factory()`` runs once per partition and returns ``client(prompt, system_prompt,
**options) -> str | None``. A client that raises counts as no answer; the reason is kept in a column
beside it. Without a factory every answer is NULL and no Python runs.

With a log, an answer is paid for once: equal prompts are asked once, answers go to the log in rounds of bounded
size, and what the log holds is never asked again, in this run or a later one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed
from ..scale import cut, keep as kept

_CALLS_A_TASK = 32
_LOG = "key string, answer string, error string"


def _asker(client_factory: Callable, system_prompt: str | None, options: dict) -> Callable:
    client = client_factory()

    def ask(text):
        if text is None:
            return None, None
        try:
            return client(text, system_prompt=system_prompt, **options), None
        except Exception as problem:
            return None, f"{type(problem).__name__}: {problem}"
    return ask


def _read_log(df: DataFrame, path: str) -> DataFrame:
    try:
        return df.sparkSession.read.schema(_LOG).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.sparkSession.createDataFrame([], _LOG)


def _complete_logged(df: DataFrame, prompt: str, client_factory: Callable, names: list[str], system_prompt: str | None,
                     tasks: int, log: str, options: dict) -> DataFrame:
    """Ask what the log does not hold, ``tasks`` calls at a time, and read the answers from the log.

    A round asks at most ``_CALLS_A_TASK`` prompts a task and is written before the next begins, so a lost task
    repeats no more than that and a run that breaks off nothing but its last round. Failed calls are asked
    again by the next run.
    """
    asked_with = json.dumps([system_prompt, options], sort_keys=True, default=str)
    # The length keeps settings and prompt apart.
    key = F.when(F.col(prompt).isNotNull(), F.sha2(F.concat(F.lit(f"{len(asked_with)}:{asked_with}"), F.col(prompt)), 256))
    prompts = kept(df.select(key.alias("key"), F.col(prompt).alias("prompt")).where("key is not null").dropDuplicates(["key"]))
    paid = _read_log(df, log).where("error is null").select("key")
    waiting = prompts.join(paid, "key", "left_anti")
    rounds = math.ceil(waiting.count() / (tasks * _CALLS_A_TASK))
    waiting = kept(waiting.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(max(1, rounds)))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _asker(client_factory, system_prompt, options)
        for batch in batches:
            answers, errors = zip(*[ask(p) for p in batch.column(1).to_pylist()]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "answer", "error"])

    for number in range(rounds):
        now = waiting.where(F.col("round") == number).select("key", "prompt")
        now.repartition(tasks).mapInArrow(answer, _LOG).write.mode("append").parquet(log)
    found = (
        _read_log(df, log).join(prompts.select("key"), "key", "left_semi").groupBy("key")
        .agg(F.max(F.when(F.col("error").isNull(), F.col("answer"))).alias("_answer"),
             F.max("error").alias("_error"), F.min(F.col("error").isNotNull().cast("int")).alias("_failed")))
    named = dict(zip(names, [F.col("_answer"), F.when(F.col("_failed") == 1, F.col("_error"))]))
    return df.withColumn("key_", key).join(found.withColumnRenamed("key", "key_"), "key_", "left").select(
        *df.columns, *(value.alias(name) for name, value in named.items()))


def complete(df: DataFrame, prompt: str, client_factory: Callable | None, out: str = "response",
             system_prompt: str | None = None, keep: bool = True, error: str | None = None,
             parallel_calls: int | None = None, log: str | None = None, **options) -> DataFrame:
    """Add the answer to ``prompt`` as column ``out``, and the reason of a failed call as ``error`` if named.

    Answers are neither free nor repeatable, so with ``keep`` they are written once and read
    from there by everything downstream. NULL prompts are not asked. The rows are dealt out to
    ``parallel_calls`` tasks, by default as many as the cluster has cores. ``log`` is a folder that keeps the
    answers beyond the run; only prompts that it has no answer for, with this system prompt and these
    options, are asked.
    """
    if client_factory is None:
        added = [out] if error is None else [out, error]
        return df.withColumns({c: F.lit(None).cast("string") for c in added})

    names = [out] if error is None else [out, error]
    tasks = parallel_calls or df.sparkSession.sparkContext.defaultParallelism
    if log is not None:
        return _complete_logged(df, prompt, client_factory, names, system_prompt, tasks, log, options)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _asker(client_factory, system_prompt, options)
        for batch in batches:
            asked = [ask(p.as_py()) for p in batch.column(prompt)]
            added = [pa.array([a[i] for a in asked], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *names]
            )

    schema = StructType([*df.schema.fields, *(StructField(n, StringType()) for n in names)])
    answered = df.repartition(tasks).mapInArrow(answer, schema)
    return cut(answered) if keep else answered


def complete_structured(df: DataFrame, prompt: str, client_factory: Callable | None, schema: str,
                        valid: Callable[[Column], Column], out: str = "result",
                        system_prompt: str | None = None, **options) -> DataFrame:
    """As ``complete``, with the answer read as JSON of ``schema``; NULL when it does not pass ``valid``."""
    answered = complete(df, prompt, client_factory, "_answer", system_prompt, **options)
    parsed = F.from_json("_answer", schema)
    return answered.withColumn(out, parsed).withColumn(
        out, F.when(F.coalesce(valid(F.col(out)), F.lit(False)), F.col(out))
    ).drop("_answer")


def cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Price of one call in USD; unknown models cost nothing."""
    rates = F.create_map(*[
        part
        for name, (inp, outp) in fixed.PRICES.items()
        for part in (F.lit(name), F.struct(F.lit(inp).alias("input"), F.lit(outp).alias("output")))
    ])
    rate = F.try_element_at(rates, model)
    million = F.lit(1_000_000.0)
    return F.coalesce(
        input_tokens / million * rate["input"] + output_tokens / million * rate["output"], F.lit(0.0)
    )


def cost_by_model(usage: DataFrame) -> DataFrame:
    """Total cost per model of rows with ``model``, ``input_tokens`` and ``output_tokens``."""
    price = cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum(price).alias("cost"))
