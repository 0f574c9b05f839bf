"""Prompts to an external annotator, in batches, with a log of what was answered.

The log is a table in a folder that driver and executors share. The prompts are held
against it before the first pass, and each later pass asks what failed in the log, so what
it has is never asked again: not by the next pass, nor by a later run over more prompts. A
task commits its answers by itself; if a task or the job is lost, only what that task had not
committed is asked once more. Each prompt carries its digest and attempt, by which a service
can know a repeated call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import stripped
from marginalia.sources.scratch import saved

LOG = "sample_id string, digest string, attempt int, ok boolean, text string, error string"
#: As it is written: a failure keeps its prompt, by which the next pass asks again.
KEPT = LOG + ", system string, user string, tokens int"
KEY = ["sample_id", "digest"]


class Prompt(NamedTuple):
    sample_id: str
    digest: str
    attempt: int
    system: str
    user: str


#: Answers a batch of prompts in their order; None where there is no answer. What it raises fails the batch.
Call = Callable[[Sequence[Prompt]], Sequence[str | None]]


def packed(prompts: Sequence[Prompt], tokens: Sequence[int], budget: int, attempts: int) -> Iterator[list[Prompt]]:
    """``prompts`` in batches of up to ``budget`` tokens, in order; a longer prompt is a batch of its own.

    The budget halves with each attempt, and the last one is made for each prompt alone, so
    that a prompt which fails its batch doesn't fail the others with it.
    """
    batch, held = [], 0
    for prompt, size in sorted(zip(prompts, tokens, strict=True), key=lambda x: x[0].attempt):
        most = budget >> prompt.attempt - 1
        if batch and (held + size > most or batch[0].attempt != prompt.attempt or prompt.attempt >= attempts):
            yield batch
            batch, held = [], 0
        batch.append(prompt)
        held += size
    if batch:
        yield batch


def outcomes(call: Call, batch: Sequence[Prompt]) -> list[tuple]:
    """A row of the log for each prompt of a batch."""
    try:
        texts = list(call(batch))
        if len(texts) != len(batch):
            raise ValueError(f"{len(texts)} answers to {len(batch)} prompts")
        errors = [None if x is not None else "no answer" for x in texts]
    except Exception as e:  # whatever an external service does goes into the log
        texts, errors = [None] * len(batch), [f"{type(e).__name__}: {e}"] * len(batch)
    return [(p.sample_id, p.digest, p.attempt, e is None, x, e) for p, x, e in zip(batch, texts, errors, strict=True)]


def _log(prompts: DataFrame, path: str, schema: str = LOG) -> DataFrame:
    return prompts.sparkSession.read.schema(schema).parquet(path)


def digested(prompts: DataFrame, parts: int) -> DataFrame:
    """(sample_id, digest, system, user), each prompt of a sample once, in ``parts`` partitions by sample and digest; null texts are empty."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("system", "user")]
    digest = F.sha2(F.concat_ws("\x00", "system", "user"), 256)
    return prompts.select(F.col("sample_id").cast("string").alias("sample_id"), *texts).withColumn("digest", digest).repartition(parts, *KEY).dropDuplicates(KEY).select("sample_id", "digest", "system", "user")


def ask(prompts: DataFrame, call: Call, log: str, budget: int = 8_192, attempts: int = 3, tasks: int = 64) -> DataFrame:
    """(sample_id, digest, attempt, text): the answers to ``prompts(sample_id, system, user)``, asked where the log in the folder ``log`` has none.

    A pass asks what has no answer and fewer than ``attempts`` failures, in at most ``tasks`` tasks and
    batches of ``budget`` white-space tokens. Prompts that failed ``attempts`` times are in
    ``quarantined``. ``sample_id`` is not null; equal prompts of different samples are
    different calls, repeated rows one.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], KEPT).write.mode("append").parquet(log)
    tried = _log(prompts, log).groupBy(*KEY).agg(F.max("attempt").alias("tried"), F.bool_or("ok").alias("done"))
    tokens = sum((F.size(F.split(stripped(F.col(c)), r"\s+")) for c in ("system", "user")), F.lit(0))
    dealt = digested(prompts, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # the join keeps this partitioning: texts move once
    known = dealt.join(tried.hint("shuffle_merge"), KEY, "left").withColumn("attempt", F.coalesce("tried", F.lit(0)) + 1)
    asked = saved(known.select(*Prompt._fields, tokens.alias("tokens"), (~F.coalesce("done", F.lit(False)) & (F.col("attempt") <= attempts)).alias("open")), "prompts")
    pending = asked.where("open")
    for _ in range(attempts):
        if pending.isEmpty():
            break

        def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in frames:
                sizes = dict(zip(zip(rows["sample_id"], rows["digest"], strict=True), rows["tokens"].tolist(), strict=True))
                batches = packed([Prompt(*x) for x in rows[list(Prompt._fields)].itertuples(index=False)], rows["tokens"].tolist(), budget, attempts)
                for batch in batches:
                    said = outcomes(call, batch)
                    again = [(None, None, None) if x[3] or p.attempt >= attempts else (p.system, p.user, sizes[p.sample_id, p.digest]) for p, x in zip(batch, said, strict=True)]
                    yield pd.DataFrame([x + y for x, y in zip(said, again, strict=True)], columns=[x.split()[0] for x in KEPT.split(", ")], dtype=object)

        # version 2: finished tasks stay in the log if the job is lost; readers bear a row twice
        by_task = pending.select(*Prompt._fields, "tokens").coalesce(tasks).mapInPandas(answer, KEPT).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        by_task.mode("append").parquet(log)
        # what failed has its texts in the log, so that the others are not moved or read again
        rows = _log(prompts, log, KEPT).select(*KEY, "attempt", "ok", F.when(F.col("user").isNotNull(), F.struct("system", "user", "tokens")).alias("prompt"))
        last = rows.groupBy(*KEY).agg(F.max("attempt").alias("tried"), F.bool_or("ok").alias("done"), F.max_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("attempt"))).alias("prompt"))
        failed = last.where(~F.col("done") & (F.col("tried") < attempts)).join(asked.where("open").select(*KEY).hint("shuffle_merge"), KEY, "left_semi")
        pending = saved(failed.select(*KEY, (F.col("tried") + 1).alias("attempt"), "prompt.*").repartition(tasks, *KEY), "pending")
    answered = _log(prompts, log).where("ok").groupBy(*KEY).agg(F.min_by(F.struct("attempt", "text"), "attempt").alias("first"))
    return asked.select(*KEY).join(answered.hint("shuffle_merge"), KEY).select(*KEY, "first.*")


def quarantined(prompts: DataFrame, log: str, attempts: int = 3) -> DataFrame:
    """(sample_id, digest, attempts, error): prompts of the log without an answer after ``attempts`` failures, with the last error."""
    rows = _log(prompts, log).groupBy(*KEY).agg(F.max("attempt").alias("attempts"), F.bool_or("ok").alias("done"), F.max_by("error", "attempt").alias("error"))
    return rows.where(~F.col("done") & (F.col("attempts") >= attempts)).drop("done")
