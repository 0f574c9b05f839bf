"""Readers and writers of traces, tasks, prompts, run state and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as fx

from .scratch import saved

PROMPT_SCHEMA = T.StructType(
    [
        T.StructField("data_source", T.StringType()),
        T.StructField("prompt", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("ability", T.StringType()),
        T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()), T.StructField("ground_truth", T.StringType())])),
        T.StructField("extra_info", T.StructType([T.StructField("split", T.StringType()), T.StructField("index", T.LongType()), T.StructField("format", T.StringType())])),
    ]
)


def scan_traces(spark: SparkSession, base: str, files: str = "*/*.txt") -> DataFrame:
    """(model, question_id, question, thinking, answer) of a folder with one folder a model and one text file a question.

    Files of other kinds, raw outputs and empty ones are left out, and those without a question id.
    ``files`` says how they lie under ``base``: the first folder is the model's, the name
    may be a folder's too, and ``key=`` before a name (a partitioned table) is no part of it.
    Tasks list the files (``trace_source``): the driver lists the folders of models only.
    """
    from .trace_source import register

    register(spark)
    return parse_traces(spark.read.format("traces").option("files", files).load(base).where("value <> ''"))


def parse_traces(rows: DataFrame, value: str = "value") -> DataFrame:
    """The three sections of each text, with the fallbacks for a missing thinking."""
    thinking = fx.strip_think_tags(fx.cut_choices_order(fx.section(F.col(value), "THINKING")))
    answer = fx.strip_think_tags(fx.cut_choices_order(fx.section(F.col(value), "ANSWER")))
    thinking, answer = fx.thinking_fallback(thinking, answer)
    return rows.select(*(c for c in rows.columns if c != value), fx.section(F.col(value), "QUESTION").alias("question"), thinking.alias("thinking"), answer.alias("answer"))


def scan_json_tasks(spark: SparkSession, folder: str, schema: str, files: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(tasks by file stem, unreadable files): a JSON object a file. In a table partitioned by task, the folder has the name."""
    parsed = spark.read.schema(f"{schema}, _corrupt_record string").json(f"{folder}/{files}", multiLine=True, mode="PERMISSIVE")
    pattern = r"/task=([^/]+)/[^/]+$" if "task=" in files else r"([^/]+)\.json$"
    read = saved(parsed.withColumn("task", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)), "tasks")
    return read.where("_corrupt_record IS NULL").drop("_corrupt_record"), read.where("_corrupt_record IS NOT NULL").select("task", "_corrupt_record")


def scan_benchmark(spark: SparkSession, registry: DataFrame, name: str) -> DataFrame:
    """The question set that ``registry(name, path)`` knows by a name; one row reaches the driver."""
    found = registry.where(F.col("name") == name).select("path").first()
    if found is None:
        raise ValueError(f"unknown benchmark: {name}")
    return spark.read.parquet(found["path"])


def with_choice_orders(traces: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Traces with the order in which their choices were shown, a written side table by (question, model folder)."""
    return traces.join(orders.select(*keys, "choice_order"), keys, "left")


def scan_experiment_stats(spark: SparkSession, base: str, ignore: tuple[str, ...] = (), files: str = "*_intervention_experiment/*/*.txt") -> DataFrame:
    """(dataset, model, full_rate, partial_rate) of folders ``DATASET_intervention_experiment/MODEL``; ``key=`` before a name is no part of it."""
    found = spark.read.text(f"{base}/{files}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    pattern = r"/(?:[^/=]+=)?([^/=]+)_intervention_experiment/(?:[^/=]+=)?([^/]+)/[^/]+$"
    rows = found.select(F.regexp_extract("path", pattern, 1).alias("dataset"), F.regexp_extract("path", pattern, 2).alias("model"), fx.parse_stats(F.col("value")).alias("r"))
    return rows.where(~F.col("model").isin(*ignore) if ignore else F.lit(True)).select("dataset", "model", "r.full_rate", "r.partial_rate")


def sink_traces(traces: DataFrame, path: str) -> None:
    """Traces by dataset and model, so that a reader of one model reads only its files."""
    traces.write.partitionBy("dataset", "model").mode("append").parquet(path)


def prompt_records(questions: DataFrame, data_source: str, ability: str, style: str = "rule", form: str = "default") -> DataFrame:
    """Prompt records of ``questions(idx, question, gold, split)``."""
    message = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    return questions.select(
        F.lit(data_source).alias("data_source"),
        F.array(message).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), F.col("gold").cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("split"), F.col("idx").cast("long").alias("index"), F.lit(form).alias("format")).alias("extra_info"),
    )


def with_split_label(prompts: DataFrame, split: str) -> DataFrame:
    return prompts.withColumn("extra_info", F.col("extra_info").withField("split", F.lit(split)))


def sink_prompts(prompts: DataFrame, path: str) -> None:
    prompts.withColumn("split", F.col("extra_info.split")).write.partitionBy("split").mode("append").parquet(path)


def resume(samples: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Samples that a run's written annotations don't have yet."""
    return samples.join(done.select(*keys).distinct(), keys, "left_anti")


def sink_summary(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def sink_judgements(outcomes: DataFrame, path: str) -> None:
    """Prompt and annotation of samples that were classified correctly."""
    outcomes.where("outcome = 'correct'").write.mode("append").parquet(path)
