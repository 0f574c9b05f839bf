"""Orders of behaviours: transitions, their means by model, and a classifier on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("sample_id", "model")


def reindex(rows: DataFrame, codes: DataFrame, old: str = "code_idx") -> DataFrame:
    """Old code indexes to those of a new taxonomy (``codes``, some dozens of rows), joined by name; codes that are gone drop out."""
    return rows.drop(old).join(F.broadcast(codes.select("code_name", "code_idx")), "code_name")


def transitions(seq: DataFrame) -> DataFrame:
    """(sample_id, model, pos, code, next): the last of a sequence has none."""
    return seq.withColumn("next", F.lead("code").over(Window.partitionBy(*KEYS).orderBy("pos")))


def transition_rates(seq: DataFrame) -> DataFrame:
    """(sample_id, model, code, next, p): each sample's transitions, rows sum to 1."""
    counts = transitions(seq).where("next IS NOT NULL").groupBy(*KEYS, "code", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS, "code"))).drop("n")


def transition_means(seq: DataFrame) -> DataFrame:
    """(model, code, next, p): means over all samples of a model; a sample without a row counts as zero. The sizes have a row a model."""
    samples = seq.groupBy("model").agg(F.count_distinct("sample_id").alias("samples"))
    sums = transition_rates(seq).groupBy("model", "code", "next").agg(F.sum("p").alias("s"))
    return sums.join(F.broadcast(samples), "model").select("model", "code", "next", (F.col("s") / F.col("samples")).alias("p"))


def transition_distances(seq: DataFrame, means: DataFrame) -> DataFrame:
    """(sample_id, model, to_model, distance): Frobenius distance of each sample to each model's mean.

    The sum over cells of (a - b)^2 is sum(b^2) over the mean plus sum(a^2 - 2ab) over the sample's own cells.
    ``means`` has at most a row for each model and two codes of the taxonomy.
    """
    whole = means.groupBy(F.col("model").alias("to_model")).agg(F.sum(F.col("p") * F.col("p")).alias("mean_ss"))
    cells = means.select(F.col("model").alias("to_model"), "code", "next", F.col("p").alias("q"))
    samples = seq.select(*KEYS).distinct().crossJoin(F.broadcast(whole))
    own = transition_rates(seq).crossJoin(F.broadcast(whole.select("to_model"))).join(F.broadcast(cells), ["to_model", "code", "next"], "left")
    part = own.groupBy(*KEYS, "to_model").agg(F.sum(F.col("p") * F.col("p") - 2 * F.col("p") * F.coalesce("q", F.lit(0.0))).alias("rest"))
    both = samples.join(part.hint("shuffle_merge"), [*KEYS, "to_model"], "left")
    return both.select(*KEYS, "to_model", F.sqrt(F.greatest(F.col("mean_ss") + F.coalesce("rest", F.lit(0.0)), F.lit(0.0))).alias("distance"))


def transition_classifier(distances: DataFrame) -> DataFrame:
    """(sample_id, model, predicted): the nearer mean, the smaller model number on ties."""
    return distances.groupBy(*KEYS).agg(F.min(F.struct(F.round("distance", 9).alias("d"), "to_model")).alias("best")).select(*KEYS, F.col("best.to_model").alias("predicted"))
