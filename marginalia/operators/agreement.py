"""Annotator agreement between runs: Fleiss, Cohen, exact, tolerant and weighted kappa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratings(runs: DataFrame) -> DataFrame:
    """(sample_id, run, code, rating): the mean of both models' counts in a run."""
    return runs.groupBy("sample_id", "run", "code").agg(F.avg("cnt").alias("rating"))


def _fleiss(rated: DataFrame, category: Column) -> DataFrame:
    """Fleiss' kappa per code for items with two runs or more; null where chance agreement is certain."""
    cells = rated.withColumn("category", category).groupBy("code", "sample_id", "category").agg(F.count("*").alias("n"))
    items = cells.groupBy("code", "sample_id").agg(F.sum("n").alias("raters"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("raters > 1")
    observed = items.groupBy("code").agg(F.avg((F.col("squares") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("p"), F.count("*").alias("items"))
    used = cells.join(items.select("code", "sample_id").hint("shuffle_merge"), ["code", "sample_id"]).groupBy("code", "category").agg(F.sum("n").alias("n"))
    share = used.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("code")))
    chance = share.groupBy("code").agg(F.sum(F.col("share") * F.col("share")).alias("pe"))
    return observed.join(chance.hint("shuffle_merge"), "code").select("code", "items", F.when(F.col("pe") < 1 - 1e-12, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss_kappa_binary(runs: DataFrame, threshold: float = 0.0) -> DataFrame:
    return _fleiss(ratings(runs), (F.col("rating") > threshold).cast("int"))


def kappa_exact(runs: DataFrame) -> DataFrame:
    """A category for each distinct rating."""
    return _fleiss(ratings(runs), F.col("rating"))


def kappa_tolerance(runs: DataFrame, tolerance: int = 1) -> DataFrame:
    """Ratings in bands of 2 * tolerance + 1."""
    return _fleiss(ratings(runs), F.floor(F.col("rating") / (2 * tolerance + 1)))


def kappa_summary(kappas: DataFrame) -> DataFrame:
    quarter = lambda p: F.round(F.expr(f"percentile(kappa, {p})"), 6)
    return kappas.agg(F.count("kappa").alias("codes"), F.round(F.avg("kappa"), 6).alias("mean"), F.round(F.stddev_pop("kappa"), 6).alias("std"), F.round(F.min("kappa"), 6).alias("low"), F.round(F.max("kappa"), 6).alias("high"), quarter(0.25).alias("q25"), quarter(0.75).alias("q75"))


def _run_pairs(runs: DataFrame) -> DataFrame:
    """(code, run1, run2, sample_id, a, b): both runs' ratings of the samples they share."""
    rated = ratings(runs)
    one = rated.select("code", "sample_id", F.col("run").alias("run1"), F.col("rating").alias("a"))
    two = rated.select("code", "sample_id", F.col("run").alias("run2"), F.col("rating").alias("b"))
    return one.join(two.hint("shuffle_merge"), ["code", "sample_id"]).where("run1 < run2")


def cohen_kappa_pairwise(runs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Cohen's kappa of presence for each pair of runs and code with two shared samples or more."""
    x, y = ((F.col(c) > threshold).cast("int") for c in "ab")
    sums = _run_pairs(runs).groupBy("code", "run1", "run2").agg(F.count("*").alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("px"), F.avg(y).alias("py")).where("n >= 2")
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return sums.select("code", "run1", "run2", "n", F.when(pe < 1 - 1e-12, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def kappa_weighted(runs: DataFrame, squared: bool = False) -> DataFrame:
    """Per code, the mean over run pairs of 1 - observed / expected weighted disagreement, weights |i - j| or (i - j)^2.

    The expectation is over all pairs of both runs' rating distributions, which have a row a distinct rating.
    """
    weight = lambda a, b: (a - b) * (a - b) if squared else F.abs(a - b)
    pairs = _run_pairs(runs)
    keys = ["code", "run1", "run2"]
    observed = pairs.groupBy(*keys).agg(F.avg(weight(F.col("a"), F.col("b"))).alias("o"), F.count("*").alias("n")).where("n >= 2")
    one = pairs.groupBy(*keys, "a").agg(F.count("*").alias("na"))
    two = pairs.groupBy(*keys, "b").agg(F.count("*").alias("nb"))
    expected = one.join(two.hint("shuffle_merge"), keys).groupBy(*keys).agg(F.sum(weight(F.col("a"), F.col("b")) * F.col("na") * F.col("nb")).alias("e"))
    each = observed.join(expected.hint("shuffle_merge"), keys).withColumn("kappa", 1 - F.col("o") / F.nullif(F.col("e") / (F.col("n") * F.col("n")), F.lit(0.0)))
    return each.groupBy("code").agg(F.avg("kappa").alias("kappa"))
