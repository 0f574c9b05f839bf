"""Statistics over facts. All are grouped sums, so partial aggregation runs before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE = ("code_idx", "code_name")


def r6(value: Column) -> Column:
    """Six places, as sums of doubles depend on their order; never minus zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def code_counts(facts: DataFrame, by: Sequence[str] = ("comparison",)) -> DataFrame:
    """Traces that hold a code, by code and model."""
    return facts.groupBy(*by, *CODE, "model").agg(F.count_if(F.col("cnt") > 0).alias("n"))


def code_stats(facts: DataFrame, by: Sequence[str] = ("comparison",)) -> DataFrame:
    """Counts of both sides and the first one's share (0.5 without any)."""
    sums = facts.groupBy(*by, *CODE).agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("cnt"))), F.lit(0)).alias(f"c{s}") for s in (0, 1)))
    total = F.col("c0") + F.col("c1")
    return sums.withColumn("total", total).withColumn("ratio", F.when(F.col("total") == 0, 0.5).otherwise(r6(F.col("c0") / F.col("total"))))


def vectors(facts: DataFrame, presence: bool = False, keys: Sequence[str] = ("comparison", "question_id", "side", "doc_id")) -> DataFrame:
    """One array a trace, in order of the taxonomy; 0/1 with ``presence``."""
    value = (F.col("cnt") > 0).cast("long") if presence else F.col("cnt")
    return facts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code_idx", value.alias("v")))).alias("__v")).select(*keys, F.col("__v.v").alias("v"))


def code_usage(facts: DataFrame, by: Sequence[str] = ("comparison",)) -> DataFrame:
    """Traces that were annotated while the code existed."""
    return facts.groupBy(*by, *CODE).agg(F.count("cnt").alias("usage"))


def centroids(facts: DataFrame, by: Sequence[str] = ("comparison", "side")) -> DataFrame:
    return facts.groupBy(*by, *CODE).agg(F.avg("cnt").alias("mean"))


def weighted_centroids(facts: DataFrame) -> DataFrame:
    """Centroids, each dimension times its usage."""
    usage = code_usage(facts).drop("code_name")
    return centroids(facts).join(usage.hint("shuffle_merge"), ["comparison", "code_idx"]).withColumn("weighted", F.col("mean") * F.col("usage"))


def outcome(first_ok: Column, second_ok: Column) -> Column:
    return F.when(first_ok & second_ok, "correct").when(second_ok, "Model A wrong").when(first_ok, "Model B wrong").otherwise("Both wrong")


def accuracy(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, n_correct and accuracy in percent of ``outcomes(outcome, ...)``."""
    right = (F.col("outcome") == "correct").cast("long")
    return outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.sum(right).alias("n_correct"), r6(F.avg(right) * 100).alias("accuracy"))


def rolled_accuracy(outcomes: DataFrame, by: str = "comparison") -> DataFrame:
    """Accuracy by source and over all (source null)."""
    right = (F.col("outcome") == "correct").cast("long")
    return outcomes.rollup(by).agg(F.count("*").alias("n"), r6(F.avg(right) * 100).alias("accuracy"))


def vector_summary(facts: DataFrame, by: Sequence[str] = ("comparison",)) -> DataFrame:
    return facts.groupBy(*by, *CODE).agg(
        F.count("cnt").alias("n"), F.count_distinct("model").alias("models"), r6(F.avg("cnt")).alias("mean"), r6(F.stddev_pop("cnt")).alias("std"), F.min("cnt").alias("low"), F.max("cnt").alias("high")
    )


def imputation_summary(facts: DataFrame) -> DataFrame:
    cells = facts.groupBy("model").agg(F.count_distinct("doc_id").alias("vectors"), F.count("*").alias("cells"), F.count_if(F.col("cnt").isNull()).alias("missing"))
    return cells.withColumn("percent", r6(F.col("missing") * 100 / F.col("cells")))


# ---- reruns -----------------------------------------------------------------


def rerun_mean(runs: DataFrame) -> DataFrame:
    return runs.groupBy("sample_id", "model", "code").agg(F.avg("cnt").alias("mean"), F.var_pop("cnt").alias("var"), F.count("*").alias("n_runs"))


def rerun_variability(runs: DataFrame, pool_models: bool = False) -> DataFrame:
    """Per code, how much its count differs between runs of a sample: relative deviation where the mean is over 0.1, else the variance."""
    keys = ["sample_id", "code"] if pool_models else ["sample_id", "model", "code"]
    each = runs.groupBy(*keys).agg(F.avg("cnt").alias("mean"), F.var_pop("cnt").alias("var"), F.count("*").alias("n_runs")).where("n_runs > 1")
    value = F.when(F.col("mean") > 0.1, F.sqrt("var") / (F.col("mean") + 1e-8)).otherwise(F.col("var"))
    return each.groupBy("code").agg(F.avg(value).alias("variability"))


def reject_inconsistent(variability: DataFrame, percentile: float | None = None, threshold: float | None = None) -> DataFrame:
    """Codes to remove: at or above a percentile (linear) of the variability, or a threshold. One row a code, so the limit is one row."""
    if percentile is None:
        return variability.where(F.col("variability") >= threshold)
    limit = variability.agg(F.expr(f"percentile(variability, {percentile / 100})").alias("limit"))
    return variability.crossJoin(F.broadcast(limit)).where(F.col("variability") >= F.col("limit")).drop("limit")


def run_accuracy_stats(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and range of the accuracies of runs."""
    right = (F.col("outcome") == "correct").cast("double")
    per_run = outcomes.groupBy(*by, "run").agg((F.avg(right) * 100).alias("a"))
    return per_run.groupBy(*by).agg(F.count("*").alias("n_runs"), r6(F.avg("a")).alias("mean"), r6(F.stddev_pop("a")).alias("std"), r6(F.min("a")).alias("low"), r6(F.max("a")).alias("high"))


# ---- feature scores; rows (dim, label, x) ---------------------------------


def _class_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dim", "label").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.abs("x")).alias("sa"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def score_chi2(rows: DataFrame) -> DataFrame:
    """Chi-squared of the sums of absolute values by class against the class shares."""
    whole = Window.partitionBy("dim")
    expected = F.sum("sa").over(whole) * F.col("n") / F.sum("n").over(whole)
    cells = _class_sums(rows).withColumn("e", expected)
    return cells.groupBy("dim").agg(F.sum((F.col("sa") - F.col("e")) ** 2 / F.nullif(F.col("e"), F.lit(0.0))).alias("score"))


def score_anova_f(rows: DataFrame) -> DataFrame:
    """One-way F from sums and sums of squares by class."""
    sums = _class_sums(rows).groupBy("dim").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    between = F.col("between") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("between")
    return sums.select("dim", ((between / (F.col("k") - 1)) / F.nullif(within / (F.col("n") - F.col("k")), F.lit(0.0))).alias("score"))


def score_mutual_info(rows: DataFrame) -> DataFrame:
    """Exact plug-in mutual information of discrete values and classes, in nats."""
    cells = rows.groupBy("dim", "x", "label").agg(F.count("*").alias("n"))
    of = {k: F.sum("n").over(Window.partitionBy("dim", *k)) for k in ((), ("x",), ("label",))}
    p = cells.select("dim", "n", of[()].alias("all"), of[("x",)].alias("nx"), of[("label",)].alias("ny"))
    return p.groupBy("dim").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("score"))


def score_variance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dim").agg(F.var_pop("x").alias("score"))


def top_k_by_score(scores: DataFrame, k: int, by: Sequence[str] = (), order: str = "dim") -> DataFrame:
    """The k best, ties by ``order``; a missing score counts as 0. Scores have a row for each dimension."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def select_percentile(scores: DataFrame, percent: float) -> DataFrame:
    """Dimensions at or above the (100 - percent)-th percentile of the scores."""
    limit = scores.agg(F.expr(f"percentile(score, {1 - percent / 100})").alias("limit"))
    return scores.crossJoin(F.broadcast(limit)).where(F.col("score") >= F.col("limit")).drop("limit")


# ---- pruning ----------------------------------------------------------------


def top_k_codes(stats: DataFrame, k: int) -> DataFrame:
    """The k codes of each comparison that tell its models apart best: |share - 0.5| * total."""
    scored = stats.withColumn("score", r6(F.when(F.col("total") == 0, 0.0).otherwise(F.abs(F.col("c0") / F.col("total") - 0.5) * F.col("total"))))
    return top_k_by_score(scored, k, ["comparison"], "code_idx").drop("rank")


def win_ratio(facts: DataFrame, eps: float = 0.1, least_pairs: int = 5) -> DataFrame:
    """Per code over the pairs of a comparison: how often either model has more; codes near 0.5 with enough pairs are not distinguishing."""
    two = facts.groupBy("comparison", "question_id", *CODE).agg(*(F.max(F.when(F.col("side") == s, F.col("cnt"))).alias(f"x{s}") for s in (0, 1))).where("x0 IS NOT NULL AND x1 IS NOT NULL")
    sums = two.groupBy("comparison", *CODE).agg(F.count("*").alias("pairs"), F.count_if(F.col("x0") > F.col("x1")).alias("wins0"), F.count_if(F.col("x0") < F.col("x1")).alias("wins1"))
    ratio = F.col("wins0") / F.col("pairs")
    return sums.withColumns({"ties": F.col("pairs") - F.col("wins0") - F.col("wins1"), "ratio": r6(ratio), "keep": ~((F.abs(ratio - 0.5) < eps) & (F.col("pairs") >= least_pairs))})


def prune_frequency(stats: DataFrame, least: int, eps: float, inclusive_min: bool = False) -> DataFrame:
    """Codes that stay: rare ones and those whose share isn't within 0.5 +- eps."""
    often = F.col("total") >= least if inclusive_min else F.col("total") > least
    share = F.when(F.col("total") == 0, 0.5).otherwise(F.col("c0") / F.col("total"))
    return stats.where(~(often & (share > 0.5 - eps) & (share < 0.5 + eps)))


def filter_equal(stats: DataFrame, points: float) -> DataFrame:
    """Codes with ``equal``: neither model has it, or both do and the shares are within 50 +- points percent."""
    percent = F.col("c0") * 100 / F.col("total")
    equal = F.when((F.col("c0") == 0) & (F.col("c1") == 0), True).when((F.col("c0") == 0) | (F.col("c1") == 0), False).otherwise(F.abs(percent - 50) <= points)
    return stats.withColumn("equal", equal)


def merged_counts(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Traces by model that hold any code of a group; ``groups(code_name, merged)`` has a row a code, other codes stay alone."""
    named = facts.join(F.broadcast(groups), "code_name", "left").withColumn("merged", F.coalesce("merged", "code_name"))
    held = named.groupBy("comparison", "model", "doc_id", "merged").agg(F.max(F.col("cnt") > 0).alias("present"))
    return held.groupBy("comparison", "model", "merged").agg(F.count_if("present").alias("n"))


# ---- behaviour and correctness ----------------------------------------------


def code_correctness(facts: DataFrame, status: DataFrame) -> DataFrame:
    """Per code over all graded traces: Pearson r of holding it and being correct, Jaccard, and percent correct among its holders."""
    graded = facts.join(status.hint("shuffle_merge"), "doc_id").select(*CODE, (F.col("cnt") > 0).cast("int").alias("x"), (F.col("status") == "correct").cast("int").alias("y"))
    both, either = F.sum(F.col("x") * F.col("y")), F.sum(F.greatest("x", "y"))
    return graded.groupBy(*CODE).agg(F.count("*").alias("n"), F.sum("x").alias("held"), r6(F.corr("x", "y")).alias("correlation"), r6(both / F.nullif(either, F.lit(0))).alias("jaccard"), r6(both * 100 / F.nullif(F.sum("x"), F.lit(0))).alias("percent"))


def held_ids(facts: DataFrame) -> DataFrame:
    """(model, code_name, question_id): a row for each trace that holds a code, as many as there are."""
    return facts.where("cnt > 0").select("model", "code_name", "question_id")


def ids_by_model_rule(facts: DataFrame) -> DataFrame:
    """All ids of a model and code in one array, for taxonomies of few traces; ``held_ids`` has no such bound."""
    return facts.where("cnt > 0").groupBy("model", "code_name").agg(F.array_sort(F.collect_list("question_id")).alias("ids"))


def dimension_means(facts: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Both sides' means of chosen codes, and mean and deviation of both together."""
    sides = [r6(F.avg(F.when(F.col("side") == s, F.col("cnt")))).alias(f"mean{s}") for s in (0, 1)]
    return facts.where(F.col("code_name").isin(*codes)).groupBy("comparison", *CODE).agg(*sides, r6(F.avg("cnt")).alias("mean"), r6(F.stddev_pop("cnt")).alias("std"))


def rate_matrix(rates: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row a dataset, a column a model with full plus partial rate, 0 where missing, and their sum."""
    grid = rates.groupBy("dataset").pivot("model", list(models)).agg(F.first(F.col("full_rate") + F.col("partial_rate"))).na.fill(0)
    total = reduce(lambda a, b: a + b, (F.col(f"`{m}`") for m in models))
    return grid.withColumn("total", total)
