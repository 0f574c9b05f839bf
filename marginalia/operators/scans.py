"""Running sums over long runs: a run's steps are summed in ranges of their numbers, and the ranges' sums carried over.

No task holds a run. A range is reduced to one row (what stands at its end since its last
reset, and whether it has one); these rows alone are scanned in order, one for ``span``
step numbers; each range then adds what was carried to it to its rows before the first reset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65_536


def running_sums(steps: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column], reset: Column | None = None, span: int = SPAN) -> DataFrame:
    """``steps`` with the sums of ``sums`` over a run's steps so far, this one included, since the last step for which ``reset`` holds (that step included).

    ``keys`` may be null; a run's integer ``order`` has no null and no ties, and about as many
    values as rows (for others choose ``span`` so that a range of it fits a task). Null values add
    nothing, a null ``reset`` is none. Rows and the sums of ranges are shuffled alike,
    so steps are moved once.
    """
    resets = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    values = {f"__v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    ranged = steps.select("*", F.struct(F.lit(0), *keys).alias("__run"), F.floor(F.col(order) / span).alias("__range"), resets.alias("__reset"), *(c.alias(n) for n, c in values.items()))
    place = Window.partitionBy("__run", "__range").orderBy(order)
    parted = ranged.withColumn("__part", F.count_if("__reset").over(place))
    inside = Window.partitionBy("__run", "__range", "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.withColumns({f"__s_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    carried = _carried(summed, order, list(sums))
    both = summed.join(carried.hint("shuffle_merge"), ["__run", "__range"])
    untouched = F.col("__part") == 0
    return both.select(*steps.columns, *((F.col(f"__s_{n}") + F.when(untouched, F.col(f"__c_{n}")).otherwise(0)).alias(n) for n in sums))


def _carried(summed: DataFrame, order: str, names: Sequence[str]) -> DataFrame:
    """(__run, __range, __c_NAME): what the ranges before leave to a range."""
    ends = summed.groupBy("__run", "__range").agg(F.max("__part").alias("__parts"), *(F.max_by(f"__s_{n}", order).alias(f"__s_{n}") for n in names))
    marked = ends.withColumn("__since", F.count_if(F.col("__parts") > 0).over(Window.partitionBy("__run").orderBy("__range")))
    upto = Window.partitionBy("__run", "__since").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    left = marked.withColumns({f"__s_{n}": F.sum(f"__s_{n}").over(upto) for n in names})
    before = Window.partitionBy("__run").orderBy("__range")
    return left.select("__run", "__range", *(F.coalesce(F.lag(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in names))


def running_accuracy(steps: DataFrame, keys: Sequence[str], order: str, right: Column, span: int = SPAN) -> DataFrame:
    """``steps`` with ``running``: the share of steps so far that are ``right``, to 6 places; unknown ones (null) count for neither, and before the first known one the share is null."""
    sums = running_sums(steps, keys, order, {"__right": right.cast("long"), "__known": right.isNotNull().cast("long")}, span=span)
    return sums.withColumn("running", F.round(F.col("__right") / F.nullif(F.col("__known"), F.lit(0)), 6)).drop("__right", "__known")


def no_update_streak(steps: DataFrame, keys: Sequence[str], order: str, updated: Column, span: int = SPAN) -> DataFrame:
    """``steps`` with ``streak``: steps in a row without an update, up to and with this one; a null is none."""
    return running_sums(steps, keys, order, {"streak": F.when(updated, 0).otherwise(1).cast("long")}, updated, span)
