"""Missing values and normalisation over long facts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import saved

KEYS = ("comparison", "question_id", "side", "model", "doc_id")


def extend_vectors(facts: DataFrame, codes: DataFrame, fill: float | None) -> DataFrame:
    """Facts with rows for codes that were added later, filled with 0 or NULL."""
    missing = facts.select(*KEYS).distinct().crossJoin(F.broadcast(codes)).join(facts.select("doc_id", "code_idx").hint("shuffle_merge"), ["doc_id", "code_idx"], "left_anti")
    return facts.unionByName(missing.withColumn("cnt", F.lit(fill).cast("long")), allowMissingColumns=True)


def impute_simple(facts: DataFrame, method: str = "mean", constant: float = 0.0, rounded: bool = False) -> DataFrame:
    """Facts with ``value``: missing counts by model and code as mean, median, most frequent (smallest of ties) or constant; 0 for a model without any. ``rounded``: half to even."""
    by = ["comparison", "model", "code_idx"]
    if method == "constant":
        filled = facts.withColumn("value", F.coalesce(F.col("cnt").cast("double"), F.lit(float(constant))))
    else:
        if method == "most_frequent":
            common = facts.where("cnt IS NOT NULL").groupBy(*by, "cnt").agg(F.count("*").alias("n"))
            fill = common.groupBy(*by).agg(F.min_by("cnt", F.struct(-F.col("n"), "cnt")).cast("double").alias("fill"))
        elif method in ("mean", "median"):
            fill = facts.groupBy(*by).agg((F.avg("cnt") if method == "mean" else F.expr("percentile(cnt, 0.5)")).alias("fill"))
        else:
            raise ValueError(f"unknown imputation: {method}")
        known = facts.join(F.broadcast(fill), by, "left")  # a row a model and code of the taxonomy
        filled = known.withColumn("value", F.coalesce(F.col("cnt").cast("double"), "fill", F.lit(0.0))).drop("fill")
    return filled.withColumn("value", F.bround("value")) if rounded else filled


def impute_knn(facts: DataFrame, k: int = 10) -> DataFrame:
    """Facts with ``value``: a missing count is the mean of the k nearest traces of its model that have the code.

    Distance is Euclidean over shared codes, scaled by all / shared; ties go to the smaller
    id. Equal vectors are one: only distinct vectors look for neighbours, and a donor vector
    stands for its k smallest ids. Targets and donors are parted by the codes that they have:
    for two such patterns the shared codes are the same throughout, so the k nearest are
    found by ``pivot_neighbours`` on these alone, and the patterns' results are ranked once more.
    """
    from .neighbours import pivot_neighbours

    by = ["comparison", "model"]
    facts = saved(facts, "facts")  # read several times; texts are counted once
    width = facts.agg(F.count_distinct("code_idx").alias("width"))
    traces = saved(facts.groupBy(*by, "doc_id").agg(F.array_sort(F.collect_list(F.struct("code_idx", "cnt"))).alias("v")), "vectors")
    had = F.transform(F.filter("v", lambda x: x["cnt"].isNotNull()), lambda x: x["code_idx"])
    nth = F.row_number().over(Window.partitionBy(*by, "v").orderBy("doc_id"))
    few = traces.withColumn("nth", nth).where(F.col("nth") <= k)
    donors = saved(few.groupBy(*by, "v").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).withColumns({"had": had, "id": F.col("ids")[0]}), "donors")
    targets = donors.where(F.size("had") < F.size("v"))
    patterns = lambda df, name: df.select(*by, F.col("had").alias(name)).distinct()
    met = patterns(targets, "target").join(patterns(donors, "donor").hint("shuffle_merge"), by)  # a row two patterns
    shared = saved(met.withColumn("shared", F.array_intersect("target", "donor")).where((F.size("shared") > 0) & (F.size(F.array_except("donor", "target")) > 0)), "patterns")
    entry = F.map_from_entries("v")
    keys = (*by, "target", "donor")

    def shown(df: DataFrame, pattern: str) -> DataFrame:
        other = "donor" if pattern == "target" else "target"
        both = df.withColumnRenamed("had", pattern).join(shared.hint("shuffle_merge"), [*by, pattern])
        return both.withColumn("entry", entry).select(*by, pattern, other, "id", F.transform("shared", lambda c: F.col("entry")[c].cast("double")).alias("v"), F.size("shared").alias("label"))

    near = pivot_neighbours(shown(targets, "target").drop("label"), shown(donors, "donor"), k, keys)
    found = near.select(*by, F.col("query").alias("target_id"), F.col("neighbour").alias("id"), F.round(F.col("distance") * F.col("distance")).alias("squares"), F.col("label").alias("n_shared"))
    scaled = found.crossJoin(F.broadcast(width)).withColumn("distance", F.sqrt(F.col("squares") * F.col("width") / F.col("n_shared")))  # one row
    gaps = saved(targets.select(*by, F.col("id").alias("target_id"), F.explode(F.filter("v", lambda x: x["cnt"].isNull())).alias("gap")).select(*by, "target_id", F.col("gap.code_idx").alias("code_idx")), "gaps")
    offered = scaled.join(donors.select(*by, "id", "ids", entry.alias("entry")).hint("shuffle_merge"), [*by, "id"]).join(gaps.hint("shuffle_merge"), [*by, "target_id"])
    offers = offered.withColumn("y", F.col("entry")[F.col("code_idx")]).where(F.col("y").isNotNull())
    rank = lambda *order: F.row_number().over(Window.partitionBy(*by, "target_id", "code_idx").orderBy(*order))
    nearest = offers.withColumn("rank", rank("distance", "id")).where(F.col("rank") <= k)
    single = nearest.withColumn("donor_id", F.explode("ids")).withColumn("rank", rank("distance", "donor_id")).where(F.col("rank") <= k)
    means = single.groupBy(*by, "target_id", "code_idx").agg(F.avg("y").alias("fill"))
    fills = saved(means.join(targets.select(*by, F.col("id").alias("target_id"), "v").hint("shuffle_merge"), [*by, "target_id"]).drop("target_id"), "fills")
    columns = impute_simple(facts, "mean").withColumnRenamed("value", "by_column")
    filled = columns.join(traces.select("doc_id", "v").hint("shuffle_merge"), "doc_id").join(fills.hint("shuffle_merge"), [*by, "v", "code_idx"], "left")
    return filled.withColumn("value", F.coalesce(F.col("cnt").cast("double"), "fill", "by_column")).drop("fill", "by_column", "v")


def impute_iterative(facts: DataFrame, rounds: int = 10, ridge: float = 1e-3) -> DataFrame:
    """Facts with ``value``: in each round each incomplete code of a comparison's model is regressed on the others in turn (ridge on covariances), from column means.

    An imputed value is a linear function of its trace's observed ones, the same for all
    traces that lack the same codes. So traces are read once: tasks add up the moments of
    each pattern of missing codes, and all rounds are worked out on these small matrices, by
    comparison and model in Spark. A pattern's map then fills its traces. Patterns come
    from the taxonomy's versions, so there are about as many as versions.
    """
    start = impute_simple(facts, "mean")
    cells = F.array_sort(F.collect_list(F.struct("code_idx", F.col("cnt").isNull().alias("missing"), "value")))
    wide = start.groupBy(*KEYS).agg(cells.alias("cells")).select(*KEYS, F.col("cells.code_idx").alias("codes"), F.col("cells.missing").alias("missing"), F.col("cells.value").alias("v"))
    wide = saved(wide, "wide")
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    key = f"comparison {kinds['comparison']}, model {kinds['model']}, codes {kinds['codes']}, missing {kinds['missing']}"
    moments = wide.select("comparison", "model", "codes", "missing", "v").mapInPandas(_moments, f"{key}, moments array<double>")
    maps = saved(moments.groupBy("comparison", "model").applyInPandas(lambda rows: _pattern_maps(rows, rounds, ridge), f"{key}, maps array<array<double>>"), "pattern-maps")  # a row a task and pattern
    met = wide.join(maps.hint("shuffle_merge"), ["comparison", "model", "codes", "missing"], "left")
    fill = lambda m: F.aggregate(F.zip_with(F.slice(m, 2, F.size("v")), F.col("v"), lambda w, x: w * x), m[0], lambda s, x: s + x)
    values = F.when(F.col("maps").isNull(), F.col("v")).otherwise(F.transform("maps", fill))
    pairs = met.select(*KEYS, F.explode(F.arrays_zip("codes", "missing", "v", values.alias("value"))).alias("p"))
    return pairs.select(*KEYS, F.col("p.codes").alias("code_idx"), F.when(F.col("p.missing"), F.col("p.value")).otherwise(F.col("p.v")).alias("value"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of (1, v) (1, v)' of a task's traces, by comparison, model and pattern."""
    held: dict[tuple, np.ndarray] = {}
    for rows in batches:
        patterns = [rows[c].map(tuple) for c in ("codes", "missing")]
        for pattern, part in rows.groupby(["comparison", "model", *patterns], dropna=False):
            x = np.column_stack([np.ones(len(part)), np.stack(part["v"].tolist())])
            held[pattern] = held.get(pattern, 0) + x.T @ x
    yield pd.DataFrame([(c, m, list(codes), list(missing), x.ravel()) for (c, m, codes, missing), x in held.items()], columns=["comparison", "model", "codes", "missing", "moments"])


def _pattern_maps(rows: pd.DataFrame, rounds: int, ridge: float) -> pd.DataFrame:
    """For each pattern of a comparison's model the map from (1, v) as it was at the start to the values after all rounds."""
    moments: dict[tuple, np.ndarray] = {}
    for codes, missing, x in zip(rows["codes"], rows["missing"], rows["moments"], strict=True):
        size = len(codes) + 1
        at = tuple(codes), tuple(map(bool, missing))
        moments[at] = moments.get(at, 0) + np.asarray(x, float).reshape(size, size)
    maps = {at: np.eye(len(at[0]) + 1) for at in moments}
    for codes in {c for c, _ in moments}:
        mine = [at for at in moments if at[0] == codes]
        incomplete = [i for i in range(len(codes)) if any(at[1][i] for at in mine)]
        for _ in range(rounds):
            for i in incomplete:
                known = sum((moments[at] for at in mine if not at[1][i]), np.zeros((len(codes) + 1,) * 2))
                if known[0, 0] == 0:
                    continue
                step = _regression(known / known[0, 0], i + 1, ridge)
                for at in mine:
                    if at[1][i]:
                        change = np.eye(len(codes) + 1)
                        change[i + 1] = step
                        moments[at] = change @ moments[at] @ change.T
                        maps[at] = change @ maps[at]
    first = rows.iloc[0]
    return pd.DataFrame([(first["comparison"], first["model"], list(at[0]), list(at[1]), list(m[1:])) for at, m in maps.items()], columns=["comparison", "model", "codes", "missing", "maps"])


def _regression(moments: np.ndarray, i: int, ridge: float) -> np.ndarray:
    """The intercept and weights (0 at ``i``) that give the i-th from the others, from mean moments of (1, v)."""
    others = [j for j in range(1, len(moments)) if j != i]
    means = moments[0]
    covariances = moments - np.outer(means, means)
    w = np.linalg.solve(covariances[np.ix_(others, others)] + ridge * np.eye(len(others)), covariances[others, i])
    out = np.zeros(len(moments))
    out[others], out[0] = w, means[i] - w @ means[others]
    return out


IMPUTERS = {"mean": lambda f: impute_simple(f, "mean"), "median": lambda f: impute_simple(f, "median"), "most_frequent": lambda f: impute_simple(f, "most_frequent"), "constant": lambda f: impute_simple(f, "constant"), "knn": impute_knn, "iterative": impute_iterative}


def normalize(facts: DataFrame, p: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Facts with ``value``: the count over its trace's L1 or L2 norm; a zero vector stays."""
    whole = Window.partitionBy(*keys)
    norm = F.sum(F.abs("cnt")).over(whole) if p == 1 else F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(whole))
    return facts.withColumn("value", F.coalesce(F.col("cnt") / F.nullif(norm, norm - norm), F.lit(0.0)))


def normalize_comparative(facts: DataFrame) -> DataFrame:
    """Facts with ``value``: a trace's share of both traces' counts of a code, 0 when they have none; a trace without a partner is unchanged."""
    pair = Window.partitionBy("comparison", "question_id", "code_idx")
    total = F.sum("cnt").over(pair)
    shared = F.when(total > 0, F.col("cnt") / total).otherwise(0.0)
    return facts.withColumn("value", F.when(F.count("*").over(pair) == 2, shared).otherwise(F.col("cnt").cast("double")))


NORMALIZERS = {"l1": lambda f: normalize(f, 1), "l2": lambda f: normalize(f, 2), "comparative": normalize_comparative}


def chosen(registry: dict, name: str):
    """The function of a name; an unknown name is an error, never a silent default."""
    if name not in registry:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]
