"""Which model wrote which output: classifiers over facts, one job for all comparisons.

Each takes training and evaluation facts and gives (comparison, question_id, side,
p0, p1): an output's scores for both models. ``resolve`` turns a pair's scores
into two different models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import saved

from .vectors import chosen

OUTPUT = ("comparison", "question_id", "side")


def is_eval(question_id: Column, seed: int = 7) -> Column:
    """A quarter of the questions, by digest."""
    return F.md5(F.concat(F.lit(f"{seed}:"), question_id.cast("string"))) < "4"


def resolve(scores: DataFrame) -> DataFrame:
    """(comparison, question_id, pred0, pred1, outcome). Both outputs take their better model (model 0 on ties); when it is the same, the output with the strictly higher score for it keeps it, else the other does."""
    sides = [scores.where(F.col("side") == s).select("comparison", "question_id", *(F.col(f"p{m}").alias(f"{x}{m}") for m in (0, 1))) for s, x in enumerate("ab")]
    both = sides[0].join(sides[1].hint("shuffle_merge"), ["comparison", "question_id"])
    best = {x: F.when(F.col(f"{x}0") >= F.col(f"{x}1"), 0).otherwise(1) for x in "ab"}
    of = lambda x: F.when(best["a"] == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1"))
    first = F.when(best["a"] != best["b"], best["a"]).when(of("a") > of("b"), best["a"]).otherwise(1 - best["a"])
    ok = first == 0
    return both.select("comparison", "question_id", first.alias("pred0"), (1 - first).alias("pred1"), F.when(ok, "correct").otherwise("Both wrong").alias("outcome"))


def _model_counts(train: DataFrame) -> DataFrame:
    """(comparison, code_idx, n0, n1, t0, t1): traces of each side that hold a code, and all annotated traces."""
    held = [F.count_if((F.col("side") == s) & (F.col("cnt") > 0)).alias(f"n{s}") for s in (0, 1)]
    every = [F.count_if((F.col("side") == s) & F.col("cnt").isNotNull()).alias(f"t{s}") for s in (0, 1)]
    return train.groupBy("comparison", "code_idx").agg(*held, *every)


def _with(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.where("cnt IS NOT NULL").join(F.broadcast(_model_counts(train)), ["comparison", "code_idx"])  # a row a comparison and code


def vote_soft(train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean over codes of P(model | code) where present, else of 1 - P."""
    p0 = F.coalesce(F.col("n0") / F.nullif(F.col("n0") + F.col("n1"), F.lit(0)), F.lit(0.5))
    mine = F.when(F.col("cnt") > 0, p0).otherwise(1 - p0)
    return _with(train, test).groupBy(*OUTPUT).agg(F.avg(mine).alias("p0")).withColumn("p1", 1 - F.col("p0"))


def vote_soft_bernoulli(train: DataFrame, test: DataFrame) -> DataFrame:
    """Normalised product over codes of P(code | model) or its complement, clipped to [1e-10, 1 - 1e-10]."""
    logs = []
    for s in (0, 1):
        p = F.least(F.greatest(F.coalesce(F.col(f"n{s}") / F.nullif(F.col(f"t{s}"), F.lit(0)), F.lit(0.0)), F.lit(1e-10)), F.lit(1 - 1e-10))
        logs.append(F.sum(F.ln(F.when(F.col("cnt") > 0, p).otherwise(1 - p))).alias(f"l{s}"))
    sums = _with(train, test).groupBy(*OUTPUT).agg(*logs)
    return sums.select(*OUTPUT, (1 / (1 + F.exp(F.col("l1") - F.col("l0")))).alias("p0"), (1 / (1 + F.exp(F.col("l0") - F.col("l1")))).alias("p1"))


def vote_hard(train: DataFrame, test: DataFrame) -> DataFrame:
    """Present codes that lean to each model; codes that lean to neither don't vote."""
    votes = [F.count_if((F.col("cnt") > 0) & (F.col(f"n{s}") > F.col(f"n{1 - s}"))).cast("double").alias(f"p{s}") for s in (0, 1)]
    return _with(train, test).groupBy(*OUTPUT).agg(*votes)


def naive_bayes_bernoulli(train: DataFrame, test: DataFrame, alpha: float = 1e-6, annotated_only: bool = False) -> DataFrame:
    """Equal priors and log P(feature | model), smoothed; with ``annotated_only`` just over codes that are present."""
    rows = _with(train, test)
    if annotated_only:
        rows = rows.where("cnt > 0")
    logs = []
    for s in (0, 1):
        p = (F.col(f"n{s}") + alpha) / (F.col(f"t{s}") + 2 * alpha)
        logs.append((F.sum(F.ln(F.when(F.col("cnt") > 0, p).otherwise(1 - p))) + F.ln(F.lit(0.5))).alias(f"p{s}"))
    return rows.groupBy(*OUTPUT).agg(*logs)


def naive_bayes_multinomial(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Sum of count * log((sum + alpha) / (total + alpha V)) and log prior."""
    sums = train.groupBy("comparison", "code_idx").agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("cnt"))), F.lit(0)).alias(f"c{s}") for s in (0, 1)))
    whole = Window.partitionBy("comparison")
    logs = sums.select("comparison", "code_idx", *(F.ln((F.col(f"c{s}") + alpha) / (F.sum(f"c{s}").over(whole) + alpha * F.count("*").over(whole))).alias(f"l{s}") for s in (0, 1)))
    n = [F.count_distinct(F.when(F.col("side") == s, F.col("doc_id"))) for s in (0, 1)]
    priors = train.groupBy("comparison").agg(*(F.ln(n[s] / (n[0] + n[1])).alias(f"prior{s}") for s in (0, 1)))
    rows = test.where("cnt IS NOT NULL").join(F.broadcast(logs), ["comparison", "code_idx"]).join(F.broadcast(priors), "comparison")  # a row a comparison and code, a row a comparison
    return rows.groupBy(*OUTPUT).agg(*((F.sum(F.col("cnt") * F.col(f"l{s}")) + F.max(f"prior{s}")).alias(f"p{s}") for s in (0, 1)))


def nearest_centroid(train: DataFrame, test: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Cosine (0 for a zero vector) or 1 / (1 + distance) to each model's mean."""
    means = train.groupBy("comparison", "code_idx").agg(*(F.coalesce(F.avg(F.when(F.col("side") == s, F.col("cnt"))), F.lit(0.0)).alias(f"m{s}") for s in (0, 1)))
    rows = test.where("cnt IS NOT NULL").join(F.broadcast(means), ["comparison", "code_idx"])  # a row a comparison and code
    x = F.col("cnt").cast("double")
    scores = []
    for s in (0, 1):
        m = F.col(f"m{s}")
        if metric == "cosine":
            norm = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(m * m))
            scores.append(F.coalesce(F.sum(x * m) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias(f"p{s}"))
        elif metric == "euclidean":
            scores.append((1 / (1 + F.sqrt(F.sum((x - m) * (x - m))))).alias(f"p{s}"))
        else:
            raise ValueError(f"unknown metric: {metric}")
    return rows.groupBy(*OUTPUT).agg(*scores)


def packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str | Column], name: str, block: int) -> DataFrame:
    """(keys, __block, ``name``): the rows of a key as lists of about ``block`` structs of ``fields``, dealt by digests of ``id``."""
    rows = df.select(*keys, F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h"), F.struct(*fields).alias("row"))
    if keys:
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("__blocks"))
        rows = rows.join(sizes.hint("shuffle_merge"), list(keys))
    else:
        rows = rows.withColumn("__blocks", F.lit(max(1, -(-df.count() // block))))
    return rows.groupBy(*keys, (F.col("h") % F.col("__blocks")).alias("__block")).agg(F.collect_list("row").alias(name))


def nearest_neighbours(queries: DataFrame, base: DataFrame, k: int, keys: tuple[str, ...] = (), block: int = 1024) -> DataFrame:
    """(keys, query, neighbour, label, distance, rank): the k nearest of ``base(keys, id, label, v)`` to each of ``queries(keys, id, v)``, by Euclidean distance, ties by id.

    Rows meet in blocks: a block of queries with a block of rows is one unit of work
    of bounded size, gives k rows a query, and these are ranked once more.
    """

    row = lambda label: ("id", label.alias("label"), F.col("v").cast("array<double>").alias("v"))
    one = packed(queries, keys, row(F.lit(None).cast("int")), "qs", block).drop("__block")
    two = packed(base, keys, row(F.col("label")), "bs", block).drop("__block")
    met = one.join(two.hint("shuffle_merge"), list(keys)) if keys else one.crossJoin(two)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (ids, _, asked), (mine, labels, rows) = (as_arrays(batch.column(x)[r].values) for x in ("qs", "bs"))
                found, step = [], max(1, (1 << 21) // max(1, rows.size))
                for i in range(0, len(ids), step):
                    d = np.sqrt(((rows - asked[i : i + step, None]) ** 2).sum(axis=2))
                    most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(rows) > k else np.inf
                    q, at = np.nonzero(d <= most)
                    order = np.lexsort((mine[at], d[q, at], q))
                    q, at = q[order], at[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < k  # how many of a query stand before
                    found.append((q[best] + i, at[best], d[q[best], at[best]]))
                q, at, d = (np.concatenate(x) for x in zip(*found, strict=True))
                same = pa.array(np.full(len(at), r))
                made = [pa.array(ids[q]), pa.array(mine[at]), labels.take(pa.array(at)), pa.array(d)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in keys), *made], [*keys, "query", "neighbour", "label", "distance"])

    kinds = "".join(f"`{c}` {met.schema[c].dataType.simpleString()}, " for c in keys)
    rows = met.mapInArrow(nearest, f"{kinds}query long, neighbour long, label int, distance double")
    rank = F.row_number().over(Window.partitionBy(*keys, "query").orderBy("distance", "neighbour"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def as_arrays(rows: pa.StructArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Ids, labels and vectors of a block; all vectors are of one length."""
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False)
    return rows.field("id").to_numpy(zero_copy_only=False), rows.field("label"), flat.reshape(len(rows), -1)


def knn_vote(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """The share of each model among the k nearest training vectors.

    Vectors of counts repeat: each distinct one looks for neighbours once, and of equal
    training vectors only those with the k smallest ids can be among the k nearest, so the
    work follows the distinct vectors, not the traces. Of these, a vector meets those in
    cells that may hold a neighbour (``pivot_neighbours``).
    """
    from .neighbours import pivot_neighbours
    from .stats import vectors

    queries = saved(vectors(test).select("comparison", (F.col("question_id") * 2 + F.col("side")).alias("id"), "v"), "queries")
    asked = saved(queries.groupBy("comparison", "v").agg(F.min("id").alias("query")), "asked")
    first = F.row_number().over(Window.partitionBy("comparison", "v").orderBy("id"))
    base = vectors(train).select("comparison", (F.col("question_id") * 2 + F.col("side")).alias("id"), F.col("side").alias("label"), "v").withColumn("nth", first).where(F.col("nth") <= k)
    near = pivot_neighbours(asked.withColumnRenamed("query", "id"), base.drop("nth"), k, ("comparison",))
    found = near.groupBy("comparison", "query").agg(F.avg((F.col("label") == 0).cast("double")).alias("p0"))
    voted = saved(asked.join(found.hint("shuffle_merge"), ["comparison", "query"]).drop("query"), "votes")
    shares = queries.join(voted.hint("shuffle_merge"), ["comparison", "v"])
    return shares.select("comparison", F.floor(F.col("id") / 2).alias("question_id"), (F.col("id") % 2).cast("int").alias("side"), "p0", (1 - F.col("p0")).alias("p1"))


def logistic_regression(train: DataFrame, test: DataFrame, c: float = 1.0, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """L2 logistic regression of each comparison's vectors: log loss + |w|^2 / (2 C), the intercept free, no scaling.

    Newton's method for all comparisons at once. A step is one aggregation: tasks add up
    X'WX, X'(p - y) and the loss of the distinct vectors they hold, by comparison; the sums
    are added and solved by comparison in Spark. Where the loss rose, the last step is
    halved. One number a step reaches the driver: how far the farthest weights moved.
    """
    from .stats import vectors

    points = saved(vectors(train).groupBy("comparison", F.col("v").cast("array<double>").alias("v")).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")), "points")
    start = points.groupBy("comparison").agg(F.max(F.size("v")).alias("width"))
    zeros = F.transform(F.sequence(F.lit(0), F.col("width")), lambda _: F.lit(0.0))
    weights = saved(start.select("comparison", zeros.alias("w"), zeros.alias("before"), F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("moved")), "weights")
    key = f"comparison {points.schema['comparison'].dataType.simpleString()}"
    for _ in range(steps):
        met = points.join(weights.select("comparison", "w", "before", F.col("loss").alias("last")).hint("shuffle_merge"), "comparison")
        sums = met.mapInPandas(_newton_sums, f"{key}, w array<double>, before array<double>, last double, sums array<double>")
        weights = saved(sums.groupBy("comparison").applyInPandas(lambda rows: _newton_step(rows, c), f"{key}, w array<double>, before array<double>, loss double, moved double"), "weights")  # a row a task
        moved = weights.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    rows = vectors(test).join(weights.select("comparison", "w").hint("shuffle_merge"), "comparison")
    inner = F.aggregate(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.col("v"), lambda w, x: w * x), F.element_at("w", -1), lambda s, x: s + x)
    return rows.withColumn("p1", 1 / (1 + F.exp(-inner))).select(*OUTPUT, (1 - F.col("p1")).alias("p0"), "p1")


def _newton_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """X'WX, X'(p - y) and the loss of the rows of each comparison that a task holds, in one array."""
    held: dict[int, list] = {}
    for rows in batches:
        for comparison, part in rows.groupby("comparison"):
            w = np.asarray(part["w"].iloc[0], float)
            x = np.column_stack([np.stack(part["v"].tolist()), np.ones(len(part))])
            n0, n1 = part["n0"].to_numpy(float), part["n1"].to_numpy(float)
            score = x @ w
            p = 1 / (1 + np.exp(-score))
            loss = (n0 * np.logaddexp(0, score) + n1 * np.logaddexp(0, -score)).sum()
            found = np.concatenate([(x.T @ (x * ((n0 + n1) * p * (1 - p))[:, None])).ravel(), x.T @ ((n0 + n1) * p - n1), [loss]])
            if comparison in held:
                held[comparison][-1] += found
            else:
                held[comparison] = [comparison, w, part["before"].iloc[0], part["last"].iloc[0], found]
    yield pd.DataFrame(list(held.values()), columns=["comparison", "w", "before", "last", "sums"])


def _newton_step(rows: pd.DataFrame, c: float) -> pd.DataFrame:
    """The next weights of a comparison, from the sums of its tasks."""
    w, before, last = np.asarray(rows["w"].iloc[0], float), np.asarray(rows["before"].iloc[0], float), rows["last"].iloc[0]
    size, sums = len(w), np.sum(np.stack(rows["sums"].tolist()), axis=0)
    penalty = np.append(np.full(size - 1, 1 / c), 0.0)
    loss = sums[-1] + (penalty * w * w).sum() / 2
    if loss > last + 1e-9 * (1 + abs(loss)):
        after, kept, loss = (w + before) / 2, before, last
    else:
        curve = sums[: size * size].reshape(size, size) + np.diag(penalty)
        after, kept = w - np.linalg.lstsq(curve, sums[size * size : -1] + penalty * w, rcond=None)[0], w
    return pd.DataFrame({"comparison": rows["comparison"].iloc[:1], "w": [after], "before": [kept], "loss": [loss], "moved": [np.abs(after - w).max()]})


CLASSIFIERS = {
    "vote_soft": vote_soft,
    "vote_soft_bernoulli": vote_soft_bernoulli,
    "vote_hard": vote_hard,
    "naive_bayes_bernoulli": naive_bayes_bernoulli,
    "naive_bayes_multinomial": naive_bayes_multinomial,
    "centroid_cosine": lambda a, b: nearest_centroid(a, b, "cosine"),
    "centroid_euclidean": nearest_centroid,
    "knn": knn_vote,
    "logistic_regression": logistic_regression,
}


def classify(method: str, train: DataFrame, test: DataFrame) -> DataFrame:
    return chosen(CLASSIFIERS, method)(train, test)
