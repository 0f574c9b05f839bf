"""Pairing, splitting and sampling. Random orders are by digest, so any engine repeats them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.tables import numbered, shuffle_numbered, shuffled_rank


def pair_traces(traces: DataFrame) -> DataFrame:
    """(comparison, question_id, doc_a, doc_b, text_a, text_b) of questions that both models answered."""
    sides = [traces.where(F.col("side") == s).select("comparison", "question_id", F.col("doc_id").alias(f"doc_{x}"), F.col("thinking").alias(f"text_{x}")) for s, x in enumerate("ab")]
    return sides[0].join(sides[1].hint("shuffle_merge"), ["comparison", "question_id"])


def model_pairs(models: DataFrame) -> DataFrame:
    """Unordered pairs of a list of models, one row a model: the list is short, and each model takes those after it."""
    listed = models.agg(F.array_sort(F.collect_set("model")).alias("all"))
    firsts = listed.select("all", F.posexplode("all").alias("at", "model_1"))
    return firsts.select("model_1", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("model_2"))


def cross_model_pairs(first: DataFrame, second: DataFrame, batch: int = 2) -> DataFrame:
    """All pairs of two lists of models, numbered in batches."""
    pairs = first.select(F.col("model").alias("model_1")).crossJoin(F.broadcast(second.select(F.col("model").alias("model_2"))))
    number = F.row_number().over(Window.orderBy("model_1", "model_2")) - 1
    return pairs.withColumn("batch", F.floor(number / batch))


def pair_correct_wrong(traces: DataFrame, status: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Pairs of a correct and a wrong trace of a question: as many as the larger side has (with ``most``: the smaller side, at most that), the other side repeating."""
    graded = traces.join(status.hint("shuffle_merge"), "doc_id")
    sides = {s: numbered(graded.where(F.col("status") == s).select(*keys, "doc_id"), list(keys), "doc_id", "i") for s in ("correct", "wrong")}
    sizes = [x.groupBy(*keys).agg(F.count("*").alias(f"n_{s}")) for s, x in sides.items()]
    n = F.greatest("n_correct", "n_wrong") if most is None else F.least("n_correct", "n_wrong", F.lit(most))
    slots = sizes[0].join(sizes[1].hint("shuffle_merge"), list(keys)).select(*keys, "n_correct", "n_wrong", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("slot"))
    for s, x in sides.items():
        slots = slots.withColumn("i", F.col("slot") % F.col(f"n_{s}")).join(x.withColumnRenamed("doc_id", f"{s}_id").hint("shuffle_merge"), [*keys, "i"]).drop("i")
    return slots.select(*keys, "slot", "correct_id", "wrong_id")


def decontaminate(questions: DataFrame, tests: DataFrame, text: str = "text") -> DataFrame:
    """Questions whose text is no test question's. Joined by digest, so long texts don't move."""
    seen = tests.select(F.sha2(text, 256).alias("__digest")).distinct()
    return questions.withColumn("__digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(seen, "__digest", "left_anti").drop("__digest")


def pending(questions: DataFrame, done: DataFrame, unfinished: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without an output, or with one that is marked unfinished."""
    return questions.join(done, key, "left_anti").unionByName(questions.join(done, key, "left_semi").join(unfinished, key, "left_semi"))


def densify(samples: DataFrame, codes: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every sample with every code; a code without a fact is 0. The taxonomy is a few dozen rows."""
    grid = samples.select(*keys).distinct().crossJoin(F.broadcast(codes.select("code_idx", "code_name")))
    return grid.join(facts.select(*keys, "code_idx", "cnt").hint("shuffle_merge"), [*keys, "code_idx"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def shuffle_pairs(pairs: DataFrame, seed: int, key: str = "question_id", balance: bool = False) -> DataFrame:
    """``pairs(comparison, ...)`` with their place in a fixed shuffle and whether the sides swap: by a bit of the digest, or every second one."""
    rank = shuffled_rank(F.col(key), seed)
    placed = shuffle_numbered(pairs, ["comparison"], rank, key, "place").withColumn("place", (F.col("place") + 1).cast("int"))
    return placed.withColumn("swap", F.col("place") % 2 == 0 if balance else F.substring(rank, 32, 1).isin(*"13579bdf"))


def split_traces(rows: DataFrame, seed: int, warmup: int, share: float, strata: Sequence[str], key: str) -> DataFrame:
    """``rows`` with split: the first ``warmup`` of each stratum's shuffle, then ``share`` of the rest to train, what is left to eval."""
    placed = shuffle_numbered(rows, strata, shuffled_rank(F.col(key), seed), key, "at_", "n_")
    train = F.floor((F.col("n_") - warmup) * share)
    return placed.withColumn("split", F.when(F.col("at_") < warmup, "warmup").when(F.col("at_") < warmup + train, "train").otherwise("eval")).drop("at_", "n_")


def accumulation_rounds(rows: DataFrame, k: int, epochs: int, seed: int, keys: Sequence[str], key: str) -> DataFrame:
    """Each epoch deals all rows in a new order into rounds of k."""
    turned = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col(key).cast("string")))
    placed = shuffle_numbered(turned, [*keys, "epoch"], rank, key, "round")
    return placed.withColumn("round", F.floor(F.col("round") / k))


def update_draws(rows: DataFrame, draws: DataFrame, seed: int, index: str) -> DataFrame:
    """A row of ``rows`` for each ``draws(draw)``, with replacement: the digest of the draw's number picks the dense index."""
    n = rows.agg(F.count("*").alias("n"))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    return draws.crossJoin(F.broadcast(n)).withColumn(index, pick % F.col("n")).drop("n").join(rows.hint("shuffle_merge"), index)


def shuffled_choices(questions: DataFrame, key: str, choices: str) -> DataFrame:
    """``questions`` with their choices in a shuffle of their own and the letter of the first (correct) one."""
    rows = questions.select("*", F.posexplode(choices).alias("__pos", "__choice"))
    rank = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("__pos").cast("string")))
    kept = [c for c in questions.columns if c != choices]
    listed = rows.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "__pos", "__choice"))).alias("__all"))
    gold = F.substring(F.lit("ABCD"), F.array_position(F.transform("__all", lambda x: x["__pos"]), F.lit(0)).cast("int"), F.lit(1))
    return listed.select(*kept, F.transform("__all", lambda x: x["__choice"]).alias(choices), gold.alias("gold"))


def few_shot(rows: DataFrame, k: int, seed: int, keys: Sequence[str], key: str) -> DataFrame:
    """k samples of each group by a fixed shuffle: the first k of each of the digest's 256 ranges, then of these."""
    ranked = rows.withColumn("rank_", shuffled_rank(F.col(key), seed)).withColumn("range_", F.substring("rank_", 1, 2))
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("rank_", key))
    near = ranked.withColumn("shot", first([*keys, "range_"])).where(F.col("shot") <= k)
    return near.withColumn("shot", first(keys)).where(F.col("shot") <= k).drop("rank_", "range_")


def repeated(rows: DataFrame, n: int, out: str = "run") -> DataFrame:
    return rows.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
