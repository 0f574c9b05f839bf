"""Names that are much alike, by an index on their rare letter pairs.

Two names alike at ``least`` share a common subsequence, so of one's n - 1 letter pairs
(repeats numbered) only those next to a dropped or inserted letter can be missing in the
other. How many letters that are follows from the lengths; so many pairs plus one, the
rarest of each name, are its prefix, and two such names share a pair of their prefixes.
Names meet by an equi-join on these. A name so short that all its pairs may be missing
meets the names of every length that it can be alike to, by an equi-join on lengths. Pairs
that meet are compared in full. Nothing is capped, and no side is broadcast.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.annotations import similarity, token_set_similarity, word_set
from marginalia.sources.scratch import saved


@lru_cache(100_000)
def most_missing(size: int, least: int) -> tuple[int, int, int]:
    """How many letter pairs of a name of ``size`` letters a name alike at ``least`` may lack, and the shortest and longest length of such names."""
    share = (least - 0.5) / 100
    low, high = math.ceil(size * share / (2 - share) - 1e-9), math.floor(size * (2 - share) / share + 1e-9)
    missing = 0
    for other in range(low, high + 1):
        common = math.ceil(share * (size + other) / 2 - 1e-9)
        if common <= min(size, other):
            missing = max(missing, 2 * (size - common) + (other - common))
    return missing, low, high


def letter_pairs(name: str) -> list[str]:
    """The letter pairs of a name, repeats numbered."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(name) - 1):
        pair = name[i : i + 2]
        seen[pair] = seen.get(pair, 0) + 1
        out.append(f"{pair}{seen[pair]}")
    return out


def _form(name: str, mode: str) -> str:
    """What is indexed of a name: itself, or its words in order."""
    return " ".join(sorted(word_set(name))) if mode == "token" else name.lower()


def prefixes(names: DataFrame, least: int, mode: str) -> DataFrame:
    """Saved (side, name, size, key): the keys by which ``names(side, name)`` meet."""

    @F.pandas_udf("size int, keep int, pairs array<string>, keys array<string>")
    def parts(side: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for s, x in zip(side, name, strict=True):
            form = _form(x, mode)
            missing, low, high = most_missing(len(form), least)
            own, other = ("n", "c") if s == 0 else ("c", "n")
            keys = [f"{own}:{len(form)}"]
            pairs = letter_pairs(form)
            if missing + 1 > len(pairs):
                keys += [f"{other}:{size}" for size in range(low, high + 1)]
                missing, pairs = -1, []
            if mode == "token":
                keys += [f"w:{w}" for w in word_set(x)]
            rows.append((len(form), missing + 1, pairs, keys))
        return pd.DataFrame(rows, columns=["size", "keep", "pairs", "keys"])

    made = saved(names.withColumn("part", parts("side", "name")).select("side", "name", "part.*"), "name-parts")
    pairs = made.select("side", "name", "size", "keep", F.explode("pairs").alias("pair"))
    often = saved(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    ranked = pairs.join(often.hint("shuffle_merge"), "pair").groupBy("side", "name", "size", "keep").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("ranked"))
    rare = ranked.select("side", "name", "size", F.explode(F.slice("ranked", 1, F.col("keep"))).alias("p")).select("side", "name", "size", F.concat(F.lit("p:"), "p.pair").alias("key"))
    return saved(rare.unionByName(made.select("side", "name", "size", F.explode("keys").alias("key"))), "name-keys")


def met(names: DataFrame, candidates: DataFrame, least: int, mode: str) -> DataFrame:
    """Saved (name, candidate): the distinct pairs of ``names(name)`` and ``candidates(candidate)`` that share a key and have lengths that allow ``least``."""
    both = names.select(F.lit(0).alias("side"), "name").unionByName(candidates.select(F.lit(1).alias("side"), F.col("candidate").alias("name"))).where("name IS NOT NULL").distinct()
    keys = prefixes(both, least, mode)
    one = keys.where("side = 0").select("name", "size", "key")
    two = keys.where("side = 1").select(F.col("name").alias("candidate"), F.col("size").alias("other"), "key")
    fits = 2 * F.least("size", "other") >= (least - 0.5) / 100 * (F.col("size") + F.col("other"))
    if mode == "token":
        fits = fits | F.col("key").startswith("w:")
    return saved(one.join(two.hint("shuffle_merge"), "key").where(fits).select("name", "candidate").distinct(), "met-names")


def fuzzy_match(names: DataFrame, candidates: DataFrame, least: int = 90, mode: str = "character") -> DataFrame:
    """(name, candidate, score): the best of ``candidates(ord, candidate)`` for each name at ``least`` or more, ties by candidate order.

    ``character`` mode compares letters; ``token`` compares the sets of words
    (``token_set_similarity``). Null names match nothing.
    """
    if not 1 <= least <= 100:
        raise ValueError("least must be 1 to 100")
    alike = token_set_similarity if mode == "token" else similarity

    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    scored = met(names, candidates, least, mode).withColumn("score", score("name", "candidate")).where(F.col("score") >= least)
    first = candidates.groupBy("candidate").agg(F.min("ord").alias("ord"))
    best = scored.join(first.hint("shuffle_merge"), "candidate").groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("lower"), "ord", "candidate")).alias("best"))
    return best.select("name", F.col("best.candidate").alias("candidate"), (-F.col("best.lower")).alias("score"))
