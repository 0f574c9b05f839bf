"""The taxonomy: embedding and grouping of codes, versions, merging, pruning, stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import clean_code_name
from marginalia.sources.scratch import saved

from . import stats
from .vectors import chosen


def embed_codes(codes: DataFrame, width: int = 768, tokens: int = 512) -> DataFrame:
    """(code_idx, dim, x): a hashed histogram of ``name: definition``, its first ``tokens`` words, at length 1."""
    words = F.slice(F.split(F.lower(F.concat("code_name", F.lit(": "), "definition")), r"\s+"), 1, tokens)
    dim = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % width
    counts = codes.select("code_idx", F.explode(words).alias("word")).groupBy("code_idx", dim.cast("int").alias("dim")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("code_idx")))
    return counts.select("code_idx", "dim", (F.col("n") / norm).alias("x"))


def indexed_dims(embedded: DataFrame, least: float) -> DataFrame:
    """Saved: the rows of ``embedded(code_idx, dim, x)`` by which codes meet.

    Dimensions are in one order, those of most codes first. The first dimensions of a code
    whose x have a norm below ``least`` are left out: with these alone no vector of length 1
    has a product of ``least``. Two similar codes so share a dimension after what is left
    out, and the last one that they share lies behind it in both.
    """
    often = saved(embedded.where("x <> 0").groupBy("dim").agg(F.count("*").alias("codes")), "dims")
    placed = embedded.where("x <> 0").join(often.hint("shuffle_merge"), "dim")
    sums = F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("code_idx").orderBy(F.desc("codes"), "dim"))  # a code's own dimensions
    return saved(placed.withColumn("squares", sums).where(F.col("squares") >= (least - 1e-9) ** 2).select("code_idx", "dim", "x"), "indexed-dims")


def met_codes(embedded: DataFrame, least: float) -> DataFrame:
    """Saved (code_1, code_2), code_1 < code_2: the pairs that share an indexed dimension."""
    indexed = indexed_dims(embedded, least)
    one, two = (indexed.select(F.col("code_idx").alias(f"code_{i}"), "dim") for i in (1, 2))
    return saved(one.join(two.hint("shuffle_merge"), "dim").where("code_1 < code_2").select("code_1", "code_2").distinct(), "met-codes")


def similar_codes(embedded: DataFrame, least: float) -> DataFrame:
    """(code_1, code_2, cosine) with cosine >= ``least`` > 0 of vectors of length 1: codes meet by ``indexed_dims`` and are compared in full."""
    met = met_codes(embedded, least)
    vectors = saved(embedded.groupBy("code_idx").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("v")), "code-vectors")  # a code's own dimensions
    side = lambda i: vectors.select(F.col("code_idx").alias(f"code_{i}"), F.col("v").alias(f"v{i}")).hint("shuffle_merge")
    both = met.join(side(1), "code_1").join(side(2), "code_2")
    dot = F.aggregate(F.map_keys("v1"), F.lit(0.0), lambda s, d: s + F.element_at("v1", d) * F.coalesce(F.try_element_at("v2", d), F.lit(0.0)))
    return both.select("code_1", "code_2", dot.alias("cosine")).where(F.col("cosine") >= least)


def component_labels(edges: DataFrame) -> DataFrame:
    """(code_idx, component) of ``edges(code_1, code_2)``: the smallest code of each connected component.

    Each round passes on smallest labels and lets every code take its label's own label,
    so chains halve; it runs until no label moves.
    """
    both = saved(edges.select(F.col("code_1").alias("a"), F.col("code_2").alias("b")).unionByName(edges.select(F.col("code_2").alias("a"), F.col("code_1").alias("b"))), "edges")
    labels = saved(both.select(F.col("a").alias("code_idx")).distinct().withColumn("component", F.col("code_idx")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("code_idx", "b").hint("shuffle_merge"), "b").groupBy(F.col("a").alias("code_idx")).agg(F.min("component").alias("heard"))
        near = saved(labels.join(heard.hint("shuffle_merge"), "code_idx").select("code_idx", F.col("component").alias("before"), F.least("component", "heard").alias("component")), "labels")
        jump = near.select(F.col("code_idx").alias("component"), F.col("component").alias("further"))
        after = saved(near.join(jump.hint("shuffle_merge"), "component").select("code_idx", F.least("component", "further").alias("component"), (F.least("component", "further") < F.col("before")).alias("moved")), "labels")
        labels = after.select("code_idx", "component")
        if after.where("moved").isEmpty():
            return labels


def average_linkage(pairs: DataFrame, codes: DataFrame, cut: float) -> DataFrame:
    """(code_idx, group) of ``codes(code_idx)``: clusters by average linkage on cosine distance, merged while the nearest two are strictly below ``cut``; a group is named by its smallest code.

    ``pairs(a, b, s)``, a < b, has the cosines that aren't 0. In each round all pairs of
    clusters merge that are each other's nearest (ties by smallest codes). A merged cluster
    is no nearer to a third one than the nearer of its parts was, so these merges are those
    that one merge at a time would make. Sums and sizes of clusters are all that moves.
    """
    members = saved(codes.select("code_idx", F.col("code_idx").alias("group")), "members")
    pairs = saved(pairs.select("a", "b", "s"), "cluster-pairs")
    while True:
        sizes = saved(members.groupBy("group").agg(F.count("*").alias("n")), "sizes")
        of = lambda x: sizes.select(F.col("group").alias(x), F.col("n").alias(f"n_{x}")).hint("shuffle_merge")  # noqa: E731, B023
        gap = F.round(1 - F.col("s") / (F.col("n_a") * F.col("n_b")), 9)
        near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", gap.alias("gap")).where(F.col("gap") < cut)
        best = near.withColumn("end", F.explode(F.array("a", "b"))).groupBy("end").agg(F.min(F.struct("gap", "a", "b")).alias("p"))
        merged = saved(best.groupBy("p.a", "p.b").agg(F.count("*").alias("ends")).where("ends = 2").select("a", "b"), "merged")
        if merged.isEmpty():
            return members
        into = lambda x: merged.select(F.col("b").alias(x), F.col("a").alias(f"{x}_into")).hint("shuffle_merge")  # noqa: E731, B023
        members = saved(members.join(into("group"), "group", "left").select("code_idx", F.coalesce("group_into", "group").alias("group")), "members")
        moved = pairs.join(into("a"), "a", "left").join(into("b"), "b", "left").select(F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "s")
        pairs = saved(moved.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")), "cluster-pairs")


def group_similar_codes(embedded: DataFrame, least: float = 0.85, size: int = 2) -> DataFrame:
    """(group, code_idx) of clusters of ``size`` codes or more. A merge below the cut needs one pair below it, so clusters stay inside components, and only codes of one component are compared again."""
    labels = component_labels(similar_codes(embedded, least).where(F.col("cosine") > least))
    inside = saved(embedded.join(labels.hint("shuffle_merge"), "code_idx"), "inside")
    one, two = (inside.select(F.col("code_idx").alias(c), "component", "dim", F.col("x").alias(f"x_{c}")) for c in "ab")
    pairs = one.join(two.hint("shuffle_merge"), ["component", "dim"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x_a") * F.col("x_b")).alias("s"))
    groups = average_linkage(pairs, labels, 1 - least)
    large = saved(groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("group"), "groups")
    return groups.join(large.hint("shuffle_merge"), "group").select("group", "code_idx")


def merge_map(codes: DataFrame, groups: DataFrame) -> DataFrame:
    """(code_name, merged): each grouped code under the name of its group's first."""
    named = saved(groups.join(codes.select("code_idx", "code_name").hint("shuffle_merge"), "code_idx"), "grouped-codes")
    first = named.groupBy("group").agg(F.min_by("code_name", "code_idx").alias("merged"))
    return named.join(first.hint("shuffle_merge"), "group").select("code_name", "merged")


def without(codes: DataFrame, removed: DataFrame) -> DataFrame:
    """The taxonomy minus removed codes, indexed anew; long facts need no rewrite."""
    place = F.row_number().over(Window.orderBy("code_idx")) - 1
    return codes.join(removed.select("code_name").distinct(), "code_name", "left_anti").withColumn("code_idx", place)


def versions_diff(codes: DataFrame, old: int, new: int) -> DataFrame:
    """(code_name, change): what was added, removed or redefined between two versions of ``codes(version, code_name, definition)``."""
    one, two = (codes.where(F.col("version") == v).select("code_name", F.col("definition").alias(f"d{i}"), F.lit(True).alias(f"in{i}")) for i, v in ((1, old), (2, new)))
    both = one.join(two, "code_name", "full")
    change = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "removed").when(~F.col("d1").eqNullSafe(F.col("d2")), "redefined")
    return both.select("code_name", change.alias("change")).where("change IS NOT NULL")


def apply_update(codes: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """The next version of ``codes(version, code_idx, code_name, definition)`` from ``changes(step, action, code_name, definition)``: updated codes move to the end under their old names, then come the added ones, in order of their steps."""
    last = changes.groupBy("code_name").agg(F.max_by("definition", "step").alias("new_definition"), F.max("step").alias("step"))
    current = codes.where(F.col("version") == version - 1)
    joined = current.join(last, "code_name", "full")
    order = Window.orderBy(F.coalesce("step", F.lit(-1)), "code_idx")
    fresh = joined.select(F.lit(version).alias("version"), (F.row_number().over(order) - 1).alias("code_idx"), "code_name", F.coalesce("new_definition", "definition").alias("definition"))
    return codes.unionByName(fresh)


def latest(codes: DataFrame) -> DataFrame:
    """The taxonomy of the highest version."""
    top = codes.agg(F.max("version").alias("version"))
    return codes.join(F.broadcast(top), "version", "left_semi")


def stop_decisions(rounds: DataFrame, by: Sequence[str] = (), max_codes: int | None = None, max_samples: int | None = None, patience: int | None = None, least_samples: int = 0) -> DataFrame:
    """(by, round, codes, samples, streak, stop) after the last of each run's ``rounds(by, round, codes, samples)``: enough codes or samples, or no change for ``patience`` rounds."""
    order = Window.partitionBy(*by).orderBy("round")
    changed = F.coalesce((F.col("codes") != F.lag("codes").over(order)).cast("int"), F.lit(1))
    islands = rounds.withColumn("island", F.sum(changed).over(order)).groupBy(*by, "island").agg(F.count("*").alias("streak"), F.max("round").alias("round"), F.max("codes").alias("codes"), F.max("samples").alias("samples"))
    last = islands.groupBy(*by).agg(F.max_by(F.struct("round", "codes", "samples", "streak"), "round").alias("last")).select(*by, "last.*").where("round IS NOT NULL")
    rules = [F.col("codes") >= max_codes if max_codes else F.lit(False), F.col("samples") >= max_samples if max_samples else F.lit(False), (F.col("streak") > patience) & (F.col("samples") >= least_samples) if patience else F.lit(False)]
    return last.withColumn("stop", rules[0] | rules[1] | rules[2])


def should_stop(rounds: DataFrame, **limits: int | None) -> bool:
    """The stop rule of one run. One row reaches the driver."""
    found = stop_decisions(rounds, **limits).first()
    return bool(found and found["stop"])


def clean_names(codes: DataFrame) -> DataFrame:
    return codes.withColumn("code_name", clean_code_name(F.col("code_name")))


#: What stays of code statistics (comparison, code_idx, code_name, c0, c1, total, ratio), by method.
PRUNERS = {
    "frequency": lambda s: stats.prune_frequency(s, 20, 0.05),
    "equal": lambda s: stats.filter_equal(s, 5).where("NOT equal").drop("equal"),
    "top_k": lambda s: stats.top_k_codes(s, 3).drop("score"),
}


def prune(method: str, code_stats: DataFrame) -> DataFrame:
    return chosen(PRUNERS, method)(code_stats)


