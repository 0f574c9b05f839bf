"""Running sums by ranges, and the automaton over the names of a taxonomy, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import annotations as an
from marginalia.functions import mentions
from marginalia.operators import scans
from marginalia.sources import tables as t


def steps_of(spark, rows):
    return spark.createDataFrame(rows, "k string, pos long, hit boolean")


def plainly(rows):
    """(running, streak) by (key, position), one step after the other."""
    out, state = {}, {}
    for k, pos, hit in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        right, known, streak = state.get(k, (0, 0, 0))
        right, known, streak = right + (hit is True), known + (hit is not None), 0 if hit else streak + 1
        state[k] = right, known, streak
        out[k, pos] = round(right / known, 6) if known else None, streak
    return out


@pytest.mark.parametrize("span", [1, 3, 16, 1000])
def test_scans_against_one_step_after_the_other(spark, span):
    rng = random.Random(span)
    rows = [(k, 5 * i - 40, rng.choice([None, False, False, False, rng.random() < 0.3])) for k in ("a", "b", None) for i in range(60)] + [("long", i, i == 7) for i in range(200)]
    want = plainly(rows)
    steps = steps_of(spark, rows)
    streaks = {(r.k, r.pos): r.streak for r in scans.no_update_streak(steps, ["k"], "pos", F.col("hit"), span).collect()}
    shares = {(r.k, r.pos): r.running for r in scans.running_accuracy(steps, ["k"], "pos", F.col("hit"), span).collect()}
    assert streaks == {x: y[1] for x, y in want.items()}
    assert shares.keys() == want.keys() and all(shares[x] == y[0] if y[0] is None else abs(shares[x] - y[0]) < 2e-6 for x, y in want.items())


def test_scans_of_empty_tables_and_without_keys(spark):
    assert scans.no_update_streak(steps_of(spark, []), ["k"], "pos", F.col("hit")).collect() == []
    rows = steps_of(spark, [("x", i, i == 2) for i in range(6)])
    assert [r.streak for r in scans.no_update_streak(rows, [], "pos", F.col("hit"), 2).orderBy("pos").collect()] == [1, 2, 0, 1, 2, 3]


def test_one_run_is_shared_by_tasks(spark):
    """A run with all rows: no task gets more than a quarter of them, and they are shuffled once."""
    steps = spark.range(40_000).select(F.lit("one").alias("k"), F.col("id").alias("pos"), (F.col("id") % 9_973 == 0).alias("hit"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = scans.no_update_streak(steps, ["k"], "pos", F.col("hit"), 500)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) <= 10_000
        assert found.where("pos = 39999").first().streak == 39_999 - 9_973 * 4
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(__run") - plan.count("ReusedExchange") <= 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


# ---- names of a large taxonomy ----------------------------------------------


def places_by_patterns(names, text, longest):
    """A pattern a name, as the rule says it."""
    at = []
    for i, name in enumerate(names):
        name = re.escape(name.lower())
        pattern = f"(?={name})" if " " in name else rf"(?<![^\W_])(?={name}(?![^\W_]))"
        at += [(m.start(), i) for m in re.finditer(pattern, text.lower())]
    return [i for _, i in sorted(at)[:longest]]


@pytest.mark.parametrize("seed", range(40))
def test_first_places_against_a_pattern_a_name(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aAbé1-_", k=rng.randint(1, 4)))
    names = list(dict.fromkeys([word() if rng.random() < 0.6 else f"{word()} {word()}" for _ in range(30)])) + ["A", "a"]
    text = "".join(rng.choices(["a", "A", "b", "é", "1", "-", "_", " ", ".", "  "], k=400))
    for longest in (5, 10_000):
        assert mentions.first_places(mentions.automaton(names), text, longest) == places_by_patterns(names, text, longest)


def test_counts_in_one_walk_equal_those_by_expressions(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aAbé1-_", k=rng.randint(1, 3)))
    names = list({(word() if rng.random() < 0.6 else f"{word()} {word()}").lower() for _ in range(60)})[:40] + ["AB", "aa aa"]
    texts = [(i, "".join(rng.choices(["a", "aa", "b", "é", "1", "-", "_", " ", ".", "aa aa aa"], k=200))) for i in range(30)] + [(30, None), (31, ""), (32, "İ ẞ ΑΣ aa")]
    rows = spark.createDataFrame(texts, "k int, thinking string")
    by_expressions = sorted(t.count_mentions(rows, names).collect())
    monkeypatch.setattr(t, "MOST_EXPRESSIONS", 0)
    walked = t.count_mentions(rows, names)
    assert sorted(walked.collect()) == by_expressions and walked.columns == ["k", "code_idx", "code_name", "cnt"]
    assert sum(r.cnt for r in by_expressions) > 1000


def test_five_thousand_names(spark, data):
    """Names that texts hold and many that they don't: the same places and counts as of the few alone."""
    names = [f"name{i} of{i}" if i % 2 else f"name{i}" for i in range(5_000)]
    names[10], names[4_000], names[4_999] = "the", "and", "of the"
    docs = t.table(spark, data, "documents").select("doc_id", "text")
    few = {0: 10, 1: 4_000, 2: 4_999}
    some = an.extract_sequence(docs, ["the", "and", "of the"], ["doc_id"]).collect()
    many = an.extract_sequence(docs, names, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.pos, few[r.code_idx]) for r in some) == sorted(map(tuple, many)) and some
    thinking = docs.select("doc_id", F.col("text").alias("thinking"))
    counted = t.count_mentions(thinking, names).where("cnt > 0").select("doc_id", "code_name", "cnt")
    assert sorted(map(tuple, counted.collect())) == sorted((r.doc_id, r.code_name, r.cnt) for r in t.count_mentions(thinking, ["the", "and", "of the"]).where("cnt > 0").collect())
