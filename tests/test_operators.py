"""Taxonomy, agreement, imputation and experiments on small inputs, and metamorphic checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import names as name_index
from marginalia.operators import agreement, classify, codebook, pairs, sequences, stats, vectors
from marginalia.plans import experiments
from marginalia.sources import scan
from marginalia.sources import tables as t


def test_numbered_matches_a_window(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 40_000) for i in range(50)], "k string, i long")
    got = {(r.k, r.i): r.n for r in t.numbered(rows, ["k"], "i", "n").collect()}
    for k in "ab":
        assert [got[k, i * 40_000] for i in range(50) if (k, i * 40_000) in got] == list(range(sum(1 for x in got if x[0] == k)))


def test_count_mentions_of_words_phrases_and_hyphens(spark):
    rows = spark.createDataFrame([("s", "Self-check: the self-check, SELF-CHECKS. Going back; going  back, going back_ the_x thé")], "k string, thinking string")
    got = {r.code_name: r.cnt for r in t.count_mentions(rows, ["self-check", "Going back", "the", "back_"]).collect()}
    assert got == {"self-check": 2, "Going back": 2, "the": 1, "back_": 1}
    assert {r.cnt for r in t.count_mentions(spark.createDataFrame([("s", None)], "k string, thinking string")).collect()} == {0}


def test_average_linkage_and_groups(spark):
    rows = [(0, 0, 1.0), (1, 0, 0.99), (1, 1, math.sqrt(1 - 0.99**2)), (2, 2, 1.0), (3, 2, 0.98), (3, 3, math.sqrt(1 - 0.98**2)), (4, 5, 1.0)]
    found = codebook.group_similar_codes(spark.createDataFrame(rows, "code_idx int, dim int, x double"), 0.85)
    assert sorted((r.group, r.code_idx) for r in found.collect()) == [(0, 0), (0, 1), (2, 2), (2, 3)]
    assert one_merge_at_a_time([1, 2, 3], {(1, 2): 0.9, (2, 3): 0.9, (1, 3): 0.0}, 0.15) == [[1, 2], [3]]


def one_merge_at_a_time(names, cosine, cut):
    """Average linkage as it is defined."""
    groups = [[x] for x in sorted(names)]
    gap = lambda a, b: round(float(np.mean([1 - cosine.get((min(x, y), max(x, y)), 0.0) for x in a for y in b])), 9)
    while len(groups) > 1:
        d, i, j = min((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d >= cut:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


@pytest.mark.parametrize("cut", [0.4, 0.8])
def test_average_linkage_in_rounds(spark, cut):
    rng = np.random.default_rng(int(cut * 10))
    cosine = {(i, j): round(float(rng.random()), 3) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.6}
    rows = spark.createDataFrame([(a, b, c) for (a, b), c in cosine.items()], "a int, b int, s double")
    found = {}
    for r in codebook.average_linkage(rows, spark.createDataFrame([(i,) for i in range(24)], "code_idx int"), cut).collect():
        found.setdefault(r.group, []).append(r.code_idx)
    assert sorted(sorted(x) for x in found.values()) == sorted(one_merge_at_a_time(range(24), cosine, cut))
    assert all(g == min(x) for g, x in found.items())


def test_groups_of_similar_items_against_all_merges(spark, data):
    from marginalia.plans.text_queries import named_items

    embedded = codebook.embed_codes(named_items(spark, data))
    vectors_ = {}
    for r in embedded.collect():
        vectors_.setdefault(r.code_idx, {})[r.dim] = r.x
    names = sorted(vectors_)
    cosine = {(a, b): sum(x * vectors_[b].get(d, 0.0) for d, x in vectors_[a].items()) for a in names for b in names if a < b}
    want = {(g[0], c) for g in one_merge_at_a_time(names, cosine, 1 - 0.35) if len(g) > 1 for c in g}
    assert {(r.group, r.code_idx) for r in codebook.group_similar_codes(embedded, 0.35).collect()} == want


def test_incremental_counts_follow_the_newest_annotations(spark, tmp_path):
    """Several versions of a sample in one file, in later files, and late ones, against the counts over all newest versions."""
    from marginalia.streaming import incremental

    schema = "split string, model string, sample_id string, version int, annotation string"
    note = lambda **counts: "\n".join(f"### {c}\nCount in OUTPUT A: {n}" for c, n in counts.items())
    files = [
        [("train", "m", "1", 1, note(x=1, y=0)), ("train", "m", "2", 3, note(x=2)), ("train", "m", "3", 1, note(x=1)), ("train", "m", "3", 2, note(y=4))],
        [("train", "m", "1", 2, note(x=0, y=5, z=1)), ("train", "m", "2", 1, note(y=9)), ("eval", "m", "1", 1, note(x=1))],
        [("train", "m", "1", 2, note(x=7)), ("train", "k", "1", 1, None), ("train", "m", "3", 5, note(y=0))],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {(r.split, r.code_name, r.model): r.n for r in incremental.run_incremental(spark, str(tmp_path / "in"), schema).collect()}
    assert got == {("train", "x", "m"): 1, ("train", "y", "m"): 1, ("train", "z", "m"): 1, ("eval", "x", "m"): 1}


NOTES = "split string, model string, sample_id string, version int, annotation string"


def put_notes(spark, folder, rows):
    """(sample, version, {code: count}) as one file of annotations."""
    text = lambda counts: "\n".join(f"### {c}\nCount in OUTPUT A: {n}" for c, n in counts.items())
    spark.createDataFrame([("train", "m", s, v, text(c)) for s, v, c in rows], NOTES).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_counts_go_on_and_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    """The last batch of both streams loses its commit, as after a crash, and runs again; samples are split over many small Arrow batches."""
    import random
    from pathlib import Path

    from marginalia.streaming import incremental

    rng = random.Random(5)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    draw = lambda: [(str(rng.randrange(12)), rng.randrange(6), {c: rng.randrange(2) for c in "abcdefg"}) for _ in range(15)]
    seen = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for step in range(3):
            rows = list({(s, v): (s, v, c) for s, v, c in draw()}.values())
            put_notes(spark, source, [r for r in rows if (r[0], r[1]) not in {(s, v) for s, v, _ in seen}])
            seen += [r for r in rows if (r[0], r[1]) not in {(s, v) for s, v, _ in seen}]
            newest = {}
            for s, v, c in seen:
                if s not in newest or v > newest[s][0]:
                    newest[s] = (v, c)
            want = {c: sum(codes[c] for _, codes in newest.values()) for c in "abcdefg"}
            for again in range(2 if step == 1 else 1):
                if again:
                    for stream in ("samples", "counts"):
                        last = max((p for p in (Path(state) / stream / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
                        for file in (last, last.with_name(f".{last.name}.crc")):
                            file.unlink(missing_ok=True)
                got = {r.code_name: r.n for r in incremental.run_incremental(spark, source, NOTES, folder=state).collect()}
                assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert spark.read.format("statestore").load(f"{state}/counts").count() == 7  # what a reader of the counts reads


def test_incremental_state_is_a_value_a_range_of_samples(spark, tmp_path):
    """400 samples of one model, and a null one, in two versions: the state has no value a sample, and the counts are those of the newest."""
    from marginalia.streaming import incremental

    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    ids = [*map(str, range(400)), None]
    put_notes(spark, source, [(s, 1, {"x": 1, "y": i % 2}) for i, s in enumerate(ids)])
    put_notes(spark, source, [(s, 2, {"x": i % 4 // 3, "z": 1}) for i, s in enumerate(ids) if i % 2])
    got = {r.code_name: r.n for r in incremental.run_incremental(spark, source, NOTES, folder=state).collect()}
    assert got == {"x": 301, "y": 0, "z": 200}
    stored = spark.read.format("statestore").option("stateVarName", "newest").load(f"{state}/samples")
    assert stored.count() <= incremental.RANGES


def test_samples_that_nothing_newer_reaches_leave_the_counts(spark, tmp_path):
    import time

    from marginalia.streaming import incremental

    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    run = lambda keep: {r.code_name: r.n for r in incremental.run_incremental(spark, source, NOTES, 10, state, keep).collect()}
    put_notes(spark, source, [("1", 1, {"x": 1, "y": 2}), ("2", 1, {"x": 3})])
    assert run(8_000) == {"x": 2, "y": 1}
    time.sleep(8.5)
    put_notes(spark, source, [("3", 1, {"y": 1})])
    assert run(8_000) == {"x": 0, "y": 1}
    put_notes(spark, source, [("1", 1, {"x": 1})])
    assert run(8_000) == {"x": 1, "y": 1}


def test_fuzzy_match_ties_go_to_the_first(spark):
    names = spark.createDataFrame([("backtracking",), ("zzz",)], "name string")
    options = spark.createDataFrame([(0, "Backtrackings"), (1, "backtracking"), (2, "Backtracking")], "ord int, candidate string")
    assert [tuple(r) for r in name_index.fuzzy_match(names, options).collect()] == [("backtracking", "backtracking", 100)]


@pytest.mark.parametrize(("least", "mode"), [(80, "character"), (90, "character"), (50, "character"), (80, "token"), (90, "token")])
def test_fuzzy_match_against_brute_force(spark, least, mode):
    import random

    from marginalia.functions import annotations as an

    rng = random.Random(least)
    words = ["back", "track", "ing", "check", "the", "sum", "Plan", "a", "é", "İx", "step-by", "case"]
    draw = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 5])))

    def spoilt(x):
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            i = rng.randrange(len(x) + 1)
            x = x[:i] + rng.choice(["", "q", "e", x[i : i + 1] * 2]) + x[i + rng.choice([0, 1]) :]
        return x

    candidates = [(i, draw()) for i in range(150)] + [(200, ""), (201, "a"), (202, "ab"), (203, "aaaaaaaaaa"), (1, "the sum")]
    names = [spoilt(x) for _, x in candidates for _ in range(2)] + ["", "a", "b", "ba", "aaaaaaaaa", "AB", "nothing like it at all"] * 2
    alike = an.token_set_similarity if mode == "token" else an.similarity
    want = {}
    for x in set(names):
        score, order, found = min((-alike(x, c), i, c) for i, c in candidates)
        if -score >= least:
            want[x] = (found, -score)
    frames = spark.createDataFrame([(x,) for x in names] + [(None,)], "name string"), spark.createDataFrame(candidates, "ord int, candidate string")
    got = {r["name"]: (r.candidate, r.score) for r in name_index.fuzzy_match(*frames, least, mode).collect()}
    assert got == want


def test_alike_names_meet_and_few_others_do(spark):
    names = spark.createDataFrame([(f"some reasoning step number {i:04d} of {'abcdefghij'[i % 10] * 4}",) for i in range(2000)], "name string")
    met = name_index.met(names, names.withColumnRenamed("name", "candidate"), 90, "character")
    rng = np.random.default_rng(0)
    other = spark.createDataFrame([("".join(map(chr, rng.integers(97, 123, 14))),) for _ in range(3000)], "name string")
    few = name_index.met(other, other.withColumnRenamed("name", "candidate"), 90, "character")
    assert met.where("name = candidate").count() == 2000
    assert few.count() * 10 < other.distinct().count() ** 2


def _embedded(spark, codes):
    """Sparse vectors of length 1: a few dimensions that most codes have, some of a group's, some of its own."""
    rng, rows, vectors = np.random.default_rng(codes), [], {}
    for code in range(codes):
        v = np.zeros(1200)
        v[rng.integers(0, 12, 10)] += 1
        v[100 + rng.integers(0, 3) + 3 * (code % (codes // 4))] += 4
        v[rng.integers(600, 1200, 4)] += rng.choice([0, 1, 3])
        vectors[code] = v = v / np.linalg.norm(v)
        rows += [(code, int(d), float(v[d])) for d in np.flatnonzero(v)]
    return spark.createDataFrame(rows, "code_idx int, dim int, x double"), vectors


def test_similar_codes_meet_by_few_dimensions(spark):
    met = []
    for codes in (150, 600):
        embedded, vectors = _embedded(spark, codes)
        m = np.stack(list(vectors.values()))
        cosines = m @ m.T
        want = {(i, j) for i in range(codes) for j in range(i + 1, codes) if cosines[i, j] >= 0.8}
        got = {(r.code_1, r.code_2): r.cosine for r in codebook.similar_codes(embedded, 0.8).collect()}
        assert got.keys() == want and want
        assert all(abs(c - cosines[p]) < 1e-9 for p, c in got.items())
        one, two = (embedded.select(F.col("code_idx").alias(f"c{i}"), "dim") for i in (1, 2))
        every = one.join(two, "dim").where("c1 < c2").select("c1", "c2").distinct().count()
        met.append(codebook.met_codes(embedded, 0.8).count())
        assert met[-1] * 4 < every
    assert met[1] < 8 * met[0]  # four times the codes, of groups as large


def test_common_letters_against_a_table():
    import random

    from marginalia.functions.annotations import common_letters

    rng = random.Random(0)
    for _ in range(300):
        one, two = ("".join(rng.choice("abcé") for _ in range(rng.randrange(0, 80))) for _ in range(2))
        row = [0] * (len(two) + 1)
        for c in one:
            last = 0
            for j, d in enumerate(two, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        assert common_letters(one, two) == row[-1]


def test_update_versions(spark):
    codes = spark.createDataFrame([(0, 0, "a", "d"), (0, 1, "b", "e")], "version int, code_idx int, code_name string, definition string")
    changes = spark.createDataFrame([(0, "add", "c", "new"), (1, "update", "a", "better")], "step int, action string, code_name string, definition string")
    after = codebook.apply_update(codes, changes, 1)
    assert [(r.code_name, r.definition) for r in codebook.latest(after).orderBy("code_idx").collect()] == [("b", "e"), ("c", "new"), ("a", "better")]
    assert {r.code_name: r.change for r in codebook.versions_diff(after, 0, 1).collect()} == {"c": "added", "a": "redefined"}


def test_stop_rule(spark):
    rounds = spark.createDataFrame([(0, 3, 10), (1, 4, 20), (2, 4, 30), (3, 4, 40)], "round int, codes int, samples long")
    assert codebook.should_stop(rounds, max_codes=4)
    assert codebook.should_stop(rounds, patience=2)
    assert not codebook.should_stop(rounds, patience=3)
    assert not codebook.should_stop(rounds, patience=2, least_samples=50)
    assert codebook.should_stop(rounds, max_samples=40)


def test_unknown_methods_are_errors(spark):
    for call in (lambda: classify.classify("nope", None, None), lambda: codebook.prune("nope", None), lambda: vectors.chosen(vectors.IMPUTERS, "nope")):
        with pytest.raises(ValueError, match="unknown method"):
            call()


def _newton(x, y):
    w, a = np.zeros(x.shape[1] + 1), np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([*[1.0] * x.shape[1], 0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    return 1 / (1 + np.exp(-a @ w))


def _points(spark, sizes):
    """Facts of one comparison a size, with the vectors and sides they stand for."""
    rng, rows, of = np.random.default_rng(0), [], {}
    for comparison, size in enumerate(sizes):
        x = rng.poisson(2 + comparison, (size, 3)).astype(float)
        y = (x[:, 0] + rng.normal(size=size) * (comparison + 0.5) > 2 + comparison).astype(float)
        of[comparison] = x, y
        rows += [(comparison, i, int(y[i]), "m", 1000 * comparison + i, c, str(c), int(x[i, c])) for i in range(size) for c in range(3)]
    return spark.createDataFrame(rows, "comparison int, question_id long, side int, model string, doc_id long, code_idx int, code_name string, cnt long"), of


def test_logistic_regression_of_all_comparisons_against_newton(spark):
    facts, of = _points(spark, [60, 200, 35])
    got = {(r.comparison, r.question_id): r.p1 for r in classify.logistic_regression(facts, facts).collect()}
    for comparison, (x, y) in of.items():
        want = _newton(x, y)
        assert max(abs(got[comparison, i] - want[i]) for i in range(len(y))) < 1e-6
    assert len(got) == 295


def test_logistic_regression_takes_as_many_jobs_for_many_comparisons(spark):
    jobs = []
    for sizes in ([60], [60, 55, 50, 45, 40, 35]):
        facts, _ = _points(spark, sizes)
        spark.sparkContext.setJobGroup(f"newton-{len(sizes)}", "")
        classify.logistic_regression(facts, facts, steps=4, tolerance=0).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"newton-{len(sizes)}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_logistic_regression_is_a_method_of_experiments(spark, data):
    from marginalia.plans import experiments

    facts = t.facts(spark, data)
    split = facts.where(~classify.is_eval(F.col("question_id"))), facts.where(classify.is_eval(F.col("question_id")))
    rows = experiments.compare(["vote_soft", "logistic_regression"], *split).collect()
    assert {r.method for r in rows} == {"vote_soft", "logistic_regression"}


def test_knn_vote_counts_each_text_once(spark, data):
    facts = t.facts(spark, data)
    held_out = classify.is_eval(F.col("question_id"))
    (train, of_train), (test, of_test) = _counted(spark, facts.where(~held_out)), _counted(spark, facts.where(held_out))
    assert classify.knn_vote(train, test).count() * 8 == of_test.value
    assert of_train.value + of_test.value == facts.count()


@pytest.mark.parametrize("pivots", [1, 8, 32])
def test_pivot_neighbours_against_brute_force(spark, pivots):
    from marginalia.operators import neighbours

    rng, rows = np.random.default_rng(pivots), []
    for key, size in ((0, 700), (1, 3), (2, 120)):
        centres = rng.normal(size=(6, 4)) * 20
        points = np.round(centres[rng.integers(0, 6, size)] + rng.normal(size=(size, 4)), 1)
        points[size // 2 :: 7] = points[0]  # ties
        rows += [(key, i, i % 2, p.tolist()) for i, p in enumerate(points)]
    base = spark.createDataFrame(rows, "key int, id long, label int, v array<double>")
    queries = base.where("id % 5 = 0").drop("label").unionByName(spark.createDataFrame([(0, 10_000, [500.0, 0.0, 0.0, 0.0]), (9, 1, [0.0] * 4)], "key int, id long, v array<double>"))
    got = {}
    for r in neighbours.pivot_neighbours(queries, base, 5, ("key",), pivots, block=64).collect():
        got.setdefault((r.key, r["query"]), []).append((r["rank"], r.neighbour, round(r.distance, 9)))
    want = {}
    for q in queries.collect():
        found = sorted((float(np.sqrt(((np.array(v) - np.array(q.v)) ** 2).sum())), i) for k, i, _, v in rows if k == q.key)[:5]
        if found:
            want[q.key, q.id] = [(n, i, round(d, 9)) for n, (d, i) in enumerate(found, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want
    placed, asked = neighbours.cells(queries, base, 5, ["key"], pivots)
    compared = asked.groupBy("key", "cell").count().join(placed.groupBy("key", "cell").agg(F.count("*").alias("rows")), ["key", "cell"]).agg(F.sum(F.col("count") * F.col("rows"))).first()[0]
    every = queries.groupBy("key").count().join(base.groupBy("key").agg(F.count("*").alias("rows")), "key").agg(F.sum(F.col("count") * F.col("rows"))).first()[0]
    assert compared <= every and (pivots < 32 or compared * 3 < every)


def test_a_query_meets_no_more_rows_as_the_base_grows(spark):
    from marginalia.operators import neighbours

    rng, met = np.random.default_rng(5), []
    for size in (3_000, 24_000):
        points = rng.integers(0, 10_000, (size, 2))
        base = spark.createDataFrame([(0, i, 0, [float(x), float(y)]) for i, (x, y) in enumerate(points.tolist())], "key int, id long, label int, v array<double>")
        placed, asked = neighbours.cells(base.where("id % 20 = 0").drop("label"), base, 5, ["key"])
        rows = placed.groupBy("cell").agg(F.count("*").alias("rows"))
        met.append(asked.join(rows, "cell").agg(F.sum("rows") / F.count_distinct("id")).first()[0])
    assert met[1] < 2 * met[0]


def _counted(spark, df):
    """``df``, and how many of its rows were read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    return df.mapInPandas(count, df.schema), seen


def test_impute_knn_counts_texts_once(spark, data):
    facts = t.facts_missing(spark, data)
    counted, seen = _counted(spark, facts)
    assert vectors.impute_knn(counted, 3).count() == facts.count() == seen.value


def test_impute_iterative_fills_gaps(spark, data):
    facts = t.facts_missing(spark, data)
    filled = vectors.impute_iterative(facts)
    assert filled.count() == facts.count()
    assert filled.where("value IS NULL").isEmpty()
    known = filled.join(facts.where("cnt IS NOT NULL").select("doc_id", "code_idx", "cnt"), ["doc_id", "code_idx"])
    assert known.where("abs(value - cnt) > 1e-9").isEmpty()


def test_impute_iterative_against_rounds_over_rows(spark):
    rng, rows, of = np.random.default_rng(4), [], {}
    for comparison in (0, 1):
        x = rng.poisson(3, (80, 5)).astype(float)
        x[:, 3] = np.round(x[:, 0] * 1.5 + x[:, 1] + rng.normal(size=80))
        gaps = np.zeros(x.shape, bool)
        gaps[::3, 3:] = True
        gaps[1::7, 2] = True
        gaps[:, 4] |= comparison == 1  # never counted
        of[comparison] = x, gaps
        rows += [(comparison, i, 0, "m", 1000 * comparison + i, c, str(c), None if gaps[i, c] else int(x[i, c])) for i in range(80) for c in range(5)]
    facts = spark.createDataFrame(rows, "comparison int, question_id long, side int, model string, doc_id long, code_idx int, code_name string, cnt long")
    got = {(r.comparison, r.question_id, r.code_idx): r.value for r in vectors.impute_iterative(facts).collect()}
    for comparison, (x, gaps) in of.items():
        v = np.where(gaps, 0, x)
        v = np.where(gaps, v.sum(axis=0) / np.maximum(1, (~gaps).sum(axis=0)), v)
        for _ in range(10):
            for c in np.flatnonzero(gaps.any(axis=0) & ~gaps.all(axis=0)):
                others = [o for o in range(5) if o != c]
                seen, y = v[~gaps[:, c]][:, others], v[~gaps[:, c], c]
                centred = seen - seen.mean(axis=0)
                w = np.linalg.solve(centred.T @ centred / len(y) + 1e-3 * np.eye(4), centred.T @ (y - y.mean()) / len(y))
                v[gaps[:, c], c] = y.mean() + (v[gaps[:, c]][:, others] - seen.mean(axis=0)) @ w
        assert max(abs(got[comparison, i, c] - v[i, c]) for i in range(80) for c in range(5)) < 1e-6


def _swapped(facts):
    return facts.withColumn("side", 1 - F.col("side"))


def test_swapping_sides_changes_nothing_symmetric(spark, data):
    facts = t.facts(spark, data)
    as_rows = lambda f: f.select(F.col("code_idx").alias("dim"), F.col("side").alias("label"), F.col("cnt").alias("x"))
    for score in (stats.score_anova_f, stats.score_chi2, stats.score_mutual_info):
        before, after = (sorted(map(tuple, score(as_rows(f)).withColumn("score", F.round("score", 6)).collect())) for f in (facts, _swapped(facts)))
        assert before == after


def _split(facts):
    held_out = classify.is_eval(F.col("question_id"))
    return facts.where(~held_out), facts.where(held_out)


def test_a_code_never_seen_changes_no_prediction(spark, data):
    facts = t.facts(spark, data)
    extra = facts.where("code_idx = 0").withColumns({"code_idx": F.lit(99), "code_name": F.lit("zzz"), "cnt": F.lit(0).cast("long")})
    for method in ("vote_hard", "centroid_euclidean"):
        before, after = (sorted(map(tuple, classify.resolve(classify.classify(method, *_split(f))).collect())) for f in (facts, facts.unionByName(extra)))
        assert before == after


def test_merging_one_code_is_the_identity(spark, data):
    facts = t.facts(spark, data)
    one = spark.createDataFrame([("the", "the")], "code_name string, merged string")
    merged = {(r.comparison, r.model, r.merged): r.n for r in stats.merged_counts(facts, one).collect()}
    assert merged == {(r.comparison, r.model, r.code_name): r.n for r in stats.code_counts(facts).collect()}


def test_kappa_of_agreeing_runs(spark):
    rows = [(s, r, m, "c", s % 2) for s in range(10) for r in range(3) for m in (0, 1)]
    runs = spark.createDataFrame(rows, "sample_id long, run int, model int, code string, cnt long")
    for kappas in (agreement.fleiss_kappa_binary(runs), agreement.kappa_exact(runs), agreement.kappa_weighted(runs)):
        assert kappas.first()["kappa"] == pytest.approx(1.0)
    constant = runs.withColumn("cnt", F.lit(1).cast("long"))
    assert agreement.fleiss_kappa_binary(constant).first()["kappa"] is None


def test_transition_distance_is_zero_to_itself(spark):
    rows = [(0, 0, i, c) for i, c in enumerate("abab", 1)] + [(1, 1, i, c) for i, c in enumerate("aabb", 1)]
    seq = spark.createDataFrame(rows, "sample_id long, model int, pos long, code string")
    distances = sequences.transition_distances(seq, sequences.transition_means(seq))
    assert {r.sample_id: r.predicted for r in sequences.transition_classifier(distances).collect()} == {0: 0, 1: 1}
    assert max(r.distance for r in distances.where("model = to_model").collect()) < 1e-6


def test_pairs_repeat_the_smaller_side(spark):
    traces = spark.createDataFrame([("q", i) for i in range(5)], "question string, doc_id long")
    status = spark.createDataFrame([(i, "correct" if i < 2 else "wrong") for i in range(5)], "doc_id long, status string")
    assert sorted((r.correct_id, r.wrong_id) for r in pairs.pair_correct_wrong(traces, status, ["question"]).collect()) == [(0, 2), (0, 4), (1, 3)]
    assert pairs.pair_correct_wrong(traces, status, ["question"], 1).count() == 1


def test_taxonomy_grows_until_full(spark, data):
    log = []
    table, codes = experiments.grow_taxonomy(spark, t.traces(spark, data), ["the"], rounds=4, per_round=2, max_codes=3, log=lambda **x: log.append(x))
    assert len(codes) == 3
    assert [r.codes for r in table.orderBy("round").collect()] == [1, 2, 3] == [x["codes"] for x in log]
    fixed, same = experiments.grow_taxonomy(spark, t.traces(spark, data), ["the"], rounds=2, per_round=2, max_codes=3, propose=None)
    assert same == ["the"]


def test_training_loop_of_a_taxonomy(spark, data):
    """Warm start, null facts of later codes, restoring the best version, pruning and epochs."""
    traces, told = t.traces(spark, data), []
    words = iter("alpha beta gamma delta epsilon zeta eta".split())
    table, codes = experiments.train_taxonomy(spark, traces, ["the", "and"], rounds=3, max_codes=4, epochs=2, warm_start=1, patience=0, propose=lambda rows, known: [next(words)], log=lambda **x: told.append(x))
    rows = table.orderBy("epoch", "round").collect()
    assert [(r.epoch, r.round) for r in rows] == [(e, n) for e in range(2) for n in range(3)]
    assert told[0]["codes"] == ["the", "and", "alpha"] and len(codes) <= 4 and {"the", "and"} <= set(codes)
    assert all(r.codes <= 4 for r in rows) and [r.samples for r in rows[:3]] == [r.samples for r in rows[3:]] and rows[2].samples == traces.count()
    for at, r in enumerate(rows[:-1]):
        if r.restored:
            best = max(range(at + 1), key=lambda i: (rows[i].accuracy, -i))
            assert told[at + 1]["codes"] == told[best]["codes"]
    facts = t.facts(spark, data).where("comparison = 0").withColumn("round", F.lit(0))
    dense = experiments._dense(facts.where("code_idx < 2"), t.codebook(spark, ["and", "new"]))
    assert {(r.code_name, r.cnt is None) for r in dense.collect()} == {("and", False), ("new", True)}


def test_transfer_directions_are_all_both_ways(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 3, 12, 12)], "comparison int")
    assert sorted(tuple(r) for r in experiments.directions(rows).collect()) == [(a, b) for a in (0, 3, 12) for b in (0, 3, 12) if a != b]


def test_transfer_keeps_directions_of_large_numbers_apart(spark, data):
    """The same facts under far numbers give the same accuracies: no two directions fall together."""
    facts, last = t.facts(spark, data).where("comparison < 2"), 2**31 - 1
    far = facts.withColumn("comparison", F.when(F.col("comparison") == 0, F.lit(last)).otherwise(F.lit(last - 1)))
    near_ways, far_ways = (spark.createDataFrame(x, "train_on int, test_on int") for x in ([(0, 1), (1, 0)], [(last, last - 1), (last - 1, last)]))
    rows = lambda f, w, name: sorted((name(r.train_on), r.refit, r.n, r.n_correct) for r in experiments.transfer(f, w).collect())
    assert rows(facts, near_ways, lambda x: x) == rows(far, far_ways, lambda x: last - x)


def test_concatenated_training_judges_every_dataset(spark, data):
    traces = t.traces(spark, data)
    got, codes = experiments.train_concat(spark, traces, ["the", "of"], rounds=2, max_codes=9)
    split = pairs.split_traces(pairs.pair_traces(traces).select("comparison", "question_id"), 5, 1, 0.8, ["comparison"], "question_id").where("split = 'eval'")
    want = {r.comparison: r["count"] for r in split.groupBy("comparison").count().collect()}
    assert {r.comparison: r.n for r in got.collect()} == want and len(codes) == 4


def test_rounds_cover_every_trace(spark, data):
    all_traces = t.traces(spark, data)
    whole = experiments.grow_taxonomy(spark, all_traces, ["the"], rounds=3, per_round=None, max_codes=9)[0].orderBy("round").collect()
    assert [r.round for r in whole] == [0, 1, 2]
    assert 0 < whole[0].samples < whole[1].samples < whole[2].samples == all_traces.count()
    few = experiments.grow_taxonomy(spark, all_traces.where("comparison = 0"), ["the"], rounds=1, per_round=5, max_codes=9)[0]
    assert few.first()["samples"] == 5


def test_transfer_zero_shot_to_itself_equals_refit(spark, data):
    facts = t.facts(spark, data)
    ways = spark.createDataFrame([(0, 0), (0, 1)], "train_on int, test_on int")
    got = {(r.train_on, r.test_on, r.refit): r.accuracy for r in experiments.transfer(facts, ways).collect()}
    assert len(got) == 4
    assert got[0, 0, False] == got[0, 0, True]


def test_prompt_records_match_the_schema(spark):
    rows = spark.createDataFrame([(1, "q", "A", "train")], "idx int, question string, gold string, split string")
    made = scan.prompt_records(rows, "d", "a")
    assert [f.dataType.simpleString() for f in made.schema] == [f.dataType.simpleString() for f in scan.PROMPT_SCHEMA]
    assert scan.with_split_label(made, "test").first()["extra_info"]["split"] == "test"


def test_similar_vectors_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    ids = [int(i) for i in rng.permutation(400)[:90]]
    c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(90) for b in range(a) if c[a, b] >= 0.8}
    assert any(a % 20 and b % 20 for a, b in want)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    for block in (16, 1024):
        got = [(r.id_1, r.id_2) for r in experiments.similar_vectors(rows, 0.8, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    parent = {i: i for i in ids}
    for _ in ids:
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    for block in (16, 1024):
        classes = {r.id: (r.class_id, r.links) for r in experiments.similar_classes(rows, 0.8, block).collect()}
        assert classes == {i: (parent[i], sum(i in p for p in want)) for i in ids}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)], "code_1 int, code_2 int")
    assert {(r.code_idx, r.component) for r in codebook.component_labels(edges).collect()} == {(i, 0) for i in range(151)}


def test_concatenated_training_counts_texts_once_for_its_classifier(spark, monkeypatch):
    """The classifier reads facts that are written, not the texts, of which it would count every one once a pass."""
    samples = spark.createDataFrame([(i, f"m{i % 2}", 0, i % 2, i // 2, f"the {'so' if i % 2 else 'of'}") for i in range(40)], "doc_id long, model string, comparison int, side int, question_id long, thinking string")
    read, real = [], experiments.resolved
    monkeypatch.setattr(experiments, "resolved", lambda method, *parts: read.extend(p._jdf.queryExecution().toString() for p in parts) or real(method, *parts))
    got, _ = experiments.train_concat(spark, samples, ["the", "of", "so"], rounds=1, max_codes=3)
    assert [tuple(r)[0] for r in got.collect()] == [0]
    assert len(read) == 2
    assert not any("thinking" in plan for plan in read)


def test_training_counts_words_and_moves_texts_once(spark, monkeypatch):
    """The default update takes its words from one count for all rounds and epochs, and a proposer that counts each batch itself gives the same run."""
    texts = [f"{'wait' if i % 3 else 'so'} {'ok' if i % 2 else 'no'} w{i % 5} the" for i in range(40)]
    samples = spark.createDataFrame([(i, f"m{i % 2}", 0, i % 2, i // 2, x) for i, x in enumerate(texts)], "doc_id long, model string, comparison int, side int, question_id long, thinking string")
    counted = []
    real = experiments.word_sums
    monkeypatch.setattr(experiments, "word_sums", lambda *a: counted.append(a[1:]) or real(*a))
    run = lambda **more: experiments.train_taxonomy(spark, samples, ["the"], rounds=2, max_codes=4, epochs=2, warm_start=1, **more)
    table, codes = run()
    assert counted == [("shares",)]
    again, same = run(propose=lambda batch, known: experiments.most_uneven_word(real(batch), known))
    assert (codes, table.collect()) == (same, again.collect())
