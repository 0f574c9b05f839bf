"""Batched calls with a log, the version tree of a taxonomy, and loops that go on where they stopped."""

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.operators import calls, versions
from marginalia.plans import experiments
from marginalia.sources import tables as t
from marginalia.sources.scratch import shared_dir


def told(folder):
    """The digests that a service was asked for and answered, call by call."""
    return [json.loads(x.read_text()) for x in folder.iterdir()]


def service(folder, fails=lambda p: False, lost=None):
    """Answers with the prompt in capitals and writes down what it answered; prompts for which ``fails`` holds break their batch."""

    def call(batch):
        if lost and any(p.user == lost for p in batch):
            time.sleep(4)
            raise KeyboardInterrupt
        if any(fails(p) for p in batch):
            raise RuntimeError("overloaded")
        (folder / uuid.uuid4().hex).write_text(json.dumps([[p.sample_id, p.digest] for p in batch]))
        return [p.user.upper() for p in batch]

    return call


def prompts_of(spark, n):
    return spark.createDataFrame([(f"s{i}", "sys", f"text {i} " + "word " * (i % 5)) for i in range(n)], "sample_id string, system string, user string")


def test_batches_keep_the_budget_and_halve():
    make = lambda n, a: calls.Prompt(str(n), "d", a, "", "")
    sizes = [5, 5, 5, 30, 5, 5]
    batches = list(calls.packed([make(i, 1) for i in range(6)], sizes, 10, 3))
    assert [[p.sample_id for p in b] for b in batches] == [["0", "1"], ["2"], ["3"], ["4", "5"]]
    assert [len(b) for b in calls.packed([make(i, 2) for i in range(3)], [5, 5, 5], 10, 3)] == [1, 1, 1]
    assert [len(b) for b in calls.packed([make(i, 3) for i in range(3)], [0, 0, 0], 10, 3)] == [1, 1, 1]
    assert list(calls.packed([], [], 10, 3)) == []


def test_answers_that_do_not_fit_are_failures():
    batch = [calls.Prompt("a", "d", 1, "", ""), calls.Prompt("b", "e", 1, "", "")]
    assert [x[3:5] for x in calls.outcomes(lambda b: ["x", None], batch)] == [(True, "x"), (False, None)]
    assert {x[3] for x in calls.outcomes(lambda b: ["x"], batch)} == {False}


def test_a_failing_service_gives_the_same_answers(spark, tmp_path):
    """Each batch that holds a doomed first attempt breaks; each prompt is answered once, and never again by a later run."""
    sound, flaky, heard = tmp_path / "sound", tmp_path / "flaky", tmp_path / "heard"
    sound.mkdir(), heard.mkdir()
    prompts = prompts_of(spark, 200)
    want = sorted((r.sample_id, r.text) for r in calls.ask(prompts, service(sound), str(tmp_path / "log0"), budget=20, tasks=4).collect())
    call = service(heard, lambda p: p.attempt == 1 and p.digest[0] in "01")
    got = calls.ask(prompts, call, str(tmp_path / "log1"), budget=20, tasks=4)
    assert sorted((r.sample_id, r.text) for r in got.collect()) == want and len(want) == 200
    assert {r.attempt for r in got.collect()} >= {1, 2}
    asked = [tuple(x) for batch in told(heard) for x in batch]
    assert len(asked) == len(set(asked)) == 200 and max(len(b) for b in told(heard)) > 1
    more = prompts_of(spark, 210).unionByName(prompts_of(spark, 210))
    assert calls.ask(more, call, str(tmp_path / "log1"), budget=20, tasks=4).count() == 210
    asked = [tuple(x) for batch in told(heard) for x in batch]
    assert len(asked) == len(set(asked)) == 210
    assert calls.quarantined(prompts, str(tmp_path / "log1")).isEmpty()


def test_texts_are_written_once_and_those_of_failures_once_more(spark, tmp_path):
    heard, folder = tmp_path / "heard", shared_dir(spark)
    heard.mkdir()
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    call = service(heard, lambda p: p.attempt == 1 and p.digest[0] in "01")
    assert calls.ask(prompts_of(spark, 200), call, str(tmp_path / "log"), budget=20, tasks=4).count() == 200
    failed = spark.read.schema(calls.LOG).parquet(str(tmp_path / "log")).where("NOT ok").count()
    tables = [x for x in set(os.listdir(folder)) - before if x.startswith(("prompts-", "pending-"))]
    assert sum(spark.read.schema("user string").parquet(f"{folder}/{x}").where("user IS NOT NULL").count() for x in tables) == 200 + failed
    assert failed > 10


def test_prompts_that_always_fail_are_set_apart(spark, tmp_path):
    heard = tmp_path / "heard"
    heard.mkdir()
    prompts = prompts_of(spark, 40).unionByName(spark.createDataFrame([("null", None, None)], "sample_id string, system string, user string"))
    call = service(heard, lambda p: p.sample_id in ("s3", "s7"))
    got = calls.ask(prompts, call, str(tmp_path / "log"), budget=1_000, tasks=1)
    assert {r.sample_id for r in got.collect()} == {f"s{i}" for i in range(40)} - {"s3", "s7"} | {"null"}
    bad = calls.quarantined(prompts, str(tmp_path / "log")).collect()
    assert sorted((r.sample_id, r.attempts, r.error) for r in bad) == [("s3", 3, "RuntimeError: overloaded"), ("s7", 3, "RuntimeError: overloaded")]
    before = len(told(heard))
    calls.ask(prompts, call, str(tmp_path / "log"), budget=1_000, tasks=1).collect()
    assert len(told(heard)) == before


def test_a_lost_job_keeps_what_its_tasks_committed(spark, tmp_path):
    heard = tmp_path / "heard"
    heard.mkdir()
    prompts, log = prompts_of(spark, 60), str(tmp_path / "log")
    with pytest.raises(Exception, match="(?s)."):
        calls.ask(prompts, service(heard, lost="text 5 "), log, budget=10, tasks=6)
    kept = spark.read.schema(calls.LOG).parquet(log).where("ok").select("sample_id", "digest").collect()
    assert 20 <= len(kept) < 60
    first = len(told(heard))
    later = tmp_path / "later"
    later.mkdir()
    assert calls.ask(prompts, service(later), log, budget=10, tasks=6).count() == 60
    again = {tuple(x) for batch in told(later) for x in batch}
    assert again.isdisjoint(map(tuple, kept)) and len(again) + len(kept) == 60 and first


def test_prompted_annotator_gives_the_facts_of_the_lexical_one(spark, data, tmp_path):
    samples, codes = t.traces(spark, data), ["the", "of", "la"]
    doomed = lambda p: p.attempt == 1 and p.digest[0] in "0123"

    def call(batch):
        if any(doomed(p) for p in batch):
            raise RuntimeError("overloaded")
        return experiments.lexical_call(batch)

    annotate = experiments.prompted_annotator(call, str(tmp_path / "log"), tasks=4)
    want = experiments.lexical_annotator(samples, codes)
    got = annotate(samples, codes)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# ---- versions ---------------------------------------------------------------


def test_versions_against_a_replay(spark):
    import random

    rng = random.Random(5)
    rows, books = [], {}
    for v in range(40):
        parent = rng.randrange(v) if v else None
        book = dict(books[parent]) if v else {}
        for step in range(rng.randint(0, 3)):
            name, put = f"c{rng.randrange(6)}", rng.random() < 0.7
            book.pop(name, None)
            if put:
                book[name] = f"v{v}s{step}"
            rows.append((v, parent, step, "put" if put else "remove", name, f"v{v}s{step}" if put else None))
        if not any(r[0] == v for r in rows):
            rows.append((v, parent, 0, None, None, None))
        books[v] = book
    events = spark.createDataFrame(rows, versions.EVENTS)
    found = {v: [] for v in books}
    for r in versions.codebooks(events, events.select("version")).orderBy("version", "code_idx").collect():
        found[r.version].append((r.code_name, r.definition))
    assert found == {v: list(b.items()) for v, b in books.items()}
    assert {r.version for r in versions.leaves(events).collect()} == set(books) - {r[1] for r in rows}
    circle = spark.createDataFrame([(1, 2, 0, "put", "a", "x"), (2, 1, 0, "put", "b", "y")], versions.EVENTS)
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        versions.codebooks(circle, circle.select("version"), most=5).collect()


def test_a_stopped_loop_goes_on_to_the_same_table(spark, data, tmp_path):
    samples, seeds = t.traces(spark, data), ["the", "and"]
    asked = []

    def annotate(rows, codes):
        asked.append(len(codes))
        if len(asked) == 3:
            raise RuntimeError("stopped")
        return experiments.lexical_annotator(rows, codes)

    whole, codes = experiments.grow_taxonomy(spark, samples, seeds, rounds=4, per_round=None, max_codes=12)
    run = str(tmp_path / "run")
    with pytest.raises(RuntimeError, match="stopped"):
        experiments.grow_taxonomy(spark, samples, seeds, rounds=4, per_round=None, max_codes=12, annotate=annotate, run=run)
    resumed, again = experiments.grow_taxonomy(spark, samples, seeds, rounds=4, per_round=None, max_codes=12, annotate=annotate, run=run)
    assert again == codes and sorted(resumed.collect()) == sorted(whole.collect())
    assert asked == [2, 3, 4, 4, 5]
    for n in range(4):
        assert spark.read.parquet(f"{run}/facts/part={n}").select(F.count_distinct("doc_id")).first()[0] < samples.count()
