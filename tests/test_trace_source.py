"""The format of trace files: the same rows as the scan, and filters that reach the folders."""

import os
import time

import pytest

from marginalia.sources import scan, tables, trace_source
from marginalia.streaming import incremental

BODY = "### QUESTION:\nwhat {i}\n### THINKING:\n<think>a long enough thought {i}</think>\n### ANSWER:\n{i}"


@pytest.fixture
def base(tmp_path):
    for m in ("m1", "m2", "model=m3", "_temporary"):
        (tmp_path / m).mkdir()
        for i in range(12):
            (tmp_path / m / f"set_question_id_{i}_x.txt").write_text(BODY.format(i=i))
        (tmp_path / m / "set_question_id_sample_77.txt").write_text("### ANSWER:\nonly é")
        (tmp_path / m / "set_question_id_88.txt").write_bytes(b"")
        for other in ("set_question_id_9_raw_output.txt", "set_no_id.txt", "set_question_id_5.json", "_question_id_6.txt"):
            (tmp_path / m / other).write_text("x")
    return tmp_path


def test_same_rows_as_the_scan(spark, base):
    """But for empty files, of which Spark's text source makes no row, and for folders with an underscore, which a pattern of names takes in."""
    scanned = scan.scan_traces(spark, str(base), "*m[0-9]/*.txt").collect()
    want = sorted([*map(tuple, scanned), *((m, "88", "", "", "") for m in ("m1", "m2", "m3"))])
    for shares, path in ((1, str(base)), (5, f"file://{base}")):
        assert sorted(map(tuple, trace_source.load_traces(spark, path, shares=shares).collect())) == want
    assert len(want) == 3 * 14


def test_a_filter_on_a_model_lists_its_folder_alone(spark, base):
    """Three tasks a folder: those of the other models are not planned."""
    found = trace_source.load_traces(spark, str(base), ["m2"], shares=3)
    assert found.rdd.getNumPartitions() == 3 and found.count() == 14
    everything = trace_source.load_traces(spark, str(base), shares=3)
    assert everything.rdd.getNumPartitions() == 9
    both = everything.where("model IN ('m1', 'm3') AND question_id = '77'").collect()
    assert sorted((r.model, r.thinking) for r in both) == [("m1", "only é"), ("m3", "only é")]
    assert trace_source.load_traces(spark, str(base), ["nobody"]).collect() == []


def test_filters_that_the_source_takes():
    reader = trace_source.TraceReader("/nowhere", 2, [])
    other = trace_source.EqualTo(("question_id",), "3")
    kept = list(reader.pushFilters([trace_source.EqualTo(("model",), "a"), trace_source.In(("model",), ("a", "b")), other]))
    assert kept == [other] and reader.models == {"a"}


@pytest.mark.parametrize(("name", "want"), [("x_question_id_12_y.txt", "12"), ("question_id_sample_3.txt", "3"), ("file=question_id_4/part-0.txt", "4"), ("question_id_4.json", None), ("question_id_x.txt", None), ("a/_question_id_1.txt", None)])
def test_question_of(name, want):
    assert trace_source.question_of(name) == want


def test_a_stream_of_traces_feeds_the_counts(spark, tmp_path):
    """Three runs over the same folder: new files come once, a file that is written anew replaces its trace, and what isn't settled waits."""
    base, state = tmp_path / "in", str(tmp_path / "state")

    def put(model, question, thinking, ago):
        (base / model).mkdir(parents=True, exist_ok=True)
        path = base / model / f"set_question_id_{question}.txt"
        path.write_text(f"### QUESTION:\nq\n### THINKING:\n<think>{thinking} and a long enough thought</think>\n### ANSWER:\n1")
        os.utime(path, (time.time() - ago,) * 2)

    def counts():
        traces = trace_source.stream_traces(spark, str(base), shares=2, settle=60)
        facts = tables.count_mentions(traces.select("model", "question_id", "version", "thinking"), ["wait", "so"])
        return {(r.code_name, r.model): r.n for r in incremental.incremental_counts(trace_source.sample_facts(facts, "train"), state).collect()}

    for i in range(5):
        put("m1", i, "wait" if i < 3 else "so", 1000)
    put("m2", 0, "so so", 1000)
    put("m2", 1, "wait", 0)
    first = {("wait", "m1"): 3, ("so", "m1"): 2, ("wait", "m2"): 0, ("so", "m2"): 1}
    assert counts() == first
    assert counts() == first
    put("m1", 0, "so", 61)
    put("m3", 9, "wait so", 61)
    time.sleep(0.01)
    assert counts() == {**first, ("wait", "m1"): 2, ("so", "m1"): 3, ("wait", "m3"): 1, ("so", "m3"): 1}


def test_files_are_written_by_tasks_and_again_without_traces_of_a_lost_one(spark, tmp_path):
    """A file a row, right in its folder: no folder a file, nothing hidden left, and the scan lists them in tasks (4 a model)."""
    rows = spark.range(30).selectExpr("concat('m', id % 2) AS folder", "concat('set_question_id_', id, '.txt') AS name", "CASE WHEN id <> 7 THEN concat('### ANSWER:\nthe answer ', id) END AS value").repartition(5)
    for _ in range(2):
        trace_source.write_files(rows, f"file://{tmp_path}/made")
    files = [x.relative_to(tmp_path / "made").as_posix() for x in (tmp_path / "made").rglob("*") if x.is_file()]
    assert sorted(files) == sorted(f"m{i % 2}/set_question_id_{i}.txt" for i in range(30))
    found = scan.scan_traces(spark, f"file://{tmp_path}/made")
    assert found.rdd.getNumPartitions() == 8
    assert sorted((r.model, int(r.question_id), r.thinking) for r in found.collect()) == sorted((f"m{i % 2}", i, f"the answer {i}") for i in range(30) if i != 7)
    assert scan.scan_traces(spark, str(tmp_path / "made"), "m1/*_2?.txt").count() == 5
    trace_source.write_files(rows.limit(0), str(tmp_path / "none"))
    assert scan.scan_traces(spark, str(tmp_path / "none")).collect() == []
