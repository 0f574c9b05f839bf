"""Steps that work off their input in pieces of bounded size."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marginalia.functions import annotations as an
from marginalia.functions import text as fx
from marginalia.plans import experiments, registered


def test_texts_of_a_batch_are_cut_in_slices():
    texts = ["word. " * n for n in (10, 40_000, 300_000, 1, 90_000)] * 4 + ["", None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts)})
    made = list(an.cut_batches(iter([batch, batch.slice(0, 0)]), 250, 50))
    assert len(made) > 8 and max(x.nbytes for x in made) < 3 << 20  # one text alone is 1.8 MB
    got = {}
    for x in made:
        for r in x.to_pylist():
            got.setdefault(r["id"], []).append(r["text"])
            assert r["part_idx"] == len(got[r["id"]]) - 1
    assert got == {i: an.cut_words(x or "", 250, 50) for i, x in enumerate(texts)}


def test_a_task_takes_one_pair_of_blocks_at_a_time(spark):
    """What a pair of blocks gives is out before the next pair is taken up, and no vector becomes a Python list."""
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "id long, v array<double>")
    met = experiments._met_blocks(rows, 10)
    sizes = experiments._of_block_pairs(met, lambda q, b, same: [np.array([len(q)]), np.array([len(b)]), np.array([int(same)])], "q long, b long, same long").collect()
    assert len(sizes) == 10 and sum(r.q for r in sizes if r.same) == 40
    i, j, c = experiments._close_pairs(pa.array([{"id": 1, "v": [3.0, 4.0]}, {"id": 2, "v": [0.0, 0.0]}]), pa.array([{"id": 9, "v": [6.0, 8.0]}, {"id": 1, "v": [3.0, 4.0]}]), False, 0.9)
    assert (i.tolist(), j.tolist(), np.round(c, 9).tolist()) == ([1], [9], [1.0])


def test_each_distinct_answer_is_rewritten_once(spark):
    """The table of forms has a row a distinct answer, null as empty; every row of the input stays."""
    rows = spark.createDataFrame([(i, (r"\dfrac17", "3 t", None, "")[i % 4]) for i in range(200)], "id long, text string")
    found = fx.with_math_normal(rows, "text", "answer")
    assert {(r.id, r.answer) for r in found.collect()} == {(i, (r"\frac{1}{7}", "3", "", "")[i % 4]) for i in range(200)}
    assert found.columns == ["id", "text", "answer"] and "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def shuffle_files(spark):
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for top in tops for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_what_blocks_write_does_not_grow_with_their_pairs(spark):
    """Ten times the blocks have a hundred times the pairs, and still each vector is dealt out once."""
    x = np.random.default_rng(5).normal(size=(800, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").localCheckpoint()
    size, pairs = [], []
    for block in (200, 20):
        before = shuffle_files(spark)
        met = experiments._of_block_pairs(experiments._met_blocks(rows, block), lambda q, b, same: [np.array([len(q) * (len(q) - 1) // 2 if same else len(q) * len(b)])], "n long")
        pairs.append((met.count(), met.groupBy().sum("n").first()[0]))
        size.append(sum(n for f, n in shuffle_files(spark).items() if f not in before))
    assert pairs == [(4 * 5 // 2, 800 * 799 // 2), (40 * 41 // 2, 800 * 799 // 2)]
    assert size[0] > x.nbytes / 2 and size[1] < 2 * size[0]


@pytest.mark.parametrize("same", [True, False])
def test_links_of_two_blocks_in_slices(monkeypatch, same):
    """Whole classes, ties at the least cosine, ids that repeat, a zero and a NaN vector, against all pairs in double."""
    monkeypatch.setattr(experiments, "SLICE", 7)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 3))
    made = [[float(a), float(b), 0.0] for a in range(-4, 5) for b in range(-3, 4)] + (centres[rng.integers(0, 6, 40)] + 0.05 * rng.normal(size=(40, 3))).tolist() + [[float("nan"), 1.0, 0.0]]
    rows = [{"id": int(i), "v": v} for i, v in zip(rng.integers(0, 300, len(made)), made, strict=True)]
    q, b = (rows, rows) if same else (rows[::2], rows[1::2])
    want, parent = {}, {r["id"]: r["id"] for r in rows}
    for k, r in enumerate(q):
        for o in b[k + 1 :] if same else b:
            if r["id"] != o["id"] and experiments._cosines(np.array([r["v"]]), np.array([o["v"]]))[0] >= 0.6:
                for x in (r["id"], o["id"]):
                    want[x] = want.get(x, 0) + 1
                low, high = sorted((parent[r["id"]], parent[o["id"]]))
                parent = {x: low if p == high else p for x, p in parent.items()}
    ids, roots, links = experiments._linked(pa.array(q), pa.array(b), same, 0.6)
    assert {i: (r, n) for i, r, n in zip(ids.tolist(), roots.tolist(), links.tolist(), strict=True)} == {i: (parent[i], n) for i, n in want.items()}


def test_similar_codes_at_the_least_cosine_are_those_of_sql(spark, tmp_path):
    """(-4, -2) and (-4, 2) have 0.6 on paper, but a little less by the query's sums."""
    rows = [{"vec_id": 3 * i, "embedding": v, "label": 0} for i, v in enumerate([[float(a), float(b), 0.0] for a in range(-4, 5) for b in range(-2, 3) if a or b])]
    pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])), tmp_path / "embeddings.parquet")
    found = duckdb.connect()
    found.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = sorted(found.execute(registered.SQL["j12_similar_code_pairs"]).fetchall())
    assert sorted(map(tuple, registered.QUERIES["j12_similar_code_pairs"](spark, str(tmp_path)).select("id", "class_id", "links").collect())) == want
