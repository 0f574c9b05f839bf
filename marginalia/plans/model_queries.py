"""Queries on pairs of traces: pairing, splits, classifiers, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import classify, pairs, stats
from marginalia.operators.stats import r6
from marginalia.sources import tables as t

from . import experiments
from .catalog import FACTS, PAIRS, STATUS, TRACES, query, with_views

T_ = with_views(TRACES)
P_ = with_views(TRACES, PAIRS)

# ---- pairing ----------------------------------------------------------------

query("m1_traces", T_ + "SELECT doc_id, model, comparison, side, question_id, length(thinking) AS n_chars FROM traces")(lambda s, d: t.traces(s, d).select("doc_id", "model", "comparison", "side", "question_id", F.length("thinking").cast("long").alias("n_chars")))
query("j1_m2_pair_traces", P_ + "SELECT comparison, question_id, doc_a, doc_b, length(text_a) + length(text_b) AS n_chars FROM pairs")(
    lambda s, d: pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id", "doc_a", "doc_b", (F.length("text_a") + F.length("text_b")).cast("long").alias("n_chars"))
)
query("j2_all_model_pairs", "SELECT a.m AS model_1, b.m AS model_2 FROM (SELECT DISTINCT source AS m FROM documents) a JOIN (SELECT DISTINCT source AS m FROM documents) b ON a.m < b.m")(lambda s, d: pairs.model_pairs(_models(s, d)))
query(
    "j3_cross_model_pairs",
    "SELECT a.l AS model_1, b.m AS model_2, (row_number() OVER (ORDER BY a.l, b.m) - 1) // 2 AS batch FROM (SELECT DISTINCT lang AS l FROM documents) a, (SELECT DISTINCT source AS m FROM documents) b",
)(lambda s, d: pairs.cross_model_pairs(t.table(s, d, "documents").select(F.col("lang").alias("model")).distinct(), _models(s, d)))


def _models(s, d):
    return t.table(s, d, "documents").select(F.col("source").alias("model")).distinct()


_CW = """g AS (SELECT source, doc_id, status FROM documents JOIN status USING (doc_id)),
    k AS (SELECT source, status, doc_id, row_number() OVER (PARTITION BY source, status ORDER BY doc_id) - 1 AS i FROM g),
    n AS (SELECT source, count(*) FILTER (status = 'correct') AS nc, count(*) FILTER (status = 'wrong') AS nw FROM g GROUP BY source),
    slots AS (SELECT source, nc, nw, unnest(range(0, {n})) AS slot FROM n WHERE nc > 0 AND nw > 0)
    SELECT slots.source, slot, c.doc_id AS correct_id, w.doc_id AS wrong_id FROM slots JOIN k c ON c.source = slots.source AND c.status = 'correct' AND c.i = slot % nc JOIN k w ON w.source = slots.source AND w.status = 'wrong' AND w.i = slot % nw"""
for _most in (None, 5):
    query("j4_e17_pair_correct_wrong" + ("_capped" if _most else ""), with_views(STATUS, _CW.format(n=f"least(nc, nw, {_most})" if _most else "greatest(nc, nw)")).rstrip())(
        lambda s, d, m=_most: pairs.pair_correct_wrong(t.table(s, d, "documents").select("source", "doc_id"), t.correctness(s, d), ["source"], m)
    )
query("j6_decontaminate", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND text NOT IN (SELECT text FROM conversations WHERE role = 'user' AND turn > 1 AND text IS NOT NULL)")(
    lambda s, d: pairs.decontaminate(*(t.table(s, d, "conversations").where(f"role = 'user' AND turn {c}") for c in (">= 0", "> 1"))).select("conv_id", "turn")
)
query("j6_decontaminate_documents", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)")(lambda s, d: pairs.decontaminate(t.table(s, d, "documents").select("doc_id", "text"), t.table(s, d, "benchmark")).select("doc_id"))
query("j7_densify", with_views(FACTS) + "SELECT doc_id, code_idx, code_name, cnt FROM facts")(
    lambda s, d: pairs.densify(t.traces(s, d), t.codebook(s), t.facts(s, d).where("cnt > 0"), ["doc_id"])
)
query("j9_match_label", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")(lambda s, d: t.table(s, d, "documents").select("doc_id", "source").join(t.table(s, d, "labels"), "doc_id"))
query("p8_pending_questions", with_views(STATUS) + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM status) OR doc_id IN (SELECT doc_id FROM status WHERE status = 'wrong')")(
    lambda s, d: pairs.pending(t.table(s, d, "documents").select("doc_id"), t.correctness(s, d).select("doc_id"), t.correctness(s, d).where("status = 'wrong'").select("doc_id"), "doc_id")
)
query("p7_empty_trace_report", "SELECT source AS model, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) = 0) AS n_empty, min(length(text)) AS shortest FROM documents GROUP BY ALL")(
    lambda s, d: t.table(s, d, "documents").groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.length(F.coalesce("text", F.lit(""))) == 0).alias("n_empty"), F.min(F.length("text")).cast("long").alias("shortest"))
)

# ---- order, splits, sets ---------------------------------------------------

query(
    "w1_shuffle_pairs",
    P_ + "SELECT comparison, question_id, doc_a, row_number() OVER (PARTITION BY comparison ORDER BY md5('3:' || question_id), question_id)::INT AS place, substring(md5('3:' || question_id), 32, 1) IN ('1','3','5','7','9','b','d','f') AS swap FROM pairs",
)(lambda s, d: pairs.shuffle_pairs(pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id", "doc_a"), 3))
query(
    "w1_shuffle_pairs_balanced",
    P_ + "SELECT comparison, question_id, place, place % 2 = 0 AS swap FROM (SELECT comparison, question_id, row_number() OVER (PARTITION BY comparison ORDER BY md5('3:' || question_id), question_id)::INT AS place FROM pairs)",
)(lambda s, d: pairs.shuffle_pairs(pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id"), 3, balance=True))
_SPLIT = "CASE WHEN a <= 1 THEN 'warmup' WHEN a <= 1 + floor((n - 1) * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('5:' || {id}), {id}) AS a, count(*) OVER (PARTITION BY {by}) AS n FROM {src})"
query("w2_split_warmup_train_eval", P_ + "SELECT comparison, question_id, " + _SPLIT.format(by="comparison", id="question_id", src="pairs"))(
    lambda s, d: pairs.split_traces(pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id"), 5, 1, 0.8, ["comparison"], "question_id")
)
query("w2_e13_split_stratified", "SELECT doc_id, source, lang, " + _SPLIT.format(by="source, lang", id="doc_id", src="documents"))(
    lambda s, d: pairs.split_traces(t.table(s, d, "documents").select("doc_id", "source", "lang"), 5, 1, 0.8, ["source", "lang"], "doc_id")
)
query("s7_scan_split_file", P_ + ", sp AS (SELECT doc_a AS doc_id, " + _SPLIT.format(by="comparison", id="question_id", src="pairs") + ") SELECT doc_id, split, length(text) AS n_chars FROM documents JOIN sp USING (doc_id)")(
    lambda s, d: t.table(s, d, "documents").join(pairs.split_traces(pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id", F.col("doc_a").alias("doc_id")), 5, 1, 0.8, ["comparison"], "question_id").select("doc_id", "split"), "doc_id").select("doc_id", "split", F.length("text").cast("long").alias("n_chars"))
)
query(
    "w3_accumulation_rounds",
    P_ + "SELECT comparison, question_id, epoch::INT AS epoch, (row_number() OVER (PARTITION BY comparison, epoch ORDER BY md5('9:' || epoch || ':' || question_id), question_id) - 1) // 40 AS round FROM (SELECT comparison, question_id, unnest(range(0, 2)) AS epoch FROM pairs)",
)(lambda s, d: pairs.accumulation_rounds(pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id"), 40, 2, 9, ["comparison"], "question_id"))
query(
    "w4_update_draws",
    "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT conv_id * 100 + turn AS draw, i, doc_id FROM (SELECT conv_id, turn, ('0x' || substring(md5('4:' || (conv_id * 100 + turn)), 1, 8))::BIGINT % n AS i FROM conversations, n) JOIN p USING (i)",
)(
    lambda s, d: pairs.update_draws(
        t.numbered(t.table(s, d, "documents").select("doc_id", F.lit(0).alias("one")), ["one"], "doc_id", "i").drop("one"), t.table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("draw")), 4, "i"
    )
)
query("w12_sample_few_shot", P_ + "SELECT comparison, question_id, row_number() OVER (PARTITION BY comparison ORDER BY md5('2:' || question_id), question_id)::INT AS shot FROM pairs QUALIFY shot <= 3")(
    lambda s, d: pairs.few_shot(pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id"), 3, 2, ["comparison"], "question_id")
)
query("w14_w15_m17_reruns", "SELECT doc_id, unnest(range(0, 3))::INT AS run FROM documents")(lambda s, d: pairs.repeated(t.table(s, d, "documents").select("doc_id"), 3))
query("e18_seed_stability_splits", "SELECT seed::INT AS seed, source, count(*) FILTER (md5(seed || ':' || doc_id) < '4') AS n_eval FROM documents, (SELECT unnest(range(0, 4)) AS seed) GROUP BY ALL")(
    lambda s, d: pairs.repeated(t.table(s, d, "documents").select("doc_id", "source"), 4, "seed").groupBy("seed", "source").agg(F.count_if(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("doc_id").cast("string"))) < "4").alias("n_eval"))
)
query("u1_concat_datasets", "SELECT 'documents' AS source, 'documents_' || doc_id AS sample_id FROM documents UNION ALL SELECT 'pages', 'pages_' || page_id FROM pages")(
    lambda s, d: experiments.concat_datasets({"documents": t.table(s, d, "documents").withColumnRenamed("doc_id", "id"), "pages": t.table(s, d, "pages").withColumnRenamed("page_id", "id")}).select("source", "sample_id")
)
_SIDES = "SELECT comparison, question_id FROM traces WHERE side = "
query("u2_shared_ids", T_ + f"{_SIDES}0 INTERSECT {_SIDES}1")(lambda s, d: _side(s, d, 0).intersect(_side(s, d, 1)))
query("u3_missing_ids", T_ + f"({_SIDES}0 EXCEPT ALL {_SIDES}1) UNION ALL ({_SIDES}1 EXCEPT ALL {_SIDES}0)")(lambda s, d: _side(s, d, 0).exceptAll(_side(s, d, 1)).unionByName(_side(s, d, 1).exceptAll(_side(s, d, 0))))


def _side(s, d, side):
    return t.traces(s, d).where(F.col("side") == side).select("comparison", "question_id")


query("u4_s5_m15_status_union", "SELECT o_custkey AS question_id, 'finished' AS status FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1995, 1996) UNION SELECT o_custkey, 'unfinished' FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) IN (1995, 1996)")(
    lambda s, d: experiments.status_sets([t.table(s, d, "orders").where(F.year("o_orderdate") == y).where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("question_id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("unfinished").alias("status")) for y in (1995, 1996)])
)
query("p9_filter_year", "SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) >= 1997")(lambda s, d: t.table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")).where("year >= 1997"))

# ---- classifiers ------------------------------------------------------------

_TT = "train AS MATERIALIZED (SELECT * FROM facts WHERE NOT md5('7:' || question_id) < '4'), test AS MATERIALIZED (SELECT * FROM facts WHERE md5('7:' || question_id) < '4')"
_MC = "mc AS (SELECT comparison, code_idx, count(*) FILTER (side = 0 AND cnt > 0) AS n0, count(*) FILTER (side = 1 AND cnt > 0) AS n1, count(*) FILTER (side = 0) AS t0, count(*) FILTER (side = 1) AS t1 FROM train GROUP BY ALL)"
_JOIN = "FROM test JOIN mc USING (comparison, code_idx) GROUP BY comparison, question_id, side"
_P = "coalesce(n0 / nullif(n0 + n1, 0), 0.5::DOUBLE)"


def _clip(s: int) -> str:
    return f"least(greatest(coalesce(n{s} / nullif(t{s}, 0), 0), 1e-10::DOUBLE), 1 - 1e-10::DOUBLE)"


def _log(p: str) -> str:
    return f"sum(ln(CASE WHEN cnt > 0 THEN {p} ELSE 1 - {p} END))"


_NB = [f"((n{s} + 1e-6::DOUBLE) / (t{s} + 2e-6::DOUBLE))" for s in (0, 1)]
_CENT = "cent AS (SELECT comparison, code_idx, coalesce(avg(cnt) FILTER (side = 0), 0) AS m0, coalesce(avg(cnt) FILTER (side = 1), 0) AS m1 FROM train GROUP BY ALL)"
_KEY = "SELECT comparison, question_id, side, "
SCORES = {
    "vote_soft": _MC + ", scores AS (" + _KEY + f"avg(CASE WHEN cnt > 0 THEN {_P} ELSE 1 - {_P} END) AS p0, 1 - avg(CASE WHEN cnt > 0 THEN {_P} ELSE 1 - {_P} END) AS p1 {_JOIN})",
    "vote_soft_bernoulli": _MC + ", l AS (" + _KEY + f"{_log(_clip(0))} AS l0, {_log(_clip(1))} AS l1 {_JOIN}), scores AS (" + _KEY + "1 / (1 + exp(l1 - l0)) AS p0, 1 / (1 + exp(l0 - l1)) AS p1 FROM l)",
    "vote_hard": _MC + ", scores AS (" + _KEY + f"(count(*) FILTER (cnt > 0 AND n0 > n1))::DOUBLE AS p0, (count(*) FILTER (cnt > 0 AND n1 > n0))::DOUBLE AS p1 {_JOIN})",
    "naive_bayes_bernoulli": _MC + ", scores AS (" + _KEY + f"{_log(_NB[0])} + ln(0.5::DOUBLE) AS p0, {_log(_NB[1])} + ln(0.5::DOUBLE) AS p1 {_JOIN})",
    "naive_bayes_multinomial": """c AS (SELECT comparison, code_idx, coalesce(sum(cnt) FILTER (side = 0), 0) AS c0, coalesce(sum(cnt) FILTER (side = 1), 0) AS c1 FROM train GROUP BY ALL),
        lg AS (SELECT comparison, code_idx, ln((c0 + 1) / (sum(c0) OVER w + count(*) OVER w)) AS l0, ln((c1 + 1) / (sum(c1) OVER w + count(*) OVER w)) AS l1 FROM c WINDOW w AS (PARTITION BY comparison)),
        pr AS (SELECT comparison, count(DISTINCT doc_id) FILTER (side = 0) AS d0, count(DISTINCT doc_id) FILTER (side = 1) AS d1 FROM train GROUP BY comparison),
        scores AS (SELECT comparison, question_id, side, sum(cnt * l0) + any_value(ln(d0 / (d0 + d1))) AS p0, sum(cnt * l1) + any_value(ln(d1 / (d0 + d1))) AS p1 FROM test JOIN lg USING (comparison, code_idx) JOIN pr USING (comparison) GROUP BY ALL)""",
    "centroid_cosine": _CENT + ", scores AS (" + _KEY + ", ".join(f"coalesce(sum(cnt * m{s}) / nullif(sqrt(sum(cnt * cnt)) * sqrt(sum(m{s} * m{s})), 0), 0) AS p{s}" for s in (0, 1)) + " FROM test JOIN cent USING (comparison, code_idx) GROUP BY ALL)",
    "centroid_euclidean": _CENT + ", scores AS (" + _KEY + ", ".join(f"1 / (1 + sqrt(sum((cnt - m{s}) * (cnt - m{s})))) AS p{s}" for s in (0, 1)) + " FROM test JOIN cent USING (comparison, code_idx) GROUP BY ALL)",
    "knn": """qv AS (SELECT comparison, question_id * 2 + side AS id, list(cnt ORDER BY code_idx) AS v FROM test GROUP BY ALL), bv AS (SELECT comparison, question_id * 2 + side AS id, side AS label, list(cnt ORDER BY code_idx) AS v FROM train GROUP BY ALL),
        nn AS (SELECT q.comparison, q.id, b.label FROM qv q JOIN bv b USING (comparison) QUALIFY row_number() OVER (PARTITION BY q.comparison, q.id ORDER BY list_sum(list_transform(list_zip(q.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.id) <= 5),
        scores AS (SELECT comparison, id // 2 AS question_id, (id % 2)::INT AS side, avg((label = 0)::INT) AS p0, 1 - avg((label = 0)::INT) AS p1 FROM nn GROUP BY ALL)""",
}
_ROUNDED = "rs AS MATERIALIZED (SELECT comparison, question_id, side, round(p0, 9) AS p0, round(p1, 9) AS p1 FROM scores)"
_RESOLVED = """r AS (SELECT comparison, question_id, CASE WHEN ba <> bb THEN ba WHEN sa > sb THEN ba ELSE 1 - ba END AS pred0 FROM (SELECT *, CASE WHEN ba = 0 THEN a0 ELSE a1 END AS sa, CASE WHEN ba = 0 THEN b0 ELSE b1 END AS sb FROM
    (SELECT comparison, question_id, x.p0 AS a0, x.p1 AS a1, y.p0 AS b0, y.p1 AS b1, CASE WHEN x.p0 >= x.p1 THEN 0 ELSE 1 END AS ba, CASE WHEN y.p0 >= y.p1 THEN 0 ELSE 1 END AS bb FROM rs x JOIN rs y USING (comparison, question_id) WHERE x.side = 0 AND y.side = 1)))"""


def train_and_test(facts):
    held_out = classify.is_eval(F.col("question_id"))
    return facts.where(~held_out), facts.where(held_out)


def scored(s, d, method):
    scores = classify.classify(method, *train_and_test(t.facts(s, d)))
    return scores.withColumns({p: F.round(p, 9) for p in ("p0", "p1")})


_IDS = {"vote_soft": "c1", "vote_soft_bernoulli": "c2", "vote_hard": "c3", "naive_bayes_bernoulli": "c4", "naive_bayes_multinomial": "c5", "centroid_cosine": "c6", "centroid_euclidean": "c6", "knn": "c7_j11"}
for _method, _sql in SCORES.items():
    query(f"{_IDS[_method]}_{_method}", with_views(FACTS, _TT, _sql) + "SELECT comparison, question_id, side, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM scores")(
        lambda s, d, m=_method: classify.classify(m, *train_and_test(t.facts(s, d))).select("comparison", "question_id", "side", r6(F.col("p0")).alias("p0"), r6(F.col("p1")).alias("p1"))
    )
for _method in ("vote_soft", "naive_bayes_multinomial"):
    query(f"c0_a8_resolve_{_method}", with_views(FACTS, _TT, SCORES[_method], _ROUNDED, _RESOLVED) + "SELECT comparison, question_id, pred0::INT AS pred0, 1 - pred0::INT AS pred1, CASE WHEN pred0 = 0 THEN 'correct' ELSE 'Both wrong' END AS outcome FROM r")(
        lambda s, d, m=_method: classify.resolve(scored(s, d, m))
    )
query("a9_e10_accuracy", with_views(FACTS, _TT, SCORES["naive_bayes_multinomial"], _ROUNDED, _RESOLVED) + "SELECT comparison, count(*) AS n, count(*) FILTER (pred0 = 0) AS n_correct, round(avg((pred0 = 0)::INT) * 100, 6) AS accuracy FROM r GROUP BY comparison")(
    lambda s, d: stats.accuracy(classify.resolve(scored(s, d, "naive_bayes_multinomial")), ["comparison"])
)
query("a33_multi_dataset_accuracy", with_views(FACTS, _TT, SCORES["naive_bayes_multinomial"], _ROUNDED, _RESOLVED) + "SELECT comparison, count(*) AS n, round(avg((pred0 = 0)::INT) * 100, 6) AS accuracy FROM r GROUP BY ROLLUP (comparison)")(
    lambda s, d: stats.rolled_accuracy(classify.resolve(scored(s, d, "naive_bayes_multinomial")))
)
_BAYES = (SCORES["naive_bayes_multinomial"], _ROUNDED, _RESOLVED)
query(
    "e18_seed_stability",
    with_views(FACTS, "sf AS MATERIALIZED (SELECT * REPLACE (seed * 4294967296 + comparison AS comparison), md5(seed || ':' || question_id) < '4' AS held FROM facts, (SELECT unnest(range(0, 4)) AS seed))", "train AS (SELECT * FROM sf WHERE NOT held), test AS (SELECT * FROM sf WHERE held)", *_BAYES)
    + "SELECT c::INT AS comparison, count(*) AS n_runs, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(min(a), 6) AS low, round(max(a), 6) AS high FROM (SELECT comparison % 4294967296 AS c, avg((pred0 = 0)::INT) * 100 AS a FROM r GROUP BY comparison) GROUP BY c",
)(lambda s, d: experiments.seed_stability(t.facts(s, d), 4))
_CW_VIEWS, _CW_PAIRS = _CW.format(n="greatest(nc, nw)").rsplit("SELECT slots.source", 1)
query(
    "e17_correct_vs_wrong",
    with_views(FACTS, STATUS, _CW_VIEWS.rstrip(), "cw AS MATERIALIZED (SELECT slots.source" + _CW_PAIRS + ")", r"sided AS (SELECT CAST(regexp_extract(source, '(\d+)', 1) AS INT) AS comparison, slot AS question_id, side, CASE side WHEN 0 THEN correct_id ELSE wrong_id END AS doc_id FROM cw, (SELECT unnest(range(0, 2)) AS side))", "pf AS MATERIALIZED (SELECT sided.*, code_idx, cnt FROM sided JOIN facts USING (doc_id))", _TT.replace("FROM facts", "FROM pf"), *_BAYES)
    + "SELECT comparison, count(*) AS n, count(*) FILTER (pred0 = 0) AS n_correct, round(avg((pred0 = 0)::INT) * 100, 6) AS accuracy FROM r GROUP BY comparison",
)(lambda s, d: experiments.correct_vs_wrong(t.facts(s, d), _correct_wrong(s, d)))


def _correct_wrong(s, d):
    paired = pairs.pair_correct_wrong(t.table(s, d, "documents").select("source", "doc_id"), t.correctness(s, d), ["source"])
    return paired.withColumn("comparison", F.regexp_extract("source", r"(\d+)", 1).cast("int"))


_CM = ["vote_soft", "vote_hard", "naive_bayes_multinomial", "centroid_euclidean"]
query("c11_compare_classifiers")(lambda s, d: experiments.compare(_CM, *train_and_test(t.facts(s, d))))
query("c8_logistic_regression")(lambda s, d: experiments.evaluate("logistic_regression", *train_and_test(t.facts(s, d))))

# ---- neighbours and similar codes -----------------------------------------

_DIST2 = "list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
query(
    "j11_knn_join",
    f"SELECT q.vec_id AS query, b.vec_id AS neighbour, b.label, round(sqrt({_DIST2}), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST2}, b.vec_id)::INT AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 11",
)(lambda s, d: _neighbours(s, d))


def _neighbours(s, d):
    rows = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    near = classify.nearest_neighbours(rows.where("id % 20 = 0"), rows, 12).where("query <> neighbour")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return near.withColumn("rank", again).where("rank <= 11").withColumn("distance", r6(F.col("distance")))


_VECTORS = "e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)"
_SIMILAR = "p AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS other FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) / (a.n * b.n) >= 0.6)"
_REACHED = "reached AS (SELECT vec_id AS id, vec_id AS other FROM e UNION SELECT reached.id, p.other FROM reached JOIN p ON reached.other = p.id)"
query(
    "j12_similar_code_pairs",
    with_views(_VECTORS, _SIMILAR, _REACHED).replace("WITH", "WITH RECURSIVE", 1) + "SELECT id, min(reached.other) AS class_id, (SELECT count(*) FROM p WHERE p.id = reached.id) AS links FROM reached GROUP BY id",
)(lambda s, d: experiments.similar_classes(t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.6))
