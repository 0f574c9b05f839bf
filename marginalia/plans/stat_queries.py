"""Queries over facts, reruns, embeddings and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import agreement, classify, scans, sequences, stats, vectors
from marginalia.operators.stats import r6
from marginalia.sources import tables as t

from .catalog import DENSE, FACTS, MISSING, RUNS, SEQ, STATS, STATUS, TRACES, query, with_views

F_ = with_views(FACTS)
FS = with_views(FACTS, STATS)
M_ = with_views(MISSING)
R_ = with_views(RUNS)

# ---- counts and vectors -----------------------------------------------------

query("m6_m7_facts", F_ + "SELECT doc_id, comparison, side, question_id, code_idx, cnt, cnt > 0 AS present FROM facts")(
    lambda s, d: t.facts(s, d).select("doc_id", "comparison", "side", "question_id", "code_idx", "cnt", (F.col("cnt") > 0).alias("present"))
)
query("a1_code_counts", F_ + "SELECT comparison, code_idx, code_name, model, count(*) FILTER (cnt > 0) AS n FROM facts GROUP BY ALL")(lambda s, d: stats.code_counts(t.facts(s, d)))
query("a2_code_stats", FS + "SELECT *, c0 + c1 AS total, CASE WHEN c0 + c1 = 0 THEN 0.5::DOUBLE ELSE round(c0 / (c0 + c1), 6) END AS ratio FROM stats")(lambda s, d: stats.code_stats(t.facts(s, d)))
query("a3_presence_vectors", F_ + "SELECT comparison, question_id, side, doc_id, list((cnt > 0)::BIGINT ORDER BY code_idx) AS v FROM facts GROUP BY ALL")(lambda s, d: stats.vectors(t.facts(s, d), presence=True))
query("a4_m10_count_vectors", F_ + "SELECT comparison, question_id, side, doc_id, list(cnt ORDER BY code_idx) AS v FROM facts GROUP BY ALL")(lambda s, d: stats.vectors(t.facts(s, d)))
query("a5_code_usage", M_ + "SELECT comparison, code_idx, code_name, count(cnt) AS usage FROM facts GROUP BY ALL")(lambda s, d: stats.code_usage(t.facts_missing(s, d)))
query("a6_class_centroids", M_ + "SELECT comparison, side, code_idx, code_name, round(avg(cnt), 6) AS mean FROM facts GROUP BY ALL")(lambda s, d: stats.centroids(t.facts_missing(s, d)).withColumn("mean", r6(F.col("mean"))))
query(
    "a7_weighted_centroids",
    M_ + "SELECT comparison, side, code_idx, code_name, round(m * u, 6) AS weighted, u AS usage FROM (SELECT comparison, side, code_idx, code_name, avg(cnt) AS m FROM facts GROUP BY ALL) JOIN (SELECT comparison, code_idx, count(cnt) AS u FROM facts GROUP BY ALL) USING (comparison, code_idx)",
)(lambda s, d: stats.weighted_centroids(t.facts_missing(s, d)).select("comparison", "side", "code_idx", "code_name", r6(F.col("weighted")).alias("weighted"), "usage"))
query("a10_label_balance", with_views(TRACES) + "SELECT model, count(*) AS n, count(*) FILTER (md5(concat('7:', question_id::VARCHAR)) < '4') AS n_eval FROM traces GROUP BY ALL")(
    lambda s, d: t.traces(s, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(classify.is_eval(F.col("question_id"))).alias("n_eval"))
)
query(
    "a11_vector_summary",
    M_ + "SELECT comparison, code_idx, code_name, count(cnt) AS n, count(DISTINCT model) AS models, round(avg(cnt), 6) AS mean, round(stddev_pop(cnt), 6) AS std, min(cnt) AS low, max(cnt) AS high FROM facts GROUP BY ALL",
)(lambda s, d: stats.vector_summary(t.facts_missing(s, d)))
query(
    "a12_m11_imputation_summary",
    M_ + "SELECT model, count(DISTINCT doc_id) AS vectors, count(*) AS cells, count(*) FILTER (cnt IS NULL) AS missing, round(100 * count(*) FILTER (cnt IS NULL) / count(*), 6) AS percent FROM facts GROUP BY ALL",
)(lambda s, d: stats.imputation_summary(t.facts_missing(s, d)))

# ---- reruns and agreement ---------------------------------------------------

_VAR = "var AS (SELECT code, avg(CASE WHEN m > 0.1::DOUBLE THEN sqrt(v) / (m + 1e-8::DOUBLE) ELSE v END) AS variability FROM (SELECT sample_id, model, code, avg(cnt) AS m, var_pop(cnt) AS v FROM runs GROUP BY ALL HAVING count(*) > 1) GROUP BY code)"
query("a13_rerun_mean", R_ + "SELECT sample_id, model, code, round(avg(cnt), 6) AS mean, round(var_pop(cnt), 6) AS var, count(*) AS n_runs FROM runs GROUP BY ALL")(
    lambda s, d: stats.rerun_mean(t.runs(s, d)).select("sample_id", "model", "code", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"), "n_runs")
)
query("a14_rerun_variability", with_views(RUNS, _VAR) + "SELECT code, round(variability, 6) AS variability FROM var")(lambda s, d: stats.rerun_variability(t.runs(s, d)).withColumn("variability", r6(F.col("variability"))))
query("a15_reject_inconsistent", with_views(RUNS, _VAR) + "SELECT code, round(variability, 6) AS variability FROM var WHERE variability >= (SELECT quantile_cont(variability, 0.6::DOUBLE) FROM var)")(
    lambda s, d: stats.reject_inconsistent(stats.rerun_variability(t.runs(s, d)), percentile=60).withColumn("variability", r6(F.col("variability")))
)
query(
    "a16_run_accuracy_stats",
    R_ + """, per AS (SELECT run, avg((CASE WHEN s0 > s1 THEN 0 ELSE 1 END = sample_id % 2)::INT::DOUBLE) * 100 AS a FROM (SELECT run, sample_id, sum(cnt) FILTER (model = 0) AS s0, sum(cnt) FILTER (model = 1) AS s1 FROM runs GROUP BY ALL HAVING count(DISTINCT model) = 2) GROUP BY run)
    SELECT count(*) AS n_runs, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(min(a), 6) AS low, round(max(a), 6) AS high FROM per""",
)(lambda s, d: stats.run_accuracy_stats(_run_outcomes(t.runs(s, d))))


def _run_outcomes(runs):
    """A guess per run and sample: the model with more behaviours; right when it is the sample's parity."""
    sums = runs.groupBy("run", "sample_id").agg(*(F.sum(F.when(F.col("model") == m, F.col("cnt"))).alias(f"s{m}") for m in (0, 1))).where("s0 IS NOT NULL AND s1 IS NOT NULL")
    guess = F.when(F.col("s0") > F.col("s1"), 0).otherwise(1)
    return sums.withColumn("outcome", F.when(guess == F.col("sample_id") % 2, "correct").otherwise("Both wrong"))


_RATED = "rated AS MATERIALIZED (SELECT sample_id, run, code, avg(cnt) AS rating FROM runs GROUP BY ALL)"


def _fleiss_sql(category: str) -> str:
    return f"""cells AS MATERIALIZED (SELECT code, sample_id, {category} AS category, count(*) AS n FROM rated GROUP BY ALL),
    items AS (SELECT code, sample_id, sum(n) AS raters, sum(n * n) AS squares FROM cells GROUP BY ALL HAVING sum(n) > 1),
    obs AS (SELECT code, avg((squares - raters) / (raters * (raters - 1))) AS p, count(*) AS items FROM items GROUP BY code),
    used AS (SELECT code, category, sum(n) AS n FROM cells SEMI JOIN items USING (code, sample_id) GROUP BY ALL),
    chance AS (SELECT code, sum(sh * sh) AS pe FROM (SELECT code, n / sum(n) OVER (PARTITION BY code) AS sh FROM used) GROUP BY code),
    kappas AS (SELECT code, items, CASE WHEN pe < 1 - 1e-12::DOUBLE THEN (p - pe) / (1 - pe) END AS kappa FROM obs JOIN chance USING (code))"""


_K = "SELECT code, items, round(kappa, 6) + 0.0::DOUBLE AS kappa FROM kappas"
_round_kappa = lambda df: df.withColumn("kappa", r6(F.col("kappa")))
query("a25_fleiss_kappa_binary", with_views(RUNS, _RATED, _fleiss_sql("(rating > 3)::INT")) + _K)(lambda s, d: _round_kappa(agreement.fleiss_kappa_binary(t.runs(s, d), 3.0)))
query(
    "a25_fleiss_summary",
    with_views(RUNS, _RATED, _fleiss_sql("(rating > 3)::INT")) + "SELECT count(kappa) AS codes, round(avg(kappa), 6) AS mean, round(stddev_pop(kappa), 6) AS std, round(min(kappa), 6) AS low, round(max(kappa), 6) AS high, round(quantile_cont(kappa, 0.25::DOUBLE), 6) AS q25, round(quantile_cont(kappa, 0.75::DOUBLE), 6) AS q75 FROM kappas",
)(lambda s, d: agreement.kappa_summary(agreement.fleiss_kappa_binary(t.runs(s, d), 3.0)))
query("a27_kappa_exact", with_views(RUNS, _RATED, _fleiss_sql("rating")) + _K)(lambda s, d: _round_kappa(agreement.kappa_exact(t.runs(s, d))))
query("a27_kappa_tolerance", with_views(RUNS, _RATED, _fleiss_sql("floor(rating / 3)")) + _K)(lambda s, d: _round_kappa(agreement.kappa_tolerance(t.runs(s, d), 1)))
_RP = "rp AS MATERIALIZED (SELECT x.code, x.run AS run1, y.run AS run2, x.sample_id, x.rating AS a, y.rating AS b FROM rated x JOIN rated y ON x.code = y.code AND x.sample_id = y.sample_id AND x.run < y.run)"
query(
    "a26_cohen_kappa_pairwise",
    with_views(RUNS, _RATED, _RP) + """SELECT code, run1, run2, n, round(CASE WHEN pe < 1 - 1e-12::DOUBLE THEN (po - pe) / (1 - pe) END, 6) + 0.0::DOUBLE AS kappa FROM (SELECT *, px * py + (1 - px) * (1 - py) AS pe FROM
    (SELECT code, run1, run2, count(*) AS n, avg(((a > 3) = (b > 3))::INT) AS po, avg((a > 3)::INT) AS px, avg((b > 3)::INT) AS py FROM rp GROUP BY ALL HAVING count(*) >= 2))""",
)(lambda s, d: _round_kappa(agreement.cohen_kappa_pairwise(t.runs(s, d), 3.0)))
for _squared, _w in ((False, "abs(a - b)"), (True, "(a - b) * (a - b)")):
    query(
        "a27_kappa_weighted" + ("_squared" if _squared else ""),
        with_views(RUNS, _RATED, _RP) + f""", o AS (SELECT code, run1, run2, avg({_w}) AS o, count(*) AS n FROM rp GROUP BY ALL HAVING count(*) >= 2),
        e AS (SELECT code, run1, run2, sum({_w} * na * nb) AS e FROM (SELECT code, run1, run2, a, count(*) AS na FROM rp GROUP BY ALL) JOIN (SELECT code, run1, run2, b, count(*) AS nb FROM rp GROUP BY ALL) USING (code, run1, run2) GROUP BY ALL)
        SELECT code, round(avg(1 - o / nullif(e / (n * n), 0)), 6) + 0.0::DOUBLE AS kappa FROM o JOIN e USING (code, run1, run2) GROUP BY code""",
    )(lambda s, d, q=_squared: _round_kappa(agreement.kappa_weighted(t.runs(s, d), q)))

# ---- feature scores ---------------------------------------------------------

_SUMS = "sums AS (SELECT dim, label, count(x) AS n, sum(x) AS s, sum(abs(x)) AS sa, sum(x * x) AS ss FROM dense GROUP BY ALL)"
_CHI = "score AS (SELECT dim, sum(power(sa - e, 2) / nullif(e, 0)) AS score FROM (SELECT *, sum(sa) OVER w * n / sum(n) OVER w AS e FROM sums WINDOW w AS (PARTITION BY dim)) GROUP BY dim)"
_ANOVA = "score AS (SELECT dim, ((b - s * s / n) / (k - 1)) / nullif((ss - b) / (n - k), 0) AS score FROM (SELECT dim, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM sums GROUP BY dim))"
_SCORE = "SELECT dim, round(score, 6) AS score FROM score"
_round_score = lambda df: df.withColumn("score", r6(F.col("score")))
query("a17_score_chi2", with_views(DENSE, _SUMS, _CHI) + _SCORE)(lambda s, d: _round_score(stats.score_chi2(t.dense(s, d))))
query("a18_score_anova_f", with_views(DENSE, _SUMS, _ANOVA) + _SCORE)(lambda s, d: _round_score(stats.score_anova_f(t.dense(s, d))))
_MI = "score AS (SELECT dim, sum(n / a * ln(n * a / (nx * ny))) AS score FROM (SELECT dim, n::DOUBLE AS n, sum(n) OVER (PARTITION BY dim) AS a, sum(n) OVER (PARTITION BY dim, x) AS nx, sum(n) OVER (PARTITION BY dim, label) AS ny FROM (SELECT comparison * 100 + code_idx AS dim, cnt AS x, side AS label, count(*) AS n FROM facts GROUP BY ALL)) GROUP BY dim)"
query("a19_score_mutual_info", with_views(FACTS, _MI) + _SCORE)(lambda s, d: _round_score(stats.score_mutual_info(_as_rows(t.facts(s, d)))))
query("a20_score_variance", with_views(DENSE) + "SELECT dim, round(var_pop(x), 6) AS score FROM dense GROUP BY dim")(lambda s, d: _round_score(stats.score_variance(t.dense(s, d))))
query("w9_top_k_by_score", with_views(DENSE, _SUMS, _ANOVA) + "SELECT dim, round(score, 6) AS score, row_number() OVER (ORDER BY round(coalesce(score, 0), 9) DESC, dim)::INT AS rank FROM score QUALIFY rank <= 10")(
    lambda s, d: _round_score(stats.top_k_by_score(stats.score_anova_f(t.dense(s, d)).withColumn("score", F.round("score", 9)), 10))
)
query("w10_select_percentile", with_views(DENSE, _SUMS, _CHI) + "SELECT dim, round(score, 6) AS score FROM score WHERE score >= (SELECT quantile_cont(score, 0.8::DOUBLE) FROM score)")(
    lambda s, d: _round_score(stats.select_percentile(stats.score_chi2(t.dense(s, d)), 20))
)
query("w11_top_dimensions", with_views(DENSE, _SUMS, _ANOVA) + "SELECT dim, round(score, 6) AS score FROM score ORDER BY score.score DESC, dim LIMIT 5")(lambda s, d: _round_score(stats.score_anova_f(t.dense(s, d)).orderBy(F.desc("score"), "dim").limit(5)))


def _as_rows(facts):
    return facts.select((F.col("comparison") * 100 + F.col("code_idx")).alias("dim"), F.col("side").alias("label"), F.col("cnt").alias("x"))


# ---- pruning ----------------------------------------------------------------

query(
    "a21_win_ratio",
    F_ + """SELECT *, pairs - wins0 - wins1 AS ties, round(wins0 / pairs, 6) AS ratio, NOT (abs(wins0 / pairs - 0.5::DOUBLE) < 0.1::DOUBLE AND pairs >= 5) AS keep FROM (
    SELECT comparison, code_idx, code_name, count(*) AS pairs, count(*) FILTER (x0 > x1) AS wins0, count(*) FILTER (x0 < x1) AS wins1 FROM (SELECT comparison, question_id, code_idx, code_name, max(cnt) FILTER (side = 0) AS x0, max(cnt) FILTER (side = 1) AS x1 FROM facts GROUP BY ALL) WHERE x0 IS NOT NULL AND x1 IS NOT NULL GROUP BY ALL)""",
)(lambda s, d: stats.win_ratio(t.facts(s, d)))
_SHARE = "CASE WHEN c0 + c1 = 0 THEN 0.5::DOUBLE ELSE c0 / (c0 + c1) END"
query("a22_prune_frequency", FS + f"SELECT comparison, code_idx, c0, c1 FROM stats WHERE NOT (c0 + c1 > 20 AND {_SHARE} > 0.5::DOUBLE - 0.05::DOUBLE AND {_SHARE} < 0.5::DOUBLE + 0.05::DOUBLE)")(
    lambda s, d: stats.prune_frequency(stats.code_stats(t.facts(s, d)), 20, 0.05).select("comparison", "code_idx", "c0", "c1")
)
query("a23_filter_equal", FS + "SELECT comparison, code_idx, c0, c1, CASE WHEN c0 = 0 AND c1 = 0 THEN true WHEN c0 = 0 OR c1 = 0 THEN false ELSE abs(c0 * 100 / (c0 + c1) - 50) <= 5 END AS equal FROM stats")(
    lambda s, d: stats.filter_equal(stats.code_stats(t.facts(s, d)), 5).select("comparison", "code_idx", "c0", "c1", "equal")
)
query(
    "a24_e3_merged_counts",
    F_ + """SELECT comparison, model, merged, count(*) FILTER (p) AS n FROM (SELECT comparison, model, doc_id, CASE WHEN code_name IN ('the', 'la', 'der', 'die') THEN 'article' WHEN code_name IN ('of', 'de') THEN 'genitive' ELSE code_name END AS merged, bool_or(cnt > 0) AS p FROM facts GROUP BY ALL) GROUP BY ALL""",
)(lambda s, d: stats.merged_counts(t.facts(s, d), s.createDataFrame([(c, "article") for c in ("the", "la", "der", "die")] + [(c, "genitive") for c in ("of", "de")], "code_name string, merged string")))
_TOPK = "round(CASE WHEN c0 + c1 = 0 THEN 0 ELSE abs(c0 / (c0 + c1) - 0.5::DOUBLE) * (c0 + c1) END, 6)"
query("w8_top_k_codes", FS + f"SELECT comparison, code_idx, code_name, c0, c1, {_TOPK}::DOUBLE AS score FROM stats QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY {_TOPK} DESC, code_idx) <= 3")(
    lambda s, d: stats.top_k_codes(stats.code_stats(t.facts(s, d)), 3).select("comparison", "code_idx", "code_name", "c0", "c1", "score")
)
query("u5_codebook_minus_removed", FS + f"SELECT comparison, code_name, row_number() OVER (PARTITION BY comparison ORDER BY code_idx)::INT - 1 AS code_idx FROM stats WHERE NOT (c0 + c1 > 20 AND {_SHARE} > 0.5::DOUBLE - 0.05::DOUBLE AND {_SHARE} < 0.5::DOUBLE + 0.05::DOUBLE)")(
    lambda s, d: _reindexed(stats.prune_frequency(stats.code_stats(t.facts(s, d)), 20, 0.05))
)


def _reindexed(codes):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("comparison").orderBy("code_idx")) - 1
    return codes.withColumn("__new", place).select("comparison", "code_name", F.col("__new").alias("code_idx"))


# ---- behaviour and correctness ----------------------------------------------

query(
    "a28_j10_code_correctness",
    with_views(FACTS, STATUS) + """SELECT code_idx, code_name, count(*) AS n, sum(x)::BIGINT AS held, round(corr(x, y), 6) + 0.0::DOUBLE AS correlation, round(sum(x * y) / nullif(sum(greatest(x, y)), 0), 6) AS jaccard, round(sum(x * y) * 100 / nullif(sum(x), 0), 6) AS percent
    FROM (SELECT code_idx, code_name, (cnt > 0)::INT AS x, (status = 'correct')::INT AS y FROM facts JOIN status USING (doc_id)) GROUP BY ALL""",
)(lambda s, d: stats.code_correctness(t.facts(s, d), t.correctness(s, d)))
query("a29_ids_by_model_rule", F_ + "SELECT model, code_name, list(question_id ORDER BY question_id) AS ids FROM facts WHERE cnt > 0 GROUP BY ALL")(lambda s, d: stats.ids_by_model_rule(t.facts(s, d)))
query(
    "a30_dimension_means",
    F_ + "SELECT comparison, code_idx, code_name, round(avg(cnt) FILTER (side = 0), 6) AS mean0, round(avg(cnt) FILTER (side = 1), 6) AS mean1, round(avg(cnt), 6) AS mean, round(stddev_pop(cnt), 6) AS std FROM facts WHERE code_name IN ('the', 'of', 'de') GROUP BY ALL",
)(lambda s, d: stats.dimension_means(t.facts(s, d), ["the", "of", "de"]))
query(
    "a31_success_rate_matrix",
    """WITH r AS (SELECT o_orderpriority AS dataset, o_orderstatus AS model, round(count(*) FILTER (o_totalprice > 150000) / count(*), 6) AS f, round(count(*) FILTER (o_totalprice BETWEEN 100000 AND 150000) / count(*), 6) AS p FROM orders GROUP BY ALL),
    g AS (SELECT dataset, round(coalesce(max(f + p) FILTER (model = 'F'), 0), 6) AS "F", round(coalesce(max(f + p) FILTER (model = 'O'), 0), 6) AS "O", round(coalesce(max(f + p) FILTER (model = 'P'), 0), 6) AS "P" FROM r GROUP BY dataset)
    SELECT *, round("F" + "O" + "P", 6) AS total FROM g""",
)(lambda s, d: _rates(t.table(s, d, "orders")))


def _rates(orders):
    price = F.col("o_totalprice")
    share = lambda c: r6(F.count_if(c) / F.count("*"))
    rates = orders.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("model")).agg(share(price > 150000).alias("full_rate"), share(price.between(100000, 150000)).alias("partial_rate"))
    grid = stats.rate_matrix(rates, ["F", "O", "P"])
    return grid.select("dataset", *(r6(F.col(c)).alias(c) for c in ("F", "O", "P", "total")))


# ---- missing values and normalisation --------------------------------------


def _values(df):
    return df.select("doc_id", "code_idx", r6(F.col("value")).alias("value"))


_FILL = "FROM facts LEFT JOIN fill USING (comparison, model, code_idx)"
query("v1_extend_vectors", M_ + "SELECT doc_id, code_idx, coalesce(cnt, CASE WHEN code_idx >= 6 THEN 0 END) AS cnt FROM (SELECT doc_id, code_idx, CASE WHEN code_idx < 6 THEN cnt ELSE 0 END AS cnt FROM facts)")(
    lambda s, d: vectors.extend_vectors(t.facts_missing(s, d).where("code_idx < 6"), t.codebook(s).where("code_idx >= 6"), 0).select("doc_id", "code_idx", "cnt")
)
for _name, _agg in (("mean", "avg(cnt)"), ("median", "quantile_cont(cnt, 0.5::DOUBLE)")):
    query(f"v3_impute_{_name}", with_views(MISSING, f"fill AS (SELECT comparison, model, code_idx, {_agg} AS f FROM facts GROUP BY ALL)") + f"SELECT doc_id, code_idx, round(coalesce(cnt, f, 0)::DOUBLE, 6) AS value {_FILL}")(
        lambda s, d, m=_name: _values(vectors.impute_simple(t.facts_missing(s, d), m))
    )
query(
    "v3_impute_most_frequent",
    with_views(MISSING, "fill AS (SELECT comparison, model, code_idx, arg_min(cnt, -n * 1000000 + cnt) AS f FROM (SELECT comparison, model, code_idx, cnt, count(*) AS n FROM facts WHERE cnt IS NOT NULL GROUP BY ALL) GROUP BY ALL)") + f"SELECT doc_id, code_idx, round(coalesce(cnt, f, 0)::DOUBLE, 6) AS value {_FILL}",
)(lambda s, d: _values(vectors.impute_simple(t.facts_missing(s, d), "most_frequent")))
query("v3_impute_constant_rounded", M_ + "SELECT doc_id, code_idx, coalesce(cnt, 2)::DOUBLE AS value FROM facts")(lambda s, d: _values(vectors.impute_simple(t.facts_missing(s, d), "constant", 2.5, rounded=True)))
query(
    "v4_impute_knn",
    with_views(MISSING, "holed AS (SELECT comparison, model, doc_id AS target, code_idx FROM facts WHERE cnt IS NULL)") + """,
    gaps AS (SELECT l.comparison, l.model, l.doc_id AS target, r.doc_id AS donor, sqrt(sum((l.cnt - r.cnt) * (l.cnt - r.cnt)) * 8 / count(*)) AS distance FROM facts l JOIN facts r USING (comparison, model, code_idx) WHERE l.cnt IS NOT NULL AND r.cnt IS NOT NULL AND l.doc_id <> r.doc_id AND l.doc_id IN (SELECT target FROM holed) GROUP BY ALL),
    near AS (SELECT h.target, h.code_idx, r.cnt AS y FROM holed h JOIN gaps g ON h.target = g.target JOIN facts r ON r.doc_id = g.donor AND r.code_idx = h.code_idx WHERE r.cnt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h.target, h.code_idx ORDER BY g.distance, g.donor) <= 10),
    fill AS (SELECT target AS doc_id, code_idx, avg(y) AS f FROM near GROUP BY ALL),
    by_column AS (SELECT comparison, model, code_idx, avg(cnt) AS c FROM facts GROUP BY ALL)
    SELECT doc_id, code_idx, round(coalesce(cnt, f, c, 0)::DOUBLE, 6) AS value FROM facts LEFT JOIN fill USING (doc_id, code_idx) LEFT JOIN by_column USING (comparison, model, code_idx)""",
)(lambda s, d: _values(vectors.impute_knn(t.facts_missing(s, d), 10)))
query("n1_normalize_l1", F_ + "SELECT doc_id, code_idx, round(coalesce(cnt / nullif(sum(abs(cnt)) OVER (PARTITION BY doc_id), 0), 0), 6) AS value FROM facts")(lambda s, d: _values(vectors.normalize(t.facts(s, d), 1)))
query("n1_normalize_l2", F_ + "SELECT doc_id, code_idx, round(coalesce(cnt / nullif(sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 0), 0), 6) AS value FROM facts")(lambda s, d: _values(vectors.normalize(t.facts(s, d), 2)))
query(
    "n2_normalize_comparative",
    F_ + "SELECT doc_id, code_idx, round(CASE WHEN count(*) OVER w = 2 THEN CASE WHEN sum(cnt) OVER w > 0 THEN cnt / sum(cnt) OVER w ELSE 0 END ELSE cnt END, 6)::DOUBLE AS value FROM facts WINDOW w AS (PARTITION BY comparison, question_id, code_idx)",
)(lambda s, d: _values(vectors.normalize_comparative(t.facts(s, d))))

# ---- sequences --------------------------------------------------------------

_RATES = "tr AS (SELECT sample_id, model, code, lead(code) OVER (PARTITION BY sample_id, model ORDER BY pos) AS next FROM seq), rates AS MATERIALIZED (SELECT sample_id, model, code, next, n / sum(n) OVER (PARTITION BY sample_id, model, code) AS p FROM (SELECT sample_id, model, code, next, count(*) AS n FROM tr WHERE next IS NOT NULL GROUP BY ALL))"
_MEANS = "means AS MATERIALIZED (SELECT model, code, next, sum(p) / any_value(k) AS p FROM rates JOIN (SELECT model, count(DISTINCT sample_id) AS k FROM seq GROUP BY model) USING (model) GROUP BY ALL)"
_DIST = """cells AS (SELECT m AS to_model, code, next FROM (SELECT DISTINCT model AS m FROM means), (SELECT DISTINCT code, next FROM (SELECT code, next FROM means UNION ALL SELECT code, next FROM rates))),
    dist AS (SELECT x.sample_id, x.model, c.to_model, sqrt(sum(power(coalesce(r.p, 0) - coalesce(m.p, 0), 2))) AS distance FROM (SELECT DISTINCT sample_id, model FROM seq) x CROSS JOIN cells c LEFT JOIN rates r ON r.sample_id = x.sample_id AND r.model = x.model AND r.code = c.code AND r.next = c.next LEFT JOIN means m ON m.model = c.to_model AND m.code = c.code AND m.next = c.next GROUP BY ALL)"""
query("w7_m12_transitions", with_views(SEQ) + "SELECT sample_id, model, pos, code, lead(code) OVER (PARTITION BY sample_id, model ORDER BY pos) AS next FROM seq")(lambda s, d: sequences.transitions(t.sequences(s, d)))
query("m13_transition_rates", with_views(SEQ, _RATES) + "SELECT sample_id, model, code, next, round(p, 6) AS p FROM rates")(lambda s, d: sequences.transition_rates(t.sequences(s, d)).withColumn("p", r6(F.col("p"))))
query("a32_transition_means", with_views(SEQ, _RATES, _MEANS) + "SELECT model, code, next, round(p, 6) AS p FROM means")(lambda s, d: sequences.transition_means(t.sequences(s, d)).withColumn("p", r6(F.col("p"))))
query("j13_transition_distance", with_views(SEQ, _RATES, _MEANS, _DIST) + "SELECT sample_id, model, to_model, round(distance, 6) AS distance FROM dist")(
    lambda s, d: sequences.transition_distances(t.sequences(s, d), sequences.transition_means(t.sequences(s, d))).withColumn("distance", r6(F.col("distance")))
)
query("c10_transition_classifier", with_views(SEQ, _RATES, _MEANS, _DIST) + "SELECT sample_id, model, arg_min(to_model, round(distance, 9) * 10 + to_model * 1e-12::DOUBLE) AS predicted FROM dist GROUP BY ALL")(
    lambda s, d: sequences.transition_classifier(sequences.transition_distances(t.sequences(s, d), sequences.transition_means(t.sequences(s, d))))
)
query("w5_running_accuracy", with_views(SEQ) + "SELECT sample_id, model, pos, round(avg((code = 'purchase')::INT::DOUBLE) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) AS running FROM seq")(
    lambda s, d: scans.running_accuracy(t.sequences(s, d), ["sample_id"], "pos", F.col("code") == "purchase").drop("code")
)
query(
    "w6_no_update_streak",
    with_views(SEQ) + "SELECT sample_id, pos, CASE WHEN island = 0 THEN row_number() OVER (PARTITION BY sample_id, island ORDER BY pos) ELSE row_number() OVER (PARTITION BY sample_id, island ORDER BY pos) - 1 END AS streak FROM (SELECT *, sum((code = 'click')::INT) OVER (PARTITION BY sample_id ORDER BY pos) AS island FROM seq)",
)(lambda s, d: scans.no_update_streak(t.sequences(s, d), ["sample_id"], "pos", F.col("code") == "click").select("sample_id", "pos", "streak"))
