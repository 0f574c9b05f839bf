"""Queries of whole experiments: updates and stop rules of a taxonomy, reruns, sequences from counts, registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.annotations import parse_counts
from marginalia.functions.text import annotation_prompts
from marginalia.operators import calls, pairs, stats, vectors, versions
from marginalia.operators import codebook as cb
from marginalia.operators.vectors import chosen
from marginalia.sources import tables as t
from marginalia.sources.scratch import scratch_path

from . import experiments
from .answer_queries import _SECTIONS
from .catalog import FACTS, PAIRS, SEQ, SQL, query, with_views
from .model_queries import _CM, _RESOLVED, _ROUNDED, _TT, SCORES, train_and_test
from .text_queries import combined

F_ = with_views(FACTS)
_ACCURACY = "SELECT comparison, count(*) AS n, count(*) FILTER (pred0 = 0) AS n_correct, round(avg((pred0 = 0)::INT) * 100, 6) AS accuracy FROM r GROUP BY comparison"

# ---- updates and stop rules -------------------------------------------------

query(
    "e4_apply_update",
    """WITH old AS (SELECT 0 AS version, row_number() OVER (ORDER BY m)::INT - 1 AS code_idx, m AS code_name, 'of ' || n || ' parts' AS definition FROM (SELECT p_type AS m, count(*) AS n FROM part GROUP BY m)),
    changes AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS code_name, max(p_partkey) AS step FROM part GROUP BY ALL),
    last AS (SELECT code_name, step, p_name AS new_definition FROM changes JOIN part ON p_partkey = step),
    joined AS (SELECT coalesce(o.code_name, l.code_name) AS code_name, code_idx, definition, step, new_definition FROM old o FULL JOIN last l USING (code_name))
    SELECT version::INT AS version, code_idx, code_name, definition FROM old
    UNION ALL SELECT 1, row_number() OVER (ORDER BY coalesce(step, -1), code_idx NULLS FIRST)::INT - 1, code_name, coalesce(new_definition, definition) FROM joined""",
)(lambda s, d: _updated(t.table(s, d, "part")))


def _updated(parts: DataFrame) -> DataFrame:
    """A taxonomy of types of parts, and an update a part: even ones define their type anew, odd ones add their brand."""
    types = parts.groupBy("p_type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("p_type")) - 1
    old = types.select(F.lit(0).alias("version"), place.alias("code_idx"), F.col("p_type").alias("code_name"), F.concat(F.lit("of "), F.col("n").cast("string"), F.lit(" parts")).alias("definition"))
    even = F.col("p_partkey") % 2 == 0
    changes = parts.select(F.col("p_partkey").alias("step"), F.when(even, "update").otherwise("add").alias("action"), F.when(even, F.col("p_type")).otherwise(F.col("p_brand")).alias("code_name"), F.col("p_name").alias("definition"))
    return cb.apply_update(old, changes, 1)


query(
    "e7_stop_rule",
    with_views(SEQ)
    + """, grown AS (SELECT sample_id, pos, sum((first = pos)::INT) OVER (PARTITION BY sample_id ORDER BY pos)::BIGINT AS codes FROM (SELECT sample_id, pos, min(pos) OVER (PARTITION BY sample_id, code) AS first FROM seq)),
    marked AS (SELECT *, sum((codes <> before OR before IS NULL)::INT) OVER (PARTITION BY sample_id ORDER BY pos) AS island FROM (SELECT *, lag(codes) OVER (PARTITION BY sample_id ORDER BY pos) AS before FROM grown)),
    islands AS (SELECT sample_id, island, count(*) AS streak, max(pos) AS round, max(codes) AS codes FROM marked GROUP BY ALL)
    SELECT sample_id, round, codes, round * 3 AS samples, streak, codes >= 6 OR round * 3 >= 240 OR (streak > 55 AND round * 3 >= 60) AS stop FROM islands QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round DESC) = 1""",
)(lambda s, d: _stopped(t.sequences(s, d)))


def _stopped(seq: DataFrame) -> DataFrame:
    """Each user's events as rounds of three samples; a kind of event seen for the first time is a new code."""
    first = F.min("pos").over(Window.partitionBy("sample_id", "code"))
    codes = F.sum((F.col("first") == F.col("pos")).cast("long")).over(Window.partitionBy("sample_id").orderBy("pos"))
    grown = seq.withColumn("first", first).select("sample_id", F.col("pos").alias("round"), codes.alias("codes"), (F.col("pos") * 3).alias("samples"))
    return cb.stop_decisions(grown, ["sample_id"], max_codes=6, max_samples=240, patience=55, least_samples=60)


query("e6_train_taxonomy")(lambda s, d: experiments.train_taxonomy(s, t.traces(s, d), list(t.SEED_CODES[:3]), rounds=3, max_codes=6, epochs=2, warm_start=1)[0])

query(
    "m4_version_tree",
    """WITH RECURSIVE said AS (SELECT conv_id, turn, text, length(text) AS n, conv_id * 1048576 + turn AS version FROM conversations),
    ev AS (SELECT version, CASE WHEN (conv_id + turn) % 3 = 0 THEN coalesce(lag(version, 2) OVER w, lag(version) OVER w) ELSE lag(version) OVER w END AS parent, CASE WHEN n % 5 = 0 THEN 'remove' ELSE 'put' END AS action, 'code' || (n % 4) AS code_name, text AS definition FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    path AS (SELECT version, version AS holder, parent, 0 AS depth FROM ev UNION ALL SELECT p.version, ev.version, ev.parent, depth + 1 FROM path p JOIN ev ON ev.version = p.parent),
    last AS (SELECT path.version, depth, action, code_name, definition FROM path JOIN ev ON ev.version = holder WHERE code_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path.version, code_name ORDER BY depth) = 1)
    SELECT version, row_number() OVER (PARTITION BY version ORDER BY depth DESC, code_name)::INT - 1 AS code_idx, code_name, definition FROM last WHERE action = 'put'""",
)(lambda s, d: _versions(t.table(s, d, "conversations")))


def _versions(conversations: DataFrame) -> DataFrame:
    """All versions of a taxonomy a conversation: a turn puts or removes a code; some restore the version before the last one."""
    of, n = Window.partitionBy("conv_id").orderBy("turn"), F.length("text")
    version = F.col("conv_id") * 1_048_576 + F.col("turn")
    said = conversations.select("conv_id", "turn", "text", version.cast("long").alias("version"))
    before = F.lag("version").over(of)
    parent = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.coalesce(F.lag("version", 2).over(of), before)).otherwise(before)
    events = said.select("version", parent.alias("parent"), F.lit(0).alias("step"), F.when(n % 5 == 0, "remove").otherwise("put").alias("action"), F.concat(F.lit("code"), (n % 4).cast("string")).alias("code_name"), F.col("text").alias("definition"))
    return versions.codebooks(events, events.select("version"))


query("x1_call_log", with_views(FACTS, PAIRS) + "SELECT CAST(doc_a AS VARCHAR) AS sample_id, code_name, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS side, cnt FROM facts JOIN pairs USING (comparison, question_id)")(lambda s, d: _asked(s, d))


def _asked(s, d) -> DataFrame:
    """All pairs' prompts, sent in batches to an annotator that breaks at some prompts' first attempts; the counts that its answers hold."""

    def unsteady(batch):
        if any(p.attempt == 1 and p.digest < "08" for p in batch):
            raise ConnectionError("try again")
        return experiments.lexical_call(batch)

    each = pairs.pair_traces(t.traces(s, d)).select(F.col("doc_a").cast("string").alias("sample_id"), F.array("text_a", "text_b").alias("outputs"))
    answers = calls.ask(annotation_prompts(each, experiments.defined(t.codebook(s)), "Annotate."), unsteady, scratch_path(s, "calls"), tasks=16)
    return parse_counts(answers.withColumnRenamed("text", "annotation"))


# ---- reruns, sequences, long lists of ids ----------------------------------

_RERUNS = "runs3 AS (SELECT test.* REPLACE (cnt + (question_id + run * code_idx) % 3 AS cnt), run FROM test, (SELECT unnest(range(0, 3)) AS run))"
_MEANS = "test AS MATERIALIZED (SELECT comparison, question_id, side, doc_id, code_idx, avg(cnt) AS cnt FROM runs3 GROUP BY ALL)"
_TRAIN, _TEST = _TT.split(", test AS MATERIALIZED")
_HELD = "held AS MATERIALIZED" + _TEST
_OF_HELD = _RERUNS.replace("test.*", "held.*").replace("FROM test", "FROM held")


def _reruns(s, d) -> tuple[DataFrame, DataFrame]:
    """Training facts, and three annotation runs of the held-out ones that differ a little."""
    train, test = train_and_test(t.facts(s, d))
    runs = pairs.repeated(test, 3)
    return train, runs.withColumn("cnt", F.col("cnt") + (F.col("question_id") + F.col("run") * F.col("code_idx")) % 3)


query("e11_averaged_accuracy", with_views(FACTS, _TRAIN, _HELD, _OF_HELD, _MEANS, SCORES["centroid_euclidean"], _ROUNDED, _RESOLVED) + _ACCURACY)(lambda s, d: experiments.evaluate_averaged("centroid_euclidean", *_reruns(s, d)))
_EACH = "train AS MATERIALIZED (SELECT fit.* REPLACE (run * 4294967296 + comparison AS comparison) FROM fit, (SELECT unnest(range(0, 3)) AS run)), test AS MATERIALIZED (SELECT * REPLACE (run * 4294967296 + comparison AS comparison) FROM runs3)"
query(
    "e11_run_stats",
    with_views(FACTS, _TRAIN.replace("train AS", "fit AS"), _HELD, _OF_HELD, _EACH, SCORES["centroid_euclidean"], _ROUNDED, _RESOLVED)
    + "SELECT c::INT AS comparison, count(*) AS n_runs, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(min(a), 6) AS low, round(max(a), 6) AS high FROM (SELECT comparison % 4294967296 AS c, avg((pred0 = 0)::INT) * 100 AS a FROM r GROUP BY comparison) GROUP BY c",
)(lambda s, d: experiments.evaluate_runs("centroid_euclidean", *_reruns(s, d)))
query(
    "e19_sequences_from_counts",
    with_views(FACTS, _SECTIONS)
    + r""", words AS (SELECT sample_id, side, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT sample_id, side, string_split_regex(lower(section), '[^\p{L}\p{N}]+') AS ws FROM sections))
    SELECT sample_id, side, row_number() OVER (PARTITION BY sample_id, side ORDER BY k) AS pos, code_idx FROM words JOIN codebook ON w = code_name QUALIFY pos <= 50""",
)(lambda s, d: experiments.sequences_from_counts(combined(s, d), list(t.SEED_CODES)))
query("a29_held_ids", F_ + "SELECT model, code_name, question_id FROM facts WHERE cnt > 0")(lambda s, d: stats.held_ids(t.facts(s, d)))

# ---- callbacks and registries -----------------------------------------------

query(
    "x2_round_log",
    F_ + """, q AS (SELECT comparison, question_id, (row_number() OVER (PARTITION BY comparison ORDER BY md5('1:' || question_id)) - 1) * 3 // count(*) OVER (PARTITION BY comparison) AS round FROM (SELECT DISTINCT comparison, question_id FROM traces)),
    dealt AS (SELECT doc_id, round FROM traces JOIN q USING (comparison, question_id))
    SELECT r.round::INT AS round, 4 AS codes, count(DISTINCT doc_id) AS samples FROM (SELECT DISTINCT round FROM dealt) r JOIN dealt d ON d.round <= r.round GROUP BY r.round""",
)(lambda s, d: _logged(s, d))


def _logged(s, d) -> DataFrame:
    """What the callback of the rounds is told."""
    told: list[tuple] = []
    experiments.grow_taxonomy(s, t.traces(s, d), list(t.SEED_CODES[:4]), rounds=3, per_round=None, max_codes=12, propose=None, log=lambda **x: told.append((x["round"], x["codes"], x["samples"])))
    return s.createDataFrame(told, "round int, codes int, samples long")


query(
    "x3_method_registry",
    F_ + """, n AS (SELECT comparison, code_idx, coalesce(cnt / nullif(sum(abs(cnt)) OVER (PARTITION BY doc_id), 0), 0) AS l1, coalesce(cnt / nullif(sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 0), 0) AS l2,
        CASE WHEN count(*) OVER w = 2 THEN CASE WHEN sum(cnt) OVER w > 0 THEN cnt / sum(cnt) OVER w ELSE 0 END ELSE cnt END AS comparative FROM facts WINDOW w AS (PARTITION BY comparison, question_id, code_idx))
    SELECT method, comparison, round(sum(value)::DOUBLE, 4) AS total FROM (SELECT comparison, 'l1' AS method, l1 AS value FROM n UNION ALL SELECT comparison, 'l2', l2 FROM n UNION ALL SELECT comparison, 'comparative', comparative FROM n) GROUP BY ALL""",
)(lambda s, d: _by_every_method(t.facts(s, d)))


def _by_every_method(facts: DataFrame) -> DataFrame:
    """The sums that each registered normalisation leaves of a comparison's counts."""
    each = (chosen(vectors.NORMALIZERS, m)(facts).select(F.lit(m).alias("method"), "comparison", "value") for m in sorted(vectors.NORMALIZERS))
    return reduce(DataFrame.unionByName, each).groupBy("method", "comparison").agg(F.round(F.sum("value"), 4).alias("total"))


# ---- SQL of experiments over all comparisons --------------------------------

_WAYS = "ways AS MATERIALIZED (SELECT a.c AS train_on, b.c AS test_on, refit, (a.c * 100000 + b.c) * 2 + refit::INT AS way FROM (SELECT DISTINCT comparison AS c FROM traces) a JOIN (SELECT DISTINCT comparison AS c FROM traces) b ON a.c <> b.c, (VALUES (false), (true)) v(refit))"
TRANSFER_SQL = (
    with_views(FACTS, _WAYS, "train AS MATERIALIZED (SELECT facts.* REPLACE (way AS comparison) FROM facts JOIN ways ON comparison = CASE WHEN refit THEN test_on ELSE train_on END WHERE NOT md5('7:' || question_id) < '4')", "test AS MATERIALIZED (SELECT facts.* REPLACE (way AS comparison) FROM facts JOIN ways ON comparison = test_on WHERE md5('7:' || question_id) < '4')", SCORES["naive_bayes_multinomial"], _ROUNDED, _RESOLVED)
    + f"SELECT train_on, test_on, refit, n, n_correct, accuracy FROM ({_ACCURACY}) JOIN ways ON comparison = way"
)
SQL["e12_transfer"] = TRANSFER_SQL


def _one_method(method: str) -> str:
    return f"SELECT '{method}' AS method, * FROM (" + with_views(SCORES[method], _ROUNDED, _RESOLVED) + _ACCURACY + ")"


SQL["c11_compare_classifiers"] = with_views(FACTS, _TT) + " UNION ALL ".join(map(_one_method, _CM))
query(
    "t11_parts_of_outputs",
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS ws FROM documents),
    cut AS (SELECT doc_id, ws, len(ws) AS n, 0::BIGINT AS start, 0::BIGINT AS words FROM d
        UNION ALL SELECT doc_id, ws, n, stop, stop - start FROM (SELECT *, CASE WHEN n - start > 250 THEN coalesce(list_max(list_filter(range(start + 201, start + 251), lambda i: right(ws[i], 1) IN ('.', '!', '?'))), start + 250) ELSE n END AS stop FROM cut WHERE start < n))
    SELECT doc_id, greatest(count(*) FILTER (words > 0), 1) AS parts, max(words) AS longest, sum(words)::BIGINT AS n_words FROM cut GROUP BY doc_id""",
)(lambda s, d: _parts(t.table(s, d, "documents")))


def _parts(docs: DataFrame) -> DataFrame:
    from marginalia.functions.annotations import split_output

    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    return split_output(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(words).alias("longest"), F.sum(words).alias("n_words"))
