"""Queries on names, answers, verdict sentences and files of traces, tasks and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import annotations as an
from marginalia.functions import text as fx
from marginalia.sources import scan, trace_source
from marginalia.sources import tables as t
from marginalia.sources.scratch import scratch_path

from .catalog import FACTS, TRACES, TURNS, query, with_views
from .text_queries import combined, turns

U_ = with_views(TURNS)

# ---- names ------------------------------------------------------------------

query(
    "p10_clean_rule_names",
    "SELECT p_partkey, p_name NOT LIKE '%Both model%' AND len(string_split_regex(p_name || ' ' || p_type, '\\s+')) <= 10 AND p_name || ' ' || p_type NOT LIKE '%the%' AS clean, p_partkey % 3 > 0 AND len(string_split_regex(p_name || ' ' || p_type, '\\s+')) <= 10 AS clean_but_the FROM part",
)(lambda s, d: _rule_names(t.table(s, d, "part")))


def _rule_names(parts: DataFrame) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), "p_type")
    both = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Both outputs "), name)).otherwise(name)
    return parts.select("p_partkey", fx.is_clean_rule(name).alias("clean"), fx.is_clean_rule(both, drop_the=False).alias("clean_but_the"))


query(
    "p11_parse_run_folder",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderpriority END AS model, CASE o_orderkey % 4 WHEN 0 THEN 'inst-intervened' WHEN 1 THEN 'no-intervened' WHEN 2 THEN 'no-intervened' END AS arm, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey::INT END AS run FROM orders",
)(lambda s, d: _folders(t.table(s, d, "orders")))


def _folders(orders: DataFrame) -> DataFrame:
    """Folder names of runs; every fourth has no number, so it is none."""
    case = F.col("o_orderkey") % 4
    arm = F.when(case == 0, "-inst-intervened-run-").when(case < 3, "-no-intervened-run-").otherwise("-no-intervened-run")
    found = fx.parse_run_folder(F.concat("o_orderpriority", arm, F.when(case < 3, F.col("o_custkey").cast("string")).otherwise("")))
    return orders.select("o_orderkey", found["model"].alias("model"), found["arm"].alias("arm"), found["run"].alias("run"))


query(
    "p13_parse_stats",
    "SELECT o_orderkey, round(o_totalprice, 2)::DOUBLE AS full_rate, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE ELSE 0 END AS partial_rate FROM orders",
)(lambda s, d: _stats_texts(t.table(s, d, "orders")))


def _stats_texts(orders: DataFrame) -> DataFrame:
    partial = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nPartial success rate = "), F.col("o_custkey").cast("string"))).otherwise("")
    text = F.concat(F.lit("Run "), "o_orderpriority", F.lit("\nFull success rate: "), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), partial)
    found = fx.parse_stats(text)
    return orders.select("o_orderkey", found["full_rate"].alias("full_rate"), found["partial_rate"].alias("partial_rate"))


query("x4_string_similarity")(lambda s, d: _similarities(t.table(s, d, "part")))


def _similarities(parts: DataFrame) -> DataFrame:
    """How like a part's name is to its type, by characters and by sets of words."""
    @F.pandas_udf("characters int, words int")
    def alike(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"characters": [an.similarity(x, y) for x, y in zip(a, b, strict=True)], "words": [an.token_set_similarity(x, y) for x, y in zip(a, b, strict=True)]})

    scored = parts.select("p_partkey", alike(F.coalesce("p_name", F.lit("")), F.coalesce("p_type", F.lit(""))).alias("s"))
    return scored.select("p_partkey", "s.characters", "s.words")


# ---- answers ----------------------------------------------------------------

#: (text of a form, its normal form) by SQL expression over a number x; {{x}} is the number.
_FORMS = (
    ("\\dfrac{x}7", "\\frac{{x}}{7}"),
    ("\\cfrac1{{x}}", "\\frac{1}{{x}}"),
    ("\\left({x},1\\right)", "({x},1)"),
    ("{x}\\text{ miles}", "{x}"),
    ("{x}^{\\circ}", "{x}"),
    ("{x}{cm}^2", "{x}"),
    ("{x} t", "{x}"),
    ("\\${x}\\%", "{x}%"),
    ("3\\cdot{x}", "3{x}"),
    ("{x}+infinity", "{x}+\\infty"),
    ("\\mathbf{{x}}", "{{x}}"),
    ("{x}\\mbox{ of them}", "{x}"),
    ("{x}j", "{x}i"),
    ("{x}.000", "{x}"),
    (".{x}", "0.{x}"),
    ("\\sqrt{x}", "\\sqrt{{x}}"),
    ("\\tan{x}", "\\tan{{x}}"),
    ("1{x}/7", "\\frac{1{x}}{7}"),
    ("\\sqrt2/{x}", "\\frac{\\sqrt{2}}{{x}}"),
    ("x = {x},", "x={x}"),
    ("{x}.50", "{x}.50"),
    ("\\text{of {x}}", "of{x}"),
)


def _sql_of(form: str) -> str:
    return " || x || ".join(f"'{part}'" for part in form.split("{x}"))


def _of(form: str, x):
    parts = form.split("{x}")
    return F.concat(*(y for i, p in enumerate(parts) for y in ([x] if i else []) + [F.lit(p)]))


query(
    "g7_math_forms",
    "SELECT o_orderkey, f.form::INT AS form, CASE f.form " + " ".join(f"WHEN {i} THEN {_sql_of(want)}" for i, (_, want) in enumerate(_FORMS)) + f" END AS answer FROM (SELECT o_orderkey, (o_orderkey % 9 + 1)::VARCHAR AS x FROM orders), (SELECT unnest(range(0, {len(_FORMS)})) AS form) f",
)(lambda s, d: _math_forms(t.table(s, d, "orders")))


def _math_forms(orders: DataFrame) -> DataFrame:
    """Every form of answer with a digit from each order."""
    x = (F.col("o_orderkey") % 9 + 1).cast("string")
    forms = orders.select("o_orderkey", F.posexplode(F.array(*(_of(text, x) for text, _ in _FORMS))).alias("form", "text"))
    return fx.with_math_normal(forms, "text", "answer").select("o_orderkey", "form", "answer")


query(
    "g8_list_answers",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [o_custkey::VARCHAR, (o_orderkey % 7)::VARCHAR, '(1,2)'] WHEN 1 THEN [o_custkey || ',' || (o_orderkey % 7)] ELSE [o_custkey::VARCHAR, (o_orderkey % 7)::VARCHAR] END AS answers FROM orders",
)(lambda s, d: _lists(t.table(s, d, "orders")))


def _lists(orders: DataFrame) -> DataFrame:
    a, b = F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 7).cast("string")
    case = F.col("o_orderkey") % 3
    question = F.when(case == 0, "Give all, separated by commas.").otherwise("Give all.")
    text = F.when(case == 0, F.concat(F.lit("so \\boxed{"), a, F.lit(", "), b, F.lit("} and \\boxed{(1, 2)}"))).when(case == 1, F.concat(F.lit("The answer is "), a, F.lit(", "), b, F.lit("."))).otherwise(F.concat(F.lit("\\boxed{"), a, F.lit(" \\text{ and } "), b, F.lit("}")))
    return orders.select("o_orderkey", fx.list_answers(question, text).alias("answers"))


query(
    "g9_suite_answers",
    U_ + r"""SELECT conv_id, turn, conv_id || '' AS gsm, '答' AS cloze, conv_id || '.' AS choice, CASE turn % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS letter, 'x = ' || conv_id AS course,
    regexp_replace(regexp_replace(answer, '^\s+', ''), '\s+$', '') AS proof, '-' || conv_id || '.5' AS chinese FROM turns""",
)(lambda s, d: _suites(turns(s, d)))


def _suites(rows: DataFrame) -> DataFrame:
    """An answer of each suite behind every assistant turn, and the next question after it."""
    conv, answer = F.col("conv_id").cast("string"), F.col("answer")
    letter = F.substring(F.lit("abcd"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1))
    texts = {
        "gsm": ("gsm_few_shot", F.concat(answer, F.lit(" it is 7 or "), conv, F.lit("\nQ: and 9"))),
        "cloze": ("gaokao_cloze", F.concat(answer, F.lit("答案是 $答$\n问题 9"))),
        "choice": ("gaokao_choice", F.concat(answer, F.lit("答案是"), conv, F.lit(".\n更多答案是 8"))),
        "letter": ("sat_few_shot", F.concat(answer, F.lit(" The final answer is ("), letter, F.lit(").\nProblem: the final answer is (e)"))),
        "course": ("courses_few_shot", F.concat(answer, F.lit("\nfinal answer is x = "), conv, F.lit(". I hope it is correct.\nProblem: none"))),
        "proof": ("formal_proof", F.concat(answer, F.lit("\nInformal: more"))),
        "chinese": ("cmath_few_shot", F.concat(answer, F.lit("答案是：3 或 -"), conv, F.lit(".5。\n问题：7"))),
    }
    return rows.select("conv_id", "turn", *(fx.suite_answer(text, suite).alias(name) for name, (suite, text) in texts.items()))


# ---- verdicts, sections and updates ----------------------------------------

_ID = "comparison || '_' || question_id"
query(
    "t3_parse_joint_decision",
    with_views(TRACES) + f"SELECT {_ID} AS sample_id, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS side, c AS code_name, 'm-' || model AS model FROM traces SEMI JOIN (SELECT comparison, question_id FROM traces GROUP BY ALL HAVING count(*) = 2) USING (comparison, question_id), (VALUES (0, 'the'), (0, 'of'), (1, 'la'), (1, 'de la')) v(s, c) WHERE s = side",
)(lambda s, d: an.parse_joint_decision(_sentences(t.traces(s, d))))


def _sentences(traces: DataFrame) -> DataFrame:
    """A verdict on each pair after its texts; a question with one trace gets the sentence of that side alone, which says nothing."""
    key = F.concat_ws("_", F.col("comparison").cast("string"), F.col("question_id").cast("string"))
    codes = F.when(F.col("side") == 0, F.lit("reasoning behaviors the, of")).otherwise(F.lit("the reasoning behaviors la, de la"))
    said = F.concat(F.lit("Because of "), codes, F.lit(", the author model of OUTPUT "), F.when(F.col("side") == 0, "A").otherwise("B"), F.lit(" is m-"), "model", F.lit("."))
    rows = traces.groupBy(key.alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("side", said.alias("said"), "thinking"))).alias("r"))
    texts, sentences = (F.array_join(F.col(f"r.{n}"), "\n") for n in ("thinking", "said"))
    return rows.select("sample_id", F.concat(F.coalesce(texts, F.lit("")), F.lit("\n### Verdict\n"), sentences).alias("annotation"))


_SUMMARY = f"SELECT sample_id, string_agg(line, chr(10) ORDER BY code_idx) AS summary FROM (SELECT {_ID} AS sample_id, code_idx, '### ' || code_name || chr(10) || string_agg('Count in OUTPUT ' || CASE side WHEN 0 THEN 'A' ELSE 'B' END || ': ' || cnt, chr(10) ORDER BY side) AS line FROM facts GROUP BY comparison, question_id, code_idx, code_name) GROUP BY sample_id"
_SECTIONS = rf"""parts AS MATERIALIZED (SELECT {_ID} AS sample_id, side, thinking, side = max(side) OVER (PARTITION BY comparison, question_id) AS is_last FROM traces),
    sections AS MATERIALIZED (SELECT sample_id, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS side, regexp_replace(regexp_replace(CASE WHEN is_last THEN thinking || chr(10) || chr(10) || summary ELSE thinking END, '^\s+', ''), '\s+$', '') AS section FROM parts JOIN ({_SUMMARY}) USING (sample_id))"""


query("t10_split_sections_whole", with_views(FACTS, _SECTIONS) + "SELECT sample_id, side, length(section) AS n_chars, md5(section) AS digest FROM sections")(
    lambda s, d: an.split_sections(combined(s, d)).select("sample_id", "side", F.length("section").cast("long").alias("n_chars"), F.md5("section").alias("digest"))
)
query("t8_added_codes", "SELECT 'p_' || p_partkey AS update_id, 0::INT AS step, 'add' AS action, p_name AS code_name, p_type || ' of size ' || p_size AS definition FROM part")(
    lambda s, d: an.parse_new_codes(t.table(s, d, "part").select(F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("update_id"), F.concat(F.lit("Some thoughts.\nFinal output:\n### Added\n1. **"), "p_name", F.lit("**: "), "p_type", F.lit(" of size "), F.col("p_size").cast("string"), F.lit("\n- none: nothing else to add\n- "), "p_name", F.lit(": the same name once more")).alias("text")), list(t.SEED_CODES))
)

# ---- files ------------------------------------------------------------------


def _files(rows: DataFrame, label: str, *folders: str) -> str:
    """``rows(value, folders...)`` as text files, one a row, in a folder for each value of each of ``folders``."""
    path = scratch_path(rows.sparkSession, label)
    rows.select("value", *folders).repartition(*folders).write.partitionBy(*folders).text(path)
    return path


query(
    "s1_scan_traces",
    U_ + r"SELECT 'm' || conv_id % 3 AS model, (conv_id * 100 + turn)::VARCHAR AS question_id, regexp_replace(regexp_replace(question, '^\s+', ''), '\s+$', '') AS question, length(question) AS n_thinking, regexp_replace(regexp_replace(answer, '^\s+', ''), '\s+$', '') AS answer FROM turns WHERE turn % 5 <> 4 AND length(question) >= 10",
)(lambda s, d: _trace_files(s, turns(s, d)))


def _trace_files(s, rows: DataFrame) -> DataFrame:
    """All turns by the scan of their files."""
    found = scan.scan_traces(s, _trace_folder(rows))
    return found.select("model", "question_id", "question", F.length("thinking").cast("long").alias("n_thinking"), "answer")


def _trace_folder(rows: DataFrame) -> str:
    """All turns as trace files in a folder a model; those of every fifth turn are raw outputs, which readers leave out."""
    value = F.concat(F.lit("### QUESTION:\n"), "question", F.lit("\n### THINKING:\n<think>"), F.reverse("question"), F.lit("</think>\n### ANSWER:\n"), "answer")
    name = F.concat(F.when(F.col("turn") % 5 == 4, "raw_output_").otherwise("set_"), F.lit("question_id_"), (F.col("conv_id") * 100 + F.col("turn")).cast("string"))
    path = scratch_path(rows.sparkSession, "traces")
    trace_source.write_files(rows.where("length(question) >= 10").select(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("folder"), F.concat(name, F.lit(".txt")).alias("name"), value.alias("value")), path)
    return path


query(
    "s1_traces_of_models",
    U_ + r"SELECT 'm' || conv_id % 3 AS model, (conv_id * 100 + turn)::VARCHAR AS question_id, regexp_replace(regexp_replace(question, '^\s+', ''), '\s+$', '') AS question, length(question) AS n_thinking, regexp_replace(regexp_replace(answer, '^\s+', ''), '\s+$', '') AS answer FROM turns WHERE turn % 5 <> 4 AND length(question) >= 10 AND conv_id % 3 <> 1",
)(lambda s, d: _traces_of_models(s, turns(s, d)))


def _traces_of_models(s, rows: DataFrame) -> DataFrame:
    """The same files by the format of traces, those of two of the three models: the third one's folder is not listed."""
    found = trace_source.load_traces(s, _trace_folder(rows), ["m0", "m2"])
    return found.select("model", "question_id", "question", F.length("thinking").cast("long").alias("n_thinking"), "answer")


query("s3_scan_json_tasks", "SELECT 'item-' || item_id AS task, CASE WHEN item_id % 7 = 0 THEN NULL ELSE length(text) END AS n_chars, item_id % 7 = 0 AS broken FROM benchmark")(lambda s, d: _task_files(s, t.table(s, d, "benchmark")))


def _task_files(s, items: DataFrame) -> DataFrame:
    """All items as JSON objects, one a file; every seventh is cut short and is quarantined."""
    whole = F.to_json(F.struct(F.col("text").alias("question"), F.col("item_id").alias("number")))
    value = F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("{\n"), F.substring(whole, F.lit(2), F.length(whole) - 2))).otherwise(whole)
    path = _files(items.select(value.alias("value"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("task")), "tasks", "task")
    tasks, broken = scan.scan_json_tasks(s, path, "question string, number long", "task=*/*.txt")
    good = tasks.select("task", F.length("question").cast("long").alias("n_chars"), F.lit(False).alias("broken"))
    return good.unionByName(broken.select("task", F.lit(None).cast("long").alias("n_chars"), F.lit(True).alias("broken")))


query(
    "s8_scan_experiment_stats",
    "SELECT 'd' || o_custkey % 10 AS dataset, o_orderstatus AS model, count(*)::DOUBLE AS full_rate, CASE WHEN o_custkey % 10 = 3 THEN 0 ELSE max(o_orderkey % 7 + o_custkey)::DOUBLE END AS partial_rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey % 10, o_orderstatus",
)(lambda s, d: _stats_files(s, t.table(s, d, "orders")))


def _stats_files(s, orders: DataFrame) -> DataFrame:
    """A summary file for each dataset and model; one model is ignored, one dataset has no partial rate."""
    number = F.col("o_custkey") % 10
    rates = orders.groupBy(F.concat(F.lit("d"), number.cast("string"), F.lit("_intervention_experiment")).alias("folder"), F.col("o_orderstatus").alias("model"), number.alias("number")).agg(F.count("*").alias("n"), F.max(F.col("o_orderkey") % 7 + F.col("o_custkey")).alias("m"))
    partial = F.when(F.col("number") == 3, "").otherwise(F.concat(F.lit("\nPartial success rate: "), F.col("m").cast("string")))
    path = _files(rates.select(F.concat(F.lit("Full success rate: "), F.col("n").cast("string"), partial).alias("value"), "folder", "model"), "stats", "folder", "model")
    return scan.scan_experiment_stats(s, path, ("P",), "folder=*_intervention_experiment/model=*/*.txt")
