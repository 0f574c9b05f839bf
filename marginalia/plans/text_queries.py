"""Queries on texts: sections, prompts, parsers, grading, sources and sinks, the incremental path."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import annotations as an
from marginalia.functions import text as fx
from marginalia.operators import codebook as cb
from marginalia.operators import names as name_index
from marginalia.operators import classify, pairs, stats, vectors
from marginalia.operators.stats import r6
from marginalia.sources import scan
from marginalia.sources import tables as t
from marginalia.sources.scratch import scratch_path
from marginalia.streaming import incremental

from . import experiments
from .catalog import CODEBOOK, FACTS, PAIRS, STATS, STATUS, TRACES, TURNS, query, with_views

U_ = with_views(TURNS)
F_ = with_views(FACTS)


def turns(s, d):
    return t.turns(s, d)


# ---- sections and spans -----------------------------------------------------

_BLANKS = r"[ \t\n\x0B\f\r]+"  # white space of any kind, of which SQL's trim takes spaces only
query(
    "p1_thinking_fallback",
    U_ + f"SELECT conv_id, turn, CASE WHEN size < 10 THEN answer ELSE q END AS thinking, CASE WHEN size = 0 THEN '' ELSE answer END AS answer FROM (SELECT *, length(regexp_replace(regexp_replace(q, '^{_BLANKS}', ''), '{_BLANKS}$', '')) AS size FROM (SELECT conv_id, turn, coalesce(substring(question, 1, (conv_id % 15)::INT), '') AS q, coalesce(answer, '') AS answer FROM turns))",
)(lambda s, d: _fallback(turns(s, d)))


def _fallback(rows):
    short = F.expr("substring(question, 1, int(conv_id % 15))")
    thinking, answer = fx.thinking_fallback(short, F.col("answer"))
    return rows.select("conv_id", "turn", thinking.alias("thinking"), answer.alias("answer"))


query(
    "p1_thinking_fallback_whole",
    U_ + "SELECT conv_id, turn, CASE WHEN length(trim(q)) < 10 THEN answer ELSE q END AS thinking, CASE WHEN length(trim(q)) = 0 THEN '' ELSE answer END AS answer FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN '  ' WHEN 1 THEN substring(question, 1, (conv_id % 9 + 1)::INT) ELSE question END AS q, answer FROM turns)",
)(lambda s, d: _fallback_whole(turns(s, d)))


def _fallback_whole(rows):
    """Whole questions as thinking; a quarter of the turns is made blank or 1-9 characters long."""
    case = (F.col("conv_id") + F.col("turn")) % 8
    some = F.when(case == 0, F.lit("  ")).when(case == 1, F.expr("substring(question, 1, int(conv_id % 9 + 1))")).otherwise(F.col("question"))
    thinking, answer = fx.thinking_fallback(some, F.col("answer"))
    return rows.select("conv_id", "turn", thinking.alias("thinking"), answer.alias("answer"))


query("p3_strip_think_tags", U_ + "SELECT conv_id, turn, question || answer AS text FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.strip_think_tags(F.concat(F.lit("\n<think>"), "question", F.lit("</think>"), "answer", F.lit("\n\n"))).alias("text"))
)
query("p4_after_last_think", U_ + "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN answer ELSE question || answer END AS text FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.after_last_think(F.concat("question", F.when(F.col("turn") % 4 == 0, F.lit("</think>x</think>")).otherwise(""), "answer")).alias("text"))
)
query("p5_split_think_span", U_ + "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN question ELSE '' END AS thinking, CASE WHEN turn % 4 = 0 THEN answer ELSE '<think>' || question || answer END AS answer FROM turns")(lambda s, d: _span(turns(s, d)))


def _span(rows):
    whole = F.concat(F.lit("<think>"), "question", F.when(F.col("turn") % 4 == 0, F.lit("</think>")).otherwise(""), "answer")
    thinking, answer = fx.split_think_span(whole)
    return rows.select("conv_id", "turn", thinking.alias("thinking"), answer.alias("answer"))


def _trace_text():
    return F.concat(F.lit("### QUESTION:\n"), "question", F.lit("\n### THINKING:\n<think>"), F.reverse("question"), F.lit("</think>\n### ANSWER:\n"), "answer")


query("s2_p2_parse_trace_sections", U_ + r"SELECT conv_id, turn, regexp_replace(regexp_replace(question, '^\s+', ''), '\s+$', '') AS question, length(question) AS n_thinking, regexp_replace(regexp_replace(answer, '^\s+', ''), '\s+$', '') AS answer FROM turns WHERE length(question) >= 10")(
    lambda s, d: scan.parse_traces(turns(s, d).where("length(question) >= 10").select("conv_id", "turn", _trace_text().alias("value"))).select("conv_id", "turn", "question", F.length("thinking").cast("long").alias("n_thinking"), "answer")
)
query("p6_m18_encode_model", "SELECT doc_id, CASE WHEN source < 'src2' THEN 'model-' || upper(substring(source, 4)) ELSE source END AS alias FROM documents")(
    lambda s, d: fx.encode_models(t.table(s, d, "documents").select("doc_id", F.col("source").alias("model")), t.table(s, d, "documents").where("source < 'src2'").select(F.col("source").alias("model"), F.concat(F.lit("model-"), F.upper(F.substring("source", 4, 9))).alias("alias")).distinct()).select("doc_id", "alias")
)
query("p12_clean_code_name", "SELECT event_id, event_type AS code_name FROM events")(lambda s, d: t.table(s, d, "events").select("event_id", fx.clean_code_name(F.concat(F.lit("### **["), "event_type", F.lit("]**"))).alias("code_name")).withColumn("code_name", F.ltrim("code_name")))
query("p14_question_prompts", U_ + "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN question || chr(10) || 'Put the final number in \\boxed{}.' WHEN 1 THEN 'Complete the assertion.' || chr(10) || '[PYTHON]' || chr(10) || question || chr(10) || '[/PYTHON]' || chr(10) || 'Answer between [ANSWER] and [/ANSWER].' ELSE question END AS prompt FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.question_prompt(F.when(F.col("turn") % 3 == 0, "boxed").when(F.col("turn") % 3 == 1, "python").otherwise("plain"), F.col("question")).alias("prompt"))
)
_CH = "SELECT o_orderkey, pos, CASE pos WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderkey::VARCHAR ELSE o_custkey::VARCHAR END AS choice FROM orders, (SELECT unnest(range(0, 4)) AS pos)"
query(
    "p15_m14_shuffle_choices",
    f"WITH c AS ({_CH}), r AS (SELECT o_orderkey, pos, choice, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5(o_orderkey || ':' || pos), pos) AS k FROM c) SELECT o_orderkey, list(choice ORDER BY k) AS choices, substring('ABCD', max(k) FILTER (pos = 0), 1) AS gold FROM r GROUP BY o_orderkey",
)(lambda s, d: pairs.shuffled_choices(_choices(s, d), "o_orderkey", "choices"))


def _choices(s, d):
    return t.table(s, d, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("choices"))


query(
    "p16_intervention_injection",
    U_ + "SELECT conv_id, turn, question || chr(10) || 'A) yes' || chr(10) || 'B) no' || CASE WHEN turn % 4 = 0 THEN chr(10) || 'Summarise first.' ELSE '' END || chr(10) || 'Format the answer as: the correct answer is (letter).' AS prompt FROM turns",
)(lambda s, d: turns(s, d).select("conv_id", "turn", fx.inject(fx.choice_prompt(F.col("question"), F.array(F.lit("yes"), F.lit("no"))), F.col("turn") % 4 == 0, "Summarise first.").alias("prompt")))


def _defined(s):
    return t.codebook(s).withColumn("definition", F.concat(F.lit("uses the word "), "code_name"))


_LINES = "(SELECT string_agg(code_name || ': uses the word ' || code_name, chr(10) ORDER BY code_idx) AS book FROM codebook)"
query(
    "p17_render_annotation_prompt",
    with_views(TRACES, PAIRS, CODEBOOK)
    + f"SELECT doc_a AS sample_id, 'Annotate.' || chr(10) || book AS system, 'OUTPUT A:' || chr(10) || text_a || chr(10) || chr(10) || 'OUTPUT B:' || chr(10) || text_b AS \"user\" FROM pairs, {_LINES}",
)(lambda s, d: fx.annotation_prompts(pairs.pair_traces(t.traces(s, d)).select(F.col("doc_a").alias("sample_id"), F.array("text_a", "text_b").alias("outputs")), _defined(s), "Annotate."))
query(
    "p18_render_update_prompt",
    with_views(TRACES, PAIRS, CODEBOOK)
    + f"SELECT doc_a AS sample_id, 'Correct.' || chr(10) || book AS system, 'Output of m1:' || chr(10) || text_b || chr(10) || chr(10) || 'Output of m0:' || chr(10) || text_a || chr(10) || chr(10) || 'Annotation:' || chr(10) || 'none' AS \"user\" FROM pairs, {_LINES}",
)(
    lambda s, d: fx.update_prompts(
        pairs.pair_traces(t.traces(s, d)).select(F.col("doc_a").alias("sample_id"), F.array("text_a", "text_b").alias("outputs"), F.array(F.lit("m0"), F.lit("m1")).alias("labels"), F.array(F.lit("m1"), F.lit("m0")).alias("primary_labels"), F.lit("none").alias("annotation")), _defined(s), "Correct."
    )
)
query("p19_truncate_tokens", r"SELECT doc_id, array_to_string(string_split_regex(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+')[1:50], ' ') AS text FROM documents")(lambda s, d: t.table(s, d, "documents").select("doc_id", fx.truncate_tokens(F.col("text"), 50).alias("text")))
query("p20_truncate_annotation", U_ + "SELECT conv_id, turn, question AS text FROM turns")(lambda s, d: turns(s, d).select("conv_id", "turn", fx.truncate_annotation(F.concat("question", F.lit("\n### Count in OUTPUT A: 3\n"), "answer")).alias("text")))
query("p21_run_name_from_path", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'run' ELSE 'step-' || page_id END AS run FROM pages")(
    lambda s, d: t.table(s, d, "pages").select("page_id", fx.run_name_from_path(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("/runs/step_"), F.col("page_id").cast("string"), F.lit("/"), F.col("url"))), "run").alias("run"))
)
query("p23_examples_for_dataset", "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'science' WHEN 1 THEN 'math' WHEN 2 THEN 'code' ELSE 'general' END AS examples FROM conversations")(
    lambda s, d: t.table(s, d, "conversations").select("conv_id", "turn", fx.examples_for_dataset(F.element_at(F.array(F.lit("GPQA-x"), F.lit("my_MATH500"), F.lit("cruxeval"), F.lit("other")), (F.col("conv_id") % 4 + 1).cast("int"))).alias("examples"))
)

# ---- annotation parsers -----------------------------------------------------

query("t5_count_mentions", F_ + "SELECT doc_id, code_idx, code_name, cnt FROM facts")(lambda s, d: t.count_mentions(t.table(s, d, "documents").select("doc_id", F.col("text").alias("thinking"))))


def written_annotations(s, d):
    """Annotations of all pairs, written from the facts as an annotator would."""
    facts = t.facts(s, d).withColumn("letter", F.when(F.col("side") == 0, "A").otherwise("B"))
    key = F.concat_ws("_", F.col("comparison").cast("string"), F.col("question_id").cast("string"))
    line = F.concat(F.lit("### The reasoning behavior is "), F.when(F.col("cnt") > 0, "").otherwise("not "), F.lit("observed in OUTPUT "), "letter", F.lit("\nCount in OUTPUT "), "letter", F.lit(": "), F.col("cnt").cast("string"))
    per = facts.select(key.alias("sample_id"), "code_idx", "code_name", "side", line.alias("line")).groupBy("sample_id", "code_idx", "code_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code_idx", F.concat(F.lit("### **"), "code_name", F.lit("**\n"), "lines").alias("x")))), lambda r: r["x"]), "\n")
    return per.groupBy("sample_id").agg(text.alias("annotation"))


# A heading opens its code for both outputs: what an annotation doesn't say of an output is absent, also where a question has one output only.
_OPENED = "SELECT comparison || '_' || question_id AS sample_id, code_name, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS side, {value} FROM (SELECT DISTINCT comparison, question_id, code_idx, code_name FROM facts) CROSS JOIN (VALUES (0), (1)) s(side) LEFT JOIN facts USING (comparison, question_id, code_idx, code_name, side)"
query("t1_parse_presence", F_ + _OPENED.format(value="coalesce(cnt > 0, false) AS present"))(lambda s, d: an.parse_presence(written_annotations(s, d)))
query("t2_m5_parse_counts", F_ + _OPENED.format(value="coalesce(cnt, 0) AS cnt"))(lambda s, d: an.parse_counts(written_annotations(s, d)))
query("t3_m8_parse_decision", with_views(TRACES) + "SELECT DISTINCT comparison || '_' || question_id AS sample_id, 'a' AS side, c AS code_name, 'model-' || model AS model FROM traces, (VALUES ('the'), ('of')) v(c) WHERE side = 0")(
    lambda s, d: an.parse_decision(t.traces(s, d).where("side = 0").select(F.concat_ws("_", F.col("comparison").cast("string"), F.col("question_id").cast("string")).alias("sample_id"), F.concat(F.lit("### x\n### Final: Output A is written by model-"), "model", F.lit(" because of **the, of**.")).alias("annotation")))
)
query("t4_c9_parse_verdict", with_views(TRACES) + "SELECT doc_id, CASE WHEN side = 0 THEN model ELSE 'unknown' END AS author FROM traces")(
    lambda s, d: t.traces(s, d).select("doc_id", an.verdict_model(F.when(F.col("side") == 0, F.concat(F.lit("So the author model of output a is: **"), "model", F.lit("**. This follows."))).otherwise(F.col("thinking")), "a").alias("author"))
)
query("t6_combine_parts", "SELECT conv_id AS sample_id, role AS side, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg('Part ' || k || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY k) END AS annotation FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) GROUP BY conv_id, role")(
    lambda s, d: an.combine_parts(t.table(s, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("role").alias("side"), F.col("turn").alias("part_idx"), "text"))
)
_BODY = "SELECT comparison || '_' || question_id AS sample_id, string_agg('=== Annotation for OUTPUT ' || CASE side WHEN 0 THEN 'A' ELSE 'B' END || ' ===' || chr(10) || thinking, chr(10) || chr(10) ORDER BY side) AS body FROM traces GROUP BY ALL"
_CODE_LINES = "SELECT sample_id, string_agg(line, chr(10) ORDER BY code_idx) AS summary FROM (SELECT comparison || '_' || question_id AS sample_id, code_idx, '### ' || code_name || chr(10) || string_agg('Count in OUTPUT ' || CASE side WHEN 0 THEN 'A' ELSE 'B' END || ': ' || cnt, chr(10) ORDER BY side) AS line FROM facts GROUP BY comparison, question_id, code_idx, code_name) GROUP BY sample_id"
query("t7_combine_sides", F_ + f"SELECT sample_id, body || chr(10) || chr(10) || summary AS annotation FROM ({_BODY}) JOIN ({_CODE_LINES}) USING (sample_id)")(lambda s, d: combined(s, d))


def combined(s, d):
    key = F.concat_ws("_", F.col("comparison").cast("string"), F.col("question_id").cast("string")).alias("sample_id")
    side = F.when(F.col("side") == 0, "a").otherwise("b").alias("side")
    return an.combine_sides(t.traces(s, d).select(key, side, F.col("thinking").alias("annotation")), t.facts(s, d).select(key, side, "code_idx", "code_name", "cnt"))


# The annotation is cut at its headings, so its last output's section has the summary too.
_CUT = rf"SELECT sample_id, lower(part[1]) AS side, length(regexp_replace(regexp_replace(regexp_replace(part, '^.[^\n]*===\n?', ''), '^{_BLANKS}', ''), '{_BLANKS}$', '')) AS least FROM (SELECT sample_id, unnest(string_split(body || chr(10) || chr(10) || summary, '=== Annotation for OUTPUT ')[2:]) AS part FROM ({_BODY}) JOIN ({_CODE_LINES}) USING (sample_id)) WHERE lower(part[1]) = 'a'"
query("t10_e19_split_sections", F_ + _CUT)(
    lambda s, d: an.split_sections(combined(s, d)).where("side = 'a'").select("sample_id", "side", F.length("section").cast("long").alias("least"))
)
query("t8_e4_new_codes")(lambda s, d: an.parse_new_codes(t.table(s, d, "conversations").where("role = 'assistant'").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("update_id"), F.concat(F.lit("Final output:\nAdded:\n- "), F.substring("text", 1, 20), F.lit(": "), "text").alias("text")), list(t.SEED_CODES)))
query(
    "t9_extract_sequence",
    F_ + r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, code_idx FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, string_split_regex(lower(thinking), '[^\p{L}\p{N}]+') AS ws FROM traces)) JOIN codebook ON w = code_name QUALIFY pos <= 50""",
)(lambda s, d: an.extract_sequence(t.table(s, d, "documents").select("doc_id", "text"), list(t.SEED_CODES), ["doc_id"]))
query("t11_split_output")(lambda s, d: an.split_output(t.table(s, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(F.size(F.split("text", r"\s+"))).cast("long").alias("longest")))
query("t12_occurrence_to_sequence", F_ + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY code_idx, k) AS pos, code_name AS code FROM (SELECT doc_id, code_idx, code_name, unnest(range(0, cnt)) AS k FROM facts)")(lambda s, d: an.occurrence_to_sequence(t.facts(s, d), ["doc_id"]))
query("v2_reindex_sequences", F_ + "SELECT doc_id, code_name, 7 - code_idx AS code_idx, cnt FROM facts WHERE code_idx > 1")(
    lambda s, d: _reversed_index(s, d)
)


def _reversed_index(s, d):
    from marginalia.operators.sequences import reindex

    return reindex(t.facts(s, d).select("doc_id", "code_idx", "code_name", "cnt"), t.codebook(s).where("code_idx > 1").withColumn("code_idx", 7 - F.col("code_idx"))).select("doc_id", "code_name", "code_idx", "cnt")


# ---- grading ----------------------------------------------------------------

query("g1_j5_choice_letter", U_ + "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN conv_id % 4 WHEN 1 THEN (conv_id + 1) % 4 ELSE (conv_id + 2) % 4 END::INT AS letter FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.choice_letter(_choice_text()).alias("letter"))
)


def _choice_text():
    letter = lambda k: F.substring(F.lit("ABCD"), ((F.col("conv_id") + k) % 4 + 1).cast("int"), F.lit(1))
    return F.when(F.col("turn") % 4 == 0, F.concat("answer", F.lit("\nThe correct answer is ("), letter(0), F.lit(")"))).when(F.col("turn") % 4 == 1, F.concat("answer", F.lit("\nAnswer: "), letter(1))).otherwise(F.concat("question", F.lit(" so \\boxed{"), letter(2), F.lit("}")))


query("g2_g3_tagged_answers", U_ + r"SELECT conv_id, turn, regexp_replace(regexp_replace(question, '^\s+', ''), '\s+$', '') AS tagged, conv_id || ', ' || turn AS call FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.tagged_answer(F.concat("answer", F.lit("[ANSWER]\n"), "question", F.lit("\n[/ANSWER][ANSWER]x[/ANSWER]"))).alias("tagged"), fx.tagged_call_input(F.concat(F.lit("[ANSWER]assert f("), F.col("conv_id").cast("string"), F.lit(", "), F.col("turn").cast("string"), F.lit(") == 1[/ANSWER]"))).alias("call"))
)
query("g4_boxed_answers", U_ + "SELECT conv_id, turn, ['{' || conv_id || '}', 'x_{' || turn || '}'] AS boxes FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.boxed_answers(F.concat("question", F.lit("\\boxed{{"), F.col("conv_id").cast("string"), F.lit("}} "), F.lit("and \\boxed{x_{"), F.col("turn").cast("string"), F.lit("}} and \\boxed{open"))).alias("boxes"))
)
query("g5_program_output", U_ + r"SELECT conv_id, turn, regexp_replace(regexp_replace(answer, '^\s+', ''), '\s+$', '') AS output FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.program_output(F.concat(F.lit("```output\nold\n```\n"), "question", F.lit("\n```output\n"), "answer", F.lit("\n```\nend"))).alias("output"))
)
query("g6_g7_free_answer", U_ + "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '\\frac{' || conv_id || '}{7}' WHEN 1 THEN (conv_id * 10)::VARCHAR ELSE turn::VARCHAR END AS answer FROM turns")(
    lambda s, d: turns(s, d).select("conv_id", "turn", fx.free_answer(_free_text()).alias("answer"))
)


def _free_text():
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return F.when(F.col("turn") % 4 == 0, F.concat("question", F.lit(" \\boxed{\\dfrac "), F.lit("{"), conv, F.lit("}{7}}"))).when(F.col("turn") % 4 == 1, F.concat("question", F.lit(" The final answer is $"), conv, F.lit("0.00$. I hope it is correct."))).otherwise(F.concat("question", F.lit(" So the answer is: "), turn, F.lit(".\nThanks 99")))


query("g10_grade", "SELECT 'choice' AS dataset, source AS model, count(*) AS n, count(*) FILTER (doc_id % 4 = doc_id % 3) AS n_correct, round(avg((doc_id % 4 = doc_id % 3)::INT), 6) AS accuracy FROM documents GROUP BY source")(
    lambda s, d: fx.grade(t.table(s, d, "documents").select(F.lit("choice").alias("dataset"), F.col("source").alias("model"), F.concat("text", F.lit("\nThe correct answer is "), _letter_of(4)).alias("answer"), _letter_of(3).alias("gold")))
)


def _letter_of(n):
    return F.substring(F.lit("ABCD"), (F.col("doc_id") % n + 1).cast("int"), F.lit(1))


query(
    "g10_s5_status_shares",
    with_views(STATUS) + "SELECT source, count(*) AS n, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'wrong') AS wrong, count(*) FILTER (status IS NULL) AS unfinished FROM documents LEFT JOIN status USING (doc_id) GROUP BY source",
)(
    lambda s, d: t.table(s, d, "documents").select("doc_id", "source").join(t.correctness(s, d).hint("shuffle_merge"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "correct").alias("correct"), F.count_if(F.col("status") == "wrong").alias("wrong"), F.count_if(F.col("status").isNull()).alias("unfinished"))
)

# ---- sources and sinks -----------------------------------------------------


def _written(s, rows, sink, label):
    path = scratch_path(s, label)
    sink(rows, path)
    return s.read.parquet(path)


query("s4_scan_benchmark", "SELECT item_id, length(text) AS n_chars FROM benchmark")(
    lambda s, d: scan.scan_benchmark(s, s.createDataFrame([("bench", f"{d}/benchmark.parquet")], "name string, path string"), "bench").select("item_id", F.length("text").cast("long").alias("n_chars"))
)
query("s9_sink_traces", "SELECT lang AS dataset, source AS model, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ALL")(
    lambda s, d: _written(s, t.table(s, d, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("model"), "doc_id", "text"), scan.sink_traces, "traces").groupBy("dataset", "model").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
)
query("s10_m16_p22_sink_prompts", U_ + "SELECT conv_id * 100 + turn AS idx, 'chat' AS data_source, question AS content, answer AS gold, 'heldout' AS split FROM turns")(
    lambda s, d: _written(s, scan.with_split_label(scan.prompt_records(turns(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), "question", F.col("answer").alias("gold"), F.lit("train").alias("split")), "chat", "talk"), "heldout"), scan.sink_prompts, "prompts").select(
        F.col("extra_info.index").alias("idx"), "data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("gold"), F.col("split").cast("string").alias("split")
    )
)
query("s11_resume", with_views(STATUS) + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM status)")(
    lambda s, d: scan.resume(t.table(s, d, "documents").select("doc_id"), _written(s, t.correctness(s, d), lambda rows, path: rows.write.parquet(path), "state"), ["doc_id"])
)
query("s12_m19_sink_summary", with_views(STATUS) + "SELECT source, count(*) AS n, round(avg((status = 'correct')::INT) * 100, 6) AS accuracy FROM documents JOIN status USING (doc_id) GROUP BY source")(
    lambda s, d: _written(s, stats.accuracy(_graded(s, d), ["source"]).select("source", "n", "accuracy"), scan.sink_summary, "summary")
)
query("s13_sink_judgements", with_views(STATUS) + "SELECT doc_id, source FROM documents JOIN status USING (doc_id) WHERE status = 'correct'")(lambda s, d: _written(s, _graded(s, d), scan.sink_judgements, "judgements").select("doc_id", "source"))


def _graded(s, d):
    return t.table(s, d, "documents").select("doc_id", "source").join(t.correctness(s, d), "doc_id").withColumnRenamed("status", "outcome")


query("s6_scan_choice_orders", f"WITH c AS ({_CH}), r AS (SELECT o_orderkey, pos, choice, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5(o_orderkey || ':' || pos), pos) AS k FROM c), l AS (SELECT o_orderkey, list(choice ORDER BY k) AS choice_order FROM r GROUP BY o_orderkey) SELECT o_orderkey, l_linenumber, choice_order FROM lineitem JOIN l ON l_orderkey = o_orderkey")(
    lambda s, d: scan.with_choice_orders(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), _written(s, pairs.shuffled_choices(_choices(s, d), "o_orderkey", "choices").withColumnRenamed("choices", "choice_order"), lambda rows, path: rows.write.parquet(path), "orders"), ["o_orderkey"])
)

# ---- taxonomy ---------------------------------------------------------------


def versions(s, d):
    """A taxonomy of event types and versions by hour of first sight: each type's first and second event define it."""
    events = t.table(s, d, "events").groupBy(F.col("event_type").alias("code_name")).agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    one = events.select(F.lit(0).alias("version"), "code_name", F.concat(F.lit("first seen at "), F.col("first").cast("string")).alias("definition"))
    two = events.where("first % 2 = 0").select(F.lit(1).alias("version"), "code_name", F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times")).alias("definition"))
    return one.unionByName(two)


_VERSIONS = "e AS (SELECT event_type AS code_name, min(event_id) AS f, count(*) AS n FROM events GROUP BY ALL), versions AS (SELECT 0 AS version, code_name, 'first seen at ' || f AS definition FROM e UNION ALL SELECT 1, code_name, 'seen ' || n || ' times' FROM e WHERE f % 2 = 0)"
query("s14_m3_m4_latest_codebook", with_views(_VERSIONS) + "SELECT code_name, definition FROM versions WHERE version = 1")(lambda s, d: cb.latest(versions(s, d)).select("code_name", "definition"))
query("u6_codebook_diff", with_views(_VERSIONS) + "SELECT a.code_name, CASE WHEN b.code_name IS NULL THEN 'removed' ELSE 'redefined' END AS change FROM (SELECT * FROM versions WHERE version = 0) a LEFT JOIN (SELECT * FROM versions WHERE version = 1) b USING (code_name)")(lambda s, d: cb.versions_diff(versions(s, d), 0, 1))
query("e9_prune_top_k", with_views(FACTS, STATS) + "SELECT comparison, code_idx FROM stats QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY round(CASE WHEN c0 + c1 = 0 THEN 0 ELSE abs(c0 / (c0 + c1) - 0.5::DOUBLE) * (c0 + c1) END, 6) DESC, code_idx) <= 3")(
    lambda s, d: cb.prune("top_k", stats.code_stats(t.facts(s, d))).select("comparison", "code_idx")
)
query("e9_prune_equal", with_views(FACTS, STATS) + "SELECT comparison, code_idx FROM stats WHERE NOT (CASE WHEN c0 = 0 AND c1 = 0 THEN true WHEN c0 = 0 OR c1 = 0 THEN false ELSE abs(c0 * 100 / (c0 + c1) - 50) <= 5 END)")(lambda s, d: cb.prune("equal", stats.code_stats(t.facts(s, d))).select("comparison", "code_idx"))


def named_items(s, d):
    """Benchmark items as codes: the first words name one, the text defines it."""
    return t.table(s, d, "benchmark").select(F.col("item_id").cast("int").alias("code_idx"), fx.truncate_tokens(F.col("text"), 3).alias("code_name"), F.col("text").alias("definition"))


query(
    "e1_embed_codes",
    r"""WITH w AS (SELECT item_id::INT AS code_idx, unnest(string_split_regex(lower(array_to_string(string_split_regex(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+')[1:3], ' ') || ': ' || text), '\s+')[1:512]) AS word FROM benchmark),
    c AS (SELECT code_idx, (('0x' || substring(md5(word), 1, 8))::BIGINT % 768)::INT AS dim, count(*) AS n FROM w GROUP BY ALL)
    SELECT code_idx, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY code_idx)), 6) AS x FROM c""",
)(lambda s, d: cb.embed_codes(named_items(s, d)).withColumn("x", r6(F.col("x"))))
query("e2_group_similar_codes")(lambda s, d: cb.group_similar_codes(cb.embed_codes(named_items(s, d)), 0.35))
query("j8_fuzzy_match")(lambda s, d: name_index.fuzzy_match(t.table(s, d, "part").select(F.lower("p_name").alias("name")), named_items(s, d).select(F.col("code_idx").alias("ord"), F.col("code_name").alias("candidate")).unionByName(t.table(s, d, "part").groupBy("p_brand").agg(F.min(F.lower("p_name")).alias("candidate"), F.min("p_partkey").cast("int").alias("ord")).select("ord", "candidate")), 80))
query("v5_impute_iterative")(lambda s, d: vectors.impute_iterative(t.facts_missing(s, d)).select("doc_id", "code_idx", r6(F.col("value")).alias("value")))

# ---- experiments and the incremental path ---------------------------------

query("e6_e14_x1_grow_taxonomy")(lambda s, d: experiments.grow_taxonomy(s, t.traces(s, d), list(t.SEED_CODES[:4]), rounds=3, per_round=None, max_codes=12)[0])
query(
    "e14_fixed_taxonomy",
    F_ + """, q AS (SELECT comparison, question_id, (row_number() OVER (PARTITION BY comparison ORDER BY md5('1:' || question_id)) - 1) * 3 // count(*) OVER (PARTITION BY comparison) AS round FROM (SELECT DISTINCT comparison, question_id FROM traces)),
    dealt AS (SELECT doc_id, cnt, round FROM facts JOIN q USING (comparison, question_id) WHERE code_idx < 4)
    SELECT r.round::INT AS round, 4 AS codes, count(DISTINCT doc_id) AS samples, sum(cnt)::BIGINT AS cnt FROM (SELECT DISTINCT round FROM dealt) r JOIN dealt d ON d.round <= r.round GROUP BY r.round""",
)(lambda s, d: experiments.grow_taxonomy(s, t.traces(s, d), list(t.SEED_CODES[:4]), rounds=3, per_round=None, max_codes=12, propose=None)[0])
query("e12_transfer")(lambda s, d: experiments.transfer(t.facts(s, d), experiments.directions(t.traces(s, d))))
query("e13_train_concat")(lambda s, d: experiments.train_concat(s, t.traces(s, d), list(t.SEED_CODES), rounds=3, max_codes=12)[0])
query(
    "e11_evaluate_averaged",
    F_ + "SELECT comparison, code_idx, side, round(avg((cnt + cnt + 1) / 2), 6) AS mean FROM facts GROUP BY ALL",
)(lambda s, d: _averaged(s, d))


def _averaged(s, d):
    facts = t.facts(s, d)
    runs = pairs.repeated(facts.select("doc_id", "code_idx", "cnt"), 2).withColumn("cnt", F.col("cnt") + F.col("run"))
    return stats.centroids(experiments.averaged(facts, runs)).select("comparison", "code_idx", "side", r6(F.col("mean")).alias("mean"))


query(
    "e15_baseline_verdict",
    with_views(TRACES, PAIRS) + "SELECT comparison, count(*) AS n, count(*) FILTER (length(text_a) >= length(text_b)) AS n_correct, round(avg((length(text_a) >= length(text_b))::INT) * 100, 6) AS accuracy FROM pairs GROUP BY comparison",
)(lambda s, d: stats.accuracy(experiments.judged_by_verdict(_guessed_by_length(s, d)), ["comparison"]))


def _guessed_by_length(s, d):
    """Pairs judged without training: the longer output is said to be the first model's."""
    model = lambda x: F.concat(F.lit("src"), (F.col("comparison") * 2 + x).cast("string"))
    longer = F.length("text_a") >= F.length("text_b")
    said = lambda x, first: F.concat(F.lit(f"The author model of output {x} is **"), F.when(first, model(0)).otherwise(model(1)), F.lit("**.\n"))
    return pairs.pair_traces(t.traces(s, d)).select("comparison", "question_id", model(0).alias("model_a"), model(1).alias("model_b"), F.concat(said("a", longer), said("b", ~longer)).alias("annotation"))


query(
    "e16_direct_rules",
    F_ + """, train AS (SELECT * FROM facts WHERE NOT md5('7:' || question_id) < '4'), test AS (SELECT * FROM facts WHERE md5('7:' || question_id) < '4'),
    st AS (SELECT comparison, code_idx, sum(cnt) FILTER (side = 0) AS c0, sum(cnt) FILTER (side = 1) AS c1 FROM train GROUP BY ALL),
    rules AS (SELECT comparison, code_idx, CASE WHEN c0 > c1 THEN 1 ELSE -1 END AS w FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY round(CASE WHEN c0 + c1 = 0 THEN 0 ELSE abs(c0 / (c0 + c1) - 0.5::DOUBLE) * (c0 + c1) END, 6) DESC, code_idx) <= 4) WHERE c0 <> c1),
    b AS (SELECT comparison, question_id, side, coalesce(sum(cnt * w), 0) AS b FROM test LEFT JOIN rules USING (comparison, code_idx) GROUP BY ALL)
    SELECT comparison, count(*) AS n, count(*) FILTER (x.b >= y.b) AS n_correct, round(avg((x.b >= y.b)::INT) * 100, 6) AS accuracy FROM b x JOIN b y USING (comparison, question_id) WHERE x.side = 0 AND y.side = 1 GROUP BY comparison""",
)(lambda s, d: _direct(s, d))


def _direct(s, d):
    facts = t.facts(s, d)
    held_out = classify.is_eval(F.col("question_id"))
    rules = experiments.direct_rules(facts.where(~held_out), 4)
    return stats.accuracy(experiments.judged_by_verdict(experiments.rule_annotations(rules, facts.where(held_out))), ["comparison"])


_INC = "SELECT 'train' AS split, code_name, model, count(*) FILTER (cnt > 0) AS n FROM facts GROUP BY ALL"


def _arrivals(s, d):
    """Annotations as they arrive: a first version of every trace without counts, then one with them."""
    line = lambda x, n: F.concat(F.lit("### "), x["code_name"], F.lit("\nCount in OUTPUT A: "), n.cast("string"))
    text = lambda n: F.array_join(F.transform("held", lambda x: line(x, n(x))), "\n")
    held = t.facts(s, d).groupBy("model", "doc_id").agg(F.array_sort(F.collect_list(F.struct("code_idx", "code_name", "cnt"))).alias("held"))
    both = F.array(*(F.struct(F.lit(i).alias("version"), text(n).alias("annotation")) for i, n in enumerate((lambda _: F.lit(0), lambda x: x["cnt"]))))
    return held.select("model", "doc_id", both.alias("both")).select(F.lit("train").alias("split"), "model", F.col("doc_id").cast("string").alias("sample_id"), F.inline("both"))


_SCHEMA = "split string, model string, sample_id string, version int, annotation string"
query("r1_batch_code_counts", F_ + _INC)(lambda s, d: incremental.code_counts(incremental.annotation_facts(_arrivals(s, d))))
query("r1_incremental_code_counts", F_ + _INC)(lambda s, d: _streamed(s, d))


def _streamed(s, d):
    path = scratch_path(s, "arrivals")
    _arrivals(s, d).repartition(4, "version", "sample_id").write.parquet(path)
    return incremental.run_incremental(s, path, _SCHEMA, files_per_batch=2)
