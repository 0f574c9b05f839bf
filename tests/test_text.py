"""Parsers, names and graders on hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import annotations as an
from marginalia.functions import text as fx
from marginalia.sources import scan


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_scan_traces(spark, tmp_path):
    folder = tmp_path / "m1"
    folder.mkdir()
    body = "### QUESTION:\n{q}\n### THINKING:\n{t}\n### ANSWER:\n{a}\n"
    (folder / "set_question_id_3_m1.txt").write_text(body.format(q="what", t="<think>a long enough thought</think>", a="42\n### CHOICES ORDER\nx"))
    (folder / "set_question_id_4_m1.txt").write_text(body.format(q="why", t="", a="because of this"))
    (folder / "set_question_id_5_m1.txt").write_text(body.format(q="how", t="short", a="in this way"))
    (folder / "set_question_id_sample_6_m1.txt").write_text("### ANSWER:\nonly")
    (folder / "set_question_id_7_raw_output.txt").write_text("x")
    (folder / "set_no_id.txt").write_text("x")
    rows = {r.question_id: r for r in scan.scan_traces(spark, str(tmp_path)).collect()}
    assert set(rows) == {"3", "4", "5", "6"}
    assert (rows["3"].question, rows["3"].thinking, rows["3"].answer) == ("what", "a long enough thought", "42")
    assert (rows["4"].thinking, rows["4"].answer) == ("because of this", "")
    assert (rows["5"].thinking, rows["5"].answer) == ("in this way", "in this way")
    assert (rows["6"].question, rows["6"].thinking, rows["6"].answer) == ("", "only", "")
    assert {r.model for r in rows.values()} == {"m1"}


def test_scan_json_tasks(spark, tmp_path):
    (tmp_path / "good.json").write_text('{\n "question": "q",\n "level": 2\n}')
    (tmp_path / "bad.json").write_text('{"question": ')
    tasks, broken = scan.scan_json_tasks(spark, str(tmp_path), "question string, level int")
    assert [(r.task, r.question, r.level) for r in tasks.collect()] == [("good", "q", 2)]
    assert [r.task for r in broken.collect()] == ["bad"]


def test_scan_experiment_stats(spark, tmp_path):
    for model, text in (("m1", "Full success rate: 0.75\nPartial success rate: 0.1"), ("m2", "full success rate = 0.5"), ("m3", "x")):
        folder = tmp_path / "gpqa_intervention_experiment" / model
        folder.mkdir(parents=True)
        (folder / "s.txt").write_text(text)
    rows = {r.model: (r.dataset, r.full_rate, r.partial_rate) for r in scan.scan_experiment_stats(spark, str(tmp_path), ("m3",)).collect()}
    assert rows == {"m1": ("gpqa", 0.75, 0.1), "m2": ("gpqa", 0.5, 0.0)}


@pytest.mark.parametrize(("text", "want"), [("a</think>b</think>c", "c"), ("no tag", "no tag"), ("x</think>", "")])
def test_after_last_think(spark, text, want):
    assert one(spark, fx.after_last_think(F.col("t")), t=text) == want


def test_cut_choices_order(spark):
    assert one(spark, fx.cut_choices_order(F.col("t")), t="a\n### CHOICES ORDER b\n### CHOICES ORDER c\nd") == "a\n### CHOICES ORDER b\n"


def test_names(spark):
    assert tuple(one(spark, fx.parse_run_folder(F.col("t")), t="my-model-inst-intervened-run-12")) == ("my-model", "inst-intervened", 12)
    assert one(spark, fx.parse_run_folder(F.col("t")), t="my-model-run-12") is None
    assert one(spark, fx.is_clean_rule(F.col("t")), t="Hypothesis testing") is False
    assert one(spark, fx.is_clean_rule(F.col("t"), drop_the=False), t="Hypothesis testing") is True
    assert one(spark, fx.is_clean_rule(F.col("t")), t="Both models count") is False
    aliases = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "model string, alias string")
    assert [r.alias for r in fx.ambiguous_aliases(aliases).collect()] == ["x"]


PRESENCE = """### Backtracking
said before
### The reasoning behavior is observed in OUTPUT A
### The reasoning behavior is not observed in OUTPUT B
### A heading that has far too many words to be a code at all here
### The reasoning behavior is observed in OUTPUT B
### Verification:
### Output A planning
### Final check
### The reasoning behavior is observed in OUTPUT B
### Conclusion first
### Whether this counts
### Backtracking
### The reasoning behavior is observed in OUTPUT B"""


def test_parse_presence_resets_on_reopening(spark):
    rows = spark.createDataFrame([("s", PRESENCE), ("none", "### The reasoning behavior is observed in OUTPUT A"), ("null", None)], "sample_id string, annotation string")
    got = {(r.sample_id, r.code_name, r.side): r.present for r in an.parse_presence(rows).collect()}
    held = {"Backtracking": True, "Final check": True, "Conclusion first": False, "Whether this counts": False}
    assert got == {("s", c, s): s == "b" and b for c, b in held.items() for s in "ab"}


COUNTS = """### **Restating**
Count in OUTPUT A: 4
It is not observed in OUTPUT B.
### Whether this behavior is used
### How many times it is used
### Guessing
It is observed in OUTPUT A
Count in OUTPUT B: 2, not observed in output a or not, is observed in OUTPUT B
### Conclusion
Count in OUTPUT A: **3**
### Guessing again
### Guessing
It is observed in OUTPUT A
count in output b:2"""


def test_parse_counts_in_order(spark):
    rows = spark.createDataFrame([("s", COUNTS)], "sample_id string, annotation string")
    got = {(r.code_name, r.side): r.cnt for r in an.parse_counts(rows).collect()}
    assert got == {("Restating", "a"): 4, ("Restating", "b"): 0, ("Guessing", "a"): 1, ("Guessing", "b"): 2, ("Conclusion", "a"): 0, ("Conclusion", "b"): 0, ("Guessing again", "a"): 0, ("Guessing again", "b"): 0}


@pytest.mark.parametrize(
    ("text", "want"),
    [("The author model of output A is **m-1**. The rest", "m-1"), ("the author model of output a is model [x-2], as", "x-2"), ("the author model of output a is m-3\nnext", "m-3"), ("nothing", "unknown"), (None, "unknown"), ("the author model of output a is m-4.", "m-4")],
)
def test_verdict_model(spark, text, want):
    assert one(spark, an.verdict_model(F.col("t"), "a"), t=text) == want


def test_similarity():
    assert an.similarity("Backtracking", "backtracking") == 100
    assert an.similarity("ab", "ba") == 50
    assert an.similarity("", "x") == 0


def test_new_codes():
    text = "Thoughts\nFinal output:\nAdded:\n- Case analysis: splits the problem into cases\n- Case analysys: splits the problem in cases\n- none: nothing to add here\n- Short: tiny\n**Updated:**\n1. Backtrackin -> Going back: returns to an earlier step\n"
    assert list(an.new_codes(text, ["Backtracking", "Guessing"])) == [("add", "Case analysis", "splits the problem into cases"), ("update", "Backtracking", "returns to an earlier step")]
    many = "Added:\n" + "\n".join(f"{chr(97 + i) * 9}: a definition that is long" for i in range(12))
    assert len(list(an.new_codes(many, []))) == 9
    assert next(iter(an.new_codes("Added:\nlong one: " + "x" * 3000, [])))[2] == "x" * 2000 + "..."


def test_cut_words():
    words = [f"w{i}" for i in range(600)]
    assert an.cut_words(" ".join(words[:250]), 250, 50) == [" ".join(words[:250])]
    words[229] += "."
    parts = an.cut_words(" ".join(words), 250, 50)
    assert [len(p.split()) for p in parts] == [230, 250, 120]
    assert " ".join(parts) == " ".join(words)
    assert an.cut_words("", 250, 50) == [""]


def test_extract_sequence(spark):
    rows = spark.createDataFrame([("s", "aa bb aaa aa-cc dd e"), ("t", None)], "k string, text string")
    got = [(r.k, r.pos, r.code_idx) for r in an.extract_sequence(rows, ["aa", "dd e", "cc"], ["k"]).orderBy("k", "pos").collect()]
    assert got == [("s", 1, 0), ("s", 2, 0), ("s", 3, 2), ("s", 4, 1)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("The correct answer is (B) but the correct answer is: C.", 2), ("Answer: D", 3), ("so \\boxed{\\text{A}}", 0), ('{"answer": "B"}', 1), ("none", 4), (None, 4)],
)
def test_choice_letter(spark, text, want):
    assert one(spark, fx.choice_letter(F.col("t")), t=text) == want


def test_grade_choice(spark):
    rows = spark.createDataFrame([("the correct answer is (B)", ["Wrong 1", "Correct Answer"]), ("the correct answer is (D)", ["Correct Answer"]), (None, None)], "answer string, choice_order array<string>")
    assert [r.correct for r in fx.grade_choice(rows).collect()] == [True, False, False]


FREE = [
    ("\\boxed{\\dfrac{1}{2}}", "\\frac{1}{2}"),
    ("x \\boxed{\\frac12} y \\boxed{3.50}", "3.50"),
    ("final answer is $3/4$. I hope it helps", "\\frac{3}{4}"),
    ("$. I hope so, the final answer is $7 apples", "7apples"),
    ("The answer is: 12.\nmore", "12"),
    ("The answer is 1. No, the answer is :: 5/.", "5"),
    ("so we get 1,234 apples", "1234"),
    ("at -.5 or so", "-.5"),
    ("```output\n7\n```", "7"),
    ("\\boxed{5\\text{ cm}}", "5"),
    ("\\boxed{\\sqrt2}", "\\sqrt{2}"),
    ("\\boxed{x = 5}", "x=5"),
    ("\\boxed{0.5}", "0.5"),
    ("\\boxed{50}%", "50}"),
    ("a boxed result: 12", ""),
    ("nothing", ""),
    (None, ""),
]


def test_free_answer(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(FREE)], "i int, t string").select("i", fx.free_answer(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [want for _, want in FREE]


#: Answers and their normal forms, worked out by hand from the rules.
MATH = [
    (" 5 ", "5"),
    ("5.", "5"),
    ("5,", "5"),
    ("1\n2", "12"),
    ("7\\!8", "78"),
    ("\\text{yes}", "yes"),
    ("\\text{a} \\text{b}", "a}\\text{b"),
    ("5\\text{ miles}", "5"),
    ("12 \\text{sq} \\text{ m}", "12"),
    ("\\dfrac12", "\\frac{1}{2}"),
    ("\\tfrac{3}{4}", "\\frac{3}{4}"),
    ("\\cfrac12", "\\frac{1}{2}"),
    ("\\frac1{72}", "\\frac{1}{72}"),
    ("\\frac{72}1", "\\frac{72}1"),
    ("\\frac12+\\frac1{23}", "\\frac{1}{2}+\\frac{1}{23}"),
    ("\\frac12+\\frac1", "\\frac12+\\frac1"),
    ("\\left(1,2\\right)", "(1,2)"),
    ("90^{\\circ}", "90"),
    ("90^\\circ", "90"),
    ("3{cm}^2", "3"),
    ("4{m}", "4"),
    ("7 t", "7"),
    ("\\$5", "5"),
    ("$x\\in[0,1]$", "[0,1]"),
    ("50\\%", "50%"),
    (" .5", "0.5"),
    ("\\frac{.5}{2}", "\\frac{0.5}{2}"),
    ("3\\cdot4", "34"),
    ("infinity", "\\infty"),
    ("-inf", "-\\infty"),
    ("inf, \\infty", "inf,\\infty"),
    ("\\mathbf{x}", "{x}"),
    ("\\mathrm{e}", "{e}"),
    ("3\\mbox{ units}4", "34"),
    ("2+3j", "2+3i"),
    ("ij", "ij"),
    ("2.00", "2"),
    ("2.0x", "2x"),
    ("2.50", "2.50"),
    ("\\sqrt12", "\\sqrt{12}"),
    ("\\sqrt 12", "\\sqrt{12}"),
    ("\\sqrt{3}", "\\sqrt{3}"),
    ("\\tan12", "\\tan{12}"),
    ("\\tan x", "\\tan{x}"),
    ("a b", "ab"),
    ("3/4", "\\frac{3}{4}"),
    ("-3/4", "\\frac{-3}{4}"),
    ("03/4", "03/4"),
    ("x/4", "x/4"),
    ("\\sqrt{2}/2", "\\frac{\\sqrt{2}}{2}"),
    ("1/2/3", "1/2/3"),
    ("x=5", "x=5"),
    ("0.5", "0.5"),
    ("1\\\\", "1"),
    ("", ""),
]


def test_math_normal(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(MATH)], "i int, t string").select("i", fx.math_normal(F.col("t")).alias("x")).orderBy("i").collect()
    assert [(MATH[r.i][0], r.x) for r in rows] == MATH


def test_list_and_suite_answers(spark):
    lists = [("give them separated by commas", "\\boxed{1, 2} and \\boxed{(3, 4)}", ["1", "2", "(3,4)"]), ("all", "\\boxed{1, 2 \\text{ and } 3}", ["1,2", "3"]), (None, "the answer is 1, 2", ["1,2"]), ("x", None, [])]
    for question, text, want in lists:
        assert one(spark, fx.list_answers(F.col("q"), F.col("t")), q=question, t=text) == want
    suites = [
        ("gsm_few_shot", "x 4 then -42.5 apples\nQ: 7", "-42.5"),
        ("gsm_few_shot", "none", "[invalid]"),
        ("single", "The answer is 9", "9"),
        ("gaokao_cloze", "答案是 $3$ \n x 问题 9", "3"),
        ("gaokao_cloze", "x", "placeholder"),
        ("gaokao_choice", "答案是 A\n答案是 B", "A"),
        ("sat_few_shot", "The final answer is (c). Problem: the final answer is a", "C"),
        ("mmlu_stem", "no", "placeholder"),
        ("courses_few_shot", "final answer is 3 eV. I hope it is correct.", "3 eV"),
        ("courses_few_shot", "3 eV", "[invalid]"),
        ("formal_proof", " by simp \nInformal: x", "by simp"),
        ("cmath_few_shot", "答案是：12.5。问题：7", "12.5"),
        ("cmath_few_shot", "答案是 x", "[invalid]"),
        ("cmath_few_shot", "so \\boxed{8}", "8"),
    ]
    for suite, text, want in suites:
        assert one(spark, fx.suite_answer(F.col("t"), suite), t=text) == want
    assert one(spark, fx.suite_list_answers(F.lit("separated by commas"), F.col("t")), t="\\boxed{1,2} Problem: \\boxed{3}") == ["1", "2"]
    with pytest.raises(ValueError, match="unknown suite"):
        fx.suite_answer(F.lit("x"), "none")


def test_joint_decision(spark):
    good = "### x\n### y\nBecause of the reasoning behaviors a b, c, the author model of OUTPUT A is m-1. Because of reasoning behaviors d, d, the author model of OUTPUT B is m-2-x."
    rows = spark.createDataFrame([("good", good), ("half", good.split(" Because of reasoning")[0]), ("null", None)], "sample_id string, annotation string")
    got = {tuple(r) for r in an.parse_joint_decision(rows).collect()}
    assert got == {("good", "a", "a b", "m-1"), ("good", "a", "c", "m-1"), ("good", "b", "d", "m-2-x")}


def test_token_sets():
    assert an.token_set_similarity("Going back", "back, going!") == 100
    assert an.token_set_similarity("Going back", "going back to the start") == 100
    assert an.token_set_similarity("", "x") == 0
    assert an.token_set_similarity("ab", "cd") == 0
    assert an.token_set_similarity("fuzzy bear", "fuzzy pear") == max(an.similarity("fuzzy bear", "fuzzy pear"), an.similarity("fuzzy", "fuzzy bear"))


def test_injection_and_examples(spark):
    prompt = fx.inject(F.col("t"), F.lit(True), "Note.")
    assert one(spark, prompt, t="q\nFormat the answer as x") == "q\nNote.\nFormat the answer as x"
    assert one(spark, prompt, t="q") == "q\nNote."
    assert one(spark, fx.examples_for_dataset(F.col("t")), t="AIME25") == "math"
    assert one(spark, fx.truncate_annotation(F.col("t"), 4, 2), t="=== Annotation for OUTPUT A ===\nb c\n=== Annotation for OUTPUT B ===\nd e") is not None


def test_fallback_reads_whole_questions(spark, data):
    from marginalia.plans import registered
    from marginalia.sources import tables as t

    questions = {(r.conv_id, r.turn): r.question for r in t.turns(spark, data).collect()}
    got = {(r.conv_id, r.turn): r.thinking for r in registered.QUERIES["p1_thinking_fallback_whole"](spark, data).collect()}
    assert got.keys() == questions.keys()
    assert any(len(q) > 14 for q in questions.values())
    assert all(got[k] == q for k, q in questions.items() if sum(k) % 8 > 1 and len(q.strip()) >= 10)
