"""Column functions over trace texts and prompts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.sources.scratch import saved

# ---- trace sections ---------------------------------------------------------


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def section(text: Column, name: str) -> Column:
    """What follows ``### NAME:`` up to the next of the three headings or the end; empty if missing."""
    return stripped(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)### {name}:(.*?)(?=### (?:QUESTION|THINKING|ANSWER):|\z)", 1))


def thinking_fallback(thinking: Column, answer: Column) -> tuple[Column, Column]:
    """(thinking, answer): a blank thinking takes the answer, which becomes empty; one of 1-9 characters is replaced by the answer."""
    thinking, answer = F.coalesce(thinking, F.lit("")), F.coalesce(answer, F.lit(""))
    size = F.length(stripped(thinking))
    return F.when(size < 10, answer).otherwise(thinking), F.when(size == 0, F.lit("")).otherwise(answer)


def cut_choices_order(text: Column) -> Column:
    """The text before the last ``### CHOICES ORDER``."""
    return F.regexp_replace(text, r"(?s)### CHOICES ORDER(?!.*### CHOICES ORDER).*\z", "")


def strip_think_tags(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, r"^\n+", ""), r"\n+\z", "")


def after_last_think(text: Column) -> Column:
    """The text after the last ``</think>``, all of it where there is none."""
    return F.substring_index(text, "</think>", -1)


def split_think_span(text: Column) -> tuple[Column, Column]:
    """(thinking, answer) around the first ``<think>`` and the first ``</think>``; without both, all is answer."""
    start, end = F.instr(text, "<think>"), F.instr(text, "</think>")
    whole = (start > 0) & (end > start)
    return F.when(whole, F.substring(text, start + 7, end - start - 7)).otherwise(F.lit("")), F.when(whole, F.substring(text, end + 8, F.length(text))).otherwise(text)


# ---- names ------------------------------------------------------------------


def clean_code_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[*#\[\]]", "")


def is_clean_rule(name: Column, drop_the: bool = True) -> Column:
    """A rule about one model, of at most ten words; with ``drop_the`` none that holds these three letters."""
    clean = ~(name.contains("Both model") | name.contains("Both output")) & (F.size(F.split(stripped(name), r"\s+")) <= 10)
    return clean & ~name.contains("the") if drop_the else clean


def parse_run_folder(name: Column) -> Column:
    """Struct (model, arm, run) of ``MODEL-inst-intervened-run-N`` or ``MODEL-no-intervened-run-N``; null for other names."""
    pattern = r"^(.+)-(inst-intervened|no-intervened)-run-(\d+)$"
    parts = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
    return F.when(name.rlike(pattern), F.struct(parts[0].alias("model"), parts[1].alias("arm"), parts[2].try_cast("int").alias("run")))


def parse_stats(text: Column) -> Column:
    """Struct (full_rate, partial_rate) of a summary; a missing rate is 0."""

    def rate(name: str) -> Column:
        return F.coalesce(F.regexp_extract(text, rf"(?i){name}[^0-9\n]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))

    return F.struct(rate("full(?:y)?[ _-]*success[ _-]*rate").alias("full_rate"), rate("partial(?:ly)?[ _-]*success[ _-]*rate").alias("partial_rate"))


def run_name_from_path(path: Column, default: str) -> Column:
    """``step-N`` for the first ``step_N`` of a path, ``default`` without one."""
    step = F.regexp_extract(path, r"step_([^/]+)", 1)
    return F.when(step == "", F.lit(default)).otherwise(F.concat(F.lit("step-"), step))


def encode_models(df: DataFrame, aliases: DataFrame, column: str = "model", out: str = "alias") -> DataFrame:
    """The neutral name of each model (itself where it has none). ``aliases(model, alias)`` holds one row a model and is small."""
    known = aliases.select(F.col("model").alias(column), F.col("alias").alias("__alias"))
    return df.join(F.broadcast(known), column, "left").withColumn(out, F.coalesce("__alias", column)).drop("__alias")


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases that stand for several models: decoding them would be a guess."""
    return aliases.groupBy("alias").agg(F.count_distinct("model").alias("models")).where("models > 1")


# ---- prompts ----------------------------------------------------------------

BOXED_SUFFIX = "\nPut the final number in \\boxed{}."
#: (dataset name part, set of example behaviours), first match wins.
EXAMPLE_SETS = (("gpqa", "science"), ("math", "math"), ("aime", "math"), ("crux", "code"), ("lcb", "code"))


def question_prompt(kind: Column, question: Column) -> Column:
    """By kind: ``boxed`` asks for a boxed number, ``python`` wraps an assertion to complete, anything else is left alone."""
    python = F.concat(F.lit("Complete the assertion.\n[PYTHON]\n"), question, F.lit("\n[/PYTHON]\nAnswer between [ANSWER] and [/ANSWER]."))
    return F.when(kind == "boxed", F.concat(question, F.lit(BOXED_SUFFIX))).when(kind == "python", python).otherwise(question)


def choice_prompt(question: Column, choices: Column) -> Column:
    """A multiple-choice question with lettered choices."""
    lettered = F.transform(choices, lambda c, i: F.concat(F.chr(F.lit(65) + i), F.lit(") "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\nFormat the answer as: the correct answer is (letter)."))


def inject(prompt: Column, flag: Column, text: str, before: str = "\nFormat the answer as") -> Column:
    """The intervention text before the format line where ``flag`` is set."""
    at = F.instr(prompt, before)
    injected = F.concat(F.substring(prompt, F.lit(1), at - 1), F.lit("\n" + text), F.substring(prompt, at, F.length(prompt)))
    return F.when(flag & (at > 0), injected).when(flag, F.concat(prompt, F.lit("\n" + text))).otherwise(prompt)


def examples_for_dataset(dataset: Column, sets: Sequence[tuple[str, str]] = EXAMPLE_SETS, default: str = "general") -> Column:
    out = F.lit(default)
    for part, name in reversed(sets):
        out = F.when(F.lower(dataset).contains(part), F.lit(name)).otherwise(out)
    return out


def codebook_text(codes: DataFrame) -> DataFrame:
    """One row: the taxonomy as lines ``name: definition`` in order of index."""
    rows = F.array_sort(F.collect_list(F.struct("code_idx", "code_name", "definition")))
    return codes.agg(F.array_join(F.transform(rows, lambda r: F.concat(r["code_name"], F.lit(": "), r["definition"])), "\n").alias("codebook_text"))


def annotation_prompts(pairs: DataFrame, codes: DataFrame, instructions: str) -> DataFrame:
    """``pairs(sample_id, outputs)`` with the system and user texts that ask for an annotation; the taxonomy is one row."""
    system = F.concat(F.lit(instructions + "\n"), F.col("codebook_text"))
    lettered = F.transform("outputs", lambda x, i: F.concat(F.lit("OUTPUT "), F.chr(F.lit(65) + i), F.lit(":\n"), x))
    return pairs.crossJoin(F.broadcast(codebook_text(codes))).select("sample_id", system.alias("system"), F.array_join(lettered, "\n\n").alias("user"))


def update_prompts(samples: DataFrame, codes: DataFrame, instructions: str, empty_hint: str = "The taxonomy is empty so far.") -> DataFrame:
    """Prompts that ask to correct the taxonomy: outputs with their labels, in the order of ``primary_labels``, and the annotation so far."""
    system = F.concat(F.lit(instructions + "\n"), F.when(F.col("codebook_text") == "", F.lit(empty_hint)).otherwise(F.col("codebook_text")))
    ordered = F.transform("primary_labels", lambda m: F.concat(F.lit("Output of "), m, F.lit(":\n"), F.element_at("outputs", F.array_position("labels", m).cast("int"))))
    user = F.concat(F.array_join(ordered, "\n\n"), F.lit("\n\nAnnotation:\n"), F.coalesce("annotation", F.lit("")))
    return samples.crossJoin(F.broadcast(codebook_text(codes))).select("sample_id", system.alias("system"), user.alias("user"))


def truncate_tokens(text: Column, n: int) -> Column:
    """The first n white-space tokens, one space between."""
    return F.array_join(F.slice(F.split(stripped(text), r"\s+"), 1, n), " ")


def truncate_annotation(text: Column, most: int = 20_000, each: int = 10_000) -> Column:
    """Without what follows the first ``### Count in`` line; a longer rest is cut to ``each`` words in every output's section."""
    head = F.substring_index(text, "\n### Count in ", 1)
    mark = "=== Annotation for OUTPUT"
    parts = F.transform(F.split(head, mark), lambda x: truncate_tokens(x, each))
    cut = F.array_join(parts, "\n" + mark + " ")
    return F.when(F.size(F.split(stripped(head), r"\s+")) > most, cut).otherwise(head)


# ---- answers ----------------------------------------------------------------


def _letter(text: Column) -> Column:
    """0-3 for the first of A, B, C, D that the text holds; null without one."""
    return F.coalesce(*(F.when(text.contains(c), F.lit(i)) for i, c in enumerate("ABCD")))


def choice_letter(answer: Column) -> Column:
    """0-3 from the last "the correct answer is", else "answer:", else a box, else a JSON field; 4 if none."""
    answer = F.coalesce(answer, F.lit(""))
    lower = F.lower(answer)

    def after(phrase: str, n: int) -> Column:
        tail = F.substring_index(lower, phrase, -1)
        return F.when(lower.contains(phrase), _letter(F.upper(F.substring(tail, 1, n))))

    boxed = F.element_at(F.regexp_extract_all(answer, F.lit(r"boxed\{([^{}]*(?:\{[^{}]*\})?[^{}]*)\}"), 1), -1)
    field = F.regexp_extract(answer, r'"answer"\s*:\s*"([A-D])"', 1)
    return F.coalesce(after("the correct answer is", 8), after("answer:", 6), F.when(F.size(F.regexp_extract_all(answer, F.lit(r"boxed\{"), 0)) > 0, _letter(boxed)), _letter(field), F.lit(4))


def tagged_answer(text: Column) -> Column:
    return stripped(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\[ANSWER\](.*?)\[/ANSWER\]", 1))


def tagged_call_input(text: Column) -> Column:
    """What stands in the first ``f(...)`` of the tagged answer, up to the first closing bracket."""
    return stripped(F.regexp_extract(tagged_answer(text), r"(?s)f\((.*?)\)", 1))


def boxed_answers(text: Column) -> Column:
    """Contents of every ``boxed{...}``, braces balanced; the closing brace stays where a percent sign follows it."""
    pieces = F.slice(F.split(F.coalesce(text, F.lit("")), r"boxed\{"), 2, 1 << 30)

    def balanced(piece: Column) -> Column:
        """How many characters the content has (null where it never ends)."""
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

        def step(state: Column, char: Column) -> Column:
            depth = state["depth"] + F.when(char == "{", 1).when(char == "}", -1).otherwise(0)
            open_ = state["depth"] > 0
            return F.struct(F.when(open_, depth).otherwise(0).alias("depth"), F.when(open_ & (depth > 0), state["size"] + 1).otherwise(state["size"]).alias("size"))

        return F.aggregate(F.split(piece, ""), start, step, lambda s: F.when(s["depth"] == 0, s["size"]))

    def content(x: Column) -> Column:
        size = x["size"] + F.when(F.substring(x["piece"], x["size"] + 2, F.lit(1)) == "%", 1).otherwise(0)
        return F.substring(x["piece"], F.lit(1), size)

    sized = F.transform(pieces, lambda p: F.struct(p.alias("piece"), balanced(p).alias("size")))
    return F.transform(F.filter(sized, lambda x: x["size"].isNotNull()), content)


def program_output(text: Column) -> Column:
    """The last ```` ```output ```` block."""
    tail = F.substring_index(F.coalesce(text, F.lit("")), "```output", -1)
    return F.when(text.contains("```output"), stripped(F.substring_index(tail, "```", 1))).otherwise(F.lit(""))


def last_number(text: Column) -> Column:
    """The last number, commas left out; empty without one."""
    found = F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), F.lit(r"-?\d*\.?\d+"), 0)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.lit(""))


def free_answers(text: Column) -> Column:
    """All answers of free-form text in normal form: a marked final answer, else every box, else what follows the last phrase, else a program's output, else the last number."""
    text = F.coalesce(text, F.lit(""))
    opening, closing = "final answer is $", "$. I hope"
    rest = F.substring(text, F.instr(text, opening) + len(opening), F.length(text))
    final = F.when(text.contains(opening) & text.contains(closing), F.array(stripped(F.substring_index(rest, closing, 1))))
    boxed = F.when(text.contains("boxed"), boxed_answers(text))
    phrase = F.when(text.contains("he answer is"), F.array(stripped(F.substring_index(text, "he answer is", -1))))
    other = F.coalesce(F.nullif(program_output(text), F.lit("")), last_number(text))
    raw = F.coalesce(final, boxed, phrase, F.filter(F.array(other), lambda x: x != ""))

    def normal(answer: Column) -> Column:
        line = F.substring_index(stripped(answer), "\n", 1)
        return math_normal(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^:+", ""), r"\.+\z", ""), r"/+\z", ""))

    return F.transform(raw, normal)


def free_answer(text: Column) -> Column:
    """The last of the answers of free-form text, empty without one."""
    found = free_answers(text)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.lit(""))


#: Of a plain fraction: a whole number as it is usually written, or anything with a root.
_SIDE = r"(0|-?[1-9]\d*|[^/]*sqrt[^/]*)"
#: No fraction without braces is cut short: else all stay as they are.
_FRACTIONS_END = r"\A(?!.*\\frac[^{]?(?:\\frac|\z))"
#: Ordered rewrites of the math normaliser: (pattern, replacement, condition on the text before or None).
_MATH = (
    # ends and line breaks
    (r"\A\s+|\s+\z", "", None),
    (r"\n", "", None),
    (r"\.+\z", "", None),
    (r"\\!", "", None),
    # a text around everything, forms of fractions, sizes of brackets
    (r"\A\\text\{(.*)\}\z", "$1", None),
    (r"[tdc]frac", "frac", None),
    (r"\\left|\\right", "", None),
    # units: a text at the end unless it is all there is, degrees, lengths, times of day, tons
    (r"\A((?!\\text\{).*?)\\text\{.*\}\z", "$1", None),
    (r"\A\s+|\s+\z", "", None),
    (r"\^\{\\circ\}|\^\\circ", "", None),
    (r"\{[cm]?m\}(?:\^[23])?", "", None),
    (r"\s*p\.m\.\s*\z", "", None),
    (r"(\d)\s*t\s*\z", "$1", None),
    (r"\A\s+|\s+\z", "", None),
    # signs
    (r"\\\$|\$", "", None),
    (r"x\\in", "", None),
    (r"\\%", "%", None),
    (r"([ {])\.", "$10.", None),
    (r"\\cdot", "", None),
    (r"infinity", r"\\infty", None),
    (r"inf", r"\\infty", r"\A(?!.*\\infty)"),
    (r"\+\\inity", r"\\infty", None),
    (r"\\mathbf|\\mathrm", "", None),
    (r"\\mbox\{.*?\}", "", None),
    (r"j", "i", r"\A[^i]*\z"),
    # numbers
    (r"(\d+)\.0+(\D|\z)", "$1$2", None),
    (r"\A\.", "0.", None),
    # arguments without braces
    (r"\\(sqrt|tan)(-?[0-9.a-zA-Z]+)", r"\\$1{$2}", None),
    (r"\\(sqrt|tan)\s+(\w+)\z", r"\\$1{$2}", None),
    (r" ", "", None),
    (r"\\frac([^{])\{", r"\\frac{$1}{", _FRACTIONS_END),
    (r"\\frac([^{])([^{])", r"\\frac{$1}{$2}", _FRACTIONS_END),
    (rf"\A{_SIDE}/{_SIDE}\z", r"\\frac{$1}{$2}", None),
    # what is left at the end
    (r"[\\,.]+\z", "", None),
)


def math_normal(text: Column) -> Column:
    """A canonical form of a math answer, by ordered rewrites."""

    def rewritten(pattern: str, to: str, where: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.rlike(where), F.regexp_replace(x, pattern, to)).otherwise(x)

    out = F.coalesce(text, F.lit(""))
    for pattern, to, where in _MATH:  # as a lambda's variable, the text so far stands once in the expression
        out = F.regexp_replace(out, pattern, to) if where is None else F.get(F.transform(F.array(out), rewritten(pattern, to, where)), F.lit(0))
    return out


def with_math_normal(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, the canonical form of ``text``. Answers repeat: each distinct one is rewritten once, in a table that is written and read back, so that Spark joins by its true size."""
    distinct = df.select(F.coalesce(text, F.lit("")).alias("__text")).distinct()
    normal = saved(distinct.withColumn(out, math_normal(F.col("__text"))), "math-forms")
    return df.withColumn("__text", F.coalesce(text, F.lit(""))).join(normal, "__text").drop("__text")


def list_answers(question: Column, text: Column) -> Column:
    """All answers of free-form text; a question that asks for answers separated by commas has those without brackets split at commas, and others are split at ``\\text{and}``."""

    def parts(answer: Column) -> Column:
        commas = question.contains("separated by commas") & ~answer.rlike(r"[()\[\]]")
        return F.transform(F.when(F.coalesce(commas, F.lit(False)), F.split(answer, ",")).otherwise(F.split(answer, r"\\text\{\s*and\s*\}")), stripped)

    return F.flatten(F.transform(free_answers(text), parts))


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _last_decimal(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"-?\d+\.?\d*"), 0)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.lit("[invalid]"))


def _said_in_chinese(text: Column) -> Column:
    """The line after the first mark of an answer; null without the mark."""
    said = F.substring(text, F.instr(text, "答案是") + 3, F.length(text))
    return F.when(text.contains("答案是"), stripped(_before(stripped(said), "\n")))


def _final_letter(text: Column) -> Column:
    letter = F.regexp_extract(F.lower(_before(text, "Problem:")), r"the final answer is \(?([abcd])\)?", 1)
    return F.when(letter == "", F.lit("placeholder")).otherwise(F.upper(letter))


def _hoped(text: Column) -> Column:
    pattern = r"final answer is (.*)\. I hope it is correct."
    head = _before(text, "Problem:")
    return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1)).otherwise(F.lit("[invalid]"))


def _chinese_number(text: Column) -> Column:
    head = _before(text, "问题：")
    said = _said_in_chinese(head)
    return F.when(said.isNotNull(), _last_decimal(said)).otherwise(free_answer(head))


#: The answer of each evaluation suite: marks of the next question and of the answer are fixed values of the suites.
SUITES = {
    "single": free_answer,
    "gsm_few_shot": lambda x: _last_decimal(_before(x, "Q: ")),
    "gaokao_cloze": lambda x: F.coalesce(F.regexp_replace(_said_in_chinese(_before(x, "问题 ")), r"\A\$+|\$+\z", ""), F.lit("placeholder")),
    "gaokao_choice": lambda x: F.coalesce(_said_in_chinese(_before(x, "问题 ")), F.lit("placeholder")),
    "sat_few_shot": _final_letter,
    "mmlu_stem": _final_letter,
    "courses_few_shot": _hoped,
    "formal_proof": lambda x: stripped(_before(x, "Informal:")),
    "cmath_few_shot": _chinese_number,
}


def suite_answer(text: Column, suite: str) -> Column:
    """The answer of a text by the rule of an evaluation suite; an unknown suite is an error."""
    if suite not in SUITES:
        raise ValueError(f"unknown suite {suite!r}; known: {', '.join(sorted(SUITES))}")
    return SUITES[suite](F.coalesce(text, F.lit("")))


def suite_list_answers(question: Column, text: Column) -> Column:
    """The list of answers before the next problem."""
    return list_answers(question, _before(F.coalesce(text, F.lit("")), "Problem:"))


def grade(answers: DataFrame) -> DataFrame:
    """(dataset, model, n, n_correct, accuracy) of ``answers(dataset, model, answer, gold)``; the dataset chooses the extractor."""
    kind = F.lower("dataset")
    got = (
        F.when(kind.contains("choice"), F.substring(F.lit("ABCD-"), choice_letter(F.col("answer")) + 1, F.lit(1)))
        .when(kind.contains("tagged"), tagged_answer(F.col("answer")))
        .when(kind.contains("call"), tagged_call_input(F.col("answer")))
        .otherwise(free_answer(F.col("answer")))
    )
    gold = F.when(kind.rlike("choice|tagged|call"), F.col("gold")).otherwise(math_normal(F.col("gold")))
    return answers.withColumn("correct", (got == gold).cast("long")).groupBy("dataset", "model").agg(F.count("*").alias("n"), F.sum("correct").alias("n_correct"), F.round(F.avg("correct"), 6).alias("accuracy"))


def grade_choice(answers: DataFrame) -> DataFrame:
    """``answers(..., answer, choice_order)`` with correct: the chosen letter's entry in the order is the right one."""
    letter = choice_letter(F.col("answer"))
    chosen = F.when(letter < F.size("choice_order"), F.element_at("choice_order", letter + 1))
    return answers.withColumn("correct", F.coalesce(chosen == "Correct Answer", F.lit(False)))
