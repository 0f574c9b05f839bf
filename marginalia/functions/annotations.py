"""Annotation texts to facts: parsers of line-oriented annotations, one Spark job each."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mentions import places_column
from .text import clean_code_name, stripped

#: A heading line with one of these names no code (fixed values of the annotation format).
NOT_A_CODE = (
    "definition of this reasoning behavior",
    "exhibited by",
    "in output",
    "output a shows",
    "output b shows",
    "this reasoning behavior is",
    "because of this reasoning behavior",
    "output a",
    "output b",
    "reasoning behavior name",
    ":",
)
#: The same for annotations with counts.
NOT_A_COUNTED_CODE = (*NOT_A_CODE, "whether this", "how many times", "count in")
_LONGEST_NAME = 10


def _opened(line: Column, excluded: Sequence[str]) -> Column:
    """The code that a stripped line opens, null where it opens none."""
    bare = stripped(F.regexp_replace(line, r"^#+|#+$", ""))
    words = F.size(F.split(bare, r"\s+"))
    is_name = line.startswith("###") & (bare != "") & (words <= _LONGEST_NAME) & ~F.lower(line).rlike("|".join(rf"\Q{x}\E" for x in excluded))
    return F.when(is_name, stripped(clean_code_name(bare)))


def _sections(annotations: DataFrame, key: str, text: str, excluded: Sequence[str]) -> DataFrame:
    """(key, code_name, said): the lines in lower case under each code's last heading, up to the next code's. All within the row: nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: stripped(x))
    marked = F.transform("__lines", lambda x: F.struct(F.lower(x).alias("lower"), _opened(x, excluded).alias("opens")))
    heads = F.filter(F.transform("__marked", lambda x, i: F.when(x["opens"].isNotNull(), i)), lambda i: i.isNotNull())

    def section(head: Column, k: Column) -> Column:
        end = F.coalesce(F.get("__heads", k + 1), F.size("__marked"))
        said = F.transform(F.slice("__marked", head + 2, end - head - 1), lambda x: x["lower"])
        return F.struct(F.get("__marked", head)["opens"].alias("code_name"), said.alias("said"))

    names = F.transform("__heads", lambda i: F.get("__marked", i)["opens"])
    last = F.filter(F.transform("__heads", section), lambda x, k: ~F.array_contains(F.slice("__names", k + 2, F.size("__names")), x["code_name"]))
    steps = annotations.select(key, lines.alias("__lines")).select(key, marked.alias("__marked")).withColumn("__heads", heads).withColumn("__names", names)
    return steps.select(key, F.inline(last))


def _by_side(sections: DataFrame, key: str, out: str, start: Column, fold) -> DataFrame:  # noqa: ANN001
    """(key, code_name, side, out): each section's lines folded for each side."""
    sides = F.array(*(F.struct(F.lit(x).alias("side"), F.aggregate("said", start, fold(x)).alias(out)) for x in "ab"))
    return sections.select(key, "code_name", F.inline(sides))


def parse_presence(annotations: DataFrame, key: str = "sample_id", text: str = "annotation") -> DataFrame:
    """(key, code_name, side, present). A heading opens a code, a repeated heading starts it anew.

    Of a line ``### ... reasoning behavior is observed in output a`` the first match
    of: observed in a, in b, not observed in a, in b, counts; the last such line wins.
    """

    def fold(side: str):
        def verdict(state: Column, line: Column) -> Column:
            effects = [(f"{no}observed in output {x}", x, no == "is ") for no in ("is ", "not ") for x in "ab"]
            out = F.when(~(line.startswith("###") & line.contains("reasoning behavior is")), state)
            for words, x, seen in effects:
                out = out.when(line.contains(words), F.lit(seen) if x == side else state)
            return out.otherwise(state)

        return verdict

    return _by_side(_sections(annotations, key, text, NOT_A_CODE), key, "present", F.lit(False), fold)


def parse_counts(annotations: DataFrame, key: str = "sample_id", text: str = "annotation") -> DataFrame:
    """(key, code_name, side, cnt). In order of the lines, and within a line in this order: ``count in output x: n`` sets n, ``is observed in output x`` sets 1 if it is still 0, else ``not observed in output x`` sets 0."""

    def fold(side: str):
        def count(state: Column, line: Column) -> Column:
            number = F.regexp_extract(line, rf"count in output {side}:\s*(\d+)", 1).try_cast("long")
            now = F.coalesce(F.when(line.contains(f"count in output {side}:"), number), state)
            return F.when(line.contains(f"is observed in output {side}"), F.when(now == 0, F.lit(1).cast("long")).otherwise(now)).when(line.contains(f"not observed in output {side}"), F.lit(0).cast("long")).otherwise(now)

        return count

    return _by_side(_sections(annotations, key, text, NOT_A_COUNTED_CODE), key, "cnt", F.lit(0).cast("long"), fold)


def parse_decision(annotations: DataFrame, key: str = "sample_id", text: str = "annotation") -> DataFrame:
    """(key, side, code_name, model): codes cited in the verdict, which stands after the last ``###``.

    Its form: ``output a is written by MODEL because of CODE, CODE`` and the same for b.
    """
    tail = F.substring_index(F.coalesce(F.col(text), F.lit("")), "###", -1)

    def cited(side: str) -> Column:
        pattern = rf"(?is)output {side}\b.*?\b(\w+(?:-\w+)+)\b.*?because of\s+\**([^.\n]+)"
        return F.struct(F.lit(side).alias("side"), F.regexp_extract(tail, pattern, 1).alias("model"), F.regexp_extract(tail, pattern, 2).alias("codes"))

    rows = annotations.select(key, F.explode(F.array(cited("a"), cited("b"))).alias("c")).where("c.model <> ''")
    return rows.select(key, "c.side", F.explode(F.split("c.codes", ", ")).alias("code_name"), "c.model").withColumn("code_name", stripped(clean_code_name(F.col("code_name")))).where("code_name <> ''")


def parse_joint_decision(annotations: DataFrame, key: str = "sample_id", text: str = "annotation") -> DataFrame:
    """(key, side, code_name, model): codes cited after the last ``###`` in the one sentence of each side, both of which must be there.

    Its form: ``Because of (the) reasoning behaviors CODE, CODE, the author model of OUTPUT A
    is MODEL.``, white space, and the same for OUTPUT B; a model's name has a hyphen.
    """
    tail = F.substring_index(F.coalesce(F.col(text), F.lit("")), "###", -1)
    said = [rf"Because of (?:the )?reasoning behaviors (.+?),\s*the author model of OUTPUT {x} is (\w+(?:-\w+)+)\." for x in "AB"]
    pattern = r"\s*".join(said)
    cited = [F.struct(F.lit(x).alias("side"), F.regexp_extract(tail, pattern, 2 * i + 1).alias("codes"), F.regexp_extract(tail, pattern, 2 * i + 2).alias("model")) for i, x in enumerate("ab")]
    rows = annotations.select(key, F.explode(F.array(*cited)).alias("c")).where("c.model <> ''")
    return rows.select(key, "c.side", F.explode(F.array_distinct(F.split("c.codes", ", "))).alias("code_name"), "c.model")


def verdict_model(text: Column, side: str) -> Column:
    """The model that the verdict names as author of an output, ``unknown`` without one."""
    said = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i)the author model of output {side} is:?\s+(.*?)(?:\. [A-Z]|\.?\s*$|,|\.?\n)", 1)
    name = F.regexp_replace(F.element_at(F.split(stripped(said), r"\s+"), -1), r"[*\[\]]", "")
    return F.when(name == "", F.lit("unknown")).otherwise(F.regexp_replace(name, r"\.$", ""))


def combine_parts(parts: DataFrame) -> DataFrame:
    """(sample_id, side, annotation) of ``parts(sample_id, side, part_idx, text)``; a single part is left as it is."""
    rows = F.array_sort(F.collect_list(F.struct("part_idx", "text")))
    grouped = parts.groupBy("sample_id", "side").agg(rows.alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("Part "), (i + 1).cast("string"), F.lit(":\n"), r["text"])), "\n\n")
    return grouped.select("sample_id", "side", F.when(F.size("rows") == 1, F.col("rows")[0]["text"]).otherwise(joined).alias("annotation"))


def combine_sides(sides: DataFrame, counts: DataFrame) -> DataFrame:
    """(sample_id, annotation): both sides under their headings, then a summary of counts by code.

    ``sides(sample_id, side, annotation)``, ``counts(sample_id, side, code_idx, code_name, cnt)``.
    """
    heads = F.transform(F.array_sort(F.collect_list(F.struct("side", "annotation"))), lambda r: F.concat(F.lit("=== Annotation for OUTPUT "), F.upper(r["side"]), F.lit(" ===\n"), r["annotation"]))
    texts = sides.groupBy("sample_id").agg(F.array_join(heads, "\n\n").alias("body"))
    per_code = counts.groupBy("sample_id", "code_idx", "code_name").agg(F.array_sort(F.collect_list(F.struct("side", "cnt"))).alias("c"))
    said = F.array_join(F.transform("c", lambda r: F.concat(F.lit("Count in OUTPUT "), F.upper(r["side"]), F.lit(": "), r["cnt"].cast("string"))), "\n")
    lines = per_code.withColumn("line", F.concat(F.lit("### "), F.col("code_name"), F.lit("\n"), said))
    summary = lines.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code_idx", "line"))), lambda r: r["line"]), "\n").alias("summary"))
    return texts.join(summary.hint("shuffle_merge"), "sample_id", "left").select("sample_id", F.concat_ws("\n\n", "body", "summary").alias("annotation"))


def split_sections(annotations: DataFrame, key: str = "sample_id", text: str = "annotation") -> DataFrame:
    """(key, side, section) under the headings that ``combine_sides`` writes."""
    parts = F.slice(F.split(F.coalesce(F.col(text), F.lit("")), "=== Annotation for OUTPUT "), 2, 1 << 30)
    rows = annotations.select(key, F.explode(parts).alias("part"))
    return rows.select(key, F.lower(F.substring("part", 1, 1)).alias("side"), stripped(F.regexp_replace("part", r"^.[^\n]*===\n?", "")).alias("section"))


#: Bytes of texts that a task cuts at once.
_SLICE_BYTES = 1 << 20


def cut_words(text: str, words: int, search: int) -> list[str]:
    """A text in parts of at most ``words`` words, cut after the last sentence end among a part's last ``search`` words; a short text is one part, unchanged."""
    tokens = text.split()
    if len(tokens) <= words:
        return [text]
    parts, at = [], 0
    while len(tokens) - at > words:
        end = at + words
        cut = next((i for i in range(end, end - search, -1) if tokens[i - 1][-1] in ".!?"), end)
        parts.append(" ".join(tokens[at:cut]))
        at = cut
    return [*parts, " ".join(tokens[at:])]


def cut_batches(batches: Iterator[pa.RecordBatch], words: int, search: int) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is a text, with a number and a part of it in its place. Texts of ``_SLICE_BYTES`` are taken up at once, or a longer one alone, whatever a batch holds."""
    for batch in batches:
        *rest, text = batch.schema.names
        sizes = pc.fill_null(pc.binary_length(batch.column(len(rest))), 0).to_numpy(zero_copy_only=False)
        slices = np.cumsum(sizes, dtype=np.int64) // _SLICE_BYTES
        for start, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]):
            rows = batch.slice(start, end - start)
            parts = [cut_words(x.as_py() or "", words, search) for x in rows.column(len(rest))]
            of = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            number = pa.array([i for x in parts for i in range(len(x))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(rows.column(i).take(of) for i in range(len(rest))), number, pa.array([y for x in parts for y in x], pa.string())], [*rest, "part_idx", text])


def split_output(df: DataFrame, words: int = 250, search: int = 50, text: str = "text") -> DataFrame:
    """``df`` with part_idx and its text in parts (``cut_words``)."""
    ordered = df.select(*(c for c in df.columns if c != text), text)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ordered.schema.fields[:-1])
    return ordered.mapInArrow(lambda batches: cut_batches(batches, words, search), f"{kinds}part_idx int, `{text}` string")


def occurrence_to_sequence(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Each code of ``facts(keys, code_idx, code_name, cnt)`` as often as it was counted, in order of the taxonomy."""
    rows = facts.where("cnt > 0").select(*keys, "code_idx", F.explode(F.array_repeat("code_name", F.col("cnt").cast("int"))).alias("code"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("code_idx")).cast("long")).select(*keys, "pos", "code")


def extract_sequence(df: DataFrame, codes: list[str], keys: list[str], text: str = "text", longest: int = 50) -> DataFrame:
    """(keys, pos, code_idx): where code names stand in a text, overlaps too, the first ``longest`` by place, then by index. A name of one word needs neighbours that are no letters or digits. A text is walked once, however many names there are."""
    return df.select(*keys, F.posexplode(places_column(F.col(text), codes, longest)).alias("pos", "code_idx")).select(*keys, (F.col("pos") + 1).cast("long").alias("pos"), "code_idx")


# ---- taxonomy updates -------------------------------------------------------

#: Names that an update must not add (fixed values of the update format).
_JUNK = re.compile(r"^(?:none|n/a|added|updated|removed|no change.*|final output.*|output [ab].*|model [ab].*|)$", re.IGNORECASE)


def common_letters(one: str, two: str) -> int:
    """The length of the longest common subsequence: a bit for each letter of ``one``, a few operations on whole numbers for each of ``two``."""
    places: dict[str, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    every = free = (1 << len(one)) - 1
    for c in two:
        taken = free & places.get(c, 0)
        free = (free + taken | free - taken) & every
    return len(one) - free.bit_count()


def similarity(one: str, two: str) -> int:
    """round(100 * 2 LCS / (lengths)), on lower case."""
    one, two = one.lower(), two.lower()
    if not one or not two:
        return 100 if one == two else 0
    return round(200 * common_letters(one, two) / (len(one) + len(two)))


def word_set(text: str) -> set[str]:
    """Words in lower case, without punctuation."""
    return {*re.sub(r"[^\w]|_", " ", text.lower()).split()}


def token_set_similarity(one: str, two: str) -> int:
    """The best similarity of: the common words, these and the first text's other words, these and the second's; words in lower case, without punctuation, sorted. A text whose words are all the other's scores 100."""
    a, b = word_set(one), word_set(two)
    if not a or not b:
        return 0
    common = sorted(a & b)
    if common and (a <= b or b <= a):
        return 100
    parts = [" ".join(common), *(" ".join([*common, *sorted(x - set(common))]) for x in (a, b))]
    return max(similarity(parts[1], parts[2]), *(similarity(parts[0], x) for x in parts[1:] if common), 0)


def new_codes(text: str, existing: list[str], most: int = 9, longest: int = 2000, alike: int = 90) -> Iterator[tuple[str, str, str]]:
    """(action, name, definition) of one update text, in order. An update keeps the code's old name."""
    cut = text.lower().rfind("final output:")
    section, added, names = "", 0, list(existing)
    for line in text[cut + 13 if cut >= 0 else 0 :].split("\n"):
        bare = re.sub(r"^[\s\-*\d.]+|\*\*|[#\[\]]", "", line).strip()
        if m := re.match(r"(added|updated)\s*:?\s*$", bare, re.IGNORECASE):
            section = m[1].lower()
            continue
        name, colon, definition = bare.partition(":")
        name, definition = name.strip(), definition.strip()
        if not colon or not section:
            continue
        if len(definition) > longest:
            definition = definition[:longest] + "..."
        if section == "updated":
            old = name.partition("->")[0].strip()
            match = max(names, key=lambda x: (similarity(x, old), -names.index(x)), default="")
            if match and similarity(match, old) >= alike:
                names.remove(match)
                names.append(match)
                yield "update", match, definition
        elif added < most and not _JUNK.match(name) and len(definition) >= 10 and all(similarity(name, x) < alike for x in names):
            added += 1
            names.append(name)
            yield "add", name, definition


def parse_new_codes(updates: DataFrame, existing: list[str]) -> DataFrame:
    """(update_id, step, action, code_name, definition) of ``updates(update_id, text)`` against the current taxonomy. Each update's lines depend on each other; updates don't."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(u, i, *x) for u, t in zip(rows["update_id"], rows["text"], strict=True) for i, x in enumerate(new_codes(t or "", existing))]
            yield pd.DataFrame(out, columns=["update_id", "step", "action", "code_name", "definition"])

    return updates.select("update_id", "text").mapInPandas(parse, "update_id string, step int, action string, code_name string, definition string")
