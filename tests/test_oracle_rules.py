"""SQL states the rule of its query on rows that the small tables lack."""

import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from marginalia.plans import registered
from marginalia.sources.tables import SEED_CODES
from tests.oracle import assert_same, connect


def same_on(spark, data, folder, name, **tables):
    """Compares a query with its SQL over ``data`` with some tables replaced, and returns its rows."""
    for x in Path(data).iterdir():
        if x.suffix == ".parquet":
            shutil.copy(x, folder)
    for table, rows in tables.items():
        schema = pq.read_schema(Path(data) / f"{table}.parquet")
        pq.write_table(pa.Table.from_pylist(rows, schema=schema), folder / f"{table}.parquet")
    df = registered.QUERIES[name](spark, str(folder))
    rows = df.collect()
    assert_same([tuple(r) for r in rows], df.columns, connect(folder).execute(registered.SQL[name]))
    return rows


def talk(conv_id, question, answer):
    return [{"conv_id": conv_id, "turn": i, "role": r, "text": x} for i, (r, x) in enumerate((("user", question), ("assistant", answer)))]


def test_a_thinking_is_blank_or_short_without_white_space_of_any_kind(spark, data, tmp_path):
    # prefixes of 14 characters: nine letters and line breaks, ten letters, only white space; then missing texts
    rows = [x for i, q in enumerate(("\nabcdefghi\t\r\n\x0b rest", "\tabcdefghij\n\n\n rest", "\n\t\r\f\x0b \n\n\n\n\n\n\n\n rest", None)) for x in talk(15 * i + 14, q, "said")]
    rows += talk(90, "long enough here", None)
    got = {r.conv_id: (r.thinking, r.answer) for r in same_on(spark, data, tmp_path, "p1_thinking_fallback", conversations=rows)}
    assert got == {14: ("said", "said"), 29: ("\tabcdefghij\n\n\n", "said"), 44: ("said", ""), 59: ("said", ""), 90: ("", "")}


def outputs(*sources_and_texts):
    return [{"doc_id": i, "text": x, "lang": "en", "source": s, "n_chars": len(x or "")} for i, (s, x) in enumerate(sources_and_texts)]


#: Question 0 has both outputs, question 1 the first one only, question 0 of the other comparison the second one only.
UNPAIRED = outputs(("src0", "the one and the other"), ("src1", "of it "), ("src0", " der, die und the "), ("src3", "la de un\n"))


def test_a_code_is_absent_in_an_output_that_an_annotation_lacks(spark, data, tmp_path):
    got = {(r.sample_id, r.code_name, r.side): r.present for r in same_on(spark, data, tmp_path, "t1_parse_presence", documents=UNPAIRED)}
    assert len(got) == 3 * 8 * 2
    assert got["0_1", "der", "a"] and not got["0_1", "der", "b"] and got["1_0", "la", "b"] and not got["1_0", "la", "a"]


def test_a_code_counts_nothing_in_an_output_that_an_annotation_lacks(spark, data, tmp_path):
    got = {(r.sample_id, r.code_name, r.side): r.cnt for r in same_on(spark, data, tmp_path, "t2_m5_parse_counts", documents=UNPAIRED)}
    assert len(got) == 3 * 8 * 2
    assert got["0_0", "the", "a"] == 2 and got["0_1", "der", "b"] == 0 and got["1_0", "la", "b"] == 1 and got["1_0", "la", "a"] == 0


def test_the_section_of_an_only_output_has_the_summary(spark, data, tmp_path):
    got = {r.sample_id: r.least for r in same_on(spark, data, tmp_path, "t10_e19_split_sections", documents=UNPAIRED)}
    summary = "\n".join(f"### {code}\nCount in OUTPUT A: {int(code in ('the', 'und', 'der', 'die'))}" for code in SEED_CODES)
    assert got == {"0_0": len("the one and the other"), "0_1": len("der, die und the \n\n" + summary)}
