"""Empty tables, nulls in every column and clashing names: nothing crashes, results are as defined."""

import pytest

from marginalia.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"


def written(spark, path, documents, pages, turns):
    spark.createDataFrame(documents, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, PAGES).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(turns, TURNS).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    documents = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 40_000, None, "s", 1), (None, "a b c", None, None, 1)]
    pages = [(None, None, None), (1, None, "<p>x"), (2, "http://h/", None), (2, "http://h/", None)]
    turns = [(None, None, None, None), (1, None, None, "x"), (1, 0, None, None), (1, 0, None, None)]
    return written(spark, tmp_path_factory.mktemp("holes"), documents, pages, turns)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    rows = queries.queries()[name](spark, empty).collect()
    assert len(rows) == (1 if name.startswith("op5") else 0)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nulls_everywhere(spark, holes, name):
    rows = queries.queries()[name](spark, holes).collect()
    if name.startswith("op5"):
        assert sorted((r.conv_id is None, r.n_turns) for r in rows) == [(False, 2), (False, 3), (True, 1)]
    elif name.startswith("op11"):
        assert [(r.lang, r.phrase, r.a, r.n) for r in rows] == [("und", "word word word word", 39_997, 40_003)]
    elif name.startswith("op3"):
        assert {r.doc_id for r in rows} == {None, 1, 2, 3}
    else:
        assert len(rows) == (4 if "page_id" in rows[0].__fields__ else 6)


def test_pipeline_on_empty_and_holed_tables(spark, empty, holes):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
    assert corpus_pipeline.run(spark, holes).collect() == []  # too short or repetitive, every one


#: Names that the operators use themselves.
CLASHES = "node same bucket row label host ids digest hash prefix salt norm head best nth rows first text_sha256 kept keep_id group_size piece start length offset sequence_id n_tokens component component_id signature n_shingles paths path own_0 own_1 line_hashes removed depleted clean_text n_words base_failed conv unknown place range size block window written tokens system rule verdict strict_terms soft_terms id best_text phrase count bit lang_pred held_out score values places shard chunk own pairs times pair a b texts n_a n_links count_sum __terms __rule".split()


@pytest.fixture(scope="module")
def clashing(spark, data, tmp_path_factory):
    path = tmp_path_factory.mktemp("clashing")
    for name in ("documents", "pages", "conversations"):
        df = spark.read.parquet(f"{data}/{name}.parquet")
        df.selectExpr("*", *(f"'{x}' AS `{x}`" if i % 2 else f"CAST(NULL AS ARRAY<INT>) AS `{x}`" for i, x in enumerate(CLASHES) if x not in df.columns)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


#: Which pieces share a sequence in op3 may differ with the order of rows.
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_extra_columns_change_nothing(spark, data, clashing, name):
    got, want = (queries.queries()[name](spark, x) for x in (clashing, data))
    assert got.columns == want.columns
    keys = [c for c in want.columns if c not in ("sequence_id", "offset")]
    rows = [sorted(map(repr, df.select(*keys).collect())) for df in (got, want)]
    assert rows[0] == rows[1]


def test_pipeline_stages_with_extra_columns(spark, data, clashing):
    import corpus_pipeline as cp

    docs = [spark.read.parquet(f"{x}/documents.parquet") for x in (clashing, data)]
    for _, stage in cp.STAGES[:-1]:
        rows = [stage(spark, df, data) for df in docs]
        assert all(tuple(df.columns) == cp.COLUMNS for df in rows)
        assert sorted(map(repr, rows[0].collect())) == sorted(map(repr, rows[1].collect()))
    assert {r.doc_id for r in cp.pack(spark, docs[0], data).collect()} == {r.doc_id for r in docs[1].collect()}


def test_url_verdicts_keep_columns_of_any_name(spark):
    """Columns that have the names of the results are replaced, all others stay, those that the operator would use inside too."""
    from marginalia.llm import urls

    rows = spark.createDataFrame([(1, "http://a.com/x", "t", "r", "s", "h")], "page_id long, url string, __terms string, __rule string, ___TERMS string, host string")
    found = urls.url_verdicts(rows)
    assert {"page_id", "url", "__terms", "__rule", "___TERMS"} <= set(found.columns)
    r = found.first()
    assert (r["__terms"], r["__rule"], r["___TERMS"], r.host, r.verdict) == ("t", "r", "s", "a.com", "allow")
