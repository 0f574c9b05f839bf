"""Duplicates, quality rules, components and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import components, exact_dedup, near_dedup, quality, queries
from tests.oracle import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_duplicates(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a  b ", None, "", " \n\t", "é x", "éx"] + ["hot text"] * 700 + ["hot  text"] * 3 + [f"t{i % 900}" for i in range(2000)])]
    rows += [(8, "hot text"), (8, "hot text"), (710, "hot  text"), (None, "hot text"), (None, "zz"), (None, "zz")] + [(None, "no id at all")] * 150
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))).collect()
    groups, kept = defaultdict(list), Counter()
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    assert len(out) == len(rows)
    for r in out:
        best = min(groups[normal(r.text)])
        assert (r.group_size, r.keep_id) == (len(groups[normal(r.text)]), None if best[1] else best[2])
        kept[normal(r.text)] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000 + i, 999) for i in range(1, 300)]
    ring = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    got = {r.a: r.b for r in components.connected_components(spark.createDataFrame(chain + star + ring + [(5, 5), (6, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 999 for i in range(1, 300)} | {2000 + i: 2000 for i in range(1, 7)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def noisy(rng, words, share):
    return " ".join(rng.choice(["x", "y", "z"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rng, rows = random.Random(width), []
    for group in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))]
        rows += [noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05])) for _ in range(rng.choice([1, 3, 12]))]
    drift = [f"d{i}" for i in range(150)]
    for i in range(25):  # a chain whose ends are far apart
        drift[i * 3] = f"e{i}"
        rows.append(" ".join(drift))
    rows = list(enumerate(rows + ["", None, "one", "One", "two words", "two  WORDS", " \n"]))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    want = brute_components(rows, width, percent)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    rng, base = random.Random(3), [f"w{i}" for i in range(80)]
    rows = [(i, noisy(rng, base, 0.03)) for i in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_near_duplicates_of_all_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_minhash_near_dedup(spark, data).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_edge_rows(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (1, text), (2, text + " "), (2, "other words are here now"), (3, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [("1", 1, True), ("2", 1, False), ("2", 2, True), ("3", 3, True), ("None", None, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85).collect() == []


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, data):
    texts = [None, "", "a", "x y z " * 30, "l\nl\n l\n\n", "#*$ %&|<>", "é b \U0001f642", "a b c d e f g h " * 2, "word " * 5000]
    rows = [(i + 10_000, t, None) for i, t in enumerate(texts)] + [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = brute_stats(t)
        assert tuple(got[i][c] for c in quality.STATS) == want
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_depleted_documents_go_and_copies_stay(spark, monkeypatch):
    own = lambda i, n=40: " ".join(f"own{i}w{j}" for j in range(n))
    menu = [" ".join(f"menu{k}word{j}" for j in range(9)) for k in range(12)]
    rows = [(i, own(i) + "\n" + "\n".join(menu), "h") for i in range(60)]  # own text and the menu
    rows += [(100 + i, "\n".join(menu), "h") for i in range(3)]  # nothing but the menu
    rows += [(200 + i, "\n".join(f"copied line {k} " + own(9000 + k, 12) for k in range(5)), "h") for i in range(80)]  # copies of one document
    rows += [(400 + i, "\n".join(menu), "other") for i in range(3)]  # common elsewhere only
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    out = quality.judged(df).orderBy("doc_id").collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(kept) == len(rows)
    assert all(r.clean_text == (own(r.doc_id) if r.doc_id < 100 else "" if r.doc_id < 200 else r.text) for r in out)
    assert [i for i, k in kept.items() if not k] == [100, 101, 102]
    assert kept == {r.doc_id: r.kept for r in quality.quality_verdicts(df).collect()}
    monkeypatch.setattr(quality, "BROADCAST", 0)
    assert out == quality.judged(df).orderBy("doc_id").collect()


def test_lines_are_found_by_their_hash(spark):
    lines = ["A  b\tC", "a b c", " É x ", "", "  ", "tail\r", "\x0bq"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", quality.line_hash(F.col("line")).alias("h")).collect()
    for r in rows:
        assert r.h in quality.distinct_lines(r.line.encode())[0].tolist() or not r.line.split()
    text = spark.createDataFrame([("keep\n a B  c\n\nA b c\nend\n",), (None,)], "text string")
    removed = F.array(F.lit(rows[1].h))
    assert [r[0] for r in text.select(quality.without_lines(F.col("text"), removed)).collect()] == ["keep\n\nend\n", None]


def test_quality_query_where_lines_decide(spark, tmp_path):
    """The registered query and its SQL on planted boilerplate: a host's menu in many pages, pages of nothing else, copies of one page, null and empty hosts."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(n))
    rows = []
    for host in ("big", None, ""):
        menu = [words(8) for _ in range(6)]
        page = words(60) + "\n" + words(50)
        texts = [words(40) + "\n" + "\n".join(rng.sample(menu, 5)) for _ in range(90)] + ["\n".join(menu), "\n".join(menu[:4])] * 4 + [page] * 70 + ["\n".join(menu) + " \n" + words(4)]
        rows += [(x, host) for x in texts]
    docs = spark.createDataFrame([(i, t, "en", h, len(t)) for i, (t, h) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op9_quality_rules(spark, str(tmp_path))
    got = df.collect()
    gone = [r.doc_id for r in got if not r.kept and not r.base_failed]
    assert len(gone) == 27 and len(got) == len(rows)
    assert {rows[i][0].count("\n") for i in gone} == {3, 5, 6}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert_same([tuple(r) for r in got], df.columns, con.execute(queries.oracle_sql()["op9_quality_rules"]))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert_same([tuple(r) for r in df.collect()], df.columns, connect(data).execute(queries.oracle_sql()[name]))


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline as cp

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    verdicts = {r.doc_id: r.kept for r in queries.op9_quality_rules(spark, data).collect()}
    left = {i: t for i, t in docs.items() if verdicts[i]}
    best = {}
    for i, t in left.items():
        key = normal(t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    left = {i: left[i] for _, i in best.values()}
    left = {i for i, (_, c) in brute_components(list(left.items()), 5, 80).items() if c == i}
    packed = cp.run(spark, data).collect()
    assert {r.doc_id for r in packed} == left
    assert [name for name, _ in cp.STAGES] == ["quality rules", "exact dedup", "near dedup", "packing"]
