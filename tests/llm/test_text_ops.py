"""Encoding, packing, files, formatting, counts, extraction and filters against brute force and round trips."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, html_extract, packing, queries, token_counts, token_files, tokens, urls
from marginalia.llm.common import scratch_path

ODD = ["", None, "  a  b\n\n c", "<|endoftext|> x", "a<|startoftext|>b", "café x", "́x", "İstanbul ΣΑΣ", "a b c", "日本 語", "x\x1c y", "don't I'LL we've", "½ ²x ١", " ", "\n", "\U0001f642\U0001f642", "a\x85b", "''s 's'", "a\rb\r\n c\t\td  "]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(name))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, x, "extra") for i, x in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.mark.parametrize("name", [queries.BYTE_BPE, queries.WORD_BPE])
def test_encoder_equals_the_library(spark, data, name):
    enc, lib = tokens.encoder(name), library(name)
    for text in [*ODD, *(r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect())]:
        want = lib.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(enc.encode(text or ""), "<u4")
        assert got.tolist() == want
        assert enc.decode(got) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", [queries.BYTE_BPE, queries.WORD_BPE])
def test_long_texts_in_pieces(spark, name):
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdeé'st1") for _ in range(5000)), "a" * 9000, "the" * 4000 + " x " + "of" * 3000, "日本語" * 3000, "x<|endoftext|>" + "ab" * 5000, "?!" * 5000 + "in" * 4000]
    long += [" ".join(rng.choice(["the", "it's", "x", "<|endoftext|>", "Ünïcode", "日本", "12,5", "a  b", "\n\n", "e\u0301"]) for _ in range(n)) for n in (700, 3000)]
    long += ["\n".join("line of words, no. %d." % i for i in range(900)), "word " * 3000, " " * 9000 + "x" + "\n " * 4000]
    texts = [*long, *ODD, long[0]]
    lib = library(name)
    rows = bpe.bpe_digests(docs_of(spark, texts), name, long=3000, piece=500, run_piece=200).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_the_registered_round_trip(spark, data, tmp_path):
    """op1 on all documents and on longer texts than it cuts, against the library."""
    lib = library(queries.WORD_BPE)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(10**6 + i, x) for i, x in enumerate([" ".join(t or "" for _, t in rows[i::3]) for i in range(3)] + ["ab" * 40_000, None, ""])]
    assert max(len(t or "") for _, t in rows) > 2 * bpe.LONG
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op1_bpe_round_trip(spark, str(tmp_path)).collect()} == want


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 5, "y")], "doc_id long, text string, ids string, own_0 long, row string")
    out = bpe.bpe_encode(rows, queries.WORD_BPE, decoded="row").first()
    lib = library(queries.WORD_BPE)
    ids = lib.encode("a b", add_special_tokens=False).ids
    assert out.asDict() == {"doc_id": 1, "text": "a b", "own_0": 5, "ids": np.array(ids, "<u4").tobytes(), "row": lib.decode(ids, skip_special_tokens=False)}


@pytest.mark.parametrize("piece", [3, 17, 64])
def test_tree_of_small_pieces(piece):
    rng, runs = random.Random(piece), bpe.run_encoder(queries.WORD_BPE)
    for alphabet in ("ab", "in", "thein", "aeioustrn"):
        word = "".join(rng.choice(alphabet) for _ in range(400))
        parts = [word[i : i + piece] for i in range(0, len(word), piece)]
        ids = [runs.encode(p, i == len(parts) - 1) for i, p in enumerate(parts)]
        assert runs.tree(ids, [len(p) for p in parts], word) == runs.encode(word, True)


def test_packing_is_whole_and_near_its_bound(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(docs_of(spark, [None, "", "a b"]).selectExpr("doc_id + 100000 AS doc_id", "text"))
    enc = tokens.encoder(queries.BYTE_BPE)
    want = {r.doc_id: np.append(np.frombuffer(enc.encode(r.text or ""), "<u4"), 0).astype("<u4") for r in docs.collect()}
    rows = packing.pack_documents(docs, queries.BYTE_BPE, 0, 512, group=60).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for doc, ids in want.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 512 or r.piece == 0
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 512
    lengths = np.array([r.length for r in rows])
    assert len(sequences) <= packing.lower_bound(lengths, 512) + 3


def test_the_registered_packing(spark, data):
    """op3 on all documents against the library's ids, and how far from the least number of sequences it may be."""
    lib = library(queries.BYTE_BPE)
    want = {r.doc_id: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    df = queries.op3_best_fit_packing(spark, data)
    rows, seen, filled = df.collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id].append((r.piece, r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    assert seen.keys() == want.keys()
    for doc, parts in seen.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(want[doc])
        assert all(n == 2048 for p, _, n in parts if p) and parts[0][2] <= 2048
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    proof = packing.certificate(df).first()
    assert proof.pieces == len(rows) and proof.sequences == len(filled)
    assert proof.bound <= proof.sequences <= proof.bound + max(1, proof.bound // 100)


def test_the_registered_token_files(spark, data):
    """op8 on all documents against the library."""
    lib, at, want = library(queries.BYTE_BPE), 0, []
    for r in sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op8_token_files(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_the_registered_token_counts(spark, data):
    """op6 on all documents against a plain best segmentation of each word."""
    trie = token_counts.unigram_trie(queries.PIECES)
    scores, known = trie.scores, {}

    def best(word):
        if word not in known:
            rows = [(0, 0)]
            for end in range(1, len(word) + 1):
                options = [(rows[start][0] + scores[word[start:end]], rows[start][1] - 1) for start in range(max(0, end - trie.longest), end) if word[start:end] in scores]
                if word[end - 1] not in scores:
                    n = len(word[end - 1].encode())
                    options.append((rows[end - 1][0] + n * trie.unknown, rows[end - 1][1] - n))
                rows.append(max(options))
            known[word] = rows[-1]
        return known[word]

    got = {r.doc_id: (r.n_pre_tokens, r.n_tokens, r.score) for r in queries.op6_token_counts(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        found = [best(token_counts.MARK + w) for w in words]
        assert got[r.doc_id] == (len(words), -sum(t for _, t in found), sum(s for s, _ in found))


def test_bounds_and_best_fit():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([5, 5, 5]), 10) == 2
    assert packing.lower_bound(np.array([], int), 10) == 0
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 101, 200)
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        assert packing.lower_bound(lengths, 100) <= bins.max() + 1 <= packing.lower_bound(lengths, 100) * 1.3


def test_token_files_round_trip_and_prune(spark):
    texts = ["b c", None, "", "a " * 3000, *(f"text {i}" for i in range(200)), "twice", "twice"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(3, "again"), (None, "no id")]
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, queries.BYTE_BPE, 2, stripe_mb=1, rows_per_index=1000)
    enc = tokens.encoder(queries.BYTE_BPE)
    got = sorted(token_files.token_offsets(spark, path).collect(), key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    crc = defaultdict(set)
    for i, x in rows:
        crc[i].add(zlib.crc32(enc.encode(x or "") + np.array([2], "<u4").tobytes()))
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 in crc[r.doc_id]
        at += r.n_tokens
    one = token_files.read_token_files(spark, path).where("doc_id = 7")
    assert one.first()["ids"][-1] == 2
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().executedPlan().toString()
    assert token_files.token_offsets(spark, _empty(spark)).collect() == []


def test_token_files_have_indexes_and_skip_rows(spark):
    path = scratch_path(spark, "tokens")
    rows = [(i, f"text {i}") for i in range(0, 12_000, 2)] + [(7001, f"hot {i}") for i in range(3000)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, queries.BYTE_BPE, 2, rows_per_index=1000)
    files, orc = token_files.read_token_files(spark, path).inputFiles(), spark._jvm.org.apache.orc.OrcFile
    for file in files:
        reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(spark._jsc.hadoopConfiguration()))
        records = reader.rows()
        for stripe in reader.getStripes():
            kinds = {x.getKind().toString() for x in records.readStripeFooter(stripe).getStreamsList()}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    for key, found in ((4002, 1), (4003, 0), (7001, 3000)):
        one = token_files.read_token_files(spark, path).where(f"doc_id = {key}")
        assert len(one.collect()) == found
        read = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        assert read <= (0 if not found else found + 2000)
    got = token_files.token_offsets(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)


def _empty(spark):
    path = scratch_path(spark, "none")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, queries.BYTE_BPE, 2)
    return path


def digests(rows):
    out = {}
    for conv, turns in rows.items():
        target = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    return out


def test_chat_round_trip(spark, data):
    turns = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i} </turn> ### \\ # : " * (i % 17)) for i in range(1100)]
    turns += [(2, 0, None, None), (2, None, "a:b\\#", "x"), (None, 0, "assistant", "no id"), (3, 5, "user", "w " * 2000), (3, 6, "assistant", "w " * 2000), (4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
    want = defaultdict(list)
    for conv, _, role, text in sorted(turns, key=lambda z: (z[0] or -1, -1 if z[1] is None else z[1])):
        want[conv].append((role or "", text or ""))
    windows = chat.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 512, 128)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == digests(want)
    for w in windows.where("conv_id = 1").collect():
        assert w.formatted.startswith("### system: ")
        assert w.n_repeated >= 1 or (w.block, w.window) == (0, 0)
    query = {r.conv_id: tuple(r)[1:5] for r in queries.op5_chat_windows(spark, data).collect()}
    every = defaultdict(list, {-7: [("user", queries._TRICKY), ("assistant", queries._TRICKY)]})
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        every[r.conv_id].append((r.role, r.text or ""))
    assert query == digests(every)


def test_blocks_are_bounded_whatever_the_turn_numbers(spark):
    rows = [(None, None, "user", "same words")] * 1500 + [(7, 3, "assistant", f"t{i % 40} </turn>") for i in range(1500)] + [(7, None, "system", "first"), (8, 10**12, "user", "far"), (8, -5, "user", "near")]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 100, 20).collect()
    new = defaultdict(int)
    for w in windows:
        new[w.conv_id, w.block] += w.n_turns - w.n_repeated
    assert max(new.values()) <= chat.BLOCK
    assert {c: sum(n for (x, _), n in new.items() if x == c) for c in (None, 7, 8)} == {None: 1500, 7: 1501, 8: 2}
    assert [chat.read_turns(w.formatted)[-1][1] for w in windows if w.conv_id == 8] == ["far"]


def test_unigram_counts_against_each_word_alone(spark):
    trie = token_counts.unigram_trie(queries.PIECES)
    scores, longest = trie.scores, trie.longest

    def alone(word):
        s, best = token_counts.MARK + word, [(0, 0)]
        for end in range(1, len(s) + 1):
            found = [(best[b][0] + scores[s[b:end]], best[b][1] - 1) for b in range(max(0, end - longest), end) if s[b:end] in scores]
            if s[end - 1] not in scores:
                n = len(s[end - 1].encode())
                found.append((best[end - 1][0] + n * min(scores.values()), best[end - 1][1] - n))
            best.append(max(found))
        return best[-1]

    texts = ["the cat sat on the catalogue", None, "", " \t\n", "日本\U0001f642 café", "a" * 3000, "the cat sat on the catalogue"]
    got = {r.doc_id: r for r in token_counts.unigram_counts(docs_of(spark, texts), queries.PIECES).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (got[i].n_pre_tokens, got[i].n_tokens, got[i].score) == (len(words), -sum(alone(w)[1] for w in words), sum(alone(w)[0] for w in words))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home"><header>Site</header><nav><a href=1>a</a></nav>
<div class="cookie-notice">We use cookies</div><div id="wrap"><div class="sidebar">side</div><div class="post-%d content"><h1>Title &amp; more</h1>
<p>First para with <a href="x">link</a> and <i>it</i>.<ul><li>one<li>two</ul><p>Second&nbsp;para<br>x<pre>a  b</pre><form><input>subscribe</form><aside>rel</aside></div>
<section class="comments"><p>%s</p></section></div><footer>foot</footer><script>var a="<p>no</p>";</script></body></html>"""
MAIN = "Title & more\nFirst para with link and it.\none\ntwo\nSecond para x\na b"


def test_main_text(spark):
    short = "<html><body><div id='wrap'><div class='content post-9'><p>Tiny.</p></div><div class='post'><p>" + "A long box of other things that is not the article. " * 3 + "</p></div></div></body></html>"
    rows = [(i, f"http://h.example/{i}", PAGE % (i, "great " * 50)) for i in range(5)]
    rows += [(10, "http://h.example/10", None), (11, None, ""), (12, "x", "plain &lt;x&gt;"), (13, "http://o.example/", "<p>a<p>b</div><b>c"), (14, "http://h.example/14", short), (0, "http://h.example/0", PAGE % (0, ""))]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert {text[i] for i in range(5)} == {MAIN}
    assert (text[10], text[11], text[12], text[13]) == ("", "", "plain <x>", "a\nbc")
    assert all(r.n_chars == len(r.text) for r in got)


def test_main_text_of_all_pages(spark, data):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op2_html_main_text(spark, data).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_deep_and_broken_pages():
    assert html_extract.main_text("<div>" * 5000 + "deep", []) == "deep"
    assert html_extract.main_text("<p>a &amp b <!-- open", []) == "a & b"
    assert html_extract.main_text("<article><p>Intro to a table<table><tr><td>c1<td>c2</table></article>", []) == "Intro to a table\nc1\nc2"


BODY = "Long body text goes on and on. " * 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p title=it's>Hello world, here.</p><p>It's fine here.</p><p>Bye then</p></article>", "Hello world, here.\nIt's fine here.\nBye then"),
        ("<div class='post'><h1>T</h1><p>Short intro.</p><div class='body'>" + BODY + "</div></div>", "T\nShort intro.\n" + BODY.strip()),
        ("<article class='post comments-open'><h1>T</h1><div><div class=x>short</div><div class=y>" + BODY + "</div></div></article>", "T\nshort\n" + BODY.strip()),
        ("<div><section><p>one</p></section><section><p>" + BODY + "</p></section></div>", "one\n" + BODY.strip()),
        ("<div><div class=a><p>" + BODY + "</p></div><div class=b><a href=1>link</a> <a href=2>more links</a></div></div>", BODY.strip()),
        ("<article><p>" + BODY + "</p><div class='comments'><p>reader</p></div><div id=no-sidebar><p>end</p></div></article>", BODY.strip() + "\nend"),
        ("<p>a <![CDATA[gone]]> b</p><!-->c<!--->d</>e</ x>f", "a b\nc d e f".replace("c d e f", "cdef")),
        ("<p data-a=\"x>y\" data-b='>' class=a/b>in quotes</p><p a='1' a=\"2\">twice</p>", "in quotes\ntwice"),
        ("<p>cut <a href='x", "cut"),
    ],
)
def test_main_text_of_odd_pages(page, want):
    assert html_extract.main_text(page, []) == want


def test_depth_changes_nothing():
    paragraphs = [f"Paragraph {i} " + "with words " * (5 + 30 * (i == 3)) for i in range(4)]
    want = "\n".join(["Title", *(p.strip() for p in paragraphs)])
    for depth in (0, 1, 7, 70, 500):
        page = "<article><h1>Title</h1>" + "".join("<div>" * depth + f"<p>{p}</p>" + "</div>" * depth for p in paragraphs) + "</article>"
        assert html_extract.main_text(page, []) == want


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x</b></i>" * 50_000, "<span>" * 50_000 + "<p>x</p>" * 50_000, "<p><span>" * 50_000 + "<ul>x", "<b>x<table></b>" * 20_000, "<a b='" * 50_000])
def test_time_grows_with_the_page_only(page):
    began = time.process_time()
    html_extract.main_text(page, [])
    assert time.process_time() - began < 10


def test_columns_and_ties_of_host_paths(spark):
    page = lambda c, t: f"<body><div class={c}><p>{t}</p></div><div class=z><p>{t}</p></div>"
    rows = [(1, "http://h/1", page("a", "one two three"), "mine", [7]), (2, "http://h/2", page("b", "four five six"), "yours", None)]
    schema = "page_id long, url string, html string, host string, paths array<int>"
    out = html_extract.extract_main_text(spark.createDataFrame(rows, schema)).orderBy("page_id").collect()
    assert [(r.host, r.paths) for r in out] == [("mine", [7]), ("yours", None)]
    again = html_extract.extract_main_text(spark.createDataFrame(rows[::-1], schema).repartition(3)).orderBy("page_id").collect()
    assert out == again  # equal votes: the order of rows doesn't matter
    assert [r.n_chars for r in out] == [len(r.text) for r in out]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://Sub.Example.ORG/es/1?q#f", ("sub.example.org", "/es/1", "example.org/es/", "block")),
        ("https://example.org/en/17", ("example.org", "/en/17", "example.org/en/1", "block")),
        ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("http://a.com/de/x", ("a.com", "/de/x", "com/de/", "block")),
        ("http://a.com", ("a.com", "", None, "allow")),
        ("http://a.net?x=casino", ("a.net", "", None, "block")),
        ("http://a.net/casinos", ("a.net", "/casinos", None, "allow")),
        ("http://free.net/free", ("free.net", "/free", None, "allow")),
        ("http://free-bets.net/", ("free-bets.net", "/", None, "block")),
        ("no scheme porn", ("", "", None, "block")),
        (None, ("", "", None, "allow")),
    ],
)
def test_url_verdicts(spark, url, want):
    r = urls.url_verdicts(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_url_vocabulary_as_a_table(spark):
    terms = [("bad", "strict", 1.0), ("a", "soft", 0.5), ("b-c", "soft", 1.0), ("c", "soft", 0.5), ("Both", "soft", 0.1), ("both", "strict", 0.1), (None, "soft", 9.0), ("", "strict", 9.0)]
    table = spark.createDataFrame(terms, "term string, kind string, weight double")
    addresses = ["http://x/BAD", "http://x/a-a-a/a", "http://x/a/c", "http://x/a/b-c", "http://x/b-c", "http://x/both", "http://x/bads", "", None, "http://y/" + "z" * 200_000 + "/bad"]
    rows = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.soft_weight, r.strict_terms, r.soft_terms) for r in urls.url_verdicts(rows, rules=(), vocabulary=table, least_weight=1.5).collect()}
    assert got == {
        0: ("block", 0.0, ["bad"], []),
        1: ("allow", 0.5, [], ["a"]),
        2: ("allow", 1.0, [], ["a", "c"]),
        3: ("block", 2.0, [], ["a", "b-c", "c"]),
        4: ("block", 1.5, [], ["b-c", "c"]),
        5: ("block", 0.0, ["both"], []),
        6: ("allow", 0.0, [], []),
        7: ("allow", 0.0, [], []),
        8: ("allow", 0.0, [], []),
        9: ("block", 0.0, ["bad"], []),
    }
    with pytest.raises(ValueError, match="terms"):
        urls.vocabulary_terms(table, most=3)


PARAGRAPHS = ["The first paragraph says a good deal about things.", "The second paragraph says a good deal more about other things."]
TWO = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
WRAPPERS = [*"overflow-hidden layout-with-sidebar layout--sidebar-left content-sidebar-wrap sr-container banner-present sticky-nav page-overlay-none".split(), *(f"page-{x}-on" for x in sorted(html_extract._NOISE | html_extract._COMMENTS | {"hidden", "sr", "skip"}))]
WHOLE = ["<body><div class='{c}'><article>{t}</article></div></body>", "<body><div id='{c}'>{t}</div></body>", "<body><div class='{c}'><div class='x'>{t}</div></div><footer>foot</footer></body>", "<body><div class='{c}'><main>{t}<form>Your mail, please</form></main></div><nav>menu</nav></body>"]
OWN = "category-notices|tag-advertising|post-share-enabled-false|entry-content social-proof|relative overflow-hidden rounded".split("|")


@pytest.mark.parametrize("page", [*(p.format(c=c, t=TWO) for c in WRAPPERS for p in WHOLE), *(f"<body><nav>m</nav><article class='{c}'>{TWO}</article><div class='share'>Share this</div></body>" for c in OWN), f"<body><form id='aspnetForm'><div class='content'>{TWO}</div><input value=x></form></body>", f"<body><div style='display:none'>{TWO}</div></body>", f"<body><div class='hidden md:block'>{TWO}</div></body>"])
def test_hints_never_empty_a_page(page):
    assert html_extract.main_text(page, []) == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize(
    "noise",
    [
        "<form><label>Mail</label> please give us your mail</form>",
        "<div class='comments'>" + "<p>Nice article, I liked it a lot and so did my friends.</p>" * 6 + "</div>",
        "<div class='hidden'>Not shown</div><span class='sr-only'>for readers</span><div class='related'><article>a teaser</article><article>another</article></div>",
        "<div class='cookie-banner'>We use cookies</div><div id='sidebar'>side</div><p class='advert'>buy</p><div role='form'>fields</div>",
    ],
)
def test_hints_still_take_noise_out(noise):
    for page in (f"<body><div class='post'>{TWO}</div>{noise}</body>", f"<body><div class='post'>{TWO}{noise}</div></body>", f"<body><article>{TWO}{noise}</article></body>"):
        assert html_extract.main_text(page, []) == "\n".join(PARAGRAPHS)


def test_a_hosts_path_never_takes_text_from_a_page(spark):
    """Pages in the way of a host, and one whose article goes on in another box."""
    words = lambda n, k: "".join(f"<p>Paragraph {i} of page {n} tells something {'more ' * 20}.</p>" for i in range(k))
    page = lambda inner: f"<body><nav>menu</nav><div class='wrap'>{inner}</div><footer>foot</footer></body>"
    odd = page(f"<div class='story'>{words(9, 3)}</div><div class='update'>{words(10, 2)}</div>")
    rows = [(i, "http://h.example/a", page(f"<div class='story'>{words(i, 4)}</div>")) for i in range(5)] + [(9, "http://h.example/b", odd)]
    frame = lambda x: spark.createDataFrame(x, "page_id long, url string, html string")
    alone, beside = (next(r for r in html_extract.extract_main_text(frame(x)).collect() if r.page_id == 9) for x in (rows[-1:], rows))
    assert alone.text == beside.text and alone.text.count("\n") == 4


def test_main_text_of_pages_without_articles(spark, data):
    """The given pages with other boxes for their articles, against what stood in these."""
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    boxed = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.concat(F.lit("<div class='layout-with-sidebar'><div class='text box-"), F.col("page_id") % 3, F.lit("'>"))), F.lit("</article>"), F.lit("</div></div>")))
    source = {r.page_id: r.html for r in pages.collect()}
    wrong = 0
    for r in html_extract.extract_main_text(boxed).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        wrong += r.text != "\n".join(b for b in blocks if b)
    assert wrong <= 0.05 * len(source)  # an article of a few words is less than its page's notices


@pytest.mark.parametrize("system", [True, False])
def test_windows_repeat_history_at_the_edges_of_blocks(spark, system):
    n = 3 * chat.BLOCK + 40
    turns = [(1, -1, "system", "Be kind to all.")] * system + [(1, i, ("user", "assistant")[i % 2], f"turn {i} says a few words") for i in range(n)]
    rows = chat.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("block", "window").collect()
    assert len({r.block for r in rows}) == 4
    heads = 1 if system else 0
    assert [r.n_repeated > heads for r in rows] == [i > 0 for i in range(len(rows))]
    texts, at = [x for _, _, _, x in turns], 0
    for r in rows:
        read = [t for _, t, _, _ in chat.read_turns(r.formatted)]
        new = read[r.n_repeated :]
        assert new == texts[at : at + len(new)]
        assert read[: r.n_repeated] == ["Be kind to all."] * (heads if at else 0) + texts[at - (r.n_repeated - (heads if at else 0)) : at]
        at += len(new)
    assert at == len(turns)
    back = chat.read_back(chat.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert back.n_turns == len(turns)
    assert back.loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in turns if r == "assistant").encode()).hexdigest()
